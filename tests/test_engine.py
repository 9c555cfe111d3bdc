"""The graph of stages: order, one scan, equal outputs, dead letters and the trace."""

import pytest
from pyspark.sql import functions as F

from narrata.functions.text import extracted_normal
from narrata.operators import engine, passages, plain, staging
from narrata.operators.engine import Graph, Stage


def rows(df):
    return sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


def test_order_by_what_is_needed(spark):
    s = lambda name, needs, makes: Stage(name, needs, makes, lambda *x: x[0])
    stages = [s("c", ("b", "a"), "c"), s("a", ("in",), "a"), s("b", ("a",), "b")]
    assert [x.name for x in Graph(stages).ordered({"in"})] == ["a", "b", "c"]
    with pytest.raises(ValueError, match=r"a \(x\), b \(y\)"):
        Graph([s("a", ("x",), "y"), s("b", ("y",), "x")]).ordered({"in"})
    with pytest.raises(ValueError, match="two stages"):
        Graph([s("a", ("in",), "a"), s("b", ("in",), "a")])


def test_stages_equal_the_single_operators(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id % 4 = 1").select("doc_id", "text")
    out = Graph(engine.ENRICHED).execute(documents=docs)
    clean = docs.select("doc_id", extracted_normal(F.coalesce("text", F.lit(""))).alias("text"))
    built = staging.rebuilt_texts(clean)
    assert rows(out.tables["rebuilt"]) == rows(built)
    assert rows(out.tables["readability"]) == rows(passages.readability(built))
    assert rows(out.tables["sentiment"]) == rows(passages.sentiment_flow(built))
    assert rows(out.tables["plain_blocks"]) == rows(plain.plain_blocks(built))
    assert out.tables["blocks"].count() == out.tables["plain_blocks"].count() and out.dead.count() == 0
    made = out.tables["documents_made"].collect()
    assert len(made) == docs.count() and sum(r.blocks for r in made) == out.tables["blocks"].count()
    plan = out.tables["plan"].groupBy("doc_id").agg(F.sum("cues").alias("n")).collect()
    assert sum(r.n for r in plan) == out.tables["blocks"].count()
    # the trace counts what was written, by one job a stage
    assert len(out.trace) == len(engine.ENRICHED) >= 11
    by = {t["stage"]: t for t in out.trace}
    for stage in engine.ENRICHED:
        assert by[stage.name]["rows_out"] == out.tables[stage.makes].count() and by[stage.name]["jobs"] == 1 and by[stage.name]["seconds"] > 0
    assert by["Sentiment Enrichment"]["rows_in"] == out.tables["plain_blocks"].count() + out.tables["flow"].count()
    assert engine.trace_table(spark, out).count() == len(out.trace)


def test_only_what_is_wanted(spark):
    docs = spark.createDataFrame([(1, "One. Two."), (2, None)], "doc_id long, text string")
    out = Graph(engine.ENRICHED).execute({"readability"}, documents=docs)
    assert [t["stage"] for t in out.trace] == ["Text Cleaning", "Paragraph Reconstruction", "Readability Analysis"] and out.tables["readability"].count() == 2
    assert {s.makes for s in engine.BASIC} == {"clean", "rebuilt", "plain_blocks"}


def test_a_failing_document_is_a_dead_letter(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    stop = lambda df, *bad: df.withColumn("text", F.when(F.col("doc_id").isin(*bad), F.raise_error(F.concat(F.lit("cannot do "), F.col("doc_id").cast("string")))).otherwise(F.col("text")).cast("string"))
    stages = [
        Stage("first", ("documents",), "one", lambda d: stop(d, 13, 44)), Stage("second", ("one", "documents"), "two", lambda a, d: stop(a, 13, 7).join(d.select("doc_id"), "doc_id")),
        Stage("last", ("two", "documents"), "three", lambda a, d: d.join(a.groupBy("doc_id").count(), "doc_id", "left")),
    ]
    out = Graph(stages).execute(documents=docs)
    dead = {(r.doc_id, r.stage) for r in out.dead.collect()}
    assert dead == {(13, "first"), (44, "first"), (7, "second")} and all("cannot do" in r.error or "USER_RAISED" in r.error for r in out.dead.collect())
    assert {r.doc_id for r in out.tables["two"].collect()} == {r.doc_id for r in out.tables["three"].collect()} == set(range(60)) - {7, 13, 44}


def test_empty_and_all_failing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = Graph(engine.ENRICHED).execute(documents=docs)
    assert out.tables["documents_made"].count() == 0 and out.dead.count() == 0
    one = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    out = Graph([Stage("s", ("documents",), "t", lambda d: d.withColumn("text", F.raise_error(F.lit("no")).cast("string")))]).execute(documents=one)
    assert out.tables["t"].count() == 0 and [r.doc_id for r in out.dead.collect()] == [1]


def _failing(monkeypatch, makes, what):
    """The stages of the query, where what makes a table does so by way of ``what(df)``."""
    stages = [Stage(s.name, s.needs, s.makes, (lambda *x, run=s.run: what(run(*x))) if s.makes == makes else s.run) for s in engine.ENRICHED]
    monkeypatch.setattr(engine, "ENRICHED", stages)


def test_queries_tell_of_documents_that_a_stage_fails_for(spark, tmp_path, monkeypatch):
    from narrata.plans import engine_queries

    spark.createDataFrame([(i, f"Text {i} is here. It goes on!") for i in range(12)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    bad = F.when(F.col("doc_id").isin(3, 8), F.raise_error(F.lit("cannot do it")).cast("double")).otherwise(F.col("reading_ease"))
    _failing(monkeypatch, "readability", lambda df: df.withColumn("reading_ease", bad))
    got = {r.doc_id: r for r in engine_queries.engine_documents(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(12))
    for i, r in got.items():
        assert (r.stage, r.words, r.blocks) == ("Readability Analysis", None, None) and "cannot do it" in r.error if i in (3, 8) else r.stage is None and r.error is None and r.words == 6 and r.blocks > 0
    trace = {r.stage: r for r in engine_queries.stage_trace(spark, str(tmp_path)).collect()}
    assert {s for s, r in trace.items() if r.lost} == {"Readability Analysis"} and trace["Readability Analysis"].lost == 2


def test_a_failure_of_the_store_is_no_dead_letter(spark, tmp_path, monkeypatch):
    docs = spark.range(4).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    (tmp_path / "file").write_text("in the way")
    monkeypatch.setattr(engine, "shared_folder", lambda spark: f"file://{tmp_path}/file")
    with pytest.raises(Exception, match="(?i)mkdirs|not a directory|parent path|create"):
        Graph([Stage("s", ("documents",), "t", lambda d: d)]).execute(documents=docs)


def test_tables_are_read_in_even_splits_and_inputs_of_few_splits_are_dealt(spark, tmp_path, monkeypatch):
    """One file of many documents is more than one task's work at each stage; the session's own sizes stay."""
    from narrata.plans import engine_queries

    spark.range(400).select(F.col("id").alias("doc_id"), F.lit("Some text.").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    count = lambda d: seen.append((d.rdd.getNumPartitions(), spark.conf.get("spark.sql.files.maxPartitionBytes"))) or d
    monkeypatch.setattr(engine, "ENRICHED", [Stage("a", ("documents",), "one", count), Stage("b", ("one",), "two", count)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert [r.rows_out for r in engine_queries.stage_trace(spark, str(tmp_path)).collect()] == [400, 400]
    assert all(n >= spark.sparkContext.defaultParallelism and size == str(engine.SPLIT) for n, size in seen) and len(seen) == 2
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert [engine._bytes(x) for x in ("134217728b", "128MB", "1g", "7")] == [1 << 27, 1 << 27, 1 << 30, 7]


def test_what_a_stage_writes_as_it_is_made_is_searched_too(spark):
    docs = spark.range(8).select(F.col("id").alias("doc_id"))
    bad = lambda d: engine.saved(d.withColumn("x", F.when(F.col("doc_id") == 5, F.raise_error(F.lit("no")).cast("int")).otherwise(1)), "own")
    out = Graph([Stage("s", ("documents",), "t", bad)]).execute(documents=docs)
    assert [r.doc_id for r in out.dead.collect()] == [5] and {r.doc_id for r in out.tables["t"].collect()} == set(range(8)) - {5}
