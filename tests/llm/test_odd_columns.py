"""Columns without an order, and rows that are equal but for them, through every stage that keeps one of several rows."""

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from narrata.llm import mixing, near, simhash
from narrata.llm.common import orderable, stored


def odd(docs):
    """With columns of maps, of arrays and structs of maps, of variants, and with a dot and a mark in a name."""
    at = F.create_map(F.lit("k"), F.col("doc_id").cast("string"))
    return docs.select("*", at.alias("m"), F.array(at).alias("a.b"), F.struct(at.alias("x"), F.lit(1).alias("y")).alias("s`t"), F.parse_json(F.lit('{"v": [1]}')).alias("v"), F.lit(None).cast("map<int,int>").alias("none"))


def test_stages_carry_columns_without_order(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = plain = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    docs = odd(docs)
    assert not orderable(docs.schema) and orderable(plain.schema)
    for _, stage in pipeline.STAGES[:-1]:
        docs, plain = stored(stage(spark, docs, sf_dir), "odd"), stored(stage(spark, plain, sf_dir), "plain")
        rows = docs.collect()
        assert all(r.m == {"k": str(r.doc_id)} == r["a.b"][0] == r["s`t"].x and r.none is None for r in rows)
        assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in plain.collect())
    assert pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == len(rows)


def test_rows_equal_but_for_a_map(spark):
    """One of them stays, the same whatever the partitions."""
    rows = [(1, "one two three four five six", {"k": i}) for i in (3, 1, 2)] + [(2, "other words of another text", {"k": 9}), (None, "no id", {"k": 1})]
    docs = spark.createDataFrame([(i, t, "en", "a", 1, m) for i, t, m in rows], "doc_id long, text string, lang string, source string, n_chars long, m map<string,int>")
    for one in (near.one_of_each, simhash.one_of_each):
        found = [sorted(((r.doc_id, r.m["k"]) for r in one(docs.repartition(n)).collect()), key=str) for n in (1, 3)]
        assert found[0] == found[1] and [i for i, _ in found[0]] == [1, 2, None]
    mixed = [sorted(((r.doc_id, r.m["k"]) for r in mixing.mixed(docs.repartition(n)).collect()), key=str) for n in (1, 3)]
    assert mixed[0] == mixed[1] and len({k for i, k in mixed[0] if i == 1}) == 1
