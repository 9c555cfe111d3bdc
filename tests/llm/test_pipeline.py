"""The pipeline on a small table: what its stages keep, and that their decisions take effect."""

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from narrata.llm import bpe
from narrata.llm.common import stored


def alike_groups(rows):
    """The least id of each group that 5-word similarities of 0.8 and more link, over all pairs."""
    sets = {}
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both * 5 >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return {root(i) for i in ids}


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {"input": docs}
    for name, stage in pipeline.STAGES:
        seen[name] = docs = stored(stage(spark, docs, sf_dir), f"test-{name}")
    for name, _ in pipeline.STAGES[:-1]:
        assert seen[name].columns == seen["input"].columns
    ids = {name: [r.doc_id for r in df.select("doc_id").collect()] for name, df in seen.items()}
    bad = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 0").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").collect()}
    kept = set(ids["quality"])
    assert len(bad & kept) <= 0.2 * len(bad) and len(good & kept) >= 0.97 * len(good)
    assert sorted(ids["near_duplicates"]) == sorted(alike_groups(seen["quality"].collect()))
    assert sorted(ids["secrets"]) == sorted(ids["near_duplicates"])
    text = " ".join(r.text for r in seen["secrets"].collect())
    assert "AKIA" not in text or "<access>" in text
    assert set(ids["mixing"]) <= set(ids["secrets"]) and len(ids["bpe"]) == len(ids["mixing"])
    rows = {(r.doc_id, r.ids_sha256) for r in seen["bpe"].collect()}
    assert rows == {(r.doc_id, r.ids_sha256) for r in bpe.encode(seen["mixing"]).collect()}


def test_run_is_the_stages(spark):
    assert pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert 4 <= len(pipeline.STAGES) <= 5


def test_empty_input(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_further_columns_may_clash_with_any_name(spark):
    """Columns named as the stages name their own come through unchanged, and rows are those without them."""
    sf_dir = "/root/testdata/sf0.001"
    docs = plain = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    names = ["score", "secrets", "rules", "_of", "_id", "_times", "_n", "_null", "_text", "_row", "_copy", "kept", "key", "bits", "size", "target", "component", "a.b"]
    docs = stored(docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in names]), "wide")
    for _, stage in pipeline.STAGES[:-1]:
        docs, plain = stored(stage(spark, docs, sf_dir), "clash"), stored(stage(spark, plain, sf_dir), "plain")
        rows = docs.collect()
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names)
        assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in plain.collect())
    assert pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == len(rows)
