"""From documents to token ids: five stages, each by an operator of ``narrata.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return
the columns of documents. Null texts count as empty, repeated rows and ids are treated as the operators say,
and empty tables go through. Texts of any length are treated whole. Ties are settled by content: of near-duplicates
the smallest id stays, of rows with one id the least as a whole, and documents with one id are mixed in order of size and a
digest of their texts. Further columns, of any name and type, are carried along unchanged; the last stage
gives the token ids of a row beside its doc_id and source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.llm import bpe, mixing, near, quality, secrets
from narrata.llm.common import nested, stored

#: Bits in which fingerprints of candidates for near-duplicates may differ. As 5-word similarities of 0.8 and more
#: lie at 3 to 11 bits, MinHash bands search too, and what either finds is verified.
RADIUS = 3


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the line field rejects."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = quality.scored(nested(docs, "doc_id", "text"), model, ["_row"])
    return rows.filter(F.col("score") >= quality.THRESHOLD).select("_row.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: 5-word similarity of 0.8 or more."""
    return near.one_of_each(docs, radius=RADIUS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by their kinds."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as the mix of sources does."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids_sha256, decoded_sha256 and the token ids of every row."""
    return bpe.encode(docs, keep=("source",), ids=True)


STAGES = [("quality", classify), ("near_duplicates", deduplicate), ("secrets", redact), ("mixing", mix), ("bpe", tokenize)]

#: SQL can express neither the field nor the fingerprints nor the encoding; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
