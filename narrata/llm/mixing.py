"""Mixing sources to target weights by weighted fair queueing.

Every document gets virtual finish times: the tokens of its source up to and with it, in shuffled
order, divided by the source's target. A document may be taken up to ``repeats`` times; a later pass
over the source starts where the former ended. All copies are then ranged by finish time, and the mix
is cut where the total budget is reached, so every source ends near its target.

All of it is DataFrame work on slim rows (no texts after the first scan). Running totals are made in
two levels, over buckets of the shuffle key and inside a bucket, so that a source with a third of all
rows is split like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, documents, in_order, stored

#: Fractions of virtual time in which the cut is searched; it lies near 1. From FAR on they widen, so their number is bounded.
TICKS, FAR = 4096, 2.0


def _ranked(sizes: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0 in order of skey: ranges of keys are ranked apart, after the rows of the ranges before."""
    parts = stored(sizes.repartitionByRange("skey").withColumn("part", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row a range, as many as there are shuffle partitions
    starts = parts.groupBy("part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return parts.join(starts, "part").withColumn("rank", F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy("skey")) - 1).drop("part", "start")


def targets(sizes: DataFrame, weights=(1, 2, 3), repeats: int = 3) -> DataFrame:
    """One row a source (skey, source_size) to its target.

    Sources in order take ``weights`` in turn and share the total in proportion. A target stops at
    ``repeats`` times the source's size, and the excess is shared again by weight until none is above: each
    round is one sum over the sources, and a round that stops no further source is the last.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int")).cast("long")
    rows = stored(_ranked(sizes).select("skey", "source_size", w.alias("weight"), (F.lit(repeats) * F.col("source_size")).alias("cap")), "mix-weights")
    budget = rows.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        full = F.lit(level) * F.col("weight") > F.col("cap")
        n, caps, left = rows.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if n == stopped or not left:
            break
        level, stopped = (budget - caps) / left, n
    return rows.select("skey", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"), F.lit(budget).cast("long").alias("budget"))


def mix(docs: DataFrame, weights=(1, 2, 3), repeats: int = 3, keep=()) -> DataFrame:
    """doc_id, size, source_size, target, taken (and the columns named in ``keep``), a row a document.

    ``size`` counts words; a null text has none. A null source is a source of its own, the last. Empty
    texts and sources have size 0 and take nothing. Repeated rows are documents of their own; documents
    with the same id are ordered by size and a digest of the text, and equal ones take what their places give.
    The order is a digest of the id, so runs agree. ``keep`` must not name a column of the result. An empty
    table gives an empty result.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    slim = stored(
        docs.select(
            F.struct("doc_id", *keep).alias("kept"),
            F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source"))).alias("skey"),
            F.coalesce(F.regexp_count("text", F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long").alias("size"),
            key.alias("key"),
            F.xxhash64("text").alias("tie"),
        ).withColumn("bucket", F.substring("key", 1, 3)),
        "mix-sizes",
    )
    sums = slim.groupBy("skey", "bucket").agg(F.sum("size").alias("n"))
    aim = targets(sums.groupBy("skey").agg(F.sum("n").alias("source_size")), weights, repeats)
    ahead = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n").join(aim, "skey")
    inside = Window.partitionBy("skey", "bucket").orderBy("key", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = stored(
        slim.join(starts, ["skey", "bucket"])
        .withColumn("upto", F.col("start") + F.sum("size").over(inside))
        .select("kept", "key", "size", "source_size", "target", "budget", "upto"),
        "mix-places",
    )
    finish = lambda e: (F.lit(e) * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")
    tick = lambda f: F.when(f < FAR, F.floor(f * TICKS)).otherwise(int(FAR * TICKS) + F.floor(F.log2(f / FAR) * 64))
    copies = placed.filter("size > 0").select("key", "size", "budget", F.explode(F.array(*[F.struct(finish(e).alias("finish"), F.lit(e).alias("e")) for e in range(repeats)])).alias("at"))
    copies = copies.select("key", "size", "budget", F.col("at.finish").alias("finish"), F.col("at.e").alias("e")).withColumn("tick", tick(F.col("finish")))
    so_far = Window.orderBy("tick")
    sums = copies.groupBy("tick").agg(F.sum("size").alias("n"), F.max("budget").alias("budget")).withColumn("upto", F.sum("n").over(so_far))
    # a single row: the first tick that goes over the budget
    cut = sums.filter("upto > budget").orderBy("tick").limit(1).select("tick", (F.col("upto") - F.col("n")).alias("before")).first()
    taken = [F.lit(1)] * repeats
    if cut:
        order = Window.orderBy("finish", "key", "size", "e").rowsBetween(Window.unboundedPreceding, 0)
        last = (
            copies.filter(F.col("tick") == cut["tick"])
            .withColumn("upto", F.lit(cut["before"]) + F.sum("size").over(order))
            .filter("upto <= budget")
            .agg(F.max(F.struct("finish", "key", "size", "e")).alias("last"))
            .first()["last"]
        )
        end = F.struct(F.lit(last["finish"]).cast("double"), F.lit(last["key"]), F.lit(last["size"]).cast("long"), F.lit(last["e"]).cast("int")) if last else None
        taken = [
            ((tick(finish(e)) < cut["tick"]) | ((tick(finish(e)) == cut["tick"]) & (F.struct(finish(e), F.col("key"), F.col("size"), F.lit(e)) <= end) if last else F.lit(False))).cast("long")
            for e in range(repeats)
        ]
    n = taken[0]
    for x in taken[1:]:
        n = n + x
    return placed.select("kept.*", "size", "source_size", "target", F.when(F.col("size") > 0, n * F.col("size")).otherwise(0).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights=(1, 2, 3), repeats: int = 3) -> DataFrame:
    """The rows of the mix: each row of ``docs`` as often as it is taken, none to ``repeats`` times.

    Documents without words take no part. Rows that are equal in id, text and source are taken together, as the
    least of them by its other columns.
    """
    same = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.xxhash64("text", "source").alias("_text")]
    shares = mix(docs.select("doc_id", "text", "source", *same), weights, repeats, ("_id", "_text")).filter("taken > 0")
    shares = shares.groupBy("_id", "_text").agg(F.sum(F.floor(F.col("taken") / F.col("size"))).cast("int").alias("_times"))
    # one of each before the join, so that equal rows are thinned before they are shuffled
    rows, order = in_order(docs, *same)
    at = Window.partitionBy("_id", "_text").orderBy(order)
    once = rows.withColumn("_n", F.row_number().over(at)).filter("_n = 1")
    rows = once.join(shares.hint("shuffle_hash"), ["_id", "_text"])
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


#: The same mix in DuckDB.
OP9_SQL = rf"""
WITH slim AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         coalesce(len(regexp_extract_all(text, '[^{SPACE}]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
sizes AS (SELECT skey, sum(size)::BIGINT AS source_size FROM slim GROUP BY skey),
weighed AS (SELECT *, (row_number() OVER (ORDER BY skey) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM sizes),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY cap::DOUBLE / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
aims AS (SELECT skey, source_size, least(cap::DOUBLE, max(level) OVER () * weight) AS target, sum(source_size) OVER () AS budget FROM levels),
placed AS (
  SELECT s.*, a.source_size, a.target, a.budget, row_number() OVER () AS id,
         sum(size) OVER (PARTITION BY skey ORDER BY key, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM slim s JOIN aims a USING (skey)),
copies AS (
  SELECT p.*, e.e, (e.e * source_size + upto)::DOUBLE / target AS finish
  FROM placed p, (VALUES (0), (1), (2)) e(e) WHERE size > 0),
ranged AS (SELECT *, sum(size) OVER (ORDER BY finish, key, size, e ROWS UNBOUNDED PRECEDING) AS total FROM copies),
taken AS (SELECT id, sum(size) AS taken FROM ranged WHERE total <= budget GROUP BY id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM placed LEFT JOIN taken USING (id)
"""
