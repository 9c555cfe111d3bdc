"""Hard negatives: for each anchor and each of its positives, the different-label rows that score just below.

Each anchor's scores are computed and sorted in full, by score and id; a positive's upper limit is found in them by
binary search, and rows are read from there while they are over the lower limit. As no task may hold all scores of
an anchor, anchors and rows are dealt to tiles of bounded size: each tile sorts the scores of its anchors with its rows,
and gives the heads that can stand in the merged order. A first pass gives the positives, a second the negatives, for
which the positives set the limits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

#: Anchors of a tile, and components of its rows: what a task holds of each.
ANCHORS, COMPONENTS = 512, 1 << 20
#: Scores that are sorted at once in a task.
AT_ONCE = 1 << 21
LEAST, MOST = -(2**63), 2**63 - 1


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(uid, vec_id, label, x): rows that take part, with components floor(256 x) as longs (beyond a long, its bounds)."""
    e = F.col("embedding")
    sound = e.isNotNull() & F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    x = F.transform(e, lambda x: F.floor(x.cast("double") * 256))
    return vectors.filter(sound).select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of longs, as longs; beyond a long, its bounds."""
    most = lambda m: max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
    bound = most(a) * most(b) * a.shape[1]
    if bound < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if bound < 2**63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, LEAST, MOST).astype(np.int64)


def limits(score: int, low: int = 50, high: int = 95) -> tuple[int, int]:
    """Least and largest score n of a negative: low * score <= 100 * n <= high * score."""
    return -((-low * score) // 100), high * score // 100


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    values = np.asarray(column.flatten(), np.int64)
    return values.reshape(len(column), len(values) // max(1, len(column)))


def _in_tile(anchors: pa.Table, rows: pa.Table):
    """Of each anchor of a tile: (its place, its scores in order, the places of the rows they belong to).

    Rows come by id, so a stable sort by falling score is one by score and id.
    """
    rows = rows.sort_by([("vec_id", "ascending"), ("uid", "ascending")])
    x, y = _matrix(anchors.column("x")), _matrix(rows.column("x"))
    step = max(1, AT_ONCE // len(y))
    for i in range(0, len(x), step):
        block = scores(x[i : i + step], y)
        for k, line in enumerate(block):
            # -2**63 has no negative of its own
            order = np.argsort(~line, kind="stable")
            yield i + k, line[order], order, rows


def _tiles(anchors: DataFrame, rows: DataFrame, each, schema: str) -> DataFrame:
    """``each(anchors, rows)`` (Arrow tables) for all tiles of anchors and rows of one width."""
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
    deep = max(1, -(-facts["n"] * max(1, facts["width"] or 1) // COMPONENTS))
    wide = max(1, -(-anchors.count() // ANCHORS))
    deal = lambda df, n, salt: F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(n)).cast("int")
    of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # columns of their own: both sides come from one table
    left = anchors.select(*[F.col(c).alias(c) for c in anchors.columns]).withColumn("down", deal(anchors, wide, 1)).withColumn("across", of(deep)).withColumn("width", F.size("x"))
    right = rows.withColumn("across", deal(rows, deep, 2)).withColumn("down", of(wide)).withColumn("width", F.size("x"))
    key = ("down", "across", "width")

    def tile(a, b):
        return each(a, b) if a.num_rows and b.num_rows else pa.Table.from_batches([], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    # a tile is little to read and much to do, so tiles are not to be put together by their bytes
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(n, *key).groupBy(*key).cogroup(right.repartition(n, *key).groupBy(*key)).applyInArrow(tile, schema)


def positives(anchors: DataFrame, rows: DataFrame, many: int = 5) -> DataFrame:
    """(anchor, anchor_id, place, positive_id, score): the first ``many`` other rows of each anchor's label."""
    schema = "anchor long, anchor_id long, uid long, vec_id long, score long"

    def each(a, b):
        uid, vec_id, label = (a.column(c).to_numpy() for c in ("uid", "vec_id", "label"))
        out = [[], [], [], [], []]
        for k, line, order, rows in _in_tile(a, b):
            uids, ids = rows.column("uid").to_numpy(), rows.column("vec_id").to_numpy()
            at = np.flatnonzero((rows.column("label").to_numpy()[order] == label[k]) & (uids[order] != uid[k]))[:many]
            for column, values in zip(out, (np.full(len(at), uid[k]), np.full(len(at), vec_id[k]), uids[order[at]], ids[order[at]], line[at])):
                column.append(values)
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in out], names=["anchor", "anchor_id", "uid", "vec_id", "score"])

    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "uid")
    found = _tiles(anchors, rows, each, schema).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= many)
    return found.select("anchor", "anchor_id", "place", F.col("vec_id").alias("positive_id"), "score")


def negatives(anchors: DataFrame, rows: DataFrame, found: DataFrame, many: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``positives``."""
    schema = "anchor long, place int, uid long, vec_id long, score long"
    # at most as many positives an anchor as were asked for
    asked = found.groupBy("anchor").agg(F.collect_list(F.struct("place", "score")).alias("asked"))
    anchors = anchors.join(asked, F.col("uid") == F.col("anchor")).drop("anchor")

    def each(a, b):
        uid, label, asked = a.column("uid").to_numpy(), a.column("label").to_numpy(), a.column("asked").to_pylist()
        out = [[], [], [], [], []]
        for k, line, order, rows in _in_tile(a, b):
            other = rows.column("label").to_numpy()[order] != label[k]
            line, order = line[other], order[other]
            uids, ids = rows.column("uid").to_numpy(), rows.column("vec_id").to_numpy()
            for x in asked[k]:
                least, most = limits(x["score"], low, high)
                start = len(line) - np.searchsorted(line[::-1], most, side="right")
                at = np.arange(start, min(start + many, len(line)))
                at = at[line[at] >= least]
                for column, values in zip(out, (np.full(len(at), uid[k]), np.full(len(at), x["place"]), uids[order[at]], ids[order[at]], line[at])):
                    column.append(values)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(np.concatenate(c), kind) for c, kind in zip(out, kinds)], names=["anchor", "place", "uid", "vec_id", "score"])

    first = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id", "uid")
    heads = _tiles(anchors, rows, each, schema).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= many)
    heads = heads.select("anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(heads, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")


def mine(vectors: DataFrame, every: int = 50, many_positives: int = 5, many: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, embedding, label).

    Anchors are rows whose vec_id is divisible by ``every``; scores are integer inner products of floor(256 x). Rows with a null
    id, label or vector, or a null or non-finite component, take no part. Only vectors of one width have a score;
    components and scores beyond a long are its bounds. Higher scores come first, ties by smaller vec_id. Repeated rows
    are rows of their own: each is an anchor, and a positive of the other. A positive score below zero has no
    negatives, one of zero those of zero. Anchors without positives or negatives give no rows, nor does an empty
    table. Other columns are left out.
    """
    rows = stored(whole_vectors(vectors), "whole-vectors")
    anchors = rows.filter(F.col("vec_id") % every == 0)
    found = stored(positives(anchors, rows, many_positives), "positives")
    return negatives(anchors, rows, found, many, low, high)


def relabelled(vectors: DataFrame) -> DataFrame:
    """Rows whose vec_id is divisible by 7 with the next label of ten."""
    return vectors.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(relabelled(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


#: The same in DuckDB, where scores are compared with each other.
OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.uid AS anchor, a.vec_id AS anchor_id, b.uid, b.vec_id, a.label = b.label AS same, CASE WHEN len(a.x) = len(b.x) AND len(a.x) > 0 THEN list_inner_product(a.x, b.x) ELSE 0 END::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.uid <> b.uid AND len(a.x) = len(b.x)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, uid) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER w::INTEGER AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor, p.uid ORDER BY n.score DESC, n.vec_id, n.uid)
QUALIFY row_number() OVER w <= 3
"""
