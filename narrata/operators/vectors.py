"""Vector search: exact cosine top-k of query vectors against a history, by cells that bounds let be skipped."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.sinks import written

#: Most cells, which all tasks know the centres of; rows of cells, and queries, that meet in one task.
CELLS, ROWS, QUERIES = 1024, 16_384, 16_384
#: Pairs of a query and a row that are few enough to compare all, and queries then sent in a row, and at most.
FEW, BLOCK, MOST_SENT = 1 << 24, 256, 4096
#: Cosines of matrix products are trusted to this; what lies nearer is told apart by the exact sum.
NEAR = 1e-9
#: The cell of vectors without a direction: their cosine is 0.
NOWHERE = -1


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """0 where a vector is zero; an error where widths differ."""
    sound = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different widths"))).otherwise(F.lit(True))
    scale = norm(a) * norm(b)
    return F.when(sound & (scale > 0), dot(a, b) / scale).otherwise(0.0)


def _units(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one width and none zero, as unit vectors."""
    x = np.asarray(column.flatten(), float).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1.0, 1.0))


def _met(pairs: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """(query, id, near) over (query, v, part, cells) and (id, v, part, cell): of each query and cell, or piece of a large cell, what may be among the k nearest.

    A query's vector goes to a part of many cells once, with the cells it looks into.
    """
    count = lambda df, most, name: df.groupBy("part").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    # a row a part; by a shuffled join all vectors would be written once more
    sizes = F.broadcast(count(placed, ROWS, "across").join(count(pairs, QUERIES, "down"), "part"))
    dealt = lambda df, key, own, other: df.join(sizes, "part").withColumns({own[0]: F.pmod(F.xxhash64(key), F.col(own[1])).cast("int"), other[0]: F.explode(F.sequence(F.lit(0), F.col(other[1]) - 1))}).drop("across", "down")
    left, right = dealt(pairs, "query", ("d", "down"), ("a", "across")), dealt(placed.select("id", "v", "cell", "part"), "id", ("a", "across"), ("d", "down"))
    schema = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("near", pa.float64())])

    def tile(q: pa.Table, h: pa.Table) -> pa.Table:
        if not q.num_rows or not h.num_rows:
            return schema.empty_table()
        cells, vectors = q.column("cells").combine_chunks(), h.column("v").combine_chunks()
        asked, wanted = np.repeat(np.arange(q.num_rows), pc.list_value_length(cells).to_numpy(zero_copy_only=False)), cells.flatten().to_numpy(zero_copy_only=False)
        every, all_ids, of = q.column("query").to_numpy(), h.column("id").to_numpy(), h.column("cell").to_numpy()
        units = _units(q.column("v").combine_chunks())
        out = ([every[:0]], [all_ids[:0]], [np.zeros(0)])
        for cell in np.unique(of):
            who, here = asked[wanted == cell], np.flatnonzero(of == cell)
            if not len(who):
                continue
            names, ids, zero = every[who], all_ids[here], cell == NOWHERE
            x, y = units[who], None if zero else _units(vectors.take(pa.array(here)))
            for i in range(0, len(x), 256):
                near = np.zeros((len(x[i : i + 256]), len(ids))) if zero else x[i : i + 256] @ y.T
                near[names[i : i + 256, None] == ids[None]] = -2.0
                least = np.partition(near, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)] if len(ids) > k else np.full(len(near), -1.5)
                for row, bound in enumerate(least):
                    at = np.flatnonzero(near[row] >= max(bound - NEAR, -1.5))
                    if zero:
                        # all are equally near: those with the least ids stand first
                        at = at[np.argsort(ids[at], kind="stable")[:k]]
                    out[0].append(np.full(len(at), names[i + row]))
                    out[1].append(ids[at])
                    out[2].append(near[row, at])
        return pa.table([pa.array(np.concatenate(c), f.type) for c, f in zip(out, schema)], schema=schema)

    key = ("part", "a", "d")
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(n, *key).groupBy(*key).cogroup(right.repartition(n, *key).groupBy(*key)).applyInArrow(tile, "query long, id long, near double")


def _of_few(queries: DataFrame, history: DataFrame, n: int, k: int, id_: str, vector: str) -> DataFrame:
    """As ``nearest``, for n queries of a checked number: blocks of them are sent to all rows."""
    stated = queries.select(F.struct(F.col(id_).alias("q"), F.col(vector).alias("v"), norm(F.col(vector)).alias("n")).alias("x"))
    block = stated.groupBy(F.pmod(F.xxhash64("x.q"), F.lit(max(1, -(-n // BLOCK)))).alias("_part")).agg(F.collect_list("x").alias("_block")).drop("_part")
    rows = history.select(F.col(id_).alias("id"), F.col(vector).alias("_v"), norm(F.col(vector)).alias("_n"))
    met = rows.join(F.broadcast(block)).select("id", "_v", "_n", F.explode("_block").alias("b")).filter("id <> b.q")
    scale = F.col("_n") * F.col("b.n")
    met = met.select(F.col("b.q").alias("query"), "id", F.when(scale > 0, dot(F.col("_v"), F.col("b.v")) / scale).otherwise(0.0).alias("similarity"))
    at = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return met.withColumn("rank", F.row_number().over(at)).filter(F.col("rank") <= k).select("query", "rank", "id", "similarity")


def nearest(queries: DataFrame, history: DataFrame, k: int = 2, id_: str = "vec_id", vector: str = "embedding", probes: int = 2, skipped: list | None = None, few: int = FEW) -> DataFrame:
    """(query, rank, id, similarity) of the k nearest of other ids, ties by id; exact.

    The history is read once and put in cells around some of its vectors. A cell's largest angle to its centre bounds how near
    anything in it can be to a query. Each query first looks into the ``probes`` nearest cells; of the others only those whose
    bound is not below what it has found are looked into. Queries and rows of a cell meet in parts of bounded size. ``skipped`` gets
    the pairs of a query and a cell there are, and those that were looked into. Vectors have one width, and no null in them;
    one that is zero is 0 like to all. Rows without a vector or an id take no part. Where there are ``few`` pairs at most, all are compared.
    """
    spark = history.sparkSession
    # single precision stays so until it is reckoned with, which is in double precision
    kind = "float" if dict(history.dtypes)[vector] == dict(queries.dtypes)[vector] == "array<float>" else "double"
    fine = lambda df: df.filter(F.col(id_).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(id_).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"))
    rows = fine(history)
    n, many = rows.count(), fine(queries).count()
    if n * many <= few and many <= MOST_SENT:
        return _of_few(fine(queries), rows, many, k, "id", "v")
    # of a bounded number: centres that every task gets
    picked = rows.filter(norm("v") > 0).orderBy(F.xxhash64("id"), "id").limit(min(CELLS, max(1, int(n**0.5)))).collect()
    centres = np.array([r.v for r in picked] or [[1.0]], float)
    centres = centres / np.linalg.norm(centres, axis=1, keepdims=True)

    def place(batches):
        for batch in batches:
            ids, v = batch.column(0), batch.column(1)
            cell, far = np.full(len(ids), NOWHERE), np.zeros(len(ids))
            some = np.asarray(v.flatten(), float).reshape(len(ids), -1).any(axis=1) if len(ids) else np.zeros(0, bool)
            if some.any():
                angle = _angles(_units(v.filter(pa.array(some))), centres)
                cell[some], far[some] = angle.argmin(axis=1), angle.min(axis=1)
            yield pa.RecordBatch.from_arrays([ids, v, pa.array(cell, pa.int32()), pa.array(far)], names=["id", "v", "cell", "far"])

    placed = written(rows.mapInArrow(place, f"id long, v array<{kind}>, cell int, far double"), "placed-vectors")
    # a row a cell
    told = placed.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).orderBy("cell").collect()
    widest = {r.cell: r.far for r in told}
    # cells in parts of about as many rows as meet in a task
    part_of, held = {}, 0
    for r in told:
        new = not part_of or held + r.n > ROWS or NOWHERE in part_of and len(part_of) == 1
        held = r.n if new else held + r.n
        part_of[r.cell] = max(part_of.values(), default=-1) + new
    placed = placed.join(F.broadcast(spark.createDataFrame(list(part_of.items()) or [(NOWHERE, 0)], "cell int, part int")), "cell")
    asked = written(fine(queries).select(F.col("id").alias("query"), "v", norm("v").alias("n")), "queries")
    cells = sorted(c for c in widest if c != NOWHERE)

    def bounds(batches, found: bool):
        """(query, v, part, cells), a row a query and part: the nearest cells of queries; with what they found (least), all others that may hold as near ones."""
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v")
            angle = _angles(_units(v), centres[cells])
            first = np.zeros(angle.shape, bool)
            np.put_along_axis(first, np.argsort(angle, axis=1, kind="stable")[:, :probes], True, axis=1)
            if found:
                bound = np.cos(np.maximum(0.0, angle - np.array([widest[c] for c in cells])))
                least = batch.column("least").to_numpy(zero_copy_only=False)[:, None] - NEAR
                q, c = np.nonzero(~first & (bound >= least))
                other = np.flatnonzero(least[:, 0] <= 0.0) if NOWHERE in widest else np.zeros(0, int)
                q, c = np.concatenate((q, other)), np.concatenate((np.array(cells)[c], np.full(len(other), NOWHERE)))
            else:
                q, c = np.nonzero(first)
                c = np.array(cells)[c]
            part = np.array([part_of[x] for x in c.tolist()], np.int32)
            order = np.lexsort((c, part, q))
            q, c, part = q[order], c[order], part[order]
            first_of = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (part[1:] != part[:-1])][: len(q)])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[first_of, len(q)], pa.int32()), pa.array(c, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("query").take(pa.array(q[first_of])), v.take(pa.array(q[first_of])), pa.array(part[first_of]), lists], names=["query", "v", "part", "cells"])

    schema = f"query long, v array<{kind}>, part int, cells array<int>"
    if cells:
        one = written(_met(asked.filter("n > 0").select("query", "v").mapInArrow(lambda b: bounds(b, False), schema), placed, k), "found")
        at = Window.partitionBy("query").orderBy(F.desc("near"))
        least = one.withColumn("_n", F.row_number().over(at)).filter(F.col("_n") == k).select("query", F.col("near").alias("least"))
        open_ = asked.filter("n > 0").join(least, "query", "left").select("query", "v", F.coalesce("least", F.lit(-2.0)).alias("least"))
        more = written(open_.mapInArrow(lambda b: bounds(b, True), schema), "cells-left")
        if skipped is not None:
            directed = asked.filter("n > 0").count()
            skipped.append((directed * len(widest), directed * min(probes, len(cells)) + (more.agg(F.sum(F.size("cells"))).first()[0] or 0)))
        found = one.union(_met(more, placed, k)).select("query", "id")
    else:
        found = spark.createDataFrame([], "query long, id long")
    # a query without a direction is 0 like to all: those with the least ids
    first_ids = F.broadcast(rows.select("id").orderBy("id").limit(k + 1))
    none = asked.filter("n = 0" if cells else "true").select("query").join(first_ids, F.col("query") != F.col("id")).select("query", "id")
    pairs = found.union(none).distinct()
    q = asked.select("query", F.col("v").alias("_q"), F.col("n").alias("_qn"))
    met = pairs.join(q, "query").join(placed.select("id", F.col("v").alias("_v"), norm("v").alias("_n")), "id")
    scale = F.col("_n") * F.col("_qn")
    met = met.select("query", "id", F.when(scale > 0, dot(F.col("_v"), F.col("_q")) / F.when(scale > 0, scale)).otherwise(0.0).alias("similarity"))
    at = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return met.withColumn("rank", F.row_number().over(at)).filter(F.col("rank") <= k).select("query", "rank", "id", "similarity")
