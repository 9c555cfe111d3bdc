"""Embedding near-duplicates by lattice hashing.

In each table a random rotation takes a unit vector to a few 8-dimensional blocks, and each block is decoded to
its nearest point of the E8 lattice; the points together are the cell. A vector is kept in its own cell and also
probes the neighbouring cells that it lies nearest to. What meets in a cell is compared by exact cosine.

Equal vectors are one class and are compared once. Vectors are fetched only for cells where something meets.
A cell with very many vectors is dealt to several tasks by pairs of groups, so none holds more than a bounded
number, and no pair is left out.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored
from .components import components

TABLES, BLOCKS, PROBES = 12, 3, 3
#: Side of a lattice cell, in units of a unit vector's length over the root of its width: of a wider vector a smaller
#: part falls into the projected dimensions, and cells shrink with it.
SIDE = 2.8
#: Rows of a cell that one task takes; larger cells are dealt out by groups of this size.
GROUP = 1024
SEED = 20240229
#: What the rows of one run have in common: table, cell and the groups of a large cell.
SIGN = ("t", "key", "g", "h")


def nearest_points(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Near E8 points of each row, the nearest first: doubled coordinates (rows x 6 x 8) and squared distances.

    E8 is the integer points with an even sum, and these moved by a half in all places. In each of the two
    cosets the nearest points follow from rounding and moving the worst-rounded coordinates the other way.
    """
    rows, points, far = np.arange(len(y)), [], []
    for shift in (0.0, 0.5):
        near = np.rint(y - shift)
        rest = y - shift - near
        worst = np.argsort(-np.abs(rest), axis=1, kind="stable")
        step = np.where(rest >= 0, 1.0, -1.0)

        def moved(point, k):
            out = point.copy()
            out[rows, worst[:, k]] += step[rows, worst[:, k]]
            return out

        odd = (near.sum(1) % 2 != 0)[:, None]
        for a, b in ((moved(near, 0), near), (moved(near, 1), moved(moved(near, 0), 1)), (moved(near, 2), moved(moved(near, 0), 2))):
            point = np.where(odd, a, b) + shift
            points.append(np.rint(2 * point).astype(np.int64))
            far.append(((y - point) ** 2).sum(1))
    points, far = np.stack(points, 1), np.stack(far, 1)
    order = np.argsort(far, axis=1, kind="stable")
    return np.take_along_axis(points, order[:, :, None], 1), np.take_along_axis(far, order, 1)


@lru_cache(256)
def rotation(table: int, width: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, offsets and the multipliers that pack a cell into 64 bits, for one table."""
    rng = np.random.default_rng([SEED, table, width])
    q = np.linalg.qr(rng.normal(size=(max(width, 8 * blocks), 8 * blocks)))[0]
    return q[:width], rng.random(8 * blocks), rng.integers(1, 2**63, size=8 * blocks, dtype=np.int64) | 1


def cells(unit: np.ndarray, table: int, blocks: int = BLOCKS, probes: int = PROBES, side: float = SIDE) -> np.ndarray:
    """Packed cells of unit vectors (rows x 1 + probes): their own, then the neighbours to probe."""
    directions, offsets, packing = rotation(table, unit.shape[1], blocks)
    y = unit @ directions * (np.sqrt(max(unit.shape[1], 8 * blocks)) / side) + offsets
    key, far = np.full((len(y), 1), unit.shape[1], np.int64), np.zeros((len(y), 1))
    with np.errstate(over="ignore"):
        for b in range(blocks):
            points, d = nearest_points(y[:, 8 * b : 8 * b + 8])
            part = (points[:, : probes + 1] * packing[8 * b : 8 * b + 8]).sum(2)
            key = (key[:, :, None] + part[:, None, :]).reshape(len(y), -1)
            far = (far[:, :, None] + d[:, None, : probes + 1]).reshape(len(y), -1)
            best = np.argsort(far, axis=1, kind="stable")[:, : probes + 1]
            key, far = np.take_along_axis(key, best, 1), np.take_along_axis(far, best, 1)
    return key


def unit_vectors(column) -> np.ndarray:
    """Rows of an Arrow list column, all of one width, as unit vectors in double precision."""
    x = np.asarray(column.flatten(), float).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_width(column):
    """(places, unit vectors) for each width in the column."""
    width = np.asarray(pa.compute.list_value_length(column))
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        yield at, unit_vectors(column.take(pa.array(at)))


def lattice_cells(classes: DataFrame, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, side: float = SIDE) -> DataFrame:
    """(t, key, id, own) of classes (id, embedding): where each vector is kept (own) and where it probes."""

    def each(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, unit in _by_width(batch.column(1)):
                for t in range(tables):
                    key = cells(unit, t, blocks, probes, side)
                    n, m = key.shape
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n * m, t, np.int32)), pa.array(key.ravel()), pa.array(np.repeat(ids[at], m)), pa.array(np.tile(np.arange(m) == 0, n))], names=["t", "key", "id", "own"])

    return classes.select("id", "embedding").mapInArrow(each, "t int, key long, id long, own boolean")


def _forest(label: np.ndarray, p: np.ndarray, q: np.ndarray):
    """Merges the labels of linked places; gives for each merger a pair that stands for it."""
    while len(p):
        low, high = np.minimum(label[p], label[q]), np.maximum(label[p], label[q])
        apart = low != high
        p, q, low, high = p[apart], q[apart], low[apart], high[apart]
        top, first = np.unique(high, return_index=True)
        yield p[first], q[first]
        to = np.arange(len(label))
        to[top] = low[first]
        while (to[to] != to).any():
            to = to[to]
        label[:] = to[label]


def _compare(batches, least: float, probes: int = PROBES):
    """Of runs of rows with equal SIGN: links (a, b) that span what cosines of at least ``least`` link, and counts.

    A count is a row (a, a, n): n other vectors linked to a. Each pair is counted once, in the first table where
    the two meet, and there in the least of the cells where they do; so no row a pair is needed.
    """
    held = None

    def runs(table):
        cut = np.zeros(table.num_rows - 1, bool)
        for c in SIGN:
            cut |= np.diff(table.column(c).to_numpy()) != 0
        return np.flatnonzero(cut) + 1

    def linked(table):
        table = table.combine_chunks()
        edges = np.concatenate(([0], runs(table), [table.num_rows]))
        starts, sizes = edges[:-1], np.diff(edges)
        t, keys, g, h, ids, own, group, many = (table.column(c).to_numpy() for c in ("t", "key", "g", "h", "id", "own", "group", "many"))
        a, b, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(table.num_rows, np.int64)

        def count(table_no, p, q):
            """Counts those of the pairs of places that are to be counted here."""
            if not len(p):
                return
            at, back = np.unique(np.concatenate((p, q)), return_inverse=True)
            p, q, x, y = p, q, back[: len(p)], back[len(p) :]
            for k in range(table_no + 1):
                c = cells(unit[where[at]], k, probes=probes)
                there, here = (c[x, :1] == c[y]).any(1), (c[y, :1] == c[x]).any(1)
                if k < table_no:
                    stay = ~(there | here)
                else:
                    mine = np.where(there & here, np.minimum(c[x, 0], c[y, 0]), np.where(there, c[x, 0], c[y, 0]))
                    stay = mine == keys[p]
                p, q, x, y = p[stay], q[stay], x[stay], y[stay]
            np.add.at(counts, p, many[q])
            np.add.at(counts, q, many[p])

        def link(p, q):
            a.append(np.minimum(ids[p], ids[q]))
            b.append(np.maximum(ids[p], ids[q]))

        column = table.column("embedding").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        for places, unit in _by_width(column):
            where = np.full(table.num_rows, -1)
            where[places] = np.arange(len(places))
            two = starts[sizes == 2]
            two = two[(where[two] >= 0) & (where[two + 1] >= 0) & (own[two] | own[two + 1]) & (ids[two] != ids[two + 1])]
            two = two[np.einsum("ij,ij->i", unit[where[two]], unit[where[two + 1]]) >= least]
            link(two, two + 1)
            for k in np.unique(t[two]):
                count(k, two[t[two] == k], two[t[two] == k] + 1)
            for x, n in zip(starts[sizes > 2], sizes[sizes > 2]):
                at = np.arange(x, x + n)
                at = at[where[at] >= 0]
                vectors = unit[where[at]]
                label = np.arange(len(at))
                for i in range(0, len(at), 512):
                    rows = at[i : i + 512]
                    near = vectors[i : i + 512] @ vectors.T >= least
                    near &= (own[rows, None] | own[None, at]) & (ids[rows, None] < ids[None, at])
                    if g[x] != h[x]:
                        near &= group[rows, None] != group[None, at]
                    p, q = np.nonzero(near)
                    for v, w in _forest(label, p + i, q):
                        link(at[v], at[w])
                    count(t[x], rows[p], at[q])
        some = np.flatnonzero(counts)
        zeros = np.zeros(sum(map(len, a)), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((*a, ids[some]))), pa.array(np.concatenate((*b, ids[some]))), pa.array(np.concatenate((zeros, counts[some])))], names=["a", "b", "n"])

    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        cut = runs(held)
        if len(cut):
            yield from linked(held.slice(0, cut[-1]))
            held = held.slice(cut[-1])
    if held is not None and held.num_rows:
        yield from linked(held)


def found(classes: DataFrame, least: float = 0.9, tables: int = TABLES) -> DataFrame:
    """Links and counts (a, b, n), see ``_compare``, between classes (id, embedding, n vectors each)."""
    spark = classes.sparkSession
    met = stored(lattice_cells(classes, tables), "cells")
    busy = met.groupBy("t", "key").agg(F.count("*").alias("all"), F.max("own").alias("kept")).filter("all > 1 and kept")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = met.join(busy.select("t", "key", "all"), ["t", "key"])
    groups = F.ceil(F.col("all") / GROUP).cast("int")
    rows = rows.withColumn("groups", groups).withColumn("group", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select("t", "key", F.least("group", "with").alias("g"), F.greatest("group", "with").alias("h"), "group", "id", "own")
    rows = rows.join(classes.select("id", "embedding", F.col("n").alias("many")), "id").repartition(n, *SIGN).sortWithinPartitions(*SIGN)
    return rows.select(*SIGN, "group", "id", "own", "many", "embedding").mapInArrow(lambda batches: _compare(batches, least), "a long, b long, n long")


def near_duplicates(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept, a row a vector.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do
    vectors of different widths. Equal vectors link with each other; repeated rows count as vectors of their
    own. A null vec_id never names a component. Other columns are left out; an empty table gives no rows.
    """
    e = F.col("embedding")
    sound = e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding")
    fine = rows.filter(sound)
    classes = stored(fine.groupBy("embedding").agg(F.min("vec_id").cast("long").alias("id"), F.count("*").alias("n")), "classes")
    named = classes.filter("id is not null")
    met = stored(found(named, least), "links")
    degree = met.filter("a = b").groupBy("a").agg(F.sum("n").alias("more"))
    of = components(met.filter("a != b").select("a", "b"))
    about = classes.join(degree, F.col("id") == F.col("a"), "left").join(of, F.col("id") == F.col("node"), "left")
    about = about.select("embedding", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = fine.join(about, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.filter(F.coalesce(~sound, F.lit(True))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
