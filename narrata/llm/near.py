"""Near-duplicates by the likeness of their sets of five-word shingles, verified.

Candidates come from two searches: SimHash fingerprints within a radius, and bands of MinHash values. A document is
first compared with the least one of each bucket it is in. Where a bucket then still holds documents of several
groups, all that is in it is compared, dealt to tasks in pairs of slices of bounded size. Only links of the least
likeness, computed on the whole sets, stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import in_order, stored
from .components import components

WIDTH = 5
#: The least likeness of near-duplicates, as a fraction of whole numbers.
LEAST = (4, 5)
#: MinHash bands and the values in each: of pairs at the least likeness, 1 - (1 - 0.8**7)**36 = 0.9998 meet.
BANDS, ROWS = 36, 7
#: Shingles under all hash functions at once.
BLOCK = 2048
#: A task compares at most two slices of a bucket: of so many documents and, but for a single longer one, shingles.
SLICE, MOST_SHINGLES = 512, 1 << 22
_RANDOM = np.random.default_rng(5)
_TIMES = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: bytes | None, width: int = WIDTH, seed: int = 42) -> np.ndarray:
    """Hashes of the distinct shingles in order. Words are as in ``simhash``; fewer than ``width`` make one shingle."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    last = max(1, len(words) - width + 1)
    joined, hash_of = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:last].tolist()
    ends = (ends[-last:] - 1).tolist()
    return np.unique(np.fromiter((hash_of(joined[a:b], seed) for a, b in zip(starts, ends)), np.uint64, last))


def bands(found: np.ndarray) -> np.ndarray:
    """A key a band of the MinHash values of a set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), BLOCK):
        h = found[i : i + BLOCK]
        np.minimum(least, (h[None, :] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1), out=least)
    keys = np.zeros(BANDS, np.uint64)
    for value in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ value) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


def _digest(found: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh128_digest(found.tobytes())


def _sketches(docs: DataFrame) -> DataFrame:
    def each(batches):
        for batch in batches:
            digests, keys, bits, size = [], [], [], []
            for t in batch.column(1):
                text = t.as_py()
                found = shingles(text)
                digests.append(_digest(found))
                keys.append(bands(found).view(np.int64))
                bits.append(simhash.simhash(text))
                size.append(len(found))
            made = [pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(np.array(bits, np.uint64).view(np.int64)), pa.array(size, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "digest", "bands", "bits", "size"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(each, "doc_id long, digest binary, bands array<long>, bits long, size long")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, set: its shingles' hashes as bytes) of the documents named in ids; an id that repeats has several rows."""

    def each(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], names=["id", "set"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    return rows.join(ids.hint("shuffle_hash"), "id", "left_semi").mapInArrow(each, "id long, set binary")


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * LEAST[1] >= (len(x) + len(y) - both) * LEAST[0]


def linked(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between places of ``sets`` that span the groups of all pairs of the least likeness."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    values = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    left, links = np.ones(len(sets), bool), []
    for first in range(len(sets)):
        queue = [first] if left[first] else []
        left[first] = False
        while queue:
            x = queue.pop()
            a, b = np.searchsorted(values, sets[x], "left"), np.searchsorted(values, sets[x], "right")
            n = b - a
            places = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
            both = np.bincount(owner[places], minlength=len(sets))
            near = np.flatnonzero(left & (both * LEAST[1] >= (size + size[x] - both) * LEAST[0]))
            left[near] = False
            queue.extend(near.tolist())
            links.extend((x, int(y)) for y in near)
    return links


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose sets are alike."""

    def each(batches):
        for batch in batches:
            of = lambda c: (np.frombuffer(x.as_py(), np.uint64) for x in batch.column(c))  # noqa: B023, E731
            good = pa.array([alike(x, y) for x, y in zip(of(2), of(3))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    x, y = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(each, "a long, b long")


def _slices(met: DataFrame, groups: DataFrame) -> DataFrame:
    """(band, key, g, h, id): the members of buckets (band, key, id, size) that hold several of groups (node, component).

    Each pair of slices (g, h) of a bucket is a part of its own. Buckets with the same members count once.
    """
    at = met.join(groups, F.col("id") == F.col("node"), "left").select("band", "key", "id", "size", F.coalesce("component", "id").alias("of"))
    n = F.greatest(F.ceil(F.count("*") / SLICE), F.ceil(F.sum("size") / MOST_SHINGLES)).cast("int")
    mixed = at.groupBy("band", "key").agg(n.alias("n"), F.bit_xor(F.xxhash64("id")).alias("members"), F.min("id").alias("first"), F.max("id").alias("last"), F.min("of").alias("low"), F.max("of").alias("high")).filter("low != high")
    once = mixed.groupBy("members", "first", "last", "n").agg(F.min(F.struct("band", "key")).alias("b")).select("b.band", "b.key", "n")
    rows = at.join(once, ["band", "key"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    return rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("band", "key", F.least("own", "other").alias("g"), F.greatest("own", "other").alias("h"), "id")


def _compared(parts: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that span the groups of the alike in each part (band, key, g, h)."""

    def each(table):
        ids = table.column("id").to_pylist()
        links = linked([np.frombuffer(x.as_py(), np.uint64) for x in table.column("set")])
        return pa.table({"a": pa.array([ids[a] for a, _ in links], pa.int64()), "b": pa.array([ids[b] for _, b in links], pa.int64())})

    return parts.join(sets, "id").groupBy("band", "key", "g", "h").applyInArrow(each, "a long, b long")


def groups(docs: DataFrame, radius: int = 3) -> DataFrame:
    """node, component (the smallest doc_id that links reach) of the ids that have near-duplicates.

    Near-duplicates are alike by LEAST at least in their five-word shingles; groups are what such links reach.
    Texts without words are alike. Equal sets are one class, and only classes are compared. Rows that repeat an
    id are one node, null ids none. Texts of any length are sketched and compared whole, null ones are empty. Other columns
    are left out; an empty table gives no rows.
    """
    rows = stored(_sketches(docs.filter("doc_id is not null")), "sketches")
    classes = stored(rows.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("bits").alias("bits"), F.first("size").alias("size")), "classes")
    keys = classes.select("id", "size", F.posexplode("bands").alias("band", "key"))
    busy = keys.groupBy("band", "key").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least != most")
    met = stored(keys.join(busy.drop("most"), ["band", "key"]), "buckets")
    prints = classes.groupBy("bits").agg(F.min("id").alias("id"))
    same = classes.select(F.col("id").alias("a"), "bits").join(prints, "bits").select("a", F.col("id").alias("b"))
    pairs = stored(met.select(F.col("id").alias("a"), F.col("least").alias("b")).union(same).union(simhash.links(prints, radius)).filter("a != b").distinct(), "candidates")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).union(met.select("id")).distinct()
    sets = stored(_sets(docs, ids), "sets")
    near = stored(_verified(pairs, sets), "alike")
    parts = stored(_slices(met, components(near)), "slices")
    near = near.union(_compared(parts, sets))
    equal = rows.join(classes.select("digest", "id"), "digest").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    return components(near.union(equal))


def one_of_each(docs: DataFrame, radius: int = 3) -> DataFrame:
    """The rows of ``docs`` without those whose group has a smaller doc_id; a repeated id stays once, as the least of its rows.

    Rows without an id are not grouped and stay. Further columns may be of any type and name. Texts of any length are
    compared whole; an empty table gives no rows.
    """
    gone = stored(groups(docs, radius).filter("node != component").select(F.col("node").alias("doc_id")), "gone")
    rows, order = in_order(docs, "doc_id")
    at = Window.partitionBy("doc_id").orderBy(order)
    stay = rows.filter("doc_id is not null").join(gone.hint("shuffle_hash"), "doc_id", "left_anti").withColumn("_n", F.row_number().over(at)).filter("_n = 1")
    return stay.select("_row.*").union(docs.filter("doc_id is null"))
