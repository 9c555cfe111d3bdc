"""SimHash near-duplicates by covering locality-sensitive hashing.

Each bit of a fingerprint is given a nonzero vector over GF(2) of ``radius + 1`` places. For every
nonzero vector v, a mask keeps the bits whose vector has an odd product with v. Any ``radius`` bits span
too little to leave no v orthogonal to all of them, so two fingerprints within the radius agree under
some mask: no pair is missed. Candidates are compared exactly, as classes of equal fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, in_order, schema_of, stored
from .components import components

BITS = 64
#: Shingles hashed at once, for bounded memory in very long texts.
BLOCK = 1 << 16
#: Buckets with more fingerprints than this are split by a second covering family, and what is wider still is dealt out.
WIDE = 4096
#: What rows of one run have in common: mask and key of both families, and the slices of a bucket.
SIGN = ("t", "key", "t2", "key2", "g", "h")


def simhash(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """The fingerprint of a UTF-8 text as an unsigned number: a bit is set if over half of the hashes have it.

    ``A-Z`` count as ``a-z``, words are parted by ASCII white space, and fewer words than ``width`` make one
    shingle. No word: zero.
    """
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    last = max(1, len(words) - width + 1)
    joined, hash_of = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:last].tolist()
    ends = (ends[-last:] - 1).tolist()
    ones = np.zeros(BITS, np.int64)
    for i in range(0, last, BLOCK):
        h = np.array([hash_of(joined[a:b], seed) for a, b in zip(starts[i : i + BLOCK], ends[i : i + BLOCK])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > last, bitorder="little").view(np.uint64)[0])


def simhashes(docs: DataFrame, width: int = 3, keep=()) -> DataFrame:
    """doc_id and ``keep`` with ``bits``, the fingerprint as a signed long."""

    def hashed(batches):
        for batch in batches:
            bits = np.array([simhash(t.as_py(), width) for t in batch.column(0)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bits), *batch.columns[1:]], names=["bits", *batch.schema.names[1:]])

    rows = docs.select(F.col("text").cast("binary").alias("_text"), "doc_id", *keep)
    return rows.mapInArrow(hashed, schema_of("bits long", rows.schema.fields[1:]))


def masks(radius: int = 3, turn: int = 0) -> list[int]:
    """The covering masks; ``turn`` gives the bits other vectors."""
    n = 2 ** (radius + 1) - 1
    vectors = [(i * (2 * turn + 1) + i // n * turn) % n + 1 for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, n + 1)]


def _spanned(bits: np.ndarray, radius: int):
    """Pairs of places in ``bits`` that span the same groups as all pairs within the radius do."""
    left = np.arange(len(bits))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(bits[left] ^ bits[x]) <= radius
            found, left = left[near], left[~near]
            queue.extend(found)
            for y in found:
                yield x, y


def _keyed(rows: DataFrame, radius: int, turn: int = 0) -> DataFrame:
    """Rows (id, bits, ...) under each mask of a covering family, as t and key beside their own columns."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    at = F.array(*[F.struct(F.lit(t).alias("t"), F.col("bits").bitwiseAND(F.lit(signed(m)).cast("long")).alias("key")) for t, m in enumerate(masks(radius, turn))])
    return rows.withColumn("at", F.explode(at)).select(*rows.columns, "at.t", "at.key")


def links(classes: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) between ids of classes (id, bits) that span the groups of all pairs within the radius.

    Rows meet under each mask and are sorted by it; a task walks through runs of equal keys. A run gives
    fewer links than it has rows, whatever its size. A bucket of more than WIDE rows is first split by a second
    covering family, and what is still that large is dealt to tasks in pairs of slices; no pair is left out.
    """
    rows = _keyed(classes.select("id", "bits"), radius).withColumns({"t2": F.lit(0), "key2": F.lit(0).cast("long")})
    whole = rows.withColumns({"g": F.lit(0), "h": F.lit(0)})
    # a bucket can be wide only where there are as many classes
    if classes.limit(WIDE + 1).count() <= WIDE:
        return _walked(whole, radius)
    wide = stored(rows.groupBy("t", "key").agg(F.count("*").alias("n")).filter(F.col("n") > WIDE).select("t", "key"), "wide")
    if not wide.head(1):
        return _walked(whole, radius)
    again = _keyed(rows.join(wide, ["t", "key"]).select("id", "bits", F.col("t").alias("t1"), F.col("key").alias("key1")), radius, 3)
    again = again.select("id", "bits", F.col("t1").alias("t"), F.col("key1").alias("key"), F.col("t").alias("t2"), F.col("key").alias("key2"))
    size = again.groupBy("t", "key", "t2", "key2").agg(F.ceil(F.count("*") / WIDE).cast("int").alias("slices"))
    dealt = again.join(size, ["t", "key", "t2", "key2"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    dealt = dealt.select("id", "bits", "t", "key", (F.col("t2") + 1).alias("t2"), "key2", F.least("own", "other").alias("g"), F.greatest("own", "other").alias("h"))
    return _walked(whole.join(wide, ["t", "key"], "left_anti").unionByName(dealt), radius).distinct()


def _walked(rows: DataFrame, radius: int) -> DataFrame:
    """Links within runs of equal SIGN of rows (id, bits, t, key, t2, key2, g, h)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def runs(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            # the last run may go on in the next batch
            cut = np.zeros(held.num_rows - 1, bool)
            for c in SIGN:
                cut |= np.diff(held.column(c).to_numpy()) != 0
            cut = np.flatnonzero(cut) + 1
            if len(cut):
                yield from linked(held.slice(0, cut[-1]), cut[:-1])
                held = held.slice(cut[-1])
        if held is not None and held.num_rows:
            yield from linked(held, np.array([], int))

    def linked(rows, cut):
        ids, bits = rows.column("id").to_numpy(), rows.column("bits").to_numpy().view(np.uint64)
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(ids)]))
        many = ends - starts > 1
        two = many & (ends - starts == 2)
        s = starts[two]
        s = s[np.bitwise_count(bits[s] ^ bits[s + 1]) <= radius]
        a, b = [ids[s]], [ids[s + 1]]
        for x, y in zip(starts[many & ~two], ends[many & ~two]):
            pairs = np.array(list(_spanned(bits[x:y], radius)), np.int64).reshape(-1, 2)
            a.append(ids[x:y][pairs[:, 0]])
            b.append(ids[x:y][pairs[:, 1]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return rows.select("id", "bits", *SIGN).repartition(n, *SIGN).sortWithinPartitions(*SIGN).mapInArrow(runs, "a long, b long")


def groups(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, bits, component_id (the smallest doc_id that links reach), a row a document.

    Equal fingerprints form a class, whose id is its smallest doc_id; only classes are compared. Null and
    empty texts have fingerprint zero and are linked like any other; long ones are hashed whole. Rows that repeat an id are one node.
    A null id never names a component; a class of null ids alone has a null one. Other columns are left
    out, and an empty table gives no rows.
    """
    rows = stored(simhashes(docs, width), "simhashes")
    classes = rows.groupBy("bits").agg(F.min("doc_id").cast("long").alias("id"))
    found = components(links(classes.filter("id is not null"), radius))
    named = classes.join(found, F.col("id") == F.col("node"), "left").select("bits", F.coalesce("component", "id").alias("component_id"))
    return rows.join(named, "bits").select("doc_id", "bits", "component_id")


def one_of_each(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs`` without those whose group has a smaller doc_id; a repeated id stays once.

    Rows without an id are not grouped and stay.
    """
    kept = groups(docs, width, radius).filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    rows, order = in_order(docs, "doc_id")
    at = Window.partitionBy("doc_id").orderBy(order)
    stay = rows.join(kept.hint("shuffle_hash"), "doc_id").withColumn("_n", F.row_number().over(at)).filter("_n = 1")
    return stay.select("_row.*").union(docs.filter("doc_id is null"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")
