"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Every 5-word shingle is hashed once. The hash's high bits choose a bin, and a bin keeps its least hash.
Empty bins take the value of a donor, found by probing bins in an order of their own (a 2-universal map
of the bins), so that two texts probe alike. Only four low-order bits of each bin are stored, a hex digit
a bin; likeness is the share of equal digits, corrected for chance matches.

Everything is in built-in expressions. The next document by id is found in one shuffle: rows go to
ranges of ids, each range also gets the first row of the following one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, documents, let

BINS = 256
SHINGLE = 5
#: Values of a stored digit; that many equal by chance.
CHANCE = 1 / 16
#: Probes in turn before all donors are compared.
PROBES = 8


def _probes() -> tuple[list[int], list[int], list[int]]:
    """For each bin, a and c of its probe order (a j + c) mod BINS, and a's inverse."""
    a, c = [], []
    for i in range(BINS):
        x = (i + 1) * 0x9E3779B97F4A7C15 % 2**64
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        a.append((x >> 8) % BINS | 1)
        c.append((x >> 40) % BINS)
    return a, c, [pow(x, -1, BINS) for x in a]


def fingerprint(text: Column) -> Column:
    """A hex digit for each of the bins. A text of fewer words than a shingle has one shingle, an empty text an empty one."""
    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")
    return let(let(words, _hashes), lambda h: let(F.array_sort(h), _digits))


def _hashes(w: Column) -> Column:
    shingle = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)])
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE, F.lit(0))), shingle)


def _digits(h: Column) -> Column:
    of = lambda x: F.shiftright(x, 56)  # noqa: E731  the bin, less 128
    least = F.filter(h, lambda x, i: (i == 0) | (of(x) != of(F.get(h, i - 1))))
    return let(least, _densified)


def _densified(least: Column) -> Column:
    bin_of = lambda x: (F.shiftright(x, 56) + 128).cast("int")
    digit = lambda x: F.get(F.lit(list("0123456789abcdef")), x.bitwiseAND(F.lit(15)).cast("int"))
    gap = lambda x, i: bin_of(x) - F.when(i == 0, -1).otherwise(bin_of(F.get(least, i - 1))) - 1
    a, c, inverse = map(F.lit, _probes())

    def donated(b: Column, donors: Column, i: Column) -> Column:
        mod = lambda x: x.bitwiseAND(F.lit(BINS - 1))
        tries = [F.get(b, mod(F.get(a, i) * j + F.get(c, i))) for j in range(PROBES)]
        first = F.array_min(F.transform(donors, lambda d: mod(F.get(inverse, i) * (d - F.get(c, i) + BINS)) * BINS + d))
        # mixed with the bin: else one donor's digit would stand in all bins it fills, and meet another's by chance as a whole
        return F.xxhash64(F.coalesce(*tries, F.get(b, mod(first))), i)

    def filled(b: Column, donors: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: digit(F.coalesce(F.get(b, i), donated(b, donors, i))))

    spread = F.flatten(F.transform(least, lambda x, i: F.concat(F.array_repeat(F.lit(None).cast("long"), gap(x, i)), F.array(x))))
    dense = F.when(F.size(least) == BINS, F.transform(least, digit)).otherwise(let(spread, lambda b: let(F.transform(least, bin_of), lambda donors: filled(b, donors))))
    return F.array_join(dense, "")


def likeness(x: Column, y: Column) -> Column:
    """Estimated Jaccard similarity of the shingles behind two fingerprints, 0 to 1."""
    same = F.size(F.filter(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: (p == q) & (p != "")), lambda z: z))
    return F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - CHANCE) / (1 - CHANCE))


def with_next(rows: DataFrame, columns: list[str], ranges: int | None = None) -> DataFrame:
    """Adds next_<column> of the row that follows by doc_id; after the last comes the first.

    Null ids stand first, and rows with equal ids are ordered by the columns. The rows are shuffled once,
    by ranges of ids; a range's window also holds copies of the first rows of the following range. There are
    four ranges to a shuffle partition, so they stay small where the partitions are as many as the data asks
    for. Rows with equal ids are in one range.
    """
    spark = rows.sparkSession
    n = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 4 * n).alias("cuts")).first()["cuts"]
    cuts = sorted(set(cuts or [0]))
    step = max(1, math.isqrt(len(cuts)))
    below = lambda id_, values: F.size(F.filter(values, lambda b: b <= id_))
    ends = F.lit(cuts[step - 1 :: step]) if len(cuts) >= step else F.array().cast("array<long>")
    id_ = F.col("doc_id").cast("long")
    ranged = rows.withColumn("_block", below(id_, ends)).withColumn("_range", F.col("_block") * step + below(id_, F.slice(F.lit(cuts), F.col("_block") * step + 1, step))).drop("_block")
    firsts = {r["_range"]: (r["id"], r["nulls"]) for r in ranged.groupBy("_range").agg(F.min("doc_id").alias("id"), F.max(F.col("doc_id").isNull()).alias("nulls")).collect()}  # a row a range
    order = sorted(firsts) or [0]
    before = {b: order[i - 1] for i, b in enumerate(order)}
    every = range(len(cuts) + 1)
    first = F.get(F.lit([None if firsts.get(b, (None, True))[1] else int(firsts[b][0]) for b in every]).cast("array<long>"), F.col("_range"))
    back = F.get(F.lit([before.get(b, 0) for b in every]), F.col("_range"))
    copies = F.when(id_.eqNullSafe(first), F.array(F.struct(F.col("_range").alias("part"), F.lit(False).alias("copy")), F.struct(back.alias("part"), F.lit(True).alias("copy")))).otherwise(F.array(F.struct(F.col("_range").alias("part"), F.lit(False).alias("copy"))))
    at = Window.partitionBy("_at.part").orderBy("_at.copy", F.col("doc_id").asc_nulls_first(), *columns)
    return (
        ranged.withColumn("_at", F.explode(copies))
        .select("*", *[F.lead(c).over(at).alias(f"next_{c}") for c in columns])
        .filter(~F.col("_at.copy"))
        .drop("_at", "_range")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, fingerprint. A null text counts as empty; equal texts have equal fingerprints.

    Rows that repeat are fingerprinted each by itself, other columns are left out, an empty table gives no
    rows, and texts of any length count whole.
    """
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("fingerprint", fingerprint(F.col("text")))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(fingerprints(documents(spark, sf_dir)), ["text", "fingerprint"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left("text", n - half), F.left("next_text", half))).withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
