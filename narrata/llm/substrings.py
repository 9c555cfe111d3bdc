"""Removal of long repeated substrings by a sparse suffix index in levels.

A string of ``length`` bytes holds at least one anchor: the first of the least seed hashes in it. Where a string
stands again, its anchor stands at the same place in it, so only suffixes that begin at anchors are indexed, about
one in eighty. An index entry has the seed's hash (h), the hash of the stretch that all windows of this anchor
cover (u), and the text it is from. Entries with equal h and u repeat as a whole; where stretches differ around a
common seed, one of each is fetched and all their windows are compared. Stretches are equal if a cryptographic
digest of theirs is; windows are found by a rolling hash and then compared byte by byte.

Each text is treated once, whatever the number of its copies: one document stands for all with the same digest.

``Levels`` keeps the index of earlier batches: a new batch is sorted by h, scanned with every level for matches,
and levels of like size are merged, so an entry is rewritten a logarithmic number of times.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, stored

LENGTH = 200
#: Longer seeds drop more texts early, shorter ones need fewer anchors.
SEED = 72
#: Bytes of a text that are hashed at once.
BLOCK = 1 << 20
#: Windows that are compared at once in a task.
AT_ONCE = 1 << 20
#: Seeds around which more stretches differ than this are compared by window over all tasks instead of in one.
WIDE = 1 << 17


def _digest(stretch: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(stretch, digest_size=8).digest(), "little")


class Hasher:
    """Anchors of texts. Powers and random values of the two prefix hashes are made once in each worker."""

    made: dict[tuple[int, int], Hasher] = {}

    def __init__(self, length: int, seed: int):
        self.length, self.seed, self.windows = length, seed, length - seed + 1
        rng = np.random.default_rng(7)
        n = BLOCK + 2 * length + 1
        self.values, self.powers, self.inverse = [], [], []
        for _ in range(2):
            self.values.append(rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
            base = int(rng.integers(2**62, 2**63)) * 2 + 1
            for out, b in ((self.powers, base), (self.inverse, pow(base, -1, 2**64))):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                out.append(np.multiply.accumulate(p))

    @classmethod
    def of(cls, length: int, seed: int) -> Hasher:
        if (length, seed) not in cls.made:
            cls.made[length, seed] = cls(length, seed)
        return cls.made[length, seed]

    @staticmethod
    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(32))

    def prefixes(self, data: np.ndarray, which: int) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[which][data] * self.powers[which][: len(data)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.mix((prefix[end] - prefix[start]) * self.inverse[which][start])

    def _least(self, key: np.ndarray) -> np.ndarray:
        """The least of each ``windows`` neighbours, by running minima of blocks from both sides."""
        w, n = self.windows, len(key)
        padded = np.full(-(-n // w) * w, np.uint64(2**64 - 1))
        padded[:n] = key
        blocks = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])

    def anchors(self, text: bytes):
        """(h, u, anchor, first, last) of each anchor: first and last start of the windows whose anchor it is."""
        if len(text) < self.length:
            return tuple(np.zeros(0, d) for d in (np.int64, np.int64, np.int64, np.int64, np.int64))
        parts = []
        for at in range(0, len(text) - self.length + 1, BLOCK):
            data = np.frombuffer(text[at : at + BLOCK + self.length - 1], np.uint8)
            prefix = self.prefixes(data, 0)
            n = len(data) - self.seed + 1
            h = self.mix((prefix[self.seed :] - prefix[:n]) * self.inverse[0][:n])
            place = self._least((h & np.uint64(2**64 - 2**24)) | np.arange(n, dtype=np.uint64)) & np.uint64(2**24 - 1)
            place = place.astype(np.int64)
            cut = np.flatnonzero(np.diff(place)) + 1
            first, last = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(place) - 1]))
            anchor = place[first]
            whole = data.tobytes()
            u = np.fromiter((_digest(whole[a:b]) for a, b in zip(first.tolist(), (last + self.length).tolist())), np.uint64, len(first))
            u = self.mix(u ^ ((last - first) * 4099 + anchor - first).astype(np.uint64))
            parts.append((h[anchor].view(np.int64), u.view(np.int64), anchor + at, first + at, last + at))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def tagged(self, values: np.ndarray, offsets: np.ndarray, h: int) -> np.ndarray:
        """Window hashes with the place in the window and the seed's hash mixed in: only windows of one seed meet."""
        return self.mix(values + offsets.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)) ^ np.uint64(h % 2**64)

    def window_hashes(self, context: bytes, anchor: int, least: int = 0, upto: int = 1 << 30) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows around an anchor in a context, and where the anchor lies in each, from least to under upto."""
        data = np.frombuffer(context, np.uint8)
        low, high = max(0, anchor + self.seed - self.length, anchor - upto + 1), min(anchor - least, len(data) - self.length)
        if high < low:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        start = np.arange(low, high + 1)
        return self.ranges(self.prefixes(data, 1), 1, start, start + self.length), anchor - start

    def window_digests(self, context: bytes, anchor: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``window_hashes``, by the digest of each window: for windows that meet in no task where bytes can be compared."""
        _, offsets = self.window_hashes(context, anchor)
        return np.fromiter((_digest(context[anchor - o : anchor - o + self.length]) for o in offsets.tolist()), np.uint64, len(offsets)), offsets


def repeated(values: np.ndarray, rows: np.ndarray, offsets: np.ndarray, window) -> np.ndarray:
    """Which of the windows (row, offset) stand in another row at the same offset. ``window(row, low, high)`` gives bytes.

    Equal hashes say where to look. Neighbours among them are compared as whole runs of windows; where a run's bytes
    differ, the windows with these hashes are told apart by their bytes.
    """
    order = np.lexsort((rows, offsets, values))
    same = np.flatnonzero((np.diff(values[order]) == 0) & (np.diff(offsets[order]) == 0))
    again = np.zeros(len(values), bool)
    p, q = order[same], order[same + 1]
    by = np.lexsort((-offsets[p], rows[q], rows[p]))
    p, q = p[by], q[by]
    if not len(p):
        return again
    cut = np.flatnonzero((np.diff(rows[p]) != 0) | (np.diff(rows[q]) != 0) | (np.diff(offsets[p]) != -1)) + 1
    doubtful = []
    for a, b in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(p)]))):
        low, high = int(offsets[p[b - 1]]), int(offsets[p[a]])
        if window(int(rows[p[a]]), low, high) == window(int(rows[q[a]]), low, high):
            again[p[a:b]] = again[q[a:b]] = True
        else:
            doubtful.append(values[p[a:b]])
    if doubtful:
        at = np.flatnonzero(np.isin(values, np.concatenate(doubtful)))
        seen: dict[tuple, list[int]] = {}
        for i in at.tolist():
            seen.setdefault((int(offsets[i]), window(int(rows[i]), int(offsets[i]), int(offsets[i]))), []).append(i)
        again[at] = False
        for group in seen.values():
            again[group] = len(group) > 1
    return again


def entries(texts: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """The index entries (h, u, key, c) of texts (key, text): c times in this text."""

    def each(batches):
        hasher = Hasher.of(length, seed)
        for batch in _slices(batches, 1024):
            keys, out = batch.column(0).to_numpy(), ([], [], [], [])
            for k, text in zip(keys, batch.column(1)):
                h, u, *_ = hasher.anchors(text.as_py() or b"")
                if len(h):
                    order = np.lexsort((u, h))
                    h, u = h[order], u[order]
                    new = np.flatnonzero(np.concatenate(([True], (np.diff(h) != 0) | (np.diff(u) != 0))))
                    for x, y in zip(out, (h[new], u[new], np.full(len(new), k), np.diff(np.append(new, len(h))).astype(np.int32))):
                        x.append(y)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["h", "u", "key", "c"])

    return texts.select("key", "text").mapInArrow(each, "h long, u long, key long, c int")


def repeats(found: DataFrame, wide: int = WIDE) -> DataFrame:
    """Entries that matter (key, h, u, whole, show, wide): ``whole`` repeats as it is, ``show`` has to be compared.

    A seed that stands once is dropped. Where stretches differ around a seed, one entry of each is shown.
    """
    by_h, by_u = Window.partitionBy("h"), Window.partitionBy("h", "u")
    met = found.withColumn("all", F.sum("c").over(by_h)).withColumn("low", F.min("u").over(by_h)).withColumn("high", F.max("u").over(by_h)).filter("all > 1")
    met = met.withColumn("here", F.sum("c").over(by_u)).withColumn("first", F.min("key").over(by_u))
    met = met.withColumn("show", (F.col("low") != F.col("high")) & (F.col("key") == F.col("first"))).withColumn("shown", F.sum(F.col("show").cast("int")).over(by_h))
    return met.select("key", "h", "u", (F.col("here") > 1).alias("whole"), "show", (F.col("shown") > wide).alias("wide")).filter("whole or show")


def _slices(batches, rows: int = 256):
    """Smaller batches, so that few texts are Python objects at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _contexts(rows: DataFrame, length: int, seed: int) -> DataFrame:
    """(h, u, key, whole, wide, anchor, context) of the shown entries of texts (key, text, shown)."""

    def each(batches):
        hasher = Hasher.of(length, seed)
        for batch in _slices(batches):
            out = []
            for row in batch.to_pylist():
                shown = {(x["h"], x["u"]): (x["whole"], x["wide"]) for x in row["shown"]}
                text = row["text"]
                h, u, anchor, _, _ = hasher.anchors(text)
                for a, b, p in zip(h.tolist(), u.tolist(), anchor.tolist()):
                    if (a, b) in shown:
                        low = max(0, p + seed - length)
                        out.append((a, b, row["key"], *shown.pop((a, b)), p - low, text[low : p + length]))
            names = ["h", "u", "key", "whole", "wide", "anchor", "context"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)

    return rows.select("key", "text", "shown").mapInArrow(each, "h long, u long, key long, whole boolean, wide boolean, anchor int, context binary")


def _ranges(rows: np.ndarray, offsets: np.ndarray):
    """(row, low, high) of runs of offsets that go down one by one within a row."""
    if len(rows):
        cut = np.flatnonzero((np.diff(rows) != 0) | (np.diff(offsets) != -1)) + 1
        for a, b in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(rows)]))):
            yield int(rows[a]), int(offsets[b - 1]), int(offsets[a])


def _spread(contexts: DataFrame, length: int, seed: int) -> DataFrame:
    """As ``_compared``, with a row a window: no task holds all that share a seed."""

    def each(batches):
        hasher = Hasher.of(length, seed)
        for batch in _slices(batches):
            h, u, key, whole, anchor, context = (batch.column(c).to_pylist() for c in ("h", "u", "key", "whole", "anchor", "context"))
            got = [hasher.window_digests(x, a) for x, a in zip(context, anchor)]
            n = [len(x) for x, _ in got]
            values = [hasher.tagged(x, o, a).view(np.int64) for (x, o), a in zip(got, h)]
            repeat = lambda x, kind: pa.array(np.repeat(np.array(x), n), kind)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values)), repeat(h, pa.int64()), repeat(u, pa.int64()), repeat(key, pa.int64()), repeat(whole, pa.bool_()), pa.array(np.concatenate([o for _, o in got]))], names=["w", "h", "u", "key", "whole", "o"])

    rows = contexts.dropDuplicates(["h", "u"]).mapInArrow(each, "w long, h long, u long, key long, whole boolean, o long")
    again = rows.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1").select("w")
    return rows.filter("not whole").join(again, "w", "left_semi").groupBy("key", "h", "u").agg(F.collect_list(F.array("o", "o")).alias("offsets"))


def _compared(contexts: DataFrame, length: int, seed: int, partitions: int) -> DataFrame:
    """(key, h, u, offsets): places of the anchor in those of its windows that stand elsewhere too."""

    def each(batches):
        hasher, held = Hasher.of(length, seed), None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            h = held.column("h").to_numpy()
            cut = np.flatnonzero(np.diff(h)) + 1
            if len(cut):
                yield matched(hasher, held.slice(0, cut[-1]))
                held = held.slice(cut[-1])
        if held is not None and held.num_rows:
            yield matched(hasher, held)

    def matched(hasher, table):
        h, u = table.column("h").to_numpy(), table.column("u").to_numpy()
        # copies of a text show the same entry
        once = np.flatnonzero(np.concatenate(([True], (np.diff(h) != 0) | (np.diff(u) != 0))))
        table = table.take(pa.array(once)).combine_chunks()
        h, u, keys, anchors = (table.column(c).to_numpy() for c in ("h", "u", "key", "anchor"))
        whole = table.column("whole").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        contexts = table.column("context")
        found: dict[int, list[list[int]]] = {}
        step = max(1, AT_ONCE // max(1, len(h)))
        for least in range(0, hasher.windows, step):
            values, sizes, offsets = [np.zeros(0, np.uint64)], [], [np.zeros(0, np.int64)]
            for i, context in enumerate(contexts):
                x, o = hasher.window_hashes(context.as_py(), int(anchors[i]), least, least + step)
                values.append(hasher.tagged(x, o, int(h[i])))
                sizes.append(len(x))
                offsets.append(o)
            values, offsets, rows = np.concatenate(values), np.concatenate(offsets), np.repeat(np.arange(len(sizes)), sizes)
            again = repeated(values, rows, offsets, lambda i, low, high: contexts[i].as_py()[int(anchors[i]) - high : int(anchors[i]) - low + length])  # noqa: B023
            again &= ~whole[rows]
            for i, a, b in _ranges(rows[again], offsets[again]):
                found.setdefault(i, []).append([a, b])
        at = sorted(found)
        pairs = pa.array([found[i] for i in at], pa.list_(pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays([pa.array(keys[at], pa.int64()), pa.array(h[at], pa.int64()), pa.array(u[at], pa.int64()), pairs], names=["key", "h", "u", "offsets"])

    return contexts.repartition(partitions, "h").sortWithinPartitions("h", "u").mapInArrow(each, "key long, h long, u long, offsets array<array<long>>")


def removed_runs(text: bytes, whole: set, partial: dict, length: int = LENGTH, seed: int = SEED) -> list[tuple[int, int]]:
    """Maximal runs of bytes to remove: whole stretches, and windows named by ranges of the anchor's place in them."""
    h, u, anchor, first, last = Hasher.of(length, seed).anchors(text)
    spans = []
    for entry, p, a, b in zip(zip(h.tolist(), u.tolist()), anchor.tolist(), first.tolist(), last.tolist()):
        if entry in whole:
            spans.append((a, b + length))
        else:
            spans.extend((p - high, p - low + length) for low, high in partial.get(entry, ()))
    runs: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            if b > runs[-1][1]:
                runs[-1] = (runs[-1][0], b)
        else:
            runs.append((a, b))
    return runs


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, texts: bool = False, keep=(), wide: int = WIDE) -> DataFrame:
    """doc_id, ``keep``, n_bytes, n_removed, n_spans, kept_sha256 and, if ``texts``, the bytes left, a row a document.

    Each byte goes that is covered by a string of ``length`` bytes which starts anywhere else too, in the same
    text or another; runs that overlap or touch are one. A null text counts as empty; texts shorter than
    ``length`` lose nothing. Repeated rows lose all that is long enough. Texts of any length are treated whole,
    in blocks; other columns are left out, an empty table gives no rows.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", *keep, F.xxhash64(text).alias("key"), F.sha2(text, 256).alias("sha"), text.cast("binary").alias("text"))
    # what an entry is holds wherever it stands, so texts whose keys meet by chance may share a list
    met = stored(repeats(entries(rows, length, seed), wide), "repeats")
    # one document stands for all with its text
    one = rows.join(met.select("key").distinct().hint("shuffle_hash"), "key", "left_semi").groupBy("key", "sha").agg(F.min("doc_id").alias("doc_id"))
    one = stored(one, "texts")

    def texts_with(listed: DataFrame) -> DataFrame:
        """key, sha, text and ``listed`` (key, a list), a row a text; more where a document's row repeats."""
        of = one.join(listed, "key").select(F.col("doc_id").alias("id"), F.col("key").alias("k"), F.col("sha").alias("s"), listed.columns[1]).hint("shuffle_hash")
        same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")) & (F.col("sha") == F.col("s"))
        return rows.select("doc_id", "key", "sha", "text").join(of, same).select("key", "sha", "text", listed.columns[1])

    shown = met.filter("show").groupBy("key").agg(F.collect_list(F.struct("h", "u", "whole", "wide")).alias("shown"))
    contexts = _contexts(texts_with(shown), length, seed)
    if met.filter("show and wide").head(1):
        contexts = stored(contexts, "contexts")
        partial = _compared(contexts.filter("not wide"), length, seed, n).union(_spread(contexts.filter("wide"), length, seed))
    else:
        partial = _compared(contexts, length, seed, n)
    marks = met.filter("whole").select("key", "h", "u", F.lit(None).cast("array<array<long>>").alias("offsets")).union(partial)
    marks = marks.groupBy("key").agg(F.collect_list(F.struct("h", "u", "offsets")).alias("marks"))

    def cut(text: bytes, marked: list) -> tuple:
        whole = {(x["h"], x["u"]) for x in marked if x["offsets"] is None}
        runs = removed_runs(text, whole, {(x["h"], x["u"]): x["offsets"] for x in marked if x["offsets"] is not None}, length, seed)
        left, at, digest = [], 0, hashlib.sha256()
        for a, b in runs:
            left.append(text[at:a])
            at = b
        left.append(text[at:])
        for piece in left:
            digest.update(piece)
        return sum(b - a for a, b in runs), len(runs), digest.hexdigest(), b"".join(left) if texts else None

    def each(batches):
        for batch in _slices(batches):
            out = [cut(text.as_py(), marked.as_py()) for text, marked in zip(batch.column(2), batch.column(3))]
            made = [pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["key", "sha", "removed", "spans", "left_sha", "left"])

    done = texts_with(marks).mapInArrow(each, "key long, sha string, removed long, spans long, left_sha string, left binary").dropDuplicates(["key", "sha"])
    out = rows.join(done, ["key", "sha"], "left")
    return out.select(
        "doc_id",
        *keep,
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("left_sha", "sha").alias("kept_sha256"),
        *[F.coalesce("left", "text").alias("kept")] * texts,
    )


class Levels:
    """Index entries of earlier batches, in levels of growing size, as tables sorted by h."""

    def __init__(self, ratio: int = 2, length: int = LENGTH, seed: int = SEED):
        self.ratio, self.length, self.seed = ratio, length, seed
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, texts: DataFrame) -> DataFrame:
        """Indexes a batch (key, text); gives its entries (key, h, u, earlier, whole) whose seed a level or the batch has again."""
        n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        new = stored(entries(texts, self.length, self.seed).repartitionByRange(n, "h").sortWithinPartitions("h", "u"), "level")
        inside = new.groupBy("h").agg(F.sum("c").alias("n")).filter("n > 1").select("h", F.lit(False).alias("earlier"))
        seen = inside
        for _, level in self.levels:
            seen = seen.union(level.join(new.select("h").distinct(), "h", "left_semi").select("h", F.lit(True).alias("earlier")).distinct())
        seen = seen.groupBy("h").agg(F.max("earlier").alias("earlier"))
        equal = new.select("h", "u", "c")
        for _, level in self.levels:
            equal = equal.union(level.join(new.select("h").distinct(), "h", "left_semi").select("h", "u", "c"))
        equal = equal.groupBy("h", "u").agg((F.sum("c") > 1).alias("whole"))
        found = stored(new.join(seen, "h").join(equal, ["h", "u"]).select("key", "h", "u", "earlier", "whole"), "matches")
        self.levels.append((new.count(), new))
        while len(self.levels) > 1 and self.levels[-1][0] * self.ratio > self.levels[-2][0]:
            (a, x), (b, y) = self.levels.pop(), self.levels.pop()
            self.levels.append((a + b, stored(x.union(y).repartitionByRange(n, "h").sortWithinPartitions("h", "u"), "level")))
        return found


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
