"""Byte-level BPE over overlapping chunks, and back.

A text longer than a chunk is cut into chunks that overlap. Chunks are dealt to tasks and pre-tokenised
each from its own start, which may lie inside a pre-token. A document's chunks are then stitched from the
left: at the first place in an overlap where the left chunk's true pre-tokens and the right chunk's both
begin, the pattern, which never looks back, goes on alike in both. Texts within a chunk need no stitch.
Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

CHUNK = 1 << 15
OVERLAP = 1 << 11
#: The last pre-tokens of a chunk may be cut off or see no next character.
UNSURE = 3
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


class Codec:
    """Encodes and decodes by a file of ranks; loaded once in each Python worker."""

    loaded: dict[str, Codec] = {}

    def __init__(self, ranks: bytes, pattern: str):
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.bytes_of = {rank: piece for piece, rank in table.items()}
        self.digits_of = {rank: str(rank) for rank in table.values()}
        self.pieces: dict[str, list[int]] = {}

    @classmethod
    def of(cls, ranks: bytes, pattern: str) -> Codec:
        key = hashlib.sha1(ranks + pattern.encode()).hexdigest()
        if key not in cls.loaded:
            cls.loaded[key] = cls(ranks, pattern)
        return cls.loaded[key]

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def encode_piece(self, piece: str) -> list[int]:
        """The ids of one pre-token."""
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) > 100_000:
                self.pieces.clear()
            found = self.pieces[piece] = self.encoding._encode_single_piece(piece)
        return found

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digest(self, ids: list[int]) -> tuple[int, str, str]:
        """How many ids, their sha256 and that of the decoded bytes, in blocks of bounded size."""
        a, b = hashlib.sha256(), hashlib.sha256()
        for i in range(0, len(ids), 1 << 20):
            part = ids[i : i + (1 << 20)]
            a.update(((b"," if i else b"") + ",".join(map(self.digits_of.__getitem__, part)).encode()))
            b.update(self.decode(part))
        return len(ids), a.hexdigest(), b.hexdigest()


def stitch(chunks: list[tuple[int, np.ndarray]], overlap_from: list[int]) -> list[tuple[int, int]] | None:
    """Which pre-tokens of each chunk stand, as (first, end); None where an overlap has no common start.

    ``chunks``: for each chunk its pre-tokens' starts in the text; ``overlap_from``: where each begins.
    """
    out, first = [], 0
    for k, starts in enumerate(chunks):
        if k + 1 == len(chunks):
            out.append((first, len(starts)))
            break
        sure = starts[first : len(starts) - UNSURE]
        sure = sure[sure >= overlap_from[k + 1]]
        common = np.intersect1d(sure, chunks[k + 1], assume_unique=True)
        if not len(common):
            return None
        out.append((first, int(np.searchsorted(starts, common[0]))))
        first = int(np.searchsorted(chunks[k + 1], common[0]))
    return out


def ranks_of(name: str = VOCABULARY) -> tuple[bytes, str]:
    """The ranks file of a public vocabulary, read on the driver, and its pattern."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP, keep=(), ids: bool = False) -> DataFrame:
    """doc_id, ``keep``, n_tokens, ids_sha256, decoded_sha256 and, if ``ids``, the token ids, a row a document.

    A null text counts as empty, with no tokens and the digests of nothing. Rows that repeat are encoded
    each by itself, other columns are left out, an empty table gives no rows. Texts longer than ``chunk`` are cut in
    overlapping pieces for tasks; the ids are those of the whole text.
    """
    spark = docs.sparkSession
    ranks, pattern = ranks_of(vocabulary)
    if len(ranks) > 64 << 20:
        raise ValueError("a vocabulary of over 64 MB is not sent to all executors")
    sent = spark.sparkContext.broadcast(ranks)
    rows = docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("_text"))
    kept = rows.schema.fields[:-1]
    names = [f.name for f in kept]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_tokens long, ids_sha256 string, decoded_sha256 string", *["ids array<int>"] * ids])
    columns = [*names, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]

    def result(codec, found):
        return (*codec.digest(found), *[found] * ids)

    def whole(batches):
        codec = Codec.of(sent.value, pattern)
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            got = list(zip(*(result(codec, codec.encode(t.as_py())) for t in batch.column(0)), strict=True)) or [[]] * (3 + ids)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(x, k) for x, k in zip(got, kinds))], names=columns)

    def parts(batches):
        codec = Codec.of(sent.value, pattern)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                found = [(m.start(), m.group()) for m in codec.pattern.finditer(row["_chunk"])]
                got = [codec.encode_piece(p) for _, p in found]
                at = np.fromiter((s for s, _ in found), np.int64, len(found)) + row["_from"]
                out.append({"_doc": row["_doc"], "_k": row["_k"], "_from": row["_from"], "_core": row["_chunk"][:chunk], "_starts": at.tobytes(), "_counts": np.fromiter(map(len, got), np.int64, len(got)).tobytes(), "_ids": np.array([x for y in got for x in y], np.int32).tobytes(), **{n: row[n] for n in names}})
            kept_fields = [f for f in batch.schema if f.name != "_chunk"]
            made = [pa.field("_core", pa.string()), pa.field("_starts", pa.binary()), pa.field("_counts", pa.binary()), pa.field("_ids", pa.binary())]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([*kept_fields, *made]))

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        codec = Codec.of(sent.value, pattern)
        group = group.sort_values("_k")
        chunks = [np.frombuffer(x, np.int64) for x in group["_starts"]]
        ranges = stitch(chunks, list(group["_from"]))
        if ranges is None:  # one run fills an overlap: no place to stitch, so the document is encoded as one piece
            found = codec.encode("".join(group["_core"]))
        else:
            found = []
            for (first, end), counts, got in zip(ranges, group["_counts"], group["_ids"]):
                upto = np.concatenate(([0], np.cumsum(np.frombuffer(counts, np.int64))))
                found += np.frombuffer(got, np.int32)[upto[first] : upto[end]].tolist()
        return pd.DataFrame([(*group[names].iloc[0], *result(codec, found))], columns=columns).astype({n: group[n].dtype for n in names})

    long = F.length("_text") > chunk + overlap
    short = rows.filter(~long).select("_text", *names).mapInArrow(whole, schema)
    cut = rows.filter(long).withColumn("_doc", F.monotonically_increasing_id()).withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor((F.length("_text") - 1) / chunk).cast("int"))))
    cut = cut.select("_doc", "_k", (F.col("_k").cast("long") * chunk).alias("_from"), F.substring("_text", F.col("_k") * chunk + 1, F.lit(chunk + overlap)).alias("_chunk"), *names)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    pieces = cut.repartition(n, "_doc", "_k").mapInArrow(parts, f"_doc long, _k int, _from long, {types}, _core string, _starts binary, _counts binary, _ids binary")
    return short.unionByName(pieces.groupBy("_doc").applyInPandas(joined, schema))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir))
