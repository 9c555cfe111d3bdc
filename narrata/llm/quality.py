"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad from its own features and its neighbours'. The field is fitted on
labelled documents and on mixed ones: a half of a good document and a half of a bad one, so that labels switch
inside a text and lines are told apart by what they are, not by the document around them. A line's own label is
hidden; the label of the document it is from is evidence for it, EVIDENCE in log-odds. Fitting is expectation
maximisation: what the field expects of the lines under that evidence against what it expects without.
A document's quality is the mean of its lines' forward-backward marginals, weighted by length and calibrated on
the labelled documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, documents, schema_of

#: The bound of the sample that is fitted: so many documents, none with more bytes or lines than this.
SAMPLE = 4000
MOST_BYTES = 20_000
MOST_LINES = 64
THRESHOLD = 0.7
#: How far a document's label speaks for each of its lines, in log-odds.
EVIDENCE = 3.0

#: Classes of bytes whose shares in a line are features.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)), b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b".,;:?'\"()-", b"!", b"#$%&*@^~_=+\\/", b"|<>{}[]`")
_CLASS_OF = np.full(256, len(CLASSES), np.uint8)
for _k, _members in enumerate(CLASSES):
    _CLASS_OF[np.frombuffer(_members, np.uint8)] = _k


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line (lines x features) and the lines' lengths in bytes."""
    lines = text.split(b"\n")
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    kinds = _CLASS_OF[np.frombuffer(text + b"\n", np.uint8)]
    starts = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    own = np.zeros((len(lines), len(CLASSES) + 8), np.float32)
    for k in range(len(CLASSES)):
        own[:, k] = np.add.reduceat(kinds == k, starts, dtype=np.int64)
    own[:, : len(CLASSES)] /= np.maximum(size, 1)[:, None]
    seen: set[bytes] = set()
    n = len(CLASSES)
    for i, line in enumerate(lines):
        words = line.split()
        m = len(words)
        distinct = set(words)
        own[i, n : n + 5] = (
            m and len(distinct) / m,
            m and size[i] / m / 10,
            m and sum(len(w) <= 3 for w in words) / m,
            line.rstrip()[-1:] in b".!?\"'" and m > 0,
            line in seen and m > 0,
        )
        own[i, n + 5] = m and math.log1p(m) / 6
        own[i, n + 6] = m == 0
        seen.add(line)
    own[:, n + 7] = 1
    around = np.zeros((len(lines), 3 * own.shape[1]), np.float32)
    around[:, : own.shape[1]] = own
    around[1:, own.shape[1] : 2 * own.shape[1]] = own[:-1]
    around[:-1, 2 * own.shape[1] :] = own[1:]
    return around, size


def _both_ways(e: np.ndarray, a: np.ndarray, mask: np.ndarray):
    """Marginals, pair marginals and log Z of padded chains. e: chains x places (score of good), a: 2 x 2."""
    n, t_max = e.shape
    s = np.stack([np.zeros_like(e), e], 2)
    alpha, beta = np.zeros_like(s), np.zeros_like(s)
    alpha[:, 0] = s[:, 0]
    for t in range(1, t_max):
        new = np.logaddexp(alpha[:, t - 1, :1] + a[0], alpha[:, t - 1, 1:] + a[1]) + s[:, t]
        alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
    for t in range(t_max - 2, -1, -1):
        ahead = s[:, t + 1] + beta[:, t + 1]
        new = np.logaddexp(a[:, 0] + ahead[:, :1], a[:, 1] + ahead[:, 1:])
        beta[:, t] = np.where(mask[:, t + 1, None], new, 0)
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    good = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]) * mask
    pairs = np.zeros((2, 2))
    for t in range(1, t_max):
        p = np.exp(alpha[:, t - 1, :, None] + a + (s[:, t] + beta[:, t])[:, None] - z[:, None, None])
        pairs += (p * mask[:, t, None, None]).sum(0)
    return good, pairs, z


def mixtures(texts: list[bytes], labels: list[int]):
    """Halves of good and bad documents in turn, as one text, and for each line whether it is from the good one."""
    good, bad = ([t.split(b"\n") for t, y in zip(texts, labels, strict=True) if y == k] for k in (1, 0))
    for k, (g, b) in enumerate(zip(good, bad)):  # as many as there are of both
        g, b = g[: (len(g) + 1) // 2], b[len(b) // 2 :]
        first, last = (g, b) if k % 2 else (b, g)
        yield b"\n".join(first + last), np.array([float(k % 2)] * len(first) + [float(1 - k % 2)] * len(last))


def fit(texts: list[bytes], labels: list[int], rounds: int = 120, l2: float = 1e-3) -> dict:
    """The field's weights by gradient ascent on the likelihood of the evidence, and the calibration of document scores."""
    rows = [line_features(t) for t in texts]
    of = [np.full(len(f), y, float) for (f, _), y in zip(rows, labels, strict=True)]
    for text, y in mixtures(texts, labels):
        rows.append(line_features(text))
        of.append(y)
    t_max, width = max((len(x) for x, _ in rows), default=1), rows[0][0].shape[1] if rows else 1
    x, mask, evidence = np.zeros((len(rows), t_max, width), np.float32), np.zeros((len(rows), t_max), bool), np.zeros((len(rows), t_max))
    for i, ((f, _), line) in enumerate(zip(rows, of, strict=True)):
        x[i, : len(f)], mask[i, : len(f)], evidence[i, : len(f)] = f, True, EVIDENCE * (2 * line - 1)
    w, a = np.zeros(width), np.zeros((2, 2))
    lines = max(1, mask.sum())
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, a)]
    for i in range(1, rounds + 1):
        e = (x @ w.astype(np.float32)).astype(float)
        free, free_pairs, _ = _both_ways(e, a, mask)
        held, held_pairs, _ = _both_ways(e + evidence, a, mask)
        slopes = (np.einsum("ntf,nt->f", x, (held - free).astype(np.float32)) / lines - l2 * w, (held_pairs - free_pairs) / lines - l2 * a)
        for p, g, m in zip((w, a), slopes, moments, strict=True):
            m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.99 * m[1] + 0.01 * g * g
            p += 0.15 * (m[0] / (1 - 0.9**i)) / (np.sqrt(m[1] / (1 - 0.99**i)) + 1e-8)
    model = {"w": w, "a": a, "scale": (1.0, 0.0)}
    y = np.array(labels, float)
    raw = np.array([_raw(*r, model) for r in rows[: len(texts)]])
    slope, offset = 1.0, 0.0
    for _ in range(200):  # Newton steps of a logistic fit, with a little ridge
        p = 1 / (1 + np.exp(-(slope * raw + offset)))
        g0, g1, h = (y - p).sum(), ((y - p) * raw).sum() - 1e-2 * slope, np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[(h * raw * raw).sum() + 1e-2, (h * raw).sum()], [(h * raw).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, [g1, g0])
        slope, offset = slope + np.clip(step[0], -1, 1), offset + np.clip(step[1], -1, 1)
        if abs(step).max() < 1e-6:
            break
    return model | {"scale": (float(max(slope, 1e-3)), float(offset))}


def marginals(features: np.ndarray, model: dict) -> list[float]:
    """Of one chain: each line's probability of being good, by scaled forward-backward."""
    e = np.clip(features @ model["w"], -30, 30)
    g = np.exp(e).tolist()
    (a00, a01), (a10, a11) = np.exp(model["a"]).tolist()
    ahead = [(1.0, 1.0)] * len(g)
    x, y = 1.0, 1.0
    for t in range(len(g) - 1, 0, -1):
        x, y = a00 * x + a01 * g[t] * y, a10 * x + a11 * g[t] * y
        s = x + y
        x, y = x / s, y / s
        ahead[t - 1] = (x, y)
    out, x, y = [], 1.0, 0.0
    for t, v in enumerate(g):
        x, y = (1.0, v) if t == 0 else (a00 * x + a10 * y, (a01 * x + a11 * y) * v)
        s = x + y
        x, y = x / s, y / s
        p, q = x * ahead[t][0], y * ahead[t][1]
        out.append(q / (p + q))
    return out


def _raw(features: np.ndarray, size: np.ndarray, model: dict) -> float:
    """Log-odds of the length-weighted mean of the lines' marginals."""
    p = float(np.average(marginals(features, model), weights=size + 1))
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def score(text: bytes | None, model: dict) -> float:
    slope, offset = model["scale"]
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, slope * _raw(*line_features(text or b""), model) + offset))))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: tuple[int, int] = (4, 2), sample: int = SAMPLE) -> dict:
    """Fits on at most ``sample`` labelled documents, chosen by a digest of their ids, outside the held-out part.

    Documents with more than MOST_BYTES bytes or MOST_LINES lines are not fitted on. Ids come from the slim
    label table; only the sampled rows' texts are fetched. Without labels every document gets one score.
    """
    chosen = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), held_out[0]) != held_out[1]))
    chosen = chosen.groupBy("doc_id").agg(F.max(label).cast("int").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.cast("binary").alias("_text")).filter((F.octet_length(text) <= MOST_BYTES) & (F.regexp_count(text, F.lit("\n")) < MOST_LINES))
    got = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "_text", "_label").collect()  # bounded by sample and MOST_BYTES
    got = sorted(got, key=lambda r: (r["doc_id"], r["_text"]))[:sample]
    return fit([bytes(r["_text"]) for r in got], [r["_label"] for r in got])


def scored(docs: DataFrame, model: dict, keep=()) -> DataFrame:
    """doc_id, score and ``keep``, a row a document.

    A null text counts as empty: one empty line. Texts of any length are scored whole, repeated rows each by
    itself; an empty table gives no rows.
    """

    def each(batches):
        for batch in batches:
            values = [score(t.as_py(), model) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.float64()), *batch.columns[1:]], names=["score", *batch.schema.names[1:]])

    rows = docs.select(F.col("text").cast("binary").alias("_text"), "doc_id", *keep)
    return rows.mapInArrow(each, schema_of("score double", rows.schema.fields[1:]))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
