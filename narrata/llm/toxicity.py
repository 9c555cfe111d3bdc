"""Toxicity by the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

Terms are all words of the examples. A term weighs by its frequency in the text, by its rarity among all documents, and by how far it goes with the label among the examples (the coefficient
phi), so what says nothing about the label hardly moves a text towards another. The index keeps a term's postings
in blocks of examples with each block's largest weight. Terms that stand in very many examples have full rows of
weights instead, which are multiplied for many texts at once. A query bounds every block by its best sum over these
rows and the largest weights of the other terms, scores blocks in order of their bounds, and stops when the k-th
best score reaches the next bound: the result is exact. The
neighbours' votes, weighted by nearness, are calibrated on the examples themselves, each left out in turn.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, documents, schema_of

#: The bound of the examples: so many labelled documents, none with more bytes than this.
SAMPLE = 4000
MOST_BYTES = 20_000
#: Examples in a block of the index.
BLOCK = 256
NEAREST = 15
#: Terms in more than this share of the examples have full rows; texts that are scored at once.
COMMON, AT_ONCE = 1 / 24, 64
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str):
    text = text.lower()
    return _WORD.findall(text) if len(text) < 1 << 20 else (m.group() for m in _WORD.finditer(text))


def vocabulary_of(texts: list[str]) -> dict[str, int]:
    """A number for every word of the texts, in order."""
    return {t: i for i, t in enumerate(sorted({w for x in texts for w in words_of(x)}))}


def counts_of(text: str, vocabulary: dict[str, int]) -> dict[int, int]:
    """The numbers of a vocabulary's words in a text, and how often they stand there."""
    return {i: n for w, n in Counter(words_of(text)).items() if (i := vocabulary.get(w)) is not None}


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each first, as many as its size, laid end to end."""
    return np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())


class BlockMaxIndex:
    """Unit vectors of examples over all their terms, as postings by (term, block) with block maxima.

    ``df`` has for each term the documents that hold it, out of ``n``; without it, examples are counted.
    """

    def __init__(self, texts: list[str], labels: list[int], ids: list[int], vocabulary: dict[str, int] | None = None, df: np.ndarray | None = None, n: int = 0):
        self.vocabulary = vocabulary_of(texts) if vocabulary is None else vocabulary
        counts = [counts_of(t, self.vocabulary) for t in texts]
        y = np.array(labels, float)
        held, with_one = np.zeros(len(self.vocabulary)), np.zeros(len(self.vocabulary))
        for c, label in zip(counts, labels, strict=True):
            at = list(c)
            held[at] += 1
            with_one[at] += label
        df, n = (held, len(texts)) if df is None else (np.maximum(df, 1), n)
        rest = held * (len(y) - held) * y.sum() * (len(y) - y.sum())
        phi = np.abs(len(y) * with_one - held * y.sum()) / np.sqrt(np.where(rest > 0, rest, 1))
        self.weight = (np.log(max(n, 1) / df) + 1) * np.where(rest > 0, phi, 0)
        # examples whose heaviest terms are the same share blocks, so that other blocks have low bounds
        vectors = [self.vector(c) for c in counts]
        order = sorted(range(len(texts)), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]) if len(vectors[i][0]) else -1, ids[i]))
        self.labels, self.ids = y[order], np.array(ids, np.int64)[order]
        self.n_blocks = -(-len(texts) // BLOCK) or 1
        term = np.concatenate([np.zeros(0, np.int64), *(vectors[i][0] for i in order)])
        example = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
        weight = np.concatenate([np.zeros(0), *(vectors[i][1] for i in order)])
        by = np.lexsort((example, term))
        term, example, weight = term[by], example[by], weight[by]
        many = np.bincount(term, minlength=len(self.vocabulary)) > max(1.0, COMMON * len(texts))
        self.row = np.where(many, np.cumsum(many) - 1, -1)
        self.rows = np.zeros((int(many.sum()), len(texts)))
        self.rows[self.row[term[many[term]]], example[many[term]]] = weight[many[term]]
        few = ~many[term]
        term, self.examples, self.weights = term[few], example[few], weight[few]
        self.edges = np.arange(0, max(1, len(texts)), BLOCK)
        cell = term * self.n_blocks + self.examples // BLOCK
        # a cell is a term in a block: where its postings start, its block, its largest weight
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(cell)), bool), np.diff(cell) != 0)))
        self.starts = np.append(first, len(cell))
        self.block = cell[first] % self.n_blocks
        self.most = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        self.cells = np.searchsorted(cell[first] // self.n_blocks, np.arange(len(self.vocabulary) + 1))
        self.prior = float(y.mean()) if len(y) else 0.5
        self.scale = (1.0, 0.0)
        self._calibrate([vectors[i] for i in order])

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """The terms of a text in order, and their weights; the vector has length one."""
        terms = np.fromiter(counts.keys(), np.int64, len(counts))
        order = np.argsort(terms)
        w = (1 + np.log(np.fromiter(counts.values(), float, len(counts))))[order] * self.weight[terms[order]]
        return terms[order], w / (np.linalg.norm(w) or 1)

    def sums(self, vectors: list) -> np.ndarray:
        """Of each text and example, the part of the cosine that comes from the terms with full rows."""
        q = np.zeros((len(vectors), len(self.rows)))
        for i, (terms, weights) in enumerate(vectors):
            row = self.row[terms]
            q[i, row[row >= 0]] = weights[row >= 0]
        return q @ self.rows

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEAREST, leave_out: int = -1, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k best examples with a positive cosine, ties by number, and their cosines. ``known`` is a row of ``sums``."""
        if not len(self.labels):
            return np.zeros(0, np.int64), np.zeros(0)
        known = self.sums([(terms, weights)])[0] if known is None else known
        few = self.row[terms] < 0
        terms, weights = terms[few], weights[few]
        size = self.cells[terms + 1] - self.cells[terms]
        cells, w = _ranges(self.cells[terms], size), np.repeat(weights, size)
        block = self.block[cells]
        bound = np.maximum.reduceat(known, self.edges) + np.bincount(block, w * self.most[cells], self.n_blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best, score = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 4
        while at < len(order) and not (len(best) == k and score[-1] > bound[order[at]] + 1e-12):
            taken = np.zeros(self.n_blocks, bool)
            taken[order[at : at + step]] = True
            at, step = at + step, step * 2
            here = taken[block]
            first = self.starts[cells[here]]
            many = self.starts[cells[here] + 1] - first
            places = _ranges(first, many)
            local = np.where(np.repeat(taken, BLOCK)[: len(known)], known, 0)
            local += np.bincount(self.examples[places], np.repeat(w[here], many) * self.weights[places], len(known))
            if leave_out >= 0:
                local[leave_out] = 0
            new = np.flatnonzero(local > (score[-1] if len(best) == k else 0))
            if len(new) > k:
                new = new[local[new] >= np.partition(local[new], -k)[-k]]
            best, score = np.concatenate((best, new)), np.concatenate((score, local[new]))
            keep = np.lexsort((best, -score))[:k]
            best, score = best[keep], score[keep]
        return best, score

    def vote(self, best: np.ndarray, score: np.ndarray) -> float:
        """Log-odds of the neighbours' votes; the nearer, the more they weigh. The prior has a small vote."""
        w = score**2
        p = ((w * self.labels[best]).sum() + 0.2 * self.prior) / (w.sum() + 0.2)
        p = min(max(p, 1e-4), 1 - 1e-4)
        return math.log(p / (1 - p))

    def _calibrate(self, vectors: list) -> None:
        x = np.zeros(len(vectors))
        for at in range(0, len(vectors), AT_ONCE):
            for i, known in enumerate(self.sums(vectors[at : at + AT_ONCE]), at):
                x[i] = self.vote(*self.nearest(*vectors[i], leave_out=i, known=known))
        y = self.labels
        if not len(y) or y.min() == y.max():
            return
        slope, offset = 1.0, 0.0
        for _ in range(200):  # Newton steps of a logistic fit, with a little ridge
            p = 1 / (1 + np.exp(-(slope * x + offset)))
            h = np.maximum(p * (1 - p), 1e-6)
            step = np.linalg.solve([[(h * x * x).sum() + 1e-2, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]], [((y - p) * x).sum() - 1e-2 * slope, (y - p).sum()])
            slope, offset = slope + np.clip(step[0], -1, 1), offset + np.clip(step[1], -1, 1)
            if abs(step).max() < 1e-6:
                break
        self.scale = (float(max(slope, 1e-3)), float(offset))

    def scores(self, texts: list[str | None]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Calibrated scores, and as evidence the neighbours and their cosines."""
        out, (slope, offset) = [], self.scale
        for at in range(0, len(texts), AT_ONCE):
            vectors = [self.vector(counts_of(t or "", self.vocabulary)) for t in texts[at : at + AT_ONCE]]
            for v, known in zip(vectors, self.sums(vectors)):
                best, near = self.nearest(*v, known=known)
                out.append((1 / (1 + math.exp(-(slope * self.vote(best, near) + offset))), best, near))
        return out


def frequencies(docs: DataFrame, vocabulary: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many of all documents each term of a vocabulary stands, and how many documents there are."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by SAMPLE and MOST_BYTES

    def each(batches):
        vocabulary, found = sent.value, np.zeros(len(sent.value) + 1, np.int64)
        for batch in batches:
            for t in batch.column(0):
                words = set(words_of(t.as_py() or ""))
                found[[i for w in words if (i := vocabulary.get(w)) is not None]] += 1
            found[-1] += batch.num_rows
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["term", "n"])

    out = np.zeros(len(vocabulary) + 1, np.int64)
    for r in docs.select("text").mapInArrow(each, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():  # a row a term at most
        out[r["term"]] = r["n"]
    return out[:-1], int(out[-1])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out: tuple[int, int] = (5, 0), sample: int = SAMPLE) -> BlockMaxIndex:
    """Indexes at most ``sample`` labelled documents of MOST_BYTES bytes at most, outside the held-out part.

    They are chosen by a digest of their ids from the slim label table, both labels at one rate, so that their
    mix is the table's whatever its size; only their texts are fetched. Equal texts count once. How rare a term
    is comes from all documents. A table whose rows all repeat under new ids gives the same scores.
    """
    fit = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), held_out[0]) != held_out[1]))
    fit = fit.groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    chosen = fit.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("_text")).filter(F.octet_length(text) <= MOST_BYTES)
    got = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "_text", "_label").collect()  # bounded by sample and MOST_BYTES
    once = {r["_text"]: r for r in sorted(got, key=lambda r: (-r["doc_id"], r["_label"]))}
    got = sorted(once.values(), key=lambda r: r["doc_id"])[:sample]
    texts = [r["_text"] for r in got]
    vocabulary = vocabulary_of(texts)
    return BlockMaxIndex(texts, [r["_label"] for r in got], [r["doc_id"] for r in got], vocabulary, *frequencies(docs, vocabulary))


def scored(docs: DataFrame, index: BlockMaxIndex, keep=()) -> DataFrame:
    """doc_id, score, neighbours and cosines (the evidence) and ``keep``, a row a document.

    A null text counts as empty; a text without any of the index's terms gets the score of the prior. Texts
    of any length are scored whole, repeated rows each by itself; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(index)  # bounded by SAMPLE and MOST_BYTES

    def each(batches):
        own = sent.value
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            got = own.scores([t.as_py() for t in batch.column(0)])
            made = [pa.array([g[0] for g in got], pa.float64()), pa.array([own.ids[g[1]].tolist() for g in got], pa.list_(pa.int64())), pa.array([g[2].tolist() for g in got], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*made, *batch.columns[1:]], names=["score", "neighbours", "cosines", *batch.schema.names[1:]])

    rows = docs.select(F.col("text").alias("_text"), "doc_id", *keep)
    return rows.mapInArrow(each, schema_of("score double, neighbours array<long>, cosines array<double>", rows.schema.fields[1:]))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.slice("neighbours", 1, 3).alias("neighbours"))
