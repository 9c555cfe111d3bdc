"""The near-duplicate stage against 5-word similarity by brute force."""

import pytest

import corpus_pipeline as pipeline
from narrata.llm import near, simhash


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("width", [512, 2])
def test_stage_keeps_one_of_each_likeness_group(spark, monkeypatch, width):
    monkeypatch.setattr(near, "SLICE", width)
    texts = {}
    for k in range(40):  # copies with words changed here and there, of likeness above and below 0.8
        words = [f"w{k}x{(i * 7919 + k) % 997}" for i in range(150)]
        texts[10 * k + 1] = " ".join(words)
        for j in range(1, 6):
            other = list(words)
            for at in range(j):
                other[15 + 25 * at] = f"new{j}y{at}"
            texts[10 * k + 1 + j] = " ".join(other)
    texts |= {1001: "", 1002: None, 1003: "one two", 1004: "One  two", 1005: "three"}
    sets = {i: grams(t) for i, t in texts.items()}
    least = {i: i for i in texts}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    far = 0
    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both * 5 >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                least[y] = x
                far += (simhash.simhash((texts[a] or "").encode()) ^ simhash.simhash((texts[b] or "").encode())).bit_count() > pipeline.RADIUS
    assert far > 20  # pairs that the fingerprints alone do not link
    docs = spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id long, text string, source string")
    kept = {r.doc_id for r in pipeline.deduplicate(spark, docs, "").collect()}
    assert kept == {root(i) for i in ids}
    assert {r.doc_id for r in near.one_of_each(docs.union(docs)).collect()} == kept
