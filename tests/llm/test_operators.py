"""The training-data operators against brute force, on small tables with nulls, empties, ties, repeats and odd texts."""

import base64
import collections
import hashlib
import itertools
import random
import re
import tempfile
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from narrata.llm import bpe, components, embeddings, fingerprints, licenses, mixing, quality, secrets, simhash, substrings, toxicity
from narrata.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bits string, u string, key string"
rng = random.Random(5)
WORDS = ["the", "and", "of", "Rain", "stone", "mill", "énorme", "licence", "token", "über", "river", "a", "gate", "night", "MIT", "CC", "by"]


def prose(n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", ".", "\n"]) for _ in range(n))


_long = prose(900)
_mid = prose(120)
TEXTS = [
    None, "", " \n\t ", "one", "one", "two words", _mid, _mid, _mid.replace("river", "brook", 1), _long, _long + " tail", "head " + _long[:1500], prose(60), "x" * 700, "ab" * 300, "Ünïcode 😀 " * 60,
    'password = "hunter2hunter2" and token: abc then secret:token:abcdefgh1', "AKIA" + "A1B2" * 5 + " " + "0123456789abcdef" * 3, "api_key='AAAAbbbb1234' ghp_" + "a1" * 20,
    "Licensed under the MIT License. GNU General Public License v3, Apache License, Version 2.0; CC-BY and cc by-nc 4.0\nSPDX-License-Identifier: MIT", "İ K license", "https://user:secretpw@host/x -----BEGIN RSA PRIVATE KEY-----",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 % 64, t, "en", ["a", "b", None, "ç"][i % 4], len(t or ""), "x", "y", "z") for i, t in enumerate(TEXTS)]
    rows += [rows[6], (None, _mid, "en", "a", 1, "x", "y", "z")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, docs):
    ids = [r.doc_id for r in docs.select("doc_id").distinct().collect() if r.doc_id is not None]
    return spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in ids], "doc_id long, quality int, toxic int")


def pairs(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def test_queries_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_empty_tables(spark, empty, labels):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert fingerprints.with_next(fingerprints.fingerprints(empty), ["text", "fingerprint"]).count() == 0
    assert bpe.encode(empty).count() == 0
    assert licenses.scan(empty).count() == 0
    assert secrets.find(empty).count() == 0 and secrets.redact(empty).columns == empty.columns
    assert embeddings.near_duplicates(vectors).count() == 0
    assert substrings.remove_repeats(empty).count() == 0
    assert simhash.groups(empty).count() == 0 and simhash.one_of_each(empty).count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert quality.scored(empty, quality.train(empty, labels)).count() == 0
    assert toxicity.scored(empty, toxicity.train(empty, labels)).count() == 0


def test_fingerprints(spark, docs):
    assert len(fingerprints.fingerprints(docs).collect()) == docs.count()
    by_text = collections.defaultdict(set)
    for r in fingerprints.fingerprints(docs).collect():
        by_text[r.text].add(r.fingerprint)
        assert re.fullmatch("[0-9a-f]{256}", r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    texts = [prose(n) for n in (3, 8, 40, 300, 1500)]
    rows = [(i, t, " ".join(t.split()[: len(t.split()) // 2] + prose(len(t.split()) // 2).split())) for i, t in enumerate(texts)]
    got = spark.createDataFrame(rows, "i int, a string, b string").select("i", fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("j")).collect()
    shingles = lambda t: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))}
    for r in got:
        a, b = shingles(rows[r.i][1]), shingles(rows[r.i][2])
        assert abs(r.j - len(a & b) / len(a | b)) < 0.15


@pytest.mark.parametrize("ranges", [1, 3, 200])
def test_next_document(docs, ranges):
    rows = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(rows, ["text"], ranges).collect()}
    order = sorted(pairs(rows))
    assert got == {i: order[(k + 1) % len(order)][1] for k, (i, _) in enumerate(order)}
    assert fingerprints.with_next(docs.select("doc_id", "text"), ["text"], ranges).count() == docs.count()


@pytest.mark.parametrize("chunk, overlap", [(1 << 15, 1 << 11), (60, 20), (25, 10)])
def test_bpe(docs, chunk, overlap):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.VOCABULARY), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((i if i is not None else -1, len(x := encoding.encode_ordinary(t)), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in pairs(docs))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(docs, chunk=chunk, overlap=overlap).collect())
    assert got == want


def test_stitching_fails_where_nothing_meets():
    assert bpe.stitch([np.array([0, 5, 9, 12]), np.array([8, 11, 14])], [0, 8]) is None
    assert bpe.stitch([np.array([0, 5, 9, 12, 20, 30, 31]), np.array([8, 9, 12, 14])], [0, 8]) == [(0, 2), (1, 4)]


def test_licenses(docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(docs).collect())
    want = []
    for i, t in pairs(docs):
        w = word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        at, names = [], set()
        for phrase, name in licenses.PHRASES.items():
            p = phrase.split()
            hits = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += hits
            names |= {name} if hits else set()
        want.append((i if i is not None else -1, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(names))))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_license_rules(spark):
    rules = licenses.rules()
    assert len(rules) >= 200
    texts = {1: "SPDX-License-Identifier: Apache-2.0", 2: "licensed under the MIT License", 3: "see https://opensource.org/licenses/MIT for terms", 4: "GNU General Public License version 3", 5: "nothing here", 6: "MIT"}
    got = {r.doc_id: (r.labels, r.score, r.n_detections) for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[1] == ("apache-2.0", 1.0, 1)
    assert got[2] == ("mit", 0.9, 1)
    assert "mit" in got[3][0].split(",") and "gpl-3.0" in got[4][0].split(",")
    assert got[5] == got[6] == ("", 0.0, 0)


def test_secrets(docs):
    patterns = [(re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8), (re.compile("AKIA[A-Z0-9]+"), 0, 16), (re.compile("[0-9a-f]+"), 0, 32)]
    want = sorted((i if i is not None else -1, sorted((m.start(), k, m.end()) for k, (p, g, n) in enumerate(patterns) for m in p.finditer(t) if len(m[g]) >= n)) for i, t in pairs(docs))
    got = sorted((r.doc_id if r.doc_id is not None else -1, sorted((s.start, s.kind, s.end) for s in r.secrets if s.kind < secrets.BASE)) for r in secrets.find(docs).collect())
    assert got == want
    kinds = {secrets.RULES[s.kind][0] for r in secrets.find(docs).collect() for s in r.secrets}
    assert {"code_host", "url", "pem"} <= kinds


def test_trigram_queries_are_sound():
    samples = {"code_host": "ghs_" + "Z9" * 20, "chat": "xoxb-1234567890ab", "cloud": "AIza" + "x" * 35, "payment": "sk_live_" + "a" * 20, "pem": "-----BEGIN EC PRIVATE KEY-----", "bearer": "Bearer " + "t" * 30, "assign": "API_KEY = abcdefgh", "access": "AKIA" + "B" * 16, "registry": "npm_" + "a" * 36}
    for kind, sample in samples.items():
        pattern = next(r[1] for r in secrets.RULES if r[0] == kind)
        assert re.search(pattern, sample)
        assert any(all(t in sample.lower() for t in grams) for grams in secrets.trigram_query(pattern)), kind
    assert secrets.trigram_query("[0-9a-f]{32,}") == [[]]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "a token=abcdefgh1 b", 19), (2, None, 0), (3, "plain", 5)], "doc_id long, text string, n_chars long")
    assert sorted(map(tuple, secrets.redact(df).collect())) == [(1, "a <assign> b", 12), (2, None, 0), (3, "plain", 5)]


def test_components(spark):
    n = 300
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(220)] + [(k, k + 1) for k in range(400, 440)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def brute_simhash(text, width=3):
    w = text.encode().lower().split()
    s = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    ones = [sum(xxhash.xxh64_intdigest(x, 42) >> j & 1 for x in s) for j in range(64)]
    return sum(1 << j for j in range(64) if 2 * ones[j] > len(s))


@pytest.mark.parametrize("radius", [3, 5])
def test_masks_cover(radius):
    masks = simhash.masks(radius)
    for _ in range(3000):
        x = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(x & m == 0 for m in masks)


def test_simhash(spark, docs, monkeypatch):
    got = [(r.doc_id, r.bits % 2**64, r.component_id) for r in simhash.groups(docs).collect()]
    fps = {(i, brute_simhash(t)) for i, t in pairs(docs)}
    assert {(i, b) for i, b, _ in got} == fps and len(got) == docs.count()
    assert all(c is not None for _, b, c in got)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(5))) for b in base for _ in range(4)]
    bits = sorted(set(base + near))
    rows = [(i, b - 2**64 if b >> 63 else b) for i, b in enumerate(bits)]
    classes = spark.createDataFrame(rows, "id long, bits long")
    parent = list(range(len(bits)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(bits)):
        for j in range(i):
            if (bits[i] ^ bits[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    for wide in (4096, 2):
        monkeypatch.setattr(simhash, "WIDE", wide)
        found = {r.node: r.component for r in components.components(simhash.links(classes)).collect()}
        assert all(found.get(i, i) == find(i) for i in range(len(bits)))


def test_one_of_each(docs):
    kept = simhash.one_of_each(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and ids.count(None) == 1
    comps = {r.doc_id: r.component_id for r in simhash.groups(docs).collect() if r.doc_id is not None}
    assert sorted(i for i in ids if i is not None) == sorted(set(comps.values()))


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    assert rows == mixing.mix(docs).collect() or sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    total, size = sum(r.size for r in rows), {}
    for r in rows:
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        size[r.source_size, r.target] = size.get((r.source_size, r.target), 0) + r.taken
    assert sum(size.values()) <= total
    longest = max(r.size for r in rows)
    assert all(abs(taken - target) <= 2 * longest for (_, target), taken in size.items())
    mixed = mixing.mixed(docs)
    assert mixed.count() == sum(r.taken // r.size for r in rows if r.size)


def test_targets(spark):
    sizes = [("0a", 100), ("0b", 10), ("0c", 50), ("0d", 0), ("1", 40)]
    got = {r.skey: r.target for r in mixing.targets(spark.createDataFrame(sizes, "skey string, source_size long")).collect()}
    left, target = {k: (i % 3 + 1, 3 * s) for i, (k, s) in enumerate(sizes)}, {}
    budget = float(sum(s for _, s in sizes))
    while True:
        level = (budget - sum(target.values())) / sum(w for w, _ in left.values())
        full = [k for k, (w, cap) in left.items() if level * w > cap]
        if not full:
            break
        for k in full:
            target[k] = left.pop(k)[1]
    target |= {k: level * w for k, (w, _) in left.items()}
    assert got == pytest.approx(target)


def test_substrings(docs):
    n = 60
    texts = [t.encode() for _, t in pairs(docs)]
    seen = collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    want = []
    for i, t in pairs(docs):
        b, runs = t.encode(), []
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                if runs and k <= runs[-1][1]:
                    runs[-1][1] = k + n
                else:
                    runs.append([k, k + n])
        kept, at = b"", 0
        for x, y in runs:
            kept, at = kept + b[at:x], y
        want.append((i if i is not None else -1, len(b), sum(y - x for x, y in runs), len(runs), hashlib.sha256(kept + b[at:]).hexdigest()))
    for wide in (1 << 17, 1):
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(docs, n, 16, wide=wide).collect())
        assert got == sorted(want)


def test_blocks_of_long_texts(monkeypatch):
    rng_ = np.random.default_rng(3)
    text = bytes(rng_.integers(97, 123, 5000, dtype=np.uint8))
    whole = substrings.Hasher(60, 16)
    a = whole.anchors(text)
    monkeypatch.setattr(substrings, "BLOCK", 700)
    b = substrings.Hasher(60, 16).anchors(text)
    assert set(a[2]) <= set(b[2])
    covered = np.zeros(len(text) - 59, bool)
    for first, last in zip(b[3], b[4]):
        covered[first : last + 1] = True
    assert covered.all()


def test_levels(spark):
    levels = substrings.Levels()
    body = prose(200)
    batches = [[(i * 10 + k, (prose(80) + (body if k == 0 else "")).encode()) for k in range(3)] for i in range(4)]
    found = [levels.add(spark.createDataFrame(b, "key long, text binary")).collect() for b in batches]
    assert not any(r.earlier for r in found[0])
    assert all(any(r.earlier and r.whole for r in f) for f in found[1:])
    assert len(levels.levels) < 4


def test_embeddings(spark):
    g = np.random.default_rng(1)
    base = g.normal(size=(60, 64))
    x = np.concatenate([base, base[:20] + g.normal(size=(20, 64)) * 0.2, base[:10] + g.normal(size=(10, 64)) * 0.3, base[:3]]).astype(np.float32)
    rows = [(i * 2, v.tolist(), i % 3) for i, v in enumerate(x)] + [(1, None, 0), (3, [], 0), (5, [0.0] * 64, 0), (7, [float("nan")] + [1.0] * 63, 0), (9, [None] + [1.0] * 63, 0), (11, [float("inf")] + [1.0] * 63, 0), (13, [1.0, 2.0], 0)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    found = sum(got[i * 2].n_links for i in range(len(u)))
    assert 0.9 * near.sum() <= found <= near.sum()
    assert all(got[i * 2].n_links <= near[i].sum() for i in range(len(u)))
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (1, 3, 5, 7, 9, 11, 13))
    assert len(got) == len(rows)


def test_large_cells_are_dealt_by_groups(spark, monkeypatch):
    g = np.random.default_rng(2)
    x = (g.normal(size=(1, 64)) + g.normal(size=(40, 64)) * 0.05).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(embeddings, "GROUP", 7)
    assert all(r.n_links == 39 and r.component_id == 0 for r in embeddings.near_duplicates(df).collect())


@pytest.mark.parametrize("width", [16, 24, 64, 256, 1536])
def test_recall_at_the_least_cosine(width):
    """Of pairs at a cosine of 0.9, at least 0.9 meet in some table; unrelated vectors hardly ever do, at any width."""
    g = np.random.default_rng(width)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(g.normal(size=(300, width)))
    z = g.normal(size=x.shape)
    y = 0.9 * x + np.sqrt(1 - 0.81) * unit(z - (z * x).sum(1, keepdims=True) * x)
    met, apart = np.zeros(300, bool), 0.0
    for t in range(embeddings.TABLES):
        a, b = embeddings.cells(x, t), embeddings.cells(y, t)
        met |= (a[:, :1] == b).any(1) | (b[:, :1] == a).any(1)
        apart = max(apart, ((a[:, :1] == a[:, 0]).sum() - 300) / (300 * 299))
    assert met.mean() >= 0.9 and apart < 0.001


def test_lattice_points_are_nearest():
    y = np.random.default_rng(4).normal(size=(50, 8))
    points, far = embeddings.nearest_points(y)
    assert (np.diff(far, axis=1) >= 0).all() and ((points.sum(2) // 2) % 2 == 0).all()
    halves = points % 2
    assert (halves == halves[:, :, :1]).all()


def held_out(spark, sf_dir, name, label, n, part):
    rows = QUERIES[name](spark, sf_dir).collect()
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == part) and 0 <= r.score <= 1
    return [(r.score, r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]


def test_quality_on_held_out_rows(spark):
    got = held_out(spark, "/root/testdata/sf0.01", "op10_quality", "quality", 4, 2)
    assert np.mean([p == y for _, p, y in got]) >= 0.95


def test_toxicity_on_held_out_rows(spark):
    got = held_out(spark, "/root/testdata/sf0.01", "op2_toxicity", "toxic", 5, 0)
    assert np.mean([p == y for _, p, y in got]) >= 0.9


def test_chains_match_their_batched_form():
    g = np.random.default_rng(0)
    model = {"w": g.normal(size=4), "a": g.normal(size=(2, 2))}
    x = g.normal(size=(6, 4))
    good, _, _ = quality._both_ways((x @ model["w"])[None, :], model["a"], np.ones((1, 6), bool))
    assert quality.marginals(x, model) == pytest.approx(good[0].tolist())


def test_marginals_against_all_labelings():
    """Marginals, pair marginals and log Z of short chains, by summing over every labelling."""
    g = np.random.default_rng(2)
    a, e = g.normal(size=(2, 2)), g.normal(size=(4, 5))
    mask = np.arange(5)[None, :] < np.array([1, 2, 4, 5])[:, None]
    good, pairs, z = quality._both_ways(e * mask, a, mask)
    all_pairs = np.zeros((2, 2))
    for row, n in enumerate([1, 2, 4, 5]):
        total, marginal, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            p = np.exp(sum(e[row, t] for t in range(n) if y[t]) + sum(a[y[t], y[t + 1]] for t in range(n - 1)))
            total, marginal = total + p, marginal + p * np.array(y)
            for t in range(n - 1):
                two[y[t], y[t + 1]] += p
        assert z[row] == pytest.approx(np.log(total))
        assert good[row, :n] == pytest.approx(marginal / total)
        all_pairs += two / total
    assert pairs == pytest.approx(all_pairs)


def test_lines_of_a_document_have_labels_of_their_own():
    """A text of good and bad lines gets marginals that follow its lines, and a score between."""
    r = random.Random(1)
    clean = lambda: " ".join(r.choice(["the", "river", "ran", "under", "stones"]) for _ in range(9)) + "."
    noise = lambda: " ".join(r.choice(["$$$", "###", "%%%", "AAAA", "0101"]) for _ in range(9))
    good = ["\n".join(clean() for _ in range(6)) for _ in range(60)]
    bad = ["\n".join(noise() for _ in range(6)) for _ in range(60)]
    model = quality.fit([t.encode() for t in good + bad], [1] * 60 + [0] * 60)
    of = lambda t: quality.marginals(quality.line_features(t.encode())[0], model)
    p = np.array([of("\n".join([clean() for _ in range(4)] + [noise() for _ in range(4)])) for _ in range(20)])
    assert (p[:, :3] > 0.5).all() and (p[:, 5:] < 0.5).all()
    score = lambda t: quality.score(t.encode(), model)
    assert min(map(score, good)) > max(map(score, bad))
    half = [score("\n".join([clean() for _ in range(k)] + [noise() for _ in range(10 - k)])) for k in (1, 5, 9)]
    assert half == sorted(half)


def test_block_max_search_is_exact(monkeypatch):
    """Against cosines over all terms of all texts."""
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    r = random.Random(3)
    texts = [prose(30) + " " + " ".join(f"w{r.randrange(400)}ling" for _ in range(12)) for _ in range(300)]
    y = [int("MIT" in t) for t in texts]
    texts = [t + (" vile" * 3 if k else "") for t, k in zip(texts, y)]
    index = toxicity.BlockMaxIndex(texts, y, list(range(300)))
    terms = lambda t: collections.Counter(re.findall(r"[^\W\d_]+", t.lower()))
    counts = [terms(t) for t in texts]
    df = collections.Counter(t for c in counts for t in c)
    assert set(df) == set(index.vocabulary)
    phi = {t: abs(np.corrcoef([t in c for c in counts], y)[0, 1]) if n < 300 else 0.0 for t, n in df.items()}

    def unit(c):
        w = {t: (1 + np.log(n)) * (np.log(300 / df[t]) + 1) * phi[t] for t, n in c.items() if t in df}
        size = np.sqrt(sum(x * x for x in w.values()))
        return {t: x / size for t, x in w.items()}

    vectors = {i: unit(c) for i, c in enumerate(counts)}
    for t in texts[:25]:
        q = unit(terms(t + " vile"))
        full = sorted((-sum(x * vectors[i].get(k, 0) for k, x in q.items()), i) for i in vectors)
        best, score = index.nearest(*index.vector(toxicity.counts_of(t + " vile", index.vocabulary)))
        assert score == pytest.approx([-s for s, _ in full[:15]])
        assert {int(index.ids[b]) for b, s in zip(best, score) if s > -full[14][0] + 1e-9} == {i for s, i in full[:15] if -s > -full[14][0] + 1e-9}


def test_scores_do_not_move_with_size(spark):
    """A table whose rows repeat under new ids gives its rows the same scores."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(80).cache()
    labels = docs.select("doc_id", (F.pmod("doc_id", F.lit(7)) == 0).cast("int").alias("toxic"))
    more = lambda df: df.withColumn("doc_id", F.explode(F.array(*[F.col("doc_id") + 1_000_000 * k for k in range(10)])))
    never = (5, 7)  # no remainder of 5 is 7, so that both tables fit on the same texts
    once = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.train(docs, labels, held_out=never)).collect()}
    ten = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.train(more(docs), more(labels), held_out=never)).collect()}
    assert ten == pytest.approx(once)


def test_fingerprint_query(spark, docs):
    """All columns of the contract: texts and digests from Python, likeness from the digits of the fingerprints."""
    rows = sorted((i, t) for i, t in pairs(docs.filter("doc_id is not null").dropDuplicates(["doc_id"])))
    path = f"{tempfile.mkdtemp()}"
    spark.createDataFrame([(i, t or None) for i, t in rows], "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    got = {r.doc_id: r for r in fingerprints.op1_fingerprints(spark, path).collect()}
    assert sorted(got) == [i for i, _ in rows]
    edited = []
    for k, (i, t) in enumerate(rows):
        half = len(t) // 2
        after = rows[(k + 1) % len(rows)][1]
        edited.append((i, t[: len(t) - half] + after[:half]))
    prints = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(spark.createDataFrame(edited, "doc_id long, text string")).collect()}
    like = lambda x, y: max(0.0, (sum(p == q for p, q in zip(x, y)) / 256 - 1 / 16) / (1 - 1 / 16))
    for k, (i, t) in enumerate(rows):
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited[k][1].encode()).hexdigest()
        assert r.edited_fingerprint == prints[i]
        assert r.near_edited == pytest.approx(like(r.fingerprint, prints[i]))
        assert r.near_next == pytest.approx(like(r.fingerprint, got[rows[(k + 1) % len(rows)][0]].fingerprint))


def test_many_matches_in_one_text(spark):
    """Tens of thousands of matches in one text, with letters of several bytes between them."""
    n = 20_000
    text = "".join(f"é token=abcdefgh{k % 10} 😀" for k in range(n))
    license_ = "licensed under the MIT License; " * 3000
    df = spark.createDataFrame([(1, text), (2, license_)], "doc_id long, text string")
    start = time.time()
    r = {x.doc_id: x for x in secrets.redact(df).collect()}
    assert r[1].text == "é <assign> 😀" * n and r[2].text == license_
    found = {x.doc_id: x.secrets for x in secrets.find(df).collect()}
    assert [(s.start, s.end) for s in found[1]] == [(m.start(), m.end()) for m in re.finditer(r"token=\w+", text)]
    assert {x.doc_id: x.n_detections for x in licenses.scan(df).collect()}[2] == 3000
    assert time.time() - start < 120


def test_mixed_picks_alike_among_ties(spark):
    rows = [(k // 3, "one two three " * (1 + k % 2), f"s{k % 4}", k) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    runs = [sorted(map(tuple, mixing.mixed(df.repartition(n)).collect())) for n in (1, 3)]
    assert runs[0] == runs[1]


def test_scores_of_odd_texts(docs, labels):
    for module in (quality, toxicity):
        rows = module.scored(docs, module.train(docs, labels)).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
