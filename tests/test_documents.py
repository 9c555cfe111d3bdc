"""Folds, streams, chapters and statistics of documents that SQL cannot express, against plain Python."""

import random

import pytest

from narrata.functions import hashes
from narrata.operators import documents, records, requests
from narrata.operators.folds import resumed, sequenced
from narrata.streaming import sinks

rng = random.Random(4)


def test_folds_pass_by_in_batches(spark):
    """A state goes on over batches, and each key starts anew."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(k, i, rng.randrange(9)) for k in range(5) for i in range(30)]
        step = lambda total, r: (total + r["x"], [(total + r["x"],)])
        got = sequenced(spark.createDataFrame(rows, "k int, i int, x int").repartition(3), ["k"], ["i"], lambda: 0, step, "total int", lambda total: [(-total,)]).collect()
        for k in range(5):
            want, total = [], 0
            for _, i, x in sorted(r for r in rows if r[0] == k):
                total += x
                want.append(total)
            assert [r.total for r in got if r.k == k] == [*want, -total]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("size", [3, 50])
def test_cache_against_a_dictionary(spark, size):
    """Entries expire from when they were stored, and the one used longest ago makes room."""
    rows = [(f"r{i:04}", rng.choice("ab"), f"q{rng.randrange(9)}", i * 7, rng.random() < 0.7) for i in range(400)]
    want = []
    for provider in "ab":
        cache = {}
        for request, p, prompt, ts, ok in rows:
            if p != provider:
                continue
            stored, used = cache.get(prompt, (None, None))
            outcome, evicted = "miss" if stored is None else "expired" if ts - stored > 200 else "hit", None
            if outcome == "expired":
                del cache[prompt]
            if outcome == "hit":
                cache[prompt] = (stored, ts)
            elif ok:
                if len(cache) >= size:
                    evicted = min(cache, key=lambda q: cache[q][1])
                    del cache[evicted]
                cache[prompt] = (ts, ts)
            want.append((provider, request, outcome, evicted))
    df = spark.createDataFrame(rows, "request string, provider string, prompt string, ts long, ok boolean").repartition(4)
    got = requests.cache_events(df, ttl=200, size=size).collect()
    assert sorted((r.provider, r.request, r.outcome, r.evicted) for r in got) == sorted(want) if size == 50 else {(r.provider, r.request, r.outcome, r.evicted) for r in got} == set(want)


def test_requests_join_those_in_flight(spark):
    rows = [("a", "q", f"r{i}", i * 4000) for i in range(10)]
    got = requests.deduplicated(spark.createDataFrame(rows, "provider string, prompt string, request string, ts long"), 5000).collect()
    assert sorted(r.ts for r in got) == [0, 8000, 16000, 24000, 32000]


def test_streams_show_whole_paragraphs(spark):
    texts = {k: "".join(rng.choice(["word ", "\n\n", "longer words here, "]) for _ in range(300)) for k in range(3)}
    tokens = [(k, i, t[j : j + 5]) for k, t in texts.items() for i, j in enumerate(range(0, len(t), 5))]
    got = documents.flushed(spark.createDataFrame(tokens, "session int, pos int, token string").repartition(3), 80).collect()
    for k, text in texts.items():
        parts = [r.text for r in sorted(got, key=lambda r: r.flush) if r.session == k]
        assert "\n\n".join(parts).rstrip() == text.rstrip()
        assert len(parts) > 3


def test_typed_fragments(spark):
    text = 'Anna nodded slowly, "We go now," said Tom. He walked to the far end of the long hall and then back again to the door, '
    rows = documents.typed_fragments(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("pos").collect()
    assert [(r.kind, r.content[:12]) for r in rows] == [("action_beat", "Anna nodded "), ("dialogue", '"We go now,"'), ("narration", "said Tom. He")] or [r.kind for r in rows] == ["action_beat", "dialogue", "narration"]
    assert not rows[-1].content.endswith(",")


def test_document_statistics(spark):
    paras = [(1, 0, 'Tom said, "Come here." Then nothing.'), (1, 1, "Five more words stand here."), (2, 0, "One")]
    found = [(1, 1, 0), (1, 2, 1), (2, 1, 0)]
    got = {r.doc_id: r for r in documents.document_statistics(spark.createDataFrame(paras, "doc_id int, pos int, text string"), spark.createDataFrame(found, "doc_id int, scene int, pos int")).collect()}
    r = got[1]
    assert (r.words, r.paragraphs, r.scenes, r.dialogue_fragments, r.narration_fragments) == (11, 2, 2, 1, 3)
    assert (r.words_per_paragraph, r.words_per_scene, r.dialogue_ratio) == (6, 6, 0.25)
    assert (got[2].words, got[2].dialogue_fragments, got[2].speakers) == (1, 0, "")


def test_tiers_of_chapters(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "x\nPart ii: one\nScene 4. two"), (3, "plain"), (4, None)], "doc_id int, text string")
    headed = spark.createDataFrame([(1, 1, "One", "a"), (1, 2, "Two", "b")], "doc_id int, chapter int, title string, content string")
    got = sorted((r.doc_id, r.tier, r.chapter, r.content) for r in documents.detected_chapters(texts, headed).collect())
    assert got == [(1, "chapter_regex", 1, "a"), (1, "chapter_regex", 2, "b"), (2, "scene_split", 1, "x"), (2, "scene_split", 2, "one"), (2, "scene_split", 3, "two"), (3, "single_chapter_safe_mode", 1, "plain"), (4, "single_chapter_safe_mode", 1, "")]


def test_scene_sets_lose_nothing(spark):
    texts = spark.createDataFrame([(1, "a b\n\nc"), (2, "a b\n\nc"), (3, "x y"), (4, " ")], "doc_id int, text string")
    first = spark.createDataFrame([(1, 1, "a b"), (1, 2, ""), (1, 3, "c"), (1, 4, "c"), (2, 1, "a")], "doc_id int, scene int, text string")
    second = spark.createDataFrame([(2, 1, "a"), (2, 2, "b c"), (3, 1, "z")], "doc_id int, scene int, text string")
    got = sorted((r.doc_id, r.scene, r.text) for r in documents.scene_sets(texts, first, second).collect())
    assert got == [(1, 1, "a b"), (1, 2, "c"), (2, 1, "a"), (2, 2, "b c"), (3, 1, "x y")]


def test_long_paragraphs_are_cut(spark):
    text = " ".join("w" * rng.randrange(1, 40) for _ in range(600)) + "x" * 5000
    parts = [r.text for r in documents.parts(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("part").collect()]
    rest, want = text, []
    while len(rest) > 3500:
        at = rest[:3500].rfind(" ")
        at = at if at >= 1400 else 3500
        want.append(rest[:at].strip())
        rest = rest[at:].strip()
    assert parts == [*want, rest]


def test_failing_stages_are_named(spark):
    with pytest.raises(RuntimeError, match="second"):
        documents.composed(spark.range(3), [("first", lambda df: df), ("second", lambda df: df.select("nothing"))])


def test_hashes(spark):
    def js(text):
        h = 0x811C9DC5
        signed = lambda x: (x & 0xFFFFFFFF) - (1 << 32) if x & 0x80000000 else x & 0xFFFFFFFF
        raw = text.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = signed(int(float(signed(h) ^ int.from_bytes(raw[i : i + 2], "big")) * 16777619.0))
        return h & 0xFFFFFFFF

    texts = ["", "a", "hello world", "é😀 longer text " * 20]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", hashes.fnv1a("t").alias("h"), hashes.cache_key("t", "t").alias("k")).collect()
    assert {r.i: r.h for r in rows} == {i: js(t) for i, t in enumerate(texts)}


def test_newest_rows_of_a_key(spark, tmp_path):
    write = sinks.latest_writer(f"file://{tmp_path}", "k", "ts")
    write(spark.createDataFrame([(1, 5, "new"), (1, 3, "old"), (2, 1, "a")], "k int, ts int, v string"), 0)
    write(spark.createDataFrame([(1, 4, "late"), (2, 1, "b"), (3, 9, "c")], "k int, ts int, v string"), 1)
    got = sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/1").select("k", "ts", "v").collect()))
    assert got == [(1, 5, "new"), (2, 1, "b"), (3, 9, "c")]


def test_broadcast_sides_are_bounded(spark):
    many = spark.range(requests.MOST_POLICIES + 1)
    with pytest.raises(ValueError, match="policies"):
        requests.bounded(many, requests.MOST_POLICIES, "policies")


def test_merged_words(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("Run", ["walk", "RUN", " jog"], ["Walk", "", "sprint"])], "b string, x array<string>, y array<string>")
    assert df.select(records.merged_words("b", F.col("x"), F.col("y")).alias("w")).first().w == ["walk", "jog", "sprint"]


def test_prices_of_their_time(spark):
    """Calls before any price, on the day of a change and long after it; one provider with nearly all calls; stretches of any width."""
    rng_ = random.Random(12)
    prices = [("a", 50, 7), ("a", 400, 9), ("a", 400, 8), ("b", 10, 3), ("a", 1000, 2), ("c", None, 5), ("a", 700, None)]
    calls = [("a" if rng_.random() < 0.9 else rng_.choice("bcd"), rng_.randrange(1500), rng_.randrange(40), rng_.randrange(40)) for _ in range(900)] + [("a", 400, None, 5), ("a", 399, 1, None), ("b", 10, 1, 1)]
    want = {}
    for provider, ts, estimated, tokens in calls:
        known = [(since, micros) for p, since, micros in prices if p == provider and since is not None and micros is not None]
        then = max((x for x in known if x[0] <= ts), default=(None, None))[1]
        newest = max(known, default=(0, 0))[1]
        w = want.setdefault(provider, [0, 0, 0, 0])
        for i, x in enumerate((1, then is None, (estimated or 0) * newest, (tokens or 0) * (then or 0))):
            w[i] += x
    c = spark.createDataFrame(calls, "provider string, ts long, estimated long, tokens long").repartition(3)
    p = spark.createDataFrame(prices, "provider string, since long, micros long")
    for width in (37, 400, 100_000):
        got = {r.provider: (r.calls, r.unpriced, r.estimated_usd, r.actual_usd) for r in requests.dated_costs(c, p, width).collect()}
        assert got == {k: (n, u, e / 1e9, a / 1e9) for k, (n, u, e, a) in want.items()}
    assert requests.dated_costs(c.limit(0), p).count() == 0


@pytest.mark.parametrize("hot", [True, False])
def test_resumed_folds(spark, hot):
    """Zones of near values, with one key in nearly all rows or with many keys: as a plain loop, and all ranges at once."""
    rng_ = random.Random(21)
    rows = [(0 if hot and rng_.random() < 0.97 else rng_.randrange(9 if hot else 700), i, rng_.choice([0.1, 0.12, 0.14, 0.2, 0.4])) for i in range(20_000)]

    def step(state, place, row):
        start, anchor = state
        return (state, ()) if anchor is not None and abs(row[1] - anchor) <= 0.05 else ((place, row[1]), [(start, place - 1)] if place > start else [])

    want = []
    for k in {r[0] for r in rows}:
        state, mine = (0, None), sorted(r[1:] for r in rows if r[0] == k)
        for place, row in enumerate(mine):
            state, out = step(state, place, row)
            want += [(k, *x) for x in out]
        want.append((k, state[0], len(mine) - 1))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rounds = []
        df = spark.createDataFrame(rows, "k int, i int, x double").repartition(5)
        got = resumed(df, ["k"], ["i"], lambda: (0, None), step, "a int, b int", lambda state, n: [(state[0], n - 1)], rounds, small=0)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
        # the large key is most of the ranges, and they agree soon
        assert (rounds[0] >= 12 and len(rounds) <= 3) if hot else rounds == []
        # a fold that never forgets takes a round a range and is right all the same
        rounds = []
        total = resumed(df.filter("k = 0"), ["k"], ["i"], lambda: 0, lambda s, place, row: (s + row[0], ()), "total long", lambda s, n: [(s,)], rounds, small=0)
        assert [r.total for r in total.collect()] == [sum(r[1] for r in rows if r[0] == 0)]
        for small in (0, 1 << 40):
            assert resumed(df.limit(0), ["k"], ["i"], lambda: 0, lambda s, place, row: (s, ()), "x int", small=small).count() == 0
        # few bytes are one pass
        one = resumed(df, ["k"], ["i"], lambda: (0, None), step, "a int, b int", lambda state, n: [(state[0], n - 1)], [], small=1 << 40)
        assert sorted(tuple(r) for r in one.collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_composed_pipeline_goes_through_scenes(spark, tmp_path):
    from narrata.plans import more_queries

    long = "word " * 1500
    docs = [(1, "He sat there.\n\n***\n\nThey ran off."), (2, f"One.\r\n \r\nTwo.\n\n{long}\n\nMeanwhile they left."), (3, None), (4, "***"), (5, "Only one.")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.paragraphs, r.scenes, r.parts) for r in more_queries.composed_pipeline(spark, str(tmp_path)).filter("doc_id > 0").collect()}
    assert got == {1: (3, 2, 3), 2: (4, 2, 6), 4: (1, 0, 1), 5: (1, 1, 1)}
