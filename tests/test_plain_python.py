"""Queries that have no SQL, over their whole inputs, against the same rules in plain Python."""

import math
import re

import pytest

from narrata.operators import chapters
from narrata.plans import book_queries, fixtures, more_queries, registry, text_queries

#: Queries without SQL, and the test that holds them.
HELD = {
    "thought_statistics": "here", "extracted_normal": "here", "dialogue_fragments": "here", "structured_dialogue": "here", "tense_formats": "here", "merged_metadata": "here",
    "flushed_streams": "here", "markup_counts": "here", "composed_pipeline": "here", "original_mode": "here", "detected_tiers": "here",
    "cache_events": "test_documents.test_cache_against_a_dictionary", "document_statistics": "test_documents.test_document_statistics", "typed_fragments": "test_documents.test_typed_fragments",
    "scene_titles": "test_values.test_scenes", "chapters": "test_values.test_chapters", "exported_chapters": "test_values.test_chapters", "markup_blocks": "test_values.test_markup",
    "paragraph_strategies": "test_values.test_packings_lose_nothing", "careful_sentences": "test_values.test_careful_sentences", "rebuilt_paragraphs": "test_values.test_rebuilding_loses_nothing",
    "staged_scenes": "test_values.test_staging", "plain_blocks": "test_values.test_plain_blocks", "page_boundaries": "test_values.test_boundaries",
    "checked_outputs": "here", "titles": "here", "scene_starts": "here", "rendered_scenes": "test_rendering.test_the_query_over_all_events",
    "engine_documents": "test_engine.test_stages_equal_the_single_operators", "stage_trace": "test_engine.test_stages_equal_the_single_operators",
}


def test_every_query_is_held():
    """A query has SQL, or a test of its values."""
    assert set(registry.queries()) - set(registry.oracle_sql()) == set(HELD)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in text_queries.texts(spark, sf_dir).collect()}


def run(spark, sf_dir, name):
    return registry.queries()[name](spark, sf_dir).collect()


def words(t):
    return [w for w in re.split(r"\s+", re.sub(r"[^a-zA-Z'\s-]", "", t, flags=re.A), flags=re.A) if w]


def trim(t):
    return re.sub(r"^\s+|\s+\Z", "", t, flags=re.A)


def half_up(x, k=1):
    return math.floor(x * 10**k + 0.5) / 10**k


def test_thoughts(spark, sf_dir, texts):
    got = {r.doc_id: r for r in run(spark, sf_dir, "thought_statistics")}
    assert set(got) == set(texts)
    for i, t in texts.items():
        n = len(words(t))
        spoken = len(words(" ".join(re.findall(r'"([^"]*)"', t))))
        thought = sum(len(words(" ".join(re.findall(p, t, flags=re.A)))) for p in (r"(?<!\w)\*([^*]+)\*(?!\w)", r"(?<!\w)_([^_]+)_(?!\w)"))
        share = [math.floor(x / n * 1000 + 0.5) / 10 if n else 0.0 for x in (spoken, thought)]
        assert got[i].thought_percent == share[1]
        assert got[i].action_percent == (max(0.0, min(100.0, half_up(100.0 - share[0] - share[1]))) if n else 0.0)


def test_cleaning_of_extracted_texts(spark, sf_dir):
    raw = {r.doc_id: r.text or "" for r in text_queries._raw(spark, sf_dir).collect()}
    got = {r.doc_id: r for r in run(spark, sf_dir, "extracted_normal")}
    one = re.A
    # a line begins and ends at carriage returns too
    a, z = r"(?:\A|(?<=\n)|(?<=\r)(?!\n))", r"(?=\r|\n|\Z)"
    for i, t in raw.items():
        x = t
        for p, by, flags in ((a + r"\s*\d{1,4}\s*" + z, "", 0), (a + r"\s*page\s+\d+\s*(of\s+\d+)?\s*" + z, "", re.I), (a + r"\s*-\s*\d+\s*-\s*" + z, "", 0), (r"(\w)-\s*\n\s*(\w)", r"\1\2", 0), (a + r"\s*[|§¶©®]\s*" + z, "", 0)):
            x = re.sub(p, by, x, flags=flags | one)
        x = "\n".join(line for line in x.split("\n") if not re.search(r"^(.)\1{2,}\Z", trim(line)))
        x = x.translate({ord(c): '"' for c in "“”„‟″‶"} | {ord(c): "'" for c in "‘’‚‛′‵"} | {ord(c): "—" for c in "–—―"}).replace("…", "...")
        x = re.sub(r"\.{4,}", "...", x)
        x = re.sub("[\u200b-\u200f\ufeff]", "", x)
        for sign, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")):
            x = x.replace(sign, letters)
        x = re.sub(a + r"[ \t]+|[ \t]+" + z, "", re.sub(r"\n{4,}", "\n\n\n", x))
        assert got[i].text == trim(x), i
        m = re.sub(r" {2,}", " ", re.sub(r"-\n", "-", re.sub(r"\s*\n\s*", "\n", trim(t), flags=one)).replace("\n", " "))
        assert got[i].merged == trim(m), i


QUOTED = r'"[^"]+"'


def fragments_of(t):
    """Quotes and what stands between, with kinds."""
    out, at = [], 0
    tidy = lambda x: trim(re.sub(r"\s+", " ", re.sub(r"^[,;:\-\s]+", "", x, flags=re.A), flags=re.A))
    for m in re.finditer(QUOTED, t):
        out += [("narration", tidy(t[at : m.start()])), ("dialogue", trim(re.sub(r"\s+", " ", m.group(), flags=re.A)))]
        at = m.end()
    return [(k, x) for k, x in [*out, ("narration", tidy(t[at:]))] if x]


def test_fragments(spark, sf_dir, texts):
    got = {}
    for r in run(spark, sf_dir, "dialogue_fragments"):
        got.setdefault(r.doc_id, []).append((r.pos, r.kind, r.content, r.speaker))
    for i, t in texts.items():
        assert [(k, c) for _, k, c, _ in sorted(got.get(i, []))] == fragments_of(t), i
    said = {r.doc_id: r.text for r in run(spark, sf_dir, "structured_dialogue")}
    for i in texts:
        assert said[i] == "\n\n".join(f"{s}: {c}" if s is not None else c for _, _, c, s in sorted(got.get(i, []))), i


def test_original_mode(spark, sf_dir, texts):
    got = {r.doc_id: r.text for r in run(spark, sf_dir, "original_mode")}
    bare = lambda x: re.sub(r"\s+", "", x, flags=re.A)
    for i, t in texts.items():
        x = t.replace("\u00a0", " ")
        for p, by in ((r"\r\n|\r", "\n"), (r"[ \t]+", " "), (r"\n +", "\n"), (r" +\n", "\n"), (r"\n{3,}", "\n\n")):
            x = re.sub(p, by, x)
        x = trim(x)
        cut = "\n\n".join(c for _, c in fragments_of(x))
        assert got[i] == (cut if bare(cut) == bare(x) else x), i


def test_tense_formats(spark, sf_dir, texts):
    got = {r.doc_id: r for r in run(spark, sf_dir, "tense_formats")}
    for i, t in texts.items():
        s = [trim(x) for x in re.sub(r"""([.!?]["”']?)\s+""", "\\1\x01", t, flags=re.A).split("\x01")]
        s = [x for x in s if x]
        k = i % 100
        short = lambda x: x if len(x.split()) <= 6 else "\n".join(" ".join(x.split()[j : j + 6]) for j in range(0, len(x.split()), 6))
        want = "\n\n".join(map(short, s)) if k >= 70 else " ".join(s) if k <= 35 else "\n\n".join(s)
        assert re.sub(r"\s+", " ", got[i].text) == re.sub(r"\s+", " ", want), i
        assert got[i].text.count("\n") == want.count("\n"), i
        assert got[i].separated == re.sub(r'(["”])\s+(?=["“])', r"\1" + "\n", t, flags=re.A), i


def test_merged_metadata(spark, sf_dir):
    rows = {}
    for title, author, description, subjects, priority in book_queries._META:
        rows.setdefault(trim(re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", title.lower()))), []).append((priority, title, author, description, subjects))
    got = {r.title_key: r for r in run(spark, sf_dir, "merged_metadata")}
    assert set(got) == set(rows)
    for key, found in rows.items():
        found.sort(key=lambda r: r[0])
        first = lambda n: next((r[n] for r in found if (r[n] or "").strip()), None)  # noqa: B023, E731
        names = []
        for s in (s.strip() for r in found for s in r[4] or []):
            if s and s.lower() not in [x.lower() for x in names]:
                names.append(s)
        r = got[key]
        assert (r.title, r.author, r.sources) == (first(1), first(2), len(found))
        assert r.subjects.split("|") == names or (not names and r.subjects == "")
        assert len(r.description or "") == max((len(x[3] or "") for x in found))


def test_streams(spark, sf_dir):
    tokens = {}
    for r in more_queries._tokens(spark, sf_dir).collect():
        tokens.setdefault(r.session, []).append((r.pos, r.token))
    want = []
    for session, rows in tokens.items():
        held, n = "", 0
        for _, token in sorted(rows):
            held += token
            at = held.rfind("\n\n")
            if len(held) >= 320 and at > 0:
                want.append((session, n, held[:at]))
                held, n = held[at + 2 :], n + 1
        if held.strip():
            want.append((session, n, held))
    assert sorted(map(tuple, run(spark, sf_dir, "flushed_streams"))) == sorted(want)


def test_counts_of_markup(spark, sf_dir):
    got = {r.doc_id: r for r in run(spark, sf_dir, "markup_counts")}
    blocks = {}
    for r in run(spark, sf_dir, "markup_blocks"):
        blocks.setdefault(r.doc_id, []).append(r)
    for i, r in got.items():
        b = blocks[-i]
        assert (r.blocks, r.sfx, r.transitions, r.beats, r.dialogues) == (len(b), sum(x.sfx is not None for x in b), sum(x.transition is not None for x in b), sum(x.beat is not None for x in b), sum(x.type == "dialogue" for x in b))


def test_composed_pipeline(spark, sf_dir, texts):
    got = {r.doc_id: r for r in run(spark, sf_dir, "composed_pipeline")}
    for i, t in texts.items():
        x = trim(re.sub(r" {3,}", "  ", re.sub(r"\t+", " ", re.sub(r"\r\n|\r", "\n", t))))
        paras = [trim(p) for p in re.split(r"\n\s*\n", x, flags=re.A) if trim(p)]
        parts = 0
        for rest in paras:
            while len(rest) > 3500:
                at = rest[:3500].rfind(" ")
                at = at if at >= 1400 else 3500
                rest, parts = trim(rest[at:]), parts + 1
            parts += bool(rest)
        assert (got[i].parts if i in got else 0) == parts, i
        assert i not in got or got[i].lowest <= got[i].highest


def test_detected_tiers(spark, sf_dir, texts):
    got = {r.doc_id: r for r in run(spark, sf_dir, "detected_tiers")}
    headed = {}
    for r in chapters.chapters(text_queries.texts(spark, sf_dir)).filter("title <> 'Full Text'").collect():
        headed.setdefault(r.doc_id, []).append(r.title)
    assert set(got) == set(texts)
    for i, t in texts.items():
        marks = [p for p in re.split(r"\n\s*(?:scene|part)\s+[\divxlcdm]+[:.\- ]", t, flags=re.A | re.I) if p]
        if got[i].tier == "scene_split":
            assert len(marks) >= 2 and got[i].chapters == len(marks)
        elif got[i].tier == "single_chapter_safe_mode":
            assert len(marks) < 2 and got[i].chapters == 1
        else:
            assert got[i].chapters == len(headed[i])


def test_checked_outputs(spark, sf_dir, texts):
    got = {r.doc_id: r for r in run(spark, sf_dir, "checked_outputs")}
    for i, t in texts.items():
        t = trim(t)
        apart = not re.search(r'["“][^"”]+["”]', t) or bool(re.search(r'(^|\n)\s*["“]', t, flags=re.M | re.A))
        r = got[i]
        assert r.dialogue_separated == apart
        issues = [n for n, bad in (("empty", t == ""), ("dialogue", not apart), ("readability", not r.readable)) if bad]
        assert r.issues == ",".join(issues) and r.valid == (not issues)


def test_titles(spark, sf_dir):
    got = {r.doc_id: r.title for r in run(spark, sf_dir, "titles")}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        lines = [trim(x) for x in (r.text or "").split("\n") if trim(x)][:40]
        assert got[r.doc_id] == "Untitled Novel" or any(got[r.doc_id] in re.sub(r"\s+", " ", x) for x in lines)
    assert len(fixtures.BOOKS) and all(got[-b[0]] for b in fixtures.BOOKS)


def test_scene_starts(spark, sf_dir):
    paras = {}
    for r in text_queries.line_texts(spark, sf_dir).collect():
        paras.setdefault(r.doc_id, []).append((r.pos, trim(r.text or "")))
    want = set()
    for i, rows in paras.items():
        rows.sort()
        heads = [t[:80] for pos, t in rows if pos % 3 == 0]
        at = 0
        for head in heads if len(heads) > 1 else []:
            hit = next((k for k in range(at, len(rows)) if head and rows[k][1].startswith(head)), None)
            if hit is not None:
                at = hit + 1
                if hit > 0:
                    want.add((i, rows[hit][0]))
    got = [tuple(r) for r in run(spark, sf_dir, "scene_starts")]
    assert set(got) == want and len(got) == len(want)
