"""Known values of single functions and operators, and a few properties."""

import io
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from narrata.functions import scores, text
from narrata.operators import chapters, dialogue, ingest, markup, metadata, pacing, packing, passages, reader, requests, scenes, vectors
from narrata.sources import books, files, positioned


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize("word, n", [("cat", 1), ("the", 1), ("run", 1), ("cake", 1), ("make", 1), ("beautiful", 3), ("computer", 3), ("information", 4), ("", 1)])
def test_syllables(spark, word, n):
    assert one(spark, scores.syllables("w"), w=word) == n


def test_tokens(spark):
    assert one(spark, text.sentences("t"), t="Hello world. How are you. Fine thanks.") == ["Hello world", "How are you", "Fine thanks"]
    assert one(spark, text.words("t"), t="hello, world! test.") == ["hello", "world", "test"]
    assert one(spark, text.sentences_kept("t"), t='He ran. "Go!" she said.') == ["He ran.", '"Go!"', "she said."]


@pytest.mark.parametrize("score, label", [(95, "very_easy"), (85, "easy"), (75, "fairly_easy"), (65, "standard"), (55, "fairly_difficult"), (35, "difficult"), (15, "very_difficult")])
def test_difficulty(spark, score, label):
    assert one(spark, scores.difficulty("s"), s=score) == label


@pytest.mark.parametrize("score, label", [(0.5, "joy"), (0.3, "joy"), (0.15, "surprise"), (0.0, "neutral"), (0.05, "neutral"), (-0.05, "neutral"), (-0.3, "sadness"), (-0.5, "fear"), (-0.15, "anger")])
def test_emotion(spark, score, label):
    assert one(spark, scores.emotion("s"), s=score) == label


def test_sentiment(spark):
    s = lambda t: one(spark, scores.sentiment("t"), t=t)
    assert s("I do not love this").score < s("I love this").score
    assert s("very good").raw_score > s("good").raw_score
    assert (s("").score, s("").emotion) == (0.0, "neutral")


def test_statistics(spark):
    t = "The quick brown fox jumps over the lazy dog. The dog barked loudly. The fox ran away quickly."
    r = passages.text_statistics(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
    assert (r.words, r.sentences) == (18, 3)
    r = passages.text_statistics(spark.createDataFrame([(1, "hello world")], "doc_id long, text string")).first()
    assert (r.characters, r.characters_no_spaces) == (11, 10)


def test_cleaning(spark):
    assert one(spark, text.ocr_normal("t"), t="Hello\0World\aTest") == "HelloWorldTest"
    assert one(spark, text.ocr_normal("t"), t="con-\nnection") == "connection"
    assert one(spark, text.ocr_normal("t"), t="end.......next") == "end...next"
    assert one(spark, text.composed("t"), t="é") == "é"


def scene_ids(spark, paras):
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate(paras)], "doc_id long, pos int, text string")
    return [r.scene for r in scenes.scenes(df).orderBy("pos").collect()]


def test_scenes(spark):
    assert scene_ids(spark, ["The bright day began.", "She walked.", "Hours later, it rained.", "A fire burned."]) == [1, 1, 2, 2]
    assert scene_ids(spark, ["At Rivergate, bells rang.", "In Stonekeep, silence."]) == [1, 2]


def test_chapters(spark):
    body = "One sentence that goes on for a while. " * 20
    df = spark.createDataFrame([(1, f"1. Dawn at the Harbor\n{body}\n2. The Return\n{body}")], "doc_id long, text string")
    assert [r.title for r in chapters.chapters(df).orderBy("chapter").collect()] == ["1 Dawn at the Harbor", "2 The Return"]


def test_markup(spark):
    t = '[SCENE: Gate]\n"Run!" said Mara and left.\n*no*\n[SFX: BOOM]\nCUT TO: yard\nBEAT.\n[REFLECTION]\nwas it? [TENSION: 130]\n[/REFLECTION]\nThe end. [EMOTION: joy]'
    rows = markup.parsed(spark.createDataFrame([(1, t)], "doc_id long, text string")).orderBy("pos").collect()
    assert [r.type for r in rows] == ["title_card", "dialogue", "action", "inner_thought", "sfx", "transition", "beat", "inner_thought", "action"]
    assert (rows[1].speaker, rows[1].intensity, rows[4].sfx_intensity, rows[5].transition, rows[7].tension, rows[8].emotion) == ("MARA", "shout", "loud", "CUT TO", 100, "joy")


def test_pacing(spark):
    schema = "doc_id long, pos int, type string, tension int"
    flat = spark.createDataFrame([(1, i, "action", 50) for i in range(20)], schema)
    assert pacing.flat_zones(flat).count() == 1
    loud = spark.createDataFrame([(1, i, "sfx", 90) for i in range(10)], schema)
    assert [tuple(r) for r in pacing.rushed_zones(loud).collect()] == [(1, 0, 9)]
    assert pacing.pacing(flat).first().rhythm == "erratic"


def test_progress(spark):
    ch = spark.createDataFrame([("b", n, "t", 1000, False) for n in (1, 2, 3)], "book string, number int, title string, word_count long, is_processed boolean")
    pr = spark.createDataFrame([("b", 2, 600, [1], [])], "book string, current int, read_sec long, read_chapters array<int>, bookmarks array<int>")
    sn = spark.createDataFrame([("b", 2, "original", 0.5, 600, 1000)], "book string, chapter int, mode string, scroll double, read_sec int, ts long")
    r = reader.progress_summary(ch, pr, sn).first()
    assert (r.words_read, r.percent, r.words_per_minute, r.minutes_left, r.sessions_today) == (1500, 50, 150, 10, 1)


def test_thinning_depends_on_the_last_kept(spark):
    rows = [("b", 1, "o", 0.5, 1, t) for t in (0, 15_000, 19_000, 21_000, 39_000, 41_500)]
    out = reader.thinned(spark.createDataFrame(rows, "book string, chapter int, mode string, scroll double, read_sec int, ts long"))
    assert sorted(r.ts for r in out.collect()) == [0, 21_000, 41_500]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<double>")
    out = vectors.nearest(v.filter("vec_id = 1"), v, 2).orderBy("rank").collect()
    assert [(r.id, round(r.similarity, 6)) for r in out] == [(3, 0.707107), (2, 0.0)]
    with pytest.raises(Exception, match="widths"):
        one_wide = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
        one_wide.select(vectors.cosine(F.col("a"), F.col("b"))).collect()


def test_vectors_by_cells(spark, monkeypatch):
    """Clusters, ties, copies and vectors without a direction: as all pairs say, with most cells left aside."""
    import random

    rng = random.Random(31)
    spots = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.04) for x in spots[i % 12]]) for i in range(600)] + [(600 + i, [0.0] * 8) for i in range(4)] + [(700 + i, spots[0]) for i in range(6)] + [(None, spots[1]), (800, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    q = v.filter("vec_id % 20 = 0 or vec_id >= 600")
    taken = lambda **more: sorted((r.query, r["rank"], r.id, r.similarity) for r in vectors.nearest(q, v, 3, **more).collect())
    want = taken()
    skipped = []
    assert taken(few=0, skipped=skipped) == want and len(want) == 3 * q.filter("embedding is not null").count()
    there, seen = skipped[0]
    assert seen < there / 3
    # tasks of few rows and queries
    monkeypatch.setattr(vectors, "ROWS", 20)
    monkeypatch.setattr(vectors, "QUERIES", 5)
    assert taken(few=0) == want
    # more asked for than a cell holds, a history without any direction, none at all
    few = v.filter("vec_id < 30")
    assert sorted(map(tuple, vectors.nearest(few, few, 29, few=0).collect())) == sorted(map(tuple, vectors.nearest(few, few, 29).collect()))
    zero = v.filter("vec_id between 600 and 603")
    assert sorted((r.query, r.id) for r in vectors.nearest(zero, zero, 2, few=0).collect()) == [(600, 601), (600, 602), (601, 600), (601, 602), (602, 600), (602, 601), (603, 600), (603, 601)]
    assert vectors.nearest(v.limit(0), v.limit(0), few=0).count() == 0


def test_metadata(spark):
    assert one(spark, F.array_join(metadata.distinct_names(F.col("v")), "|"), v=[" A", "a", "", "B"]) == "A|B"
    assert one(spark, metadata.genre(F.col("v")), v=["Space opera", "Love story"]) == "romance"
    assert one(spark, metadata.story_format(F.col("v")), v=["Manga", "Shonen", "novel"]) == "manga"


def test_gates(spark):
    assert one(spark, ingest.error_code("m"), m="File is too large") == "FILE_TOO_LARGE"
    assert one(spark, ingest.text_gate("m"), m="too short") == "TOO_SHORT"
    assert one(spark, ingest.secure_endpoint("m"), m="https://a.b/c") is True
    assert one(spark, ingest.secure_endpoint("m"), m="http://10.0.0.1/") is False
    assert one(spark, ingest.secure_endpoint("m", local=True), m="http://10.0.0.1/") is True


def test_speakers(spark):
    df = spark.createDataFrame([(1, 'Mara said, "Go now." Then he left. "Why?" asked Tom.')], "doc_id long, text string")
    rows = dialogue.fragments(df).orderBy("pos").collect()
    assert [(r.kind, r.speaker) for r in rows] == [("narration", None), ("dialogue", "Mara"), ("narration", None), ("dialogue", "Tom"), ("narration", None)]


def test_token_buckets(spark):
    rows = [("a", f"r{i}", 0, 1) for i in range(4)]
    out = requests.token_buckets(spark.createDataFrame(rows, "provider string, request string, ts long, tokens int"), rpm=12, tpm=6000)
    assert [r.wait_ms for r in out.orderBy("request").collect()] == [0.0, 0.0, 5000.0, 10000.0]


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_X_", "."), body)
    return out.getvalue()


def test_files(spark, tmp_path):
    ns = 'xmlns:w="http://x/w"'
    (tmp_path / "a.txt").write_text("plain text")
    (tmp_path / "b.docx").write_bytes(zipped(word__document_X_xml=f"<w:d {ns}><w:p><w:t>one</w:t><w:t>two</w:t></w:p><w:p/><w:p><w:t>three</w:t></w:p></w:d>"))
    slides = {f"ppt__slides__slide{n}_X_xml": f'<a:s xmlns:a="http://x/a"><a:t>s{n}</a:t></a:s>' for n in (10, 2)}
    (tmp_path / "c.pptx").write_bytes(zipped(**slides))
    opf = '<package><manifest><item id="i1" href="1.xhtml"/><item id="i2" href="2.xhtml"/></manifest><spine><itemref idref="i2"/><itemref idref="no"/><itemref idref="i1"/></spine></package>'
    page = "<html><body><p>{}</p></body></html>"
    container = '<container><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>'
    epub = io.BytesIO()
    with zipfile.ZipFile(epub, "w") as z:
        for name, body in (("META-INF/container.xml", container), ("o/c.opf", opf), ("o/1.xhtml", page.format("first")), ("o/2.xhtml", page.format("second"))):
            z.writestr(name, body)
    (tmp_path / "d.epub").write_bytes(epub.getvalue())
    (tmp_path / "e.docx").write_bytes(b"not a zip")
    (tmp_path / "f.doc").write_bytes(b"x")
    got = {r.path.rpartition("/")[2]: (r.text, r.error) for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("plain text", None)
    assert got["b.docx"] == ("onetwo\nthree", None)
    assert got["c.pptx"] == ("s2\ns10", None)
    assert got["d.epub"] == ("second\nfirst", None)
    assert got["e.docx"][1].startswith("EXTRACTION_FAILED")
    assert got["f.doc"] == (None, "LEGACY_FORMAT")


def test_boundaries(spark):
    words = "amber birch cedar delta ember fjord grove heath".split()
    body = lambda p: [f"{words[p % 8]} {w} {words[(p * 3 + 1) % 8]} x" * 2 for w in words]
    rows = [(1, p, "\n".join([f"Title {p}", *body(p), "Foot", str(p)])) for p in range(8)]
    out = {r.page: r.text for r in positioned.without_boundaries(spark.createDataFrame(rows, "doc_id long, page int, text string")).collect()}
    assert out == {p: "\n".join(body(p)) for p in range(8)}
    few = spark.createDataFrame([(2, 1, "only\npage"), (2, 2, "12\n---\ntext\n-"), (2, 3, "")], "doc_id long, page int, text string")
    assert {r.page: r.text for r in positioned.without_boundaries(few).collect()} == {1: "only\npage", 2: "text", 3: ""}


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "book string, n int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "book string, n int")
    assert sorted(map(tuple, books.upserted(old, new, "book").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, books.deleted(old, new, "book").collect())) == [("a", 1)]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(t=st.text(alphabet="ab. !?\n\"", max_size=60))
def test_packings_lose_nothing(spark, t):
    df = spark.createDataFrame([(1, t)], "doc_id long, text string")
    bare = lambda x: "".join(x.split())
    assert bare("".join(r.text for r in packing.pages(df, 10, 3).orderBy("page", "line").collect())) == bare(t)
    assert bare("".join(r.text for r in packing.line_chunks(df, 12).orderBy("chunk").collect())) == bare(t)


def test_careful_sentences(spark):
    s = lambda t: one(spark, text.sentences_careful("t"), t=t)
    assert s("Dr. Reed paid 3.50 for it... then he left. Mr. Fox came in at noon.") == ["Dr. Reed paid 3.50 for it... then he left.", "Mr. Fox came in at noon."]
    assert s('He said "Go!" Then J. Smith ran. It cost 3. 5 more came.') == ['He said "Go!"', "Then J. Smith ran.", "It cost 3. 5 more came."]
    assert s("") == [] and s("What?! No.") == ["What?!", "No."]


def test_staging(spark):
    from narrata.operators import staging

    t = 'The old mill stood by the river. She wondered what it held inside.\n\nSuddenly a gunshot! "Run!" he cried. The door slammed. Blood and panic. They fight now!'
    rows = staging.staged(spark.createDataFrame([(1, t), (2, "")], "doc_id long, text string")).orderBy("scene").collect()
    assert [r.scene for r in rows] == [1, 2] and rows[0].transition is None and rows[1].transition == "SMASH CUT"
    assert "[REFLECTION]" in rows[0].text and "[TENSION]" in rows[1].text and "[SFX: gunshot]" in rows[1].text
    bare = lambda x: "".join(x.split())
    kept = bare("".join(line for r in rows for line in r.text.split("\n") if not line.startswith("[")))
    assert kept == bare(t)
    parsed = markup.parsed(spark.createDataFrame([(1, rows[1].text)], "doc_id long, text string")).collect()
    assert {"transition", "title_card", "sfx", "action"} <= {r.type for r in parsed}


def test_rebuilding_loses_nothing(spark):
    from narrata.operators import staging

    t = "THE HEADING\n\nA line that is bro-\nken here.\nAnother one. And more. Yet more. Still more. \"Speech,\" he said.\n\nshort\nverse\nlines"
    out = staging.rebuilt_texts(spark.createDataFrame([(1, t), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    bare = lambda x: "".join(x.split())
    assert bare(out[0].text) == bare(t) and out[0].text.startswith("THE HEADING\n\n") and out[1].text == ""


def test_plain_blocks(spark):
    from narrata.operators import plain

    t = 'Chapter 1\n\nMara walked to the gate. A door closed.\n\n"Who is there?" said Tom.\n\nMara, pale, said nothing. "Go!"\n\n*I must run*\n\nHe wondered why.\n\nTHE END\n\nSuddenly nothing was left.'
    rows = plain.plain_blocks(spark.createDataFrame([(1, t), (2, None)], "doc_id long, text string")).orderBy("pos").collect()
    kinds = [(r.type, r.speaker) for r in rows]
    assert ("dialogue", "TOM") in kinds and ("dialogue", "MARA") in kinds
    assert [r.content for r in rows if r.type == "inner_thought"] == ["I must run", "He wondered why."]
    assert ("SFX: DOOR", "medium") in [(r.content, r.sfx_intensity) for r in rows]
    assert {"CHAPTER 1", "THE END"} <= {r.content for r in rows if r.type == "title_card"}
    assert [r.transition for r in rows if r.type == "transition"] == ["FADE IN", "FADE IN", "CUT TO"]
