"""What keeps the work of text queries in proportion to the text: fewer passes with the same results, no text through joins."""

import math
import re

import pytest
from pyspark.sql import functions as F

from narrata.functions import scores, text
from narrata.operators import dialogue, packing, scenes
from narrata.plans import registry, text_queries

ODD = ["".join(map(chr, range(1, 256))) + "Kİﬁﬀ​ x y don't co-op e1x", "a\x00b c", "", "The freed agreed; wanted tabled ye ed e the -- ' rhythm queue banane\tabided 7eyed!"]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_letters_and_syllables(spark):
    t = spark.createDataFrame([(x,) for x in ODD], "t string")
    each = F.aggregate(F.transform(text.words("t"), scores.syllables), F.lit(0), lambda a, x: a + x)
    for row in t.select("t", text.letters("t").alias("l"), each.alias("each"), (F.size(text.words("t")) + scores.syllables_in(text.letters("t"))).alias("all")).collect():
        assert row["l"] == re.sub(r"[^a-zA-Z' \t\n\x0b\f\r-]", "", row["t"])
        assert row["each"] == row["all"]


def test_found_is_the_regex(spark):
    tables = [p for p, _ in dialogue.SFX + dialogue.AMBIENCE] + [scenes.L + p + scenes.R for p in (scenes.TIME_SHIFT, scenes.TRANSITION, scenes.FLASHBACK, scenes.DREAM, scenes.MEMORY, *scenes.MOODS.values())] + [scenes.BREAK_SIGNALS[4:]]
    bare = [p.replace(scenes.L, "").replace(scenes.R, "") for p in tables]
    held = [re.sub(r"[()?:\\]", "", w) for p in bare for w in text.ways(p)]
    t = spark.createDataFrame([(x,) for w in held + ["a   b", "x....", "###", "THAT Night", "weeKs later", "none", "Slammed", "sirens"] for x in (w, f"A {w.upper()}.", f"x{w}x")], "t string")
    differ = [F.count_if(text.found("t", b, p) != F.regexp_like("t", F.lit(f"(?i){p}"))) for b, p in zip(bare, tables)]
    assert not any(t.agg(*[d.alias(f"c{i}") for i, d in enumerate(differ)]).first())
    # most texts are done without the regex
    assert "Contains" in plan(t.select(text.found("t", bare[0], tables[0])))


@pytest.mark.parametrize("name", ["cues", "checked_outputs", "scene_analysis"])
def test_texts_are_joined_to_nothing(spark, sf_dir, name):
    assert "Join" not in plan(registry.queries()[name](spark, sf_dir))


def test_wrapping_is_the_fold(spark):
    t = spark.createDataFrame([("",), (" a  bb\tccc dddd eeeee  ",), ("x" * 12 + " y " + "z" * 6 + " 𝄞𝄞𝄞 é",), ("ab cd ef gh ij kl",)], "t string")
    for width in (1, 2, 5, 6, 8):
        words = F.filter(F.split("t", r"\s+"), lambda w: w != "")
        folded = packing.packed(words, F.length, lambda n, total, s: total + n + s <= width, " ")
        assert t.filter(folded != packing.wrapped("t", width)).count() == 0
    assert "aggregate" not in plan(t.select(packing.wrapped("t", 90)))


def test_tasks_grow_in_number(spark, sf_dir, monkeypatch):
    few = text_queries.documents(spark, sf_dir).rdd.getNumPartitions()
    monkeypatch.setattr(text_queries, "TASK_BYTES", 1 << 12)
    assert text_queries.documents(spark, sf_dir).rdd.getNumPartitions() > 2 * few


def test_pdf_maps_are_not_spelled_out():
    import io

    from narrata.sources import pdf

    out = io.BytesIO()
    made = pdf.Document(out.write)
    for _ in range(2):
        made.page(["жяк 中 (a\\b)", "plain"])
    made.close()
    file = pdf.Pdf(out.getvalue())
    pages = list(file.pages())
    shown = [[t[0] for t in pdf._tokens(file, file.get(p["Contents"], True)[1], file.get(p["Resources"]))] for p in pages]
    assert shown == [["жяк 中 (a\\b)", "plain"]] * 2
    # one font an object, for all pages; of its 65,536 codes those that were shown
    wide = [f for _, f in file.fonts.values() if f.wide]
    assert len(file.fonts) == 2 and len(wide) == 1 and len(wide[0].known) < 20


def test_words_are_not_shuffled(spark, sf_dir):
    """Texts are dealt once; neither the words of a text nor their counts go over the network."""
    df = registry.queries()["top_words"](spark, sf_dir)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(re.findall(r"\bExchange ", final)) == 1


def test_units_are_taken_once(spark, sf_dir):
    optimized = plan(registry.queries()["text_hashes"](spark, sf_dir))
    # of documents and of the fixture: once for the whole text, once for the first 512 characters
    assert optimized.count("regexp_extract_all(") == 2 * 2


def test_lines_are_found_without_a_fold_over_all_tokens(spark):
    """Tall stretches, ties, unknown places: as by a loop over a page. Only tall stretches are folded, and no order is compared by a lambda."""
    import random

    from narrata.sources import positioned

    some = random.Random(7)
    rows = [(d, p, some.choice(["a", " b\tc ", ",", "d", "  ", None]), some.choice([0.0, 1.0, 2.5, None]), some.choice([some.uniform(0, 30), 10.0, 13.0, 16.0, 16.1, None])) for d in range(12) for p in range(3) for _ in range(3 * d)]
    df = spark.createDataFrame(rows, "doc_id long, page int, text string, x double, y double")
    want = []
    for key in {r[:2] for r in rows}:
        low = lambda v: (v is not None, v or 0.0)
        tokens = sorted((low(None if y is None else -y), low(x), re.sub(r"\s+", " ", t).strip()) for d, p, t, x, y in rows if (d, p) == key and (t or "").strip())
        lines, at = [], None
        for up, x, t in tokens:
            if at is None or not up[0] or abs(up[1] - at) > positioned.TOLERANCE:
                lines.append([])
                at = up[1] if up[0] else None
            lines[-1].append((x, up, t))
        want += [(*key, i, re.sub(r"\s+([,.;!?])", r"\1", " ".join(t for *_, t in sorted(words))).strip()) for i, words in enumerate(lines)]
    made = positioned.reading_order(df)
    assert sorted(map(tuple, made.collect())) == sorted(want)
    assert "array_sort" not in plan(made) and "lambdafunction(if" not in plan(made)


def test_markup_lines_are_asked_for_their_beginnings(spark):
    from narrata.operators import markup

    lines = ["sfx: a door", "He ran Sfx: thud", "he ran [sfx: Boom]", "fade to black: night", "Cut to the house", "silence.", "[reflection]", "a [EMOTION: joy] b", "[/reflection]", "(WIDE SHOT: hall)", "He ROARED", "so…", "end —", "*thought*", '"Hi!" said Mara softly', "--- ", "— ✦ —", "[Scene: One]", "beaten"]
    made = markup.parsed(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string"))
    got = [(r.type, r.content, r.intensity) for r in made.orderBy("pos").collect()]
    assert got == [
        ("sfx", "SFX: a door", "emphasis"), ("action", "He ran", "normal"), ("sfx", "SFX: thud", "emphasis"), ("action", "he ran", "normal"), ("sfx", "SFX: Boom", "emphasis"),
        # of two that begin alike the first named is met
        ("transition", "night", "normal"), ("transition", "the house", "normal"), ("beat", "", "normal"), ("inner_thought", "a  b", "whisper"), ("action", "hall", "normal"), ("action", "He ROARED", "shout"),
        ("action", "so…", "whisper"), ("action", "end —", "whisper"), ("inner_thought", "thought", "whisper"), ("dialogue", "Hi!", "whisper"), ("action", "said Mara softly", "normal"),
        ("beat", "— ✦ —", "normal"), ("beat", "— ✦ —", "normal"), ("title_card", "One", "normal"), ("action", "beaten", "normal"),
    ]
    assert plan(made).count("StartsWith(") >= 10 and plan(made).count("Contains(") >= 6


def test_a_vector_goes_to_many_cells_at_once(spark, monkeypatch):
    """A query's vector is sent once to a part of cells with as many rows as meet in a task, however many of its cells it looks into; all are compared as before."""
    import numpy as np

    from narrata.operators import vectors

    some = np.random.default_rng(3).normal(size=(900, 12)).astype("float32")
    some[5] = some[17] = 0
    some[30] = some[31]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(some)], "vec_id long, embedding array<float>")
    met, sent = vectors._met, []

    def seen(pairs, placed, k):
        sent.append((pairs.count(), placed.select("part").distinct().count(), dict(placed.dtypes)["v"]))
        return met(pairs, placed, k)

    monkeypatch.setattr(vectors, "_met", seen)
    monkeypatch.setattr(vectors, "ROWS", 300)
    monkeypatch.setattr(vectors, "QUERIES", 20)
    looked = []
    queries = df.filter("vec_id % 9 = 0")
    rows = lambda few: sorted((r.query, r.rank, r.id, r.similarity) for r in vectors.nearest(queries, df, 3, skipped=looked, few=few).collect())
    cells, pairs = rows(0), rows(vectors.FEW)
    assert [r[:3] for r in cells] == [r[:3] for r in pairs] and all(abs(a[3] - b[3]) < 1e-12 for a, b in zip(cells, pairs))
    assert len(sent) == 2 and all(n <= 100 * parts and parts <= 8 and kind == "array<float>" for n, parts, kind in sent)
    # far more pairs of a query and a cell than vectors sent
    assert looked[0][1] > 2 * sum(n for n, *_ in sent)


def shuffled(df) -> set[str]:
    """The columns that exchanges of a plan hand on."""
    nodes, out = [df._jdf.queryExecution().executedPlan()], set()
    while nodes:
        node = nodes.pop()
        if "Adaptive" in node.nodeName():
            nodes.append(node.initialPlan())
        if node.nodeName() == "Exchange":
            out |= set(re.findall(r"(\w+)#", node.output().mkString(" ")))
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_statistics_shuffle_no_text(spark):
    """Fragments are numbered where they are found, paragraphs measured and their cues found where they are read."""
    from narrata.operators import documents

    paras = spark.createDataFrame([(1, 0, 'Tom said, "Come."')], "doc_id long, pos int, text string")
    assert shuffled(dialogue.fragments(paras)) == shuffled(documents.typed_fragments(paras)) == set()
    found = scenes.scenes(paras)
    assert {"_place", "_mode"} <= shuffled(found) and "text" not in shuffled(found)
    whole = shuffled(documents.document_statistics(paras, found))
    assert "_who" in whole and not whole & {"text", "content", "_f"}


def test_statistics_are_those_of_the_fragments(spark):
    import random

    from narrata.operators import documents

    some = random.Random(11)
    bits = ['"Go  on,"', " said Tom Reed. ", " he asked ,", "She nodded to him", "\t--- ", '"', '" "', " They  walked on; ", "Mara replied: ", '"Who?"', "\n", "é,", " I whispered "]
    rows = [(d, p, None if p == 5 else "".join(some.choice(bits) for _ in range(some.randrange(9)))) for d in range(9) for p in range(2 + d)] + [(77, 0, None), (78, 0, " ,; ")]
    paras = spark.createDataFrame(rows, "doc_id long, pos int, text string")
    each = documents.typed_fragments(paras.select(F.struct("doc_id", "pos").alias("at"), "text"), "at").collect()
    assert {r.kind for r in each} == {"dialogue", "narration", "action_beat"} and len({r.speaker for r in each}) > 3
    got = {r.doc_id: r for r in documents.document_statistics(paras, scenes.scenes(paras)).collect()}
    assert set(got) == {r[0] for r in rows}
    for d, r in got.items():
        of = [x for x in each if x["at"].doc_id == d]
        kinds = [x.kind for x in of]
        assert (r.dialogue_fragments, r.narration_fragments) == (kinds.count("dialogue"), kinds.count("narration"))
        assert r.speakers == ",".join(sorted({x.speaker for x in of if x.speaker is not None}))
        assert r.dialogue_ratio == int(kinds.count("dialogue") / max(1, len(kinds)) * 1000 + 0.5) / 1000


def test_hints_miss_nothing(spark):
    """What the hints say no to, the regexes find nothing in; they are taken in one pass, by Arrow."""
    import pyarrow as pa

    from narrata.functions.lexicon import INTENSIFIERS, LEXICON, NEGATIONS

    signals, cued = scenes.BREAK_SIGNALS[4:], [scenes.TIME_SHIFT, scenes.TRANSITION, scenes.FLASHBACK, scenes.DREAM, scenes.MEMORY]
    held = scenes.CUES.split("|")
    texts = [x for w in held + ["***", "---", "###", "....", " \t ", "======", "~_*"] for x in (w, f"Ab {w.upper()}.", f"x{w}x", f"é{w}", f"a {w[1:]} b", f"a {w[:-1]}")]
    texts += [f"{a}{p}{b}{q}Old Mill" for p in ("in", "At", "on", "near", "Beside", "inside", "outside", "beneath", "Above", "across", "Back at", "beyond", "up") for a in ("", "x ") for b in (" ", " \x0b ") for q in ("", "the ", "the\n")]
    texts += [x for w in [*LEXICON, *NEGATIONS, *INTENSIFIERS] for x in (w, f"a {w.title()}ing.", f"({w[:2]}é{w[2:]}9)\x0bx", f"{w}x")] + ["f\u0130ght", "li\u212Ae", "\u017fad", "nothing here", "notion"]
    mood = scores.sentiment("t")["hits"] > 0
    counts = F.regexp_like("t", F.lit(f"(?i){'|'.join(cued)}|{signals}")) | F.regexp_like("t", F.lit(scenes.DIVIDER))
    plainly = F.lower(text.trimmed(F.coalesce(scenes.first("t", scenes.L + scenes.PLACE_SHIFT), scenes.first("t", scenes.L + scenes.PLACE))))
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", counts.alias("cued"), plainly.isNotNull().alias("placed"), mood.alias("telling"), plainly.eqNullSafe(scenes.place_hint("t")).alias("same")).collect()
    hints = scenes.hinted()(pa.array([r.t for r in rows])).to_pylist()
    for name in ("cued", "placed", "telling"):
        assert not [r.t for r, h in zip(rows, hints) if r[name] and not h[name]]
        assert sum(r[name] for r in rows) > 100 and sum(not h[name] for h in hints) > 100
    assert all(r.same for r in rows)
    odd = scenes.hinted()(pa.array([b"de\xffath", b"\xc3later"]).cast(pa.string(), safe=False)).to_pylist()
    assert odd[0]["telling"] and odd[1]["cued"]
    found = scenes._signals(spark.createDataFrame([(1, 0, "x")], "doc_id long, pos int, text string"), "doc_id")
    assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()


def test_scenes_of_odd_lines(spark):
    """White space around a paragraph is no break; empty ones and null are no paragraphs."""
    lines = ["  One. ", None, " \t ", "Two.", "   Three.", "\t*** ", "Four.", "Five   six.", "Seven.", " They f\u0130ght in  Rivergate", "In Rivergate", "At the Mill", "later"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, pos int, text string")
    assert [(r.pos, r.scene) for r in scenes.scenes(df).orderBy("pos").collect()] == [(0, 1), (3, 1), (4, 1), (6, 2), (7, 3), (8, 3), (9, 3), (10, 3), (11, 4), (12, 5)]


def test_telling_words_by_a_loop(spark):
    """Words that tell nothing are made full stops before the fold; those around them keep their places."""
    import random

    from narrata.functions.lexicon import INTENSIFIERS, LEXICON, NEGATIONS, SUFFIXES

    some = random.Random(5)
    words = [*NEGATIONS, *INTENSIFIERS] * 2 + some.sample(sorted(LEXICON), 40) + [some.choice(sorted(LEXICON)) + some.choice(SUFFIXES) for _ in range(40)] + ["notion", "table", "the", "x", "-", "'", "nothe", "joyx"] * 8
    texts = [some.choice(["", " ", "\n"]) + "".join(some.choice(words).title() + some.choice([" ", "  ", ", ", "\t", ".\n", " é "]) for _ in range(some.randrange(14))) for _ in range(300)] + ["notion", "the table"]

    def looped(t):
        tokens, neg, chain, by, raw, hits = re.sub(r"[^a-z'\s-]", "", t.lower()).split(), -9, -9, 10, 0, 0
        for i, w in enumerate(tokens):
            stem = re.sub(f"(?:{'|'.join(SUFFIXES)})$", "", w)
            score = LEXICON.get(w, LEXICON.get(stem) if len(stem) >= 3 else None)
            carried = by if chain == i - 1 else 10
            if w in NEGATIONS:
                neg, chain, by = i, i, carried
            elif w in INTENSIFIERS:
                chain, by = i, round(INTENSIFIERS[w] * 10)
            else:
                if score is not None:
                    raw, hits = raw + score * carried * (-3 if i - neg <= 2 else 4), hits + 1
                chain, by = -9, 10
        return hits, raw / 40

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scores.sentiment("t").alias("s"), F.transform(F.array("t"), scores.sentiment)[0].alias("inner")).collect()
    for r in rows:
        hits, raw = looped(r.t)
        assert (r.s.hits, r.s.raw_score) == (hits, math.floor(raw * 100 + 0.5) / 100) and r.inner == r.s
    assert sum(r.s.hits for r in rows) > 300
    # a group is a place that every search clears
    assert scores.TELLING.count("(") < 1000


def test_trimming(spark):
    for x in ["", " ", "\t\n ", "x", " x", "x ", "  a  b \x0b\f\r\n", "\n\na\n", " é "]:
        assert spark.createDataFrame([(x,)], "t string").select(text.trimmed("t")).first()[0] == x.strip(" \t\n\x0b\f\r")
