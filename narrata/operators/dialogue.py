"""Dialogue and drama: fragments with speakers, tension, cues, checks of finished scenes, kinds of lines, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import cases, sentiment
from ..functions.text import c, clamp, found, let, lines, spaces_normal, trimmed, whole
from .passages import readability
from .scenes import L, R

# Patterns and labels: fixed values.
QUOTED = r'"[^"\n]+"'
VERBS = "said|asked|replied|whispered|shouted|muttered|cried|yelled|called|answered|snapped|growled|sighed|added|remarked|told"
NAME = r"[A-Z][A-Za-z'\-]*(?:\s+[A-Z][A-Za-z'\-]*){0,2}|he|she|they|we|i"
TENSION_CUES = "(suddenly|danger|threat|panic|fear|dread|blood|scream|gun|knife|fight|attack|urgent|run|now)"
SFX = ((rf"{L}gunshot|shot{R}", "gunshot"), (rf"{L}thunder{R}", "thunder"), (rf"{L}explosion|blast{R}", "explosion"), (rf"{L}crash|shatter(?:ed|ing)?{R}", "crash"), (rf"{L}slam(?:med|ming)?{R}", "door slam"), (rf"{L}footsteps?{R}", "footsteps"), (rf"{L}siren(?:s)?{R}", "siren"), (rf"{L}wind{R}", "wind"), (rf"{L}creak(?:ed|ing)?{R}", "creak"))
AMBIENCE = ((rf"{L}rain|drizzle|storm{R}", "rain"), (rf"{L}wind|gust{R}", "wind"), (rf"{L}thunder{R}", "thunder"), (rf"{L}forest|woods|trees{R}", "forest"), (rf"{L}city|street|traffic|crowd{R}", "city"), (rf"{L}silence|silent|quiet{R}", "silence"), (rf"{L}ocean|sea|waves{R}", "ocean"), (rf"{L}fire|flame|embers{R}", "fire"))
DIALOGUE_LINE = r"^\s*(?:[\"“']|[A-Z][A-Za-z]+:\s)"


def speaker(before: Column, after: Column) -> Column:
    """Who speaks, from 180 characters on both sides of a quote: name and verb or verb and name, before then after."""
    b, a = F.substring(before, -180, 180), F.substring(after, 1, 180)
    tries = [
        F.regexp_extract(b, rf"(?i)({NAME})\s+(?:{VERBS})[\s,;:!?-]*\z", 1),
        F.regexp_extract(b, rf"(?i)(?:{VERBS})\s+({NAME})[\s,;:!?-]*\z", 1),
        F.regexp_extract(a, rf"(?i)^[,;:\s-]*({NAME})\s+(?:{VERBS}){R}", 1),
        F.regexp_extract(a, rf"(?i)^[,;:\s-]*(?:{VERBS})\s+({NAME}){R}", 1),
    ]
    who = trimmed(F.coalesce(*[F.nullif(t, F.lit("")) for t in tries]))
    low = F.lower(who)
    return F.when(low == "i", "I").when(low.isin("he", "she", "they", "we"), low).otherwise(who)


def fragments_of(text) -> Column:
    """array<struct<kind, content, speaker>>: quotes and what stands between them, in order. Quotes are straight ones."""
    t = F.coalesce(c(text), F.lit(""))
    none = F.lit(None).cast("string")
    # runs of white space but single spaces, which most are
    even = lambda x: F.trim(F.regexp_replace(x, r"\s(?:\s+|(?<! ))", " "))
    told = lambda x: F.struct(F.lit("narration").alias("kind"), even(F.regexp_replace(x, r"^[,;:\-\s]+", "")).alias("content"), none.alias("speaker"))
    said = lambda x, who: F.struct(F.lit("dialogue").alias("kind"), even(x).alias("content"), who.alias("speaker"))

    # what stands around the quote at i, as far as a speaker is looked for
    def parts_of(g: Column, q: Column) -> Column:
        before = lambda x, i: F.right(F.concat(F.when(i > 0, F.get(q, i - 1)).otherwise(""), x), F.lit(180))
        after = lambda i: F.left(F.concat(F.coalesce(F.get(g, i + 1), F.lit("")), F.coalesce(F.get(q, i + 1), F.lit(""))), F.lit(180))
        spoken = lambda x, i: let(F.struct(before(x, i).alias("b"), after(i).alias("a")), lambda s: speaker(s["b"], s["a"]))
        return F.flatten(F.transform(g, lambda x, i: F.when(i < F.size(q), F.array(told(x), said(F.get(q, i), spoken(x, i)))).otherwise(F.array(told(x)))))

    gaps, quotes = F.split(t, QUOTED, -1), F.regexp_extract_all(t, F.lit(f"({QUOTED})"), F.lit(1))
    parts = F.when(F.contains(t, F.lit('"')), let(gaps, lambda g: let(quotes, lambda q: parts_of(g, q)))).otherwise(F.array(told(t)))
    return F.filter(parts, lambda f: f["content"] != "")


def fragments(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, kind, content, speaker): the fragments of each text; no row is shuffled for their numbers."""
    return df.select(key, F.posexplode(fragments_of(text)).alias("pos", "f")).select(key, "pos", "f.*")


def structured(df: DataFrame, key: str = "doc_id", text: str = "text", label: bool = True) -> DataFrame:
    """(key, text): every quote and narration on its own, quotes with their speakers if asked for."""
    f = fragments(df, key, text)
    line = F.when(F.col("speaker").isNotNull(), F.concat_ws(": ", "speaker", "content")).otherwise(F.col("content")) if label else F.col("content")
    out = f.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("text"))
    return df.select(key).join(out, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))


def labelled(t, table) -> Column:
    """The label of the first pattern that a text holds, or null."""
    return let(F.lower(c(t)), lambda low: cases([(found(t, p.replace(L, "").replace(R, ""), p, low), name) for p, name in table], None))


def tension(t, short_lines, score) -> Column:
    """Cue words, exclamations, strength of feeling and short lines, 0 to 100."""
    cues = F.regexp_count(c(t), F.lit(f"(?i){L}{TENSION_CUES}{R}"))
    return whole(clamp(cues * 14 + F.regexp_count(c(t), F.lit("!")) * 4 + F.abs(score) * 35 + short_lines * 3, 0, 100)).cast("long")


def analysis(df: DataFrame, key: str = "doc_id", text: str = "text", keep=()) -> DataFrame:
    """Words, sentences, lines of dialogue, short lines, reading ease, tension and charge of scenes, beside the columns to keep."""
    t = F.coalesce(F.col(text), F.lit(""))
    full = F.filter(F.transform(lines(t), trimmed), lambda x: x != "")
    n = lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    base = df.select(key, *keep, t.alias("_t"), full.alias("_l"), sentiment(t).alias("_s"))
    base = base.select(
        key,
        *keep,
        "_t",
        F.size("_l").cast("long").alias("lines"),
        F.size(F.filter("_l", lambda x: F.regexp_like(x, F.lit(DIALOGUE_LINE)))).cast("long").alias("dialogue_lines"),
        F.size(F.filter("_l", lambda x: n(x) <= 6)).cast("long").alias("short_lines"),
        F.abs("_s.score").alias("charge"),
    )
    # one scan: the measures of readability are taken beside these, not joined to them
    out = readability(base, key, "_t", [*keep, "_t", "lines", "dialogue_lines", "short_lines", "charge"])
    return out.select(
        key, *keep, "words", "sentences", "dialogue_lines", "short_lines", "reading_ease", tension("_t", F.col("short_lines"), F.col("charge")).alias("tension"), "charge",
        F.when(F.col("lines") > 0, F.col("dialogue_lines") / F.col("lines")).otherwise(0.0).alias("dialogue_ratio"),
    )


def camera_cue(tension_score, dialogue_ratio, reading_ease) -> Column:
    t = c(tension_score)
    return cases([(t >= 75, "HANDHELD CLOSE"), (c(dialogue_ratio) >= 0.45, "OVER THE SHOULDER"), (c(reading_ease) < 45, "PUSH IN"), (t <= 25, "WIDE ESTABLISHING")], "MEDIUM TRACKING")


def transition_cues(scenes: DataFrame, key: str = "doc_id", pos: str = "scene") -> DataFrame:
    """Adds ``transition`` to analysed scenes: how each is entered from the one before."""
    at = Window.partitionBy(key).orderBy(pos)
    change, charge = F.col("tension") - F.lag("tension").over(at), F.abs(F.col("charge") - F.lag("charge").over(at))
    rows = scenes.withColumn("_d", change).withColumn("_c", charge)
    return rows.withColumn("transition", F.when(F.col("_d").isNotNull(), cases([(F.col("_d") >= 18, "SMASH CUT"), (F.col("_d") <= -24, "FADE TO BLACK"), (F.col("_c") >= 0.35, "DISSOLVE TO")], "CUT TO"))).drop("_d", "_c")


def checked(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, dialogue_separated, readable, tense, short_lines, issues, valid) of finished texts."""
    t = trimmed(F.coalesce(F.col(text), F.lit("")))
    marks = df.select(key, text, (t == "").alias("_empty"), (~F.regexp_like(t, F.lit(r'["“][^"”]+["”]')) | F.regexp_like(t, F.lit(r'(?m)(^|\n)\s*["“]'))).alias("dialogue_separated"))
    rows = analysis(marks, key, text, ["_empty", "dialogue_separated"]).withColumn("readable", (F.col("sentences") == 0) | (F.col("reading_ease") >= 40))
    issues = F.array_compact(F.array(F.when(F.col("_empty"), "empty"), F.when(~F.col("dialogue_separated"), "dialogue"), F.when(~F.col("readable"), "readability")))
    return rows.select(key, "dialogue_separated", "readable", (F.col("tension") >= 35).alias("tense"), (F.col("short_lines") > 0).alias("short_lines"), F.array_join(issues, ",").alias("issues"), (F.size(issues) == 0).alias("valid"))


def is_dramatic(s) -> Column:
    """Up to five words, an exclamation or question, a cue word, or all in capitals."""
    t = trimmed(s)
    n = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    return (t != "") & ((n <= 5) | F.regexp_like(t, F.lit(r"[!?]\z")) | F.regexp_like(t, F.lit(f"(?i){L}{TENSION_CUES}{R}")) | F.regexp_like(t, F.lit(r"^[A-Z][A-Z\s,'\".!?-]+\z")))


def is_capitals(line) -> Column:
    """A heading in capitals, of 2 to 120 characters with two letters at least."""
    t = trimmed(line)
    return F.length(t).between(2, 120) & (F.regexp_count(t, F.lit("[A-Z]")) >= 2) & F.regexp_like(t, F.lit(r"^[A-Z][A-Z\d\s:.,!?'-]+\z"))


def is_roman(line) -> Column:
    t = trimmed(line)
    return (t != "") & F.regexp_like(t, F.lit(r"^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})\z"))


def is_verse(block) -> Column:
    """Two lines or more, most of them short and half of them without an end mark."""
    full = F.filter(F.transform(F.split(c(block), "\n"), trimmed), lambda x: x != "")
    n = F.size(full)
    return (n >= 2) & (F.size(F.filter(full, lambda x: F.length(x) <= 60)) >= n * 0.75) & (F.size(F.filter(full, lambda x: ~F.regexp_like(x, F.lit(r"[.!?]\z")))) >= n * 0.5)


def tense_format(t, tension_score) -> Column:
    """High tension: lines of six words. Low: the sentences joined. Else a sentence a paragraph. Nothing is lost."""
    from .packing import short_lines

    s = F.filter(F.transform(F.split(c(t), r"(?<=[.!?][\"”']?)\s+"), trimmed), lambda x: x != "")
    k = c(tension_score)
    return let(s, lambda x: cases([(k >= 70, F.array_join(F.transform(x, lambda y: short_lines(y)), "\n\n")), (k <= 35, F.array_join(x, " "))], F.array_join(x, "\n\n")))


def separated(t) -> Column:
    """Quotes that follow each other on lines of their own."""
    return F.regexp_replace(c(t), r'(["”])\s+(?=["“])', "$1\n")


def original(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): normal spaces, quotes on lines of their own where no text is lost by it."""
    base = df.select(key, spaces_normal(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    cut = structured(base.select(key, F.col("_t").alias("text")), key, label=False).withColumnRenamed("text", "_s")
    bare = lambda x: F.regexp_replace(x, r"\s+", "")
    return base.join(cut, key).select(key, F.when(bare("_s") == bare("_t"), F.col("_s")).otherwise(F.col("_t")).alias("text"))


def title_candidates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line, score) of the first forty lines that may be a title."""
    full = F.slice(F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), trimmed), lambda x: x != ""), 1, 40)
    rows = df.select(key, F.posexplode(full).alias("pos", "raw"))
    mark = F.regexp_extract("raw", r"^#{1,2}\s+(.+)\z", 1)
    clean = lambda x: trimmed(F.regexp_replace(F.regexp_replace(x, r"^[\s\"'“”‘’\[\](){}]+|[\s\"'“”‘’\[\](){}]+\z", ""), r"\s+", " "))
    rows = rows.withColumn("line", clean(F.when(mark != "", mark).otherwise(F.col("raw")))).withColumn("_next", F.lead("raw").over(Window.partitionBy(key).orderBy("pos")))
    line = F.col("line")
    byline = r"(?i)^by\s+[\p{L}\d][\p{L}\d\s.'’-]{1,80}\z"
    # after a word a boundary follows where no letter does, after another sign where one does
    noise = r"(?i)^(?:(?:copyright|all rights reserved|published by|printed in|isbn|project gutenberg|table of contents|contents)" + R + r"|(?:www\.|https?://)(?=[A-Za-z0-9_]))"
    heads = r"(?i)^(chapter|part|book|act|scene|section|prologue|epilogue|introduction|foreword|afterword|preface|appendix|postscript)" + R
    words = F.filter(F.split(line, r"\s+"), lambda w: w != "")
    n = F.size(words)
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[^\p{L}\d]+|[^\p{L}\d]+\z", ""))
    small = ["a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with"]
    titled = F.size(F.filter(bare, lambda w, i: (F.lower(w).isin(*small) & (i > 0)) | F.regexp_like(w, F.lit(r"^[A-Z\d]"))))
    narrative = (n >= 7) & (F.regexp_like(line, F.lit(r"[.!?]\z")) | F.regexp_like(line, F.lit(f"(?i){L}(he|she|they|we|i|the){R}")))
    add = lambda condition, points: F.when(condition, points).otherwise(0)
    score = (
        F.greatest(F.lit(0), 30 - F.col("pos") * 2)
        + add(mark != "", 40)
        + add(F.regexp_like(line, F.lit(r"^[A-Z\d][A-Z\d\s'’&,:\-–—]+\z")) & (n >= 2), 35)
        + add((n >= 2) & (n <= 14) & (titled / n >= 0.75), 28)
        + add((n >= 2) & (n <= 12), 16)
        - add(n > 16, 15)
        - add(narrative, 25)
        - add(F.regexp_like(line, F.lit(r"[;:]\z")), 8)
        + add(F.coalesce(F.regexp_like("_next", F.lit(byline)), F.lit(False)), 20)
    )
    fine = F.length(line).between(2, 120) & ~F.regexp_like(line, F.lit(noise)) & ~F.regexp_like(line, F.lit(byline)) & ~F.regexp_like(line, F.lit(heads))
    return rows.filter(fine).select(key, "pos", "line", score.alias("score"))


def titles(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 40, fallback: str = "Untitled Novel") -> DataFrame:
    """(key, title): a labelled title of the first lines, else the best candidate, else the fallback."""
    full = F.slice(F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), trimmed), lambda x: x != ""), 1, 12)
    label = F.filter(F.transform(full, lambda x: trimmed(F.regexp_extract(x, r"(?i)^(?:title|book\s*title)\s*[:–—-]\s*(.+)\z", 1))), lambda x: F.length(x).between(2, 120))
    best = title_candidates(df, key, text).groupBy(key).agg(F.max_by(F.struct("line", "score"), F.struct(F.col("score"), -F.col("pos"))).alias("b"))
    rows = df.select(key, F.get(label, F.lit(0)).alias("_l")).join(best, key, "left")
    return rows.select(key, F.coalesce("_l", F.when(F.col("b.score") >= least, F.col("b.line")), F.lit(fallback)).alias("title"))
