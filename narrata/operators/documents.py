"""Whole documents: cutting what is too long, chapters by marks, sets of scenes, gates, statistics, composed stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import cases
from ..functions.text import SPACES, c, canonical, folded, let, paragraphs, spaces_normal, trimmed, whole
from .dialogue import fragments_of
from .folds import sequenced

MOST, LEAST_SHARE = 3500, 0.4
MARK = r"\n\s*(?i:scene|part)\s+(?i:[\divxlcdm])+[:.\- ]"
#: Verbs of short physical action, after a name or pronoun.
GESTURES = [
    "paused", "nodded", "shook", "looked", "turned", "stepped", "leaned", "crossed", "folded", "clenched", "unclenched", "smiled", "frowned", "shrugged", "gestured", "pointed",
    "waved", "glanced", "stared", "sighed", "laughed", "winced", "flinched", "blinked", "swallowed", "hesitated", "straightened",
]
GESTURE = r"^(?:He|She|They|[A-Z][a-z]+)\s+(?:" + "|".join(GESTURES) + ")"
BEAT_WORDS = 12


def prepass(t) -> Column:
    """Line ends alike, tabs as a space, no more than two spaces in a row, none around the text."""
    t = F.regexp_replace(c(t), r"\r\n|\r", "\n")
    return trimmed(F.regexp_replace(F.regexp_replace(t, r"\t+", " "), r" {3,}", "  "))


def cut(paragraph, most: int = MOST) -> Column:
    """A paragraph in parts of up to ``most`` characters, at the last space of each unless that stands too early."""
    least = int(most * LEAST_SHARE)
    held = lambda at, made: F.struct(at.alias("at"), made.alias("parts"))

    def seen(blocks: Column, at: Column) -> Column:
        """The ``most`` characters from a place on: of the block it is in and the next."""
        k = F.floor(at / most).cast("int")
        return F.substring(F.concat(F.coalesce(F.get(blocks, k), F.lit("")), F.coalesce(F.get(blocks, k + 1), F.lit(""))), (at % most + 1).cast("int"), F.lit(most))

    def step(t: Column, size: Column, blocks: Column, acc: Column) -> Column:
        """The next part from where the last one ended."""

        def parted(window: Column) -> Column:
            space = F.length(F.regexp_extract(window, r"(?s)^(.*) ", 1))
            n = F.when(F.contains(window, F.lit(" ")) & (space >= least), space).otherwise(most)
            # what is left begins with its first character that is not white space; a run beyond a window is looked for in all of it
            lead = lambda stop: F.length(F.regexp_extract(seen(blocks, stop), r"^\s*", 0))
            following = lambda stop: stop + let(lead(stop), lambda k: F.when(k < most, k).otherwise(F.regexp_instr(F.substring(t, stop + 1, size - stop), F.lit(r"\S")) - 1))
            return let(n, lambda n: held(following(acc["at"] + n), F.concat(acc["parts"], F.filter(F.array(trimmed(F.substring(window, F.lit(1), n))), lambda p: p != ""))))

        return F.when(size - acc["at"] <= most, acc).otherwise(let(seen(blocks, acc["at"]), parted))

    def whole(t: Column, size: Column, blocks: Column) -> Column:
        turns = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(size / float(max(1, least))).cast("int")))
        done = lambda acc: F.filter(F.concat(acc["parts"], F.array(seen(blocks, acc["at"]))), lambda p: p != "")
        return F.aggregate(turns, held(F.lit(0), F.array().cast("array<string>")), lambda acc, _: step(t, size, blocks, acc), done)

    cut_up = lambda t: F.regexp_extract_all(t, F.lit(f"(?s).{{1,{most}}}"), F.lit(0))
    return let(trimmed(paragraph), lambda t: let(F.struct(F.length(t).alias("n"), cut_up(t).alias("blocks")), lambda x: whole(t, x["n"], x["blocks"])))


def parts(df: DataFrame, most: int = MOST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, part, text): the parts of all paragraphs of a text, none longer than ``most``."""
    cuts = F.flatten(F.transform(paragraphs(F.coalesce(F.col(text), F.lit(""))), lambda p: cut(p, most)))
    return df.select(key, F.posexplode(cuts).alias("part", "text"))


def marked_chapters(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chapter, title, content) of texts that scene or part marks cut into two or more."""
    pieces = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), MARK), lambda x: x != "")
    rows = df.select(key, pieces.alias("p")).filter(F.size("p") >= 2).select(key, F.posexplode("p").alias("i", "content"))
    return rows.select(key, (F.col("i") + 1).alias("chapter"), F.concat(F.lit("Scene "), (F.col("i") + 1).cast("string")).alias("title"), trimmed("content").alias("content"))


def detected_chapters(df: DataFrame, headed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tier, chapter, title, content): chapters by headings where ``headed`` has a key, else by marks, else one."""
    columns = [key, "tier", "chapter", "title", "content"]
    first = headed.withColumn("tier", F.lit("chapter_regex"))
    rest = df.join(headed.select(key).distinct(), key, "left_anti")
    second = marked_chapters(rest, key, text).withColumn("tier", F.lit("scene_split"))
    last = rest.join(second.select(key).distinct(), key, "left_anti").select(key, F.lit("single_chapter_safe_mode").alias("tier"), F.lit(1).alias("chapter"), F.lit("Full Text").alias("title"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    return first.select(*columns).unionByName(second.select(*columns)).unionByName(last.select(*columns))


def chapterless(df: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The keys of texts without any chapter."""
    return df.select(key).join(found.select(key).distinct(), key, "left_anti")


def scene_sets(texts: DataFrame, *candidates: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, scene, text) of the first candidate (key, scene, text) that loses nothing of texts (key, text), else one scene.

    Scenes that are empty or repeat the one before are left out first.
    """
    whole_ = texts.select(key, spaces_normal(F.coalesce("text", F.lit(""))).alias("_all")).filter("_all <> ''")
    found, left = None, whole_
    at = Window.partitionBy(key).orderBy("scene")
    for candidate in candidates:
        rows = candidate.select(key, "scene", spaces_normal(F.coalesce("text", F.lit(""))).alias("text")).filter(canonical("text") != "")
        rows = rows.filter(F.lit(True)).withColumn("_was", F.lag(canonical("text")).over(at)).filter(F.col("_was").isNull() | (F.col("_was") != canonical("text"))).drop("_was")
        stitched = rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("scene", "text"))), lambda x: x["text"]), "").alias("_made"))
        fine = left.join(stitched, key).filter(canonical("_made") == canonical("_all")).select(key)
        good = rows.join(fine, key, "left_semi").select(key, F.row_number().over(at).alias("scene"), "text")
        found = good if found is None else found.unionByName(good)
        left = left.join(fine, key, "left_anti")
    single = left.select(key, F.lit(1).alias("scene"), F.col("_all").alias("text"))
    return single if found is None else found.unionByName(single)


def output_gate(blocks: DataFrame, words: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, refused): why the blocks made of texts (key, words) are no rendering of them, or null.

    No blocks from words, or under six tenths of over fifty words and none spoken.
    """
    n = F.size(F.filter(F.split(F.coalesce("content", F.lit("")), r"\s+"), lambda w: w != ""))
    made = blocks.groupBy(key).agg(F.count("*").alias("_n"), F.sum(n).alias("_words"), F.count_if(F.col("type") == "dialogue").alias("_said"))
    rows = words.select(key, "words").join(made, key, "left").fillna(0, ["_n", "_words", "_said"])
    lost = (F.col("_words") * 10 < F.col("words") * 6) & (F.col("_said") == 0) & (F.col("words") > 50)
    return rows.select(key, cases([((F.col("_n") == 0) & (F.col("words") > 0), "NO_BLOCKS"), (lost, "WORDS_LOST")], None).alias("refused"))


def typed_of(text) -> Column:
    """Fragments without the punctuation around narration; short physical action is an action beat; ``pos`` counts those without content too."""
    n = lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    tidy = lambda f: F.when(f["kind"] == "narration", F.regexp_replace(f["content"], rf"[,;:\-{SPACES}]++\z", "")).otherwise(f["content"])
    beat = lambda f, x: (f["kind"] == "narration") & F.regexp_like(x, F.lit(GESTURE)) & (n(x) <= BEAT_WORDS)
    typed = lambda f, x, i: F.struct(i.alias("pos"), F.when(beat(f, x), "action_beat").otherwise(f["kind"]).alias("kind"), x.alias("content"), f["speaker"].alias("speaker"))
    return F.filter(F.transform(fragments_of(text), lambda f, i: let(tidy(f), lambda x: typed(f, x, i))), lambda f: f["content"] != "")


def typed_fragments(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, kind, content, speaker): the typed fragments of each text."""
    return df.select(key, F.explode(typed_of(text)).alias("f")).select(key, "f.*")


def document_statistics(paras: DataFrame, scenes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Words, paragraphs, scenes, fragments, speakers and ratios of texts as paragraphs (key, pos, text) and scenes (key, scene).

    A paragraph is measured where it is read; paragraphs with the same speakers, mostly none, are added up before they are shuffled.
    """
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    of = lambda kind: F.size(F.filter("_f", lambda f: f["kind"] == kind))
    who = F.array_sort(F.array_distinct(F.filter(F.transform("_f", lambda f: f["speaker"]), lambda s: s.isNotNull())))
    rows = paras.select(key, n.alias("_n"), typed_of("text").alias("_f"))
    rows = rows.select(key, "_n", F.size("_f").alias("_all"), of("dialogue").alias("_said"), of("narration").alias("_told"), F.when(F.exists("_f", lambda f: f["speaker"].isNotNull()), who).alias("_who"))
    rows = rows.groupBy(key, "_who").agg(F.sum("_n").alias("_n"), F.count("*").alias("_paras"), F.sum("_all").alias("_all"), F.sum("_said").alias("_said"), F.sum("_told").alias("_told"))
    speakers = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_who")))), ",")
    base = rows.groupBy(key).agg(F.sum("_n").cast("long").alias("words"), F.sum("_paras").alias("paragraphs"), F.sum("_all").alias("_all"), F.sum("_said").alias("dialogue_fragments"), F.sum("_told").alias("narration_fragments"), speakers.alias("speakers"))
    many = scenes.groupBy(key).agg(F.count_distinct("scene").alias("scenes"))
    rows = base.join(many, key, "left").fillna(0, ["scenes"])
    per = lambda n: F.when(F.col(n) > 0, whole(F.col("words") / F.when(F.col(n) > 0, F.col(n)))).otherwise(0).cast("long")
    ratio = F.floor(F.col("dialogue_fragments") / F.greatest(F.lit(1), F.col("_all")) * 1000 + 0.5) / 1000.0
    return rows.select(key, "words", "paragraphs", "scenes", "dialogue_fragments", "narration_fragments", "speakers", per("paragraphs").alias("words_per_paragraph"), per("scenes").alias("words_per_scene"), ratio.alias("dialogue_ratio"))


def filled_emotions(blocks: DataFrame, flow: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks (key, pos, emotion) where those without take the emotion of the sentence of flow (key, i, emotion) as far along."""
    at = Window.partitionBy(key).orderBy("pos")
    rows = blocks.select(key, "pos", "emotion", (F.row_number().over(at) - 1).alias("_b"), F.count("*").over(Window.partitionBy(key)).alias("_blocks"))
    size = flow.groupBy(key).agg(F.count("*").alias("_flow"))
    rows = rows.join(size, key, "left").withColumn("_i", F.least(F.floor(F.col("_b") * F.col("_flow") / F.col("_blocks")), F.col("_flow") - 1))
    of = flow.select(F.col(key).alias("_k"), F.col("i").alias("_j"), F.col("emotion").alias("_e"))
    return rows.join(of, (F.col(key) == F.col("_k")) & (F.col("_i") == F.col("_j")), "left").select(key, "pos", F.coalesce("emotion", "_e").alias("emotion"))


def unfenced(t) -> Column:
    """A text without a code fence around it."""
    return trimmed(F.regexp_replace(F.regexp_replace(c(t), r"(?i)^```(?:json)?\s*", ""), r"\s*```\z", ""))


def flushed(tokens: DataFrame, least: int = 320, key: str = "session", order: str = "pos") -> DataFrame:
    """(key, flush, text): what a stream of tokens (key, order, token) shows: whole paragraphs once ``least`` characters wait, the rest at its end."""

    def step(state: tuple[int, str], row: dict):
        n, held = state
        held += row["token"] or ""
        at = held.rfind("\n\n")
        if len(held) >= least and at > 0:
            return (n + 1, held[at + 2 :]), [(n, held[:at])]
        return (n, held), []

    rest = lambda state: [(state[0], state[1])] if state[1].strip() else []
    return sequenced(tokens.select(key, order, "token"), [key], [order], lambda: (0, ""), step, "flush int, text string", rest)


def stream_metrics(events: DataFrame, key: str = "session") -> DataFrame:
    """(key, tokens, first_token_ms, tokens_per_second, state) of events (key, ts, kind): start, token, complete, error, cancel."""
    of = lambda kind, x: F.min(F.when(F.col("kind") == kind, x))
    rows = events.groupBy(key).agg(of("start", F.col("ts")).alias("_start"), of("token", F.col("ts")).alias("_first"), F.max(F.when(F.col("kind") == "token", F.col("ts"))).alias("_last"), F.count_if(F.col("kind") == "token").alias("tokens"), F.max_by("kind", F.struct("ts", "kind")).alias("_kind"))
    state = cases([(F.col("_kind") == "complete", "complete"), (F.col("_kind") == "error", "error"), (F.col("_kind") == "cancel", "cancelled"), (F.col("tokens") > 0, "streaming")], "idle")
    seconds = (F.col("_last") - F.col("_start")) / 1000.0
    return rows.select(key, "tokens", (F.col("_first") - F.col("_start")).alias("first_token_ms"), F.when(seconds > 0, F.floor(F.col("tokens") / F.when(seconds > 0, seconds) * 100 + 0.5) / 100.0).otherwise(0.0).alias("tokens_per_second"), state.alias("state"))


def reader_state(scenes: DataFrame, key: str = "session") -> DataFrame:
    """(key, scenes, complete, progress, streaming, tokens, active) over the scenes' states (key, scene, ts, progress, state, tokens)."""
    return scenes.groupBy(key).agg(
        F.count("*").alias("scenes"), F.count_if(F.col("state") == "complete").alias("complete"), (F.sum(F.when(F.col("state") == "complete", 100).otherwise(F.col("progress"))) / F.count("*")).alias("progress"),
        (F.count_if(F.col("state") == "streaming") > 0).alias("streaming"), F.sum("tokens").alias("tokens"), F.max_by("scene", F.struct("ts", "scene")).alias("active"),
    )


def composed(df: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """A table through named stages in order; a stage's failure names it. Plans are made, not run, so a stage costs nothing by itself."""
    for name, stage in stages:
        try:
            df = stage(df)
        except Exception as e:
            raise RuntimeError(f"stage {name} failed") from e
    return df


def scene_starts(paras: DataFrame, scenes: DataFrame, key: str = "doc_id", chars: int = 80) -> DataFrame:
    """(key, pos) of the paragraphs (key, pos, text) that scenes (key, scene, text) begin with, by their first characters.

    Scenes are looked for in order, each from the paragraph after the last one found; a scene that is not found is
    passed over. The first paragraph is no start, and texts of one scene have none.
    """
    in_order = lambda x, y: F.array_sort(F.collect_list(F.struct(x, y)))
    p = paras.groupBy(key).agg(in_order("pos", trimmed(F.coalesce("text", F.lit(""))).alias("text")).alias("_p"))
    s = scenes.groupBy(key).agg(in_order("scene", F.left(trimmed(F.coalesce("text", F.lit(""))), F.lit(chars)).alias("head")).alias("_s")).filter(F.size("_s") > 1)

    def step(at: Column, scene: Column) -> tuple[Column, Column]:
        hits = F.filter(F.sequence(F.lit(0), F.size("_p") - 1), lambda i: (i >= at) & F.startswith(F.get("_p", i)["text"], scene["head"]))
        hit = F.when(scene["head"] != "", F.get(hits, F.lit(0)))
        return F.coalesce(hit + 1, at), F.filter(F.array(hit), lambda i: i.isNotNull() & (i > 0))

    found = folded(F.col("_s"), F.lit(0), step, "int")
    return p.join(s, key).select(key, F.explode(F.transform(found, lambda i: F.get("_p", i)["pos"])).alias("pos"))


def projected(chapters: DataFrame) -> DataFrame:
    """Chapters as they are exported: title, number and paragraphs of the revised text where there is one, else of the original."""
    return chapters.withColumn("paragraphs", paragraphs(F.coalesce("revised", "text", F.lit("")))).drop("revised", "text")
