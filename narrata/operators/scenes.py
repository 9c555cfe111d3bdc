"""Scenes over paragraphs (key, pos, text), by windows instead of a loop over the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import NEARLY, cases, sentiment
from ..functions.text import c, found, let, literals, trimmed, ways

#: ASCII word boundaries; the engine's own \b takes accented letters for word characters.
L, R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# Cue phrases and patterns: fixed values.
BREAK_SIGNALS = r"(?i)(later that night|meanwhile|hours later|at dawn|suddenly|in another place|elsewhere|the next (morning|day|evening|night)|days later|weeks later|months later|years later|across town|back at|far away|on the other side|that morning|at nightfall|before sunrise|after sunset|in a flash|without warning|in an instant|moments later|a while later|at the same time|at that moment|\*\*\*|---|###|\.{3,}|\s{3,})"
DIVIDER = r"^\s*[*\-#=~_]{3,}\s*\z|^\s*\.{3,}\s*\z"
PLACE = r"(?:[Ii]n|[Aa]t|[Oo]n|[Nn]ear|[Bb]eside|[Ii]nside|[Oo]utside|[Bb]eneath|[Aa]bove|[Aa]cross)\s+(?:the\s+)?([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"
PLACE_SHIFT = r"(?:[Ii]n|[Aa]t|[Oo]n|[Ii]nside|[Oo]utside|[Nn]ear|[Aa]cross|[Bb]ack at|[Bb]eyond)\s+(?:the\s+)?([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"
TIME = r"(that night|that morning|the next day|at dawn|at dusk|hours later|days later|meanwhile)"
TIME_SHIFT = r"(later|earlier|meanwhile|the next (?:morning|day|night|evening)|at (?:dawn|dusk|sunrise|sunset|nightfall)|that (?:night|morning|evening)|hours later|days later|weeks later|months later|years later)"
TRANSITION = r"(meanwhile|elsewhere|back in|back at|on the other side|later|earlier|in another place|at the same time|as for)"
LAYOUT_TIME = r"(later that night|later that day|hours later|days later|weeks later|months later|years later|meanwhile|the next morning|the next day|the following morning|at dawn|at dusk|at nightfall|before sunrise|after sunset|that night|that morning)"
LAYOUT_PLACE = r"(?:in|at|on|inside|outside|near|within|beneath|beyond|across)\s+(?:the\s+)?([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})"
LAYOUT_DIVIDER = r"^\s*(?:\*{3,}|-{3,}|#{3,}|\.{3,}|—\s*✦\s*—)\s*\z"
FLASHBACK = r"(he remembered|she remembered|they remembered|remembered when|she recalled|he recalled|they recalled|memories flooded|years ago|long ago)"
DREAM = r"(dreaming|in the dream|the dream faded|woke with a start)"
MEMORY = r"(the memory|recollection)"
POV_VERBS = [
    "walked", "thought", "felt", "saw", "heard", "knew", "looked", "stood", "turned", "ran", "sat", "watched",
    "wondered", "realized", "remembered", "noticed", "whispered", "said", "spoke", "asked", "replied", "muttered",
    "sighed", "screamed", "cried", "laughed", "smiled", "frowned", "gazed", "stared", "glanced", "moved", "stepped",
    "entered", "left", "opened", "closed", "grabbed", "held", "dropped", "pulled", "pushed", "reached", "waited",
    "paused", "hesitated", "decided", "began", "started", "continued", "tried", "wanted", "needed", "wished",
    "hoped", "feared", "loved", "hated",
]
POV = r"^([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s+(?:" + "|".join(POV_VERBS) + ")"
ACTION = r"(explosion|attack|battle|fight|chase|escape|collision|confrontation|argument|scream|crash|gunshot|ambush|pursuit)"
MOODS = {
    "Dark": "(terror|dread|horror|fear|scream|dark|shadow|death)", "Joyful": "(joy|laugh|smile|happy|delight|celebrate|cheer)", "Sorrowful": "(sorrow|tears|grief|mourn|weep|loss|tragic)",
    "Tense": "(tense|danger|threat|warn|urgent|desperate)", "Quiet": "(calm|peace|quiet|gentle|serene|still|rest)",
}
PRONOUNS = ("He", "She", "They", "We", "I", "You", "It")

#: Where neither matches, in lower case, there is no cue of time, transition, break or mode, and no divider.
CUES = "|".join(sorted({x for p in (TIME_SHIFT, TRANSITION, "|".join(w for w in ways(BREAK_SIGNALS[4:]) if w[0].isalpha()), FLASHBACK, DREAM, MEMORY) for x in literals(p)}))
RULES = r"[*#.=~_ \t\n\x0B\f\r-]{3}"
#: A capital after the end of "the" or of a word that places follow.
PLACED = r"[ABCDEFGHIJKLMNOPQRSTUVWXYZ](?<=[nterhsd\s]\s.)[a-z]"


def has(t, pattern: str, low: Column | None = None) -> Column:
    """Whether the words of a pattern stand in a text, whatever their case; ``low`` is the text in lower case, if it is at hand."""
    return found(t, pattern, f"{L}{pattern}{R}", low)


def first(t, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    return F.nullif(F.regexp_extract(F.col(t) if isinstance(t, str) else t, pattern, group), F.lit(""))


def narrative_mode(t, low: Column | None = None) -> Column:
    return cases([(has(t, FLASHBACK, low), "flashback"), (has(t, DREAM, low), "dream"), (has(t, MEMORY, low), "memory")], "normal")


def place_hint(t) -> Column:
    return F.when(F.regexp_like(c(t), F.lit(PLACED)), F.lower(trimmed(F.coalesce(first(t, L + PLACE_SHIFT), first(t, L + PLACE)))))


def point_of_view(t) -> Column:
    return first(trimmed(t), POV + R)


#: What of a paragraph is worth a closer look.
HINTS = "cued boolean, placed boolean, telling boolean"


def hinted():
    """A function of an Arrow array of texts that gives HINTS: what is false says that the regexes of it find nothing there.

    Arrow's regexes read a text once, whatever the number of words looked for. They are given bytes, since texts may be no
    valid UTF-8, and only signs of ASCII count; two others have a lower case in ASCII. The function needs no module but Arrow's.
    """
    cues, rules, nearly, white = CUES, RULES, NEARLY, r" \t\n\x0B\f\r"

    def hints(texts):
        import pyarrow as pa
        import pyarrow.compute as pc

        low = pc.ascii_lower(texts)
        for sign, by in (("\u0130", "i"), ("\u212A", "k")):
            low = pc.replace_substring(low, sign, by)
        low = low.cast(pa.binary())
        words = pc.replace_substring_regex(low, f"[^a-z'{white}-]+", "")
        cued = pc.or_(pc.match_substring_regex(low, cues), pc.match_substring_regex(low, rules))
        placed = pc.match_substring_regex(texts.cast(pa.binary()), f"[nterhsd{white}][{white}][A-Z][a-z]")
        telling = pc.match_substring_regex(words, f"(?:^|[{white}]){nearly}(?:[{white}]|$)")
        return pa.StructArray.from_arrays([cued, placed, telling], ["cued", "placed", "telling"])

    return hints


def _signals(paragraphs: DataFrame, key: str) -> DataFrame:
    """Paragraphs that are no dividers, with what tells them from the one before."""
    order = Window.partitionBy(key).orderBy("pos")
    hints = F.arrow_udf(hinted(), HINTS)
    # all that the text says is taken before the windows over it and their shuffle, which then go without the text
    p = paragraphs.select(key, "pos", "text").filter(F.regexp_like("text", F.lit(r"\S"))).withColumn("_h", hints("text"))
    cued, t, low = F.col("_h.cued"), F.col("_trimmed"), F.col("_low")
    p = p.withColumn("_trimmed", F.when(cued, trimmed("text"))).withColumn("_low", F.lower(t))
    where = lambda x: F.when(cued, x).otherwise(False)
    mood = lambda score, confidence: F.struct(score.alias("score"), confidence.alias("confidence"))
    p = p.select(
        key, "pos", where(F.regexp_like(t, F.lit(DIVIDER))).alias("_divider"), F.when(F.col("_h.placed"), place_hint("text")).alias("_place"), F.when(cued, narrative_mode(t, low)).otherwise("normal").alias("_mode"),
        F.when(F.col("_h.telling"), let(sentiment("text"), lambda s: mood(s["score"], s["confidence"]))).otherwise(mood(F.lit(0.0), F.lit(0.0))).alias("_s"),
        where(has(t, TIME_SHIFT, low)).alias("time_shift"), where(found(t, BREAK_SIGNALS[4:], BREAK_SIGNALS[4:], low) | has(t, TRANSITION, low)).alias("signal"),
    )
    p = p.withColumn("_part", F.sum(F.col("_divider").cast("int")).over(order)).filter(~F.col("_divider"))
    for name in ("part", "place", "mode", "s"):
        p = p.withColumn(f"_was_{name}", F.lag(f"_{name}").over(order))
    a, b = F.col("_was_s"), F.col("_s")
    flipped = (F.signum(a["score"]) != F.signum(b["score"])) & (F.abs(a["score"]) >= 0.2) & (F.abs(b["score"]) >= 0.2)
    return p.withColumns(
        {
            "after_divider": F.coalesce(F.col("_was_part") != F.col("_part"), F.col("_part") > 0),
            "opens": F.col("_was_part").isNull(),
            "moved": F.coalesce(F.col("_was_place") != F.col("_place"), F.lit(False)),
            "mode_changed": F.coalesce(F.col("_was_mode") != F.col("_mode"), F.lit(False)),
            "reset": F.coalesce((a["confidence"] >= 0.05) & (b["confidence"] >= 0.05) & ((F.abs(a["score"] - b["score"]) >= 0.55) | flipped), F.lit(False)),
        }
    )


def scenes(paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, scene): scenes start after dividers, time shifts, moves, cue words, changes of mode and resets of mood."""
    order = Window.partitionBy(key).orderBy("pos")
    p = _signals(paragraphs, key)
    starts = F.col("opens") | F.col("after_divider") | F.col("time_shift") | F.col("moved") | F.col("signal") | F.col("mode_changed") | F.col("reset")
    return p.select(key, "pos", F.sum(starts.cast("int")).over(order).cast("int").alias("scene"))


def break_reasons(paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, reason): the first thing that tells a paragraph from the one before, or none."""
    p = _signals(paragraphs, key)
    reason = cases([(F.col("opens"), "start"), (F.col("after_divider"), "divider"), (F.col("time_shift"), "time_shift"), (F.col("moved"), "location_change"), (F.col("mode_changed"), "mode_change"), (F.col("reset"), "emotional_reset"), (F.col("signal"), "transition")], "none")
    return p.select(key, "pos", reason.alias("reason"))


def paragraphs_with_gaps(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, text, gap): paragraphs between blank lines, with the newlines that follow each."""
    t = trimmed(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r\n|\r", "\n"))
    gap = r"\n\s*\n+"
    both = F.arrays_zip(F.split(t, gap).alias("text"), F.transform(F.regexp_extract_all(t, F.lit(f"({gap})"), F.lit(1)), lambda s: F.regexp_count(s, F.lit("\n"))).alias("gap"))
    return df.select(key, F.posexplode(both).alias("pos", "p")).select(key, "pos", trimmed("p.text").alias("text"), F.coalesce("p.gap", F.lit(0)).alias("gap")).filter("text <> ''")


def layout_scenes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, scene) by dividers, time shifts, gaps of three newlines, and places other than the scene's last."""
    order = Window.partitionBy(key).orderBy("pos")
    p = paragraphs_with_gaps(df, key, text).withColumn("_divider", F.regexp_like("text", F.lit(LAYOUT_DIVIDER))).withColumn("_gap", F.coalesce(F.lag("gap").over(order), F.lit(0)))
    p = p.withColumn("_part", F.sum(F.col("_divider").cast("int")).over(order)).filter(~F.col("_divider"))
    p = p.withColumn("_was_part", F.lag("_part").over(order)).withColumn("_place", F.lower(trimmed(first("text", f"(?i){L}{LAYOUT_PLACE}"))))
    hard = F.col("_was_part").isNull() | (F.col("_was_part") != F.col("_part")) | (F.col("_gap") >= 3) | has("text", LAYOUT_TIME)
    p = p.withColumn("_stretch", F.sum(hard.cast("int")).over(order)).withColumn("_hard", hard)
    within = Window.partitionBy(key, "_stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.coalesce(F.col("_place") != F.last("_place", ignorenulls=True).over(within), F.lit(False))
    p = p.withColumn("_moved", moved)
    return p.select(key, "pos", F.sum((F.col("_hard") | F.col("_moved")).cast("int")).over(order).cast("int").alias("scene"))


def scene_texts(paragraphs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, scene, paragraphs, text): the paragraphs of each scene joined by blank lines."""
    rows = paragraphs.select(key, "pos", trimmed("text").alias("text")).join(found, [key, "pos"])
    return rows.groupBy(key, "scene").agg(F.count("*").alias("paragraphs"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def scene_titles(paragraphs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, scene, title): by place, time, talk or action, mood, point of view, else by number."""
    return told_scenes(paragraphs, found, key).select(key, "scene", "title")


def told_scenes(paragraphs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, scene, pos, paragraphs, text, title): where each scene begins, what ``scene_texts`` and ``scene_titles`` say of it, by gathering it once."""
    rows = paragraphs.select(key, "pos", trimmed("text").alias("text")).join(found, [key, "pos"])
    told = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    s = rows.groupBy(key, "scene").agg(F.min("pos").alias("pos"), F.count("*").alias("paragraphs"), told.alias("_all"))
    s = s.select(key, "scene", "pos", "paragraphs", F.get("_all", F.lit(0)).alias("one"), F.array_join("_all", "\n\n").alias("text"))
    # words of moods stand within lines, so a break between paragraphs tells as much as a space
    s = s.withColumn("_low", F.lower("text"))
    number = F.col("scene").cast("string")
    when = first("one", f"(?i){L}{TIME}{R}")
    act = first("one", f"(?i){L}{ACTION}{R}")
    the_act = F.concat(F.lit("The "), F.upper(F.substring(act, 1, 1)), F.lower(F.substring(act, 2, 40)))
    pov = point_of_view("one")
    title = F.coalesce(
        first("one", L + PLACE),
        F.concat(F.upper(F.substring(when, 1, 1)), F.substring(when, 2, 40)),
        F.when(F.regexp_like("one", F.lit('^["“]')), F.coalesce(the_act, F.lit("The Conversation"))),
        the_act,
        *[F.when(has("text", pattern, F.col("_low")), F.concat(F.lit(f"{mood} Scene "), number)) for mood, pattern in MOODS.items()],
        F.when(pov.isNotNull() & ~pov.isin(*PRONOUNS), F.concat(pov, F.lit("'s Scene"))),
        F.concat(F.lit("Scene "), number),
    )
    return s.select(key, "scene", "pos", "paragraphs", "text", title.alias("title"))
