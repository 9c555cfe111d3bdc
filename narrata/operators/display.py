"""What a reader shows of blocks: heights, kinds, spacing, visible range; and labels of times, speeds and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import cases
from ..functions.text import c, clamp, whole

# Spacing by timing and by type, opacity and tracking by intensity, types that open a scene.
TIMING_SPACING = {"rapid": 0.5, "quick": 0.75, "normal": 1.0, "slow": 1.5}
TYPE_SPACING = {"transition": 2.25, "title_card": 2.5, "chapter_header": 3.0, "beat": 1.5, "dialogue": 1.15, "inner_thought": 1.35, "sfx": 1.0}
OPACITY = {"whisper": 0.82, "normal": 1.0, "emphasis": 1.0, "shout": 1.0, "explosive": 1.0}
TRACKING = {"whisper": "0.02em", "normal": "0em", "emphasis": "0.01em", "shout": "0.02em", "explosive": "0.035em"}
OPENERS = ["transition", "title_card", "chapter_header"]


def _of(table: dict, key: Column, rest) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(rest))


def block_height(kind="type", content="content", speaker="speaker") -> Column:
    """Pixels of a block: a base, and lines of 60 or 70 characters."""
    lines = lambda width: F.ceil(F.length(F.coalesce(c(content), F.lit(""))) / float(width)) * 22
    said = lines(60) + F.when(c(speaker).isNotNull() & (c(speaker) != ""), 20).otherwise(0)
    return (24 + cases([(c(kind).isin("beat", "sfx"), 20), (c(kind).isin(*OPENERS), 40), (c(kind) == "dialogue", said)], lines(70))).cast("long")


def paragraph_kind(kind="type", tension="tension") -> Column:
    return cases([(c(kind) == "title_card", "scene"), (c(kind) == "dialogue", "dialogue"), (c(kind) == "inner_thought", "reflection"), (F.coalesce(c(tension), F.lit(0)) >= 70, "tension")], "action")


def pacing_styles(blocks: DataFrame, cinematic: bool = True, key: str = "doc_id") -> DataFrame:
    """(key, pos, spacing in hundredths, tracking, opacity, delay in thousandths, opens a scene, class), each against the block before."""
    at = Window.partitionBy(key).orderBy("pos")
    rows = blocks.select(key, "pos", "type", "timing", "tension", *(["intensity"] if "intensity" in blocks.columns else []), F.lag("type").over(at).alias("_was"), (F.row_number().over(at) - 1).alias("_i"))
    intensity = F.coalesce("intensity", F.lit("normal")) if "intensity" in rows.columns else F.lit("normal")
    timing, tension = F.coalesce("timing", F.lit("normal")), F.coalesce("tension", F.lit(0))
    # hundredths, so that sums are exact
    cents = lambda table: {k: round(v * 100) for k, v in table.items()}
    base = F.greatest(_of(cents(TIMING_SPACING), timing, 100), _of(cents(TYPE_SPACING), F.col("type"), 0))
    spaced = base + cases([(tension > 80, 50), (tension > 60, 25), ((tension < 20) & (base > 75), -15)], 0)
    opens = (F.col("_i") > 0) & F.col("type").isin(*OPENERS) & (F.col("_was").isNull() | ~F.col("_was").isin(*OPENERS))
    tenths = 13 if cinematic else 10
    spacing = F.when(opens, F.greatest(spaced * tenths, F.lit(250 * tenths))).otherwise(spaced * tenths)
    style = cases([(timing.isin("rapid", "quick"), "rapid"), (timing == "slow", "slow"), (tension > 70, "tense")], "")
    delay = F.least(F.col("_i") * 25, F.lit(400)) if cinematic else F.lit(0)
    return rows.select(key, "pos", spacing.cast("long").alias("spacing"), _of(TRACKING, intensity, "0em").alias("tracking"), _of(OPACITY, intensity, 1.0).alias("opacity"), delay.cast("long").alias("delay"), opens.alias("opens_scene"), style.alias("style"))


def offsets(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks (key, pos) with their heights and where they begin."""
    at = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.select(key, "pos", block_height().alias("height"))
    return rows.withColumn("top", F.coalesce(F.sum("height").over(at), F.lit(0)))


def visible(blocks: DataFrame, scroll: int, view: int, more: int = 3, key: str = "doc_id") -> DataFrame:
    """(key, first_pos, last_pos) of the blocks that a view shows, and ``more`` on both sides."""
    at = Window.partitionBy(key).orderBy("pos")
    rows = offsets(blocks, key).withColumn("_i", F.row_number().over(at))
    seen = rows.groupBy(key).agg(F.min(F.when((F.col("top") + F.col("height") > scroll) & (F.col("top") < scroll + view), F.col("_i"))).alias("_a"), F.max(F.when((F.col("top") + F.col("height") > scroll) & (F.col("top") < scroll + view), F.col("_i"))).alias("_b"))
    near = rows.join(seen.filter("_a is not null"), key).filter(F.col("_i").between(F.col("_a") - more, F.col("_b") + more))
    return near.groupBy(key).agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def minutes_label(minutes) -> Column:
    m = c(minutes).cast("long")
    hours, rest = F.floor(m / 60).cast("string"), (m % 60).cast("string")
    return cases([(m < 60, F.concat(m.cast("string"), F.lit("m"))), (m % 60 == 0, F.concat(hours, F.lit("h")))], F.concat(hours, F.lit("h "), rest, F.lit("m")))


def scroll_ratio(top, height, view) -> Column:
    most = F.greatest(F.lit(0), c(height) - c(view))
    return F.when(most <= 0, 0.0).otherwise(clamp(c(top) / F.when(most > 0, most), 0.0, 1.0))


def scroll_speed(tension, base: float = 40.0) -> Column:
    """Pixels a second: slower where tension is high."""
    return base * (1 - c(tension) * 0.7 / 100.0)


def page_batch(pages, memory_gb: float = 4) -> Column:
    """Pages that are read at once, by the memory there is and the number of pages."""
    many, few, most = next(x for limit, *x in ((2, 2, 3, 250), (4, 3, 5, 300), (8, 5, 8, 350), (float("inf"), 8, 10, 450)) if memory_gb <= limit)
    return F.when(c(pages) > most, many).otherwise(few)


def mapped(progress, start, end) -> Column:
    """A percentage within a stage as one of the whole."""
    return whole(c(start) + (c(end) - c(start)) * clamp(progress, 0, 100) / 100.0).cast("long")
