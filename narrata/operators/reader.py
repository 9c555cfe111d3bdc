"""Reading telemetry: snapshots, sessions, progress and the summary of a reader's book."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import cases, reading_rhythm
from ..functions.text import clamp, whole
from .folds import resumed

SESSION_MS = 20 * 60 * 1000
KEPT = 720
SAMPLE_SECONDS = 45


def sane(snapshots: DataFrame) -> DataFrame:
    """Scroll from 0 to 1, whole seconds that are not negative."""
    return snapshots.withColumn("scroll", clamp("scroll", 0.0, 1.0)).withColumn("read_sec", F.greatest(F.lit(0), F.col("read_sec")))


def thinned(snapshots: DataFrame, key: str = "book") -> DataFrame:
    """Snapshots without those that come within 20 s of the last kept one in the same chapter and mode, hardly scrolled.

    Which one is kept depends on the one kept before. Of a book's, the last KEPT stay.
    """
    names = ("ts", "chapter", "mode", "scroll", "read_sec")

    def step(kept: tuple | None, place: int, x: tuple):
        if kept and x[0] - kept[0] < 20_000 and kept[1] == x[1] and kept[2] == x[2] and abs(kept[3] - x[3]) < 0.02:
            return kept, ()
        return x, (x,)

    rows = sane(snapshots).select(key, *names)
    return latest(resumed(rows, [key], list(names), lambda: None, step, "ts long, chapter int, mode string, scroll double, read_sec int"), KEPT, key)


def latest(snapshots: DataFrame, n: int = KEPT, key: str = "book") -> DataFrame:
    """The n last snapshots of each book."""
    at = Window.partitionBy(key).orderBy(F.desc("ts"))
    return snapshots.withColumn("_n", F.row_number().over(at)).filter(F.col("_n") <= n).drop("_n")


def sessions(events: DataFrame, key: str, ts: str, gap: int = SESSION_MS) -> DataFrame:
    """(key, session, start, end, events): a pause of more than ``gap`` opens a session. ``ts`` is in milliseconds."""
    order = Window.partitionBy(key).orderBy("ts")
    rows = events.select(key, F.col(ts).alias("ts")).withColumn("_new", F.coalesce(F.col("ts") - F.lag("ts").over(order) > gap, F.lit(True)))
    rows = rows.withColumn("session", F.sum(F.col("_new").cast("int")).over(order.rangeBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "session").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("events"))


def words_read(chapters: DataFrame, progress: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(book, total_words, words_read): words of read chapters, and of the current one as far as it is scrolled."""
    totals = chapters.groupBy("book").agg(F.sum("word_count").alias("total_words"), F.map_from_entries(F.collect_list(F.struct("number", "word_count"))).alias("_by"))
    last = sane(snapshots).groupBy("book").agg(F.max_by("scroll", "ts").alias("_scroll"))
    rows = progress.join(totals, "book").join(last, "book", "left")
    of = lambda n: F.coalesce(F.try_element_at(F.col("_by"), n), F.lit(0).cast("bigint"))
    done = F.aggregate("read_chapters", F.lit(0).cast("bigint"), lambda a, n: a + of(n))
    now = F.when(F.array_contains("read_chapters", F.col("current")), 0).otherwise(whole(of(F.col("current")) * F.coalesce("_scroll", F.lit(0.0))))
    return rows.select("book", "total_words", F.greatest(F.lit(0), F.least(F.col("total_words"), done + now)).alias("words_read"))


def progress_summary(chapters: DataFrame, progress: DataFrame, snapshots: DataFrame, ref_ts: int | None = None) -> DataFrame:
    """Words read, share, speed, minutes left, minutes and sessions of the last day, last activity, one row a book.

    ``ref_ts`` stands for now; without it, the latest snapshot of all.
    """
    read = words_read(chapters, progress, snapshots)
    now = F.lit(ref_ts) if ref_ts is not None else F.col("_now")
    marked = snapshots.crossJoin(F.broadcast(snapshots.agg(F.max("ts").alias("_now")))) if ref_ts is None else snapshots  # a single row
    today = marked.filter(F.col("ts") >= now - 86_400_000)
    day = today.groupBy("book").agg(F.count("*").alias("_n"))
    visits = sessions(today, "book", "ts").groupBy("book").agg(F.count("*").alias("_sessions"))
    last = snapshots.groupBy("book").agg(F.max("ts").alias("last_ts"))
    rows = read.join(progress.select("book", "read_sec"), "book").join(day, "book", "left").join(visits, "book", "left").join(last, "book", "left")
    wpm = whole(F.col("words_read") / F.greatest(F.lit(1.0), F.col("read_sec") / 60.0))
    left = F.greatest(F.lit(0), F.col("total_words") - F.col("words_read"))
    return rows.select(
        "book",
        "words_read",
        F.when(F.col("total_words") > 0, clamp(whole(F.col("words_read") / F.col("total_words") * 100.0), 0, 100)).otherwise(0).cast("long").alias("percent"),
        wpm.cast("long").alias("words_per_minute"),
        F.ceil(left / F.when(wpm > 0, wpm).otherwise(170)).cast("long").alias("minutes_left"),
        whole(F.coalesce("_n", F.lit(0)) * SAMPLE_SECONDS / 60.0).cast("long").alias("minutes_today"),
        F.coalesce("_sessions", F.lit(0)).cast("long").alias("sessions_today"),
        "last_ts",
    )


def cinematic_summary(blocks: DataFrame, scenes: int, key: str = "doc_id") -> DataFrame:
    """Tension, emotions, cues, rhythm and the depth score of a chapter's blocks.

    Blocks count as transitions and sounds by their type, and where they carry one in a column of that name.
    """
    carries = lambda kind, field: F.coalesce((F.col("type") == kind) | F.col(field).isNotNull() if field in blocks.columns else F.col("type") == kind, F.lit(False))
    timing = cases([(F.col("timing") == "slow", 30), (F.col("timing") == "normal", 52), (F.col("timing") == "quick", 74), (F.col("timing") == "rapid", 92)], None)
    base = blocks.groupBy(key).agg(
        F.count("*").alias("cues"),
        F.coalesce(whole(F.avg("tension")), F.lit(0)).cast("long").alias("avg_tension"),
        F.coalesce(F.max("tension") - F.min("tension"), F.lit(0)).alias("tension_swing"),
        F.coalesce(F.when(F.count("tension") >= 2, F.stddev_pop("tension")), F.lit(0.0)).alias("_deviation"),
        F.count_distinct("emotion").alias("emotions"),
        F.count_if(carries("transition", "transition")).alias("transitions"),
        F.count_if(carries("sfx", "sfx")).alias("sounds"),
        whole(F.count_if(F.col("type").isin("dialogue", "inner_thought")) / F.count("*") * 100.0).cast("long").alias("dialogue_percent"),
        F.avg(timing).alias("_timing"),
    )
    most = lambda x, top: F.greatest(F.lit(0.0), F.least(F.lit(float(top)), x))
    depth = min(scenes * 11, 28) + most(F.col("cues") * 3.1, 24) + most(F.col("emotions") * 5.5, 16) + most(F.col("tension_swing") * 0.24 + F.col("_deviation") * 0.42, 20) + most((F.col("transitions") + F.col("sounds")) * 1.9, 12)
    score = F.coalesce("_timing", clamp(35 + (F.col("cues") / max(scenes, 1) if scenes else F.lit(0)) * 14, 0.0, 100.0))
    return base.select(key, "cues", "avg_tension", "tension_swing", "emotions", "transitions", "sounds", "dialogue_percent", clamp(whole(depth), 0, 100).cast("long").alias("depth"), reading_rhythm(score).alias("rhythm"))
