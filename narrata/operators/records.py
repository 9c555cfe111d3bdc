"""Small stores and lookups as tables: feedback, checkpoints, chapters in turn, characters, providers in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import cases
from ..functions.text import c, let, trimmed

# Kinds of feedback; key formats and least lengths of providers; stages and their shares of progress.
CATEGORIES = ["bug", "ux", "feature", "other"]
KEY_FORMATS = {
    "openai": r"^sk-[a-zA-Z0-9_-]{20,}\z",
    "gemini": r"^AIza[a-zA-Z0-9_-]{30,}\z",
    "claude": r"^sk-ant-[a-zA-Z0-9_-]{20,}\z",
    "groq": r"^gsk_[a-zA-Z0-9]{20,}\z",
    "deepseek": r"^[a-zA-Z0-9_-]{20,}\z",
    "nim": r"^nvapi-[a-zA-Z0-9_-]{20,}\z",
    "gwen": r"^[a-zA-Z0-9_.-]{6,}\z",
}
LEAST_KEY = {"openai": 20, "gemini": 30, "claude": 20, "groq": 20, "deepseek": 20, "nim": 20, "gwen": 6}
LOCAL = ["ollama", "gemma"]
RETRYABLE = ["network", "timeout", "503", "429", "rate limit", "failed to fetch"]
STAGES = {"validating": (0, 5), "extracting": (5, 45), "cleaning": (45, 55), "normalizing": (55, 65), "detecting_chapters": (65, 75), "processing_text": (75, 98), "complete": (100, 100)}


def feedback(entries: DataFrame, most: int = 120) -> DataFrame:
    """(id, category, message, ts) of the newest entries that say something; other categories count as other."""
    kind = F.when(F.col("category").isin(*CATEGORIES), F.col("category")).otherwise("other")
    rows = entries.select("id", kind.alias("category"), trimmed("message").alias("message"), "ts").filter(F.length("message") >= 5)
    return rows.orderBy(F.desc("ts"), "id").limit(most)


def checkpoints(files: DataFrame, most: int = 10) -> DataFrame:
    """(key, ts) of the files seen last; a file is known by its name, size and time."""
    key = F.concat_ws(":", "name", F.col("size").cast("string"), F.col("mtime").cast("string"))
    return files.groupBy(key.alias("key")).agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), "key").limit(most)


def key_check(provider, key) -> Column:
    """ok, local, empty, characters, short, long, or format: such a key may still work."""
    k, p = trimmed(key), c(provider)
    least = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LEAST_KEY.items() for x in kv]), p), F.lit(6))
    fits = F.regexp_like(k, F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KEY_FORMATS.items() for x in kv]), p), F.lit(r"(?s)^.*\z")))
    return cases([(p.isin(*LOCAL), "local"), (k == "", "empty"), (~F.regexp_like(k, F.lit(r"^[\x21-\x7E]+\z")), "characters"), (F.length(k) < least, "short"), (F.length(k) > 512, "long"), (~fits, "format")], "ok")


def retryable(message) -> Column:
    return F.regexp_like(F.lower(c(message)), F.lit("|".join(RETRYABLE)))


def current_chapters(progress: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book, number, title): the chapter that progress names by number, else the one at that place."""
    at = Window.partitionBy("book").orderBy("number")
    rows = chapters.select("book", "number", "title", F.row_number().over(at).alias("_place"))
    now = progress.select("book", F.col("current").alias("_now"))
    found = now.join(rows, "book", "left").filter((F.col("number") == F.col("_now")) | (F.col("_place") == F.col("_now")))
    best = found.groupBy("book").agg(F.min_by(F.struct("number", "title"), (F.col("number") != F.col("_now")).cast("int")).alias("c"))
    return now.join(best, "book", "left").select("book", "c.number", "c.title")


def chapters_in_turn(chapters: DataFrame, progress: DataFrame) -> DataFrame:
    """Chapters (book, number) with the ones before and after, whether they are read, and whether it is the first unread one."""
    at = Window.partitionBy("book").orderBy("number")
    rows = chapters.select("book", "number").join(progress.select("book", "read_chapters"), "book", "left")
    read = F.coalesce(F.array_contains("read_chapters", F.col("number")), F.lit(False))
    rows = rows.select("book", "number", read.alias("read"), F.lag("number").over(at).alias("before"), F.lead("number").over(at).alias("after"))
    return rows.withColumn("first_unread", ~F.col("read") & (F.col("number") == F.min(F.when(~F.col("read"), F.col("number"))).over(Window.partitionBy("book"))))


def characters_of_books(appearances: DataFrame) -> DataFrame:
    """(book, name, places, lines) over all chapters of rows (book, chapter, pos, name): places are chapter:pos in order."""
    a = F.transform(F.array_sort(F.collect_list(F.struct("chapter", "pos"))), lambda x: F.concat_ws(":", x["chapter"].cast("string"), x["pos"].cast("string")))
    return appearances.filter(F.coalesce(F.col("name"), F.lit("")) != "").groupBy("book", "name").agg(F.array_join(a, ",").alias("places"), F.count("*").alias("lines"))


def cheapest_first(providers: DataFrame, tokens: int = 1000, pinned: str | None = None) -> DataFrame:
    """Providers with ``rank``: a pinned one first, then by cost, equal costs by name."""
    cost = F.lit(tokens) / 1000.0 * F.col("cost_per_1k")
    at = Window.orderBy((F.col("name") != F.lit(pinned)).cast("int") if pinned else F.lit(0), cost, "name")
    return providers.select("name", cost.alias("cost_usd"), F.row_number().over(at).alias("rank"))


def eligible(providers: DataFrame, allowed: DataFrame, excluded: DataFrame) -> DataFrame:
    """Providers that are allowed and not excluded, both tables of names."""
    return providers.join(allowed.select("name").distinct(), "name", "left_semi").join(excluded.select("name").distinct(), "name", "left_anti")


def merged_words(base, *groups) -> Column:
    """The words of all groups in order, each once whatever its case, without the base word."""
    words = F.filter(F.transform(F.flatten(F.array(*groups)), trimmed), lambda w: w != "")
    # sorted by their small letters, equal words stand side by side, the first met first
    keyed = F.array_sort(F.transform(words, lambda w, i: F.struct(F.lower(w).alias("low"), i.alias("i"), w.alias("w"))))
    once = let(keyed, lambda s: F.filter(s, lambda x, j: (j == 0) | (F.get(s, j - 1)["low"] != x["low"])))
    kept = F.filter(once, lambda x: x["low"] != F.lower(c(base)))
    return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(x["i"].alias("i"), x["w"].alias("w")))), lambda x: x["w"])


def scan_quality(pages: DataFrame, least: float = 60.0, key: str = "doc_id") -> DataFrame:
    """(key, scanned_share, confidence, low_pages) of pages with whether they were scanned and how sure the reading is."""
    scanned = F.col("scanned")
    sums = pages.groupBy(key).agg(F.count_if(scanned).alias("_n"), F.count("*").alias("_all"), F.sum(F.when(scanned, F.col("confidence"))).alias("_sum"), F.count_if(scanned & (F.col("confidence") < least)).alias("low_pages"))
    return sums.select(key, (F.col("_n") / F.col("_all")).alias("scanned_share"), F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n")).alias("confidence"), "low_pages")
