"""Book tables: upserts, latest rows, chapters by book, migration, and export as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import cases
from ..functions.text import paragraphs


def upserted(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Stored rows without those that the new rows replace, and the new rows."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def deleted(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return stored.join(keys.select(key), key, "left_anti")


def latest_by(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """The newest row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), ts).alias("_r")).select(key, "_r.*")


def listed(books: DataFrame) -> DataFrame:
    """Books, the last changed first."""
    return books.orderBy(F.coalesce("updated_at", "created_at").desc(), "book")


def grouped_chapters(chapters: DataFrame, key: str = "book") -> DataFrame:
    """(book, chapters in order of their numbers, words, processed, status)."""
    out = chapters.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("number", "title", "word_count"))).alias("chapters"), F.sum("word_count").alias("words"), F.count_if("is_processed").alias("processed"), F.count("*").alias("total"))
    status = cases([(F.col("processed") == F.col("total"), "ready"), (F.col("processed") > 0, "processing")], "pending")
    return out.withColumn("status", status)


def migrated(books: DataFrame, **defaults) -> DataFrame:
    """Books of an earlier version with the columns and defaults of this one."""
    for name, value in defaults.items():
        books = books.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in books.columns else F.lit(value))
    return books


def block_prefix() -> Column:
    camera = F.when(F.col("camera") != "", F.concat(F.lit("["), F.col("camera"), F.lit("]"))).otherwise("")
    speaker = F.when(F.col("speaker") != "", F.concat(F.lit("["), F.col("speaker"), F.lit("]"))).otherwise("")
    k = F.col("type")
    return cases([(k == "dialogue", speaker), (k == "sfx", "[SFX]"), (k == "beat", "[BEAT]"), (k == "transition", "[TRANSITION]"), (k.isin("chapter_header", "title_card"), "")], F.coalesce(camera, F.lit("")))


def export_blocks(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): blocks with their prefixes, each followed by a blank line."""
    line = F.trim(F.concat(F.coalesce(block_prefix(), F.lit("")), F.lit(" "), F.coalesce("content", F.lit(""))))
    rows = blocks.select(key, "pos", line.alias("line"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n\n").alias("text"))


def export_chapters(chapters: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): chapters (number, title, content) under rules with their titles, paragraphs parted by blank lines."""
    one = F.concat(F.lit("─── "), F.col("title"), F.lit(" ───\n\n"), F.array_join(paragraphs("content"), "\n\n"))
    return chapters.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter", one.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def chosen_chapters(chapters: DataFrame, wanted: list[int], key: str = "book") -> DataFrame:
    """Chapters at the wanted places (from 0), all if none is wanted; places without a chapter are ignored."""
    at = Window.partitionBy(key).orderBy("number")
    rows = chapters.withColumn("_i", F.row_number().over(at) - 1)
    return (rows.filter(F.col("_i").isin(*wanted)) if wanted else rows).drop("_i")


def write_texts(exported: DataFrame, path: str) -> None:
    """Writes exported texts as text files, one a partition."""
    exported.select("text").write.mode("overwrite").text(path)
