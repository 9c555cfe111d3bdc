"""Measures of passages: statistics, readability, sentiment and its flow. Row-local but for rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import STOP_WORDS
from ..functions.scores import difficulty, sentiment, syllables, syllables_in
from ..functions.text import clamp, letters, lines, paragraphs, rounded, sentences, split_words, words


def _words_in(text: str, pattern: str) -> Column:
    """Words inside the first group of all matches."""
    return F.size(words(F.array_join(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)), " ")))


def text_statistics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a text: counts, times, averages, longest word, shares of dialogue and thoughts, vocabulary."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = df.select(
        key,
        F.length(t).cast("long").alias("characters"),
        F.length(F.regexp_replace(t, r"\s", "")).cast("long").alias("characters_no_spaces"),
        words(t).alias("_w"),
        F.greatest(F.lit(1), F.size(sentences(t))).cast("long").alias("sentences"),
        F.size(paragraphs(t)).cast("long").alias("paragraphs"),
        _words_in(text, r'"([^"]*)"').alias("_spoken"),
        (_words_in(text, r"(?<!\w)\*([^*]+)\*(?!\w)") + _words_in(text, r"(?<!\w)_([^_]+)_(?!\w)")).alias("_thought"),
    ).withColumns({"words": F.size("_w").cast("long"), "_size": F.transform("_w", F.length), "_distinct": F.size(F.array_distinct(F.transform("_w", F.lower))).cast("long")})
    n = F.col("words")
    share = lambda x, k: F.when(n > 0, rounded(x / n * (100.0 if k == 1 else 1.0), k)).otherwise(0.0)
    dialogue = F.when(n > 0, F.floor(F.col("_spoken") / n * 1000.0 + 0.5) / 10.0).otherwise(0.0)
    thought = F.when(n > 0, F.floor(F.col("_thought") / n * 1000.0 + 0.5) / 10.0).otherwise(0.0)
    return base.select(
        key,
        "characters",
        "characters_no_spaces",
        "words",
        "sentences",
        "paragraphs",
        rounded(n / 238.0, 1).alias("reading_minutes"),
        rounded(n / 150.0, 1).alias("speaking_minutes"),
        F.when(n > 0, rounded(F.aggregate("_size", F.lit(0), lambda a, x: a + x) / n, 1)).otherwise(0.0).alias("avg_word_length"),
        rounded(n / F.col("sentences"), 1).alias("avg_sentence_length"),
        F.when(n > 0, F.get("_w", (F.array_position("_size", F.array_max("_size")) - 1).cast("int"))).otherwise("").alias("longest_word"),
        F.when(n > 0, F.floor(F.col("_distinct") / n * 1000.0 + 0.5) / 10.0).otherwise(0.0).alias("unique_percent"),
        share(F.col("_distinct"), 3).alias("richness"),
        dialogue.alias("dialogue_percent"),
        thought.alias("thought_percent"),
        F.when(n > 0, clamp(rounded(100.0 - dialogue - thought, 1), 0.0, 100.0)).otherwise(0.0).alias("action_percent"),
    )


def top_words(df: DataFrame, n: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The n most frequent words of each text without stop words; of equal ones the first seen. Texts are dealt by key, so that their words are not."""
    seen = df.repartition(F.col(key)).select(key, F.posexplode(F.transform(words(F.coalesce(F.col(text), F.lit(""))), F.lower)).alias("pos", "word")).filter((F.length("word") > 1) & ~F.col("word").isin(*STOP_WORDS))
    counted = seen.groupBy(key, "word").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    at = Window.partitionBy(key).orderBy(F.desc("n"), "first_pos")
    return counted.withColumn("rank", F.row_number().over(at)).filter(F.col("rank") <= n).select(key, "rank", "word", "n")


def readability(df: DataFrame, key: str = "doc_id", text: str = "text", keep=()) -> DataFrame:
    """Reading ease, grade level, averages, vocabulary and complex words of each text, beside the columns to keep."""
    t = F.coalesce(F.col(text), F.lit(""))
    w = df.select(key, *keep, letters(t).alias("_b"), F.greatest(F.lit(1), F.size(sentences(t))).cast("long").alias("sentences"))
    w = w.withColumns({"_w": split_words("_b"), "_more": syllables_in("_b")})
    w = w.withColumn("_s", F.transform("_w", syllables)).withColumn("words", F.greatest(F.lit(1), F.size("_w")).cast("long"))
    per_sentence, per_word = F.col("words") / F.col("sentences"), (F.size("_w") + F.col("_more")) / F.col("words")
    ease = clamp(rounded(206.835 - 1.015 * per_sentence - 84.6 * per_word, 1), 0.0, 100.0)
    return w.select(
        key,
        *keep,
        ease.alias("reading_ease"),
        F.greatest(F.lit(0.0), rounded(0.39 * per_sentence + 11.8 * per_word - 15.59, 1)).alias("grade"),
        rounded(per_sentence, 1).alias("words_per_sentence"),
        rounded(per_word, 2).alias("syllables_per_word"),
        rounded(F.size(F.array_distinct(F.transform("_w", F.lower))) / F.col("words"), 3).alias("diversity"),
        "words",
        "sentences",
        (F.floor(F.size(F.filter("_s", lambda x: x >= 3)) / F.col("words") * 1000.0 + 0.5) / 10.0).alias("complex_percent"),
        difficulty(ease).alias("difficulty"),
    )


def passage_sentiment(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """score, raw_score, hits, emotion and confidence of each text."""
    return df.select(key, sentiment(F.coalesce(F.col(text), F.lit(""))).alias("_s")).select(key, "_s.*")


def sentence_flow(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a sentence: its sentiment, and whether its emotion differs from the sentence before."""
    s = df.select(key, F.transform(sentences(F.coalesce(F.col(text), F.lit(""))), sentiment).alias("_s"))
    shifted = F.transform("_s", lambda x, i: F.struct(x["score"].alias("score"), x["emotion"].alias("emotion"), ((i > 0) & (x["emotion"] != F.get("_s", i - 1)["emotion"]) & (x["confidence"] > 0.05)).alias("is_shift")))
    return s.select(key, F.posexplode(shifted).alias("pos", "_x")).select(key, "pos", "_x.score", "_x.emotion", F.coalesce("_x.is_shift", F.lit(False)).alias("is_shift"))


def dominant(df: DataFrame, keys: list[str], value: str, pos: str, name: str = "dominant") -> DataFrame:
    """The most frequent value of each group; of equal ones the first met."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(pos).alias("_first"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("_n"), -F.col("_first"))).alias(name))


def sentiment_flow(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shifts, dominant emotion and range of sentiment over the sentences of each text."""
    flow = sentence_flow(df, key, text)
    counted = flow.groupBy(key, "emotion").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.count_if("is_shift").alias("shifts"), F.min("score").alias("low"), F.max("score").alias("high"))
    out = counted.groupBy(key).agg(F.sum("n").alias("sentences"), F.sum("shifts").alias("shifts"), F.max_by("emotion", F.struct(F.col("n"), -F.col("first"))).alias("dominant"), rounded(F.max("high") - F.min("low"), 3).alias("emotional_range"))
    empty = df.select(key).join(out, key, "left")
    return empty.select(key, *[F.coalesce(c, F.lit(d)).alias(c) for c, d in (("sentences", 0), ("shifts", 0), ("dominant", "neutral"), ("emotional_range", 0.0))])


def line_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line) of each text."""
    return df.select(key, F.posexplode(lines(F.coalesce(F.col(text), F.lit("")))).alias("pos", "line"))
