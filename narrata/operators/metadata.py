"""Book metadata from several sources: one record a title, genres by keyword, distinct names, word lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import c, trimmed

#: Keywords of genres and story formats, in order of priority. Fixed values.
GENRES = {
    "fantasy": ["fantasy", "dragon", "magic", "myth", "sorcery"], "romance": ["romance", "love story", "courtship"], "thriller": ["thriller", "suspense", "spy", "conspiracy"],
    "sci_fi": ["science fiction", "sci-fi", "space", "robot", "dystopia"], "mystery": ["mystery", "detective", "crime", "whodunit"], "historical": ["historical", "history", "war", "victorian"],
    "literary_fiction": ["literary", "classic", "character study"], "horror": ["horror", "ghost", "haunted", "supernatural terror"], "adventure": ["adventure", "quest", "expedition", "journey"],
}
FORMATS = {"manhwa": ["manhwa", "webtoon", "korean comic", "k-comic"], "manhua": ["manhua", "chinese comic", "hua man", "dongman"], "manga": ["manga", "shonen", "shoujo", "shojo", "seinen", "josei"], "novel": ["novel", "literature", "prose"]}


def title_key(t) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(F.lower(c(t)), r"[^a-z0-9\s]", " "), r"\s+", " "))


def distinct_names(values: Column) -> Column:
    """Trimmed values without blanks and without later ones that differ in case only."""
    v = F.filter(F.transform(values, trimmed), lambda x: x != "")
    return F.filter(v, lambda x, i: ~F.exists(F.slice(v, F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))


def _any_of(values: Column, pattern: str) -> Column:
    return F.exists(values, lambda s: F.regexp_like(s, F.lit(pattern)))


def _sum_over(values: Column, keys: list[str], count) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, s: a + count(s, keys))


def genre(subjects: Column) -> Column:
    """The first genre that a subject holds a keyword of, or null."""
    low = F.transform(subjects, lambda s: F.lower(s))
    out = None
    for name, keys in GENRES.items():
        hit = _any_of(low, "|".join(keys))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def story_format(subjects: Column) -> Column:
    """The format with the most keyword hits; unknown without hits or with a tie."""
    low = F.transform(subjects, lambda s: F.lower(s))
    count = lambda s, keys: sum((F.contains(s, F.lit(k)).cast("int") for k in keys[1:]), F.contains(s, F.lit(keys[0])).cast("int"))
    hits = F.array(*[F.struct(_sum_over(low, keys, count).alias("n"), F.lit(name).alias("name")) for name, keys in FORMATS.items()])
    most = F.array_max(F.transform(hits, lambda x: x["n"]))
    best = F.filter(hits, lambda x: x["n"] == most)
    return F.when((most > 0) & (F.size(best) == 1), best[0]["name"]).otherwise("unknown")


def merged(records: DataFrame, key: str = "title_key") -> DataFrame:
    """One record a key from (title, author, description, subjects, priority): the first filled field by priority, the longest description."""
    filled = lambda n: F.min_by(F.when(F.trim(F.col(n)) != "", F.col(n)), F.when(F.trim(F.col(n)) != "", F.col("priority")))
    longest = F.max_by("description", F.struct(F.length("description"), -F.col("priority")))
    out = records.groupBy(key).agg(filled("title").alias("title"), filled("author").alias("author"), longest.alias("description"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("priority", "subjects"))), lambda x: x["subjects"])).alias("_s"), F.count("*").alias("sources"))
    names = distinct_names(F.col("_s"))
    return out.select(key, "title", "author", "description", names.alias("subjects"), genre(names).alias("genre"), story_format(names).alias("story_format"), "sources")


def best_match(candidates: DataFrame, key: str = "query", title: str = "title", pos: str = "pos") -> DataFrame:
    """Of each query's candidates the one whose title equals it, else the first."""
    at = Window.partitionBy(key).orderBy((title_key(title) == title_key(key)).desc(), pos)
    return candidates.withColumn("_n", F.row_number().over(at)).filter("_n = 1").drop("_n")


def completions(vocabulary: DataFrame, prefix: str, n: int = 8, word: str = "word") -> DataFrame:
    """Words that go on from a prefix of two letters or more, the most frequent first."""
    p = prefix.lower()
    if len(p) < 2:
        return vocabulary.limit(0)
    return vocabulary.filter(F.col(word).startswith(p) & (F.col(word) != p)).orderBy(F.desc("n"), word).limit(n)


def toggled(values: Column, x) -> Column:
    """An array with a value added if it lacks it, else without it."""
    return F.when(F.array_contains(values, x), F.array_remove(values, x)).otherwise(F.array_append(values, x))


def recent_words(events: DataFrame, key: str, word: str, ts: str, n: int = 8) -> DataFrame:
    """The n words looked up last by each reader, whatever their case."""
    last = events.groupBy(key, F.lower(word).alias("word")).agg(F.max(ts).alias("last_ts"))
    at = Window.partitionBy(key).orderBy(F.desc("last_ts"), "word")
    return last.withColumn("rank", F.row_number().over(at)).filter(F.col("rank") <= n)


#: What a dictionary service answers: an array of entries.
ENTRIES = "array<struct<word:string,phonetic:string,meanings:array<struct<partOfSpeech:string,definitions:array<struct<definition:string,example:string>>>>>>"


def definitions(answers: DataFrame, most: int = 6, word: str = "word", json: str = "json") -> DataFrame:
    """(word, rank, part, definition, example): the first ``most`` definitions of dictionary answers; what is no answer gives none."""
    entries = F.from_json(F.col(json), ENTRIES)
    each = lambda m: F.transform(F.coalesce(m["definitions"], F.array().cast("array<struct<definition:string,example:string>>")), lambda d: F.struct(m["partOfSpeech"].alias("part"), d["definition"].alias("definition"), d["example"].alias("example")))
    flat = F.flatten(F.transform(F.flatten(F.transform(entries, lambda e: e["meanings"])), each))
    fine = F.slice(F.filter(flat, lambda d: d["definition"].isNotNull() & (d["definition"] != "")), 1, most)
    return answers.select(word, F.posexplode(fine).alias("i", "d")).select(word, (F.col("i") + 1).alias("rank"), "d.*")


def first_sentence(value) -> Column:
    """The first sentence of a field that is text, an array of texts, or an object with a text under value."""
    v = F.try_parse_json(c(value))
    text = F.coalesce(F.try_variant_get(v, "$.value", "string"), F.try_variant_get(v, "$[0]", "string"), F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.when(v.isNull(), c(value)))
    return F.nullif(trimmed(F.regexp_extract(trimmed(text), r"(?s)^(.*?[.!?])(?:\s|\z)|^(.*)", 0)), F.lit(""))


def subjects_of(description) -> Column:
    """The parts between commas, semicolons and slashes."""
    return distinct_names(F.split(F.coalesce(c(description), F.lit("")), "[,;/]"))
