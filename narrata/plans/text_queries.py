"""Queries over texts, with the SQL of each: statistics, readability, sentiment, cleaning, tokens, scenes, chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, text
from ..functions.lexicon import STOP_WORDS
from ..operators import chapters, passages, scenes
from . import sql
from .fixtures import cte, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


#: Bytes of a file that are a task's work where each row is much work.
TASK_BYTES = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """An input of few splits over all cores, and over more tasks the larger it is, so that no task grows with it; one with splits enough is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = max(cores, int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // TASK_BYTES)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < max(2 * cores, wanted) else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents and the fixture passages, whose ids are negative."""
    docs = documents(spark, sf_dir)
    return docs.unionByName(table(spark, "fx_passages").withColumn("doc_id", -F.col("doc_id")))


TEXTS = f"{cte('fx_passages')}, texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT -doc_id, text FROM fx_passages)"


def line_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as paragraphs, and the fixture paragraphs, whose ids are negative."""
    lines = passages.line_rows(documents(spark, sf_dir)).select("doc_id", "pos", F.col("line").alias("text"))
    return lines.unionByName(table(spark, "fx_paragraphs").withColumn("doc_id", -F.col("doc_id")))


PARAS = f"""{cte('fx_paragraphs')}, paras AS (
  SELECT doc_id, (generate_subscripts(l, 1) - 1)::INTEGER AS pos, unnest(l) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
  UNION ALL SELECT -doc_id, pos, text FROM fx_paragraphs)"""

_N = "words"


@query(
    "text_statistics",
    rf"""WITH {TEXTS},
w AS (SELECT doc_id, coalesce(text, '') AS t, {sql.words("coalesce(text, '')")} AS w FROM texts),
b AS (SELECT doc_id, length(t) AS characters, length(regexp_replace(t, '\s', '', 'g')) AS characters_no_spaces, w, len(w) AS words,
  greatest(1, len({sql.sentences('t')})) AS sentences,
  len(list_filter(list_transform(regexp_split_to_array(t, '\n\s*\n'), lambda p: {sql.trim('p')}), lambda p: p <> '')) AS paragraphs,
  len({sql.words('''array_to_string(regexp_extract_all(t, '"([^"]*)"', 1), ' ')''')}) AS spoken,
  list_transform(w, lambda x: length(x)) AS sizes, len(list_distinct(list_transform(w, lambda x: lower(x)))) AS n_distinct FROM w)
SELECT doc_id, characters, characters_no_spaces, words, sentences::BIGINT AS sentences, paragraphs,
  {sql.rounded('words / 238.0::DOUBLE', 1)} AS reading_minutes, {sql.rounded('words / 150.0::DOUBLE', 1)} AS speaking_minutes,
  CASE WHEN words > 0 THEN {sql.rounded('list_sum(sizes)::DOUBLE / words', 1)} ELSE 0.0 END AS avg_word_length,
  {sql.rounded('words::DOUBLE / sentences', 1)} AS avg_sentence_length,
  CASE WHEN words > 0 THEN w[list_position(sizes, list_max(sizes))] ELSE '' END AS longest_word,
  CASE WHEN words > 0 THEN floor(n_distinct::DOUBLE / words * 1000.0::DOUBLE + 0.5) / 10.0::DOUBLE ELSE 0.0 END AS unique_percent,
  CASE WHEN words > 0 THEN {sql.rounded('n_distinct::DOUBLE / words', 3)} ELSE 0.0 END AS richness,
  CASE WHEN words > 0 THEN floor(spoken::DOUBLE / words * 1000.0::DOUBLE + 0.5) / 10.0::DOUBLE ELSE 0.0 END AS dialogue_percent
FROM b""",
)
def text_statistics(spark, sf_dir):
    return passages.text_statistics(texts(spark, sf_dir)).drop("thought_percent", "action_percent")


@query("thought_statistics")
def thought_statistics(spark, sf_dir):
    return passages.text_statistics(texts(spark, sf_dir)).select("doc_id", "thought_percent", "action_percent")


@query(
    "top_words",
    rf"""WITH {TEXTS},
s AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, list_transform({sql.words("coalesce(text, '')")}, lambda x: lower(x)) AS w FROM texts)),
c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first_pos FROM s WHERE length(word) > 1 AND word NOT IN ({", ".join(map(sql.q, STOP_WORDS))}) GROUP BY ALL),
r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS rank, word, n FROM c)
SELECT doc_id, rank::INTEGER AS rank, word, n FROM r WHERE rank <= 10""",
)
def top_words(spark, sf_dir):
    # not spread: they are dealt by key
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return passages.top_words(docs.unionByName(table(spark, "fx_passages").withColumn("doc_id", -F.col("doc_id"))))


def _syllables(w: str) -> str:
    x = f"regexp_replace(lower({w}), '[^a-z]', '', 'g')"
    g = f"greatest(1, len(regexp_extract_all({x}, '[aeiouy]+')))"
    return f"(CASE WHEN length({x}) <= 2 THEN 1 ELSE greatest(1, {g} - CASE WHEN {g} > 1 AND {x} LIKE '%e' AND {x} NOT LIKE '%le' THEN 1 ELSE 0 END - CASE WHEN {g} > 1 AND {x} LIKE '%ed' AND NOT regexp_matches({x}, '[dt]ed\\z') THEN 1 ELSE 0 END) END)"


_DIFFICULTY = "CASE WHEN {0} >= 90 THEN 'very_easy' WHEN {0} >= 80 THEN 'easy' WHEN {0} >= 70 THEN 'fairly_easy' WHEN {0} >= 60 THEN 'standard' WHEN {0} >= 50 THEN 'fairly_difficult' WHEN {0} >= 30 THEN 'difficult' ELSE 'very_difficult' END"


@query(
    "readability",
    rf"""WITH {TEXTS},
w AS (SELECT doc_id, {sql.words("coalesce(text, '')")} AS w, greatest(1, len({sql.sentences("coalesce(text, '')")})) AS sentences FROM texts),
s AS (SELECT *, list_transform(w, lambda x: {_syllables('x')}) AS s, greatest(1, len(w)) AS words FROM w),
a AS (SELECT *, words::DOUBLE / sentences AS ps, coalesce(list_sum(s), 0)::DOUBLE / words AS pw FROM s),
e AS (SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE, {sql.rounded('206.835::DOUBLE - 1.015::DOUBLE * ps - 84.6::DOUBLE * pw', 1)})) AS reading_ease FROM a)
SELECT doc_id, reading_ease, greatest(0.0::DOUBLE, {sql.rounded('0.39::DOUBLE * ps + 11.8::DOUBLE * pw - 15.59::DOUBLE', 1)}) AS grade,
  {sql.rounded('ps', 1)} AS words_per_sentence, {sql.rounded('pw', 2)} AS syllables_per_word,
  {sql.rounded('len(list_distinct(list_transform(w, lambda x: lower(x))))::DOUBLE / words', 3)} AS diversity, words::BIGINT AS words, sentences::BIGINT AS sentences,
  floor(len(list_filter(s, lambda x: x >= 3))::DOUBLE / words * 1000.0::DOUBLE + 0.5) / 10.0::DOUBLE AS complex_percent, {_DIFFICULTY.format('reading_ease')} AS difficulty FROM e""",
)
def readability(spark, sf_dir):
    return passages.readability(texts(spark, sf_dir))


@query(
    "syllables",
    rf"""WITH {TEXTS}, w AS (SELECT DISTINCT lower(unnest({sql.words("coalesce(text, '')")})) AS word FROM texts) SELECT word, {_syllables('word')}::INTEGER AS n FROM w""",
)
def syllables(spark, sf_dir):
    found = texts(spark, sf_dir).select(F.explode(text.words(F.coalesce("text", F.lit("")))).alias("word")).select(F.lower("word").alias("word")).distinct()
    return found.select("word", scores.syllables("word").cast("int").alias("n"))


@query("sentiment", f"WITH {TEXTS}, {sql.sentiment('texts', 'doc_id')} SELECT * FROM senti")
def sentiment(spark, sf_dir):
    return passages.passage_sentiment(texts(spark, sf_dir))


_FLOW = f"""WITH {TEXTS}, s0 AS (SELECT doc_id, {sql.sentences("coalesce(text, '')")} AS s FROM texts),
sents AS (SELECT doc_id, (generate_subscripts(s, 1) - 1)::INTEGER AS pos, unnest(s) AS text FROM s0), {sql.sentiment('sents', 'doc_id, pos')},
flow AS (SELECT doc_id, pos, score, emotion, coalesce(emotion <> lag(emotion) OVER (PARTITION BY doc_id ORDER BY pos) AND confidence > 0.05, false) AS is_shift FROM senti)"""


@query("sentence_flow", f"{_FLOW} SELECT * FROM flow")
def sentence_flow(spark, sf_dir):
    return passages.sentence_flow(texts(spark, sf_dir))


@query(
    "sentiment_flow",
    f"""{_FLOW}, c AS (SELECT doc_id, emotion, count(*) AS n, min(pos) AS first_pos FROM flow GROUP BY ALL),
d AS (SELECT doc_id, emotion AS dominant FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) = 1),
t AS (SELECT doc_id, count(*) AS sentences, count(*) FILTER (WHERE is_shift) AS shifts, {sql.rounded('max(score) - min(score)', 3)} AS emotional_range FROM flow GROUP BY doc_id)
SELECT x.doc_id, coalesce(sentences, 0) AS sentences, coalesce(shifts, 0) AS shifts, coalesce(dominant, 'neutral') AS dominant, coalesce(emotional_range, 0.0) AS emotional_range
FROM texts x LEFT JOIN t USING (doc_id) LEFT JOIN d USING (doc_id)""",
)
def sentiment_flow(spark, sf_dir):
    return passages.sentiment_flow(texts(spark, sf_dir))


@query(
    "token_counts",
    rf"""WITH {TEXTS} SELECT doc_id, len({sql.sentences("coalesce(text, '')")}) AS sentences,
  len(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^.!?]+[.!?]+(?:["'')\]]+)?|[^.!?]+\z'), lambda s: {sql.trim('s')}), lambda s: s <> '')) AS matched,
  len(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n\s*\n'), lambda p: {sql.trim('p')}), lambda p: p <> '')) AS paragraphs,
  len(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n\n+'), lambda p: {sql.trim('p')}), lambda p: p <> '')) AS paragraphs_strict,
  len(string_split(coalesce(text, ''), chr(10))) AS lines, len({sql.words("coalesce(text, '')")}) AS words,
  CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(1, ceil(length(text) / 4.0::DOUBLE))::BIGINT END AS tokens FROM texts""",
)
def token_counts(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    n = lambda x: F.size(x).cast("long")
    tokens = F.when(t == "", 0).otherwise(F.greatest(F.lit(1), F.ceil(F.length(t) / 4.0))).cast("long")
    return texts(spark, sf_dir).select("doc_id", n(text.sentences(t)).alias("sentences"), n(text.sentences_matched(t)).alias("matched"), n(text.paragraphs(t)).alias("paragraphs"), n(text.paragraphs_strict(t)).alias("paragraphs_strict"), n(text.lines(t)).alias("lines"), n(text.words(t)).alias("words"), tokens.alias("tokens"))


def _raw(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.unionByName(table(spark, "fx_raw").withColumn("doc_id", -F.col("doc_id")))


RAW = f"{cte('fx_raw')}, raw AS (SELECT doc_id, coalesce(text, '') AS t FROM documents UNION ALL SELECT -doc_id, text FROM fx_raw)"


def _replace(x: str, *steps: tuple[str, str, str]) -> str:
    for pattern, by, flags in steps:
        x = f"regexp_replace({x}, {sql.q(pattern)}, {by if by.startswith('chr(') else sql.q(by)}, '{flags}')"
    return x


_QUOTES = "regexp_replace(replace(translate(%s, '“”„‟″‶‘’‚‛′‵–—―', '\"\"\"\"\"\"''''''''''''———'), '…', '...'), '\\.{4,}', '...', 'g')"


@query("quotes_normal", f"WITH {RAW} SELECT doc_id, {_QUOTES % 't'} AS text FROM raw")
def quotes_normal(spark, sf_dir):
    return _raw(spark, sf_dir).select("doc_id", text.quotes_normal(F.coalesce("text", F.lit(""))).alias("text"))


_NL = "chr(10)"


@query(
    "spaces_normal",
    f"""WITH {RAW} SELECT doc_id, {sql.trim(_replace("replace(t, chr(160), ' ')", (chr(92) + 'r' + chr(92) + 'n|' + chr(92) + 'r', 'chr(10)', 'g'), ('[ ' + chr(92) + 't]+', ' ', 'g'), (chr(92) + 'n +', 'chr(10)', 'g'), (' +' + chr(92) + 'n', 'chr(10)', 'g'), (chr(92) + 'n{3,}', 'chr(10) || chr(10)', 'g')))} AS text,
  {sql.trim("regexp_replace(t, '" + chr(92) + "s+', ' ', 'g')")} AS one_line, regexp_replace(t, '{chr(92)}s+', '', 'g') AS canonical FROM raw""",
)
def spaces_normal(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return _raw(spark, sf_dir).select("doc_id", text.spaces_normal(t).alias("text"), text.one_line(t).alias("one_line"), text.canonical(t).alias("canonical"))


@query("extracted_normal")
def extracted_normal(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return _raw(spark, sf_dir).select("doc_id", text.extracted_normal(t).alias("text"), text.ocr_normal(t).alias("scanned"), text.merged_lines(t).alias("merged"))


@query(
    "html_text",
    r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+\z', '', 'g') AS text FROM pages""",
)
def html_text(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", text.one_line(F.regexp_replace("html", "<[^>]+>", " ")).alias("text"))


def _has(x: str, p: str) -> str:
    return f"regexp_matches({x}, {sql.q('(?i)' + chr(92) + 'b' + p + chr(92) + 'b')})"


def _first(x: str, p: str) -> str:
    return f"nullif(regexp_extract({x}, {sql.q(p)}, 1), '')"


_B = chr(92) + "b"
_MODE = f"CASE WHEN {_has('text', scenes.FLASHBACK)} THEN 'flashback' WHEN {_has('text', scenes.DREAM)} THEN 'dream' WHEN {_has('text', scenes.MEMORY)} THEN 'memory' ELSE 'normal' END"
_SCENES = f"""WITH {PARAS}, p0 AS (SELECT doc_id, pos, {sql.trim('text')} AS text FROM paras),
p1 AS (SELECT *, regexp_matches(text, {sql.q(scenes.DIVIDER)}) AS divider FROM p0 WHERE text <> ''),
p2 AS (SELECT *, sum(divider::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM p1),
p AS (SELECT * FROM p2 WHERE NOT divider), {sql.sentiment('p', 'doc_id, pos')},
f AS (SELECT p.doc_id, p.pos, p.text, p.part, lower({sql.trim(f"coalesce({_first('text', _B + scenes.PLACE_SHIFT)}, {_first('text', _B + scenes.PLACE)})")}) AS place, {_MODE} AS mode, s.score, s.confidence
  FROM p JOIN senti s ON s.doc_id = p.doc_id AND s.pos = p.pos),
l AS (SELECT *, lag(part) OVER w AS was_part, lag(place) OVER w AS was_place, lag(mode) OVER w AS was_mode, lag(score) OVER w AS was_score, lag(confidence) OVER w AS was_confidence FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
sig AS (SELECT doc_id, pos, was_part IS NULL AS opens, coalesce(was_part <> part, part > 0) AS after_divider, {_has('text', scenes.TIME_SHIFT)} AS time_shift,
  coalesce(was_place <> place, false) AS moved, regexp_matches(text, {sql.q(scenes.BREAK_SIGNALS)}) OR {_has('text', scenes.TRANSITION)} AS signal, coalesce(was_mode <> mode, false) AS mode_changed,
  coalesce(was_confidence >= 0.05 AND confidence >= 0.05 AND (abs(was_score - score) >= 0.55::DOUBLE OR (sign(was_score) <> sign(score) AND abs(was_score) >= 0.2 AND abs(score) >= 0.2)), false) AS reset FROM l)"""


@query("scenes", f"{_SCENES} SELECT doc_id, pos, sum((opens OR after_divider OR time_shift OR moved OR signal OR mode_changed OR reset)::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos)::INTEGER AS scene FROM sig")
def universal_scenes(spark, sf_dir):
    return scenes.scenes(line_texts(spark, sf_dir))


@query(
    "break_reasons",
    f"{_SCENES} SELECT doc_id, pos, CASE WHEN opens THEN 'start' WHEN after_divider THEN 'divider' WHEN time_shift THEN 'time_shift' WHEN moved THEN 'location_change' WHEN mode_changed THEN 'mode_change' WHEN reset THEN 'emotional_reset' WHEN signal THEN 'transition' ELSE 'none' END AS reason FROM sig",
)
def break_reasons(spark, sf_dir):
    return scenes.break_reasons(line_texts(spark, sf_dir))


@query(
    "narrative_labels",
    f"""WITH {PARAS} SELECT doc_id, pos, {_MODE} AS mode, {_first(sql.trim('text'), scenes.POV + _B)} AS pov,
  lower({sql.trim(f"coalesce({_first('text', _B + scenes.PLACE_SHIFT)}, {_first('text', _B + scenes.PLACE)})")}) AS place FROM paras""",
)
def narrative_labels(spark, sf_dir):
    return line_texts(spark, sf_dir).select("doc_id", "pos", scenes.narrative_mode("text").alias("mode"), scenes.point_of_view("text").alias("pov"), scenes.place_hint("text").alias("place"))


@query(
    "scene_texts",
    f"""{_SCENES}, n AS (SELECT doc_id, pos, sum((opens OR after_divider OR time_shift OR moved OR signal OR mode_changed OR reset)::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos)::INTEGER AS scene FROM sig)
SELECT n.doc_id, n.scene, count(*) AS paragraphs, string_agg({sql.trim('x.text')}, chr(10) || chr(10) ORDER BY n.pos) AS text FROM n JOIN paras x ON x.doc_id = n.doc_id AND x.pos = n.pos GROUP BY ALL""",
)
def scene_texts(spark, sf_dir):
    p = line_texts(spark, sf_dir)
    return scenes.scene_texts(p, scenes.scenes(p))


@query("scene_titles")
def scene_titles(spark, sf_dir):
    p = line_texts(spark, sf_dir)
    return scenes.scene_titles(p, scenes.scenes(p))


def _multi(spark):
    """Fixture paragraphs as texts with blank lines."""
    p = table(spark, "fx_paragraphs")
    sep = F.when(F.col("pos") % 4 == 3, "\n\n\n").otherwise("\n\n")
    return p.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat("text", sep).alias("t")))), lambda x: x["t"]), "").alias("text"))


@query(
    "layout_scenes",
    rf"""WITH {cte('fx_paragraphs')},
u AS (SELECT doc_id, pos, {sql.trim('text')} AS text, CASE WHEN pos % 4 = 3 THEN 3 ELSE 2 END AS nl, sum(CASE WHEN {sql.trim('text')} = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS blanks FROM fx_paragraphs),
v AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INTEGER AS pos, text, pos AS old, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM u WHERE text <> ''),
g AS (SELECT v.*, CASE WHEN nxt IS NULL THEN 0 ELSE (SELECT sum(nl) FROM u WHERE u.doc_id = v.doc_id AND u.pos >= v.old AND u.pos < v.nxt) END AS gap FROM v),
d AS (SELECT *, regexp_matches(text, {sql.q(scenes.LAYOUT_DIVIDER)}) AS divider, coalesce(lag(gap) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS was_gap FROM g),
e AS (SELECT *, sum(divider::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM d),
f AS (SELECT *, lag(part) OVER (PARTITION BY doc_id ORDER BY pos) AS was_part, lower({sql.trim(_first('text', '(?i)' + _B + scenes.LAYOUT_PLACE))}) AS place FROM e WHERE NOT divider),
h AS (SELECT *, was_part IS NULL OR was_part <> part OR was_gap >= 3 OR {_has('text', scenes.LAYOUT_TIME)} AS hard FROM f),
s AS (SELECT *, sum(hard::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS stretch FROM h),
m AS (SELECT *, coalesce(place <> last_value(place IGNORE NULLS) OVER (PARTITION BY doc_id, stretch ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS moved FROM s)
SELECT doc_id, pos, sum((hard OR moved)::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos)::INTEGER AS scene FROM m""",
)
def layout_scenes(spark, sf_dir):
    return scenes.layout_scenes(_multi(spark))


@query("chapters")
def book_chapters(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return chapters.chapters(docs.unionByName(table(spark, "fx_books").withColumn("doc_id", -F.col("doc_id"))))
