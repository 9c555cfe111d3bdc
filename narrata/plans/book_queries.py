"""Queries over books, files, pages, dialogue and streams, with the SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions.scores import sentiment
from ..operators import chapters, dialogue, ingest, markup, metadata, pacing, passages, plain, requests, scenes, staging
from ..sources import books, files, positioned
from ..streaming import events as streams
from . import sql
from .block_queries import BLOCKS, blocks
from .fixtures import cte, table
from .text_queries import PARAS, TEXTS, documents, line_texts, texts

QUERIES: dict = {}
SQL: dict[str, str] = {}
_B = chr(92) + "b"


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def _q(p: str) -> str:
    """A pattern of ours for RE2: word boundaries instead of look-arounds."""
    return sql.q(p.replace(scenes.L, _B).replace(scenes.R, _B))


_PATHS = [("/a/book.PDF", 10, None), ("/a/b.epub", 5, None), ("/a/c.doc", 5, None), ("/a/d.txt", 0, None), ("/a/e.docx", 60 << 20, None), ("/a/noext", 7, "text/plain"), ("/a/x.zip", 7, None), (" ", 3, None), ("/a/s.pptx", 9, None), ("/a/v.1/none", 3, "application/pdf")]
_PATH_ROWS = ", ".join(f"({sql.q(p)}, {n}, {sql.q(m) if m else 'NULL'})" for p, n, m in _PATHS)


@query(
    "file_gates",
    rf"""WITH g(path, length, mime) AS (VALUES {_PATH_ROWS}), f AS (SELECT path, length::BIGINT AS length, mime FROM g UNION ALL SELECT url || (['.txt', '.pdf', '.doc', '', '.xyz'])[page_id % 5 + 1], length(html)::BIGINT * (page_id % 3) * 9000, CASE WHEN page_id % 2 = 0 THEN 'text/plain' END FROM pages), e AS (SELECT *, lower(regexp_extract(path, '\.([^./]*)\z', 1)) AS ext FROM f),
k AS (SELECT *, coalesce(CASE WHEN ext IN ('pdf', 'epub', 'docx', 'pptx', 'txt') THEN ext END, CASE mime WHEN 'application/pdf' THEN 'pdf' WHEN 'text/plain' THEN 'txt' END) AS format FROM e)
SELECT path, coalesce(format, '') AS format, CASE WHEN trim(path) = '' OR length <= 0 THEN 'FILE_EMPTY' WHEN length > 52428800 THEN 'FILE_TOO_LARGE' WHEN ext IN ('doc', 'ppt', 'xls') THEN 'LEGACY_FORMAT' WHEN format IS NULL THEN 'UNSUPPORTED_FORMAT' ELSE '' END AS refused FROM k""",
)
def file_gates(spark, sf_dir):
    """Pages as files by their addresses, and known paths."""
    i = F.col("page_id")
    name = F.concat("url", F.get(F.lit([".txt", ".pdf", ".doc", "", ".xyz"]), (i % 5).cast("int")))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(name.alias("path"), (F.length("html").cast("long") * (i % 3) * 9000).alias("length"), F.when(i % 2 == 0, "text/plain").alias("mime"))
    rows = pages.unionByName(spark.createDataFrame(_PATHS, "path string, length long, mime string"))
    return rows.select("path", F.coalesce(files.file_format("path", "mime"), F.lit("")).alias("format"), F.coalesce(files.file_gate("path", "length", "mime"), F.lit("")).alias("refused"))


@query(
    "text_gates",
    rf"""WITH {TEXTS}, x AS (SELECT doc_id, text, {sql.trim("coalesce(text, '')")} AS t FROM texts)
SELECT doc_id, CASE WHEN text IS NULL OR length(t) < 100 THEN 'TOO_SHORT' WHEN len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')) < 20 THEN 'TOO_FEW_WORDS' ELSE '' END AS refused FROM x""",
)
def text_gates(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.coalesce(ingest.text_gate("text"), F.lit("")).alias("refused"))


_MESSAGES = ["File is too large (60 MB)", "Legacy .doc format", "Unsupported thing", "image-only PDF found", "bad xref table", "3 damaged pages", "password needed", "Corrupted archive", "OCR gave up", "who knows", "Invalid EPUB: missing"]


@query(
    "error_codes",
    f"WITH f(message) AS (VALUES {', '.join(f'({sql.q(m)})' for m in _MESSAGES)}), m AS (SELECT message FROM f UNION ALL SELECT text FROM documents WHERE text IS NOT NULL), c AS (SELECT message, CASE "
    + " ".join(f"WHEN regexp_matches(lower(message), {sql.q(p)}) THEN '{code}'" for p, code, _ in ingest.ERRORS)
    + f" ELSE 'UNKNOWN_ERROR' END AS code FROM m) SELECT md5(message) AS message, code, code NOT IN ({', '.join(sql.q(code) for _, code, ok in ingest.ERRORS if not ok)}) AS recoverable FROM c",
)
def error_codes(spark, sf_dir):
    """Whole texts of documents as messages, and known ones."""
    texts_ = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null").select(F.col("text").alias("message"))
    rows = texts_.unionByName(spark.createDataFrame([(m,) for m in _MESSAGES], "message string")).withColumn("code", ingest.error_code("message"))
    return rows.select(F.md5(F.encode("message", "UTF-8")).alias("message"), "code", ingest.recoverable("code").alias("recoverable"))


@query(
    "secure_endpoints",
    r"""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host FROM pages)
SELECT page_id, scheme, host, coalesce(scheme = 'https' OR (scheme = 'http' AND (host IN ('localhost', '127.0.0.1', '::1') OR host LIKE '%.local' OR regexp_matches(host, '^(10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)'))), false) AS secure FROM p""",
)
def secure_endpoints(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    part = lambda x: F.lower(F.try_parse_url("url", F.lit(x)))
    return p.select("page_id", part("PROTOCOL").alias("scheme"), part("HOST").alias("host"), ingest.secure_endpoint("url", local=True).alias("secure"))


_TITLES = ["The Dragon War", " the dragon war ", "A Space Quest!", "A Love Story", "Plain"]
_META = [
    ("The Dragon War", "Reed", "short", ["Fantasy", "fantasy", "Novel"], 1), ("the dragon war", "", "a longer description", ["war", "Magic"], 2), ("A Space Quest!", None, None, ["Robot", "manga", "shonen"], 3),
    ("A space quest", "Vale", "x", ["Adventure"], 1), ("Plain", "", "", ["cookery"], 4), ("Plain", "Noor", "y", [" ", "Cookery"], 2),
]


@query("merged_metadata")
def merged_metadata(spark, sf_dir):
    rows = spark.createDataFrame(_META, "title string, author string, description string, subjects array<string>, priority int")
    return metadata.merged(rows.withColumn("title_key", metadata.title_key("title"))).withColumn("subjects", F.array_join("subjects", "|"))


@query("title_keys", rf"SELECT page_id, {sql.trim(chr(114) + 'egexp_replace(regexp_replace(lower(html), ' + sql.q('[^a-z0-9' + chr(92) + 's]') + ', ' + sql.q(' ') + ', ' + sql.q('g') + '), ' + sql.q(chr(92) + 's+') + ', ' + sql.q(' ') + ', ' + sql.q('g') + ')')} AS key FROM pages")
def title_keys(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", metadata.title_key("html").alias("key"))


@query(
    "dialogue_fragments",
)
def dialogue_fragments(spark, sf_dir):
    return dialogue.fragments(texts(spark, sf_dir))


@query("structured_dialogue")
def structured_dialogue(spark, sf_dir):
    return dialogue.structured(texts(spark, sf_dir))


_EASE = "greatest(0.0::DOUBLE, least(100.0::DOUBLE, floor((206.835::DOUBLE - 1.015::DOUBLE * (w / s::DOUBLE) - 84.6::DOUBLE * (y::DOUBLE / w)) * 10.0::DOUBLE + 0.5) / 10.0::DOUBLE))"


def _scene_sql() -> str:
    from .text_queries import _syllables

    words, sents = sql.words("t"), sql.sentences("t")
    n = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> ''))"
    return rf"""WITH {TEXTS}, {sql.sentiment('texts', 'doc_id')},
a AS (SELECT doc_id, coalesce(text, '') AS t FROM texts),
b AS (SELECT doc_id, t, {n.format('t')} AS words, len({sents}) AS sentences, list_filter(list_transform(string_split(t, chr(10)), lambda l: {sql.trim('l')}), lambda l: l <> '') AS ls,
  greatest(1, len({words})) AS w, greatest(1, len({sents})) AS s, coalesce(list_sum(list_transform({words}, lambda x: {_syllables('x')})), 0) AS y FROM a),
d AS (SELECT *, len(list_filter(ls, lambda l: regexp_matches(l, {sql.q(dialogue.DIALOGUE_LINE)}))) AS dialogue_lines, len(list_filter(ls, lambda l: {n.format('l')} <= 6)) AS short_lines FROM b),
scene AS (SELECT d.doc_id, d.w::BIGINT AS words, d.s::BIGINT AS sentences, d.dialogue_lines, d.short_lines, {_EASE} AS reading_ease,
  floor(greatest(0, least(100, len(regexp_extract_all(t, {_q('(?i)' + _B + dialogue.TENSION_CUES + _B)})) * 14 + (length(t) - length(replace(t, '!', ''))) * 4 + abs(senti.score) * 35 + short_lines * 3)) + 0.5)::BIGINT AS tension,
  abs(senti.score) AS charge, CASE WHEN len(ls) > 0 THEN dialogue_lines::DOUBLE / len(ls) ELSE 0.0 END AS dialogue_ratio FROM d JOIN senti USING (doc_id))"""


@query("scene_analysis", f"{_scene_sql()} SELECT * FROM scene")
def scene_analysis(spark, sf_dir):
    return dialogue.analysis(texts(spark, sf_dir))


@query(
    "cues",
    f"""{_scene_sql()} SELECT s.doc_id, CASE WHEN tension >= 75 THEN 'HANDHELD CLOSE' WHEN dialogue_ratio >= 0.45 THEN 'OVER THE SHOULDER' WHEN reading_ease < 45 THEN 'PUSH IN' WHEN tension <= 25 THEN 'WIDE ESTABLISHING' ELSE 'MEDIUM TRACKING' END AS camera,
  CASE {" ".join(f"WHEN regexp_matches(t, {_q('(?i)' + p)}) THEN '{name}'" for p, name in dialogue.SFX)} ELSE '' END AS sound, CASE {" ".join(f"WHEN regexp_matches(t, {_q('(?i)' + p)}) THEN '{name}'" for p, name in dialogue.AMBIENCE)} ELSE '' END AS ambience
FROM scene s JOIN a USING (doc_id)""",
)
def cues(spark, sf_dir):
    label = lambda t: F.coalesce(dialogue.labelled(F.coalesce("text", F.lit("")), t), F.lit(""))
    rows = texts(spark, sf_dir).withColumns({"sound": label(dialogue.SFX), "ambience": label(dialogue.AMBIENCE)})
    a = dialogue.analysis(rows, keep=["sound", "ambience"])
    return a.select("doc_id", dialogue.camera_cue("tension", "dialogue_ratio", "reading_ease").alias("camera"), "sound", "ambience")


@query(
    "transition_cues",
    f"""{_scene_sql()}, o AS (SELECT doc_id % 10 AS part, doc_id AS scene, tension, charge, lag(tension) OVER w AS t0, lag(charge) OVER w AS c0 FROM scene WINDOW w AS (PARTITION BY doc_id % 10 ORDER BY doc_id))
SELECT scene, CASE WHEN t0 IS NULL THEN '' WHEN tension - t0 >= 18 THEN 'SMASH CUT' WHEN tension - t0 <= -24 THEN 'FADE TO BLACK' WHEN abs(charge - c0) >= 0.35::DOUBLE THEN 'DISSOLVE TO' ELSE 'CUT TO' END AS transition FROM o""",
)
def transition_cues(spark, sf_dir):
    a = dialogue.analysis(texts(spark, sf_dir)).withColumn("part", F.col("doc_id") % 10)
    return dialogue.transition_cues(a, "part", "doc_id").select(F.col("doc_id").alias("scene"), F.coalesce("transition", F.lit("")).alias("transition"))


@query("checked_outputs")
def checked_outputs(spark, sf_dir):
    return dialogue.checked(texts(spark, sf_dir))


@query(
    "line_kinds",
    rf"""WITH {PARAS}, l AS (SELECT doc_id, pos, text, {sql.trim('text')} AS t FROM paras)
SELECT doc_id, pos, length(t) BETWEEN 2 AND 120 AND len(regexp_extract_all(t, '[A-Z]')) >= 2 AND regexp_matches(t, '^[A-Z][A-Z\d\s:.,!?''-]+\z') AS capitals,
  t <> '' AND regexp_matches(t, '^M{{0,3}}(CM|CD|D?C{{0,3}})(XC|XL|L?X{{0,3}})(IX|IV|V?I{{0,3}})\z') AS roman,
  t <> '' AND (len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')) <= 5 OR regexp_matches(t, '[!?]\z') OR regexp_matches(t, {sql.q('(?i)' + _B + dialogue.TENSION_CUES + _B)}) OR regexp_matches(t, '^[A-Z][A-Z\s,''".!?-]+\z')) AS dramatic FROM l""",
)
def line_kinds(spark, sf_dir):
    return line_texts(spark, sf_dir).select("doc_id", "pos", dialogue.is_capitals("text").alias("capitals"), dialogue.is_roman("text").alias("roman"), dialogue.is_dramatic("text").alias("dramatic"))


@query(
    "verse",
    rf"""WITH {TEXTS}, l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {sql.trim('x')}), lambda x: x <> '') AS ls FROM texts)
SELECT doc_id, len(ls) >= 2 AND len(list_filter(ls, lambda x: length(x) <= 60))::DOUBLE / greatest(1, len(ls)) >= 0.75 AND len(list_filter(ls, lambda x: NOT regexp_matches(x, '[.!?]\z')))::DOUBLE / greatest(1, len(ls)) >= 0.5 AS verse FROM l""",
)
def verse(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.coalesce(dialogue.is_verse(F.coalesce("text", F.lit(""))), F.lit(False)).alias("verse"))


@query("titles")
def titles(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return dialogue.titles(docs.unionByName(table(spark, "fx_books").withColumn("doc_id", -F.col("doc_id"))))


@query("careful_sentences")
def careful_sentences(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.posexplode(fx.sentences_careful(F.coalesce("text", F.lit("")))).alias("pos", "sentence"))


@query("rebuilt_paragraphs")
def rebuilt_paragraphs(spark, sf_dir):
    return staging.rebuilt_texts(texts(spark, sf_dir))


@query("staged_scenes")
def staged_scenes(spark, sf_dir):
    """Turns of conversations as texts, and the fixture's, whose ids are negative."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("doc_id"), "text")
    known = table(spark, "fx_passages").unionByName(_joined_paragraphs(spark))
    return staging.staged(turns.unionByName(known.withColumn("doc_id", -F.col("doc_id"))))


def _joined_paragraphs(spark):
    p = table(spark, "fx_paragraphs")
    return p.groupBy((F.col("doc_id") + 100).alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


@query("plain_blocks")
def plain_blocks(spark, sf_dir):
    return plain.plain_blocks(texts(spark, sf_dir).unionByName(_joined_paragraphs(spark)))


@query(
    "paragraph_moods",
    rf"""WITH {PARAS}, s AS (SELECT doc_id, pos, coalesce(text, '') AS p, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1)), lambda x: {sql.trim('x')} <> '') AS s FROM paras),
n AS (SELECT doc_id, pos, p, len(s) AS n, list_transform(s, lambda x: len(regexp_split_to_array(x, '\s+'))) AS w FROM s),
k AS (SELECT doc_id, pos, CASE WHEN len(regexp_extract_all(p, '\?')) >= 2 THEN 1 WHEN n >= 2 AND len(list_filter(w, lambda x: x < 5)) >= 2 AND len(list_filter(w, lambda x: x < 5)) >= n * 0.5 THEN 2 WHEN len(list_filter(w, lambda x: x > 30)) > 0 THEN 3 WHEN contains(p, '!') THEN 4 WHEN contains(p, '...') OR contains(p, '…') THEN 5 ELSE 6 END AS k FROM n)
SELECT doc_id, pos, (['normal', 'emphasis', 'normal', 'emphasis', 'whisper', 'normal'])[k] AS intensity, (['normal', 'rapid', 'slow', NULL, NULL, NULL])[k] AS timing, CASE WHEN k = 1 THEN 'suspense' END AS emotion FROM k""",
)
def paragraph_moods(spark, sf_dir):
    return line_texts(spark, sf_dir).select("doc_id", "pos", staging.mood("text").alias("m")).select("doc_id", "pos", "m.*")


@query("original_mode")
def original_mode(spark, sf_dir):
    return dialogue.original(texts(spark, sf_dir))


@query("tense_formats")
def tense_formats(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return texts(spark, sf_dir).select("doc_id", dialogue.tense_format(t, F.pmod(F.col("doc_id"), F.lit(100))).alias("text"), dialogue.separated(t).alias("separated"))


_BOOK_CHAPTERS = f"{cte('fx_chapters')}, book_chapters AS (SELECT 'c' || conv_id::VARCHAR AS book, turn::INTEGER AS number, role || ' ' || turn::VARCHAR || '. ' || replace(text, chr(10), ' ') AS title, length(text)::BIGINT AS word_count, turn % 2 = 0 AS is_processed FROM conversations UNION ALL SELECT * FROM fx_chapters)"


def _book_chapters(spark, sf_dir):
    """Turns of conversations as chapters of books, and the fixture's."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    title = F.concat("role", F.lit(" "), F.col("turn").cast("string"), F.lit(". "), F.regexp_replace("text", "\n", " "))
    rows = c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("book"), F.col("turn").cast("int").alias("number"), title.alias("title"), F.length("text").cast("long").alias("word_count"), (F.col("turn") % 2 == 0).alias("is_processed"))
    return rows.unionByName(table(spark, "fx_chapters"))


@query(
    "book_totals",
    f"""WITH {_BOOK_CHAPTERS} SELECT book, sum(word_count)::BIGINT AS words, count(*) FILTER (WHERE is_processed) AS processed, count(*) AS total,
  CASE WHEN bool_and(is_processed) THEN 'ready' WHEN bool_or(is_processed) THEN 'processing' ELSE 'pending' END AS status FROM book_chapters GROUP BY book""",
)
def book_totals(spark, sf_dir):
    return books.grouped_chapters(_book_chapters(spark, sf_dir)).drop("chapters")


@query(
    "order_totals",
    """SELECT o_orderkey AS book, sum(l_quantity) AS words, count(*) FILTER (WHERE l_linestatus = 'F') AS processed, count(*) AS total, CASE WHEN bool_and(l_linestatus = 'F') THEN 'ready' WHEN bool_or(l_linestatus = 'F') THEN 'processing' ELSE 'pending' END AS status
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
)
def order_totals(spark, sf_dir):
    """The book and chapter roll-up over the star schema: an order's lines as chapters."""
    o, li = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    rows = o.select("o_orderkey").join(li, F.col("l_orderkey") == F.col("o_orderkey"))
    done = F.col("l_linestatus") == "F"
    out = rows.groupBy(F.col("o_orderkey").alias("book")).agg(F.sum("l_quantity").alias("words"), F.count_if(done).alias("processed"), F.count("*").alias("total"))
    return out.withColumn("status", F.when(F.col("processed") == F.col("total"), "ready").when(F.col("processed") > 0, "processing").otherwise("pending"))


@query("latest_events", "SELECT user_id, arg_max(event_id, ts) AS event_id, max(ts) AS ts FROM events GROUP BY user_id")
def latest_events(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("user_id").agg(F.max_by("event_id", "ts").alias("event_id"), F.max("ts").alias("ts"))


@query(
    "recent_words",
    "WITH l AS (SELECT user_id, lower(event_type) AS word, max(ts) AS last_ts FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_ts DESC, word) AS rank FROM l) SELECT user_id, word, last_ts, rank::INTEGER AS rank FROM r WHERE rank <= 8",
)
def recent_words(spark, sf_dir):
    return metadata.recent_words(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "event_type", "ts")


@query(
    "event_properties",
    "SELECT event_id, json_type(props) IS NOT NULL AS sound, length(props) AS size FROM events",
)
def event_properties(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.try_parse_json("props").isNotNull().alias("sound"), F.length("props").cast("long").alias("size"))


@query(
    "exported_blocks",
    f"""WITH {BLOCKS}, p AS (SELECT doc_id, pos, trim(CASE type WHEN 'dialogue' THEN CASE WHEN coalesce(speaker, '') <> '' THEN '[' || speaker || ']' ELSE '' END WHEN 'sfx' THEN '[SFX]' WHEN 'beat' THEN '[BEAT]' WHEN 'transition' THEN '[TRANSITION]' ELSE '' END || ' ' || coalesce(content, '')) AS line FROM blocks)
SELECT doc_id, string_agg(line, chr(10) || chr(10) ORDER BY pos) AS text FROM p GROUP BY doc_id""",
)
def exported_blocks(spark, sf_dir):
    return books.export_blocks(blocks(spark, sf_dir).withColumn("camera", F.lit(None).cast("string")))


@query("exported_chapters")
def exported_chapters(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return books.export_chapters(chapters.chapters(docs.unionByName(table(spark, "fx_books").withColumn("doc_id", -F.col("doc_id")))))


@query(
    "file_names",
    rf"""WITH {_BOOK_CHAPTERS}, n AS (SELECT book, number, trim(substr(regexp_replace(regexp_replace(title || ' of «' || book || '» & more!', '[^a-zA-Z0-9\s_-]', '', 'g'), '\s+', '_', 'g'), 1, 60)) AS s FROM book_chapters) SELECT book, number, CASE WHEN s = '' THEN 'export' ELSE s END || '_original.txt' AS name FROM n""",
)
def file_names(spark, sf_dir):
    t = F.concat("title", F.lit(" of «"), "book", F.lit("» & more!"))
    return _book_chapters(spark, sf_dir).select("book", "number", fx.file_name(t, "original", "txt").alias("name"))


def _tokens(spark, sf_dir):
    """Words of documents as positioned tokens: twelve a line, forty lines a page, placed with a little noise."""
    docs = documents(spark, sf_dir).select("doc_id", F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("i", "text"))
    line = F.floor(F.col("i") / 12)
    return docs.select("doc_id", F.floor(line / 40).cast("int").alias("page"), "text", ((F.col("i") % 12) * 40.0).alias("x"), (800.0 - (line % 40) * 12.0 + (F.col("i") % 2)).alias("y"))


@query(
    "reading_order",
    r"""WITH w AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS l FROM documents)),
g AS (SELECT doc_id, (i // 480)::INTEGER AS page, ((i // 12) % 40)::INTEGER AS line, regexp_replace(string_agg(text, ' ' ORDER BY i), '\s+([,.;!?])', '\1', 'g') AS text FROM w GROUP BY ALL) SELECT * FROM g""",
)
def reading_order(spark, sf_dir):
    return positioned.reading_order(_tokens(spark, sf_dir))


def _pages(spark):
    rows = [(d, p, f"Book {d} page {p}\nA HEADER\n{'A line of page ' + str(p)}\nbody of {p} - {d}\n{p}\nFooter {p}") for d in (1, 2) for p in range(1, 9)] + [(3, 1, "only one\npage"), (3, 2, ""), (4, 1, "---\n12\n  ")]
    return spark.createDataFrame(rows, "doc_id long, page int, text string")


@query("page_boundaries")
def page_boundaries(spark, sf_dir):
    """Turns of conversations as pages, and pages with headers and footers, whose ids are negative."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), "text")
    return positioned.without_boundaries(turns.unionByName(_pages(spark).withColumn("doc_id", -F.col("doc_id"))))


@query(
    "scanned_pages",
    f"""WITH p AS (SELECT conv_id AS doc_id, turn AS page, text, length({sql.trim('text')}) < 120 AS poor FROM conversations)
SELECT doc_id, page, text, poor AND sum(poor::INTEGER) OVER (PARTITION BY doc_id ORDER BY page) <= 5 AS scan FROM p""",
)
def scanned_pages(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    return positioned.needs_scan(turns, least=120)


@query("markup_counts")
def markup_counts(spark, sf_dir):
    return markup.block_counts(markup.parsed(table(spark, "fx_markup")))


@query(
    "sound_intensity",
    "WITH "
    + BLOCKS
    + " SELECT doc_id, pos, CASE "
    + " ".join(f"WHEN regexp_matches(upper(coalesce(content, '')), {sql.q(p)}) THEN '{name}'" for name, p in markup.LOUD)
    + " ELSE 'medium' END AS intensity FROM blocks",
)
def sound_intensity(spark, sf_dir):
    return blocks(spark, sf_dir).select("doc_id", "pos", markup.sound_intensity(F.coalesce("content", F.lit(""))).alias("intensity"))


_PROMPT = f"x AS (SELECT doc_id, {sql.trim('text')} AS p FROM texts)"


@query(
    "prompt_keys",
    f"""WITH {TEXTS}, {_PROMPT} SELECT doc_id, concat('local:d:', lower(to_base({sql.fnv1a("concat('local|default|', p)")}, 36)), ':', length(p), ':', substr(p, 1, 24), CASE WHEN length(p) > 48 THEN concat('…', right(p, 24)) ELSE '' END) AS key FROM x""",
)
def prompt_keys(spark, sf_dir):
    rows = texts(spark, sf_dir).withColumn("provider", F.lit("local"))
    return rows.select("doc_id", requests.cache_key("provider", F.coalesce("text", F.lit(""))).alias("key"))


@query("retry_delays", "SELECT event_id, least(30000.0::DOUBLE, 1000 * pow(2.0::DOUBLE, event_id % 12))::BIGINT AS ms FROM events")
def retry_delays(spark, sf_dir):
    """Events as failed attempts, each the first to the twelfth."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("attempt", (F.col("event_id") % 12).cast("int")).select("event_id", requests.retry_delay("attempt").alias("ms"))


@query(
    "stream_sessions",
    """WITH n AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 20 MINUTE, true) AS opens FROM events),
z AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM n)
SELECT user_id, count(*) AS events, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us FROM z GROUP BY user_id, s""",
)
def stream_sessions(spark, sf_dir):
    out = streams.settled(streams.sessions(streams.event_stream(spark, f"{sf_dir}/events.parquet")))
    return out.select("user_id", "events", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("last_ts").alias("last_us"))


@query(
    "stream_activity",
    """WITH h AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS b, event_type, value FROM events), w AS (SELECT b - (k * INTERVAL 1 HOUR) AS start_ts, event_type, value FROM h, range(24) r(k))
SELECT epoch_us(start_ts) AS start_us, event_type, count(*) AS events FROM w GROUP BY ALL""",
)
def stream_activity(spark, sf_dir):
    out = streams.settled(streams.activity(streams.event_stream(spark, f"{sf_dir}/events.parquet")))
    return out.select(F.unix_micros("start_ts").alias("start_us"), "event_type", "events")


@query(
    "stream_thinned",
    """WITH RECURSIVE o AS (SELECT user_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) AS i FROM events),
w AS (SELECT user_id, i, ts, event_type, true AS keep FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.i, CASE WHEN k THEN o.ts ELSE w.ts END, CASE WHEN k THEN o.event_type ELSE w.event_type END, k
  FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1, LATERAL (SELECT o.event_type <> w.event_type OR epoch_us(o.ts) - epoch_us(w.ts) >= 20000000 AS k) x)
SELECT user_id, ts, event_type FROM w WHERE keep""",
)
def stream_thinned(spark, sf_dir):
    return streams.settled(streams.thinned(streams.event_stream(spark, f"{sf_dir}/events.parquet")), "append")


@query(
    "speech_sentiment",
    f"""WITH {BLOCKS}, said AS (SELECT doc_id, pos, coalesce(content, '') AS text FROM blocks), {sql.sentiment('said', 'doc_id, pos')}
SELECT b.doc_id, b.pos, coalesce(b.emotion, s.emotion) AS emotion, s.score FROM blocks b JOIN senti s ON s.doc_id = b.doc_id AND s.pos = b.pos""",
)
def speech_sentiment(spark, sf_dir):
    rows = blocks(spark, sf_dir).withColumn("_s", sentiment(F.coalesce("content", F.lit(""))))
    return rows.select("doc_id", "pos", F.coalesce("emotion", "_s.emotion").alias("emotion"), "_s.score")


@query("dominant_emotions", f"""WITH {BLOCKS}, c AS (SELECT doc_id, emotion, count(*) AS n, min(pos) AS a FROM blocks WHERE emotion IS NOT NULL GROUP BY ALL) SELECT doc_id, emotion AS dominant FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, a) = 1""")
def dominant_emotions(spark, sf_dir):
    return passages.dominant(blocks(spark, sf_dir).filter("emotion is not null"), ["doc_id"], "emotion", "pos")


@query("scene_share", f"WITH {BLOCKS}, e AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE type = 'dialogue') AS d FROM blocks GROUP BY doc_id) SELECT doc_id, n AS blocks, floor(d::DOUBLE / n * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE AS dialogue FROM e")
def scene_share(spark, sf_dir):
    return blocks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("blocks"), fx.rounded(F.count_if(F.col("type") == "dialogue") / F.count("*"), 3).alias("dialogue"))


@query("pacing_energy", f"WITH {BLOCKS} SELECT doc_id, pos, CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in pacing.ENERGY.items()) + " ELSE 5 END AS energy FROM blocks")
def pacing_energy(spark, sf_dir):
    return blocks(spark, sf_dir).select("doc_id", "pos", pacing.energy().alias("energy"))
