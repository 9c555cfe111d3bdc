"""Queries over typed blocks, telemetry, jobs, requests and vectors, with the SQL of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs, markup, pacing, packing, passages, reader, requests, vectors
from . import sql
from .fixtures import cte, table
from .text_queries import TEXTS, documents, texts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


_TYPES = "CASE role WHEN 'user' THEN 'dialogue' WHEN 'assistant' THEN 'action' ELSE 'transition' END"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as blocks, and the fixture blocks, whose ids are negative."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    n = F.length("text")
    turns = c.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("pos"), F.expr(_TYPES).alias("type"), F.col("text").alias("content"), F.col("role").alias("speaker"),
        F.get(F.lit(["slow", "normal", "quick", "rapid"]), (n % 4).cast("int")).alias("timing"), F.when(n % 5 > 0, F.get(F.lit(["joy", "fear", "neutral"]), (n % 3).cast("int"))).alias("emotion"), (n % 101).cast("int").alias("tension"),
    )
    return turns.unionByName(table(spark, "fx_blocks").withColumn("doc_id", -F.col("doc_id")))


BLOCKS = f"""{cte('fx_blocks')}, blocks AS (
  SELECT conv_id AS doc_id, turn::INTEGER AS pos, {_TYPES} AS type, text AS content, role AS speaker, (['slow', 'normal', 'quick', 'rapid'])[length(text) % 4 + 1] AS timing,
    CASE WHEN length(text) % 5 > 0 THEN (['joy', 'fear', 'neutral'])[length(text) % 3 + 1] END AS emotion, (length(text) % 101)::INTEGER AS tension FROM conversations
  UNION ALL SELECT -doc_id, pos, type, content, speaker, timing, emotion, tension FROM fx_blocks)"""

_ENERGY = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in pacing.ENERGY.items()) + " ELSE 5 END"
_ARC = f"""arcs AS (SELECT doc_id, pos, floor(sum({_ENERGY} * 40 + coalesce(tension, 50) * 6) OVER w::DOUBLE / count(*) OVER w + 0.5) / 1000.0::DOUBLE AS arc,
  row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"""
_ARC = _ARC.replace("OVER w::DOUBLE", "OVER w").replace("floor(sum(", "floor((sum(").replace(" OVER w / count(*) OVER w", " OVER w)::DOUBLE / count(*) OVER w")


@query("tension_arc", f"WITH {BLOCKS}, {_ARC} SELECT doc_id, pos, arc FROM arcs")
def tension_arc(spark, sf_dir):
    return pacing.tension_arc(blocks(spark, sf_dir))


_FLAT = f"""{_ARC}, walk AS (
  SELECT doc_id, i, arc, i AS start_pos FROM arcs WHERE i = 0
  UNION ALL SELECT a.doc_id, a.i, CASE WHEN abs(a.arc - w.arc) > 0.05::DOUBLE THEN a.arc ELSE w.arc END, CASE WHEN abs(a.arc - w.arc) > 0.05::DOUBLE THEN a.i ELSE w.start_pos END
  FROM walk w JOIN arcs a ON a.doc_id = w.doc_id AND a.i = w.i + 1),
flat AS (SELECT doc_id, start_pos::INTEGER AS start_pos, max(i)::INTEGER AS end_pos FROM walk GROUP BY doc_id, start_pos HAVING count(*) >= 8)"""


@query("flat_zones", f"WITH RECURSIVE {BLOCKS}, {_FLAT} SELECT * FROM flat")
def flat_zones(spark, sf_dir):
    return pacing.flat_zones(blocks(spark, sf_dir))


_RUSHED = f"""loud AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, sum(({_ENERGY} >= 7)::INTEGER) OVER w AS loud, count(*) OVER w AS n FROM blocks
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
hits AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 4, true) AS opens FROM loud WHERE n = 5 AND loud >= 4),
zones AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS z FROM hits),
rushed AS (SELECT doc_id, min(i) AS start_pos, max(i) + 4 AS end_pos FROM zones GROUP BY doc_id, z)"""


@query("rushed_zones", f"WITH {BLOCKS}, {_RUSHED} SELECT doc_id, start_pos, end_pos FROM rushed")
def rushed_zones(spark, sf_dir):
    return pacing.rushed_zones(blocks(spark, sf_dir))


def _ratio(t: str) -> str:
    return f"{sql.rounded(f'''coalesce(max(CASE WHEN type = '{t}' THEN n END), 0)::DOUBLE / max(total)''', 3)} AS {t}_ratio"


@query(
    "pacing",
    f"""WITH RECURSIVE {BLOCKS}, {_FLAT}, {_RUSHED},
t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM (SELECT doc_id, type, count(*) AS n, min(pos) AS a, max(pos) AS z FROM blocks GROUP BY ALL)),
m AS (SELECT doc_id, max(total)::BIGINT AS blocks, {", ".join(_ratio(x) for x in ("action", "dialogue", "beat", "sfx", "transition"))},
  CASE WHEN count(*) <= 1 THEN 0.0 ELSE {sql.rounded('-sum(n::DOUBLE / total * log2(n::DOUBLE / total)) / 3.0::DOUBLE', 3)} END AS variety,
  CASE WHEN max(CASE WHEN type = 'transition' THEN n END) > 1 THEN {sql.rounded("max(CASE WHEN type = 'transition' THEN z - a END)::DOUBLE / (max(CASE WHEN type = 'transition' THEN n END) - 1)", 1)} ELSE max(total)::DOUBLE END AS transition_gap FROM t GROUP BY doc_id),
f AS (SELECT doc_id, count(*) AS flat_zones FROM flat GROUP BY ALL), r AS (SELECT doc_id, count(*) AS rushed_zones FROM rushed GROUP BY ALL),
s AS (SELECT m.*, coalesce(flat_zones, 0) AS flat_zones, coalesce(rushed_zones, 0) AS rushed_zones FROM m LEFT JOIN f USING (doc_id) LEFT JOIN r USING (doc_id)),
x AS (SELECT *, greatest(0, least(100, floor(50 + (variety - 0.5::DOUBLE) * 40 - flat_zones * 5 - rushed_zones * 8 + 0.5)))::BIGINT AS score FROM s)
SELECT *, CASE WHEN variety < 0.3::DOUBLE THEN 'erratic' WHEN score >= 80 THEN 'very_fast' WHEN score >= 60 THEN 'fast' WHEN score >= 40 THEN 'balanced' WHEN score >= 20 THEN 'slow' ELSE 'very_slow' END AS rhythm FROM x""",
)
def pacing_metrics(spark, sf_dir):
    return pacing.pacing(blocks(spark, sf_dir)).withColumn("score", F.col("score").cast("long"))


@query(
    "without_repeats",
    rf"""WITH {BLOCKS}, b AS (SELECT *, type || '|' || coalesce(speaker, '') || '|' || regexp_replace(coalesce(content, ''), '\s+', '', 'g') AS k FROM blocks WHERE regexp_replace(coalesce(content, ''), '\s+', '', 'g') <> ''),
l AS (SELECT *, lag(k) OVER (PARTITION BY doc_id ORDER BY pos) AS was FROM b) SELECT doc_id, pos, type, speaker, content FROM l WHERE was IS NULL OR was <> k""",
)
def without_repeats(spark, sf_dir):
    return pacing.without_repeats(blocks(spark, sf_dir)).select("doc_id", "pos", "type", "speaker", "content")


@query(
    "heat_map",
    """WITH %s, e AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n, tension, coalesce(emotion, 'neutral') AS emotion FROM blocks),
b AS (SELECT *, floor(i / ceil(n / 30.0::DOUBLE))::BIGINT AS bucket FROM e),
c AS (SELECT doc_id, bucket, emotion, count(*) AS n, sum(coalesce(tension, 30)) AS t, min(i) AS first_i FROM b GROUP BY ALL),
d AS (SELECT doc_id, bucket, emotion FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, bucket ORDER BY n DESC, first_i) = 1)
SELECT doc_id, bucket, sum(n)::BIGINT AS blocks, floor(sum(t)::DOUBLE / sum(n) + 0.5)::BIGINT AS tension, any_value(d.emotion) AS emotion FROM c JOIN d USING (doc_id, bucket) GROUP BY ALL""" % BLOCKS,
)
def heat_map(spark, sf_dir):
    h = pacing.heat_map(blocks(spark, sf_dir))
    return h.select("doc_id", F.col("bucket").cast("long").alias("bucket"), "blocks", F.col("tension").cast("long").alias("tension"), "emotion")


_MS = r"""greatest(500, floor(greatest(1, len(list_filter(regexp_split_to_array(coalesce(content, ''), '\s+'), lambda w: w <> ''))) * 280 * (CASE timing WHEN 'slow' THEN 125 WHEN 'quick' THEN 80 WHEN 'rapid' THEN 65 ELSE 100 END)
  * (CASE type WHEN 'dialogue' THEN 90 WHEN 'beat' THEN 75 WHEN 'sfx' THEN 60 WHEN 'transition' THEN 70 WHEN 'chapter_header' THEN 85 WHEN 'title_card' THEN 85 ELSE 100 END) / 10000.0::DOUBLE + 0.5))::BIGINT"""


@query("cue_durations", f"WITH {BLOCKS} SELECT doc_id, pos, {_MS} AS ms FROM blocks")
def cue_durations(spark, sf_dir):
    return blocks(spark, sf_dir).select("doc_id", "pos", pacing.cue_duration().alias("ms"))


@query(
    "render_plan",
    f"""WITH {BLOCKS}, c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n, {_MS} AS ms, emotion, tension FROM blocks),
s AS (SELECT *, CASE WHEN n <= 1 THEN 0 ELSE least(3, floor(i * 4 / n::DOUBLE)) END::INTEGER AS scene FROM c),
e AS (SELECT doc_id, scene, emotion, count(*) AS n, min(i) AS a FROM s WHERE emotion IS NOT NULL GROUP BY ALL),
d AS (SELECT doc_id, scene, emotion FROM e QUALIFY row_number() OVER (PARTITION BY doc_id, scene ORDER BY n DESC, a) = 1),
g AS (SELECT doc_id, scene, count(*) AS cues, min(i) AS first_cue, max(i) AS last_cue, sum(ms)::BIGINT AS duration_ms, floor(avg(tension) + 0.5)::BIGINT AS tension FROM s GROUP BY ALL),
k AS (SELECT DISTINCT doc_id, unnest([0, 1, 2, 3])::INTEGER AS scene FROM blocks)
SELECT doc_id, scene, coalesce(cues, 0) AS cues, coalesce(first_cue, -1) AS first_cue, coalesce(last_cue, -1) AS last_cue, coalesce(duration_ms, 0) AS duration_ms, emotion, coalesce(tension, -1) AS tension FROM k LEFT JOIN g USING (doc_id, scene) LEFT JOIN d USING (doc_id, scene)""",
)
def render_plan(spark, sf_dir):
    return pacing.render_plan(blocks(spark, sf_dir), 4).withColumn("tension", F.coalesce(F.col("tension").cast("long"), F.lit(-1).cast("long")))


@query(
    "speakers",
    f"WITH {BLOCKS} SELECT doc_id, upper(trim(speaker)) AS name, count(*) AS appearances, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS places FROM blocks WHERE speaker <> '' GROUP BY ALL",
)
def speakers(spark, sf_dir):
    return pacing.speakers(blocks(spark, sf_dir))


@query("markup_blocks")
def markup_blocks(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return markup.parsed(docs.unionByName(table(spark, "fx_markup").withColumn("doc_id", -F.col("doc_id"))))


@query(
    "document_tags",
    rf"""WITH {cte('fx_markup')}, d AS (SELECT doc_id, text FROM documents UNION ALL SELECT -doc_id, text FROM fx_markup),
g AS (SELECT doc_id, lower({sql.trim("regexp_extract(text, '(?i)\\[GENRE:\\s*([^\\]]+)\\]', 1)".replace(chr(92) * 2, chr(92)))}) AS genre,
  list_filter(list_transform(string_split({sql.trim("regexp_extract(text, '(?i)\\[TONE:\\s*([^\\]]+)\\]', 1)".replace(chr(92) * 2, chr(92)))}, ','), lambda x: {sql.trim('x')}), lambda x: x <> '') AS tones,
  nullif({sql.trim("regexp_extract(text, '(?i)\\[SUMMARY:\\s*([^\\]]+)\\]', 1)".replace(chr(92) * 2, chr(92)))}, '') AS summary FROM d)
SELECT doc_id, CASE WHEN genre IN ({", ".join(map(sql.q, markup.GENRES))}) THEN genre END AS genre, array_to_string(tones, '|') AS tones, summary FROM g""",
)
def document_tags(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return markup.document_tags(docs.unionByName(table(spark, "fx_markup").withColumn("doc_id", -F.col("doc_id"))))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as snapshots of a book per user, and the fixture's."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("book"), (F.col("event_id") % 5 + 1).cast("int").alias("chapter"), F.col("event_type").alias("mode"), (F.pmod(F.col("event_id"), F.lit(100)) / 80.0).alias("scroll"), (F.col("event_id") % 3600).cast("int").alias("read_sec"), ts.alias("ts"))
    return rows.unionByName(table(spark, "fx_snapshots"))


SNAPS = f"""{cte('fx_snapshots')}, snaps AS (SELECT 'u' || user_id::VARCHAR AS book, (event_id % 5 + 1)::INTEGER AS chapter, event_type AS mode, (event_id % 100) / 80.0::DOUBLE AS scroll, (event_id % 3600)::INTEGER AS read_sec, epoch_us(ts) // 1000 AS ts FROM events
  UNION ALL SELECT * FROM fx_snapshots), sane AS (SELECT book, chapter, mode, greatest(0.0::DOUBLE, least(1.0::DOUBLE, scroll)) AS scroll, greatest(0, read_sec) AS read_sec, ts FROM snaps)"""

_SESSIONS = """n AS (SELECT book, ts, coalesce(ts - lag(ts) OVER (PARTITION BY book ORDER BY ts) > 1200000, true) AS opens FROM {0}),
z AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY book ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM n)"""


@query("sessions", f"WITH {SNAPS}, {_SESSIONS.format('snaps')} SELECT book, session::BIGINT AS session, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS events FROM z GROUP BY ALL")
def sessions(spark, sf_dir):
    return reader.sessions(snapshots(spark, sf_dir), "book", "ts")


@query(
    "thinned_snapshots",
    f"""WITH RECURSIVE {SNAPS}, o AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY ts, chapter, mode, scroll, read_sec) AS i FROM sane),
w AS (SELECT book, i, ts, chapter, mode, scroll, read_sec, true AS keep FROM o WHERE i = 1
  UNION ALL SELECT o.book, o.i, CASE WHEN k THEN o.ts ELSE w.ts END, CASE WHEN k THEN o.chapter ELSE w.chapter END, CASE WHEN k THEN o.mode ELSE w.mode END, CASE WHEN k THEN o.scroll ELSE w.scroll END, CASE WHEN k THEN o.read_sec ELSE w.read_sec END, k
  FROM w JOIN o ON o.book = w.book AND o.i = w.i + 1, LATERAL (SELECT NOT (o.ts - w.ts < 20000 AND o.chapter = w.chapter AND o.mode = w.mode AND abs(w.scroll - o.scroll) < 0.02::DOUBLE) AS k) x),
r AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY i DESC) AS back FROM w WHERE keep)
SELECT book, ts, chapter, mode, scroll, read_sec FROM r WHERE back <= 720""",
)
def thinned_snapshots(spark, sf_dir):
    return reader.thinned(snapshots(spark, sf_dir))


_READ = f"""{cte('fx_snapshots')}, {cte('fx_chapters')}, {cte('fx_progress')}, sane AS (SELECT book, greatest(0.0::DOUBLE, least(1.0::DOUBLE, scroll)) AS scroll, ts FROM fx_snapshots),
last AS (SELECT book, arg_max(scroll, ts) AS scroll, max(ts) AS last_ts FROM sane GROUP BY book), tot AS (SELECT book, sum(word_count)::BIGINT AS total_words FROM fx_chapters GROUP BY book),
done AS (SELECT p.book, coalesce(sum(c.word_count), 0) AS words FROM (SELECT book, unnest(read_chapters) AS number FROM fx_progress) p JOIN fx_chapters c USING (book, number) GROUP BY p.book),
cur AS (SELECT p.book, CASE WHEN list_contains(p.read_chapters, p.current) THEN 0 ELSE floor(coalesce(c.word_count, 0) * coalesce(l.scroll, 0.0::DOUBLE) + 0.5) END AS words FROM fx_progress p LEFT JOIN fx_chapters c ON c.book = p.book AND c.number = p.current LEFT JOIN last l ON l.book = p.book),
read AS (SELECT p.book, p.read_sec, t.total_words, greatest(0, least(t.total_words, coalesce(d.words, 0) + cur.words))::BIGINT AS words_read, l.last_ts FROM fx_progress p JOIN tot t USING (book) JOIN cur USING (book) LEFT JOIN done d USING (book) LEFT JOIN last l USING (book))"""


@query(
    "reading_progress",
    f"""WITH {_READ}, today AS (SELECT * FROM fx_snapshots WHERE ts >= (SELECT max(ts) FROM fx_snapshots) - 86400000), {_SESSIONS.format('today')},
d AS (SELECT book, count(*) AS n FROM today GROUP BY book), v AS (SELECT book, count(DISTINCT session) AS sessions FROM z GROUP BY book),
w AS (SELECT *, floor(words_read / greatest(1.0::DOUBLE, read_sec / 60.0::DOUBLE) + 0.5)::BIGINT AS wpm FROM read)
SELECT book, words_read, CASE WHEN total_words > 0 THEN greatest(0, least(100, floor(words_read::DOUBLE / total_words * 100.0::DOUBLE + 0.5))) ELSE 0 END::BIGINT AS percent, wpm AS words_per_minute,
  ceil(greatest(0, total_words - words_read)::DOUBLE / CASE WHEN wpm > 0 THEN wpm ELSE 170 END)::BIGINT AS minutes_left, floor(coalesce(n, 0) * 45 / 60.0::DOUBLE + 0.5)::BIGINT AS minutes_today, coalesce(sessions, 0) AS sessions_today, last_ts
FROM w LEFT JOIN d USING (book) LEFT JOIN v USING (book)""",
)
def reading_progress(spark, sf_dir):
    return reader.progress_summary(table(spark, "fx_chapters"), table(spark, "fx_progress"), table(spark, "fx_snapshots"))


@query(
    "cinematic_summary",
    f"""WITH {BLOCKS}, b AS (SELECT doc_id, count(*) AS cues, coalesce(floor(avg(tension) + 0.5), 0)::BIGINT AS avg_tension, coalesce(max(tension) - min(tension), 0) AS tension_swing, CASE WHEN count(tension) >= 2 THEN stddev_pop(tension) ELSE 0.0 END AS dev,
  count(DISTINCT emotion) AS emotions, count(*) FILTER (WHERE type = 'transition' OR pos % 9 = 4) AS transitions, count(*) FILTER (WHERE type = 'sfx' OR pos % 6 = 2) AS sounds,
  floor(count(*) FILTER (WHERE type IN ('dialogue', 'inner_thought'))::DOUBLE / count(*) * 100.0::DOUBLE + 0.5)::BIGINT AS dialogue_percent,
  avg(CASE timing WHEN 'slow' THEN 30 WHEN 'normal' THEN 52 WHEN 'quick' THEN 74 WHEN 'rapid' THEN 92 END) AS timing FROM blocks GROUP BY doc_id),
s AS (SELECT *, coalesce(timing, greatest(0.0::DOUBLE, least(100.0::DOUBLE, 35 + cues / 2.0::DOUBLE * 14))) AS score FROM b)
SELECT doc_id, cues, avg_tension, tension_swing, emotions, transitions, sounds, dialogue_percent,
  greatest(0, least(100, floor(22 + greatest(0.0::DOUBLE, least(24.0::DOUBLE, cues * 3.1::DOUBLE)) + greatest(0.0::DOUBLE, least(16.0::DOUBLE, emotions * 5.5::DOUBLE)) + greatest(0.0::DOUBLE, least(20.0::DOUBLE, tension_swing * 0.24::DOUBLE + dev * 0.42::DOUBLE)) + greatest(0.0::DOUBLE, least(12.0::DOUBLE, (transitions + sounds) * 1.9::DOUBLE)) + 0.5)))::BIGINT AS depth,
  CASE WHEN score < 40 THEN 'Measured' WHEN score < 62 THEN 'Balanced' WHEN score < 80 THEN 'Propulsive' ELSE 'Frenetic' END AS rhythm FROM s""",
)
def cinematic_summary(spark, sf_dir):
    carrying = blocks(spark, sf_dir).withColumns({"transition": F.when(F.col("pos") % 9 == 4, "CUT TO"), "sfx": F.when(F.col("pos") % 6 == 2, "BANG")})
    return reader.cinematic_summary(carrying, 2)


_JOB_KINDS = ["enqueued", "started", "failed", "started", "completed", "started", "cancelled"]


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as those of jobs, a job a user, and the fixture's."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.get(F.lit(_JOB_KINDS), (F.col("event_id") % 7).cast("int"))
    rows = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("job"), F.col("event_id").cast("int").alias("seq"), kind.alias("kind"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"))
    return rows.unionByName(table(spark, "fx_job_events"))


_JOBS = f"""{cte('fx_job_events')}, job_events AS (SELECT 'u' || user_id::VARCHAR AS job, event_id::INTEGER AS seq, ({_JOB_KINDS})[event_id % 7 + 1] AS kind, (epoch_us(ts) // 1000)::BIGINT AS ts FROM events UNION ALL SELECT * FROM fx_job_events),
st AS (SELECT job, arg_max(kind, seq) AS kind, count(*) FILTER (WHERE kind = 'started') AS attempts, min(ts) AS created_ts, max(ts) AS updated_ts FROM job_events GROUP BY job),
states AS (SELECT job, CASE WHEN kind = 'completed' THEN 'completed' WHEN kind = 'cancelled' THEN 'failed' WHEN kind = 'started' THEN 'processing' WHEN kind = 'failed' AND attempts >= 3 THEN 'failed' ELSE 'pending' END AS status, attempts, created_ts, updated_ts FROM st)"""


@query("job_states", f"WITH {_JOBS} SELECT * FROM states")
def job_states(spark, sf_dir):
    return jobs.job_states(job_events(spark, sf_dir))


@query("job_status_counts", f"WITH {_JOBS} SELECT d.status, count(s.job) AS jobs FROM (VALUES ('pending'), ('processing'), ('completed'), ('failed')) d(status) LEFT JOIN states s USING (status) GROUP BY d.status")
def job_status_counts(spark, sf_dir):
    return jobs.status_counts(jobs.job_states(job_events(spark, sf_dir)))


_SCORES = f"""{cte('fx_providers')}, {cte('fx_policies')},
k AS (SELECT *, (500 + max_tokens) / 1000.0::DOUBLE * cost_per_1k AS cost_usd, CASE complexity WHEN 'low' THEN 0 WHEN 'medium' THEN 32000 WHEN 'high' THEN 128000 ELSE 200000 END AS least_context,
  CASE WHEN complexity = 'critical' THEN [5, 40, 10, 10, 25, 10] WHEN complexity = 'high' THEN [10, 30, 10, 10, 25, 15] WHEN prefer_fastest AND complexity = 'low' THEN [15, 5, 35, 10, 25, 10] ELSE [30, 15, 15, 10, 20, 10] END AS w FROM fx_providers, fx_policies),
r AS (SELECT *, CASE WHEN NOT healthy THEN 'unhealthy' WHEN cost_usd > max_cost AND max_cost > 0 THEN 'cost' WHEN needs_stream AND NOT streams THEN 'streaming' WHEN require_json AND NOT json THEN 'json' WHEN complexity = 'critical' AND NOT top_tier THEN 'tier' END AS refused,
  greatest(0.0::DOUBLE, 100 - cost_per_1k / 0.01::DOUBLE * 100) AS c, least(100.0::DOUBLE, least(1.0::DOUBLE, context::DOUBLE / greatest(1, least_context)) * 70 + CASE WHEN complexity = 'critical' AND top_tier THEN 30 ELSE 0 END) AS a,
  greatest(0.0::DOUBLE, 100 - latency_ms / 1000.0::DOUBLE * 100) AS l, CASE WHEN NOT needs_stream THEN 50 WHEN streams THEN 100 ELSE 0 END AS s, CASE WHEN healthy THEN 100 ELSE 0 END AS h, CASE WHEN NOT require_json THEN 50 WHEN json THEN 100 ELSE 0 END AS j FROM k),
scores AS (SELECT policy, name, cost_usd, CASE WHEN refused IS NULL THEN {sql.rounded('(c * w[1] + a * w[2] + l * w[3] + s * w[4] + h * w[5] + j * w[6]) / (w[1] + w[2] + w[3] + w[4] + w[5] + w[6])', 2)} ELSE 0.0 END AS score, refused FROM r)"""


@query("provider_scores", f"WITH {_SCORES} SELECT * FROM scores")
def provider_scores(spark, sf_dir):
    return requests.provider_scores(table(spark, "fx_providers"), table(spark, "fx_policies"))


@query("provider_routes", f"WITH {_SCORES}, n AS (SELECT *, row_number() OVER (PARTITION BY policy ORDER BY score DESC, name) AS n FROM scores WHERE refused IS NULL) SELECT policy, arg_min(name, n) AS provider, string_agg(name, '>' ORDER BY n) AS chain FROM n GROUP BY policy")
def provider_routes(spark, sf_dir):
    return requests.routes(requests.provider_scores(table(spark, "fx_providers"), table(spark, "fx_policies")))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls, and the fixture's."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("request"), F.col("event_type").alias("provider"), F.col("user_id").cast("string").alias("user_id"), F.concat(F.lit("q"), (F.col("event_id") % 97).cast("string")).alias("prompt"), (F.unix_millis(F.col("ts").cast("timestamp")) * 100_000 + F.col("event_id")).alias("ts"), (F.col("event_id") % 900).cast("int").alias("tokens"), (F.col("event_id") % 7 > 1).alias("ok"))
    return rows.unionByName(table(spark, "fx_requests"))


CALLS = f"""{cte('fx_requests')}, calls AS (SELECT 'e' || event_id::VARCHAR AS request, event_type AS provider, user_id::VARCHAR AS user_id, 'q' || (event_id % 97)::VARCHAR AS prompt, (epoch_us(ts) // 1000) * 100000 + event_id AS ts, (event_id % 900)::INTEGER AS tokens, event_id % 7 > 1 AS ok FROM events UNION ALL SELECT * FROM fx_requests)"""
_TTL = requests.TTL_MS * 100_000


@query(
    "provider_health",
    f"""WITH {CALLS}, r AS (SELECT provider, ts, ok, sum(ok::INTEGER) OVER (PARTITION BY provider ORDER BY ts) AS run FROM calls),
f AS (SELECT provider, run, count(*) AS n FROM r WHERE NOT ok GROUP BY ALL), t AS (SELECT provider, count(*) AS calls, count(*) FILTER (WHERE NOT ok) AS failures, max(run) AS run FROM r GROUP BY provider),
x AS (SELECT t.provider, calls, failures, coalesce((SELECT max(n) FROM f WHERE f.provider = t.provider), 0) AS longest_run, coalesce(l.n, 0) AS last_run FROM t LEFT JOIN f l ON l.provider = t.provider AND l.run = t.run)
SELECT *, last_run < 3 AS healthy FROM x""",
)
def provider_health(spark, sf_dir):
    return requests.health(calls(spark, sf_dir))


_NOW = 1_704_400_000_000 * 100_000


@query(
    "usable_providers",
    f"""WITH {CALLS}, n AS (SELECT provider, ok, ts, row_number() OVER (PARTITION BY provider ORDER BY ts DESC, request DESC) AS n FROM calls)
SELECT provider, count(*) FILTER (WHERE n <= 3 AND NOT ok) < 3 OR {_NOW} - max(ts) > 120000 AS usable FROM n GROUP BY provider""",
)
def usable_providers(spark, sf_dir):
    return requests.usable(calls(spark, sf_dir), _NOW)


# an entry's life by the requests of its key in order; with more room than there are prompts nothing else is evicted
_CACHE = f"""{CALLS}, o AS (SELECT *, row_number() OVER (PARTITION BY provider, prompt ORDER BY ts, request) AS n FROM calls),
life AS (SELECT provider, prompt, n, request, 'miss' AS outcome, CASE WHEN ok THEN ts END AS made FROM o WHERE n = 1
  UNION ALL SELECT o.provider, o.prompt, o.n, o.request, CASE WHEN l.made IS NULL THEN 'miss' WHEN o.ts - l.made > {_TTL} THEN 'expired' ELSE 'hit' END, CASE WHEN l.made IS NOT NULL AND o.ts - l.made <= {_TTL} THEN l.made WHEN o.ok THEN o.ts END
  FROM life l JOIN o ON o.provider = l.provider AND o.prompt = l.prompt AND o.n = l.n + 1)"""


@query(
    "cache_statistics",
    f"""WITH RECURSIVE {_CACHE}, c AS (SELECT provider, count(*) FILTER (WHERE outcome = 'hit') AS hits, count(*) FILTER (WHERE outcome <> 'hit') AS misses, count(*) FILTER (WHERE outcome = 'expired') AS expirations FROM life GROUP BY provider)
SELECT *, expirations AS evictions, {sql.rounded('hits::DOUBLE / (hits + misses)', 3)} AS hit_rate FROM c""",
)
def cache_statistics(spark, sf_dir):
    return requests.cache_statistics(calls(spark, sf_dir), _TTL, 1000)


@query("cache_events")
def cache_events(spark, sf_dir):
    return requests.cache_events(calls(spark, sf_dir), _TTL, 20)


@query("cache_entries", f"WITH {CALLS} SELECT provider, prompt, max(ts) AS last_ts FROM calls GROUP BY ALL ORDER BY last_ts DESC, provider, prompt LIMIT 50")
def cache_entries(spark, sf_dir):
    return requests.least_recent(calls(spark, sf_dir))


@query(
    "requests_in_flight",
    f"""WITH RECURSIVE {CALLS}, o AS (SELECT *, row_number() OVER (PARTITION BY provider, prompt ORDER BY ts, request) AS n FROM calls),
run AS (SELECT provider, prompt, n, request, ts, ts AS since FROM o WHERE n = 1
  UNION ALL SELECT o.provider, o.prompt, o.n, o.request, o.ts, CASE WHEN o.ts - r.since > {_TTL} THEN o.ts ELSE r.since END FROM run r JOIN o ON o.provider = r.provider AND o.prompt = r.prompt AND o.n = r.n + 1)
SELECT request, provider, prompt, ts FROM run WHERE ts = since""",
)
def requests_in_flight(spark, sf_dir):
    return requests.deduplicated(calls(spark, sf_dir), _TTL).select("request", "provider", "prompt", "ts")


@query(
    "first_success",
    f"WITH {CALLS}, n AS (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY ts, request) AS n FROM calls) SELECT prompt, coalesce(min(n) FILTER (WHERE ok), count(*)) AS attempts, arg_min(provider, n) FILTER (WHERE ok) AS provider FROM n GROUP BY prompt",
)
def first_success(spark, sf_dir):
    return requests.first_success(calls(spark, sf_dir))


@query(
    "call_costs",
    f"WITH {CALLS}, {cte('fx_providers')} SELECT request, provider, tokens, tokens / 1000.0::DOUBLE * coalesce(cost_per_1k, 0.0) AS cost_usd FROM calls r LEFT JOIN fx_providers p ON p.name = r.provider",
)
def call_costs(spark, sf_dir):
    return requests.call_costs(calls(spark, sf_dir), table(spark, "fx_providers")).select("request", "provider", "tokens", "cost_usd")


# waits in milliseconds; events' times are kept apart by their ids elsewhere
_LOG = f"{CALLS}, log AS (SELECT provider, request, CASE WHEN ts > 1000000000000000 THEN ts // 100000 ELSE ts END AS ts, tokens, row_number() OVER (PARTITION BY provider ORDER BY CASE WHEN ts > 1000000000000000 THEN ts // 100000 ELSE ts END, request, tokens) AS n FROM calls)"
_NEED = "least(l.tokens::DOUBLE, 1000.0::DOUBLE)"


@query(
    "token_buckets",
    f"""WITH RECURSIVE {_LOG}, w AS (SELECT provider, 0::BIGINT AS n, ''::VARCHAR AS request, 5.0::DOUBLE AS r, 1000.0::DOUBLE AS t, 0.0::DOUBLE AS done, 0.0::DOUBLE AS wait FROM (SELECT DISTINCT provider FROM log)
  UNION ALL SELECT provider, n, request, least(5.0::DOUBLE, r + z * 0.0005::DOUBLE) - 1.0::DOUBLE, least(1000.0::DOUBLE, t + z * 0.1::DOUBLE) - need, now + z, now + z - ts
  FROM (SELECT *, greatest(0.0::DOUBLE, (1 - r) / 0.0005::DOUBLE, (need - t) / 0.1::DOUBLE) AS z FROM (
    SELECT provider, n, request, ts, need, now, least(5.0::DOUBLE, r + (now - done) * 0.0005::DOUBLE) AS r, least(1000.0::DOUBLE, t + (now - done) * 0.1::DOUBLE) AS t FROM (
      SELECT l.provider, l.n, l.request, l.ts, {_NEED} AS need, greatest(l.ts::DOUBLE, w.done) AS now, w.r, w.t, w.done FROM w JOIN log l ON l.provider = w.provider AND l.n = w.n + 1))))
SELECT provider, request, {sql.rounded('wait', 3)} AS wait_ms FROM w WHERE n > 0""",
)
def token_buckets(spark, sf_dir):
    far = F.col("ts") > 1_000_000_000_000_000
    log = calls(spark, sf_dir).withColumn("ts", F.when(far, F.floor(F.col("ts") / 100_000)).otherwise(F.col("ts")))
    return requests.token_buckets(log, rpm=30, tpm=6_000)


@query(
    "token_plan",
    f"""WITH {TEXTS}, t AS (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(1, ceil(length(text) / 4.0::DOUBLE))::BIGINT END AS prompt_tokens FROM texts),
o AS (SELECT *, least(1024, greatest(0, 7942 - prompt_tokens)) AS output_tokens FROM t) SELECT doc_id, prompt_tokens, output_tokens, output_tokens >= 1024 AS fits FROM o""",
)
def token_plan(spark, sf_dir):
    return requests.token_plan(texts(spark, sf_dir).fillna("", ["text"])).select("doc_id", "prompt_tokens", "output_tokens", "fits")


@query(
    "trimmed_prompts",
    f"""WITH {TEXTS} SELECT doc_id, CASE WHEN length(coalesce(text, '')) <= 400 THEN coalesce(text, '') ELSE substr(text, 1, 80) || chr(10) || chr(10) || '...[prompt truncated to fit token budget]...' || chr(10) || chr(10) || substr(text, greatest(1, length(text) - 272 + 1)) END AS prompt FROM texts""",
)
def trimmed_prompts(spark, sf_dir):
    return texts(spark, sf_dir).fillna("", ["text"]).select("doc_id", requests.trimmed_prompt("text", 100).alias("prompt"))


@query(
    "nearest_vectors",
    f"""WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), h AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT query, id, list_sum(list_transform(list_zip(q.v, h.v), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(q.v, lambda x: x * x))) * sqrt(list_sum(list_transform(h.v, lambda x: x * x)))) AS sim FROM q, h WHERE query <> id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS rank FROM s) SELECT query, rank::INTEGER AS rank, id, {sql.rounded('sim', 6)} AS similarity FROM r WHERE rank <= 2""",
)
def nearest_vectors(spark, sf_dir):
    """The query set is stated: ids divisible by 20, against all rows."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    from ..functions.text import rounded

    return vectors.nearest(e.filter("vec_id % 20 = 0"), e).withColumn("similarity", rounded("similarity", 6))


@query("paragraph_strategies")
def paragraph_strategies(spark, sf_dir):
    return packing.chosen_paragraphs(texts(spark, sf_dir))


_FIT = lambda most: f"r.total + w.s + r.n <= {most}"


@query(
    "line_chunks",
    rf"""WITH RECURSIVE {TEXTS}, w AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i, length(unnest(a)) AS s FROM (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {sql.trim('x')}), lambda x: x <> '') AS a FROM texts)),
r AS (SELECT doc_id, i, line, 0 AS chunk, 1 AS n, s AS total FROM w WHERE i = 1
  UNION ALL SELECT w.doc_id, w.i, w.line, CASE WHEN {_FIT(600)} THEN r.chunk ELSE r.chunk + 1 END, CASE WHEN {_FIT(600)} THEN r.n + 1 ELSE 1 END, CASE WHEN {_FIT(600)} THEN r.total + w.s ELSE w.s END FROM r JOIN w ON w.doc_id = r.doc_id AND w.i = r.i + 1)
SELECT doc_id, chunk, string_agg(line, chr(10) ORDER BY i) AS text FROM r GROUP BY doc_id, chunk""",
)
def line_chunks(spark, sf_dir):
    return packing.line_chunks(texts(spark, sf_dir))


@query(
    "page_layout",
    rf"""WITH RECURSIVE {TEXTS}, l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS k FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM texts)),
p AS (SELECT doc_id, k, list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '') AS a FROM l WHERE {sql.trim('line')} <> ''),
w AS (SELECT doc_id, k, unnest(a) AS word, generate_subscripts(a, 1) AS i, length(unnest(a)) AS s FROM p),
r AS (SELECT doc_id, k, i, word, 0 AS line, 1 AS n, s AS total FROM w WHERE i = 1
  UNION ALL SELECT w.doc_id, w.k, w.i, w.word, CASE WHEN {_FIT(90)} THEN r.line ELSE r.line + 1 END, CASE WHEN {_FIT(90)} THEN r.n + 1 ELSE 1 END, CASE WHEN {_FIT(90)} THEN r.total + w.s ELSE w.s END FROM r JOIN w ON w.doc_id = r.doc_id AND w.k = r.k AND w.i = r.i + 1),
o AS (SELECT doc_id, k, line, string_agg(word, ' ' ORDER BY i) AS text FROM r GROUP BY ALL UNION ALL SELECT doc_id, k, 1000000000, '' FROM p),
z AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY k, line) - 1 AS i FROM o)
SELECT doc_id, (i // 40)::INTEGER AS page, (i % 40)::INTEGER AS line, text FROM z""",
)
def page_layout(spark, sf_dir):
    return packing.pages(texts(spark, sf_dir))


@query("line_statistics", f"WITH {TEXTS}, l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM texts) SELECT doc_id, count(*) AS lines, count(DISTINCT line) AS distinct_lines, max(length(line)) AS longest FROM l GROUP BY doc_id")
def line_statistics(spark, sf_dir):
    rows = passages.line_rows(texts(spark, sf_dir))
    return rows.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_distinct("line").alias("distinct_lines"), F.max(F.length("line")).cast("long").alias("longest"))
