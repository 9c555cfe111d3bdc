"""Secret scans over a trigram inverted index.

A Boolean query over trigrams is derived from each rule's regex: what any match must contain. The index
holds postings (trigram, doc_id) for the trigrams that some query names. Intersecting postings gives the
candidates of each rule, and only these are verified with the regex. Rules without a mandatory trigram
scan every text.
"""

from __future__ import annotations

from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, folded, let, nested, spans

#: Rules in the order of their kinds: kind, regex, group to measure, its least length. The first three are the base.
RULES = [
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    # a run that is long enough matches from its start, so the least lengths of these two can stand in the regex
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("cloud", r"AIza[0-9A-Za-z_-]{35}", 0, 0),
    ("payment", r"[rs]k_(?:live|test)_[0-9A-Za-z]{16,}", 0, 0),
    ("mail", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}", 0, 0),
    ("registry", r"npm_[A-Za-z0-9]{36}", 0, 0),
    ("package", r"pypi-AgEI[A-Za-z0-9_-]{50,}", 0, 0),
    ("signed", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/-]{20,}", 0, 0),
    ("url", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{1,128}@", 0, 0),
]
BASE = 3


def trigram_query(pattern: str, keep: int = 3, most: int = 24) -> list[list[str]]:
    """What any match contains, lower-cased: one of the lists, with all trigrams of that list.

    An empty list in the answer means that nothing is mandatory. At most ``keep`` trigrams of a list are
    named; fewer conditions only let more candidates through.
    """
    grams = lambda s: {s[i : i + 3] for i in range(len(s) - 2)}
    flush = lambda states: {(seen | grams(tail), "") for seen, tail in states}

    def options(arg) -> list[str] | None:
        chars = []
        for kind, x in arg:
            if kind is C.LITERAL:
                chars.append(chr(x))
            elif kind is C.RANGE and x[1] - x[0] < 6:
                chars += map(chr, range(x[0], x[1] + 1))
            else:
                return None
        return chars if len(chars) <= 6 else None

    def walk(items, states):
        for kind, arg in items:
            if kind is C.LITERAL:
                states = {(seen, tail + chr(arg).lower()) for seen, tail in states}
            elif kind is C.IN and (chars := options(arg)):
                states = {(seen, tail + c.lower()) for seen, tail in states for c in chars}
            elif kind is C.SUBPATTERN:
                states = walk(arg[3], states)
            elif kind is C.BRANCH:
                states = set().union(*(walk(x, states) for x in arg[1]))
            elif kind is C.MAX_REPEAT or kind is C.MIN_REPEAT:
                low, high, body = arg
                if low == 0 and high == 1:
                    states = states | walk(body, states)
                else:
                    for _ in range(min(low, 3)):
                        states = walk(body, states)
                    if low == 0 or high != low or low > 3:
                        states = flush(states)
            elif kind is not C.AT:
                states = flush(states)
            if len(states) > most:
                states = flush(states)
        return states

    lists = {tuple(sorted(seen)) for seen, _ in flush(walk(_parser.parse(pattern), {(frozenset(), "")}))}
    if () in lists or len(lists) > 4 * most:
        return [[]]
    thin = lambda x: [x[i * (len(x) - 1) // max(1, keep - 1)] for i in range(keep)] if len(x) > keep else list(x)
    return sorted({tuple(thin(x)) for x in lists})


def index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram number, key) of docs (key, text): the inverted index over the given trigrams."""
    low = docs.select("key", F.lower("text").alias("low"))
    has = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return low.select(F.explode(has).alias("trigram"), "key")


def candidates(docs: DataFrame, patterns: list[str]) -> tuple[DataFrame, list[int]]:
    """(key, rules: numbers of the patterns to verify) of docs (key, text), and the patterns that scan fully."""
    queries = [trigram_query(p) for p in patterns]
    lists = [(rule, x) for rule, q in enumerate(queries) if [] not in [list(y) for y in q] for x in q]
    full = [rule for rule, q in enumerate(queries) if [] in [list(y) for y in q]]
    names = sorted({t for _, x in lists for t in x})
    naming = [[n for n, (_, x) in enumerate(lists) if t in x] for t in names]
    hits = index(docs, names).select("key", F.explode(F.get(F.lit(naming), F.col("trigram"))).alias("n"))
    met = hits.groupBy("key", "n").agg(F.count("*").alias("found"))
    # repeated keys only let more candidates through
    met = met.filter(F.col("found") >= F.get(F.lit([len(x) for _, x in lists]), F.col("n")))
    return met.groupBy("key").agg(F.collect_set(F.get(F.lit([rule for rule, _ in lists]), F.col("n"))).alias("rules")), full


def find(docs: DataFrame, rules=RULES, keep=()) -> DataFrame:
    """Adds ``secrets``: array<struct<start, kind, end>> in order of start, then kind, to doc_id, ``keep`` and text.

    Kinds are numbers of ``rules``; matches of a kind do not overlap. A null text counts as empty and has
    none; texts of any length are scanned whole. Rows that repeat an id are scanned each by itself. Null ids
    meet their candidates by a digest of the text, so they do not meet in one task. ``keep`` must not name
    text or secrets. Other columns are left out, and an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct("doc_id", *keep).alias("kept"), text.alias("text"), F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.xxhash64(text)).alias("key"))
    found, full = candidates(rows, [r[1] for r in rules])
    both = rows.join(found.hint("shuffle_hash"), "key", "left")
    to_verify = F.concat(F.lit(full) if full else F.array().cast("array<int>"), F.coalesce("rules", F.array().cast("array<int>")))

    def verified(r: Column, group: int) -> Column:
        least = F.get(F.lit([x[3] for x in rules]), r)
        hits = let(F.get(F.lit([x[1] for x in rules]), r), lambda p: spans(F.col("text"), p, group))
        return F.transform(F.filter(hits, lambda s: F.length(s["hit"]) >= least), lambda s: F.struct(s["start"].alias("start"), r.alias("kind"), s["end"].alias("end")))

    groups = [x[2] for x in rules]
    any_of = lambda r: F.when(F.get(F.lit(groups), r) == 2, verified(r, 2)).otherwise(verified(r, 0))
    return both.select("kept.*", "text", F.array_sort(F.flatten(F.transform(to_verify, any_of))).alias("secrets"))


def redact(docs: DataFrame, rules=RULES, keep=()) -> DataFrame:
    """The rows of ``docs`` with each secret replaced by its kind in angle brackets.

    Secrets that overlap are replaced together, by the kind of the first. ``n_chars``, where there is one,
    counts the new text. A null text stays null.
    """
    found = find(nested(docs, "doc_id", "text"), rules, ("_row",))
    clean = F.when(F.size("secrets") > 0, replaced(F.col("text"), F.col("secrets"), F.lit([f"<{r[0]}>" for r in rules]))).otherwise(F.col("text"))
    done = found.select("_row", F.when(F.col("_row.text").isNotNull(), clean).alias("text"), (F.size("secrets") > 0).alias("changed"))
    of = lambda name: F.col("_row").getField(name)
    made = {"text": F.col("text"), "n_chars": F.when(F.col("changed"), F.length("text").cast("long")).otherwise(of("n_chars"))}
    return done.select(*[(made[c] if c in made else of(c)).alias(c) for c in docs.columns])


def replaced(text: Column, secrets: Column, names: Column, block: int = 1024) -> Column:
    """A text with each secret replaced by the name of its kind. Pieces are cut from blocks, not from its start each."""

    def joined(blocks: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            part = lambda k: F.substring(F.get(blocks, k), F.greatest(a - k * block, F.lit(0)) + 1, F.least(b - k * block, F.lit(block)) - F.greatest(a - k * block, F.lit(0)))
            numbers = F.sequence((a / block).cast("int"), ((b - 1) / block).cast("int"))
            return F.when(b > a, F.array_join(F.transform(numbers, part), "")).otherwise("")

        def step(at: Column, s: Column) -> tuple[Column, Column]:
            out = F.when(s["start"] < at, F.array().cast("array<string>")).otherwise(F.array(piece(at, s["start"]), F.get(names, s["kind"])))
            return F.greatest(at, s["end"]), out

        return F.array_join(folded(secrets, F.lit(0), step, "string", lambda at: F.array(piece(at, F.length(text)))), "")

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)), joined)


def listed(found: Column, rules=RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.lit([r[0] for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir)).select("doc_id", "secrets")
    n = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] < BASE)
    return found.select("doc_id", *[n(k).alias(f"n_{RULES[k][0]}") for k in range(BASE)], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
