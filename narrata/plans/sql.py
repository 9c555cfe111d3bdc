"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

from ..functions.lexicon import INTENSIFIERS, LEXICON, NEGATIONS, SUFFIXES


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(pairs) -> str:
    return ", ".join(f"({q(k)}, {v})" for k, v in pairs)


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+\z', '', 'g')"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace({x}, '[^a-zA-Z''\s-]', '', 'g'), '\s+'), lambda w: w <> '')"


def sentences(x: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array({x}, '[.!?]+(?:\s|\z)'), lambda s: {trim('s')}), lambda s: s <> '')"


def rounded(x: str, k: int = 0) -> str:
    return f"floor(({x}) * {float(10**k)} + 0.5) / {float(10**k)}" if k else f"floor({x} + 0.5)"


def hashed(x: str, start: int, step: str) -> str:
    """A 32-bit hash over a text's characters: ``step`` over h and x, from ``start``; h is kept as a signed number."""
    signed = "CASE WHEN (v & 4294967295) >= 2147483648 THEN (v & 4294967295) - 4294967296 ELSE v & 4294967295 END".replace("v", f"({step})")
    codes = f"list_transform(list_filter(string_split({x}, ''), lambda c: c <> ''), lambda c: unicode(c)::BIGINT)"
    return f"(list_reduce(list_prepend({start - (1 << 32) if start >= 1 << 31 else start}::BIGINT, {codes}), lambda h, x: {signed}) & 4294967295)"


def fnv1a(x: str) -> str:
    return hashed(x, 2166136261, "(xor(h, x)::DOUBLE * 16777619.0::DOUBLE)::BIGINT")


def emotion(x: str) -> str:
    return f"CASE WHEN {x} >= 0.3 THEN 'joy' WHEN {x} >= 0.1 THEN 'surprise' WHEN {x} <= -0.4 THEN 'fear' WHEN {x} <= -0.2 THEN 'sadness' WHEN {x} <= -0.1 THEN 'anger' ELSE 'neutral' END"


def sentiment(source: str, keys: str, name: str = "senti") -> str:
    """CTEs that end in ``name`` (keys, score, raw_score, hits, emotion, confidence) for source (keys, text)."""
    k = [x.strip() for x in keys.split(",")]
    on = " AND ".join(f"b.{x} = a.{x}" for x in k)
    by = ", ".join(k)
    return rf"""
lex(word, s) AS (VALUES {values(LEXICON.items())}),
tenth(word, m) AS (VALUES {values((w, round(m * 10)) for w, m in INTENSIFIERS.items())}),
{name}_w AS (SELECT {by}, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (
  SELECT {by}, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^a-z''\s-]', '', 'g'), '\s+'), lambda w: w <> '') AS w FROM {source})),
{name}_k AS (SELECT t.*, t.word IN ({", ".join(map(q, NEGATIONS))}) AS neg, n.m FROM {name}_w t LEFT JOIN tenth n ON n.word = t.word),
{name}_c AS (SELECT *, NOT neg AND m IS NULL AS content, CASE WHEN NOT neg THEN m END AS by10 FROM {name}_k),
{name}_g AS (SELECT *, max(CASE WHEN neg THEN i END) OVER (PARTITION BY {by} ORDER BY i) AS last_neg,
  coalesce(sum(CASE WHEN content THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM {name}_c),
{name}_m AS (SELECT *, coalesce(last_value(by10 IGNORE NULLS) OVER (PARTITION BY {by}, grp ORDER BY i), 10) AS times FROM {name}_g),
{name}_s AS (SELECT t.*, coalesce(x.s, CASE WHEN length(regexp_replace(t.word, '(?:{"|".join(SUFFIXES)})\z', '')) >= 3 THEN y.s END) AS s
  FROM {name}_m t LEFT JOIN lex x ON x.word = t.word LEFT JOIN lex y ON y.word = regexp_replace(t.word, '(?:{"|".join(SUFFIXES)})\z', '')),
{name}_t AS (SELECT {by}, count(*) AS n, count(s) FILTER (WHERE content) AS hits,
  coalesce(sum(s * times * CASE WHEN last_neg IS NOT NULL AND i - last_neg <= 2 THEN -3 ELSE 4 END) FILTER (WHERE content AND s IS NOT NULL), 0)::BIGINT / 40.0::DOUBLE AS raw FROM {name}_s GROUP BY {by}),
{name}_n AS (SELECT {", ".join("a." + x for x in k)}, coalesce(b.raw, 0.0::DOUBLE) AS raw, coalesce(b.hits, 0)::BIGINT AS hits, greatest(1, coalesce(b.n, 0)) AS n FROM {source} a LEFT JOIN {name}_t b ON {on}),
{name}_z AS (SELECT *, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, raw / greatest(1, 2 * hits))) AS norm FROM {name}_n),
{name} AS (SELECT {by}, {rounded('norm', 3)} AS score, {rounded('raw', 2)} AS raw_score, hits, {emotion('norm')} AS emotion, {rounded('hits::DOUBLE / n', 3)} AS confidence FROM {name}_z)"""
