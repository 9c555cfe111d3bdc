"""Hashes that keys and picks are made of, over the UTF-16 units of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import c, trimmed


def units(t) -> Column:
    """The UTF-16 units of a text as whole numbers."""
    return F.transform(F.regexp_extract_all(F.hex(F.encode(c(t), "UTF-16BE")), F.lit(".{4}"), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("bigint"))


def low32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF))


def signed32(x: Column) -> Column:
    """The low 32 bits as a signed number."""
    return F.when(low32(x) >= 1 << 31, low32(x) - (1 << 32)).otherwise(low32(x))


def fnv1a_exact(t) -> Column:
    """FNV-1a in 32 bits, multiplied in whole numbers."""
    return F.aggregate(units(t), F.lit(2166136261).cast("bigint"), lambda h, x: low32(h.bitwiseXOR(x) * 16777619))


def fnv1a(t, of: Column | None = None) -> Column:
    """FNV-1a in 32 bits as engines without whole numbers compute it: a product over 2**53 loses its lowest bits. ``of`` are the text's units, if they are at hand."""
    step = lambda h, x: signed32((h.bitwiseXOR(x).cast("double") * 16777619.0).cast("bigint"))
    return low32(F.aggregate(units(t) if of is None else of, signed32(F.lit(2166136261).cast("bigint")), step))


def djb2(t, most: int = 512) -> Column:
    """h * 33 + unit from 5381, in 32 bits without a sign, over the first ``most`` characters."""
    return F.aggregate(units(F.substring(c(t), 1, most)), F.lit(5381).cast("bigint"), lambda h, x: low32(h * 33 + x))


def times31(t, of: Column | None = None) -> Column:
    """h * 31 + unit from 0, in 32 bits without a sign."""
    return F.aggregate(units(t) if of is None else of, F.lit(0).cast("bigint"), lambda h, x: low32(h * 31 + x))


def base36(x: Column) -> Column:
    return F.lower(F.conv(x.cast("string"), 10, 36))


def cache_key(provider, prompt, model: str | None = None) -> Column:
    """provider, model, hash, length and the ends of a prompt without the space around it; equal calls have equal keys."""
    p = trimmed(prompt)
    raw = F.concat_ws("|", c(provider), F.lit(model or "default"), p)
    tail = F.when(F.length(p) > 48, F.concat(F.lit("…"), F.right(p, F.lit(24)))).otherwise("")
    return F.concat(F.concat_ws(":", c(provider), F.lit(model or "d"), base36(fnv1a(raw)), F.length(p).cast("string"), F.substring(p, 1, 24)), tail)
