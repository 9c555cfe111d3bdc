"""Text primitives as columns: rounding, trimming, words, sentences, paragraphs, cleaning.

White space is the ASCII class of the regex engine; lengths count code points.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def folded(items: Column, start: Column, step, kind: str, last=None) -> Column:
    """What a fold over an array gives out, in order: array<kind>.

    ``step(state, x)`` gives the next state and the array of what is given out at x; ``last(state)`` what is given
    out at the end. An append copies the array so far, so items go in blocks of about the root of their number:
    n * sqrt(n) copied references instead of n * n.
    """
    none, nothing = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    pair = lambda s, out: F.struct(s.alias("s"), out.alias("out"))

    def add(acc: Column, x: Column) -> Column:
        state, out = step(acc["s"], x)
        return pair(state, F.concat(acc["out"], out))

    def body(a: Column) -> Column:
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(a))).cast("int"))
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(a)), size), lambda i: F.slice(a, i, size))
        grown = lambda acc, block: let(F.aggregate(block, pair(acc["s"], none), add), lambda r: pair(r["s"], F.concat(acc["out"], F.array(r["out"]))))
        done = lambda acc: F.flatten(acc["out"] if last is None else F.concat(acc["out"], F.array(last(acc["s"]))))
        return F.aggregate(blocks, pair(start, nothing), grown, done)

    return let(items, body)


def rounded(x, k: int = 0) -> Column:
    """Half up toward positive infinity, to k decimals."""
    return F.floor(c(x) * float(10**k) + 0.5) / float(10**k)


def whole(x) -> Column:
    return F.floor(c(x) + 0.5)


def clamp(x, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c(x)))


def trimmed(t) -> Column:
    """Without the white space around; what is no white space is done after one look."""
    return F.regexp_replace(c(t), r"\s(?:\s*\z|(?<=\A\s)\s*)", "")


def _parts(t: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(t, pattern), trimmed), lambda s: s != "")


#: ASCII white space and what words are made of, one by one: the engine looks up listed characters in a table, and tests ranges
#: and \\s of a class one after another.
SPACES = r" \t\n\x0B\f\r"
LETTERS = "".join(chr(i) for i in range(128) if chr(i).isalpha()) + r"'\-" + SPACES


def letters(t) -> Column:
    """A text's ASCII letters, apostrophes, hyphens and white space."""
    return F.regexp_replace(c(t), f"[^{LETTERS}]+", "")


def split_words(lettered) -> Column:
    return F.filter(F.split(c(lettered), r"\s+"), lambda w: w != "")


def words(t) -> Column:
    """Runs between white space, of ASCII letters, apostrophes and hyphens only; others are dropped from them."""
    return split_words(letters(t))


def ways(pattern: str) -> list[str]:
    """What stands between the outermost | of a pattern, which may be one group."""
    depth, out = 0, [""]
    for part in re.findall(r"\\.|\[(?:\\.|[^\]\\])*\]|.", pattern):
        depth += (part == "(") - (part == ")")
        if part == "|" and depth == 0:
            out.append("")
        else:
            out[-1] += part
    inner = re.fullmatch(r"\((?:\?:)?(.*)\)", pattern)
    return ways(inner[1]) if len(out) == 1 and inner else out


def found(t, ways_of: str, pattern: str, low: Column | None = None) -> Column:
    """Whether a pattern, whatever the case, matches a text, where ``ways_of`` is it without look-arounds.

    Each way to match begins with letters, and plain search for these is many times faster than the regex: that is
    asked only of texts that hold some. Ways that begin otherwise are looked for by themselves.
    """
    low = F.lower(c(t)) if low is None else low
    begins = {w: re.match(r"(?:[a-z ]+(?![?*{]))?", w)[0] for w in ways(ways_of)}
    whole = F.regexp_like(c(t), F.lit(f"(?i){pattern}"))
    rest = [w for w, b in begins.items() if not b]
    if rest and (pattern != ways_of or len(rest) == len(begins)):
        return whole
    held = None
    for n in sorted({b for b in begins.values() if b}):
        held = F.contains(low, F.lit(n)) if held is None else held | F.contains(low, F.lit(n))
    return F.regexp_like(c(t), F.lit("(?i)" + "|".join(rest))) | (held & whole) if rest else held & whole


def literals(pattern: str) -> list[str]:
    """The texts that a pattern of letters and spaces stands for, where each way may end in a group of others."""
    out = []
    for way in ways(pattern):
        start, ends = re.fullmatch(r"([a-z ]*)(?:\((?:\?:)?([a-z |]+)\))?", way).groups()
        out += [start + end for end in (ends or "").split("|")]
    return out


def sentences(t) -> Column:
    """Parts between runs of . ! ? that white space or the end follows."""
    return _parts(c(t), r"[.!?]+(?:\s|\z)")


def sentences_matched(t) -> Column:
    """Sentences with their punctuation and closing quotes or brackets."""
    found = F.regexp_extract_all(c(t), F.lit(r"[^.!?]+[.!?]+(?:[\"')\]]+)?|[^.!?]+\z"), F.lit(0))
    return F.filter(F.transform(found, trimmed), lambda s: s != "")


def sentences_kept(t) -> Column:
    """Parts between white space that follows . ! ? and an optional quote."""
    return _parts(c(t), r"(?=\s)(?<=[.!?][\"”']?)\s+")


def _careful() -> str:
    """White space after a true sentence end: not after abbreviations, initials, ellipses, or a number that goes on. White space is asked for first, which spares most look-behinds."""
    from .lexicon import ABBREVIATIONS

    close = "[\"'”’)\\]]{0,4}"
    words = "|".join(ABBREVIATIONS)
    return (
        rf"(?=\s)(?<=[.!?]{close})(?<!\.\.\.{close})(?<!…[.!?]{close})(?<!(?<![A-Za-z])(?i:{words})\.{close})(?<!(?<![A-Za-z])[A-Z]\.{close})"
        rf"(?!(?<=\d\.{close})\s+[a-z\d])\s+"
    )


def sentences_careful(t) -> Column:
    """Sentences that know abbreviations, decimals, initials and ellipses, with their marks and closing quotes."""
    return _parts(c(t), _careful())


def paragraphs(t) -> Column:
    """Parts between blank lines, which may hold white space."""
    return _parts(c(t), r"\n\s*\n")


def paragraphs_strict(t) -> Column:
    """Parts between two or more newlines in a row."""
    return _parts(c(t), r"\n\n+")


def lines(t) -> Column:
    return F.split(c(t), "\n")


def replaced(t, *steps: tuple[str, str]) -> Column:
    """Regex replacements in turn."""
    out = c(t)
    for pattern, by in steps:
        out = F.regexp_replace(out, pattern, by)
    return out


#: Marks that become straight double quotes, straight single quotes and em dashes; fixed values.
DOUBLE, SINGLE, DASHES = "“”„‟″‶", "‘’‚‛′‵", "–—―"


def quotes_normal(t) -> Column:
    """Straight quotes, em dashes, and three dots for the ellipsis sign and for longer runs."""
    straight = F.translate(c(t), DOUBLE + SINGLE + DASHES, '"' * len(DOUBLE) + "'" * len(SINGLE) + "—" * len(DASHES))
    return replaced(F.replace(straight, F.lit("…"), F.lit("...")), (r"\.{4,}", "..."))


#: Marks without width; ligatures and their letters; fixed values.
ZERO_WIDTH = "\u200B\u200C\u200D\u200E\u200F\uFEFF"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def unicode_normal(t, compose: bool = False) -> Column:
    """Without zero-width marks, with ligatures spelled out; accents are composed if asked for, by an Arrow function."""
    out = composed(t) if compose else c(t)
    for sign, by in {**dict.fromkeys(ZERO_WIDTH, ""), **LIGATURES}.items():
        out = F.replace(out, F.lit(sign), F.lit(by))
    return out


def composed(t) -> Column:
    """Canonical composition, which has no built-in; texts go through Python in Arrow batches."""
    from pyspark.sql.pandas.functions import PandasUDFType, pandas_udf

    nfc = pandas_udf(lambda texts: texts.str.normalize("NFC"), "string", PandasUDFType.SCALAR)
    return nfc(c(t))


def spaces_normal(t, no_break: bool = True) -> Column:
    """Newlines as \\n, no-break spaces and runs as one space, none around newlines, at most one blank line."""
    steps = [(r"\r\n|\r", "\n"), (r"[ \t]+", " "), (r"\n +", "\n"), (r" +\n", "\n"), (r"\n{3,}", "\n\n")]
    return trimmed(replaced(t, *([("\u00A0", " ")] if no_break else []), *steps))


def one_line(t) -> Column:
    return trimmed(replaced(t, (r"\s+", " ")))


def canonical(t) -> Column:
    """Without white space: what a lossless rewrite leaves as it was."""
    return replaced(t, (r"\s+", ""))


def merged_lines(t) -> Column:
    """A block's lines joined by spaces; none after a line that ends in a hyphen, which stays."""
    return trimmed(replaced(trimmed(t), (r"\s*\n\s*", "\n"), (r"-\n", "-"), (r"\n", " "), (r" {2,}", " ")))


def extracted_normal(t) -> Column:
    """Extracted text without page numbers, "page x of y", "- n -", hyphenated breaks, lone signs and rules."""
    steps = (
        (r"(?m)^\s*\d{1,4}\s*$", ""),
        (r"(?mi)^\s*page\s+\d+\s*(of\s+\d+)?\s*$", ""),
        (r"(?m)^\s*-\s*\d+\s*-\s*$", ""),
        (r"(\w)-\s*\n\s*(\w)", "$1$2"),
        (r"(?m)^\s*[|§¶©®]\s*$", ""),
    )
    kept = F.array_join(F.filter(F.split(replaced(t, *steps), "\n"), lambda x: ~F.regexp_like(trimmed(x), F.lit(r"^(.)\1{2,}\z"))), "\n")
    return trimmed(replaced(unicode_normal(quotes_normal(kept)), (r"\n{4,}", "\n\n\n"), (r"(?m)^[ \t]+|[ \t]+$", "")))


def post_extraction(t) -> Column:
    """Text of any file as its reader leaves it: no zero-width marks, newlines as \\n, none of the white space that ends lines, blank lines among it."""
    return trimmed(replaced(t, (r"[\u200B-\u200D\uFEFF]", ""), (r"\r\n|\r", "\n"), (r"(?md)\s+$", ""), (r"\n{3,}", "\n\n"), (r"[ \t]+", " ")))


def ocr_normal(t) -> Column:
    """Scanner artefacts: a lone l before a word as I, stray accents, tabs, form feeds, dot runs, control characters."""
    fixed = replaced(
        t,
        (r"(?<![A-Za-z0-9_])l(?![A-Za-z0-9_])(?=\s+[a-z])", "I"),
        ("[`´¨¸˘˙˚˝˜]", ""),
        (r"(?<=[a-z])\s{2,}(?=[a-z])", " "),
        (r"(\w)-\s*\n\s*(\w)", "$1$2"),
        (r"\t+", " "),
        (r"\f", "\n\n"),
        (r"\.{4,}", "..."),
        (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""),
    )
    return F.array_join(F.filter(F.split(fixed, "\n"), lambda x: ~F.regexp_like(trimmed(x), F.lit(r"^\d{1,3}\z"))), "\n")


def file_name(title, mode: str, extension: str) -> Column:
    """Letters, digits, spaces, - and _ of a title, spaces as _, 60 characters; "export" if none are left."""
    stem = F.substring(replaced(trimmed(replaced(title, (r"[^A-Za-z0-9 _-]", ""))), (r"\s+", "_")), 1, 60)
    return F.concat(F.when(stem == "", "export").otherwise(stem), F.lit(f"_{mode}.{extension}"))


def without_tags(html) -> Column:
    """HTML as one line of text: scripts, styles and tags go, common entities are spelled out."""
    return one_line(replaced(html, (r"(?is)<(script|style)\b.*?</\1>", " "), (r"(?s)<[^>]+>", " "), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")))


def sealed(t, key: str) -> Column:
    """A text under AES-GCM by a key derived from a phrase, in base 64. No two are equal."""
    return F.base64(F.aes_encrypt(F.encode(c(t), "UTF-8"), F.unhex(F.sha2(F.lit(key), 256)), F.lit("GCM")))


def opened(t, key: str) -> Column:
    """What ``sealed`` sealed; null where the key or the text is not right."""
    return F.decode(F.try_aes_decrypt(F.unbase64(c(t)), F.unhex(F.sha2(F.lit(key), 256)), F.lit("GCM")), "UTF-8")
