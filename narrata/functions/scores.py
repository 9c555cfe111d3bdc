"""Scores and labels of words and passages, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import INTENSIFIERS, LEXICON, NEGATIONS, SUFFIXES
from .text import c, clamp, let, letters, rounded


def cases(first_to_last: list[tuple[Column, object]], otherwise) -> Column:
    """The value of the first condition that holds."""
    out = None
    for condition, value in first_to_last:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def syllables(word) -> Column:
    """Vowel groups, less a silent e or -ed; at least one, and one for words of up to two letters."""
    w = F.regexp_replace(F.lower(c(word)), "[^a-z]", "")
    groups = F.greatest(F.regexp_count(w, F.lit("[aeiouy]+")), F.lit(1))
    silent = (w.endswith("e") & ~w.endswith("le") & (groups > 1)).cast("int")
    past = (w.endswith("ed") & (groups > 1) & ~F.regexp_like(w, F.lit("[dt]ed\\z"))).cast("int")
    return F.when(F.length(w) <= 2, 1).otherwise(F.greatest(F.lit(1), groups - silent - past))


_CONSONANTS = "[bcdfghjklmnpqrstvwxz]"


def syllables_in(lettered) -> Column:
    """Syllables of all words of a text of letters, apostrophes, hyphens and white space, beyond one a word.

    The sum of ``syllables`` less one: vowel groups that another one follows in the word, less words whose last e or ed is silent.
    """
    plain = F.translate(F.lower(c(lettered)), "'-", "")
    return let(plain, lambda t: F.regexp_count(t, F.lit(f"[aeiouy]{_CONSONANTS}+(?=[aeiouy])")) - F.regexp_count(t, F.lit(rf"[aeiouy]{_CONSONANTS}+[aeiouy]*(?:(?<!l)e|(?<![dt])ed)(?!\S)")))


def difficulty(score) -> Column:
    s = c(score)
    return cases([(s >= 90, "very_easy"), (s >= 80, "easy"), (s >= 70, "fairly_easy"), (s >= 60, "standard"), (s >= 50, "fairly_difficult"), (s >= 30, "difficult")], "very_difficult")


def emotion(score) -> Column:
    s = c(score)
    return cases([(s >= 0.3, "joy"), (s >= 0.1, "surprise"), (s <= -0.4, "fear"), (s <= -0.2, "sadness"), (s <= -0.1, "anger")], "neutral")


def rhythm(score, variety) -> Column:
    s = c(score)
    return cases([(c(variety) < 0.3, "erratic"), (s >= 80, "very_fast"), (s >= 60, "fast"), (s >= 40, "balanced"), (s >= 20, "slow")], "very_slow")


def reading_rhythm(score) -> Column:
    s = c(score)
    return cases([(s < 40, "Measured"), (s < 62, "Balanced"), (s < 80, "Propulsive")], "Frenetic")


def _slots() -> Column:
    """For each first two letters a small map of the lexicon's words; a lookup is one array access and few comparisons."""
    by: list[dict[str, int]] = [{} for _ in range(26 * 26)]
    for word, score in LEXICON.items():
        by[_slot(word)][word] = score
    none = F.create_map().cast("map<string,int>")
    return F.array(*[F.create_map(*[F.lit(x) for w, s in m.items() for x in (w, s)]) if m else none for m in by])


def _slot(word: str) -> int:
    return (ord(word[0]) - 97) * 26 + ord(word[1]) - 97


def word_score(w: Column) -> Column:
    """A lower-case word's score in the lexicon, or else that of its stem of three letters or more."""
    slots = _slots()
    place = lambda x: (F.ascii(x) - 97) * 26 + F.ascii(F.substring(x, 2, 1)) - 97
    of = lambda x: F.when(F.regexp_like(x, F.lit("^[a-z]{2}")), F.try_element_at(F.get(slots, place(x)), x))
    stem = F.regexp_replace(w, "(?:" + "|".join(SUFFIXES) + r")\z", "")
    return F.coalesce(of(w), F.when(F.length(stem) >= 3, of(stem)))


def _trie(words) -> str:
    """A regex for any of the words that shares their beginnings, so a mismatch ends after few letters."""
    tree: dict = {}
    for w in words:
        node = tree
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def written(node: dict) -> str:
        parts = [re.escape(ch) + written(rest) for ch, rest in sorted(node.items()) if ch]
        body = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")" if parts else ""
        return f"(?:{body})?" if "" in node and parts else body

    return written(tree)


#: All words that count: scored ones, their forms with one suffix, negations and intensifiers. Endings are written once: each
#: group is a place that the engine clears before every search.
TELLING = f"(?:{_trie(LEXICON)}(?:{_trie(SUFFIXES)})?|{_trie({*NEGATIONS, *INTENSIFIERS})})"
#: One tree of all of them, sooner done with; the few more words that it takes ("notion") tell nothing when folded.
NEARLY = f"{_trie({*LEXICON, *NEGATIONS, *INTENSIFIERS})}(?:{_trie(SUFFIXES)})?"


def sentiment(text) -> Column:
    """struct<score, raw_score, hits, emotion, confidence> of a passage.

    Passages without a telling word are done after one regex; of the others another makes each word that is none a
    full stop, so that only the telling words are folded, with their places: a negation works on the two words after it,
    an intensifier on the next word that is no negation.
    Contributions are fortieths, so that sums are exact whatever their order.
    """
    lowered = F.concat(F.lit(" "), letters(F.lower(c(text))))
    tenths = F.create_map(*[F.lit(x) for w, m in INTENSIFIERS.items() for x in (w, round(m * 10))])
    # chain: the place up to which an intensifier carries
    start = F.struct(F.lit(-9).alias("neg"), F.lit(-9).alias("chain"), F.lit(10).alias("by"), F.lit(0).cast("long").alias("raw"), F.lit(0).alias("hits"))

    def step(acc: Column, t: Column) -> Column:
        w, i = t["w"], t["i"]
        state = lambda neg, chain, by, raw, hits: F.struct(neg.alias("neg"), chain.alias("chain"), by.alias("by"), raw.alias("raw"), hits.alias("hits"))
        carried = F.when(acc["chain"] == i - 1, acc["by"]).otherwise(10)
        by = F.try_element_at(tenths, w)
        scored = let(
            word_score(w),
            lambda s: F.when(s.isNull(), state(acc["neg"], F.lit(-9), F.lit(10), acc["raw"], acc["hits"])).otherwise(
                state(acc["neg"], F.lit(-9), F.lit(10), acc["raw"] + (s * carried * F.when(i - acc["neg"] <= 2, -3).otherwise(4)).cast("long"), acc["hits"] + 1)
            ),
        )
        return F.when(w.isin(*NEGATIONS), state(i, i, carried, acc["raw"], acc["hits"])).when(by.isNotNull(), state(acc["neg"], i, by, acc["raw"], acc["hits"])).otherwise(scored)

    def result(raw: Column, hits: Column, n: Column) -> Column:
        norm = clamp(raw / F.greatest(F.lit(1), hits * 2), -1.0, 1.0)
        return F.struct(rounded(norm, 3).alias("score"), rounded(raw, 2).alias("raw_score"), hits.cast("long").alias("hits"), emotion(norm).alias("emotion"), rounded(hits / F.greatest(F.lit(1), n), 3).alias("confidence"))

    def folded(tokens: Column) -> Column:
        placed = F.filter(F.transform(tokens, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda t: t["w"] != ".")
        return F.aggregate(placed, start, step, lambda acc: result(acc["raw"] / 40.0, acc["hits"], F.size(tokens)))

    tokens = lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != "")
    none = F.struct(F.lit(0.0).alias("score"), F.lit(0.0).alias("raw_score"), F.lit(0).cast("long").alias("hits"), F.lit("neutral").alias("emotion"), F.lit(0.0).alias("confidence"))
    marked = lambda t: F.regexp_replace(t, f"\\s(?!{TELLING}(?:\\s|\\z))\\S+", " .")
    return let(lowered, lambda t: F.when(F.regexp_like(t, F.lit(f"\\s{NEARLY}(?:\\s|\\z)")), let(tokens(marked(t)), folded)).otherwise(none))
