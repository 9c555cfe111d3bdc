"""License scans by ordered signature rules.

Each rule is a regex with a priority and a label. Words derived from the regexes gate them twice: some decide
whether a text is looked at, and a rule's regex runs where all words of one of its branches are there.
Detections are intervals; one that lies inside another of the same or a higher priority is dropped.
All of it is per row, inside one scan: no shuffle, no join.
"""

from __future__ import annotations

from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, folded, let, spans

#: Characters of words and of what stands between them, as in the phrase scan.
WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]"
GAP = r"[^0-9A-Za-z\x80-\x{10FFFF}]"

_FOUND = "struct<start:int,upto:int,rank:int,rule:int>"

#: Phrases of the base scan and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: License families: label, SPDX id, name, path of its page. The signature rules are made from them.
FAMILIES = [
    ("mit", r"MIT", r"MIT(?:/X11|/Expat)?", r"opensource\.org/licenses?/mit"),
    ("mit-0", r"MIT-0", r"MIT No Attribution", r"opensource\.org/licenses?/mit-0"),
    ("x11", r"X11", r"X11", r"opensource\.org/licenses?/x11"),
    ("apache-1.1", r"Apache-1\.1", r"Apache(?: Software)?(?: License)?,? (?:version |v\.? ?)?1\.1", r"apache\.org/licenses/LICENSE-1\.1"),
    ("apache-2.0", r"Apache-2\.0", r"Apache(?: Software)?(?: License)?,? (?:version |v\.? ?)?2(?:\.0)?", r"apache\.org/licenses/LICENSE-2\.0"),
    ("bsd-2-clause", r"BSD-2-Clause", r"(?:Simplified|FreeBSD|2-Clause|two-clause) BSD", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", r"BSD-3-Clause", r"(?:New|Modified|Revised|3-Clause|three-clause) BSD", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd-4-clause", r"BSD-4-Clause", r"(?:Original|4-Clause|four-clause) BSD", r"spdx\.org/licenses/BSD-4-Clause"),
    ("0bsd", r"0BSD", r"(?:Zero-Clause|0-Clause) BSD", r"opensource\.org/licenses?/0bsd"),
    ("isc", r"ISC", r"ISC", r"opensource\.org/licenses?/isc"),
    ("gpl-1.0", r"GPL-1\.0(?:-only|-or-later|\+)?", r"(?:GNU )?(?:GPL|General Public License),? ?(?:version |v\.? ?)?1(?:\.0)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0"),
    ("gpl-2.0", r"GPL-2\.0(?:-only|-or-later|\+)?", r"(?:GNU )?(?:GPL|General Public License),? ?(?:version |v\.? ?)?2(?:\.0)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", r"GPL-3\.0(?:-only|-or-later|\+)?", r"(?:GNU )?(?:GPL|General Public License),? ?(?:version |v\.? ?)?3(?:\.0)?", r"gnu\.org/licenses/gpl-3\.0"),
    ("lgpl-2.0", r"LGPL-2\.0(?:-only|-or-later|\+)?", r"(?:GNU )?(?:LGPL|Library General Public License),? ?(?:version |v\.? ?)?2(?:\.0)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0"),
    ("lgpl-2.1", r"LGPL-2\.1(?:-only|-or-later|\+)?", r"(?:GNU )?(?:LGPL|Lesser General Public License),? ?(?:version |v\.? ?)?2\.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", r"LGPL-3\.0(?:-only|-or-later|\+)?", r"(?:GNU )?(?:LGPL|Lesser General Public License),? ?(?:version |v\.? ?)?3(?:\.0)?", r"gnu\.org/licenses/lgpl-3\.0"),
    ("agpl-3.0", r"AGPL-3\.0(?:-only|-or-later|\+)?", r"(?:GNU )?(?:AGPL|Affero General Public License),? ?(?:version |v\.? ?)?3(?:\.0)?", r"gnu\.org/licenses/agpl-3\.0"),
    ("gfdl-1.3", r"GFDL-1\.3(?:-only|-or-later)?", r"(?:GNU )?Free Documentation(?: License)?,? ?(?:version |v\.? ?)?1\.3", r"gnu\.org/licenses/fdl-1\.3"),
    ("gfdl-1.2", r"GFDL-1\.2(?:-only|-or-later)?", r"(?:GNU )?Free Documentation(?: License)?,? ?(?:version |v\.? ?)?1\.2", r"gnu\.org/licenses/(?:old-licenses/)?fdl-1\.2"),
    ("mpl-1.1", r"MPL-1\.1", r"(?:MPL|Mozilla Public License),? ?(?:version |v\.? ?)?1\.1", r"mozilla\.org/MPL/1\.1"),
    ("mpl-2.0", r"MPL-2\.0", r"(?:MPL|Mozilla Public License),? ?(?:version |v\.? ?)?2(?:\.0)?", r"mozilla\.org/(?:en-US/)?MPL/2\.0"),
    ("epl-1.0", r"EPL-1\.0", r"(?:EPL|Eclipse Public License)(?: -)?,? ?(?:version |v\.? ?)?1\.0", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", r"EPL-2\.0", r"(?:EPL|Eclipse Public License)(?: -)?,? ?(?:version |v\.? ?)?2(?:\.0)?", r"eclipse\.org/legal/epl-2\.0"),
    ("cddl-1.0", r"CDDL-1\.0", r"(?:CDDL|Common Development and Distribution License),? ?(?:version |v\.? ?)?1\.0", r"opensource\.org/licenses?/cddl-1\.0"),
    ("cpl-1.0", r"CPL-1\.0", r"Common Public License,? ?(?:version |v\.? ?)?1\.0", r"opensource\.org/licenses?/cpl1\.0"),
    ("eupl-1.2", r"EUPL-1\.2", r"(?:EUPL|European Union Public Licen[cs]e),? ?(?:version |v\.? ?)?1\.2", r"joinup\.ec\.europa\.eu/collection/eupl"),
    ("artistic-1.0", r"Artistic-1\.0", r"Artistic License,? ?(?:version |v\.? ?)?1(?:\.0)?", r"opensource\.org/licenses?/artistic-1\.0"),
    ("artistic-2.0", r"Artistic-2\.0", r"Artistic License,? ?(?:version |v\.? ?)?2(?:\.0)?", r"opensource\.org/licenses?/artistic-2\.0"),
    ("bsl-1.0", r"BSL-1\.0", r"Boost Software(?: License)?(?:,? ?(?:version |v\.? ?)?1\.0)?", r"boost\.org/LICENSE_1_0"),
    ("zlib", r"Zlib", r"zlib(?:/libpng)?", r"opensource\.org/licenses?/zlib"),
    ("libpng", r"libpng-2\.0", r"libpng", r"libpng\.org/pub/png/src/libpng-LICENSE"),
    ("postgresql", r"PostgreSQL", r"PostgreSQL", r"opensource\.org/licenses?/postgresql"),
    ("python-2.0", r"(?:Python|PSF)-2\.0", r"Python Software Foundation", r"docs\.python\.org/3/license"),
    ("ruby", r"Ruby", r"Ruby", r"ruby-lang\.org/en/about/license"),
    ("php-3.01", r"PHP-3\.01", r"PHP License,? ?(?:version |v\.? ?)?3\.01", r"php\.net/license/3_01"),
    ("unlicense", r"Unlicense", r"The Unlicense", r"unlicense\.org"),
    ("wtfpl", r"WTFPL", r"(?:WTFPL|Do What The F\S+ You Want To Public License)", r"wtfpl\.net"),
    ("cc0-1.0", r"CC0-1\.0", r"CC0(?: 1\.0)?(?: Universal)?", r"creativecommons\.org/publicdomain/zero/1\.0"),
    *[
        (f"cc-{form}-{v}", f"CC-{form.upper()}-{v}".replace(".", r"\."), rf"(?:CC|Creative Commons)[ -]{full}(?: International| Unported| Generic)?[ -]{v[0]}\.0".replace("..", "."), rf"creativecommons\.org/licenses/{form}/{v}".replace(".0", r"\.0"))
        for form, full in (("by", "(?:BY|Attribution)"), ("by-sa", "(?:BY-SA|Attribution[ -]Share-?Alike)"), ("by-nc", "(?:BY-NC|Attribution[ -]Non-?Commercial)"), ("by-nd", "(?:BY-ND|Attribution[ -]No-?Deriv(?:ative)?s)"), ("by-nc-sa", "(?:BY-NC-SA|Attribution[ -]Non-?Commercial[ -]Share-?Alike)"), ("by-nc-nd", "(?:BY-NC-ND|Attribution[ -]Non-?Commercial[ -]No-?Deriv(?:ative)?s)"))
        for v in ("2.0", "3.0", "4.0")
    ],
    ("odbl-1.0", r"ODbL-1\.0", r"Open Data(?:base| Commons Open Database)(?: License)?", r"opendatacommons\.org/licenses/odbl"),
    ("ofl-1.1", r"OFL-1\.1", r"SIL Open Font(?: License)?(?:,? ?(?:version |v\.? ?)?1\.1)?", r"scripts\.sil\.org/OFL"),
    ("ms-pl", r"MS-PL", r"Microsoft Public", r"opensource\.org/licenses?/ms-pl"),
    ("osl-3.0", r"OSL-3\.0", r"Open Software License,? ?(?:version |v\.? ?)?3\.0", r"opensource\.org/licenses?/osl-3\.0"),
    ("afl-3.0", r"AFL-3\.0", r"Academic Free License,? ?(?:version |v\.? ?)?3\.0", r"opensource\.org/licenses?/afl-3\.0"),
    ("ncsa", r"NCSA", r"(?:University of Illinois/)?NCSA(?: Open Source)?", r"opensource\.org/licenses?/ncsa"),
    ("upl-1.0", r"UPL-1\.0", r"Universal Permissive", r"opensource\.org/licenses?/upl"),
    ("public-domain", r"LicenseRef-public-domain", r"(?:released|placed|dedicated) (?:in)?to the public domain", r"creativecommons\.org/publicdomain/mark"),
    ("all-rights-reserved", r"LicenseRef-all-rights", r"all rights reserved", r"LicenseRef-proprietary"),
]

#: Forms in which a license is named: priority, score, regex around its parts, what stands in it besides these.
FORMS = (
    (4, 1.0, r"(?i)SPDX-License-Identifier:\s*(?:{id})(?![\w.+-])", "spdx-license-identifier:"),
    (3, 0.95, r"(?i)(?:https?://)?(?:www\.)?{url}(?:[\w./-]*\w)?", ""),
    (2, 0.9, r"(?i)\b(?:licen[cs]ed|released|distributed|available|provided|published)\s+under\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?{name}(?![\w])(?:\s+licen[cs]e)?", "under"),
    (1, 0.8, r"(?i)\b{name}(?!\w)(?:\s+licen[cs]e\b)", "licen"),
)


def literals(pattern: str) -> list[tuple[str, ...]]:
    """What any match contains, lower-cased: all words of one of the tuples, the longest word first."""

    def options(x) -> list[str] | None:
        return [chr(c) for kind, c in x] if len(x) <= 4 and all(kind is C.LITERAL for kind, _ in x) else None

    def walk(items, states):
        for kind, x in items:
            if kind is C.LITERAL:
                states = {(words, tail + chr(x).lower()) for words, tail in states}
            elif kind is C.SUBPATTERN:
                states = walk(x[3], states)
            elif kind is C.BRANCH:
                states = set().union(*(walk(part, states) for part in x[1]))
            elif kind is C.IN and options(x):
                states = {(words, tail + c.lower()) for words, tail in states for c in options(x)}
            elif kind not in (C.AT, C.ASSERT, C.ASSERT_NOT):  # what is optional or of many kinds ends a word
                states = {(words | {tail}, "") for words, tail in states}
                if kind in (C.MAX_REPEAT, C.MIN_REPEAT) and x[0]:
                    states = {(words | {tail}, "") for words, tail in walk(x[2], states)}
        return states

    found = {words | {tail} for words, tail in walk(_parser.parse(pattern), {(frozenset(), "")})}
    # a word inside another says nothing more
    least = {tuple(sorted((w for w in words if w and not any(w != v and w in v for v in words)), key=lambda w: (-len(w), w))) for words in found}
    return sorted(least)


def rules() -> list[dict]:
    """The ordered signature rules: a rule for each family and form."""
    out = []
    for label, spdx, name, url in FAMILIES:
        for priority, score, form, fixed in FORMS:
            loose = "licen" in name.lower() or label in ("public-domain", "all-rights-reserved") or label.startswith(("cc", "gpl", "lgpl", "agpl", "apache-", "mpl", "epl"))
            body = form.replace(r"(?:\s+licen[cs]e\b)", r"(?:\s+licen[cs]e\b)?") if loose and priority == 1 else form
            part = {4: spdx, 3: url}.get(priority, name)
            needs = sorted({tuple(sorted({*words, fixed if body == form else ""} - {""}, key=lambda w: (-len(w), w))) for words in literals(part.replace(" ", r"\s+"))})
            pattern = body.replace("{id}", spdx).replace("{url}", url).replace("{name}", name.replace(" ", r"\s+"))
            out.append({"label": label, "needs": needs, "priority": priority, "score": score, "pattern": pattern})
    return out


def stems() -> list[str]:
    """A text without any of these cannot match a rule: a literal of each branch of each rule."""
    keys = {words[0] for r in rules() for words in r["needs"]}
    return sorted(k for k in keys if not any(k != other and other in k for other in keys))


def gates() -> tuple[list[str], list[list[int]], list[list[str]], list[int]]:
    """Longest words, and for each the branches that need it; each branch's other words, and its rule."""
    branches = [(words, i) for i, r in enumerate(rules()) for words in r["needs"]]
    keys = sorted({words[0] for words, _ in branches})
    places = [[n for n, (words, _) in enumerate(branches) if words[0] == k] for k in keys]
    return keys, places, [list(words[1:]) for words, _ in branches], [i for _, i in branches]


def base_pattern() -> str:
    phrases = "|".join(f"{GAP}+".join(p.split(" ")) for p in PHRASES)
    return f"(?i)(?<!{WORD})(?:{phrases})(?!{WORD})"


def detections(text: Column, low: Column) -> Column:
    """Detections of a text that are left after suppression: array<struct<start, upto, rank, rule>>."""
    table = rules()
    column = lambda k: F.lit([r[k] for r in table])
    keys, places, rest, of = gates()
    # a branch's other words are looked for where its longest is there, and its rule runs where all are
    met = F.filter(F.sequence(F.lit(0), F.lit(len(keys) - 1)), lambda k: F.contains(low, F.get(F.lit(keys), k)))
    met = F.filter(F.flatten(F.transform(met, lambda k: F.get(F.lit(places), k))), lambda e: F.forall(F.get(F.lit(rest), e), lambda w: F.contains(low, w)))
    gate = F.array_sort(F.array_distinct(F.transform(met, lambda e: F.get(F.lit(of), e))))
    found = F.flatten(
        F.transform(
            gate,
            lambda r: let(
                F.get(column("pattern"), r),
                lambda p: F.transform(spans(text, p), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("upto"), (-F.get(column("priority"), r)).alias("rank"), r.alias("rule"))),
            ),
        )
    )
    # sorted by start, then the longest, then the highest priority: what may contain a detection stands before it,
    # and a detection goes if the farthest end before it, among its own and higher priorities, is not before its end
    levels = max(r["priority"] for r in table)

    def step(ends: Column, x: Column) -> tuple[Column, Column]:
        kept = F.when(F.get(ends, -x["rank"] - 1) >= -x["upto"], F.array().cast(f"array<{_FOUND}>")).otherwise(F.array(x))
        return F.transform(ends, lambda e, i: F.when(i < -x["rank"], F.greatest(e, -x["upto"])).otherwise(e)), kept

    return folded(F.array_sort(found), F.lit([-1] * levels), step, _FOUND)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, a row a document.

    A null text counts as empty; an empty text has no words, no labels, score 0 and null positions.
    Repeated rows are scanned each by itself, other columns are ignored, an empty table gives no rows.
    Texts of any length are scanned whole. Equal detections count once, by the first rule.
    """
    base = F.lit(base_pattern())
    words = lambda c: F.regexp_count(c, F.lit(f"{WORD}+"))
    none = F.array().cast("array<string>")
    table = rules()
    look = F.exists(F.lit(stems()), lambda k: F.contains(F.col("low"), k))
    rows = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("low", F.lower("text"))
        .withColumn("n_words", words(F.col("text")).cast("long"))
        .withColumn("hits", F.when(F.contains("low", F.lit("license")) | F.contains("low", F.lit("cc")), F.regexp_extract_all("text", base, F.lit(0))).otherwise(none))
        .withColumn("gaps", F.when(F.size("hits") > 0, F.split("text", base_pattern(), -1)))
        .withColumn("found", F.when(look, detections(F.col("text"), F.col("low"))).otherwise(F.array().cast(f"array<{_FOUND}>")))
    )
    label = F.create_map(*[F.lit(x) for p, name in PHRASES.items() for x in (p.split(" ")[0], name)])
    own = F.transform("hits", lambda h: F.element_at(label, F.lower(F.regexp_extract(h, f"{WORD}+", 0))))
    named = F.transform("found", lambda d: F.get(F.lit([r["label"] for r in table]), d["rule"]))
    scores = F.transform("found", lambda d: F.get(F.lit([r["score"] for r in table]), d["rule"]))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return rows.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_base"),
        F.when(F.size("hits") > 0, words(F.element_at("gaps", 1))).cast("long").alias("first_word"),
        F.when(F.size("hits") > 0, F.col("n_words") - words(F.element_at("gaps", -1)) - words(F.element_at("hits", -1))).cast("long").alias("last_word"),
        joined(own).alias("base_labels"),
        joined(F.concat(own, named)).alias("labels"),
        F.greatest(F.coalesce(F.array_max(scores), F.lit(0.0)), F.when(F.size("hits") > 0, 0.6).otherwise(0.0)).alias("score"),
        F.size("found").alias("n_detections"),
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
