"""The gates of the license rules let through all that the rules match."""

import re
from re import _constants as C
from re import _parser

from narrata.llm import licenses


def samples(pattern: str, most: bool = False) -> list[str]:
    """A text a branch of a regex, with what is optional left out or, if ``most``, put in once."""

    def walk(items, out):
        for kind, x in items:
            if kind is C.LITERAL:
                out = [s + chr(x) for s in out]
            elif kind is C.SUBPATTERN:
                out = walk(x[3], out)
            elif kind is C.BRANCH:
                out = [s for part in x[1] for s in walk(part, out)]
            elif kind in (C.MAX_REPEAT, C.MIN_REPEAT):
                for _ in range(x[0] or (1 if most else 0)):
                    out = walk(x[2], out)
            elif kind is C.IN:
                first, value = x[0]
                chars = [chr(c) for k, c in x if k is C.LITERAL] if all(k is C.LITERAL for k, _ in x) else [" " if value is C.CATEGORY_SPACE else "x"]
                out = [s + c for s in out for c in chars]
        return out

    return walk(_parser.parse(pattern), [""])


def test_first_gate_passes_every_rule(spark):
    stems = licenses.stems()
    for rule in licenses.rules():
        for text in samples(rule["pattern"]) + samples(rule["pattern"], True):
            assert re.search(rule["pattern"], text), (rule, text)
            assert any(s in text.lower() for s in stems), (rule, text)
    texts = {1: "2024, All rights reserved.", 2: "All\nRights  Reserved", 3: "see mozilla.org/MPL/2.0 here", 4: "released under Apache 2.0", 5: "nothing"}
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {1: "all-rights-reserved", 2: "all-rights-reserved", 3: "mpl-2.0", 4: "apache-2.0", 5: ""}


def test_every_branch_of_every_rule_fires(spark):
    """Against all rules' regexes run without gates; some words stand on a line of their own."""
    table = licenses.rules()
    assert len(table) == 260
    texts = sorted({t for r in table for most in (False, True) for s in samples(r["pattern"], most) for t in (s, s.replace(" ", "\n"))})
    texts += ["Common Development and\nDistribution License 1.0", "European Union Public Licence 1.2", "SIL Open Font License", "Creative Commons Attribution 4.0", "SPDX-License-Identifier: BSL-1.0", "SPDX-License-Identifier: PSF-2.0"]
    compiled = [re.compile(r["pattern"], re.ASCII) for r in table]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    fired = set()
    for i, text in enumerate(texts):
        found = sorted((m.start(), -m.end(), -table[n]["priority"], n) for n, p in enumerate(compiled) for m in p.finditer(text))
        fired |= {n for *_, n in found}
        left = [x for k, x in enumerate(found) if not any(y[1] <= x[1] and y[2] <= x[2] for y in found[:k])]
        labels = {table[n]["label"] for *_, n in left}
        assert got[i].n_detections == len(left) > 0, (text, left)
        assert labels <= set(got[i].labels.split(",")) <= labels | set(licenses.PHRASES.values()), text
        assert got[i].score == max(table[n]["score"] for *_, n in left)
    assert fired == set(range(len(table)))
