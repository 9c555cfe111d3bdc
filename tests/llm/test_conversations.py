"""Repair of conversations against all edits, tried one by one."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from narrata.llm import conversations as op

SCHEMA = "conv_id long, turn long, role string, text string, audit string, times int, place string"
PATTERN = re.compile(r"\A(s?(ua)+)?\Z")
SPACES = " \t\n\v\f\r"


def faults_of(rows):
    out = []
    for i, (role, text) in enumerate(rows):
        shown = text.rstrip(SPACES)
        out.append(op.BLANK if not shown else op.DUPLICATE if (role, text) in rows[:i] else op.CUT if shown[-1] not in ".!?" else op.SOUND)
    return out


def tried(rows):
    """(cost, audit, repaired turns) of the best of all edits, up to two insertions at a place."""
    faults = faults_of(rows)
    best = []

    def go(i, cost, audit, turns, inserted):
        shape = "".join(r[:1] or "-" for r, _ in turns)
        # a beginning of the pattern, else nothing can follow
        if not re.fullmatch(r"s?(ua)*u?", shape):
            return
        if i == len(rows) and PATTERN.match(shape):
            best.append((cost, audit, turns))
        if inserted < 2:
            for role in ("user", "assistant"):
                go(i, cost + 3, audit + "I", [*turns, (role, "")], inserted + 1)
        if i == len(rows):
            return
        role, text = rows[i]
        go(i + 1, cost + 4, audit + "D", turns, 0)
        if faults[i] not in (op.BLANK, op.DUPLICATE):
            more = 3 * (faults[i] == op.CUT)
            go(i + 1, cost + more, audit + "K", [*turns, (role, text)], 0)
            for new in ("user", "assistant"):
                go(i + 1, cost + 3 + more, audit + "R", [*turns, (new, text)], 0)

    go(0, 0, "", [], 0)
    return min(best, key=lambda x: x[:2])


def damaged(rows):
    """Rows (conv_id, turn, role, text) after damage, by conversation."""
    out = {}
    s = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else s(role), "" if kind == 1 else re.sub("[.!?]", "", s(text)) if kind == 2 else s(text)
        out.setdefault(conv, []).extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for k, v in out.items()}


def said(turned):
    rows = [(r, t) for _, r, t in turned]
    turns = {t for t, _, _ in turned if t is not None}
    faults = faults_of(rows)
    cost, audit, kept = tried(rows)
    pairs = [a[:1] + b[:1] for (a, _), (b, _) in zip(rows, rows[1:])]
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    text = "\n".join(f"{r}:{t}" for r, t in kept)
    return (gaps, faults.count(op.BLANK), faults.count(op.DUPLICATE), faults.count(op.CUT), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())


def test_cheapest_edits_are_those_of_all():
    rng = random.Random(3)
    roles = ["system", "user", "assistant", "tool", "", "unicorn", "Ä"]
    texts = ["Yes.", "No", "", " \n", "Yes.", "Why?", "x"]
    for _ in range(400):
        rows = [(rng.choice(roles[:3] if rng.random() < 0.7 else roles), rng.choice(texts)) for _ in range(rng.randrange(0, 6))]
        cost, audit, kept = tried(rows)
        got, edits = op.cheapest([r[:1] for r, _ in rows], faults_of(rows))
        assert (got, "".join(e for e, _ in edits)) == (cost, audit), rows
        assert [r[:1] for r, _ in kept] == [r for e, r in edits if e != op.DELETE]


def test_long_conversations_take_time_in_proportion():
    n = 60_000
    cost, edits = op.cheapest(list("suua" * (n // 4)), [0] * n)
    assert len(edits) >= n and cost > 0


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    roles = ["system", "user", "assistant", "user", "assistant", None, "tool", "é"]
    texts = ["Good.", "Bad", None, "", " \t", "Long " * 3000 + "end.", "é!", "Good."]
    out = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 6)):
            out.append((conv, None if rng.random() < 0.1 else turn * rng.choice([1, 1, 2]), rng.choice(roles), rng.choice(texts)))
    return out + [(None, 0, "user", "Hm."), (None, 1, "assistant", "So."), (7, 0, "user", "Again"), (7, 0, "user", "Again"), (-5, -3, "user", "Low."), (-5, 9, "assistant", "High.")]


def test_conversations_are_repaired_as_by_all_edits(spark, rows):
    df = spark.createDataFrame([(*r, "x", 9, "y") for r in rows], SCHEMA).repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in op.audits(op.damaged(df)).collect()}
    want = {conv: said(turned) for conv, turned in damaged(rows).items()}
    assert got == want
    # a conversation of which nothing is left
    gone = [x for x in want if not damaged(rows)[x]]
    assert all(got[x] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for x in gone)


def test_repaired_turns(spark, rows):
    df = spark.createDataFrame([(*r, "x", 9, "y") for r in rows], SCHEMA)
    by = {}
    for r in op.repaired(op.damaged(df)).orderBy("conv_id", "place").collect():
        by.setdefault(r.conv_id, []).append((r.role, r.text))
    for conv, turned in damaged(rows).items():
        assert by.get(conv, []) == tried([(r, t) for _, r, t in turned])[2]


def test_texts_beyond_the_spool_wait_on_disk(spark, monkeypatch):
    talk = spark.createDataFrame([(1, i, ["user", "assistant"][i % 2], "word " * 500_000 + f"{i}.") for i in range(8)], "conv_id long, turn long, role string, text string")
    row = op.audits(op.undamaged(talk)).first()
    assert row.audit == "K" * 8 and row.cost == 0
    assert row.repaired_sha256 == hashlib.sha256("\n".join(f"{['user', 'assistant'][i % 2]}:{'word ' * 500_000}{i}." for i in range(8)).encode()).hexdigest()


def test_empty_and_dropped(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op.audits(op.damaged(empty)).count() == 0 and op.repaired(op.undamaged(empty)).count() == 0
    rows = op.undamaged(spark.createDataFrame([(1, 0, "user", "Hi.")], empty.schema)).withColumn("times", F.lit(0))
    assert [tuple(r)[1:8] for r in op.audits(rows).collect()] == [(0, 0, 0, 0, 0, 0, "")]
