"""Repair of a conversation's turns at the least cost.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles: perhaps a system turn, then user and
assistant in turn. Every row is kept, given another role or deleted, and empty turns may be inserted. The cheapest
edits come from a program over the retained rows. Its states are the last retained role, and none. What lies between
two retained rows is deleted: its price is a difference of prefix sums, so each state keeps one running minimum of cost less
prefix, and a gap needs no loop. The pair of roles around a gap says what is inserted there.

Among equal costs the audit that is least in ASCII wins. An audit is never built to compare it: edits of the live
states for the same rows are never one the beginning of the other (they hold as many row edits, and end with one), so their
order stays whatever is appended to both, and a rank of four states and the new edits decide.

Rows are shuffled once by conversation and sorted. A task passes over one conversation after another and holds less than a
hundred bytes a row of the one at hand; its texts wait in a spool that goes to the task's disk beyond a bound.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, crc_mod

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLED, DELETED, INSERTED, TRUNCATED = 3, 4, 3, 3
ROLE = {"u": "user", "a": "assistant"}
#: States: no row retained, or the initial of the last one that is.
STATES = ("", "s", "u", "a")
#: Roles to insert between two retained rows, by their initials ("" is an end of the conversation).
BETWEEN = {
    ("", "s"): "", ("", "u"): "", ("", "a"): "u", ("s", "u"): "", ("s", "a"): "u", ("u", "a"): "", ("u", "u"): "a", ("a", "u"): "", ("a", "a"): "u",
    ("", ""): "", ("s", ""): "ua", ("u", ""): "a", ("a", ""): "",
}
#: Bytes of a conversation's texts that wait in memory.
SPOOL = 1 << 24
#: First faults of a row, by their places in the counts.
SOUND, BLANK, DUPLICATE, CUT = 0, 1, 2, 3


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times) of rows of conversations: what damage by a checksum of id and turn leaves.

    Nulls in role and text, and in the checksum's id and turn, are one space. ``times`` is 0 for a dropped row,
    2 for one that is repeated. Other columns are left out.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = crc_mod(F.concat(space("conv_id"), F.lit(":"), space("turn")), 20)
    text = F.when(kind <= 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(space("role")).alias("role"), F.when(kind != 0, text).alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"))


def cheapest(initials: list[str], faults: list[int]) -> tuple[int, list[tuple[str, str]]]:
    """The least cost and its edits in order: (edit, initial of the role it gives), the initial empty for a deletion.

    ``initials`` and ``faults`` are those of the rows. Takes time in proportion to the rows, and three bytes a row to go
    back: for each role the state before it, where this row is retained in it.
    """
    # of each state: cost less the deletions up to here, and its rank among the live states' audits
    cost, rank = {"": 0}, {"": 0}
    steps, deletions = bytearray(), 0
    for initial, fault in zip(initials, faults):
        best = {p: (c + deletions + DELETED, (rank[p], DELETE), 0) for p, c in cost.items()}
        if fault not in (BLANK, DUPLICATE):
            for role in STATES[1:]:
                if role != initial and role not in ROLE:
                    continue
                own = (TRUNCATED if fault == CUT else 0) + (0 if role == initial else REROLED)
                for n, p in enumerate(STATES):
                    new = BETWEEN.get((p, role))
                    if new is None or p not in cost:
                        continue
                    this = (cost[p] + deletions + INSERTED * len(new) + own, (rank[p], INSERT * len(new) + (KEEP if role == initial else REROLE)), n + 1)
                    if role not in best or this < best[role]:
                        best[role] = this
        deletions += DELETED
        order = {key: n for n, key in enumerate(sorted(key for _, key, _ in best.values()))}
        cost = {r: c - deletions for r, (c, _, _) in best.items()}
        rank = {r: order[key] for r, (_, key, _) in best.items()}
        steps += bytes(best[r][2] if r in best else 0 for r in STATES[1:])
    total, _, state = min((c + deletions + INSERTED * len(BETWEEN[p, ""]), (rank[p], INSERT * len(BETWEEN[p, ""])), p) for p, c in cost.items())
    back = [(INSERT, x) for x in reversed(BETWEEN[state, ""])]
    for i in range(len(initials) - 1, -1, -1):
        came = steps[3 * i + STATES.index(state) - 1] if state else 0
        if not came:
            back.append((DELETE, ""))
            continue
        p, role = STATES[came - 1], state
        back.append((KEEP if role == initials[i] else REROLE, role))
        back += [(INSERT, x) for x in reversed(BETWEEN[p, role])]
        state = p
    return total, back[::-1]


class Conversation:
    """The rows of one conversation as they pass, and what is said of them at its end."""

    ends = frozenset(b".!?")
    space = bytes([0x20, *range(9, 14)])

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.initials, self.lengths, self.ended = [], array("q"), bytearray()
        # rows come by turn, so the last one and counts are enough
        self.least = self.most = None
        self.distinct = self.illegal = 0
        self.digests = bytearray()
        self.texts = tempfile.SpooledTemporaryFile(SPOOL)

    def add(self, turn, role: str, text: str, times: int) -> None:
        if not times:
            return
        if turn is not None and turn != self.most:
            self.least = turn if self.least is None else self.least
            self.most, self.distinct = turn, self.distinct + 1
        initial, role, text = role[:1], role.encode(), text.encode()
        shown = text.rstrip(self.space)
        digest = hashlib.blake2b(len(role).to_bytes(8, "little") + role + text, digest_size=16).digest()
        for _ in range(times):
            if self.initials and self.initials[-1] + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.initials.append(initial)
            self.ended.append(BLANK if not shown else SOUND if shown[-1] in self.ends else CUT)
            self.digests += digest
            self.lengths.extend((len(role), len(text)))
            self.texts.write(role + text)

    def repaired(self) -> tuple[dict, list[tuple[str, str]]]:
        """Counts, cost and audit, and the edits."""
        faults = np.frombuffer(self.ended, np.uint8).copy()
        if len(faults):
            _, first = np.unique(np.frombuffer(self.digests, "V16"), return_index=True)
            again = np.ones(len(faults), bool)
            again[first] = False
            faults[again & (faults != BLANK)] = DUPLICATE
        cost, edits = cheapest(self.initials, faults.tolist())
        count = np.bincount(faults, minlength=4)
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        said = {"conv_id": self.conv_id, "gaps": gaps, "blank": int(count[BLANK]), "duplicate": int(count[DUPLICATE]), "truncated": int(count[CUT]), "illegal": self.illegal, "cost": cost, "audit": "".join(e for e, _ in edits)}
        return said, edits

    def turns_of(self, edits):
        """(edit, role, text) in UTF-8 of what stays, in order."""
        self.texts.seek(0)
        lengths = iter(self.lengths)
        for edit, initial in edits:
            if edit == INSERT:
                yield edit, ROLE[initial].encode(), b""
                continue
            n, m = next(lengths), next(lengths)
            role, text = self.texts.read(n), self.texts.read(m)
            if edit != DELETE:
                yield edit, ROLE[initial].encode() if edit == REROLE else role, text


def _walked(batches, end):
    """Runs of rows with equal conv_id, in order, each given to ``end`` when it is whole."""
    now = None
    for batch in batches:
        for conv_id, turn, role, text, times in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    yield from end(now)
                now = Conversation(conv_id)
            now.add(turn, role, text, times)
    if now is not None:
        yield from end(now)


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows of a conversation side by side, by turn, nulls first; rows of one turn by role and text."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("conv_id", "turn", "role", "text", "times")
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def _batches(rows, schema: pa.Schema, many: int = 4096, most: int = 1 << 24):
    """Record batches of dictionaries, of bounded numbers of rows and of bytes of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("text") or row.get("audit") or "")
        if len(held) >= many or size >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def audits(rows: DataFrame) -> DataFrame:
    """One row a conversation of ``rows`` (conv_id, turn, role, text, times): its faults, cost, audit and digest.

    Each row's first fault counts: blank (nothing but ASCII white space), duplicate (same role and text as an earlier row),
    truncated (does not end in one of ``.!?``). ``gaps`` is the number of turns missing between the first and the last,
    ``illegal`` that of neighbours whose roles' initials are none of su, ua and au. ``repaired_sha256`` is of the repaired
    turns as ``role:text``, joined by line feeds.

    Rows of one turn are ordered by role and text; equal rows are duplicates of each other. Turns may be null, and come
    first. Rows without conv_id make one conversation. Rows that occur no time count for nothing, but their
    conversation is still returned, with zeros, an empty audit and the digest of nothing. Other columns are left out;
    an empty table gives no rows. Texts of any length are treated whole, and wait on disk where they are long.
    """
    schema = rows.select("conv_id").schema.add("gaps", "long").add("blank", "long").add("duplicate", "long").add("truncated", "long").add("illegal", "long").add("cost", "long").add("audit", "string").add("repaired_sha256", "string")

    def end(it: Conversation):
        said, edits = it.repaired()
        digest, between = hashlib.sha256(), b""
        for _, role, text in it.turns_of(edits):
            for part in (between, role, b":", text):
                digest.update(part)
            between = b"\n"
        it.texts.close()
        yield said | {"repaired_sha256": digest.hexdigest()}

    def each(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from _batches(_walked(batches, end), to_arrow_schema(schema))

    return _in_order(rows).mapInArrow(each, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired turns: (conv_id, place, edit, role, text), place from 0 in each conversation. See ``audits``."""
    schema = rows.select("conv_id").schema.add("place", "long").add("edit", "string").add("role", "string").add("text", "string")

    def end(it: Conversation):
        _, edits = it.repaired()
        for place, (edit, role, text) in enumerate(it.turns_of(edits)):
            yield {"conv_id": it.conv_id, "place": place, "edit": edit, "role": role.decode(), "text": text.decode()}
        it.texts.close()

    def each(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from _batches(_walked(batches, end), to_arrow_schema(schema))

    return _in_order(rows).mapInArrow(each, schema)


def undamaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations as ``audits`` and ``repaired`` take them: nulls in role and text are one space, each row occurs once."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), F.lit(1).alias("times"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _state(last: str, candidates: list[str]) -> str:
    """Least of some candidate states ({c, a, t}), as SQL."""
    return f"list_min([{', '.join(candidates)}]) AS {last}"


def _sql() -> str:
    """The same in DuckDB, where whole audits are compared: a recursive step a row, for all conversations at once."""
    step = lambda p, cost, audit, text="''": f"CASE WHEN {p} IS NOT NULL THEN {{'c': {p}.c + {cost}, 'a': {p}.a || '{audit}', 't': {p}.t || {text}}} END"
    names = {"": "x.n", "s": "x.s", "u": "x.u", "a": "x.a"}
    columns = []
    for role in STATES:
        found = [step(names[role], 4, "D")]
        if role:
            for (p, r), new in BETWEEN.items():
                if r != role:
                    continue
                added = "".join(f"{ROLE[x]}:\n" for x in new)
                for edit, price, want, shown in ((KEEP, 0, f"initial = '{role}'", "role"), (REROLE, REROLED, f"initial <> '{role}'", f"'{ROLE.get(role)}'")):
                    if edit == REROLE and role == "s":
                        continue
                    made = step(names[p], f"{INSERTED * len(new) + price} + CASE WHEN fault = 3 THEN {TRUNCATED} ELSE 0 END", INSERT * len(new) + edit, f"'{added}' || {shown} || ':' || text || chr(10)")
                    found.append(f"CASE WHEN fault NOT IN (1, 2) AND {want} THEN {made} END")
        columns.append(_state(names[role][2:], found))
    ends = [step(names[p], INSERTED * len(BETWEEN[p, ""]), INSERT * len(BETWEEN[p, ""]), "'" + "".join(f"{ROLE[x]}:\n" for x in BETWEEN[p, ""]) + "'") for p in STATES]
    kind = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
    # zlib's checksum, bit by bit over the bytes of the key
    return rf"""
WITH RECURSIVE keyed AS (
  SELECT row_number() OVER () AS id, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations),
sums AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [1::BIGINT, 1, 1, 1, 1, 1, 1, 1]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS kind
  FROM keyed),
hurt AS (
  SELECT id, conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM sums WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER w AS place, lag(role) OVER w AS before, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, id, copy) AS seen,
         right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS tail
  FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, id, copy)),
faulty AS (
  SELECT *, CASE WHEN tail = '' THEN 1 WHEN seen > 1 THEN 2 WHEN tail NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM placed),
facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 1)::BIGINT AS blank,
         count(*) FILTER (WHERE fault = 2)::BIGINT AS duplicate, count(*) FILTER (WHERE fault = 3)::BIGINT AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND left(before, 1) || initial NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal
  FROM faulty GROUP BY conv_id),
states AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS done, {{'c': 0::BIGINT, 'a': '', 't': ''}}::{kind} AS n, NULL::{kind} AS s, NULL::{kind} AS u, NULL::{kind} AS a FROM conversations
  UNION ALL
  SELECT x.conv_id, done + 1, {', '.join(columns)}
  FROM states x JOIN faulty f ON x.conv_id IS NOT DISTINCT FROM f.conv_id AND f.place = done + 1),
ended AS (
  SELECT x.conv_id, f.gaps, f.blank, f.duplicate, f.truncated, f.illegal, list_min([{', '.join(ends)}]) AS best
  FROM states x LEFT JOIN facts f ON x.conv_id IS NOT DISTINCT FROM f.conv_id WHERE done = coalesce(f.n, 0))
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, best.c AS cost, best.a AS audit, sha256(left(best.t, greatest(length(best.t) - 1, 0))) AS repaired_sha256
FROM ended
"""


OP13_SQL = _sql()
