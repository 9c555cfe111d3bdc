"""What readers are shown, against a plain replay of the same rules; in one batch and in many."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from narrata.streaming import events as streams
from narrata.streaming import rendering

SCHEMA = "session long, ts timestamp, seq long, kind string, scene string, content string, provider string"


def replayed(events, upto=None):
    """(kind, ts, scene, content, progress, completed, scenes, tokens, streaming) by a plain loop over (ts, kind, scene, content, provider) of one session, and what is due after them by ``upto``."""
    out, scenes, text, waits = [], {}, "", 0
    active, streaming, tokens, given, clock = None, False, 0, 0, {}

    def say(kind, ts, scene=None, content=None):
        done = sum(s["status"] in ("complete", "skipped") for s in scenes.values())
        share = sum(s["progress"] for s in scenes.values()) / len(scenes) if scenes else 0.0
        out.append((kind, ts, scene, content, share, done, len(scenes), tokens, streaming))

    def scene(name):
        return scenes.setdefault(name, {"status": "pending", "progress": 0.0, "tokens": 0})

    def flush(ts):
        nonlocal text, waits
        clock.pop("chunk", None)
        held, text, waits = text, "", 0
        if held:
            say("chunk", ts, active, held)

    for ts, kind, name, content, _ in [*events, (upto, "end", None, None, None)]:
        for which, at in sorted(clock.items(), key=lambda x: (x[1], x[0] == "chunk")):
            if which in clock and (ts is None or at <= ts):
                if which == "chunk":
                    flush(at)
                else:
                    clock.pop("state")
                    given = at
                    say("state", at)
        if kind == "register":
            scene(name)
        elif kind == "start":
            streaming = True
            say("stream:start", ts)
        elif kind == "active":
            active = name
            if scene(name)["status"] == "pending":
                scene(name)["status"] = "streaming"
            say("scene:start", ts, name)
        elif kind == "skip":
            scene(name).update(status="skipped", progress=1.0)
            say("scene:skipped", ts, name, content)
        elif kind == "token":
            tokens += 1
            s = scenes.get(active)
            if s and s["status"] not in ("complete", "skipped"):
                s["status"], s["tokens"] = "streaming", s["tokens"] + 1
                s["progress"] = min(0.99, s["tokens"] / rendering.EXPECTED)
                if ts - given >= 50:
                    clock.pop("state", None)
                    given = ts
                    say("state", ts)
                else:
                    clock.setdefault("state", given + 50)
            text, waits = text + (content or ""), waits + 1
            if waits >= 8:
                flush(ts)
            else:
                clock.setdefault("chunk", ts + 100)
        elif kind == "complete":
            flush(ts)
            if active in scenes and scenes[active]["status"] != "skipped":
                scenes[active].update(status="complete", progress=1.0)
                say("scene:complete", ts, active)
            if all(s["status"] not in ("pending", "streaming") for s in scenes.values()):
                streaming = False
                say("stream:complete", ts)
        elif kind == "error":
            if active in scenes and scenes[active]["status"] not in ("complete", "skipped"):
                scenes[active]["status"] = "error"
            say("scene:error", ts, active, content or "Unknown stream error")
        elif kind == "cancel":
            for s in scenes.values():
                if s["status"] in ("pending", "streaming"):
                    s["status"] = "error"
            streaming = False
            say("stream:cancel", ts)
        elif kind == "retry":
            say("notification", ts, active)
    return out


@pytest.fixture(scope="module")
def events():
    rng = random.Random(6)
    out = []
    for session in range(12):
        ts = 1_700_000_000_000 + rng.randrange(500)
        if session:
            out += [(session, ts, 0, "start", None, None, "p"), (session, ts, 1, "register", "a", None, None), (session, ts, 2, "register", "b", None, None)]
        for seq in range(3, 160):
            ts += rng.choice([0, 1, 5, 9, 20, 60, 130])
            kind = rng.choices(["token", "active", "complete", "skip", "error", "retry", "cancel"], [60, 3, 2, 1, 1, 1, 0.2])[0]
            out.append((session, ts, seq, kind, rng.choice("abc") if kind in ("active", "skip") else None, rng.choice(["x", "yy ", None, "z\n\n"]), rng.choice(["p", None])))
    # one that ends the stream, so that the watermark passes all that is due
    return out + [(99, 1_700_000_900_000, 0, "register", "last", None, None)]


def run(spark, folder, out, batches, events):
    rows = spark.createDataFrame(events, "session long, ms long, seq long, kind string, scene string, content string, provider string")
    rows = rows.select("session", F.timestamp_millis("ms").alias("ts"), "seq", "kind", "scene", "content", "provider")
    edges = sorted({e[1] for e in events})
    step = -(-len(edges) // batches)
    found = None
    for i in range(0, len(edges), step):
        rows.filter(F.unix_millis("ts").between(edges[i], edges[min(i + step, len(edges)) - 1])).coalesce(1).write.mode("append").parquet(folder)
        found = streams.settled(rendering.rendered(spark.readStream.schema(rows.schema).parquet(folder)), "append", at=out)
    return found.drop("batch")


def test_one_batch_and_many_are_as_a_plain_replay(spark, events, tmp_path):
    want = {}
    for s in {e[0] for e in events}:
        want[s] = replayed([e[1:2] + e[3:] for e in sorted((e for e in events if e[0] == s), key=lambda e: (e[1], e[2]))])
    for batches in (1, 4):
        got = {}
        for r in run(spark, str(tmp_path / f"in{batches}"), str(tmp_path / f"out{batches}"), batches, events).orderBy("session", "n").collect():
            got.setdefault(r.session, []).append((r.kind, r.ts, r.scene, r.content, r.progress, r.completed, r.scenes, r.tokens, r.streaming))
        assert {s: x for s, x in want.items() if x} == got, batches
    # no two states of a session within the time between them
    for rows in want.values():
        times = [ts for kind, ts, *_ in rows if kind == "state"]
        assert all(b - a >= 50 for a, b in zip(times, times[1:]))


def test_chunks_hold_all_tokens(events):
    for s in {e[0] for e in events}:
        mine = sorted((e for e in events if e[0] == s), key=lambda e: (e[1], e[2]))
        assert "".join(e[5] or "" for e in mine if e[3] == "token") == "".join(r[3] for r in replayed([e[1:2] + e[3:] for e in mine]) if r[0] == "chunk")


def test_the_query_over_all_events(spark, sf_dir):
    from narrata.plans import engine_queries

    static = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("event_id").collect()
    by, last = {}, 0
    for e in static:
        k = e.event_id % 97
        kind = {0: "active", 1: "complete", 2: "skip", 3: "error", 4: "retry"}.get(k, "token")
        us = round((e.ts.replace(tzinfo=timezone.utc) - datetime(2024, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))
        ms = 1_704_067_200_000 + us // 1_000_000_000
        last = max(last, ms)
        by.setdefault(e.user_id, []).append((ms, e.event_id, kind, f"s{e.event_id % 5}" if k in (0, 2) else None, e.event_type + " ", "p"))
    got = {}
    for r in engine_queries.rendered_scenes(spark, sf_dir).orderBy("session", "n").collect():
        got.setdefault(r.session, []).append((r.kind, r.ts, r.scene, r.content, r.progress, r.completed, r.scenes, r.tokens, r.streaming))
    for user, events in by.items():
        ordered = [(e[0], *e[2:]) for e in sorted(events)]
        # timers of what was due until the watermark: a second before the last event of all
        assert got.get(user, []) == replayed(ordered, last - 1000), user
