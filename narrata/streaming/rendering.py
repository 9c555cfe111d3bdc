"""What a reader is shown while scenes are being made: per-scene state over a stream of events, with timers.

Events (session, ts, seq, kind, scene, content, provider) of one session come in order of time and seq. Of each session the state
keeps its scenes, the tokens that wait for a chunk, and when the state was last given out. A state is given out at
most once in ``EVERY`` ms of event time, a chunk when enough tokens wait or the first has waited long enough. What
is due is given out at its own time: by the next event of the session, or by a timer once the watermark is past it, whichever
comes first. So one batch, many, and a stop between them give the same rows.

Kinds of events: register, start, active, token, retry, skip, complete, error, cancel.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Milliseconds between states, tokens a scene is expected to have, tokens of a chunk, and milliseconds that one waits. Fixed values.
EVERY, EXPECTED, CHUNK, WAIT = 50, 500, 8, 100
OPEN, DONE = ("pending", "streaming"), ("complete", "skipped")
SCHEMA = (
    "session long, n long, ts long, kind string, scene string, content string, progress double, completed long, scenes long, tokens long, "
    "first_ms long, tokens_per_second double, streaming boolean, provider string, error string"
)
SCENE = "place long, status string, tokens long, chunks long, progress double, expected long, started long, ended long, error string"
SESSION = (
    "active string, streaming boolean, error string, provider string, started long, first long, tokens long, chunks long, given long, "
    "pending long, waiting string, waits long, due long, timer long, n long"
)
FRESH = {"active": None, "streaming": False, "error": None, "provider": None, "started": 0, "first": 0, "tokens": 0, "chunks": 0, "given": 0, "pending": None, "waiting": "", "waits": 0, "due": None, "timer": None, "n": 0}


def fresh_scene(place: int) -> dict:
    return {"place": place, "status": "pending", "tokens": 0, "chunks": 0, "progress": 0.0, "expected": EXPECTED, "started": 0, "ended": 0, "error": None}


class Session:
    """One session while its events are worked on: its own state and that of its scenes."""

    def __init__(self, key: int, now: dict, scenes: dict[str, dict]):
        self.key, self.now, self.scenes, self.changed = key, now, scenes, set()

    def scene(self, name: str) -> dict:
        if name not in self.scenes:
            self.scenes[name] = fresh_scene(len(self.scenes))
        self.changed.add(name)
        return self.scenes[name]

    def row(self, ts: int, kind: str, scene: str | None = None, content: str | None = None) -> Row:
        """A row to give out: what is said and the reader's state at that time."""
        now, all_ = self.now, sorted(self.scenes.values(), key=lambda s: s["place"])
        now["n"] += 1
        took = ts - now["started"]
        return Row(
            session=self.key, n=now["n"], ts=ts, kind=kind, scene=scene, content=content, progress=sum(s["progress"] for s in all_) / len(all_) if all_ else 0.0,
            completed=sum(s["status"] in DONE for s in all_), scenes=len(all_), tokens=now["tokens"], first_ms=now["first"] - now["started"] if now["first"] else 0,
            tokens_per_second=now["tokens"] * 1000.0 / took if took > 0 else 0.0, streaming=now["streaming"], provider=now["provider"], error=now["error"],
        )

    def state(self, ts: int) -> Row:
        self.now["given"], self.now["pending"] = ts, None
        return self.row(ts, "state")

    def chunk(self, ts: int) -> Iterator[Row]:
        """What waits, as a chunk of the active scene."""
        now = self.now
        text, now["waiting"], now["waits"], now["due"] = now["waiting"], "", 0, None
        if text:
            now["chunks"] += 1
            name = now["active"]
            if name in self.scenes and self.scenes[name]["status"] not in DONE:
                self.scene(name)["chunks"] += 1
            yield self.row(ts, "chunk", name, text)

    def fall_due(self, upto: int) -> Iterator[Row]:
        """Gives out what was due by a time, each at its own."""
        now = self.now
        while True:
            at = min((t, which) for t, which in ((now["pending"], 0), (now["due"], 1)) if t is not None) if now["pending"] is not None or now["due"] is not None else None
            if at is None or at[0] > upto:
                return
            if at[1]:
                yield from self.chunk(at[0])
            else:
                yield self.state(at[0])

    def event(self, e: Row) -> Iterator[Row]:
        now, ts, kind, name = self.now, e.ts_ms, e.kind, e.scene
        yield from self.fall_due(ts)
        if kind == "register" and name is not None:
            self.scene(name)
        elif kind == "start":
            now["streaming"], now["started"], now["provider"] = True, ts, e.provider
            yield self.row(ts, "stream:start")
        elif kind == "active" and name is not None:
            now["active"] = name
            scene = self.scene(name)
            if scene["status"] == "pending":
                scene["status"], scene["started"] = "streaming", ts
            yield self.row(ts, "scene:start", name)
        elif kind == "skip" and name is not None:
            self.scene(name).update(status="skipped", progress=1.0, ended=ts)
            yield self.row(ts, "scene:skipped", name, e.content)
        elif kind == "token":
            yield from self.token(e)
        elif kind == "retry":
            now["provider"] = e.provider
            yield self.row(ts, "notification", now["active"])
        elif kind == "complete":
            yield from self.chunk(ts)
            name = now["active"]
            if name in self.scenes and self.scenes[name]["status"] != "skipped":
                self.scene(name).update(status="complete", progress=1.0, ended=ts)
                yield self.row(ts, "scene:complete", name)
            if all(s["status"] not in OPEN for s in self.scenes.values()):
                now["streaming"] = False
                yield self.row(ts, "stream:complete")
        elif kind == "error":
            name, now["error"] = now["active"], e.content or "Unknown stream error"
            if name in self.scenes and self.scenes[name]["status"] not in DONE:
                self.scene(name).update(status="error", error=now["error"])
            yield self.row(ts, "scene:error", name, now["error"])
        elif kind == "cancel":
            for name, scene in self.scenes.items():
                if scene["status"] in OPEN:
                    self.scene(name).update(status="error", error="cancelled")
            now["streaming"], now["error"] = False, "cancelled"
            yield self.row(ts, "stream:cancel")

    def token(self, e: Row) -> Iterator[Row]:
        now, ts = self.now, e.ts_ms
        now["tokens"] += 1
        now["first"] = now["first"] or ts
        name = now["active"]
        if name in self.scenes and self.scenes[name]["status"] not in DONE:
            scene = self.scene(name)
            scene["status"], scene["tokens"] = "streaming", scene["tokens"] + 1
            scene["progress"] = min(0.99, scene["tokens"] / scene["expected"])
            now["provider"] = e.provider or now["provider"]
            if ts - now["given"] >= EVERY:
                yield self.state(ts)
            elif now["pending"] is None:
                now["pending"] = now["given"] + EVERY
        now["waiting"], now["waits"] = now["waiting"] + (e.content or ""), now["waits"] + 1
        if now["waits"] >= CHUNK:
            yield from self.chunk(ts)
        elif now["due"] is None:
            now["due"] = ts + WAIT


class Bridge(StatefulProcessor):
    """Keeps ``Session`` in the state store: a value, and its scenes in a map of which only changed ones are written."""

    def init(self, handle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", SESSION)
        self.scenes = handle.getMapState("scenes", "scene string", SCENE)

    def _held(self, key: tuple) -> Session:
        now = dict(zip(FRESH, self.session.get())) if self.session.exists() else dict(FRESH)
        names = list(fresh_scene(0))
        return Session(key[0], now, {k[0]: dict(zip(names, v)) for k, v in self.scenes.iterator()} if self.session.exists() else {})

    def _keep(self, it: Session) -> None:
        """Writes what changed, and sets the timer to what is due next."""
        due = min((t for t in (it.now["pending"], it.now["due"]) if t is not None), default=None)
        if due != it.now["timer"]:
            if it.now["timer"] is not None:
                self.handle.deleteTimer(it.now["timer"])
            if due is not None:
                self.handle.registerTimer(due)
            it.now["timer"] = due
        for name in it.changed:
            self.scenes.updateValue((name,), tuple(it.scenes[name].values()))
        self.session.update(tuple(it.now.values()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        it = self._held(key)
        for e in sorted(rows, key=lambda r: (r.ts_ms, r.seq)):
            yield from it.event(e)
        self._keep(it)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        it = self._held(key)
        it.now["timer"] = None
        yield from it.fall_due(expiredTimerInfo.getExpiryTimeInMs())
        self._keep(it)

    def close(self) -> None:
        pass


def rendered(events: DataFrame, late: str = "1 second") -> DataFrame:
    """SCHEMA over a stream of events (session, ts, seq, kind, scene, content, provider): what is given out, numbered by n in each session."""
    rows = events.select("session", "ts", F.unix_millis("ts").alias("ts_ms"), "seq", "kind", "scene", "content", "provider").withWatermark("ts", late)
    return rows.groupBy("session").transformWithState(Bridge(), SCHEMA, "Append", "EventTime")
