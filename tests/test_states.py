"""State that goes when its time is over: what is answered, and how many states are left."""

import time

import pytest
from pyspark.sql import functions as F

from narrata.streaming import events as streams


def ran(stream, folder, **trigger):
    """Rows of a stream over what is there, and the number of states it leaves."""
    with streams.rocks(stream.sparkSession):
        query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(**(trigger or {"availableNow": True})).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")).start()
    query.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return stream.sparkSession.read.parquet(f"{folder}/rows").drop("batch"), states[-1]


def stream_of(spark, folder, rows, schema):
    df = spark.createDataFrame(rows, schema)
    df.select(*[F.timestamp_millis("ts").alias("ts") if c == "ts" else F.col(c) for c in df.columns]).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)


BASE = 1_700_000_000_000
MINUTE = 60_000


def test_answers_live_by_the_time_of_events(spark, tmp_path):
    schema = "key string, request string, ts long, value string"
    first = [("a", "r1", 0, "A"), ("a", "r2", 4, "B"), ("a", "r3", 5, "C"), ("a", "r4", 9, "D"), ("b", "r1", 1, None), ("b", "r2", 2, "E"), ("b", "r3", 3, "F"), *[(f"once{i}", "r", 3, "x") for i in range(50)]]
    at = lambda rows: [(k, r, BASE + t * MINUTE, v) for k, r, t, v in rows]
    make = lambda rows: streams.remembered(stream_of(spark, str(tmp_path / "in"), at(rows), schema), 5 * MINUTE, late="1 minute")
    rows, states = ran(make(first), str(tmp_path / "out"))
    got = {(r.key, r.request): (r.outcome, r.value) for r in rows.collect()}
    assert {k: v for k, v in got.items() if not k[0].startswith("once")} == {
        ("a", "r1"): ("miss", "A"), ("a", "r2"): ("hit", "A"), ("a", "r3"): ("expired", "C"), ("a", "r4"): ("hit", "C"), ("b", "r1"): ("miss", None), ("b", "r2"): ("miss", "E"), ("b", "r3"): ("hit", "E"),
    }
    # the watermark is at minute 8: of all keys that came once none is left, and of the others those stored from minute 3 on
    assert states <= 2 * 2
    # much later: all states but that of the newest key are gone, and what was forgotten is made again
    rows, states = ran(make([("z", "r1", 600, "Z"), ("a", "r5", 600, "N")]), str(tmp_path / "out"))
    got = {(r.key, r.request): (r.outcome, r.value) for r in rows.collect()}
    assert got[("a", "r5")][1] == "N" and states <= 2 * 2


def test_the_store_forgets_by_its_own_clock(spark, tmp_path):
    # states of the clock ask for batches without end, so each run is one
    schema = "key string, request string, ts long, value string"
    make = lambda rows: streams.remembered(stream_of(spark, str(tmp_path / "in"), rows, schema), 3000, wall=True)
    rows, states = ran(make([(f"k{i}", "r1", BASE, "A") for i in range(40)]), str(tmp_path / "out"), once=True)
    assert {r.outcome for r in rows.collect()} == {"miss"} and states >= 40
    time.sleep(3.5)
    rows, states = ran(make([("k1", "r2", BASE, "B")]), str(tmp_path / "out"), once=True)
    assert [(r.outcome, r.value) for r in rows.collect() if r.request == "r2"] == [("miss", "B")]
    assert states < 40


def test_keys_that_never_return_leave_no_state(spark, tmp_path):
    schema = "user_id long, ts long, event_type string"
    rows = [(i, BASE + i * MINUTE, "view") for i in range(300)] + [(1, BASE + MINUTE + 5000, "view"), (1, BASE + MINUTE + 6000, None), (2, BASE + 2 * MINUTE + 20_000, "view")]
    make = lambda rows: streams.thinned(stream_of(spark, str(tmp_path / "in"), rows, schema), idle_ms=10 * MINUTE, late="5 minutes")
    kept, states = ran(make(rows), str(tmp_path / "out"))
    assert kept.count() == 302
    # a value and a timer for each of the keys of the last fifteen minutes
    assert states <= 3 * 16
    _, states = ran(make([(999, BASE + 9000 * MINUTE, "view")]), str(tmp_path / "out"))
    assert states <= 3


@pytest.mark.parametrize("batches", [1, 5])
def test_thinning_is_alike_in_any_number_of_batches(spark, tmp_path, batches):
    import random

    rng = random.Random(3)
    rows = sorted(((rng.randrange(5), BASE + rng.randrange(600_000), rng.choice("ab")) for _ in range(800)), key=lambda r: r[1])
    kept = set()
    for user in range(5):
        last = (None, None)
        for _, ts, kind in sorted((r for r in rows if r[0] == user), key=lambda r: (r[1], r[2])):
            if last[0] is None or kind != last[1] or ts - last[0] >= 20_000:
                kept.add((user, ts, kind))
                last = (ts, kind)
    step = -(-len(rows) // batches)
    for i in range(0, len(rows), step):
        got, _ = ran(streams.thinned(stream_of(spark, str(tmp_path / "in"), rows[i : i + step], "user_id long, ts long, event_type string")), str(tmp_path / "out"))
    assert {(r.user_id, int(r.ts.timestamp() * 1000), r.event_type) for r in got.collect()} == kept


def test_the_store_is_told_once_a_batch():
    """However many answers of a key are stored in a batch, only the last goes to the store, with one timer."""
    from pyspark.sql import Row

    calls = []

    class State:
        held = (BASE - 10 * MINUTE, "old")

        def exists(self):
            return True

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

    class Handle:
        def getValueState(self, *_):
            return state

        def registerTimer(self, at):
            calls.append(("register", at))

        def deleteTimer(self, at):
            calls.append(("delete", at))

    state = State()
    memory = streams.Memory(MINUTE, False)
    memory.init(Handle())
    rows = [Row(request=f"{i:03}", ts_ms=BASE + i * MINUTE, value=None if i == 3 else f"v{i}") for i in range(100)]
    got = list(memory.handleInputRows(("k",), iter(rows), None))
    assert [r.outcome for r in got[:5]] == ["expired", "expired", "expired", "expired", "miss"] and {r.outcome for r in got[5:]} == {"expired"}
    assert state.held == (BASE + 99 * MINUTE, "v99")
    assert calls == ["get", "update", ("delete", BASE - 9 * MINUTE), ("register", BASE + 100 * MINUTE)]
