import json
import os
import random
import threading
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from codeloom.operators import hints
from codeloom.operators.store import GraphStore
from codeloom.streaming import session_state, watch

T0 = datetime(2024, 1, 1)


def land(folder, name, events):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps({"path": p, "op": op, "ts": (T0 + timedelta(milliseconds=ms)).isoformat()}) + "\n" for p, op, ms in events))


def test_watch_keeps_the_graph_up_to_date(spark, tmp_path):
    root, events = tmp_path / "src", tmp_path / "events"
    root.mkdir()
    (root / "a.py").write_text("def f():\n    pass\n")
    (root / "b.py").write_text("def g():\n    pass\n")
    store = GraphStore(spark, str(tmp_path / "store"))
    land(events, "1.json", [("a.py", "create", 0), ("b.py", "write", 10), ("x.bin", "write", 11), ("node_modules/y.js", "write", 12), ("a.py", "rename", 13)])

    def run():
        q = watch.watch(spark, watch.read_events(spark, str(events)), str(root), store, str(tmp_path / "cp"), {"availableNow": True})
        q.awaitTermination(60)
        return sorted(r.qualified_name for r in store.graph().nodes.collect())

    assert run() == ["a.py", "a.py::f", "b.py", "b.py::g"]
    (root / "a.py").unlink()
    (root / "b.py").write_text("def h():\n    pass\n")
    land(events, "2.json", [("a.py", "write", 100), ("a.py", "remove", 200), ("b.py", "write", 150)])
    assert run() == ["b.py", "b.py::h"]
    assert store.metadata("last_updated")


def test_watch_waits_until_a_file_has_settled(spark, tmp_path):
    """A burst of writes is one refresh, the last event without a successor is applied, and no other file is read."""
    root, events = tmp_path / "src", tmp_path / "events"
    root.mkdir()
    (root / "a.py").write_text("def f():\n    pass\n")
    store, batches = GraphStore(spark, str(tmp_path / "store")), []
    events.mkdir()
    rows = watch.relevant(watch.read_events(spark, str(events)))
    seen = watch.settled(rows, 1500).writeStream.foreachBatch(lambda d, n: batches.extend(d.collect())).option("checkpointLocation", str(tmp_path / "cp0"))
    q = seen.trigger(processingTime="100 milliseconds").start()
    for k in range(4):
        land(events, f"{k}.json", [("a.py", "write", 100 * k), ("b.py", "write", 0)] if k < 3 else [("b.py", "remove", 500)])
        time.sleep(0.05)
    until(lambda: len(batches) == 2)
    time.sleep(2)
    q.stop()
    assert sorted((r.path, r.op) for r in batches) == [("a.py", "write"), ("b.py", "remove")]
    q = watch.watch(spark, watch.read_events(spark, str(events)), str(root), store, str(tmp_path / "cp"), quiet_ms=200)
    until(lambda: store.graph().nodes.count() == 2)
    q.stop()


def until(done, seconds=90):
    began = time.monotonic()
    while not done():
        assert time.monotonic() - began < seconds
        time.sleep(0.2)


def test_changes_of_a_tree_become_events(tmp_path):
    root, folder = tmp_path / "src", tmp_path / "events"
    (root / "node_modules").mkdir(parents=True)
    (root / "node_modules/x.js").write_text("x")
    (root / "a.py").write_text("a")
    state = watch.tree_state(root)
    assert set(state) == {"a.py"} and watch.land_changes(root, folder, state) == state and not folder.exists()
    (root / "new/deep").mkdir(parents=True)
    (root / "new/deep/b.py").write_text("b")
    (root / "a.py").write_text("changed")
    state = watch.land_changes(root, folder, state)
    (root / "a.py").unlink()
    watch.land_changes(root, folder, state)
    said = [json.loads(line) for f in sorted(folder.iterdir()) for line in f.read_text().splitlines()]
    assert sorted((e["path"], e["op"]) for e in said) == [("a.py", "remove"), ("a.py", "write"), ("new/deep/b.py", "create")]
    stop = threading.Event()
    thread = watch.follow(root, folder, stop, 0.05)
    (root / "c.py").write_text("c")
    until(lambda: any("c.py" in f.read_text() for f in folder.glob("*.json")), 10)
    stop.set()
    thread.join(5)


def test_tree_source_over_restarts(spark, tmp_path):
    """Changes made while the stream runs and while it is down, each once; a batch that fails has the same events when
    it runs again, whatever has changed since."""
    root, out, fails = tmp_path / "src", [], []
    (root / "pkg").mkdir(parents=True)
    (root / "pkg/old.py").write_text("old")
    state, check = tmp_path / "listings", str(tmp_path / "check")

    def batch(rows, n):
        if fails:
            fails.pop()
            raise RuntimeError("lost")
        out.append(sorted((r.path, r.op) for r in rows.collect()))

    def start():
        return watch.tree_events(spark, str(root), str(state), partitions=3).writeStream.foreachBatch(batch).option("checkpointLocation", check).trigger(processingTime="100 milliseconds").start()

    q = start()
    until(lambda: q.lastProgress is not None)
    (root / "pkg/a.py").write_text("a")
    until(lambda: any(("pkg/a.py", "create") in b for b in out))
    q.stop()
    (root / "pkg/b.py").write_text("b")
    (root / "pkg/old.py").unlink()
    fails.append(1)
    q = start()
    until(lambda: not q.isActive)
    assert not fails and "lost" in str(q.exception())
    (root / "pkg/c.py").write_text("c")
    (root / "pkg/b.py").unlink()
    q = start()
    until(lambda: any(("pkg/c.py", "create") in b for b in out))
    q.stop()
    said = [e for b in out for e in b]
    assert said == [("pkg/a.py", "create"), ("pkg/b.py", "create"), ("pkg/old.py", "remove"), ("pkg/b.py", "remove"), ("pkg/c.py", "create")]
    assert len(list(state.glob("*.json"))) <= 2


def test_debounce(spark, tmp_path):
    land(tmp_path / "e", "1.json", [("a.py", "write", ms) for ms in (0, 100, 350, 1000)] + [("b.py", "write", 0)])
    land(tmp_path / "e", "2.json", [("z.py", "write", 60_000)])
    q = watch.debounced(watch.read_events(spark, str(tmp_path / "e")), "1 second").writeStream.format("memory").queryName("bursts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.path, r.n) for r in spark.table("bursts").collect())
    assert got == [("a.py", 1), ("a.py", 3), ("b.py", 1)]
    rows = spark.createDataFrame([("a.py", ms * 1000) for ms in (0, 100, 350, 1000)], "path string, moment long")
    assert sorted(r.n for r in watch.sessions(rows, "path").collect()) == [1, 3]


def test_intent_stream(spark, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    for k, tools in enumerate((["refactor"] * 3, ["query_graph"] * 9)):
        (folder / f"{k}.json").write_text("".join(json.dumps({"session": "s", "seq": 10 * k + i, "tool": t, "ts": (T0 + timedelta(seconds=i)).isoformat()}) + "\n" for i, t in enumerate(tools)))
        os.utime(folder / f"{k}.json", (k, k))  # files are read in this order
    calls = spark.readStream.schema("session string, seq long, tool string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(folder))
    q = session_state.intents(calls).writeStream.format("memory").queryName("intents").outputMode("update").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    got = spark.table("intents").orderBy("n").select("intent", "score", "n").collect()
    assert [tuple(r) for r in got][-1] == ("debugging", 9, 12) and len(got) == 2


def test_intent_stream_is_the_batch_result(spark, tmp_path):
    """Calls out of order over some batches, one session of 200,000 of them, a restart in between: as of a table."""
    rng = random.Random(4)
    tools = [t for own in hints.INTENTS.values() for t in own] + ["other"]
    folder, check = tmp_path / "calls", str(tmp_path / "check")
    folder.mkdir()
    rows = [(f"s{rng.randrange(6)}", i, rng.choice(tools)) for i in range(900)]
    rng.shuffle(rows)
    stream = lambda: spark.readStream.schema("session string, seq long, tool string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(folder))
    out = []
    for k in range(3):
        part = rows[300 * k: 300 * (k + 1)]
        (folder / f"{k}.json").write_text("".join(json.dumps({"session": s, "seq": i, "tool": t, "ts": (T0 + timedelta(seconds=k)).isoformat()}) + "\n" for s, i, t in part))
        if k == 2:
            spark.range(200_000).select(F.lit("long").alias("session"), F.col("id").alias("seq"), F.when(F.col("id") > 199_995, "refactor").otherwise("query_graph").alias("tool"),
                                        F.lit(T0).alias("ts")).coalesce(1).write.json(str(tmp_path / "more"))
            os.rename(next((tmp_path / "more").glob("part-*.json")), folder / "9.json")
        q = session_state.intents(stream()).writeStream.outputMode("update").foreachBatch(lambda b, n: out.append({r.session: r for r in b.collect()})).option(
            "checkpointLocation", check).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    last = {}
    for batch in out:
        last |= batch
    table = spark.createDataFrame(rows, "session string, seq long, tool string")
    want = {r.session: (r.intent, r.score) for r in hints.session_intent(table).collect()} | {"long": ("debugging", 6)}
    assert {s: (r.intent, r.score) for s, r in last.items()} == want
    assert last["long"].n == hints.KEPT == max(r.n for r in last.values())


def test_idle_sessions_are_forgotten(spark, tmp_path):
    folder, out = tmp_path / "calls", []
    folder.mkdir()
    for k, (session, seconds) in enumerate((("a", 0), ("b", 7200), ("b", 7201), ("a", 7202))):
        (folder / f"{k}.json").write_text(json.dumps({"session": session, "seq": k, "tool": "refactor", "ts": (T0 + timedelta(seconds=seconds)).isoformat()}) + "\n")
        os.utime(folder / f"{k}.json", (k, k))
    calls = spark.readStream.schema("session string, seq long, tool string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(folder))
    q = session_state.intents(calls, idle_ms=60_000, late="1 second").writeStream.outputMode("update").foreachBatch(lambda b, n: out.extend(b.collect())).option(
        "checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert [(r.session, r.n) for r in out] == [("a", 1), ("b", 1), ("b", 2), ("a", 1)]  # the first call of a is forgotten
