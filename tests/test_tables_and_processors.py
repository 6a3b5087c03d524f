"""Keyed tables under replays and killed writes; state machines on shuffled input against batch forms and direct loops."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairnflow.operators.relational import insert_missing, upsert, upsert_keeping
from cairnflow.sources.tables import KeyedTable, removed, replaced, switched
from cairnflow.streaming import processors as S, state

SCHEMA = "k long, v string, digest string"


def table(spark, path, **more):
    return KeyedTable(spark, f"file://{path}/table", SCHEMA, ["k"], **{"buckets": 4, **more})


def put(old, rows):
    return upsert(old, rows, ["k"], "digest", "at").drop("status")


def held(t, version=None):
    return {r.k: r.v for r in t.frame(version).collect()}


def test_upserts_replays_and_versions(spark, tmp_path):
    t = table(spark, tmp_path)
    assert held(t) == {} and t.vacuum() == 0
    one = spark.createDataFrame([(i, f"a{i}", f"d{i}", i) for i in range(20)] + [(3, "later", "x", 99)], "k long, v string, digest string, at long")
    assert t.apply(put, one, "s", 0)
    want = {i: f"a{i}" for i in range(20)} | {3: "later"}
    assert held(t) == want
    two = spark.createDataFrame([(3, "same digest", "x", 1), (7, "new", "d7b", 1), (50, "more", "m", 1)], one.schema)
    assert t.apply(put, two, "s", 1) and not t.apply(put, two, "s", 1) and not t.apply(put, one, "s", 0)
    want |= {7: "new", 50: "more"}
    assert held(t) == want and held(t, 1)[7] == "a7"
    before = t.manifest()["buckets"]
    assert t.apply(removed(["k"]), spark.createDataFrame([(50,), (51,)], "k long"))
    assert held(t) == {k: v for k, v in want.items() if k != 50}
    assert sum(before[b] == f for b, f in t.manifest()["buckets"].items()) >= 2  # other buckets are the same files
    assert t.apply(insert_missing_rows, spark.createDataFrame([(3, "ignored", "q"), (60, "in", "q"), (60, "in", "q")], SCHEMA))
    assert held(t)[3] == "later" and held(t)[60] == "in"
    t.apply(lambda old, rows: upsert_keeping(old, rows, ["k"]), spark.createDataFrame([(60, None, "q2"), (61, "y", None)], SCHEMA))
    assert held(t)[60] == "in" and {r.k: r.digest for r in t.frame().collect()}[60] == "q2"
    assert t.vacuum(1) > 0 and held(t)[60] == "in" and t.vacuum(1) == 0
    assert t.apply(put, one.limit(0)) and held(t)[60] == "in"


def insert_missing_rows(old, rows):
    return insert_missing(old, rows, ["k"])


def test_a_killed_write_leaves_the_old_table(spark, tmp_path):
    t = table(spark, tmp_path)
    rows = spark.createDataFrame([(i, "a", "d", 0) for i in range(9)], "k long, v string, digest string, at long")
    t.apply(put, rows, "s", 0)
    boom = F.udf(lambda v: 1 / 0, "string")
    with pytest.raises(Exception):
        t.apply(lambda old, new: put(old, new).withColumn("v", boom("v")), rows, "s", 1)
    assert held(t) == dict.fromkeys(range(9), "a") and t.manifest()["version"] == 1
    stale = t.manifest()
    t.apply(removed(["k"]), spark.createDataFrame([(0,)], "k long"))
    with pytest.raises(RuntimeError):  # another writer came first
        t._commit(stale | {"version": 2})
    assert 0 not in held(t)


def test_switches_and_replaced_parts(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/likes", "u long, p long", ["u", "p"], 3)
    flip = lambda *pairs: t.apply(switched(["u", "p"]), spark.createDataFrame(list(pairs), "u long, p long"))
    flip((1, 1), (1, 2), (2, 1), (2, 1))
    flip((1, 1), (3, 3))
    assert {tuple(r) for r in t.frame().collect()} == {(1, 2), (3, 3)}
    parts = KeyedTable(spark, f"file://{tmp_path}/parts", "part string, n int", ["part"], 3)
    change = replaced("part", ["part", "n"])
    parts.apply(change, spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "part string, n int"))
    parts.apply(change, spark.createDataFrame([("a", 9)], "part string, n int"))
    assert {tuple(r) for r in parts.frame().collect()} == {("a", 9), ("b", 3)}


def test_a_stream_of_upserts_equals_one_batch(spark, tmp_path):
    r = random.Random(2)
    rows = [(r.randint(0, 30), f"v{i}", f"d{i % 7}", i) for i in range(200)]
    kind = "k long, v string, digest string, at long"
    for i in range(4):
        spark.createDataFrame(rows[50 * i : 50 * i + 50], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    t = table(spark, tmp_path)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run starts from the same checkpoint and finds nothing
        stream.writeStream.foreachBatch(t.sink(put, "s")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert t.manifest()["batches"] == {"s": 3} and {k for k in held(t)} == {k for k, *_ in rows}
    # without the checkpoint Spark gives the batches their numbers again, and none is applied twice
    stream.writeStream.foreachBatch(t.sink(put, "s")).option("checkpointLocation", str(tmp_path / "lost")).trigger(availableNow=True).start().awaitTermination()
    assert t.manifest()["version"] == 4


# -- processors -------------------------------------------------------------------

BEGIN = datetime(2024, 1, 1)


def some_events(n=300, keys=6, seed=5):
    r = random.Random(seed)
    at = sorted(r.randint(0, 4000) for _ in range(n))
    return [(f"k{r.randint(0, keys - 1)}", i, BEGIN + timedelta(minutes=m), r.choice(["start", "done", "fail"]), r.choice([None, r.random()])) for i, m in enumerate(at)]


EVENTS = "k string, id long, ts timestamp, kind string, score double"


def run(spark, tmp_path, rows, make, files=1, mode="append", name="out"):
    """What a stream over ``rows``, shuffled within each file, returns; and the last progress of its state."""
    r = random.Random(1)
    size = -(-len(rows) // files)
    for i in range(files):
        part = rows[i * size : i * size + size]
        spark.createDataFrame(r.sample(part, len(part)), EVENTS).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = make(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect(), query.recentProgress


def test_cooldown_on_a_stream_equals_the_batch(spark, tmp_path):
    rows = some_events()
    found, _ = run(spark, tmp_path, rows, lambda s: state.stream_cooldown(s, "k", "ts", 90, "id", "1 hour"), files=3, name="cool")
    want = state.first_of_bursts(spark.createDataFrame(rows, EVENTS), "k", "ts", "id", 90).collect()
    assert sorted(r.id for r in found) == sorted(r.id for r in want) and 10 < len(want) < len(rows)
    direct, last = [], {}
    for k, i, ts, *_ in rows:
        if k not in last or ts >= last[k] + timedelta(minutes=90):
            last[k] = ts
            direct.append(i)
    assert sorted(r.id for r in want) == direct


def test_state_goes_when_its_time_is_up(spark, tmp_path):
    rows = some_events(100) + [("late", 1000, BEGIN + timedelta(days=30), "done", None), ("late", 1001, BEGIN + timedelta(days=60), "done", None)]
    make = lambda s: S.processed(s, S.Hits("k", "ts", "kind", 2), "k string, kinds string, hits long, last_at timestamp", "1 hour", "update")
    found, progress = run(spark, tmp_path, rows, make, files=3, mode="update", name="hits")
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) > 20 and progress[-1]["stateOperators"][0]["numRowsTotal"] < 8  # what is left is the last key's
    best = {}
    for r in found:
        best[r.k] = max(best.get(r.k, (0, "")), (r.hits, r.kinds))
    frame = pd.DataFrame(rows[:100], columns=["k", "id", "ts", "kind", "score"])
    for k, part in frame.groupby("k"):
        assert best[k][0] == len(part) and best[k][1] == ",".join(f"{a}:{b}" for a, b in sorted(part["kind"].value_counts().items()))
    assert best["late"][0] == 2


def test_phases_on_shuffled_input(spark, tmp_path):
    rows = some_events(200)
    make = lambda s: S.processed(s, S.Phases("k", "ts", "id", "kind", "score"), "k string, phase string, score double, steps long", "100 days", "update", timers=False)
    found, _ = run(spark, tmp_path, rows, make, files=4, mode="update", name="phases")
    want = state.progress(spark.createDataFrame(rows, EVENTS), "k", ["ts", "id"], "kind", "score").collect()
    last = {}
    for r in found:
        if r.k not in last or r.steps > last[r.k].steps:
            last[r.k] = r
    assert {(k, r.phase, r.score, r.steps) for k, r in last.items()} == {(r.k, r.phase, r.score, r.steps) for r in want}


def test_overdue_runs_are_said_once(spark, tmp_path):
    at = lambda m: BEGIN + timedelta(minutes=m)
    rows = [("a", 1, at(0), "start", None), ("b", 2, at(0), "start", None), ("b", 3, at(5), "done", None), ("c", 4, at(50), "start", None), ("d", 5, at(90), "start", None), ("x", 6, at(100), "done", None), ("x", 7, at(101), "done", None), ("x", 8, at(102), "done", None)]
    make = lambda s: S.processed(s, S.Overdue("k", "ts", "id", "kind", ("done",), 30), "k string, since timestamp", "1 minute")
    found, progress = run(spark, tmp_path, rows, make, files=4, name="overdue")
    assert sorted((r.k, r.since) for r in found) == [("a", at(0)), ("c", at(50))]
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] < 12  # b and x hold none, a and c no more
