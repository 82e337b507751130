"""Streams over several micro-batches and restarts end where the batch operator does."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from uttera.config import FilterConfig, SplitConfig
from uttera.operators import features, quality, signal, splits
from uttera.sources import records
from uttera.streaming import jobs

MANIFEST = "row_index bigint, id string, sentence string, path string, duration double, client_id string"


def add(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_records_over_restarts(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    rows = [(i, f"u{i}", f"текст {i}" if i % 4 else " ", "a.wav", 1.0, f"s{i % 5}") for i in range(40)]
    for start in (0, 20):
        add(spark, src, rows[start : start + 20], MANIFEST)
        stream = spark.readStream.schema(MANIFEST).parquet(src)
        jobs.stream_records(stream, out, ckpt, FilterConfig(), SplitConfig()).awaitTermination()
    want = quality.usable(splits.assign_split(quality.with_rejection(spark.createDataFrame(rows, MANIFEST)), SplitConfig()))
    key = ["utterance_id", "split", "transcript"]
    got = spark.read.parquet(out).select(*key).collect()
    assert sorted(got) == sorted(want.select(*key).collect()) and len(got) == 30


def test_dedup_over_batches(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    t0 = pd.Timestamp("2024-01-01")
    for day in range(3):
        rows = [(f"t{i % 5 + day}", (t0 + pd.Timedelta(days=day, seconds=i)).to_pydatetime()) for i in range(20)]
        add(spark, src, rows, "text string, ts timestamp")
    stream = spark.readStream.schema("text string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    jobs.drain(jobs.stream_dedup(stream, "text", "ts", "30 days"), out, ckpt)
    assert sorted(r["text"] for r in spark.read.parquet(out).collect()) == [f"t{i}" for i in range(7)]


def test_feature_log_over_restarts(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    schema = "key string, version bigint, deleted boolean, value double"
    batches = [
        [("a", 1, False, 1.0), ("a", 2, False, 2.0), ("b", 3, False, 3.0)],
        [("a", 4, True, None), ("c", 5, False, 5.0)],
        [("b", 6, False, 6.0), ("a", 7, False, 7.0), ("c", 8, True, None)],
    ]
    for rows in batches:
        add(spark, src, rows, schema)
        stream = spark.readStream.schema(schema).parquet(src)
        jobs.stream_features(stream, out, ckpt, ["value"]).awaitTermination()
    log = spark.read.parquet(out)
    assert log.count() == 7  # the older row of "a" in the first batch is gone already
    want = [("a", 7, 7.0), ("b", 6, 6.0)]
    assert sorted(map(tuple, features.latest_state(log, ["value"]).collect())) == want
    compact = str(tmp_path / "compact")
    jobs.compact(log, ["value"], compact)
    assert sorted(map(tuple, features.latest_state(records.read_records(spark, compact), ["value"]).collect())) == want
    jobs.compact(records.read_records(spark, compact), ["value"], compact)  # the version before stays until the pointer moves
    assert sorted(map(tuple, features.latest_state(records.read_records(spark, compact), ["value"]).collect())) == want


FEATURES = "key string, version bigint, row bigint, deleted boolean, lookup boolean, rows int, cols int, values array<float>, expected int"


def cached(key, version, rows, cols=80, row=0, deleted=False, expected=1):
    """A stored feature matrix by its shape; its values only mark it."""
    return (key, version, row, deleted, False, rows, cols, None if deleted else [float(version)], expected)


def lookup(key):
    return (key, None, None, False, True, None, None, None, None)


def test_cached_features_of_a_wrong_shape_are_deleted_and_computed_again(spark, tmp_path):
    src, out, todo, ckpt = (str(tmp_path / n) for n in ("src", "out", "todo", "ckpt"))
    plausible = signal.plausible_shape(F.col("rows"), F.col("cols"), 80, F.col("expected"))
    turns = [  # what arrives, the log rows it gives, the keys to compute
        ([cached("good", 1, 50), cached("wide", 2, 50, cols=13), cached("long", 3, 900000), lookup("new")],
         [("good", 1, False), ("long", 3, True), ("wide", 2, True)], ["long", "new", "wide"]),
        ([lookup("good"), lookup("wide"), cached("new", 4, 60), cached("long", 2, 10)], [("new", 4, False)], ["wide"]),
        ([cached("wide", 5, 50), lookup("wide"), cached("good", 1, 50), lookup("new")], [("wide", 5, False)], []),
        ([cached("good", 6, 70), cached("good", 6, 71, row=2), cached("good", 6, 72, row=1), cached("new", 7, 1, deleted=True), lookup("new")],
         [("good", 6, False), ("new", 7, True)], ["new"]),
        ([cached("new", 7, 9, row=0), cached("new", 6, 9), lookup("good"), cached(None, 9, 9)], [], []),
    ]
    before, asked = [], []
    for number, (rows, logged, computed) in enumerate(turns):
        add(spark, src, rows, FEATURES)
        stream = spark.readStream.schema(FEATURES).parquet(src)
        jobs.stream_features(stream, out, ckpt, ["rows", "cols", "values"], plausible=plausible, todo=todo).awaitTermination()
        log = spark.read.parquet(out)
        new = sorted((r["key"], r["version"], r["deleted"]) for r in log.filter(f"batch = {number}").collect())
        wanted = sorted(r["key"] for r in spark.read.parquet(todo).filter(f"batch = {number}").collect())
        assert (new, wanted) == (logged, computed)
        before += logged
        asked += computed
    assert spark.read.parquet(out).count() == len(before)
    now = features.latest_state(spark.read.parquet(out), ["rows", "values"]).collect()
    assert sorted((r["key"], r["version"], r["rows"], r["values"]) for r in now) == [("good", 6, 71, [6.0]), ("wide", 5, 50, [5.0])]
    assert all(r["values"] is None for r in spark.read.parquet(out).filter("deleted").collect())


@pytest.mark.parametrize("steps", [1, 4])
def test_streamed_log_is_the_batch_log_however_it_arrives(spark, tmp_path, steps):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(400):
        gone = bool(rng.random() < 0.2)
        rows.append((f"k{int(rng.zipf(1.6)) % 23}", int(rng.integers(0, 60)), i, gone, None if gone else float(i)))
    schema = "key string, version bigint, row bigint, deleted boolean, value double"
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    shuffled = [rows[i] for i in rng.permutation(len(rows))] + rows[:50]  # late, in any order, some twice
    size = -(-len(shuffled) // steps)
    for start in range(0, len(shuffled), size):
        add(spark, src, shuffled[start : start + size], schema)
        stream = spark.readStream.schema(schema).parquet(src)
        jobs.stream_features(stream, out, ckpt, ["value"]).awaitTermination()
    want = features.latest_state(spark.createDataFrame(rows, schema), ["value"]).collect()
    assert sorted(map(tuple, features.latest_state(spark.read.parquet(out), ["value"]).collect())) == sorted(map(tuple, want))
    assert spark.conf.get(jobs.IDLE) == "true"  # the session keeps its own settings


def test_windows_close_and_late_rows_are_dropped(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    schema = "ts timestamp, m string, v double, w double"
    t0 = pd.Timestamp("2024-01-01")

    def at(minutes):
        return (t0 + pd.Timedelta(minutes=minutes)).to_pydatetime()

    for rows in (
        [(at(1), "x", 1.0, 1.0), (at(2), "x", 4.0, 2.0)],
        [(at(200), "x", 9.0, 1.0)],
        [(at(205), "x", 9.0, 1.0)],  # a batch later the watermark also bars late rows
        [(at(3), "x", 100.0, 1.0), (at(400), "x", 1.0, 1.0)],
    ):
        add(spark, src, rows, schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    jobs.drain(jobs.stream_metrics(stream, "ts", ["m"], "v", "w", "10 minutes", "30 minutes"), out, ckpt)
    closed = {r["start"].hour * 60 + r["start"].minute: (r["n"], r["mean"]) for r in spark.read.parquet(out).collect()}
    assert closed == {0: (2, 3.0), 200: (2, 9.0)}


def test_closed_windows_leave_the_state(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    schema = "ts timestamp, m string, v double, w double"
    t0 = pd.Timestamp("2024-01-01")
    held, dropped = [], 0
    for hour in range(6):
        rows = [((t0 + pd.Timedelta(hours=hour, minutes=i)).to_pydatetime(), f"m{i % 2}", 1.0, 1.0) for i in range(0, 60, 2)]
        late = [(t0.to_pydatetime(), "m0", 50.0, 1.0)] if hour > 2 else []
        add(spark, src, rows + late, schema)
        stream = spark.readStream.schema(schema).parquet(src)
        query = jobs.drain(jobs.stream_metrics(stream, "ts", ["m"], "v", "w", "10 minutes", "20 minutes"), out, ckpt)
        states = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
        held.append(states[-1]["numRowsTotal"])
        dropped += sum(s["numRowsDroppedByWatermark"] for s in states)
    assert max(held) <= 2 * 4 and dropped == 3  # the windows of the last 20 minutes and the open one, for two metrics
    done = spark.read.parquet(out).collect()
    assert len(done) == len({(r["start"], r["m"]) for r in done}) and {r["mean"] for r in done} == {1.0}


def test_one_alert_per_run(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    schema = "run int, step bigint, bad boolean"
    for rows in ([(1, 1, False), (2, 2, True), (2, 1, True)], [(1, 5, True), (2, 9, True)], [(1, 7, True), (3, 8, False)]):
        add(spark, src, rows, schema)
        stream = spark.readStream.schema(schema).parquet(src)
        jobs.drain(jobs.stream_alert(stream, "run", "step", F.col("bad")), out, ckpt, keyed=True)
    assert sorted(map(tuple, spark.read.parquet(out).select("run", "first_step").collect())) == [(1, 5), (2, 1)]


def test_quiet_runs_leave_the_state_and_may_be_told_again(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    schema = "run int, step bigint, bad boolean"
    held = []
    for keep, rows in ((1.0, [(r, 3, True) for r in range(40)]), (900.0, [(1, 8, True), (2, 9, True), (2, 10, False)]), (900.0, [(1, 11, True)])):
        time.sleep(2.0 if held else 0.0)
        add(spark, src, rows, schema)
        stream = spark.readStream.schema(schema).parquet(src)
        query = jobs.drain(jobs.stream_alert(stream, "run", "step", F.col("bad"), keep_for=keep), out, ckpt, keyed=True)
        held.append([p["stateOperators"][0]["customMetrics"] for p in query.recentProgress if p["stateOperators"]][-1])
    told = sorted(map(tuple, spark.read.parquet(out).select("run", "first_step").collect()))
    assert told[:1] == [(0, 3)] and (1, 8) in told and (2, 9) in told and (1, 11) not in told and len(told) == 42
    assert sum(h["numValuesRemovedDueToTTLExpiry"] for h in held[1:]) >= 38


def test_newest_feature_takes_rows_as_they_come():
    """F3, F8: a key's rows are read one by one, and its state is asked for once."""
    asked = []

    class State:
        def get(self):
            asked.append(1)
            return None

        def update(self, value):
            self.value = value

    state = State()
    one = jobs.NewestFeature(["value"])
    one.init(type("Handle", (), {"getValueState": lambda self, name, schema: state})())
    rows = iter([("k", 1, 0, False, False, True, 1.0), ("k", 3, 0, False, False, True, 3.0), ("k", -1, 0, False, True, True, None)])
    assert [tuple(r) for r in one.handleInputRows(("k",), rows, None)] == [("k", "store", 3, 0, False, 3.0)]
    assert state.value == (3, 0, False) and len(asked) == 1
