"""Streaming twins agree with the batch operators."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as entry
from signalblind.session import scratch_path
from signalblind.streaming import frames as ST

SF = "/root/testdata/sf0.001"


def test_scene_stream_equals_batch(spark):
    batch = {r.frame_id: r.status for r in entry.queries()["d5_scene_change_sampler"](spark, SF).collect()}
    rows = entry.queries()["st2_stream_scene_change"](spark, SF).collect()
    assert len(rows) == len(batch)
    for r in rows:
        assert batch[f"frame-{r.frame_index:08d}"] == r.status


def test_windows_open_at_the_end_come_out(spark):
    total = spark.read.parquet(f"{SF}/events.parquet").count()
    for name in ("st3_window_means", "st3_session_means"):
        assert entry.queries()[name](spark, SF).agg(F.sum("n")).first()[0] == total


def test_late_frames_are_reported_not_applied(spark):
    schema = "capture_id string, frame_index bigint, ts timestamp, thumb array<int>"
    path = scratch_path(spark, "late")
    batches = [
        [("c", i, [i * 40 % 256] * 4) for i in range(0, 60, 10)],
        [("c", 3, [99] * 4), ("c", 70, [5] * 4)],
        [("c", 200, [200] * 4)],
    ]
    out, checkpoint = scratch_path(spark, "late-out"), scratch_path(spark, "late-checkpoint")
    with ST.rocksdb_state(spark):
        for batch in batches:
            spark.createDataFrame(batch, "capture_id string, frame_index bigint, thumb array<int>").withColumn(
                "ts", F.timestamp_seconds(F.col("frame_index") + 86400)).select("capture_id", "frame_index", "ts", "thumb").coalesce(1).write.mode("append").parquet(path)
            stream = spark.readStream.schema(schema).parquet(path)
            seen = {r.frame_index: r.status for r in ST.run_to_end(ST.scene_change_stream(stream, 0.1, "5 seconds"), out, checkpoint).collect()}
    assert 3 not in seen or seen[3] == "late"
    assert seen[0] == "kept" and all(seen[i] in ("kept", "same_scene") for i in (10, 20, 30, 40, 50, 70))


def test_cap_stops_the_deduplication(spark):
    df = spark.range(50).select(F.lit("c").alias("capture_id"), F.col("id").alias("frame_index"), (F.col("id") * 1234567891234567).alias("signature"), (F.col("id") * 10.0).alias("mean_intensity"))
    path = scratch_path(spark, "cap")
    df.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    with ST.rocksdb_state(spark):
        out = ST.run_to_end(ST.deduplicate_stream(stream, max_frames=7), scratch_path(spark, "cap-out"), scratch_path(spark, "cap-checkpoint"))
    assert out.filter("status = 'kept'").count() == 7 and out.count() == 7


class _States:
    """Stands in for the handle of a stateful processor and counts what is written."""

    def __init__(self):
        self.lists, self.value, self.appended, self.timers = [], None, 0, []

    def getListState(self, name, schema):
        return self

    def getValueState(self, name, schema):
        return _States()

    def registerTimer(self, ms):
        self.timers.append(ms)

    def appendValue(self, row):
        self.lists.append(row)
        self.appended += 1

    def exists(self):
        return self.value is not None

    def get(self):
        return iter(self.lists) if self.value is None else self.value

    def put(self, rows):
        self.lists = list(rows)

    def clear(self):
        self.lists = []

    def update(self, value):
        self.value = value

    def getCurrentWatermarkInMs(self):
        return 2_500


def test_waiting_frames_take_one_entry_and_one_timer(spark):
    """Appending and expiring must not touch the state once for each frame that waits."""
    states = _States()
    scene = ST._SceneChange("frame_index", 0.1)
    scene.init(states)
    rows = pd.DataFrame({"ms": np.arange(5000)[::-1], "frame_index": np.arange(5000)[::-1], "thumb": [[i % 2 * 200] * (4 if i else 2) for i in range(5000)][::-1]})
    assert list(scene.handleInputRows(("c",), iter([rows.iloc[:4999]]), None)) == []
    assert (states.appended, states.timers) == (1, [1])
    out = pd.concat(scene.handleExpiredTimer(("c",), states, None))
    assert out["frame_index"].tolist() == list(range(1, 2501)) and (out["status"] == "kept").all()
    # the rest waits on, under the first of its times
    assert states.timers == [1, 2501] and sum(len(scene._unpacked(e)[0]) for e in states.lists) == 2499


def test_kept_frames_are_appended_and_looked_up_by_mean(spark):
    states = _States()
    seen = ST._Deduplicate("frame_index", None, 3, 4.0)
    seen.init(states)
    n = 6000
    rows = pd.DataFrame({"frame_index": np.arange(n), "signature": np.zeros(n, "int64"), "mean_intensity": np.arange(n) * 2.5})
    out = pd.concat(seen.handleInputRows(("c",), iter([rows.iloc[:4000], rows.iloc[4000:]]), None))
    assert out["status"].tolist() == ["kept", "duplicate"] * (n // 2) and states.appended == 2
    # a later micro-batch knows them all
    again = pd.concat(seen.handleInputRows(("c",), iter([rows]), None))
    assert (again["status"] == "duplicate").all() and states.appended == 2
