"""Ordered frame ingest as Structured Streaming (ST1-ST3)."""

import math
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import (
    ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType,
)

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark):
    """Keyed state in RocksDB, checkpointed with the query, so it may outgrow memory.

    The setting counts when a query starts and is put back afterwards.
    """
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


class _Kept:
    """Kept signatures and means, by slot of means: a frame can only be near one in its own slot or those beside."""

    def __init__(self, max_distance, max_mean_diff):
        self.distance, self.diff, self.width = max_distance, max_mean_diff, max(max_mean_diff, 1e-9)
        self.slots, self.n = {}, 0

    def near(self, sig, mean):
        at = math.floor(mean / self.width)
        for slot in (at - 1, at, at + 1):
            if slot in self.slots:
                sigs, means, n = self.slots[slot]
                close = np.bitwise_count((sigs[:n] ^ sig).view("uint64")) <= self.distance
                if (close & (np.abs(means[:n] - mean) <= self.diff)).any():
                    return True
        return False

    def add(self, sig, mean):
        slot = math.floor(mean / self.width)
        sigs, means, n = self.slots.get(slot) or (np.empty(4, "int64"), np.empty(4), 0)
        if n == len(sigs):
            sigs, means = np.resize(sigs, 2 * n), np.resize(means, 2 * n)
        sigs[n], means[n] = sig, mean
        self.slots[slot] = (sigs, means, n + 1)
        self.n += 1


class _Deduplicate(StatefulProcessor):
    """ST1: keep a frame unless a frame kept before is within both limits.

    State per capture is the kept signatures and means, at most ``max_frames`` of them;
    once the cap is reached no frame is looked at any more. A micro-batch reads them once
    and appends what it keeps as one entry a batch of rows.
    """

    def __init__(self, order, max_frames, max_distance, max_mean_diff):
        self.order, self.cap = order, max_frames
        self.distance, self.diff = max_distance, max_mean_diff

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", StructType([
            StructField("signatures", BinaryType()), StructField("means", BinaryType())]))

    def handleInputRows(self, key, rows, timerValues):
        kept = _Kept(self.distance, self.diff)
        for sigs, means in self.kept.get():
            for sig, mean in zip(np.frombuffer(sigs, "int64"), np.frombuffer(means, "float64")):
                kept.add(sig, mean)
        # Arrow batches come one after the other; nothing is gathered per capture.
        for batch in rows:
            batch = batch.sort_values(self.order)
            out, new = [], []
            for pos, sig, mean in zip(*(batch[c].to_numpy() for c in (self.order, "signature", "mean_intensity"))):
                if self.cap is not None and kept.n >= self.cap:
                    break
                near = kept.near(sig, mean)
                if not near:
                    kept.add(sig, mean)
                    new.append((sig, mean))
                out.append((key[0], int(pos), "duplicate" if near else "kept"))
            if new:
                sigs, means = zip(*new)
                self.kept.appendValue((np.array(sigs, "int64").tobytes(), np.array(means, "float64").tobytes()))
            if out:
                yield pd.DataFrame(out, columns=["capture_id", self.order, "status"])

    def close(self) -> None:
        pass


def deduplicate_stream(frames: DataFrame, order="frame_index", max_frames=None, max_distance=3, max_mean_diff=4.0) -> DataFrame:
    """ST1: near-duplicate suppression in arrival order, keyed by ``capture_id``."""
    schema = StructType([
        StructField("capture_id", frames.schema["capture_id"].dataType), StructField(order, LongType()),
        StructField("status", StringType())])
    return frames.select("capture_id", order, "signature", "mean_intensity").groupBy("capture_id").transformWithStateInPandas(
        statefulProcessor=_Deduplicate(order, max_frames, max_distance, max_mean_diff),
        outputStructType=schema, outputMode="Append", timeMode="None")


class _SceneChange(StatefulProcessor):
    """ST2: frames wait until the watermark has passed them, then are judged in order.

    State per capture: the last kept thumbnail, the time up to which frames were judged
    and the frames still waiting, which the watermark delay bounds. These wait as one entry
    a batch of rows, and one timer stands for them, at the first of their times: a row of
    its own for each would make appending and expiring read them all again and again.
    """

    def __init__(self, order, threshold):
        self.order, self.threshold = order, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([
            StructField("thumb", ArrayType(IntegerType())), StructField("upto", LongType())]))
        self.waiting = handle.getListState("waiting", StructType([
            StructField("ms", BinaryType()), StructField("pos", BinaryType()), StructField("size", BinaryType()), StructField("cells", BinaryType())]))

    @staticmethod
    def _packed(ms, pos, thumbs):
        size = [len(t) for t in thumbs]
        return tuple(np.asarray(x, t).tobytes() for x, t in ((ms, "int64"), (pos, "int64"), (size, "int32"), (np.concatenate(thumbs), "int32")))

    @staticmethod
    def _unpacked(entry):
        ms, pos, size, cells = (np.frombuffer(x, t) for x, t in zip(entry, ("int64", "int64", "int32", "int32")))
        return ms, pos, np.split(cells, np.cumsum(size)[:-1])

    def handleInputRows(self, key, rows, timerValues):
        upto = self.last.get()[1] if self.last.exists() else -1
        late, first = [], None
        for batch in rows:
            ms, pos = batch["ms"].to_numpy(), batch[self.order].to_numpy()
            late += [(key[0], int(p), "late") for p in pos[ms <= upto]]
            new = np.flatnonzero(ms > upto)
            if len(new):
                thumbs = batch["thumb"].to_numpy()
                self.waiting.appendValue(self._packed(ms[new], pos[new], [np.asarray(thumbs[i], "int32") for i in new]))
                first = int(ms[new].min()) if first is None else min(first, int(ms[new].min()))
        if first is not None:
            self.handle.registerTimer(first)
        if late:
            yield pd.DataFrame(late, columns=["capture_id", self.order, "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        limit = timerValues.getCurrentWatermarkInMs()
        scene, upto = self.last.get() if self.last.exists() else (None, -1)
        if limit <= upto:
            return
        scene = None if scene is None else np.asarray(scene)
        rest, due = [], []
        for entry in self.waiting.get():
            ms, pos, thumbs = self._unpacked(entry)
            due += [(int(ms[i]), int(pos[i]), thumbs[i]) for i in np.flatnonzero(ms <= limit)]
            later = np.flatnonzero(ms > limit)
            if len(later):
                rest.append((ms[later], pos[later], [thumbs[i] for i in later]))
        out = []
        for ms, pos, now in sorted(due, key=lambda r: r[:2]):
            kept = scene is None or np.abs(scene - now).mean() / 255.0 >= self.threshold
            if kept:
                scene = now
            out.append((key[0], pos, "kept" if kept else "same_scene"))
        self.waiting.put([self._packed(*r) for r in rest]) if rest else self.waiting.clear()
        if rest:
            self.handle.registerTimer(min(int(r[0].min()) for r in rest))
        self.last.update(([] if scene is None else [int(v) for v in scene], int(limit)))
        if out:
            yield pd.DataFrame(out, columns=["capture_id", self.order, "status"])

    def close(self) -> None:
        pass


def scene_change_stream(frames: DataFrame, threshold=0.10, delay="10 seconds", order="frame_index", ts="ts") -> DataFrame:
    """ST2: scene-change sampling of ``thumb`` grids in event-time order.

    Late rows are never applied: Spark drops rows behind the watermark and counts them in
    the query progress; one that still gets through is reported with status late.
    """
    schema = StructType([
        StructField("capture_id", frames.schema["capture_id"].dataType), StructField(order, LongType()),
        StructField("status", StringType())])
    timed = frames.withWatermark(ts, delay).select("capture_id", order, ts, F.unix_millis(ts).alias("ms"), "thumb")
    return timed.groupBy("capture_id").transformWithStateInPandas(
        statefulProcessor=_SceneChange(order, threshold), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def windowed_means(events: DataFrame, keys: list, value: str, ts="ts", size="1 hour", slide=None, delay="10 minutes") -> DataFrame:
    """ST3: count and mean per event-time window; Spark drops state behind the watermark."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, delay).groupBy(w.alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(
        F.unix_seconds("w.start").alias("start"), *keys, "n", F.round("mean", 6).alias("mean"))


def session_means(events: DataFrame, keys: list, value: str, ts="ts", gap="30 minutes", delay="10 minutes") -> DataFrame:
    """ST3: the same over sessions that end after a silence of ``gap``."""
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, delay).groupBy(w.alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(
        F.unix_seconds("w.start").alias("start"), F.unix_seconds("w.end").alias("stop"), *keys, "n",
        F.round("mean", 6).alias("mean"))


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drain what the source holds into parquet files and read them back."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def drain(table: DataFrame, build, path: str, ts="ts", beyond="1 day") -> DataFrame:
    """Run ``build(stream)`` over all rows of ``table`` as files below ``path``, until nothing waits.

    A watermark never passes the last event, so windows open at the end and frames that wait
    would stay in the state. When the rows are read, one more file brings a copy of the last
    row, later by ``beyond`` (longer than any delay, gap and window). It moves the watermark
    past every event and stays behind itself, for nothing moves it past that one.
    """
    spark = table.sparkSession
    source, out, checkpoint = f"{path}/in", f"{path}/out", f"{path}/checkpoint"
    table.write.parquet(source)
    stored = spark.read.schema(table.schema).parquet(source)

    def run():
        return run_to_end(build(spark.readStream.schema(table.schema).parquet(source)), out, checkpoint)

    found = run()
    last = stored.filter(F.col(ts).isNotNull()).orderBy(F.desc(ts)).limit(1)
    if last.isEmpty():
        return found
    last.withColumn(ts, F.col(ts) + F.expr(f"INTERVAL {beyond}")).coalesce(1).write.mode("append").parquet(source)
    return run()
