"""Streaming twins of the ordered operators, drained over the driver tables (ST1-ST3)."""

from pyspark.sql import functions as F

from ..operators.sampling import scene_thumbnail
from ..session import scratch_path
from ..sources.tables import document_signatures, frames, table
from ..streaming import frames as ST
from .queries_frames import GREEDY, SCENES
from .registry import query


def stream_of(spark, df, name):
    """Write a derived table once and read it as a stream."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def drained(spark, stream, name):
    return ST.run_to_end(stream, scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-checkpoint"))


def events(spark, sf):
    # Event times are stored without a zone and mean UTC, whatever the session zone is.
    local = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts"))
    return table(spark, sf, "events").withColumn("ts", local.cast("timestamp"))


@query("st1_stream_deduplicate", GREEDY + " SELECT capture_id, frame_index, CASE WHEN dup THEN 'duplicate' ELSE 'kept' END AS status FROM walk")
def _(spark, sf):
    # One file in frame order stands for frames arriving in order.
    sigs = document_signatures(spark, sf).orderBy("frame_index").coalesce(1)
    with ST.rocksdb_state(spark):
        return drained(spark, ST.deduplicate_stream(stream_of(spark, sigs, "signatures"), max_frames=None), "dedup")


@query("st2_stream_scene_change", SCENES + " SELECT capture_id, frame_index, CASE WHEN kept THEN 'kept' ELSE 'same_scene' END AS status FROM walk")
def _(spark, sf):
    # One frame per second from the second day on: time zero counts as late from the start.
    shots = frames(spark, sf).select(
        "capture_id", "frame_index", F.timestamp_seconds(F.col("frame_index") + 86400).alias("ts"),
        scene_thumbnail(F.col("pixels"), F.col("height"), F.col("width")).alias("thumb"))
    with ST.rocksdb_state(spark):
        return ST.drain(shots, lambda s: ST.scene_change_stream(s, 0.12), scratch_path(spark, "scene"))


@query("st3_window_means", """WITH hours AS (SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start, event_type, value FROM events)
SELECT start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM hours GROUP BY start, event_type""")
def _(spark, sf):
    return ST.drain(events(spark, sf), lambda s: ST.windowed_means(s, ["event_type"], "value"), scratch_path(spark, "windows"))


@query("st3_sliding_means", """WITH hops AS (SELECT event_type, value, CAST(floor(epoch(ts) / 900) * 900 AS BIGINT) - 900 * unnest(range(4)) AS start FROM events)
SELECT start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM hops GROUP BY ALL""")
def _(spark, sf):
    return ST.drain(events(spark, sf), lambda s: ST.windowed_means(s, ["event_type"], "value", slide="15 minutes"), scratch_path(spark, "sliding"))


@query("st3_session_means", """WITH marked AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts)) + 1800) AS BIGINT) AS stop, user_id, count(*) AS n,
  round(avg(value), 6) AS mean FROM runs GROUP BY user_id, s""")
def _(spark, sf):
    return ST.drain(events(spark, sf), lambda s: ST.session_means(s, ["user_id"], "value"), scratch_path(spark, "sessions"))
