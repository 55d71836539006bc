"""Matched controls and the calibration sample."""

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import grids
from ..functions.columns import fenced, height, let, pixels, width

# Generated control types at each level, in the order they are made.
CONTROL_TYPES = {
    "none": [],
    "standard": ["blank_mean", "rotated", "block_shuffle"],
    "strict": ["blank_mean", "rotated", "block_shuffle", "noise_matched", "intensity_inverted"],
}

# Fixed value: identifier of the calibration sample.
CALIBRATION_ID = "synthetic-positive-known-text"


def blank_mean(p):
    """C1"""
    mean = F.floor(F.aggregate(p, F.lit(0).cast("bigint"), lambda a, v: a + v) / F.size(p)).cast("int")
    return let(mean, lambda m: F.transform(p, lambda v: m))


def rotated(p):
    """90 degrees clockwise; the caller swaps height and width."""
    return grids.moved(p, height(), width(), width(), height(), lambda y, x: (height() - 1 - x) * width() + y)


def block_order(count, seed=12345):
    """Permutation of ``count`` tiles: tile indexes in order of md5("seed:tile")."""
    keyed = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(
        F.md5(F.concat_ws(":", F.lit(str(seed)), i)).alias("k"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda s: s["i"])


def block_shuffle(p, block=32, seed=12345):
    """Tiles change places; where a smaller edge tile lands, uncovered cells stay."""
    rows, cols = F.ceil(height() / block).cast("int"), F.ceil(width() / block).cast("int")

    def place(order):
        def cell(y, x):
            ty, tx = F.floor(y / block).cast("int"), F.floor(x / block).cast("int")

            def read(src):
                sy = F.floor(src / cols).cast("int") * block + (y - ty * block)
                sx = (src % cols) * block + (x - tx * block)
                return F.when((sy < height()) & (sx < width()), sy * width() + sx).otherwise(y * width() + x)

            return let(order[ty * cols + tx], read)

        return grids.moved(p, height(), width(), height(), width(), cell)

    return let(block_order(rows * cols, seed), place)


def noise_matched(p, key, seed=20260710):
    """C4: normal noise with the frame's mean and deviation, clipped to 0..255.

    Box-Muller on two halves of md5("seed:frame:cell"), so a rerun gives the same noise.
    """
    n = F.size(p).cast("double")
    sums = F.aggregate(p, F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("q")),
                       lambda a, v: F.struct((a["s"] + v).alias("s"), (a["q"] + v * v).alias("q")))
    stats = let(sums, lambda a: F.struct(
        (a["s"] / n).alias("m"), F.sqrt(F.greatest(F.lit(0.0), a["q"] / n - (a["s"] / n) * (a["s"] / n))).alias("d")))

    def noise(st):
        def cell(v, i):
            def normal(h):
                u = (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + 1.0) / 4294967297.0
                t = F.conv(F.substring(h, 9, 8), 16, 10).cast("double") / 4294967296.0
                z = F.sqrt(-2.0 * F.log(u)) * F.cos(2 * math.pi * t)
                return grids.to_byte(F.floor(st["m"] + st["d"] * z)).cast("int")

            return let(F.md5(F.concat_ws(":", F.lit(str(seed)), key, i)), normal)

        return F.transform(p, cell)

    return let(stats, noise)


def matched_controls(frames: DataFrame, level="standard", role="role", block=32) -> DataFrame:
    """Generated controls of laser frames, with parent links.

    One scan: every frame's controls are built in its own row and then stacked.
    """
    if level not in CONTROL_TYPES:
        raise ValueError(f"unknown control level: {level}")
    if not CONTROL_TYPES[level]:
        return frames.limit(0).select(*_control_columns(frames, F.lit(""), pixels(), height(), width()))
    make = {
        "blank_mean": (let(pixels(), blank_mean), height(), width()),
        "rotated": (let(pixels(), rotated), width(), height()),
        "block_shuffle": (let(pixels(), lambda p: block_shuffle(p, block)), height(), width()),
        "noise_matched": (let(pixels(), lambda p: noise_matched(p, F.col("frame_id"))), height(), width()),
        "intensity_inverted": (let(pixels(), grids.invert), height(), width()),
    }
    stacked = F.array(*[
        F.struct(F.lit(t).alias("type"), make[t][0].alias("pixels"), make[t][1].alias("height"), make[t][2].alias("width"))
        for t in CONTROL_TYPES[level]])
    listed = frames.filter(F.col(role) == "laser").withColumn("_all", fenced(stacked))
    each = listed.withColumn("_c", F.explode_outer("_all"))
    return each.select(*_control_columns(frames, F.col("_c.type"), F.col("_c.pixels"), F.col("_c.height"), F.col("_c.width")))


def _control_columns(frames, kind, pixels, height, width):
    stamp = F.col("timestamp_ms") if "timestamp_ms" in frames.columns else F.lit(None).cast("bigint")
    return [
        F.concat(F.lit("ctrl-"), F.col("frame_id"), F.lit("-"), kind).alias("sample_id"),
        F.col("capture_id").alias("parent_capture_id"), F.col("frame_id").alias("parent_frame_id"),
        kind.alias("control_type"), "frame_index", stamp.alias("timestamp_ms"), F.lit("control").alias("unblinded_label"),
        F.lit(True).alias("synthetic"), pixels.alias("pixels"), height.alias("height"), width.alias("width"),
    ]


def frame_samples(frames: DataFrame, role="role") -> DataFrame:
    """Frames as samples."""
    stamp = F.col("timestamp_ms") if "timestamp_ms" in frames.columns else F.lit(None).cast("bigint")
    return frames.select(
        F.col("frame_id").alias("sample_id"), "capture_id", "frame_id", "frame_index", stamp.alias("timestamp_ms"),
        F.col(role).alias("unblinded_label"), F.lit(False).alias("synthetic"), "pixels", "height", "width")


def calibration_sample(spark: SparkSession, height=180, width=320, period=16) -> DataFrame:
    """The one known-positive sample of a run, a sine grating of fixed period."""
    wave = lambda y, x: F.floor((F.sin(2 * math.pi * x / period) + 1) * 110 + 20).cast("int")
    return spark.range(1).select(
        F.lit(CALIBRATION_ID).alias("sample_id"), F.lit(0).cast("bigint").alias("frame_index"),
        F.lit("synthetic_positive").alias("unblinded_label"), F.lit(True).alias("synthetic"),
        grids.grid(F.lit(height), F.lit(width), wave).alias("pixels"), F.lit(height).alias("height"), F.lit(width).alias("width"))


def all_samples(frames: DataFrame, level="standard", role="role", block=32, calibration=(180, 320)) -> DataFrame:
    """Frames, generated controls and the calibration sample."""
    parts = [frame_samples(frames, role)]
    if CONTROL_TYPES[level]:
        parts.append(matched_controls(frames, level, role, block))
    parts.append(calibration_sample(frames.sparkSession, *calibration))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def first_per_key(df: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of every key; a partial aggregate, so repeats of a hot key
    fold where they are."""
    record = F.struct(*df.columns)
    return df.groupBy(key).agg(F.min_by(record, F.struct(*order)).alias("r")).select("r.*")
