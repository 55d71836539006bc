"""Features across neighbouring frames."""

from pyspark.sql import DataFrame, functions as F

from ..functions import grids
from ..functions.columns import fenced, let, round6
from ..functions.kernels import phase_shift
from .controls import first_per_key
from .ordering import with_previous
from .sampling import CHUNK


def with_group(samples: DataFrame, group="parent") -> DataFrame:
    """Sequence a sample belongs to: generated controls join their parent's sequence
    (``parent``) or form one of their own (``own``)."""
    parent = F.coalesce("capture_id", "parent_capture_id", "sample_id")
    if group == "own":
        parent = F.when(F.col("control_type").isNotNull(), F.concat_ws("/", parent, "control_type")).otherwise(parent)
    return samples.withColumn("sequence_id", parent)


def _resized_mask(words, from_h, from_w, to_h, to_w):
    """Nearest cell of a packed mask of another shape."""
    same = (from_h == to_h) & (from_w == to_w)
    resized = let(words, lambda m: grids.grid(to_h, to_w, lambda y, x: grids.bit_at(
        m, F.least(F.floor(y * from_h / to_h).cast("int"), from_h - 1) * from_w
        + F.least(F.floor(x * from_w / to_w).cast("int"), from_w - 1), from_h * from_w)))
    return F.when(same, words).otherwise(let(resized, grids.pack_bits))


def with_mask(frames: DataFrame) -> DataFrame:
    """Bright cells of each frame as packed bits."""
    return frames.withColumn("mask", let(F.col("pixels"), lambda p: let(grids.otsu(p), grids.pack_bits)))


def persistence(frames: DataFrame, by: list, order: list, sample="sample_id", bucket=None) -> DataFrame:
    """Best overlap (IoU) of a frame's bright mask with the frame before or after it."""
    return mask_persistence(with_mask(frames), by, order, sample, bucket)


def mask_persistence(masks: DataFrame, by: list, order: list, sample="sample_id", bucket=None) -> DataFrame:
    """W1 from packed masks. Each frame is paired with its predecessor only; the overlap
    counts for both, so one partial aggregate replaces the look ahead."""
    bucket = F.floor(F.coalesce("frame_index", F.lit(0)) / CHUNK) if bucket is None else bucket
    slim = masks.select(
        sample, *by, *[c for c in ("frame_index", "blind_id") if c in masks.columns and c != sample],
        "height", "width", "mask")
    paired = with_previous(slim, by, order, bucket, [sample, "height", "width", "mask"])
    resized = paired.withColumn("prev_mask", F.when(F.col("prev_mask").isNotNull(), _resized_mask(
        F.col("prev_mask"), F.col("prev_height"), F.col("prev_width"), F.col("height"), F.col("width"))))
    iou = F.when(F.col("prev_mask").isNull(), F.lit(0.0)).otherwise(grids.bit_overlap(F.col("prev_mask"), F.col("mask")))
    scored = resized.withColumn("_iou", iou)
    spread = scored.select(*by, F.explode_outer(F.array(F.col(sample), F.col(f"prev_{sample}"))).alias(sample), "_iou")
    return spread.filter(F.col(sample).isNotNull()).groupBy(*by, sample).agg(
        round6(F.max("_iou")).alias("persistence_score"))


def registration(frames: DataFrame, by: list, order: list, sample="sample_id", bucket=None) -> DataFrame:
    """Shift against the previous frame of the sequence; the first frame gets zeros.

    ``order`` is the frame order by default; pass the blind order to follow that instead.
    """
    bucket = F.floor(F.coalesce("frame_index", F.lit(0)) / CHUNK) if bucket is None else bucket
    paired = with_previous(frames, by, order, bucket, ["pixels", "height", "width"])
    h, w = F.coalesce("prev_height", "height"), F.coalesce("prev_width", "width")
    same = (h == F.col("height")) & (w == F.col("width"))
    fitted = F.when(same, F.col("pixels")).otherwise(let(
        F.col("pixels"), lambda p: grids.area_resize(p, F.col("height"), F.col("width"), h, w)))
    ready = paired.withColumns({"_h": h, "_w": w}).withColumn("_moving", fenced(fitted))
    return ready.select(*by, sample, phase_shift("prev_pixels", "_moving", "_h", "_w").alias("s")).select(*by, sample, "s.*")


def best_variant(results: DataFrame, sample="sample_id", score="primary_metric_score", ties=("ordinal",)) -> DataFrame:
    """The record with the highest score per sample; ``ties`` settle equal scores.

    A partial aggregate, so only the best record per sample travels.
    """
    return first_per_key(results, sample, [-F.col(score), *[F.col(c) for c in ties]])
