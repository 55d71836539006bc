"""Preprocessing steps and variants."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import fenced, let
from ..functions.grids import channels
from ..functions.stencils import chain, edge_grid, stencil


# The two preprocessing profiles (variant name and its steps, in order).
PROFILES = {
    "baseline": [
        ("grayscale", ["grayscale"]),
        ("otsu", ["grayscale", "gaussian_blur", "otsu_threshold"]),
        ("adaptive", ["grayscale", "adaptive_threshold"]),
        ("equalized", ["grayscale", "histogram_equalization", "otsu_threshold"]),
        ("edges", ["grayscale", "gaussian_blur", "canny_edges"]),
    ],
    "wide": [
        ("grayscale", ["grayscale"]),
        ("clahe", ["grayscale", "clahe"]),
        ("sharpen_otsu", ["grayscale", "sharpen", "otsu_threshold"]),
        ("invert_otsu", ["grayscale", "invert", "otsu_threshold"]),
        ("threshold_64", ["grayscale", "threshold_64"]),
        ("threshold_96", ["grayscale", "threshold_96"]),
        ("threshold_128", ["grayscale", "threshold_128"]),
        ("threshold_160", ["grayscale", "threshold_160"]),
        ("threshold_192", ["grayscale", "threshold_192"]),
        ("adaptive_15", ["grayscale", "adaptive_threshold_15"]),
        ("adaptive_31", ["grayscale", "adaptive_threshold_31"]),
        ("adaptive_51", ["grayscale", "adaptive_threshold_51"]),
        ("edges_low", ["grayscale", "gaussian_blur", "canny_low"]),
        ("edges_standard", ["grayscale", "gaussian_blur", "canny_edges"]),
        ("edges_high", ["grayscale", "gaussian_blur", "canny_high"]),
        ("morph_close", ["grayscale", "otsu_threshold", "morph_close_2"]),
        ("morph_open", ["grayscale", "otsu_threshold", "morph_open_2"]),
        ("morph_gradient", ["grayscale", "morph_gradient_3"]),
        ("resize_2x_otsu", ["grayscale", "resize_2x", "otsu_threshold"]),
    ],
    # Chains of the older text-preparation scripts.
    "text_preparation": [
        ("blur_otsu", ["gaussian_blur", "otsu_threshold"]),
        ("denoise_adaptive", ["bilateral", "histogram_equalization", "adaptive_threshold_11_2", "morph_close_2", "morph_open_2"]),
        ("edge_detection", ["canny_high_200"]),
        ("thresholding", ["otsu_threshold"]),
        ("morphological_operations", ["morph_close_3"]),
        ("adaptive_thresholding", ["adaptive_threshold_11_2"]),
        ("gaussian_blur", ["gaussian_blur"]),
        ("sharpening", ["sharpen"]),
        ("histogram_equalization", ["histogram_equalization"]),
        ("median_blur", ["median_5"]),
        ("bilateral_filter", ["bilateral"]),
    ],
}

_CUSTOM = {}


def register_step(name: str, fn):
    """Add a step ``fn(df) -> df`` that rewrites pixels, height and width."""
    _CUSTOM[name] = fn


def held(df):
    """The frames with their pixels behind a fence, for an expression behind them may not move into a UDF."""
    return df.withColumn("pixels", fenced(F.col("pixels")))


def _run(lists, number):
    return chain(lists)(F.col("pixels"), F.col("height"), F.col("width"), number)


def scale_of(steps):
    """By how much the steps enlarge a frame in each direction."""
    return 2 ** steps.count("resize_2x")


def canny(df: DataFrame, low: int, high: int, into="pixels") -> DataFrame:
    """Thinned and linked Sobel edges as 0 and 255."""
    return held(df).withColumn(into, edge_grid(low, high)(F.col("pixels"), F.col("height"), F.col("width")))


def apply_steps(df: DataFrame, steps: list) -> DataFrame:
    """Run named steps over packed frames of one or three channels. No step shuffles.

    Neighbouring built-in steps are one Arrow pass; registered ones run between them.
    """
    unknown = [s for s in steps if stencil(s) is None and s not in _CUSTOM]
    if unknown:
        raise ValueError(f"unknown preprocessing step: {unknown[0]}")
    waiting = []

    def flushed(df):
        if not waiting:
            return df
        size, out = scale_of(waiting), held(df).withColumn("pixels", _run([list(waiting)], F.lit(0)))
        waiting.clear()
        return out if size == 1 else out.withColumns({"height": F.col("height") * size, "width": F.col("width") * size})

    for step in steps:
        if step in _CUSTOM:
            df = _CUSTOM[step](flushed(df))
        else:
            waiting.append(step)
    return flushed(df)


def variants(spark: SparkSession, profile: str) -> DataFrame:
    """The variants of a profile with the hash of their definition."""
    if profile not in PROFILES:
        raise ValueError(f"unknown preprocessing profile: {profile}")
    rows = [(profile, i, name, steps) for i, (name, steps) in enumerate(PROFILES[profile])]
    table = spark.createDataFrame(rows, "profile string, ordinal int, variant string, steps array<string>")
    return table.withColumn("hash", variant_hash(F.col("profile"), F.col("variant"), F.col("steps")))


def variant_hash(profile, name, steps):
    """SHA-256 of {"profile": ..., "variant": {"name": ..., "steps": [...]}}."""
    record = F.struct(profile.alias("profile"), F.struct(name.alias("name"), steps.alias("steps")).alias("variant"))
    return F.sha2(F.to_json(record), 256)


def expand_variants(df: DataFrame, profile) -> DataFrame:
    """Every frame under every variant of a profile (5 or 19), in one scan.

    ``profile`` names a preset, or is a list of (variant, steps) of one's own. Each frame row
    is repeated per variant and one Arrow pass runs a row's own steps on it, frames of equal
    size and variant together; nothing is shuffled. Registered steps work on whole DataFrames
    and belong to ``apply_steps``.
    """
    if isinstance(profile, str) and profile not in PROFILES:
        raise ValueError(f"unknown preprocessing profile: {profile}")
    chosen = PROFILES[profile] if isinstance(profile, str) else list(profile)
    for step in (s for _, steps in chosen for s in steps):
        if step in _CUSTOM:
            raise ValueError(f"step {step} works on a whole DataFrame; run it with apply_steps")
        if stencil(step) is None:
            raise ValueError(f"unknown preprocessing step: {step}")
    listed = F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("variant"), F.lit(scale_of(steps)).alias("_scale"))
        for i, (name, steps) in enumerate(chosen)])
    keys = [c for c in df.columns if c not in ("pixels", "height", "width")]
    rows = df.select("*", F.explode_outer(listed).alias("_v")).select(*df.columns, "_v.*")
    done = held(rows).withColumn("_done", _run([steps for _, steps in chosen], F.col("ordinal")))
    return done.select(*keys, "ordinal", "variant", F.col("_done").alias("pixels"), (F.col("height") * F.col("_scale")).alias("_height"), (
        F.col("width") * F.col("_scale")).alias("_width")).withColumnsRenamed({"_height": "height", "_width": "width"})


def crop(df: DataFrame, x: int, y: int, width=None, height=None) -> DataFrame:
    """clamp a region to the frame; a region outside it leaves the frame whole."""
    h, w, px = F.col("height"), F.col("width"), F.col("pixels")
    x0, y0 = F.lit(max(0, x)), F.lit(max(0, y))
    x1 = F.least(w, x0 + (F.lit(max(1, width)) if width is not None else F.greatest(w - x0, F.lit(1))))
    y1 = F.least(h, y0 + (F.lit(max(1, height)) if height is not None else F.greatest(h - y0, F.lit(1))))
    valid = (x0 < x1) & (y0 < y1)
    cut_out = let(px, lambda p: F.flatten(F.transform(
        F.sequence(y0, F.greatest(y1 - 1, y0)), lambda r: F.slice(
            p, (r * w + x0) * channels(p, h, w) + 1, F.greatest(x1 - x0, F.lit(0)) * channels(p, h, w)))))
    kept = [c for c in df.columns if c not in ("pixels", "height", "width")]
    # Packed first: names in a lambda would resolve to new columns of the same select.
    return df.select(*kept, F.struct(
        F.when(valid, cut_out).otherwise(px).alias("pixels"), F.when(valid, y1 - y0).otherwise(h).alias("height"),
        F.when(valid, x1 - x0).otherwise(w).alias("width")).alias("_c")).select(*kept, "_c.*")


def to_cells(df: DataFrame, *keys) -> DataFrame:
    """IO3: one row per cell.

    The outer form keeps Spark from inferring a ``size(pixels) > 0`` filter, which would
    run the whole step chain a second time just to test it.
    """
    out = df.select(*keys, F.col("width").alias("_w"), F.posexplode_outer("pixels").alias("_pos", "v"))
    return out.select(
        *keys, F.floor(F.col("_pos") / F.col("_w")).cast("int").alias("y"), (F.col("_pos") % F.col("_w")).alias("x"), "v")
