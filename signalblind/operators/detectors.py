"""Per-frame features (T1-T15) over packed frames.

A frame is one row, so its features are computed inside that row: a detector run is one
scan without a shuffle. Only the series spectrum groups rows.
"""

from pyspark.sql import DataFrame, functions as F

from ..functions import columns as C, features, grids
from ..functions.columns import fenced, height, let, pixels, round6, width
from ..functions.kernels import spectrum_peak, window_power
from ..functions.lines import line_lists, vote_lists
from .ordering import top_per_group
from .preprocess import canny, held

_CUSTOM = {}


def register_detector(name: str, fn):
    """Add a detector ``fn(frames, keys) -> DataFrame`` with one row per key."""
    _CUSTOM[name] = fn


def _in_row(df, keys, kernel, names, **options):
    out = held(df).select(*keys, features.measured(kernel, names, **options)(pixels(), height(), width()).alias("_f"))
    return out.select(*keys, *features.rounded("_f", names))


def entropy_texture(df: DataFrame, keys: list) -> DataFrame:
    """T1"""
    return _in_row(df, keys, features.entropy_texture, features.TEXTURE)


def binary_mask(df: DataFrame) -> DataFrame:
    """0/1 grids are scaled to 0/255 first, then Otsu."""
    return held(df).withColumn("mask", features.binary_grid(pixels(), height(), width()))


def with_boxes(df: DataFrame) -> DataFrame:
    """Boxes of all dark regions of each frame as one array column."""
    return held(df).withColumn("boxes", features.dark_boxes(pixels(), height(), width()))


def _described(boxes, height, width, min_area):
    """Boxes of at least ``min_area`` cells with shape and the text-like test."""

    def describe(b):
        fill = b["area"] / (b["w"] * b["h"])
        aspect = b["w"] / b["h"]
        text_like = fill.between(0.15, 0.85) & aspect.between(0.1, 10.0) & (b["area"] / (height * width) < 0.2)
        return F.struct(
            *[b[c].alias(c) for c in ("label", "x", "y", "w", "h", "area")], round6(aspect).alias("aspect"),
            round6(fill).alias("fill"), text_like.alias("text_like"))

    return F.transform(F.filter(boxes, lambda b: b["area"] >= min_area), describe)


def components(df: DataFrame, keys: list, min_area=4) -> DataFrame:
    """8-connected dark regions, one row each."""
    listed = with_boxes(df).select(*keys, _described(F.col("boxes"), height(), width(), min_area).alias("_b"))
    return listed.select(*keys, F.explode_outer("_b").alias("_b")).filter("_b is not null").select(*keys, "_b.*")


def _median(values):
    """Median of a sorted array; 0 when it is empty."""
    n = F.size(values)
    middle = F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))
    return F.when(n > 0, middle / 2.0).otherwise(F.lit(0.0))


def _summary(described):
    return let(described, lambda d: F.struct(
        F.size(d).cast("bigint").alias("component_count"),
        F.size(F.filter(d, lambda b: b["text_like"])).cast("bigint").alias("text_like_count"),
        let(F.sort_array(F.transform(d, lambda b: b["area"])), _median).alias("median_area")))


def component_summary(df: DataFrame, keys: list, min_area=4) -> DataFrame:
    """Counts and median area per frame."""
    boxed = with_boxes(df)
    return boxed.select(*keys, _summary(_described(F.col("boxes"), height(), width(), min_area)).alias("_s")).select(*keys, "_s.*")


def top_components(boxes: DataFrame, keys: list, k=50) -> DataFrame:
    """K2: the largest components of each frame; the first labelled wins a tie."""
    return top_per_group(boxes, keys, [F.desc("area"), F.col("label")], k)


def _rois(boxes, height, width, k, pad, original_height, original_width):
    """The ``k`` largest outer boxes, padded, scaled and clipped."""

    def fits(b):
        box = b["w"] * b["h"]
        return b["outer"] & (box >= 25) & (box <= height * width * 0.5) & (b["w"] / b["h"]).between(0.05, 20.0)

    # Largest box first, then the lowest and rightmost, then the label.
    sortable = F.transform(F.filter(boxes, fits), lambda b: F.struct(
        (-b["w"] * b["h"]).alias("a"), (-b["y"]).alias("y"), (-b["x"]).alias("x"), b["label"].alias("l"),
        b["w"].alias("w"), b["h"].alias("h")))

    def place(s, i):
        sx, sy = original_width / width, original_height / height
        x0 = F.greatest(F.lit(0), ((-s["x"] - pad) * sx).cast("int"))
        y0 = F.greatest(F.lit(0), ((-s["y"] - pad) * sy).cast("int"))
        x1 = F.least(original_width, ((-s["x"] + s["w"] + pad) * sx).cast("int"))
        y1 = F.least(original_height, ((-s["y"] + s["h"] + pad) * sy).cast("int"))
        return F.struct((i + 1).cast("bigint").alias("rank"), x0.alias("x"), y0.alias("y"), (x1 - x0).alias("width"),
                        (y1 - y0).alias("height"), (-s["a"]).alias("area"))

    placed = F.transform(F.slice(F.array_sort(sortable), 1, k), place)
    return F.filter(placed, lambda r: (r["width"] > 0) & (r["height"] > 0))


def candidate_rois(df: DataFrame, keys: list, k=5, pad=4, original=None) -> DataFrame:
    """Padded boxes of outer dark regions, one row each, largest first.

    Outer means not enclosed by another region. ``original`` names the height and width
    columns to scale to when steps changed the frame size.
    """
    oh, ow = (F.col(original[0]), F.col(original[1])) if original else (height(), width())
    listed = with_boxes(df).select(*keys, _rois(F.col("boxes"), height(), width(), k, pad, oh, ow).alias("_r"))
    return listed.select(*keys, F.explode_outer("_r").alias("_r")).filter("_r is not null").select(*keys, "_r.*")


def edges(df: DataFrame) -> DataFrame:
    """T4: edge grids (thresholds 50 and 150)."""
    return canny(df, 50, 150)


def edge_density(df: DataFrame, keys: list) -> DataFrame:
    """T4: share of edge cells."""
    return edges(df).select(*keys, let(pixels(), features.bright_share).alias("edge_density"))


def hough_votes(edge_frames: DataFrame, keys: list, votes=50) -> DataFrame:
    """T5: lines (1 degree, 1 pixel) with at least ``votes`` edge cells, one row per line."""
    voted = edge_frames.select(*keys, vote_lists(votes)(pixels(), height(), width()).alias("_l"))
    return voted.select(*keys, F.inline("_l"))


def hough_lines(edge_frames: DataFrame, keys: list, votes=50, max_gap=8, k=100) -> DataFrame:
    """T5: straight runs of edge cells on well-voted lines, gaps of at most ``max_gap``."""
    found = edge_frames.select(*keys, line_lists(votes, max_gap, k)(pixels(), height(), width()).alias("_l"))
    listed = found.select(*keys, F.posexplode("_l").alias("_i", "_r"))
    return listed.select(*keys, (F.col("_i") + 1).alias("rank"), "_r.theta", "_r.rho", "_r.votes", round6(F.col("_r.length")).alias("length"))


def _line_summary(lines):
    """Number and mean length of a frame's runs; zeros without any."""
    total = F.aggregate(lines, F.lit(0.0), lambda t, r: t + round6(r["length"]))
    return [F.size(lines).cast("bigint").alias("line_count"),
            F.when(F.size(lines) > 0, round6(total / F.size(lines))).otherwise(0.0).alias("mean_line_length")]


def line_evidence(edge_frames: DataFrame, keys: list, votes=50, max_gap=8, k=100) -> DataFrame:
    """T5: number and mean length of a frame's lines, inside the row."""
    found = edge_frames.select(*keys, line_lists(votes, max_gap, k)(pixels(), height(), width()).alias("_l"))
    return found.select(*keys, *_line_summary(F.col("_l")))


def spectrum(df: DataFrame, keys: list, digits=6) -> DataFrame:
    """T7"""
    held = df.withColumn("pixels", fenced(pixels()))
    measured = held.select(*keys, spectrum_peak(pixels(), height(), width()).alias("s")).select(*keys, "s.*")
    places = {"prominence": digits, "radius": digits, "angle": 3, "ring": digits}
    return measured.withColumns({c: F.round(c, n) for c, n in places.items()})


def series_spectrum(df: DataFrame, by: list, position: str, value: str, window=64) -> DataFrame:
    """Power of an ordered series at every frequency k = 1 .. window / 2 of its windows.

    ``position`` is 0-based and dense per series, which is cut into windows of that many
    places. Each loses its own mean (a short one is filled up with zeros; null values count
    as missing) and is transformed in Arrow; power is averaged over the windows of a series.
    A group is one window, so a hot series is many small groups.
    """
    at = F.col(position).cast("bigint")
    cut_up = df.filter(F.col(value).isNotNull()).groupBy(*by, F.floor(at / window).alias("_window")).agg(
        F.collect_list(F.struct((at % window).cast("int").alias("at"), F.col(value).cast("double").alias("v"))).alias("_held"))
    held = cut_up.select(*by, F.size("_held").alias("_n"), F.transform("_held", lambda x: x["at"]).alias("_at"), F.transform("_held", lambda x: x["v"]).alias("_v"))
    waves = held.select(*by, "_n", window_power(window)(F.col("_at"), F.col("_v")).alias("_power"))
    power = waves.select(*by, "_n", F.posexplode("_power").alias("_k", "_p")).groupBy(*by, (F.col("_k") + 1).alias("k")).agg(
        F.sum("_n").alias("n"), F.avg("_p").alias("_p"))
    return power.select(*by, "n", "k", F.log1p(F.sqrt("_p")).alias("magnitude"))


def series_peak(power: DataFrame, by: list) -> DataFrame:
    """Strongest frequency and its prominence over the background."""
    stats = power.groupBy(*by, "n").agg(
        F.max_by("k", F.struct(F.round("magnitude", 6), -F.col("k"))).alias("peak_k"), F.max("magnitude").alias("top"),
        F.avg("magnitude").alias("mean"), F.stddev_pop("magnitude").alias("std"))
    return stats.select(
        *by, "n", "peak_k", F.round(F.greatest(F.lit(0.0), (F.col("top") - F.col("mean")) / (F.col("std") + 1e-6)), 4).alias("prominence"))


def speckle(df: DataFrame, keys: list, window=7) -> DataFrame:
    """T9"""
    return _in_row(df, keys, features.speckle, features.SPECKLE, window=window)


def glcm(df: DataFrame, keys: list, levels=16) -> DataFrame:
    """T10"""
    return _in_row(df, keys, features.pair_texture, features.PAIRS, levels=levels)


def text_evidence(words: DataFrame, keys: list) -> DataFrame:
    """Words and mean confidence per frame; negative confidence means unknown."""
    real = words.filter(F.trim("word") != "")
    return real.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("word_count"),
        round6(F.coalesce(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))), F.lit(0.0))).alias("confidence"))


def measure(df: DataFrame, keys: list, carry=(), original=None) -> DataFrame:
    """All per-frame features in one pass over the row, with the packed bright
    ``mask`` that persistence needs of the pixels."""
    oh, ow = (F.col(original[0]), F.col(original[1])) if original else (height(), width())
    boxed = canny(with_boxes(df), 50, 150, into="_edges")
    measured = boxed.select(
        *keys, *carry, "_edges", "height", "width",
        features.measured(features.entropy_texture, features.TEXTURE)(pixels(), height(), width()).alias("_texture"),
        features.measured(features.speckle, features.SPECKLE)(pixels(), height(), width()).alias("_speckle"),
        features.measured(features.pair_texture, features.PAIRS)(pixels(), height(), width()).alias("_pairs"),
        _summary(_described(F.col("boxes"), height(), width(), 4)).alias("_components"),
        _rois(F.col("boxes"), height(), width(), 5, 4, oh, ow).alias("candidate_rois"),
        spectrum_peak(pixels(), height(), width()).alias("_spectrum"),
        line_lists()(F.col("_edges"), height(), width()).alias("_lines"),
        let(pixels(), lambda p: let(grids.otsu(p), grids.pack_bits)).alias("mask"))
    return measured.select(
        *keys, *carry, "height", "width", "mask", *_line_summary(F.col("_lines")),
        *features.rounded("_texture", features.TEXTURE), *features.rounded("_speckle", features.SPECKLE), "_components.*", "candidate_rois",
        F.size("candidate_rois").cast("bigint").alias("roi_count"),
        let(F.col("_edges"), features.bright_share).alias("edge_density"),
        *[F.round(F.col(f"_spectrum.{c}"), 3 if c == "angle" else 6).alias(c) for c in ("prominence", "radius", "angle", "ring")],
        *[c.alias(f"glcm_{n}") for n, c in zip(features.PAIRS, features.rounded("_pairs", features.PAIRS))])


def detect(df: DataFrame, keys: list, metric="structure_score", words: DataFrame = None, carry=(), original=None) -> DataFrame:
    """All features of each (sample, variant) row with T12-T14 scores, in one scan."""
    out = complete(measure(df, keys, carry, original).drop("mask"), keys, metric, words)
    for fn in _CUSTOM.values():
        out = out.join(fn(df, keys), keys, "left")
    return out.drop("height", "width")


def complete(measured: DataFrame, keys: list, metric="structure_score", words: DataFrame = None) -> DataFrame:
    """Text evidence, one small row per frame, and scores on top of ``measure``."""
    out = measured
    if words is not None:
        out = out.join(text_evidence(words, keys), keys, "left")
    else:
        out = out.withColumns({"word_count": F.lit(None).cast("bigint"), "confidence": F.lit(0.0)})
    return with_scores(out, metric)


def with_scores(features: DataFrame, metric="structure_score") -> DataFrame:
    """T12, T13, T14 from a feature table."""
    text = C.text_score(F.col("word_count"), F.coalesce("confidence", F.lit(0.0)))
    structure = C.structure_score(
        text, F.col("text_like_count"), F.col("entropy"), F.col("edge_density"), F.col("line_count"), F.col("roi_count"))
    families = C.family_scores(
        text, F.col("text_like_count"), F.col("prominence"), F.col("ring"), F.col("contrast_mean"), F.col("entropy"),
        F.col("edge_density"), F.col("glcm_contrast"), F.col("roi_count"))
    out = features.withColumns({"structure_score": structure, **families})
    return out.withColumn("primary_metric_score", C.primary_score(
        metric, F.col("prominence"), F.col("contrast_mean"), text, F.col("structure_score")))
