"""Column expressions shared by the operators. All of them stay in the JVM."""

from functools import reduce

from pyspark.sql import Column, functions as F

# Capture roles that count as controls in the statistics.
CONTROL_ROLES = ["control", "matched_control", "sensor_noise", "synthetic_negative"]

# Every role a capture may carry.
CAPTURE_ROLES = ["laser", "control", "matched_control", "sensor_noise", "synthetic_positive", "synthetic_negative"]

# Detector families, in the order that settles ties.
FAMILIES = ["symbol", "diffraction", "speckle", "texture"]

# Primary metrics a run may select.
PRIMARY_METRICS = ["structure_score", "fft_peak_prominence", "speckle_contrast", "ocr_symbol_score"]


def pixels() -> Column:
    return F.col("pixels")


def height() -> Column:
    return F.col("height")


def width() -> Column:
    return F.col("width")


def let(value: Column, body) -> Column:
    """Bind ``value`` once and hand it to ``body``.

    Catalyst inlines a projected column into the lambda that reads it, so without
    the binding an array step would be recomputed for every element.
    """
    return F.transform(F.array(value), body)[0]


def fenced(value: Column) -> Column:
    """A computed column that Catalyst leaves where it is: one row out for one row in.

    Without the generator Catalyst may inline the lambdas behind a column into a UDF call
    or a pushed-down filter, and Spark does not extract a UDF whose argument holds
    nested lambdas. Filters on other columns still move below it.
    """
    return F.explode_outer(F.array(value))


def micros(value: Column) -> Column:
    """A score as whole millionths; sums of these do not depend on row order."""
    return F.floor(value * F.lit(1e6) + F.lit(0.5)).cast("long")


def round6(value: Column) -> Column:
    return F.round(value, 6)


def statistical_role(label: Column) -> Column:
    """F8: map a capture role to laser / control / calibration / other."""
    return (
        F.when(label == "laser", "laser")
        .when(label.isin(*CONTROL_ROLES), "control")
        .when(label == "synthetic_positive", "calibration")
        .otherwise("other")
    )


def hamming(left: Column, right: Column) -> Column:
    """Number of differing bits of two 64-bit signatures."""
    return F.bit_count(left.bitwiseXOR(right))


def signature_hex(signature: Column) -> Column:
    return F.lower(F.lpad(F.hex(signature), 16, "0"))


def capped(value: Column) -> Column:
    return F.least(F.lit(1.0), value)


def text_score(words: Column, confidence: Column) -> Column:
    """Evidence from recognised words: word count up to 8 and mean confidence."""
    share = words.cast("double") / F.lit(8.0) * F.lit(0.6)
    trust = F.greatest(F.lit(0.0), confidence) / F.lit(100.0) * F.lit(0.4)
    return F.when(words.isNull(), F.lit(0.0)).otherwise(capped(share + trust))


def structure_score(text, text_like, entropy, edge_density, lines, rois) -> Column:
    """Weighted mix of six capped pieces of evidence (weights are fixed values)."""
    parts = [
        (0.25, text),
        (0.20, capped(text_like / F.lit(30.0))),
        (0.15, capped(F.greatest(F.lit(0.0), entropy / F.lit(8.0)))),
        (0.20, capped(edge_density * F.lit(8.0))),
        (0.10, capped(lines / F.lit(30.0))),
        (0.10, capped(rois / F.lit(5.0))),
    ]
    return round6(reduce(lambda a, b: a + b, [part * F.lit(weight) for weight, part in parts]))


def family_scores(text, text_like, prominence, ring, speckle, entropy, edge_density, contrast, rois):
    """The four family scores, keyed in tie order."""
    texture = (
        entropy / F.lit(8.0) * F.lit(0.35)
        + edge_density * F.lit(4.0) * F.lit(0.25)
        + capped(contrast / F.lit(24.0)) * F.lit(0.25)
        + capped(rois / F.lit(5.0)) * F.lit(0.15)
    )
    return {
        "symbol": round6(F.greatest(text, capped(text_like / F.lit(40.0)))),
        "diffraction": round6(capped(prominence / F.lit(8.0) * F.lit(0.75) + ring * F.lit(0.25))),
        "speckle": round6(capped(speckle * F.lit(2.0))),
        "texture": round6(capped(texture)),
    }


def primary_score(metric, prominence, speckle, text, structure) -> Column:
    """The score a run is judged by. ``metric`` is a Column or a name."""
    if isinstance(metric, str):
        if metric not in PRIMARY_METRICS:
            raise ValueError(f"unknown primary metric {metric!r}; expected one of {PRIMARY_METRICS}")
        metric = F.lit(metric)
    return round6(
        F.when(metric == "fft_peak_prominence", capped(prominence / F.lit(8.0)))
        .when(metric == "speckle_contrast", capped(speckle * F.lit(2.0)))
        .when(metric == "ocr_symbol_score", text)
        .otherwise(F.coalesce(structure, F.lit(0.0)))
    )


def strongest_family(scores: dict) -> Column:
    """Name of the highest family score; the first in order wins a tie."""
    best = F.greatest(*[F.coalesce(scores[name], F.lit(0.0)) for name in FAMILIES])
    picked = F
    for name in FAMILIES:
        picked = picked.when(F.coalesce(scores[name], F.lit(0.0)) == best, name)
    return picked


def evidence_ladder(laser_count, control_count, difference, p_value, effect, persistence) -> Column:
    """Conservative reading of the statistics; the order of the rules matters."""
    diff = F.coalesce(difference, F.lit(0.0))
    strong = (p_value <= 0.05) & (effect >= 0.5)
    return (
        F.when((F.coalesce(laser_count, F.lit(0)) == 0) | (F.coalesce(control_count, F.lit(0)) == 0), "no signal")
        .when(diff <= 0.02, "no signal")
        .when(p_value.isNull() | effect.isNull(), "anomaly")
        .when(strong & (F.coalesce(persistence, F.lit(0.0)) >= 0.15), "repeatable candidate")
        .when(strong, "above-control candidate")
        .when(diff > 0.05, "anomaly")
        .otherwise("artifact")
    )


def interpretation(ladder: Column) -> Column:
    """What a ladder level means (fixed texts)."""
    return (
        F.when(
            ladder == "blinded review",
            "Candidates are ranked without source roles or control comparisons visible.",
        )
        .when(
            ladder.isin("above-control candidate", "repeatable candidate"),
            "The selected protocol found laser-frame scores above matched controls under this run's thresholds.",
        )
        .when(
            ladder == "anomaly",
            "The run found elevated structure, but not enough to clear the controlled evidence threshold.",
        )
        .otherwise("The selected capture and detector set did not beat matched controls.")
    )


def null_result_language(ladder: Column) -> Column:
    """Wording that goes with a ladder level (fixed texts)."""
    return (
        F.when(
            ladder.isin("above-control candidate", "repeatable candidate"),
            "This run found structure scores above matched controls. Treat this as a candidate "
            "finding until it repeats across new blinded captures.",
        )
        .when(
            ladder == "anomaly",
            "This run found elevated structure scores, but the evidence did not clear the "
            "configured blinded control threshold.",
        )
        .otherwise(
            "This run did not find structured detections above matched controls. That does not "
            "prove absence of signal; it means this capture and detector set did not beat the null."
        )
    )


def stable_json(columns: dict) -> Column:
    """One JSON text per row with keys in sorted order, whatever order they came in."""
    return F.to_json(F.struct(*[columns[name].alias(name) for name in sorted(columns)]), {"ignoreNullFields": "false"})
