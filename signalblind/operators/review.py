"""Review annotations, candidate filters, provenance, report tables (R, P, Q, M, K, U, F4)."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import columns as C


# Flags a reviewer may set.
REVIEW_FLAGS = ["interesting", "artifact", "ocr_hit", "persistent", "exclude"]

# Protocol presets (id, name, profile, primary metric, family, quality checks, science options).
PROTOCOLS = [
    ("diffraction", "Diffraction / interference", "wide", "fft_peak_prominence", "diffraction",
     ["laser_capture", "control_capture", "frame_count", "saturation", "calibration"],
     ["2D FFT spectrum", "fringe spacing proxy", "peak/ring stability"],
     "Looks for repeatable spatial-frequency structure such as fringes, peaks, and rings."),
    ("speckle", "Laser speckle / scatter", "wide", "speckle_contrast", "speckle",
     ["laser_capture", "control_capture", "frame_count", "saturation", "stability"],
     ["spatial speckle contrast", "local variance map", "temporal contrast proxy"],
     "Measures spatial and frame-to-frame speckle contrast against matched controls."),
    ("ocr", "OCR / symbol recovery", "baseline", "ocr_symbol_score", "symbol",
     ["laser_capture", "control_capture", "ocr_available", "calibration"],
     ["OCR confidence", "connected components", "synthetic known-text calibration"],
     "Keeps OCR as a detector while requiring synthetic-positive calibration and controls."),
    ("anomaly", "General anomaly scan", "wide", "structure_score", "anomaly",
     ["laser_capture", "control_capture", "frame_count", "fdr"],
     ["texture features", "edge/line density", "frame persistence", "FDR correction"],
     "Broad texture, edge, OCR, and persistence scan with stricter false-positive language."),
]

# Capture fields that should be recorded, with the warning text.
RECOMMENDED_FIELDS = [
    ("camera", "Camera/device was not recorded."),
    ("exposure", "Exposure settings were not recorded."),
    ("focus_mode", "Focus mode was not recorded."),
    ("compression_history", "Compression history was not recorded."),
]

# Fields a catalog entry must fill.
REQUIRED_CATALOG_FIELDS = [
    "attribution", "expected_behavior", "id", "kind", "label", "license", "limitations", "phenomena",
    "redistributable", "source_page", "title",
]

# Columns of the candidate table, and those shown only after the reveal.
CANDIDATE_COLUMNS = [
    "rank", "blind_id", "sample_id", "primary_metric", "primary_metric_score", "structure_score", "persistence_score",
    "preprocessing_variant", "ocr_confidence", "ocr_text", "review_flags", "review_note", "q_value",
    "detector_family_scores", "processed_path",
]
ATTRIBUTION_COLUMNS = ["unblinded_label", "source_path", "frame_index", "control_type"]


# --- annotations ---------------------------------------------------------------------


def normalized_flags(flags: Column) -> Column:
    """Distinct sorted flags; an unknown one is an error."""
    unknown = F.array_except(flags, F.array(*[F.lit(f) for f in REVIEW_FLAGS]))
    message = F.concat(F.lit("unknown review flags: "), F.concat_ws(", ", F.array_sort(unknown)))
    return F.when(F.size(unknown) > 0, F.raise_error(message)).otherwise(F.array_sort(F.array_distinct(flags)))


def latest_annotations(log: DataFrame, key="blind_id", at="ts") -> DataFrame:
    """Current state of an append-only log; one partial aggregate per key."""
    newest = F.max_by(F.struct(F.trim("note").alias("note"), "flags"), F.col(at))
    return log.groupBy(key).agg(
        newest.alias("_n"), F.min(at).alias("created_at"), F.max(at).alias("updated_at"),
        F.count(F.lit(1)).alias("revisions")
    ).select(key, "_n.note", "_n.flags", "created_at", "updated_at", "revisions")


def unknown_ids(log: DataFrame, results: DataFrame, key="blind_id") -> DataFrame:
    """Annotated ids that no result carries; must be empty."""
    return log.select(key).distinct().join(results.select(key).distinct(), key, "left_anti")


def attach_annotations(candidates: DataFrame, annotations: DataFrame, key="blind_id") -> DataFrame:
    """Empty flags and note where nobody wrote any."""
    joined = candidates.join(annotations.select(key, "note", "flags"), key, "left")
    return joined.withColumns({
        "review_flags": F.coalesce(F.concat_ws(",", "flags"), F.lit("")),
        "review_note": F.coalesce("note", F.lit(""))}).drop("note", "flags")


# --- candidates ----------------------------------------------------------------------


def filter_candidates(df: DataFrame, min_score=0.0, min_persistence=0.0, variant="all", text="any", family="all") -> DataFrame:
    """the reviewer's filters. ``text`` is any / has / none."""
    out = df.filter((F.coalesce("primary_metric_score", "structure_score", F.lit(0.0)) >= min_score)
                    & (F.coalesce("persistence_score", F.lit(0.0)) >= min_persistence))
    if variant != "all":
        out = out.filter(F.col("preprocessing_variant") == variant)
    has_text = F.trim(F.coalesce("ocr_text", F.lit(""))) != ""
    if text != "any":
        out = out.filter(has_text if text == "has" else ~has_text)
    if family != "all":
        out = out.filter(C.strongest_family({f: F.col(f) for f in C.FAMILIES}) == family)
    return out


def top_candidates(best: DataFrame, order: list, k=20) -> DataFrame:
    """K1 + W4: ranked head of the candidates; each task keeps k rows, so the final
    ranking window sees k rows in all."""
    head = best.orderBy(*order).limit(k)
    return head.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def candidate_table(candidates: DataFrame, unblinded: bool) -> DataFrame:
    """IO8: the columns of the candidate export; attribution only after the reveal."""
    shown = list(CANDIDATE_COLUMNS)
    if unblinded:
        shown[3:3] = ATTRIBUTION_COLUMNS
    return candidates.select(*[c for c in shown if c in candidates.columns])


# --- provenance ----------------------------------------------------------------------


def provenance_warnings(meta, media_width, media_height, kind, fps) -> Column:
    """Warnings of a capture. ``meta(name)`` gives the recorded text of a field."""
    entry = lambda code, message: F.struct(
        F.lit(code).alias("code"), F.lit("warning").alias("severity"), F.lit(message).alias("message"))
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    zero = lambda c: F.coalesce(c, F.lit(0)) == 0
    # Codes and texts of the warnings.
    rules = [(empty(meta(field)), f"missing_{field}", text) for field, text in RECOMMENDED_FIELDS] + [
        (zero(media_width) | zero(media_height), "unknown_resolution", "Media resolution could not be determined."),
        ((kind == "video") & zero(fps), "unknown_fps", "Video frame rate could not be determined."),
        (F.coalesce(meta("camera_fixed") == "false", F.lit(False)), "camera_not_fixed",
         "Camera was marked as not fixed; persistence scores may reflect motion."),
        (F.coalesce(meta("saturated") == "true", F.lit(False)), "capture_saturated",
         "Capture was marked saturated; clipped regions can create detector artifacts."),
    ]
    return F.filter(F.array(*[F.when(test, entry(code, text)) for test, code, text in rules]), lambda w: w.isNotNull())


def media_summary(files: DataFrame, by: list, path="path", ext="format", width="width", height="height") -> DataFrame:
    """Count, formats and the size of the first file of each image set."""
    return files.groupBy(*by).agg(
        F.count(F.lit(1)).alias("image_count"), F.array_sort(F.collect_set(ext)).alias("formats"),
        F.min_by(width, path).alias("width"), F.min_by(height, path).alias("height"))


def duration_ms(frames: Column, fps: Column) -> Column:
    """P2"""
    return F.when((frames > 0) & (fps > 0), F.floor(frames.cast("double") / fps * 1000).cast("long"))


def source_provenance(samples: DataFrame, order: str, keys: list, fixture="fixture_id") -> DataFrame:
    """P3 + K5: one record per capture, the last recorded value of every field, fixtures first.

    ``max_by`` over the rows that carry a value is a partial aggregate, so a hot capture
    is folded where its samples are.
    """
    last = [F.max_by(F.col(k), F.when(F.col(k).isNotNull(), F.col(order))).alias(k) for k in keys]
    rolled = samples.filter(F.coalesce("capture_id", fixture).isNotNull()).groupBy(
        F.coalesce("capture_id", fixture).alias("source_key")).agg(F.max("capture_id").alias("capture_id"), *last)
    return rolled.orderBy(F.when(F.coalesce(F.col(fixture), F.lit("")) != "", 0).otherwise(1),
                          F.coalesce(F.col(fixture), F.col("capture_id"), F.lit("")))


# --- quality and reports -------------------------------------------------------------


def badges(unblinded, calibration_passed, positives, controls, any_text, warnings, complete) -> Column:
    """Q1: badge list of a run, in fixed order; arguments are Columns."""
    # Texts of the badges.
    rules = [
        F.when(unblinded, "multiple comparisons corrected").otherwise("review blinded"),
        F.when(unblinded, "review unblinded").otherwise("source roles sealed"),
        F.when(calibration_passed, "calibration passed").when(positives > 0, "calibration failed"),
        F.when(unblinded & (controls > 0), "controls matched"),
        F.when(~any_text, "OCR unavailable"),
        F.when(warnings == 0, "provenance complete").otherwise(F.concat(F.lit("provenance warnings: "), warnings)),
        F.when(complete, "blind review complete"),
        F.lit("media not included"),
    ]
    return F.filter(F.array(*rules), lambda b: b.isNotNull())


def readiness(captures: DataFrame, sample_count: Column, level: str, by=()) -> DataFrame:
    """Q2 + U4: checklist before a run, one row per check."""
    agg = captures.groupBy(*by).agg(
        F.collect_set("role").alias("roles"), F.sum("warning_count").alias("warnings"), sample_count.alias("samples"))
    controls = F.array_intersect("roles", F.array(*[F.lit(r) for r in C.CONTROL_ROLES]))
    checks = [
        ("laser capture", F.array_contains("roles", "laser")),
        ("control capture", F.size(controls) > 0),
        ("frame count >= 2", F.col("samples") >= 2),
        ("matched controls enabled", F.lit(level != "none")),
        ("capture provenance complete", F.col("warnings") == 0),
        ("multiple comparisons corrected", F.lit(True)),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("check"), test.alias("ok")) for n, test in checks])
    return agg.select(*by, F.explode(rows).alias("c")).select(*by, "c.check", "c.ok")


def missing_fields(columns: dict) -> Column:
    """Names of required fields without a value, in alphabetical order."""
    empty = lambda c: c.isNull() | (c.cast("string") == "")
    return F.filter(F.array(*[F.when(empty(columns[f]), F.lit(f)) for f in REQUIRED_CATALOG_FIELDS]), lambda f: f.isNotNull())


def validate_catalog(catalog: DataFrame, files: DataFrame = None) -> DataFrame:
    """Q3: problems of a catalog, one row each. ``files`` lists bundled file names.

    Repeats of an id are found by counting per id, so a hot id costs one partial count.
    """
    missing = missing_fields({f: F.col(f) for f in REQUIRED_CATALOG_FIELDS})
    lacking = catalog.select("id", missing.alias("m")).filter(F.size("m") > 0).select(
        "id", F.concat(F.lit("missing "), F.concat_ws(", ", "m")).alias("problem"))
    repeated = catalog.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "id", F.lit("duplicate fixture id").alias("problem"))
    unnamed = catalog.filter(F.col("redistributable") & (F.coalesce("filename", F.lit("")) == "")).select(
        "id", F.lit("redistributable fixture has no filename").alias("problem"))
    out = lacking.unionByName(repeated).unionByName(unnamed)
    if files is not None:
        absent = catalog.filter("redistributable").join(
            files.select("filename").distinct(), "filename", "left_anti").select(
            "id", F.lit("bundled media file is missing").alias("problem"))
        out = out.unionByName(absent)
    return out


def protocols(spark: SparkSession) -> DataFrame:
    schema = "protocol string, name string, profile string, primary_metric string, detector_family string, quality_checks array<string>, science array<string>, description string"
    return spark.createDataFrame(PROTOCOLS, schema)


def with_protocol(df: DataFrame, table: DataFrame, want="protocol") -> DataFrame:
    """M1: preset of the wanted protocol, ``anomaly`` by default; an unknown one is an error.

    Four presets, so the lookup side is broadcast.
    """
    asked = df.withColumn(want, F.coalesce(F.col(want), F.lit("anomaly")))
    joined = asked.join(F.broadcast(table.withColumnRenamed("protocol", want)), want, "left")
    return joined.withColumn("primary_metric", F.when(F.col("primary_metric").isNull(), F.raise_error(
        F.concat(F.lit("unknown protocol preset: "), F.col(want)))).otherwise(F.col("primary_metric")))


def describe_protocol(table: DataFrame) -> DataFrame:
    text = F.concat("name", F.lit(": "), "description", F.lit(" Science options: "), F.concat_ws(", ", "science"), F.lit("."))
    return table.select("protocol", text.alias("text"))


def backfill(df: DataFrame, defaults: dict) -> DataFrame:
    """M2: add missing columns and fill missing values; what is there stays."""
    return df.withColumns({
        c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def preview(frames: DataFrame, n=4, by="capture_id", order="frame_index") -> DataFrame:
    """IO10: up to ``n`` evenly spaced frames of each capture."""
    from .sampling import with_position

    total = frames.groupBy(by).agg(F.count(F.lit(1)).alias("_total"))
    placed = with_position(frames, by, order).join(total, by)
    step = F.greatest(F.lit(1), F.floor(F.col("_total") / max(1, n)))
    return placed.filter((F.col("position") % step == 0) & (F.floor(F.col("position") / step) < n)).drop("_total")
