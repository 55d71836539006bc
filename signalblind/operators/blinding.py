"""Blind identifiers, sealing and the explicit reveal."""

from pyspark.sql import DataFrame, functions as F

from . import hashtree
from .ordering import global_rank

CALIBRATION = "synthetic_positive"

# Result columns that may be shown while roles are sealed.
SEALED_COLUMNS = [
    "run_id", "blind_id", "blinded_label", "review_image_path", "processed_path", "processed_sha256",
    "preprocessing_profile", "preprocessing_variant", "preprocessing_hash", "protocol", "primary_metric", "ocr",
    "connected_components", "entropy_texture", "edge_line_density", "fft_spectrum", "speckle_contrast",
    "texture_features", "frame_registration", "detector_family_scores", "candidate_rois", "structure_score",
    "primary_metric_score", "persistence_score",
]

# Attribution restored by the reveal.
ATTRIBUTION = [
    "sample_id", "unblinded_label", "capture_id", "parent_capture_id", "frame_id", "parent_frame_id", "control_type",
    "frame_index", "timestamp_ms",
]


def assign_blind_ids(samples: DataFrame, seed: int, sample="sample_id") -> DataFrame:
    """B1: B000001... in the order of md5("seed:sample").

    Only the sample ids are numbered; pixels and other wide columns meet their number in
    one join. Sample ids must be unique.
    """
    ids = samples.select(F.col(sample), F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(sample))).alias("_h"))
    ranked = global_rank(ids, [F.col("_h"), F.col(sample)], "blind_rank").drop("_h")
    blind = F.format_string("B%06d", F.col("blind_rank"))
    return samples.join(ranked.withColumns({"blind_id": blind, "blinded_label": blind}), sample).select(
        *samples.columns, "blind_rank", "blind_id", "blinded_label")


def seal(results: DataFrame, seal_map: DataFrame, extra_allowed=()) -> DataFrame:
    """J3 + F5: drop calibration results, keep the allow-list, show the blind id only.

    The calibration sample is one row, so the anti join is against a tiny side; Spark
    decides by its statistics whether to broadcast it.
    """
    positive = seal_map.filter(F.col("unblinded_label") == CALIBRATION).select("blind_id")
    allowed = [c for c in results.columns if c in SEALED_COLUMNS or c in extra_allowed]
    return results.join(positive, "blind_id", "left_anti").select(
        *allowed, F.col("blind_id").alias("sample_id"), F.lit(None).cast("double").alias("q_value"))


def calibration_results(results: DataFrame, seal_map: DataFrame) -> DataFrame:
    """The results kept out of the sealed table, stored next to the seal map."""
    positive = seal_map.filter(F.col("unblinded_label") == CALIBRATION).select("blind_id")
    return results.join(positive, "blind_id", "left_semi")


def seal_sources(sources: DataFrame) -> DataFrame:
    """F6"""
    return sources.select("source_id", "kind", F.lit(True).alias("sealed"))


def seal_captures(frames: DataFrame) -> DataFrame:
    """captures with nothing but ids, kind and size; partial counts per capture."""
    return frames.groupBy("capture_id", "source_id", "kind").agg(
        F.count(F.lit(1)).alias("frame_count")).withColumn("sealed", F.lit(True))


def seal_rows(seal_map: DataFrame) -> DataFrame:
    """B2: the rows of the map as hash tree leaves."""
    return hashtree.leaves(seal_map, F.sha2(F.to_json(F.struct(*sorted(seal_map.columns)), {"ignoreNullFields": "false"}), 256))


def digest(seal_map: DataFrame) -> DataFrame:
    """B2: one digest of the whole map, independent of row order and placement: the root
    of its hash tree. An empty map has none (null)."""
    return hashtree.roots(hashtree.tree(seal_rows(seal_map))).agg(F.max("digest").alias("digest"))


def check_digest(seal_map: DataFrame, expected: str):
    """Refuse to go on when the map is not the one that was sealed."""
    found = digest(seal_map).first()["digest"]
    if found != expected:
        raise ValueError("integrity: the stored map is not the one that was sealed, so nothing is revealed")


def write_seal(seal_map: DataFrame, path: str) -> str:
    """B2: store the map apart from the results and return its digest."""
    seal_map.write.mode("overwrite").parquet(path)
    return digest(seal_map.sparkSession.read.parquet(path)).first()["digest"]


def restore(sealed: DataFrame, seal_map: DataFrame) -> DataFrame:
    """Give results their attribution back; a result without one is an error."""
    known = [c for c in ATTRIBUTION if c in seal_map.columns]
    shown = sealed.drop(*[c for c in known if c in sealed.columns], "q_value")
    joined = shown.join(seal_map.select("blind_id", *known), "blind_id", "left")
    checked = F.when(F.col("sample_id").isNull(), F.raise_error(
        F.concat(F.lit("missing sealed sample mapping for "), F.col("blind_id")))).otherwise(F.col("sample_id"))
    return joined.withColumn("sample_id", checked)


def unblind(sealed: DataFrame, seal_map: DataFrame, calibration: DataFrame, expected_digest: str) -> DataFrame:
    """Integrity check, reveal, and the calibration results back in."""
    check_digest(seal_map, expected_digest)
    restored = restore(sealed, seal_map)
    return restored.unionByName(restore(calibration, seal_map), allowMissingColumns=True)
