"""Exports: candidate CSV and review bundle (IO8, IO9)."""

from pyspark.sql import DataFrame, functions as F

from ..operators import hashtree
from ..operators.review import candidate_table
from . import media

# Manifest fields that may leave a sealed run.
SEALED_MANIFEST = [
    "schema_version", "experiment_id", "created_at", "frame_sampling", "preprocessing_profiles", "detectors",
    "blind_seed", "protocol", "analysis_plan", "outputs",
]


def write_candidates(candidates: DataFrame, path: str, unblinded: bool):
    """IO8: at most the report's top rows, so one output file is enough."""
    candidate_table(candidates, unblinded).orderBy("rank").coalesce(1).write.mode("overwrite").csv(path, header=True)


def asset_hashes(candidates: DataFrame, rois_per_candidate=3) -> DataFrame:
    """IO9: bundle members of the top candidates with their hashes.

    ``assets array<struct<kind,name,sha256>>`` lists what a candidate has; crops are
    limited to the first three, as the review bundle shows no more.
    """
    crops = F.slice(F.filter("assets", lambda a: a["kind"] == "crop"), 1, rois_per_candidate)
    others = F.filter("assets", lambda a: a["kind"] != "crop")
    folder = F.when(F.col("a.kind") == "crop", "top_crops").when(F.col("a.kind") == "original", "top_originals").otherwise("top_candidates")
    return candidates.select(F.explode(F.concat(others, crops)).alias("a")).select(
        F.concat(folder, F.lit("/"), F.col("a.name")).alias("member"), F.col("a.sha256").alias("sha256"))


def bundle_tree(members: DataFrame) -> DataFrame:
    """IO9: hash tree over the (member, sha256) rows of a bundle."""
    return hashtree.tree(media.group_records(members, [], "member", "sha256"))


def export_bundle(tables: dict, path: str, unblinded: bool, include_media=False, members: DataFrame = None):
    """IO9: a directory of tables. Media only after the reveal; a sealed manifest is cut
    to its allow-list. ``members`` (member, sha256) are written as ``hashes`` with the nodes
    of their hash tree as ``hash_tree``, whose root stands for all of them."""
    if include_media and not unblinded:
        raise ValueError("media stay back until the roles have been revealed")
    for name, df in tables.items():
        if name == "media" and not include_media:
            continue
        if name == "manifest" and not unblinded:
            df = df.select(*[c for c in df.columns if c in SEALED_MANIFEST])
        df.write.mode("overwrite").json(f"{path}/{name}")
    if members is not None:
        members.write.mode("overwrite").json(f"{path}/hashes")
        bundle_tree(members).write.mode("overwrite").json(f"{path}/hash_tree")
