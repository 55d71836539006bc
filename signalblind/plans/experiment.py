"""One controlled experiment from frames to evidence: ingest, blinded run, reveal.

The pure functions take and give DataFrames; ``Experiment`` keeps their tables under one
folder and guards the blinded state.
"""

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import columns as C
from ..functions.columns import let
from ..operators import blinding as B, controls as K, crossframe as X, detectors as D, preprocess as P
from ..operators import review as R, sampling as S, stats
from ..operators.ordering import attach_totals
from ..session import cut, spread
from ..sources import sinks


def ingest(frames: DataFrame, mode="interval", interval=5, cap=None, deduplicate=True, threshold=0.10, video=True,
           by="capture_id", order="frame_index") -> DataFrame:
    """Sample, de-duplicate, cap and number the frames of each capture.

    ``frames`` carry ``signature`` and ``mean_intensity`` to de-duplicate and ``thumb``
    for scene changes. In a video the scene reference moves only when a frame is kept;
    in an image set it moves on every scene change, so the two steps come apart.
    """
    if mode not in S.SAMPLING_MODES:
        raise ValueError(f"unknown frame sampling mode: {mode}")
    if mode == "interval":
        frames = S.interval_sample(frames, interval, by, order).drop("position")
    if mode == "scene_change":
        picked = S.select_frames(frames, by, order, threshold, deduplicate and video)
        if video or not deduplicate:
            selected = picked
        else:
            changed = picked.filter("status = 'kept'").drop("status")
            selected = S.select_frames(changed, by, order)
    else:
        selected = S.select_frames(frames, by, order, None, deduplicate)
    looked_at = S.cap_selection(selected, None if mode == "all_frames" else cap, by, order)
    return S.number_frames(looked_at.filter("status = 'kept'").drop("status"), by, order)


def with_measures(frames: DataFrame) -> DataFrame:
    """Signature, mean intensity and thumbnail of packed frames, in one pass."""
    h, w = F.col("height"), F.col("width")
    return frames.withColumns({
        "signature": let(F.col("pixels"), lambda p: S.signature(p, h, w)),
        "mean_intensity": let(F.col("pixels"), S.mean_intensity),
        "thumb": S.scene_thumbnail(F.col("pixels"), h, w),
    })


def blinded_samples(frames: DataFrame, seed: int, level="standard", role="role", calibration=(180, 320)) -> DataFrame:
    """U1 + B1: frames, controls and calibration sample under blind ids."""
    return B.assign_blind_ids(K.all_samples(frames, level, role, calibration=calibration), seed).drop("blind_rank")


def blinded_run(samples: DataFrame, profile="baseline", metric="structure_score", roi=None, group="parent") -> DataFrame:
    """Every sample under every variant, with per-frame and cross-frame features.

    Attribution is still attached; ``seal`` takes it off.
    """
    cropped = P.crop(samples, **roi) if roi else samples
    sized = X.with_group(cropped, group).withColumns({
        "review_height": F.col("height"), "review_width": F.col("width"),
        "frame_index": F.coalesce("frame_index", F.lit(0))})
    keep = ["blind_id", "sequence_id", "frame_index", "review_height", "review_width"]
    work = P.expand_variants(spread(sized.select(*keep, "pixels", "height", "width"), "blind_id"), profile)
    keys, sequence = ["blind_id", "variant"], ["sequence_id", "variant"]
    order = [F.col("frame_index"), F.col("blind_id")]
    # Features and masks are read by two later steps, so they are computed once and
    # written out; pixels are not.
    measured = cut(D.measure(work, keys, ["ordinal", "sequence_id", "frame_index"], ("review_height", "review_width")))
    persist = X.mask_persistence(measured, sequence, order, "blind_id").drop("sequence_id")
    moved = X.registration(work, sequence, order, "blind_id").drop("sequence_id")
    found = D.complete(measured.drop("sequence_id", "frame_index"), keys, metric).drop("mask", "height", "width")
    known = [c for c in B.ATTRIBUTION if c in samples.columns]
    return found.join(persist, keys).join(moved, keys).join(samples.select("blind_id", *known), "blind_id").withColumnRenamed(
        "variant", "preprocessing_variant").withColumns({
            "preprocessing_profile": F.lit(profile), "primary_metric": F.lit(metric)})


def unblind_compare(sealed: DataFrame, seal_map: DataFrame, calibration: DataFrame, digest: str, seed: int,
                    permutations=1000, metric="structure_score") -> DataFrame:
    """Integrity check, reveal, and the statistics of signal against control."""
    shown = B.unblind(sealed, seal_map, calibration, digest)
    return stats.summarize(shown, seed, permutations, metric, fallback="structure_score")


def _now():
    return datetime.now(timezone.utc).replace(microsecond=0).isoformat().replace("+00:00", "Z")


STATE_SCHEMA = "version int, at string, review_state string, run_id string, digest string, seed int, profile string, protocol string, metric string, complete boolean"
ANNOTATION_SCHEMA = "run_id string, blind_id string, note string, flags array<string>, ts string, seq int"

# Result columns a review shows next to the fixed allow-list.
FEATURES = [
    "ordinal", "entropy", "contrast_std", "laplacian_variance", "contrast_mean", "contrast_spread", "variance_mean",
    "saturated_fraction", "component_count", "text_like_count", "median_area", "roi_count", "edge_density", "line_count",
    "mean_line_length", "prominence", "radius", "angle", "ring", "glcm_contrast", "glcm_homogeneity", "glcm_energy",
    "glcm_entropy", "shift_x", "shift_y", "shift_magnitude", "response", "word_count", "confidence", *C.FAMILIES,
]


class Experiment:
    """An experiment folder: frames, runs, seal maps and annotations as parquet tables.

    ``path`` must be on storage every executor sees.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> "Experiment":
        exp = cls(spark, path)
        exp._set_state(version=1, review_state="open", protocol="anomaly", complete=False)
        return exp

    # State is a log of one-row records; the highest version counts.

    def _set_state(self, **values):
        row = {name.split()[0]: None for name in STATE_SCHEMA.split(", ")}
        row.update(values, at=_now())
        self.spark.createDataFrame([tuple(row.values())], STATE_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/state")

    def state(self) -> dict:
        return self.spark.read.parquet(f"{self.path}/state").orderBy(F.desc("version")).first().asDict()

    def _change_state(self, **values):
        now = self.state()
        self._set_state(**{**now, **values, "version": now["version"] + 1})

    def _require_open(self, what):
        if self.state()["review_state"] == "blinded":
            raise ValueError(f"the latest review is still blinded; unblind it before {what}")

    def add_capture(self, frames: DataFrame, metadata=None, kind="image-set", fps=None, **sampling):
        """Ingest packed frames (capture_id, frame_index, role, pixels, height, width) with
        the recorded capture metadata; what is missing there becomes a warning."""
        self._require_open("changing captures")
        bad = frames.filter(~F.col("role").isin(*C.CAPTURE_ROLES)).select("role").first()
        if bad is not None:
            raise ValueError(f"unknown capture role {bad['role']!r}; expected one of {C.CAPTURE_ROLES}")
        kept = ingest(with_measures(frames), **sampling).drop("thumb")
        kept.write.mode("append").partitionBy("capture_id").parquet(f"{self.path}/frames")
        recorded = lambda field: F.lit(None if metadata is None else metadata.get(field)).cast("string")
        warnings = R.provenance_warnings(recorded, F.col("width"), F.col("height"), F.lit(kind), F.lit(fps).cast("double"))
        frames.groupBy("capture_id", "role").agg(F.min("width").alias("width"), F.min("height").alias("height")).select(
            "capture_id", "role", F.lit(kind).alias("kind"), warnings.alias("warnings")).write.mode("append").parquet(f"{self.path}/captures")

    def captures(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/captures")

    def frames(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/frames")

    def update_plan(self, protocol: str, metric: str = None):
        self._require_open("changing the plan")
        preset = R.protocols(self.spark).filter(F.col("protocol") == protocol).first()
        if preset is None:
            raise ValueError(f"unknown protocol preset: {protocol}")
        self._change_state(protocol=protocol, metric=metric or preset["primary_metric"])

    def estimate(self, profile="baseline", level="standard") -> DataFrame:
        return stats.estimate(self.frames(), len(P.PROFILES.get(profile, [])), level)

    def preview(self, n=4) -> DataFrame:
        return R.preview(self.frames(), n)

    def run(self, profile="baseline", seed=1, level="standard", roi=None, calibration=(180, 320)) -> str:
        """Write sealed results and, apart from them, the seal map and calibration."""
        self._require_open("starting another run")
        state = self.state()
        preset = R.protocols(self.spark).filter(F.col("protocol") == state["protocol"]).first()
        metric = state["metric"] or preset["primary_metric"]
        profile = preset["profile"] if profile == "auto" else profile
        run_id = f"run-{state['version']:06d}"
        folder = f"{self.path}/runs/{run_id}"
        blinded_samples(self.frames(), seed, level, calibration=calibration).write.mode("overwrite").parquet(f"{folder}/sealed/samples")
        samples = self.spark.read.parquet(f"{folder}/sealed/samples")
        known = [c for c in B.ATTRIBUTION if c in samples.columns]
        seal_map = samples.select("blind_id", *known)
        digest = B.write_seal(seal_map, f"{folder}/sealed/map")
        results = blinded_run(samples, profile, metric, roi).withColumn("run_id", F.lit(run_id))
        results.write.mode("overwrite").parquet(f"{folder}/sealed/results")
        results = self.spark.read.parquet(f"{folder}/sealed/results")
        # Written in blind order, so neither row order nor file order tells the role.
        B.seal(results, seal_map, FEATURES).repartitionByRange("blind_id").sortWithinPartitions("blind_id").write.mode(
            "overwrite").parquet(f"{folder}/results")
        B.calibration_results(results, seal_map).write.mode("overwrite").parquet(f"{folder}/sealed/calibration")
        self._change_state(review_state="blinded", run_id=run_id, digest=digest, seed=seed, profile=profile, metric=metric, complete=False)
        return run_id

    def _folder(self):
        run_id = self.state()["run_id"]
        if run_id is None:
            raise FileNotFoundError("no run exists yet")
        return f"{self.path}/runs/{run_id}"

    def unblinded(self) -> bool:
        return self.state()["review_state"] != "blinded"

    def results(self) -> DataFrame:
        name = "revealed" if self.unblinded() else "results"
        return self.spark.read.parquet(f"{self._folder()}/{name}")

    def unblind(self, permutations=1000) -> DataFrame:
        """Reveal, compare, attach q-values. A rerun overwrites the same tables."""
        state, folder = self.state(), self._folder()
        read = lambda name: self.spark.read.parquet(f"{folder}/{name}")
        if state["review_state"] == "blinded":
            seal_map = read("sealed/map")
            shown = B.unblind(read("results"), seal_map, read("sealed/calibration"), state["digest"])
            scores = stats.sample_scores(shown, fallback="structure_score")
            scores.write.mode("overwrite").parquet(f"{folder}/scores")
            scores = read("scores")
            q = stats.bh_q(stats.empirical_p(scores))
            stats.attach_q(shown.drop("q_value"), q).write.mode("overwrite").parquet(f"{folder}/revealed")
            stats.summarize_scores(scores, state["seed"], permutations, state["metric"]).write.mode("overwrite").parquet(f"{folder}/summary")
            self._change_state(review_state="unblinded")
        return read("summary")

    def summary(self) -> DataFrame:
        if self.unblinded():
            return self.spark.read.parquet(f"{self._folder()}/summary")
        shown = B.restore(self.results(), self.spark.read.parquet(f"{self._folder()}/sealed/map"))
        calibration = self.spark.read.parquet(f"{self._folder()}/sealed/calibration")
        return stats.summarize_blinded(shown.unionByName(calibration, allowMissingColumns=True), self.state()["metric"])

    def annotate(self, blind_id: str, note="", flags=()):
        """Append one annotation; unknown ids and flags are refused."""
        if self.results().filter(F.col("blind_id") == blind_id).first() is None:
            raise ValueError(f"unknown blind candidate: {blind_id}")
        unknown = sorted(set(flags) - set(R.REVIEW_FLAGS))
        if unknown:
            raise ValueError(f"unknown review flags: {', '.join(unknown)}")
        log = self.annotation_log()
        seq = 0 if log is None else log.count()
        row = (self.state()["run_id"], blind_id, note.strip(), sorted(set(flags)), _now(), seq)
        self.spark.createDataFrame([row], ANNOTATION_SCHEMA).write.mode("append").parquet(f"{self.path}/annotations")

    def annotation_log(self):
        try:
            log = self.spark.read.schema(ANNOTATION_SCHEMA).parquet(f"{self.path}/annotations")
        except Exception as error:  # no annotation yet
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise
        return log.filter(F.col("run_id") == self.state()["run_id"])

    def complete_review(self):
        self._change_state(complete=True)

    def candidates(self, k=20) -> DataFrame:
        """K1: the top candidates with annotations; the calibration sample is left out."""
        results = self.results()
        if "unblinded_label" in results.columns:
            results = results.filter(F.col("unblinded_label") != B.CALIBRATION)
        best = X.best_variant(results)
        top = R.top_candidates(best, [F.desc("primary_metric_score"), F.col("blind_id")], k)
        log = self.annotation_log()
        if log is None:
            return top.withColumns({"review_flags": F.lit(""), "review_note": F.lit("")})
        return R.attach_annotations(top, R.latest_annotations(log, at="seq"))

    def report(self) -> DataFrame:
        """Q1/Q4: one nested row with summary, badges and candidates."""
        state, summary = self.state(), self.summary()
        top = self.candidates()
        shown = [c for c in top.columns if c not in ("candidate_rois",)]
        # At most the twenty candidates of the report are gathered.
        candidates = top.agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in shown if c != "rank"]))).alias("top_candidates"))
        texts = self.results().agg((F.coalesce(F.max("word_count"), F.lit(0)) > 0).alias("any_text"))
        row = summary
        for part in (texts, candidates, stats.warning_count(self.captures())):
            row = attach_totals(row, part, [])
        listed = R.badges(
            F.lit(self.unblinded()), F.col("calibration_passed"), F.col("synthetic_positive_count"), F.coalesce("control_count", F.lit(0)),
            F.col("any_text"), F.coalesce("warning_count", F.lit(0)), F.lit(state["complete"]))
        return row.select(
            F.lit(state["run_id"]).alias("run_id"), F.lit(state["protocol"]).alias("protocol"), F.lit(state["review_state"]).alias("review_state"),
            listed.alias("badges"), F.struct(*summary.columns).alias("summary"), "top_candidates")

    def export_candidates(self, path: str):
        sinks.write_candidates(self.candidates(), path, self.unblinded())

    def export_bundle(self, path: str, include_media=False):
        """IO9: report, results and asset hashes; media only after the reveal."""
        if include_media and not self.unblinded():
            raise ValueError("media stay back until the roles have been revealed")
        state = self.spark.createDataFrame([tuple(self.state().values())], STATE_SCHEMA)
        manifest = state.select(F.lit(1).alias("schema_version"), F.col("run_id").alias("experiment_id"), F.col("seed").alias("blind_seed"),
                                "protocol", F.col("profile").alias("preprocessing_profiles"), "digest")
        tables = {"manifest": manifest, "report": self.report(), "results": self.results()}
        if include_media:
            tables["media"] = self.frames()
        sinks.export_bundle(tables, path, self.unblinded(), include_media)
