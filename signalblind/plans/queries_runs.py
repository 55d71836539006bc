"""Whole runs: ingest, blinded run, reveal and report (E1-E3, Q4, K)."""

from pyspark.sql import functions as F

from ..operators import blinding as B, crossframe as X, review as R, stats as S
from ..session import cut
from ..sources.tables import frames
from . import experiment as E
from .queries_frames import GREEDY, signed_documents
from .queries_stats import COHEN, FRAME_RESULTS, FRAME_SCORES, LADDER, MEANS, SEED, frame_results
from .registry import EMPIRICAL, STEP_UP, permutation_sql, query


@query("e1_ingest", GREEDY.replace("FROM sigs),", "FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY frame_index) - 1 AS pos FROM sigs) WHERE pos % 2 = 0),").replace(
    "SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY frame_index) AS rn",
    "SELECT * EXCLUDE pos, row_number() OVER (PARTITION BY capture_id ORDER BY frame_index) AS rn") + """,
kept_frames AS (SELECT capture_id, frame_index, row_number() OVER (PARTITION BY capture_id ORDER BY frame_index) - 1 AS n FROM walk WHERE NOT dup)
SELECT capture_id, frame_index, format('{}-frame-{:06d}', capture_id, n) AS frame_id FROM kept_frames WHERE n < 100""")
def _(spark, sf):
    return E.ingest(signed_documents(spark, sf), interval=2, cap=100).select("capture_id", "frame_index", "frame_id")


@query("e1_scene_ingest")
def _(spark, sf):
    measured = E.with_measures(frames(spark, sf)).select("capture_id", "frame_index", "signature", "mean_intensity", "thumb")
    return E.ingest(measured, mode="scene_change", threshold=0.12, cap=250).select("capture_id", "frame_index", "frame_id")


@query("e2_blinded_run")
def _(spark, sf):
    # The samples get their blind ids once and are read by every feature after that.
    samples = cut(E.blinded_samples(frames(spark, sf), SEED, calibration=(64, 64)))
    results = E.blinded_run(samples, "baseline")
    return B.seal(results, samples.select("blind_id", "unblinded_label"), E.FEATURES).drop("candidate_rois")


@query("e3_unblind_compare", f"""{FRAME_SCORES}, {EMPIRICAL}, {STEP_UP}, {COHEN}, {permutation_sql(SEED)},
base AS (SELECT count(*) AS sample_count, count(*) FILTER (WHERE role = 'laser') AS laser_count, count(*) FILTER (WHERE role = 'control') AS control_count,
  count(*) FILTER (WHERE role = 'calibration') AS synthetic_positive_count, coalesce(max(score) FILTER (WHERE role = 'calibration') > 0.05, false) AS calibration_passed,
  round(avg(score) FILTER (WHERE role = 'laser'), 6) AS laser_mean_score, round(avg(score) FILTER (WHERE role = 'control'), 6) AS control_mean_score,
  round(avg(score) FILTER (WHERE role = 'calibration'), 6) AS synthetic_positive_mean_score, round(avg(persistence) FILTER (WHERE role = 'laser'), 6) AS laser_mean_persistence,
  round(avg(score) FILTER (WHERE role = 'laser') - 1.96 * stddev_pop(score) FILTER (WHERE role = 'laser') / sqrt(count(*) FILTER (WHERE role = 'laser')), 6) AS laser_ci_low,
  round(avg(score) FILTER (WHERE role = 'control') + 1.96 * stddev_pop(score) FILTER (WHERE role = 'control') / sqrt(count(*) FILTER (WHERE role = 'control')), 6) AS control_ci_high
  FROM scores),
all_stats AS (SELECT b.*, round(laser_mean_score - control_mean_score, 6) AS mean_difference, e.cohen_d, CAST(p.permutation_p_value AS DOUBLE) AS permutation_p_value,
  (SELECT min(q_value) FROM qvalues) AS minimum_q_value FROM base b, effect e, permuted p),
levels_read AS (SELECT *, {LADDER.replace('difference', 'mean_difference').replace('persistence', 'laser_mean_persistence').replace('p IS NULL OR d IS NULL', 'permutation_p_value IS NULL OR cohen_d IS NULL').replace('p <=', 'permutation_p_value <=').replace('d >=', 'cohen_d >=')} AS ladder FROM all_stats)
SELECT * EXCLUDE ladder, ladder AS evidence_ladder, {MEANS} AS interpretation FROM levels_read""")
def _(spark, sf):
    # Flagship: score, blind and seal all frames, then reveal and compare.
    scored = cut(frame_results(spark, sf).withColumn("structure_score", F.col("primary_metric_score")))
    blinded = cut(B.assign_blind_ids(scored.select("sample_id", "capture_id", "frame_index", "unblinded_label"), SEED))
    seal_map = blinded.select("blind_id", "sample_id", "capture_id", "frame_index", "unblinded_label")
    digest = B.digest(seal_map).first()["digest"]
    results = scored.join(seal_map.select("blind_id", "sample_id"), "sample_id")
    sealed, calibration = B.seal(results, seal_map), B.calibration_results(results, seal_map)
    out = E.unblind_compare(sealed, seal_map, calibration, digest, SEED, metric="speckle_contrast")
    return out.drop("laser_ci_high", "laser_ci_count", "control_ci_low", "control_ci_count", "primary_metric", "fdr_method", "null_result_language")


@query("q4_report", f"""{FRAME_SCORES}, {EMPIRICAL}, {STEP_UP}, top AS (
  SELECT q.sample_id, round(q.score, 6) AS score, q.q_value, q.unblinded_label, row_number() OVER (ORDER BY q.score DESC, q.sample_id) AS rank FROM qvalues q WHERE role <> 'calibration')
SELECT rank, sample_id, score, q_value, unblinded_label FROM top WHERE rank <= 20""")
def _(spark, sf):
    scored = cut(frame_results(spark, sf))
    q = S.bh_q(S.empirical_p(S.sample_scores(scored)))
    shown = S.attach_q(scored, q).filter(F.col("unblinded_label") != B.CALIBRATION).withColumn("ordinal", F.lit(0))
    best = X.best_variant(shown)
    top = R.top_candidates(best, [F.desc("primary_metric_score"), F.col("sample_id")], 20)
    return top.select("rank", "sample_id", F.col("primary_metric_score").alias("score"), "q_value", "unblinded_label")
