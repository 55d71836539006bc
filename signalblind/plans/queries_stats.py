"""Queries over results: statistics, blinding, review, reports (S, B, J, K, P, Q, R, U, M, F4-F8, IO8-9)."""

from pyspark.sql import Window, functions as F

from ..functions import columns as C
from ..functions.columns import round6
from ..operators import blinding as B, crossframe as X, detectors as D, review as R, stats as S
from ..session import cut
from ..sources import sinks
from ..sources.tables import frames, results, table
from .queries_detectors import BEST, SPECKLE, TIES, W1
from .registry import EMPIRICAL, FRAMES, PACKED, RESULTS, SCORES, STEP_UP, hash_tree_sql, permutation_sql, query, scores_sql

NAMES = {"score": "score", "persistence": "persistence"}
SEED = 7


def line_scores(spark, sf):
    return S.sample_scores(results(spark, sf), **NAMES)


def kept_scores(spark, sf):
    """The same, written out once for statistics that read it several times."""
    return cut(line_scores(spark, sf))


# --- statistics --------------------------------------------------------------------------


@query("s1_sample_scores", f"WITH {SCORES} SELECT sample_id, unblinded_label, variants, round(score, 6) AS score, round(persistence, 6) AS persistence, role FROM scores")
def _(spark, sf):
    return line_scores(spark, sf).withColumns({"score": round6(F.col("score")), "persistence": round6(F.col("persistence"))})


FRAME_RESULTS = f"""{W1}, {SPECKLE}, frame_results AS (
  SELECT p.frame_id AS sample_id, p.capture_id, c.role AS unblinded_label, 1 AS variant,
         round(least(1.0, s.contrast_mean * 2), 6) AS score, p.persistence_score AS persistence
  FROM persist p JOIN speckles s USING (frame_id) JOIN packed c USING (frame_id))"""
FRAME_SCORES = f"WITH {PACKED}, {FRAME_RESULTS}, {scores_sql('frame_results')}"


def frame_results(spark, sf):
    """Frames scored by local contrast, with persistence over their capture."""
    f = frames(spark, sf)
    contrast = D.speckle(f, ["frame_id"]).select("frame_id", "contrast_mean")
    persistence = X.persistence(f, ["capture_id"], [F.col("frame_index")], "frame_id").drop("capture_id")
    base = f.select("frame_id", "capture_id", "frame_index", F.col("role").alias("unblinded_label"))
    return base.join(contrast, "frame_id").join(persistence, "frame_id").select(
        F.col("frame_id").alias("sample_id"), "capture_id", "frame_index", "unblinded_label",
        C.primary_score("speckle_contrast", F.lit(0.0), F.col("contrast_mean"), F.lit(0.0), F.lit(0.0)).alias("primary_metric_score"),
        "persistence_score")


@query("s2_role_means", f"""{FRAME_SCORES} SELECT count(*) AS sample_count, count(*) FILTER (WHERE role = 'laser') AS laser_count,
  count(*) FILTER (WHERE role = 'control') AS control_count, count(*) FILTER (WHERE role = 'calibration') AS synthetic_positive_count,
  round(avg(score) FILTER (WHERE role = 'laser'), 6) AS laser_mean_score, round(avg(score) FILTER (WHERE role = 'control'), 6) AS control_mean_score,
  round(avg(score) FILTER (WHERE role = 'calibration'), 6) AS synthetic_positive_mean_score FROM scores""")
def _(spark, sf):
    return S.role_means(S.sample_scores(frame_results(spark, sf))).drop("laser_mean_persistence", "calibration_passed")


@query("s2_role_means_by_flag", f"""WITH {RESULTS}, f AS (SELECT r.*, l_linenumber_mod FROM (SELECT *, sample_id % 7 AS l_linenumber_mod FROM results) r),
{scores_sql('f')}, g AS (SELECT *, sample_id % 7 AS experiment FROM scores)
SELECT experiment, count(*) AS sample_count, count(*) FILTER (WHERE role = 'laser') AS laser_count, round(avg(score) FILTER (WHERE role = 'laser'), 6) AS laser_mean_score,
  round(avg(score) FILTER (WHERE role = 'control'), 6) AS control_mean_score FROM g GROUP BY experiment""")
def _(spark, sf):
    many = results(spark, sf).withColumn("experiment", F.col("sample_id") % 7)
    out = S.role_means(S.sample_scores(many, ["experiment"], **NAMES), ["experiment"])
    return out.select("experiment", "sample_count", "laser_count", "laser_mean_score", "control_mean_score")


COHEN = """effect AS (SELECT CASE WHEN na >= 2 AND nb >= 2 THEN CASE WHEN pooled < 1e-12 THEN 0.0::DOUBLE ELSE round((ma - mb) / pooled, 6) END END AS cohen_d
  FROM (SELECT count(*) FILTER (WHERE role = 'laser') AS na, count(*) FILTER (WHERE role = 'control') AS nb, avg(score) FILTER (WHERE role = 'laser') AS ma,
    avg(score) FILTER (WHERE role = 'control') AS mb, sqrt((pow(stddev_pop(score) FILTER (WHERE role = 'laser'), 2) + pow(stddev_pop(score) FILTER (WHERE role = 'control'), 2)) / 2) AS pooled FROM scores))"""


@query("s3_cohen_d", f"WITH {SCORES}, {COHEN} SELECT cohen_d FROM effect")
def _(spark, sf):
    return S.cohen_d(line_scores(spark, sf))


@query("s4_empirical_p", f"WITH {SCORES}, {EMPIRICAL} SELECT sample_id, role, p_value FROM empirical")
def _(spark, sf):
    return S.empirical_p(kept_scores(spark, sf)).select("sample_id", "role", "p_value")


@query("s5_bh_q_values", f"WITH {SCORES}, {EMPIRICAL}, {STEP_UP} SELECT sample_id, p_value, q_value FROM qvalues")
def _(spark, sf):
    return S.bh_q(S.empirical_p(kept_scores(spark, sf))).select("sample_id", "p_value", "q_value")


@query("s6_permutation_p", f"{FRAME_SCORES}, {permutation_sql(SEED)} SELECT CAST(permutation_p_value AS DOUBLE) AS permutation_p_value FROM permuted")
def _(spark, sf):
    return S.permutation_p(cut(S.sample_scores(frame_results(spark, sf))), SEED)


@query("s7_mean_ci", f"""WITH {SCORES} SELECT role, count(*) AS count, round(avg(score), 6) AS mean, round(avg(score) - 1.96 * stddev_pop(score) / sqrt(count(*)), 6) AS low,
  round(avg(score) + 1.96 * stddev_pop(score) / sqrt(count(*)), 6) AS high FROM scores GROUP BY role""")
def _(spark, sf):
    return S.mean_ci(line_scores(spark, sf), "score", ["role"])


@query("s8_family_statistics", f"""WITH {RESULTS}, long AS (SELECT family, value FROM (SELECT * FROM results WHERE unblinded_label = 'laser')
  UNPIVOT (value FOR family IN (symbol, diffraction, speckle, texture)))
SELECT family, count(*) AS count, round(avg(value), 6) AS mean, round(avg(value) - 1.96 * stddev_pop(value) / sqrt(count(*)), 6) AS low,
  round(avg(value) + 1.96 * stddev_pop(value) / sqrt(count(*)), 6) AS high FROM long GROUP BY family""")
def _(spark, sf):
    return S.family_statistics(results(spark, sf))


@query("s9_mean_persistence", f"{FRAME_SCORES} SELECT round(avg(persistence) FILTER (WHERE role = 'laser'), 6) AS laser_mean_persistence FROM scores")
def _(spark, sf):
    return S.role_means(S.sample_scores(frame_results(spark, sf))).select("laser_mean_persistence")


@query("s10_calibration_gate", f"{FRAME_SCORES} SELECT coalesce(max(score) FILTER (WHERE role = 'calibration') > 0.05, false) AS calibration_passed FROM scores")
def _(spark, sf):
    return S.role_means(S.sample_scores(frame_results(spark, sf))).select("calibration_passed")


LADDER = """CASE WHEN coalesce(laser_count, 0) = 0 OR coalesce(control_count, 0) = 0 THEN 'no signal' WHEN coalesce(difference, 0) <= 0.02 THEN 'no signal'
  WHEN p IS NULL OR d IS NULL THEN 'anomaly' WHEN p <= 0.05 AND d >= 0.5 AND coalesce(persistence, 0) >= 0.15 THEN 'repeatable candidate'
  WHEN p <= 0.05 AND d >= 0.5 THEN 'above-control candidate' WHEN difference > 0.05 THEN 'anomaly' ELSE 'artifact' END"""

# Line items read as the statistics of many small experiments.
EXPERIMENTS = """experiments AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber - 1 AS laser_count, l_suppkey AS control_count, l_discount AS difference,
  CASE WHEN l_linenumber < 6 THEN l_tax END AS p, l_quantity / 50 AS d, l_extendedprice / 100000 AS persistence FROM lineitem)"""


def experiments(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        C.evidence_ladder(F.col("l_linenumber") - 1, F.col("l_suppkey"), F.col("l_discount"),
                          F.when(F.col("l_linenumber") < 6, F.col("l_tax")), F.col("l_quantity") / 50,
                          F.col("l_extendedprice") / 100000).alias("evidence_ladder"))


@query("s11_evidence_ladder", f"WITH {EXPERIMENTS} SELECT l_orderkey, l_linenumber, l_partkey, {LADDER} AS evidence_ladder FROM experiments")
def _(spark, sf):
    return experiments(spark, sf)


MEANS = """CASE WHEN ladder IN ('above-control candidate', 'repeatable candidate') THEN 'The selected protocol found laser-frame scores above matched controls under this run''s thresholds.'
  WHEN ladder = 'anomaly' THEN 'The run found elevated structure, but not enough to clear the controlled evidence threshold.'
  ELSE 'The selected capture and detector set did not beat matched controls.' END"""
NULL_TEXT = """CASE WHEN ladder IN ('above-control candidate', 'repeatable candidate') THEN 'This run found structure scores above matched controls. Treat this as a candidate finding until it repeats across new blinded captures.'
  WHEN ladder = 'anomaly' THEN 'This run found elevated structure scores, but the evidence did not clear the configured blinded control threshold.'
  ELSE 'This run did not find structured detections above matched controls. That does not prove absence of signal; it means this capture and detector set did not beat the null.' END"""


@query("s12_interpretation", f"WITH {EXPERIMENTS}, l AS (SELECT {LADDER} AS ladder FROM experiments) SELECT ladder AS evidence_ladder, {MEANS} AS interpretation, {NULL_TEXT} AS null_result_language, count(*) AS experiments FROM l GROUP BY ladder")
def _(spark, sf):
    level = F.col("evidence_ladder")
    return experiments(spark, sf).groupBy(level).agg(F.count(F.lit(1)).alias("experiments")).select(
        level, C.interpretation(level).alias("interpretation"), C.null_result_language(level).alias("null_result_language"), "experiments")


@query("s13_blinded_summary", f"""{FRAME_SCORES} SELECT count(*) FILTER (WHERE role <> 'calibration') AS sample_count, CAST(NULL AS BIGINT) AS laser_count,
  count(*) FILTER (WHERE role = 'calibration') AS synthetic_positive_count, coalesce(max(score) FILTER (WHERE role = 'calibration') > 0.05, false) AS calibration_passed,
  CAST(NULL AS DOUBLE) AS cohen_d, 'deferred_until_unblind' AS fdr_method, 'blinded review' AS evidence_ladder FROM scores""")
def _(spark, sf):
    return S.summarize_blinded(frame_results(spark, sf)).select(
        "sample_count", "laser_count", "synthetic_positive_count", "calibration_passed", "cohen_d", "fdr_method", "evidence_ladder")


@query("s14_run_estimate", f"""WITH {FRAMES}, sized AS (SELECT capture_id, count(*) + 3 * count(*) FILTER (WHERE role = 'laser') + 1 AS sample_count FROM frames GROUP BY 1)
SELECT capture_id, sample_count, CAST(19 AS BIGINT) AS preprocessing_variants, sample_count * 19 AS detector_records,
  CASE WHEN sample_count * 19 < 250 THEN 'short' WHEN sample_count * 19 < 2000 THEN 'medium' ELSE 'long' END AS runtime_label FROM sized""")
def _(spark, sf):
    return S.estimate(frames(spark, sf), 19, "standard", ["capture_id"])


# --- captures, provenance, quality -------------------------------------------------------

CAPTURES = """captures AS (SELECT c_custkey AS capture_id, c_nationkey AS source_id, CASE WHEN c_custkey % 2 = 0 THEN 'video' ELSE 'image-set' END AS kind,
  CASE c_custkey % 6 WHEN 0 THEN 'laser' WHEN 1 THEN 'control' WHEN 2 THEN 'matched_control' WHEN 3 THEN 'sensor_noise' WHEN 4 THEN 'synthetic_positive' ELSE 'synthetic_negative' END AS role,
  CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS camera, CASE WHEN c_custkey % 5 > 0 THEN '1/60' ELSE '' END AS exposure, CASE WHEN c_custkey % 7 > 0 THEN 'manual' END AS focus_mode,
  CASE WHEN c_custkey % 3 > 0 THEN 'none' END AS compression_history, CASE WHEN c_custkey % 11 = 0 THEN 'false' WHEN c_custkey % 11 < 5 THEN 'true' END AS camera_fixed,
  CASE WHEN c_custkey % 13 = 0 THEN 'true' END AS saturated, CASE WHEN c_custkey % 17 > 0 THEN 320 END AS width, CASE WHEN c_custkey % 19 > 0 THEN 180 ELSE 0 END AS height,
  CAST(CASE WHEN c_custkey % 4 > 0 THEN 30 ELSE 0 END AS DOUBLE) AS fps FROM customer)"""
WARNINGS = """warned AS (SELECT *, list_filter([CASE WHEN coalesce(camera, '') = '' THEN 'missing_camera' END, CASE WHEN coalesce(exposure, '') = '' THEN 'missing_exposure' END,
  CASE WHEN coalesce(focus_mode, '') = '' THEN 'missing_focus_mode' END, CASE WHEN coalesce(compression_history, '') = '' THEN 'missing_compression_history' END,
  CASE WHEN coalesce(width, 0) = 0 OR coalesce(height, 0) = 0 THEN 'unknown_resolution' END, CASE WHEN kind = 'video' AND coalesce(fps, 0) = 0 THEN 'unknown_fps' END,
  CASE WHEN camera_fixed = 'false' THEN 'camera_not_fixed' END, CASE WHEN saturated = 'true' THEN 'capture_saturated' END], lambda w: w IS NOT NULL) AS codes FROM captures)"""


def captures(spark, sf):
    """Customers as captures with recorded metadata, some of it missing."""
    k = F.col("c_custkey")
    roles = F.array(*[F.lit(r) for r in C.CAPTURE_ROLES])
    return table(spark, sf, "customer").select(
        k.alias("capture_id"), F.col("c_nationkey").alias("source_id"), F.when(k % 2 == 0, "video").otherwise("image-set").alias("kind"),
        F.element_at(roles, (k % 6 + 1).cast("int")).alias("role_unsorted"),
        F.when(k % 6 == 0, "laser").when(k % 6 == 1, "control").when(k % 6 == 2, "matched_control").when(k % 6 == 3, "sensor_noise")
        .when(k % 6 == 4, "synthetic_positive").otherwise("synthetic_negative").alias("role"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("camera"), F.when(k % 5 > 0, "1/60").otherwise("").alias("exposure"),
        F.when(k % 7 > 0, "manual").alias("focus_mode"), F.when(k % 3 > 0, "none").alias("compression_history"),
        F.when(k % 11 == 0, "false").when(k % 11 < 5, "true").alias("camera_fixed"), F.when(k % 13 == 0, "true").alias("saturated"),
        F.when(k % 17 > 0, 320).alias("width"), F.when(k % 19 > 0, 180).otherwise(0).alias("height"),
        F.when(k % 4 > 0, 30.0).otherwise(0.0).alias("fps"),
    ).drop("role_unsorted").withColumn("warnings", R.provenance_warnings(
        lambda f: F.col(f), F.col("width"), F.col("height"), F.col("kind"), F.col("fps")))


@query("p1_provenance_warnings", f"WITH {CAPTURES}, {WARNINGS} SELECT capture_id, array_to_string(codes, ',') AS codes FROM warned")
def _(spark, sf):
    return captures(spark, sf).select("capture_id", F.concat_ws(",", F.transform("warnings", lambda w: w["code"])).alias("codes"))


@query("s15_warning_counts", f"WITH {CAPTURES}, {WARNINGS} SELECT source_id, CAST(sum(len(codes)) AS BIGINT) AS warning_count FROM warned GROUP BY source_id")
def _(spark, sf):
    return S.warning_count(captures(spark, sf), ["source_id"])


@query("p2_media_summary", """WITH files AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, url || '#' || page_id AS path,
  CASE page_id % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' ELSE 'tif' END AS format, CAST(length(html) AS INTEGER) AS width, CAST(length(url) AS INTEGER) AS height FROM pages)
SELECT host, count(*) AS image_count, string_agg(DISTINCT format, ',' ORDER BY format) AS formats, arg_min(width, path) AS width, arg_min(height, path) AS height FROM files GROUP BY host""")
def _(spark, sf):
    formats = F.array(F.lit("png"), F.lit("jpg"), F.lit("tif"))
    files = table(spark, sf, "pages").select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.concat_ws("#", "url", "page_id").alias("path"),
        F.element_at(formats, (F.col("page_id") % 3 + 1).cast("int")).alias("format"), F.length("html").alias("width"), F.length("url").alias("height"))
    return R.media_summary(files, ["host"]).withColumn("formats", F.concat_ws(",", "formats"))


@query("p2_media_duration", """SELECT event_id, CASE WHEN user_id > 0 AND event_id % 4 > 0 THEN CAST(floor(user_id / CAST(event_id % 4 * 10 AS DOUBLE) * 1000) AS BIGINT) END AS duration_ms FROM events""")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", R.duration_ms(F.col("user_id"), (F.col("event_id") % 4 * 10).cast("double")).alias("duration_ms"))


PROVENANCE = """tagged AS (SELECT doc_id, source AS capture_id, lang, CASE WHEN n_chars > 500 THEN n_chars END AS n_chars,
  CASE WHEN source IN ('src1', 'src3', 'src5') THEN 'fixture-' || source END AS fixture_id FROM documents),
rolled AS (SELECT coalesce(capture_id, fixture_id) AS source_key, arg_max(lang, doc_id) AS lang, arg_max(n_chars, doc_id) FILTER (WHERE n_chars IS NOT NULL) AS n_chars,
  arg_max(fixture_id, doc_id) FILTER (WHERE fixture_id IS NOT NULL) AS fixture_id FROM tagged GROUP BY 1)"""


def provenance(spark, sf):
    source = F.col("source")
    samples = table(spark, sf, "documents").select(
        "doc_id", source.alias("capture_id"), "lang", F.when(F.col("n_chars") > 500, F.col("n_chars")).alias("n_chars"),
        F.when(source.isin("src1", "src3", "src5"), F.concat(F.lit("fixture-"), source)).alias("fixture_id"))
    return R.source_provenance(samples, "doc_id", ["lang", "n_chars", "fixture_id"])


@query("p3_source_provenance", f"WITH {PROVENANCE} SELECT source_key, lang, n_chars, fixture_id FROM rolled")
def _(spark, sf):
    return provenance(spark, sf).select("source_key", "lang", "n_chars", "fixture_id")


@query("k5_provenance_order", f"""WITH {PROVENANCE} SELECT source_key, row_number() OVER (ORDER BY CASE WHEN fixture_id IS NULL THEN 1 ELSE 0 END, coalesce(fixture_id, source_key)) AS rank FROM rolled""")
def _(spark, sf):
    from ..operators.ordering import global_rank

    keyed = provenance(spark, sf).select("source_key", F.coalesce("fixture_id", "source_key").alias("key"), F.col("fixture_id").isNull().alias("own"))
    return global_rank(keyed, [F.col("own"), F.col("key")]).select("source_key", "rank")


@query("q1_report_badges", """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN u THEN 'multiple comparisons corrected' ELSE 'review blinded' END,
  CASE WHEN u THEN 'review unblinded' ELSE 'source roles sealed' END, CASE WHEN k % 3 = 0 THEN 'calibration passed' WHEN k % 3 = 1 THEN 'calibration failed' END,
  CASE WHEN u AND k % 5 > 0 THEN 'controls matched' END, CASE WHEN k % 7 > 0 THEN 'OCR unavailable' END,
  CASE WHEN k % 4 = 0 THEN 'provenance complete' ELSE 'provenance warnings: ' || (k % 4) END, CASE WHEN k % 6 = 0 THEN 'blind review complete' END, 'media not included'],
  lambda b: b IS NOT NULL), '|') AS badges FROM (SELECT o_orderkey, o_orderkey AS k, o_orderkey % 2 = 0 AS u FROM orders)""")
def _(spark, sf):
    k = F.col("o_orderkey")
    listed = R.badges(k % 2 == 0, k % 3 == 0, F.when(k % 3 < 2, 1).otherwise(0), k % 5, k % 7 == 0, k % 4, k % 6 == 0)
    return table(spark, sf, "orders").select("o_orderkey", F.concat_ws("|", listed).alias("badges"))


READY = """per AS (SELECT source_id, list(DISTINCT role) AS roles, sum(len(codes)) AS warnings, count(*) AS n FROM warned GROUP BY source_id)"""


@query("q2_readiness", f"""WITH {CAPTURES}, {WARNINGS}, {READY}
SELECT source_id, 'laser capture' AS "check", list_contains(roles, 'laser') AS ok FROM per UNION ALL
SELECT source_id, 'control capture', len(list_intersect(roles, ['control', 'matched_control', 'sensor_noise', 'synthetic_negative'])) > 0 FROM per UNION ALL
SELECT source_id, 'frame count >= 2', n >= 2 FROM per UNION ALL SELECT source_id, 'matched controls enabled', true FROM per UNION ALL
SELECT source_id, 'capture provenance complete', warnings = 0 FROM per UNION ALL SELECT source_id, 'multiple comparisons corrected', true FROM per""")
def _(spark, sf):
    caps = captures(spark, sf).withColumn("warning_count", F.size("warnings"))
    return R.readiness(caps, F.count(F.lit(1)), "standard", ["source_id"])


@query("u4_control_roles", f"""WITH {CAPTURES}, per AS (SELECT source_id, list_sort(list_intersect(list(DISTINCT role), ['control', 'matched_control', 'sensor_noise', 'synthetic_negative'])) AS r FROM captures GROUP BY 1)
SELECT source_id, array_to_string(r, ',') AS roles FROM per""")
def _(spark, sf):
    wanted = F.array(*[F.lit(r) for r in C.CONTROL_ROLES])
    return captures(spark, sf).groupBy("source_id").agg(
        F.concat_ws(",", F.array_sort(F.array_intersect(F.collect_set("role"), wanted))).alias("roles"))


CATALOG = """catalog AS (SELECT 'fx-' || (p_partkey // 2 * 2 + CASE WHEN p_partkey % 10 = 1 THEN 0 ELSE p_partkey % 2 END) AS id, p_name AS title, p_type AS kind,
  CASE WHEN p_size % 4 > 0 THEN 'laser' END AS label, CASE WHEN p_size % 5 > 0 THEN p_brand ELSE '' END AS license, p_brand AS attribution,
  CASE WHEN p_size % 9 > 0 THEN 'https://example.org' END AS source_page, p_type AS phenomena, p_name AS expected_behavior, p_name AS limitations,
  p_size % 2 = 0 AS redistributable, CASE WHEN p_size % 3 > 0 THEN 'file-' || (p_partkey % 150) END AS filename FROM part),
lacking AS (SELECT id, list_filter([CASE WHEN label IS NULL THEN 'label' END, CASE WHEN license = '' THEN 'license' END,
  CASE WHEN source_page IS NULL THEN 'source_page' END], lambda f: f IS NOT NULL) AS m, redistributable, filename FROM catalog)"""


def catalog(spark, sf):
    """Parts as a fixture catalog with gaps, repeated ids and missing files."""
    k, size = F.col("p_partkey"), F.col("p_size")
    number = F.floor(k / 2) * 2 + F.when(k % 10 == 1, 0).otherwise(k % 2)
    return table(spark, sf, "part").select(
        F.concat(F.lit("fx-"), number).alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("kind"),
        F.when(size % 4 > 0, "laser").alias("label"), F.when(size % 5 > 0, F.col("p_brand")).otherwise("").alias("license"),
        F.col("p_brand").alias("attribution"), F.when(size % 9 > 0, "https://example.org").alias("source_page"),
        F.col("p_type").alias("phenomena"), F.col("p_name").alias("expected_behavior"), F.col("p_name").alias("limitations"),
        (size % 2 == 0).alias("redistributable"), F.when(size % 3 > 0, F.concat(F.lit("file-"), k % 150)).alias("filename"))


@query("u3_missing_fields", f"WITH {CATALOG} SELECT id, array_to_string(m, ', ') AS missing FROM lacking WHERE len(m) > 0")
def _(spark, sf):
    missing = R.missing_fields({f: F.col(f) for f in R.REQUIRED_CATALOG_FIELDS})
    return catalog(spark, sf).select("id", missing.alias("m")).filter(F.size("m") > 0).select("id", F.concat_ws(", ", "m").alias("missing"))


@query("q3_catalog_problems", f"""WITH {CATALOG}, files AS (SELECT DISTINCT 'file-' || (s_suppkey % 150) AS filename FROM supplier)
SELECT id, 'missing ' || array_to_string(m, ', ') AS problem FROM lacking WHERE len(m) > 0
UNION ALL SELECT id, 'duplicate fixture id' FROM catalog GROUP BY id HAVING count(*) > 1
UNION ALL SELECT id, 'redistributable fixture has no filename' FROM catalog WHERE redistributable AND filename IS NULL
UNION ALL SELECT id, 'bundled media file is missing' FROM catalog WHERE redistributable AND (filename IS NULL OR filename NOT IN (SELECT filename FROM files))""")
def _(spark, sf):
    files = table(spark, sf, "supplier").select(F.concat(F.lit("file-"), F.col("s_suppkey") % 150).alias("filename"))
    return R.validate_catalog(catalog(spark, sf), files)


@query("j9_requested_ids", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def _(spark, sf):
    wanted = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").join(wanted, "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("j6_frame_capture_join", "SELECT o_orderkey AS frame_id, c_custkey AS capture_id, c_mktsegment AS label, n_name AS site FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def _(spark, sf):
    cust, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    return table(spark, sf, "orders").join(cust, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("o_orderkey").alias("frame_id"), F.col("c_custkey").alias("capture_id"), F.col("c_mktsegment").alias("label"), F.col("n_name").alias("site"))


@query("j8_control_counts", f"""WITH {SCORES}, {EMPIRICAL} SELECT DISTINCT sv, CAST(ge AS BIGINT) AS controls_at_or_above FROM above""")
def _(spark, sf):
    from ..operators.ordering import running_sum

    keyed = kept_scores(spark, sf).withColumn("sv", C.micros(F.col("score") * 1000))
    levels = keyed.groupBy("sv").agg(F.count(F.when(F.col("role") == "control", 1)).alias("c"))
    return running_sum(levels, [], [F.desc("sv")], F.floor(-F.col("sv") / 1e6), "c", "controls_at_or_above").select("sv", "controls_at_or_above")


@query("m1_protocol_lookup", """WITH presets(protocol, profile, primary_metric, detector_family) AS (VALUES ('diffraction', 'wide', 'fft_peak_prominence', 'diffraction'),
  ('speckle', 'wide', 'speckle_contrast', 'speckle'), ('ocr', 'baseline', 'ocr_symbol_score', 'symbol'), ('anomaly', 'wide', 'structure_score', 'anomaly')),
wanted AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'diffraction' WHEN 1 THEN 'speckle' WHEN 2 THEN 'ocr' WHEN 3 THEN 'anomaly' END AS w FROM orders)
SELECT o_orderkey, protocol, profile, primary_metric, detector_family FROM wanted JOIN presets ON protocol = coalesce(w, 'anomaly')""")
def _(spark, sf):
    k = F.col("o_orderkey") % 5
    asked = table(spark, sf, "orders").select("o_orderkey", F.when(k == 0, "diffraction").when(k == 1, "speckle").when(k == 2, "ocr").when(k == 3, "anomaly").alias("protocol"))
    return R.with_protocol(asked, R.protocols(spark)).select("o_orderkey", "protocol", "profile", "primary_metric", "detector_family")


@query("m2_schema_backfill", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE 'unknown' END AS camera, 'anomaly' AS protocol, false AS include_media FROM customer")
def _(spark, sf):
    old = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("camera"))
    return R.backfill(old, {"camera": "unknown", "protocol": "anomaly", "include_media": False})


# --- blinding ----------------------------------------------------------------------------

SAMPLES = """samples AS (SELECT o_orderkey AS sample_id, o_custkey AS capture_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'laser' WHEN '2-HIGH' THEN 'control'
  WHEN '3-MEDIUM' THEN 'matched_control' WHEN '4-NOT SPECIFIED' THEN 'sensor_noise' ELSE 'synthetic_positive' END AS unblinded_label FROM orders),
blinded AS (SELECT *, format('B{:06d}', row_number() OVER (ORDER BY md5('7:' || sample_id), sample_id)) AS blind_id FROM samples),
run AS (SELECT b.blind_id, b.sample_id, b.unblinded_label, l_linenumber AS preprocessing_variant, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate,
    round(l_discount * 10, 6) AS structure_score, round(l_tax * 10, 6) AS persistence_score FROM blinded b JOIN lineitem ON l_orderkey = b.sample_id)"""


def order_samples(spark, sf):
    p = F.col("o_orderpriority")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("capture_id"),
        F.when(p == "1-URGENT", "laser").when(p == "2-HIGH", "control").when(p == "3-MEDIUM", "matched_control")
        .when(p == "4-NOT SPECIFIED", "sensor_noise").otherwise("synthetic_positive").alias("unblinded_label"))


def seal_map(spark, sf):
    return B.assign_blind_ids(order_samples(spark, sf), SEED).select("blind_id", "sample_id", "capture_id", "unblinded_label")


def stored_map(spark, sf):
    """The seal map written out, for what numbers the samples once and reads the map several times."""
    return cut(seal_map(spark, sf))


def run_results(spark, sf, mapped):
    """Detector records of the blinded order samples of a seal map, attribution still attached."""
    li = table(spark, sf, "lineitem")
    return li.join(mapped, F.col("l_orderkey") == F.col("sample_id")).select(
        "blind_id", "sample_id", "unblinded_label", F.col("l_linenumber").alias("preprocessing_variant"), F.col("l_partkey").alias("source_path"),
        F.round(F.col("l_discount") * 10, 6).alias("structure_score"), F.round(F.col("l_tax") * 10, 6).alias("persistence_score"))


@query("b1_blind_ids", f"WITH {SAMPLES} SELECT sample_id, blind_id FROM blinded")
def _(spark, sf):
    return seal_map(spark, sf).select("sample_id", "blind_id")


SEALED = """sealed AS (SELECT blind_id, preprocessing_variant, structure_score, persistence_score, blind_id AS sample_id, CAST(NULL AS DOUBLE) AS q_value
  FROM run WHERE unblinded_label <> 'synthetic_positive')"""


@query("f5_seal_projection", f"WITH {SAMPLES}, {SEALED} SELECT * FROM sealed")
def _(spark, sf):
    mapped = stored_map(spark, sf)
    return B.seal(run_results(spark, sf, mapped), mapped)


@query("j3_seal_anti_filter", f"WITH {SAMPLES} SELECT blind_id, count(*) AS records FROM run WHERE unblinded_label <> 'synthetic_positive' GROUP BY 1")
def _(spark, sf):
    mapped = stored_map(spark, sf)
    return B.seal(run_results(spark, sf, mapped), mapped).groupBy("blind_id").agg(F.count(F.lit(1)).alias("records"))


@query("f6_seal_captures", f"WITH {CAPTURES} SELECT capture_id, source_id, kind, count(o_orderkey) AS frame_count, true AS sealed FROM captures JOIN orders ON o_custkey = capture_id GROUP BY ALL")
def _(spark, sf):
    caps = captures(spark, sf).select("capture_id", "source_id", "kind")
    shots = table(spark, sf, "orders").select(F.col("o_custkey").alias("capture_id"))
    return B.seal_captures(shots.join(caps, "capture_id"))


@query("f8_role_mapping", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'laser' WHEN '5-LOW' THEN 'calibration' ELSE 'control' END AS role FROM orders""")
def _(spark, sf):
    return order_samples(spark, sf).select(F.col("sample_id").alias("o_orderkey"), C.statistical_role(F.col("unblinded_label")).alias("role"))


@query("j2_unblind_join", f"WITH {SAMPLES} SELECT blind_id, sample_id, capture_id, unblinded_label, count(*) AS records FROM blinded JOIN lineitem ON l_orderkey = sample_id WHERE unblinded_label <> 'synthetic_positive' GROUP BY ALL")
def _(spark, sf):
    mapped = stored_map(spark, sf)
    restored = B.restore(B.seal(run_results(spark, sf, mapped), mapped), mapped)
    return restored.groupBy("blind_id", "sample_id", "capture_id", "unblinded_label").agg(F.count(F.lit(1)).alias("records"))


def digest_sql(source, label):
    rows = f"""SELECT 0 AS all_rows, sha256('{{"blind_id":"' || blind_id || '","capture_id":' || capture_id || ',"sample_id":' || sample_id || ',"unblinded_label":"' || {label} || '"}}') AS h FROM {source}"""
    return f"(WITH {hash_tree_sql(rows)} SELECT digest FROM l0)"


@query("b2_seal_digest", f"WITH {SAMPLES} SELECT {digest_sql('blinded', 'unblinded_label')} AS digest")
def _(spark, sf):
    return B.digest(seal_map(spark, sf))


@query("b3_integrity_check", f"""WITH {SAMPLES}, both_digests AS (SELECT {digest_sql('blinded', 'unblinded_label')} AS a,
  {digest_sql('blinded', "CASE WHEN blind_id = 'B000001' THEN 'tampered' ELSE unblinded_label END")} AS b) SELECT a AS sealed, b AS tampered, a = b AS intact FROM both_digests""")
def _(spark, sf):
    mapped = stored_map(spark, sf)
    changed = mapped.withColumn("unblinded_label", F.when(F.col("blind_id") == "B000001", "tampered").otherwise(F.col("unblinded_label")))
    out = B.digest(mapped).withColumn("tampered", B.digest(changed).scalar())
    return out.select(F.col("digest").alias("sealed"), "tampered", (F.col("digest") == F.col("tampered")).alias("intact"))


@query("b4_unblind", f"WITH {SAMPLES} SELECT unblinded_label, count(*) AS records, count(DISTINCT sample_id) AS samples, round(avg(structure_score), 6) AS mean_score FROM run GROUP BY 1")
def _(spark, sf):
    mapped = stored_map(spark, sf)
    ran = run_results(spark, sf, mapped)
    expected = B.digest(mapped).first()["digest"]
    shown = B.unblind(B.seal(ran, mapped), mapped, B.calibration_results(ran, mapped), expected)
    return shown.groupBy("unblinded_label").agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("sample_id").alias("samples"), round6(F.avg("structure_score")).alias("mean_score"))


@query("j5_q_attach", f"WITH {SCORES}, {EMPIRICAL}, {STEP_UP} SELECT r.sample_id, r.variant, r.l_partkey, q.q_value FROM results r LEFT JOIN qvalues q USING (sample_id)")
def _(spark, sf):
    q = S.bh_q(S.empirical_p(kept_scores(spark, sf)))
    return S.attach_q(results(spark, sf), q).select("sample_id", "variant", "l_partkey", "q_value")


# --- review ------------------------------------------------------------------------------

LOG = """log AS (SELECT conv_id AS blind_id, turn AS ts, text AS note, [CASE role WHEN 'user' THEN 'interesting' WHEN 'assistant' THEN 'artifact' ELSE 'exclude' END,
  CASE WHEN turn % 2 = 0 THEN 'persistent' ELSE 'artifact' END] AS flags FROM conversations),
latest AS (SELECT blind_id, trim(arg_max(note, ts)) AS note, list_sort(list_distinct(arg_max(flags, ts))) AS flags, min(ts) AS created_at, max(ts) AS updated_at, count(*) AS revisions FROM log GROUP BY 1)"""


def annotation_log(spark, sf):
    role, turn = F.col("role"), F.col("turn")
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("blind_id"), turn.alias("ts"), F.col("text").alias("note"), R.normalized_flags(F.array(
            F.when(role == "user", "interesting").when(role == "assistant", "artifact").otherwise("exclude"),
            F.when(turn % 2 == 0, "persistent").otherwise("artifact"))).alias("flags"))


@query("r1_latest_annotations", f"WITH {LOG} SELECT blind_id, note, array_to_string(flags, ',') AS flags, created_at, updated_at, revisions FROM latest")
def _(spark, sf):
    return R.latest_annotations(annotation_log(spark, sf)).withColumn("flags", F.concat_ws(",", "flags"))


@query("u2_flag_normalisation", f"WITH {LOG} SELECT blind_id, ts, array_to_string(list_sort(list_distinct(flags)), ',') AS flags FROM log")
def _(spark, sf):
    return annotation_log(spark, sf).select("blind_id", "ts", F.concat_ws(",", "flags").alias("flags"))


@query("j10_unknown_annotation_ids", "SELECT DISTINCT conv_id AS blind_id FROM conversations WHERE conv_id NOT IN (SELECT l_orderkey FROM lineitem)")
def _(spark, sf):
    known = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("blind_id"))
    return R.unknown_ids(annotation_log(spark, sf), known)


CANDIDATES = f"""{RESULTS}, {BEST}, ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, sample_id) AS rank FROM best),
top AS (SELECT * FROM ranked WHERE rank <= 20)"""


def candidates(spark, sf, k=20):
    best = X.best_variant(results(spark, sf), score="score", ties=TIES)
    return R.top_candidates(best, [F.desc("score"), F.col("sample_id")], k)


@query("k1_top_candidates", f"WITH {CANDIDATES} SELECT rank, sample_id, score, variant FROM top")
def _(spark, sf):
    return candidates(spark, sf).select("rank", "sample_id", "score", "variant")


@query("k3_first_events", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 100")
def _(spark, sf):
    from ..operators.ordering import hash_spread, top_per_group

    ev = table(spark, sf, "events").select("user_id", "event_id", "ts").withColumn("_s", hash_spread("event_id"))
    return top_per_group(ev, ["user_id"], [F.col("ts"), F.col("event_id")], 100, spread=["_s"]).select("user_id", "event_id")


@query("k4_filmstrip", f"WITH {CANDIDATES} SELECT sample_id, score, unblinded_label FROM top WHERE rank <= 8")
def _(spark, sf):
    return candidates(spark, sf, 8).select("sample_id", "score", "unblinded_label")


@query("j4_annotation_attach", f"""WITH {LOG}, {CANDIDATES}
SELECT t.rank, t.sample_id, coalesce(array_to_string(l.flags, ','), '') AS review_flags, coalesce(l.note, '') AS review_note FROM top t LEFT JOIN latest l ON l.blind_id = t.sample_id""")
def _(spark, sf):
    top = candidates(spark, sf).withColumn("blind_id", F.col("sample_id"))
    return R.attach_annotations(top, R.latest_annotations(annotation_log(spark, sf))).select("rank", "sample_id", "review_flags", "review_note")


@query("f4_review_filters", f"""WITH {RESULTS}, {BEST}, strong AS (SELECT *, CASE WHEN symbol >= greatest(diffraction, speckle, texture) THEN 'symbol'
  WHEN diffraction >= greatest(speckle, texture) THEN 'diffraction' WHEN speckle >= texture THEN 'speckle' ELSE 'texture' END AS family FROM best)
SELECT sample_id, variant, score FROM strong WHERE score >= 0.3 AND persistence >= 0.2 AND family = 'diffraction' AND l_partkey % 3 = 0""")
def _(spark, sf):
    best = X.best_variant(results(spark, sf), score="score", ties=TIES).withColumns({
        "primary_metric_score": F.col("score"), "structure_score": F.col("score"), "persistence_score": F.col("persistence"),
        "ocr_text": F.when(F.col("l_partkey") % 3 == 0, "seen").otherwise(" ")})
    return R.filter_candidates(best, 0.3, 0.2, text="has", family="diffraction").select("sample_id", "variant", "score")


@query("io8_candidates_csv", f"""WITH {LOG}, {CANDIDATES}
SELECT t.rank, t.sample_id AS blind_id, t.sample_id, t.unblinded_label, 'structure_score' AS primary_metric, t.score AS primary_metric_score, t.score AS structure_score,
  t.persistence AS persistence_score, t.variant AS preprocessing_variant, coalesce(array_to_string(l.flags, ','), '') AS review_flags, coalesce(l.note, '') AS review_note
FROM top t LEFT JOIN latest l ON l.blind_id = t.sample_id""")
def _(spark, sf):
    top = candidates(spark, sf).withColumn("blind_id", F.col("sample_id")).withColumns({
        "primary_metric": F.lit("structure_score"), "primary_metric_score": F.col("score"), "structure_score": F.col("score"),
        "persistence_score": F.col("persistence"), "preprocessing_variant": F.col("variant")})
    noted = R.attach_annotations(top, R.latest_annotations(annotation_log(spark, sf)))
    return R.candidate_table(noted, unblinded=True)


@query("io9_bundle_hashes", f"""WITH {CANDIDATES}, assets AS (SELECT t.sample_id, l.l_linenumber AS n, l.l_partkey, row_number() OVER (PARTITION BY t.sample_id ORDER BY l.l_linenumber, l.l_partkey) AS i
  FROM top t JOIN lineitem l ON l.l_orderkey = t.sample_id)
SELECT 'top_crops/' || sample_id || '_' || n || '_' || l_partkey AS member, sha256(CAST(l_partkey AS VARCHAR)) AS sha256 FROM assets WHERE i <= 3
UNION ALL SELECT 'top_originals/' || sample_id, sha256(CAST(sample_id AS VARCHAR)) FROM top""")
def _(spark, sf):
    top = candidates(spark, sf).select("sample_id")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample_id"), "l_linenumber", "l_partkey")
    sha = lambda c: F.sha2(F.col(c).cast("string"), 256).alias("sha256")
    asset = lambda kind, name, c: F.struct(F.lit(kind).alias("kind"), name.alias("name"), sha(c))
    # A candidate has a handful of assets.
    crops = lines.join(top, "sample_id").groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("c"))
    listed = F.concat(F.array(asset("original", F.col("sample_id").cast("string"), "sample_id")), F.transform("c", lambda c: F.struct(
        F.lit("crop").alias("kind"), F.concat_ws("_", "sample_id", c["l_linenumber"], c["l_partkey"]).alias("name"),
        F.sha2(c["l_partkey"].cast("string"), 256).alias("sha256"))))
    return sinks.asset_hashes(crops.withColumn("assets", listed))
