"""Queries over per-frame and cross-frame features (T, W) and controls (C)."""

import math

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.columns import round6
from ..operators import controls as K, crossframe as X, detectors as D, preprocess as P
from ..operators.ordering import global_rank, running_count, running_min
from ..sources.tables import frames, mosaics, results, table, words
from .queries_frames import canny_sql
from .registry import CELL_OUT, CELLS, FRAMES, MOSAIC, MOSAIC_PACKED, PACKED, RESULTS, at, mirrored, otsu_sql, query

KEY = ["frame_id"]

# --- texture -----------------------------------------------------------------------------

T1 = f"""lap AS (SELECT frame_id, {at(mirrored('y - 1'), 'x')} + {at(mirrored('y + 1'), 'x')} + {at('y', mirrored('x - 1'))}
    + {at('y', mirrored('x + 1'))} - 4 * {at('y', 'x')} AS l FROM packed, ys, xs),
lapvar AS (SELECT frame_id, round(var_pop(l), 6) AS laplacian_variance FROM lap GROUP BY 1),
probs AS (SELECT frame_id, v, count(*) / 64.0 AS p FROM cells GROUP BY ALL),
ent AS (SELECT frame_id, round(-sum(p * log2(p)), 6) AS entropy FROM probs GROUP BY 1),
spread AS (SELECT frame_id, round(stddev_pop(v), 6) AS contrast_std FROM cells GROUP BY 1),
texture AS (SELECT frame_id, entropy, contrast_std, laplacian_variance FROM ent JOIN spread USING (frame_id) JOIN lapvar USING (frame_id))"""


@query("t1_entropy_texture", f"WITH {PACKED}, {T1} SELECT * FROM texture")
def _(spark, sf):
    return D.entropy_texture(frames(spark, sf), KEY)


@query("t2_binary_mask", f"""WITH {CELLS}, {otsu_sql()}
SELECT frame_id, y, x, CAST(CASE WHEN v > t THEN 255 ELSE 0 END AS INTEGER) AS v FROM cells JOIN otsu USING (frame_id)""")
def _(spark, sf):
    return P.to_cells(D.binary_mask(frames(spark, sf)).withColumn("pixels", F.col("mask")), "frame_id")


COMPONENTS = otsu_sql() + """,
dark AS (SELECT frame_id, y, x, y * 8 + x AS p FROM cells JOIN otsu USING (frame_id) WHERE v <= t),
reach AS (SELECT frame_id, p AS root, y, x, p FROM dark
  UNION SELECT r.frame_id, r.root, d.y, d.x, d.p FROM reach r JOIN dark d
    ON d.frame_id = r.frame_id AND abs(d.y - r.y) <= 1 AND abs(d.x - r.x) <= 1),
labelled AS (SELECT frame_id, y, x, p, min(root) AS label FROM reach GROUP BY ALL),
all_boxes AS (SELECT frame_id, label, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area
  FROM labelled GROUP BY frame_id, label),
boxes AS (SELECT *, round(w / CAST(h AS DOUBLE), 6) AS aspect, round(area / CAST(w * h AS DOUBLE), 6) AS fill,
    area / CAST(w * h AS DOUBLE) BETWEEN 0.15 AND 0.85 AND w / CAST(h AS DOUBLE) BETWEEN 0.1 AND 10 AND area / 64.0 < 0.2 AS text_like
  FROM all_boxes WHERE area >= 4)"""


@query("t3_components", f"WITH RECURSIVE {CELLS}, {COMPONENTS} SELECT frame_id, label, x, y, w, h, area, aspect, fill, text_like FROM boxes")
def _(spark, sf):
    return D.components(frames(spark, sf), KEY).select("frame_id", "label", "x", "y", "w", "h", "area", "aspect", "fill", "text_like")


SUMMARY = """comp_summary AS (SELECT f.frame_id, count(area) AS component_count, count(area) FILTER (WHERE text_like) AS text_like_count,
  CAST(coalesce(median(area), 0) AS DOUBLE) AS median_area FROM (SELECT DISTINCT frame_id FROM cells) f LEFT JOIN boxes USING (frame_id) GROUP BY f.frame_id)"""


@query("t3_component_summary", f"WITH RECURSIVE {CELLS}, {COMPONENTS}, {SUMMARY} SELECT * FROM comp_summary")
def _(spark, sf):
    return D.component_summary(frames(spark, sf), KEY)


@query("k2_top_components", f"""WITH RECURSIVE {CELLS}, {COMPONENTS}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY area DESC, label) AS rank FROM boxes)
SELECT frame_id, rank, label, area FROM ranked WHERE rank <= 50""")
def _(spark, sf):
    return D.top_components(D.components(frames(spark, sf), KEY), KEY).select("frame_id", "rank", "label", "area")


ROIS = """pad AS (SELECT frame_id, py, px_ FROM (SELECT DISTINCT frame_id FROM cells), (SELECT unnest(range(-1, 9)) AS py), (SELECT unnest(range(-1, 9)) AS px_)),
light AS (SELECT p.frame_id, p.py AS y, p.px_ AS x, p.py IN (-1, 8) OR p.px_ IN (-1, 8) AS rim
  FROM pad p LEFT JOIN dark d ON d.frame_id = p.frame_id AND d.y = p.py AND d.x = p.px_ WHERE d.p IS NULL),
outside AS (SELECT frame_id, y, x FROM light WHERE rim
  UNION SELECT l.frame_id, l.y, l.x FROM outside o JOIN light l ON l.frame_id = o.frame_id AND abs(l.y - o.y) + abs(l.x - o.x) = 1),
outer_labels AS (SELECT DISTINCT c.frame_id, c.label FROM labelled c JOIN outside o ON o.frame_id = c.frame_id AND abs(c.y - o.y) + abs(c.x - o.x) = 1),
fits AS (SELECT b.frame_id, b.label, b.x, b.y, b.w, b.h, b.w * b.h AS box FROM all_boxes b JOIN outer_labels USING (frame_id, label)
  WHERE b.w * b.h >= 25 AND b.w * b.h <= 32 AND b.w / CAST(b.h AS DOUBLE) BETWEEN 0.05 AND 20),
rois_ranked AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY box DESC, y DESC, x DESC, label) AS rank FROM fits),
rois AS (SELECT frame_id, rank, greatest(0, x - 4) AS x, greatest(0, y - 4) AS y, least(8, x + w + 4) - greatest(0, x - 4) AS width,
  least(8, y + h + 4) - greatest(0, y - 4) AS height, box AS area FROM rois_ranked WHERE rank <= 5)"""


@query("t6_candidate_rois", f"WITH RECURSIVE {CELLS}, {COMPONENTS}, {ROIS} SELECT frame_id, rank, x, y, width, height, area FROM rois")
def _(spark, sf):
    return D.candidate_rois(frames(spark, sf), KEY)


# --- edges and lines ---------------------------------------------------------------------


@query("t4_edge_density", f"WITH RECURSIVE {canny_sql(50, 150)} SELECT frame_id, round(avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END), 6) AS edge_density FROM edge_cells GROUP BY frame_id")
def _(spark, sf):
    return D.edge_density(frames(spark, sf), KEY)


ANGLES = "angles(theta, c, s) AS (VALUES " + ", ".join(
    f"({d}, {math.cos(math.radians(d))!r}::DOUBLE, {math.sin(math.radians(d))!r}::DOUBLE)" for d in range(180)) + ")"


@query("t5_hough_votes", f"""WITH RECURSIVE {canny_sql(50, 150)}, {ANGLES}
SELECT frame_id, theta, CAST(floor(x * c + y * s + 0.5) AS INTEGER) AS rho, count(*) AS votes
FROM edge_cells, angles WHERE v > 0 GROUP BY ALL HAVING count(*) >= 6""")
def _(spark, sf):
    return D.hough_votes(D.edges(frames(spark, sf)), KEY, 6)


LINES = f"""{canny_sql(50, 150, MOSAIC_PACKED, 64)}, {ANGLES},
aimed_cells AS (SELECT frame_id, theta, CAST(floor(x * c + y * s + 0.5) AS INTEGER) AS rho, y, x, y * c - x * s AS t FROM edge_cells, angles WHERE v > 0),
winners AS (SELECT frame_id, theta, rho, count(*) AS votes FROM aimed_cells GROUP BY ALL HAVING count(*) >= 50),
steps AS (SELECT a.*, w.votes, a.t - lag(a.t) OVER (PARTITION BY a.frame_id, a.theta, a.rho ORDER BY a.t, a.y, a.x) AS gap
  FROM aimed_cells a JOIN winners w USING (frame_id, theta, rho)),
line_runs AS (SELECT *, count(*) FILTER (WHERE gap > 8) OVER (PARTITION BY frame_id, theta, rho ORDER BY t, y, x) AS run FROM steps),
ends AS (SELECT frame_id, theta, rho, votes, run, arg_min(struct_pack(x, y), (t, y, x)) AS a, arg_max(struct_pack(x, y), (t, y, x)) AS b
  FROM line_runs GROUP BY frame_id, theta, rho, votes, run),
spans AS (SELECT *, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS length FROM ends),
line_ranks AS (SELECT frame_id, theta, rho, votes, round(length, 6) AS length,
  row_number() OVER (PARTITION BY frame_id ORDER BY votes DESC, theta, rho, run) AS rank FROM spans WHERE length >= 10)"""


@query("t5_lines", f"WITH RECURSIVE {LINES} SELECT frame_id, CAST(rank AS INTEGER) AS rank, theta, rho, votes, length FROM line_ranks WHERE rank <= 100")
def _(spark, sf):
    return D.hough_lines(D.edges(mosaics(spark, sf)), KEY)


@query("t5_line_evidence", f"""WITH RECURSIVE {LINES} SELECT frame_id, count(length) AS line_count, coalesce(round(avg(length), 6), 0.0) AS mean_line_length
FROM packed LEFT JOIN (SELECT * FROM line_ranks WHERE rank <= 100) USING (frame_id) GROUP BY frame_id""")
def _(spark, sf):
    return D.line_evidence(D.edges(mosaics(spark, sf)), KEY)


# --- spectra -----------------------------------------------------------------------------

SPECTRUM = """centred AS (SELECT c.frame_id, y, x, (v - avg(v) OVER (PARTITION BY c.frame_id))
    * (0.5 - 0.5 * cos(2 * pi() * y / 7)) * (0.5 - 0.5 * cos(2 * pi() * x / 7)) AS d FROM cells c),
freqs AS (SELECT ky, kx FROM (SELECT unnest(range(8)) AS ky), (SELECT unnest(range(8)) AS kx)),
dft AS (SELECT frame_id, (ky + 4) % 8 AS sy, (kx + 4) % 8 AS sx, sum(d * cos(2 * pi() * ((ky * y + kx * x) % 8) / 8)) AS re,
    sum(d * sin(2 * pi() * ((ky * y + kx * x) % 8) / 8)) AS im FROM centred, freqs GROUP BY frame_id, ky, kx),
spec AS (SELECT frame_id, sy, sx, ln(1 + sqrt(re * re + im * im)) AS mag, sqrt((sx - 4) * (sx - 4) + (sy - 4) * (sy - 4)) AS r FROM dft),
peaks AS (SELECT frame_id, sy, sx, mag, r, row_number() OVER (PARTITION BY frame_id ORDER BY mag DESC) AS n FROM spec
  WHERE r > 3 AND sy * 8 + sx <= ((8 - sy) % 8) * 8 + (8 - sx) % 8),
peak AS (SELECT * FROM peaks WHERE n = 1),
spectra AS (SELECT s.frame_id, greatest(0, (any_value(p.mag) - avg(s.mag) FILTER (WHERE s.r > 3)) / (stddev_pop(s.mag) FILTER (WHERE s.r > 3) + 1e-6)) AS prominence,
  any_value(p.r) / 4 AS radius, degrees(atan2(any_value(p.sy) - 4, any_value(p.sx) - 4)) AS angle,
  sum(s.mag) FILTER (WHERE abs(s.r - p.r) <= 2) / sum(s.mag) FILTER (WHERE s.r > 3) AS ring
  FROM spec s JOIN peak p USING (frame_id) GROUP BY s.frame_id)"""


@query("t7_spectrum_peak", f"""WITH {CELLS}, {SPECTRUM} SELECT frame_id, round(prominence, 4) AS prominence, round(radius, 4) AS radius,
  round(angle, 3) AS angle, round(ring, 4) AS ring FROM spectra""")
def _(spark, sf):
    return D.spectrum(frames(spark, sf), KEY, digits=4)


@query("t8_series_spectrum", """WITH placed AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events),
centred AS (SELECT user_id, t // 64 AS win, t % 64 AS j, value - avg(value) OVER (PARTITION BY user_id, t // 64) AS d FROM placed),
waves AS (SELECT user_id, win, k, count(*) AS c, pow(sum(d * cos(2 * pi() * k * j / 64)), 2) + pow(sum(d * sin(2 * pi() * k * j / 64)), 2) AS p
  FROM centred, (SELECT unnest(range(1, 33)) AS k) GROUP BY user_id, win, k),
power AS (SELECT user_id, k, sum(c) AS n, ln(1 + sqrt(avg(p))) AS mag FROM waves GROUP BY user_id, k)
SELECT user_id, CAST(n AS BIGINT) AS n, CAST(arg_min(k, -round(mag, 6) * 1000 + k / 1e6) AS INTEGER) AS peak_k,
  round(greatest(0, (max(mag) - avg(mag)) / (stddev_pop(mag) + 1e-6)), 4) AS prominence FROM power GROUP BY user_id, n""")
def _(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    placed = running_count(ev, ["user_id"], [F.col("ts"), F.col("event_id")], F.to_date("ts"), "t").withColumn("t", F.col("t") - 1)
    return D.series_peak(D.series_spectrum(placed, ["user_id"], "t", "value"), ["user_id"])


# --- contrast and pair texture -----------------------------------------------------------

SPECKLE = f"""offs AS (SELECT unnest(range(-3, 4)) AS d),
sums AS (SELECT frame_id, y, x, sum({at(mirrored('y + a.d'), mirrored('x + b.d'))}) AS s,
    sum({at(mirrored('y + a.d'), mirrored('x + b.d'))} * {at(mirrored('y + a.d'), mirrored('x + b.d'))}) AS q, any_value({at('y', 'x')}) AS v
  FROM packed, ys, xs, offs a, offs b GROUP BY frame_id, y, x),
local_stats AS (SELECT frame_id, v, s / 49.0 AS m, greatest(0, (q * 49.0 - CAST(s AS DOUBLE) * s) / (49.0 * 49.0)) AS var FROM sums),
speckles AS (SELECT frame_id, round(avg(sqrt(var) / (m + 1e-6)), 6) AS contrast_mean, round(stddev_pop(sqrt(var) / (m + 1e-6)), 6) AS contrast_spread,
  round(avg(var), 6) AS variance_mean, round(avg(CASE WHEN v >= 250 THEN 1.0 ELSE 0.0 END), 6) AS saturated_fraction FROM local_stats GROUP BY frame_id)"""


@query("t9_speckle_contrast", f"WITH {PACKED}, {SPECKLE} SELECT * FROM speckles")
def _(spark, sf):
    return D.speckle(frames(spark, sf), KEY)


GLCM = """ranges AS (SELECT frame_id, min(v) AS lo, max(v) AS hi FROM cells GROUP BY 1),
quant AS (SELECT frame_id, y, x, CASE WHEN hi > lo THEN (v - lo) * 15 // (hi - lo) ELSE 0 END AS g FROM cells JOIN ranges USING (frame_id)),
pairs AS (SELECT a.frame_id, a.g AS i, b.g AS j FROM quant a JOIN quant b ON a.frame_id = b.frame_id
  AND ((b.y = a.y AND b.x = a.x + 1) OR (b.x = a.x AND b.y = a.y + 1))),
both_ways AS (SELECT frame_id, i, j FROM pairs UNION ALL SELECT frame_id, j, i FROM pairs),
tallied AS (SELECT frame_id, i, j, count(*) AS c FROM both_ways GROUP BY ALL),
counted AS (SELECT frame_id, i, j, c / CAST(sum(c) OVER (PARTITION BY frame_id) AS DOUBLE) AS p FROM tallied),
glcms AS (SELECT frame_id, round(sum((i - j) * (i - j) * p), 6) AS contrast, round(sum(p / (1.0 + abs(i - j))), 6) AS homogeneity,
  round(sqrt(sum(p * p)), 6) AS energy, round(-sum(p * log2(p)), 6) AS entropy FROM counted GROUP BY frame_id)"""


@query("t10_pair_texture", f"WITH {CELLS}, {GLCM} SELECT * FROM glcms")
def _(spark, sf):
    return D.glcm(frames(spark, sf), KEY)


# --- text and scores ---------------------------------------------------------------------

WORDS = """words AS (SELECT doc_id, coalesce(quality * 100.0, -1.0) AS conf, unnest(string_split(text, ' ')) AS word
  FROM documents LEFT JOIN labels USING (doc_id))"""


@query("t11_text_evidence", f"""WITH {WORDS} SELECT doc_id, count(*) AS word_count,
  CAST(round(coalesce(avg(conf) FILTER (WHERE conf >= 0), 0), 6) AS DOUBLE) AS confidence FROM words WHERE trim(word) <> '' GROUP BY doc_id""")
def _(spark, sf):
    return D.text_evidence(words(spark, sf), ["doc_id"])


@query("s16_known_confidence", f"""WITH {WORDS} SELECT doc_id, count(*) FILTER (WHERE conf <> -1) AS known,
  CAST(round(avg(conf) FILTER (WHERE conf <> -1), 6) AS DOUBLE) AS mean_confidence FROM words GROUP BY doc_id""")
def _(spark, sf):
    from ..operators.stats import known_confidence

    return known_confidence(words(spark, sf), ["doc_id"])


def line_features(spark, sf):
    """Line items as a feature table, one record each."""
    n = F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", n.alias("word_count"), (F.col("l_discount") * 1000).alias("confidence"),
        n.alias("text_like_count"), (F.col("l_quantity") / 7).alias("entropy"), F.col("l_tax").alias("edge_density"),
        n.alias("line_count"), (n % 6).alias("roi_count"), (F.col("l_quantity") / 5).alias("prominence"),
        (F.col("l_discount") * 5).alias("ring"), (F.col("l_tax") * 6).alias("contrast_mean"), F.col("l_quantity").alias("glcm_contrast"))


FEATURES = """features AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS DOUBLE) AS n,
  least(1.0::DOUBLE, l_linenumber / 8.0::DOUBLE * 0.6::DOUBLE + greatest(0.0::DOUBLE, l_discount * 1000) / 100.0::DOUBLE * 0.4::DOUBLE) AS txt,
  l_quantity / 7 AS entropy, l_tax AS edge, l_linenumber % 6 AS rois, l_quantity / 5 AS prom, l_discount * 5 AS ring, l_tax * 6 AS speckle,
  l_quantity AS contrast FROM lineitem),
scored AS (SELECT *, round(0.25::DOUBLE * txt + 0.20::DOUBLE * least(1.0::DOUBLE, n / 30) + 0.15::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, entropy / 8))
  + 0.20::DOUBLE * least(1.0::DOUBLE, edge * 8) + 0.10::DOUBLE * least(1.0::DOUBLE, n / 30) + 0.10::DOUBLE * least(1.0::DOUBLE, rois / 5.0::DOUBLE), 6) AS structure_score FROM features)"""


@query("t12_structure_score", f"WITH {FEATURES} SELECT l_orderkey, l_linenumber, structure_score FROM scored")
def _(spark, sf):
    return D.with_scores(line_features(spark, sf)).select("l_orderkey", "l_linenumber", "structure_score")


@query("t13_family_scores", f"""WITH {FEATURES} SELECT l_orderkey, l_linenumber, round(greatest(txt, least(1.0::DOUBLE, n / 40)), 6) AS symbol,
  round(least(1.0::DOUBLE, prom / 8 * 0.75::DOUBLE + ring * 0.25::DOUBLE), 6) AS diffraction, round(least(1.0::DOUBLE, speckle * 2), 6) AS speckle,
  round(least(1.0::DOUBLE, entropy / 8 * 0.35::DOUBLE + edge * 4 * 0.25::DOUBLE + least(1.0::DOUBLE, contrast / 24) * 0.25::DOUBLE
    + least(1.0::DOUBLE, rois / 5.0::DOUBLE) * 0.15::DOUBLE), 6) AS texture FROM scored""")
def _(spark, sf):
    return D.with_scores(line_features(spark, sf)).select("l_orderkey", "l_linenumber", *C.FAMILIES)


@query("t14_primary_metric", f"""WITH {FEATURES} SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN round(least(1.0::DOUBLE, prom / 8), 6)
  WHEN 1 THEN round(least(1.0::DOUBLE, speckle * 2), 6) WHEN 2 THEN round(txt, 6) ELSE structure_score END AS primary_metric_score FROM scored""")
def _(spark, sf):
    names = F.array(*[F.lit(m) for m in ("fft_peak_prominence", "speckle_contrast", "ocr_symbol_score", "unheard_of")])
    metric = F.element_at(names, (F.col("l_linenumber") % 4 + 1).cast("int"))
    return D.with_scores(line_features(spark, sf), metric).select("l_orderkey", "l_linenumber", "primary_metric_score")


T15 = f"""{COMPONENTS}, {SUMMARY}, {ROIS}, {SPECTRUM},
roi_counts AS (SELECT frame_id, count(*) AS roi_count FROM rois GROUP BY 1),
edge_share AS (SELECT frame_id, round(avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END), 6) AS edge_density FROM edge_cells GROUP BY 1),
bundle AS (SELECT t.frame_id, t.entropy, e.edge_density, k.contrast_mean, g.contrast AS glcm_contrast, round(s.prominence, 6) AS prominence, round(s.ring, 6) AS ring,
    coalesce(c.text_like_count, 0) AS text_like, coalesce(r.roi_count, 0) AS roi_count
  FROM texture t JOIN edge_share e USING (frame_id) JOIN speckles k USING (frame_id) JOIN glcms g USING (frame_id)
  JOIN spectra s USING (frame_id) LEFT JOIN comp_summary c USING (frame_id) LEFT JOIN roi_counts r USING (frame_id)),
detected AS (SELECT frame_id, text_like AS text_like_count, roi_count, edge_density,
  round(0.20::DOUBLE * least(1.0::DOUBLE, text_like / 30.0::DOUBLE) + 0.15::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, entropy / 8))
    + 0.20::DOUBLE * least(1.0::DOUBLE, edge_density * 8) + 0.10::DOUBLE * least(1.0::DOUBLE, roi_count / 5.0::DOUBLE), 6) AS structure_score,
  round(least(1.0::DOUBLE, text_like / 40.0::DOUBLE), 6) AS symbol,
  floor(round(least(1.0::DOUBLE, prominence / 8 * 0.75::DOUBLE + ring * 0.25::DOUBLE), 6) * 10000) / 10000 AS diffraction,
  round(least(1.0::DOUBLE, contrast_mean * 2), 6) AS speckle,
  floor(round(least(1.0::DOUBLE, entropy / 8 * 0.35::DOUBLE + edge_density * 4 * 0.25::DOUBLE + least(1.0::DOUBLE, glcm_contrast / 24) * 0.25::DOUBLE
    + least(1.0::DOUBLE, roi_count / 5.0::DOUBLE) * 0.15::DOUBLE), 6) * 10000) / 10000 AS texture FROM bundle)"""


@query("t15_detector_bundle", f"""WITH RECURSIVE {canny_sql(50, 150)}, {T1}, {SPECKLE}, {GLCM}, {T15} SELECT * FROM detected""")
def _(spark, sf):
    out = D.detect(frames(spark, sf).select("frame_id", "pixels", "height", "width"), KEY)
    return out.select("frame_id", "text_like_count", "roi_count", "edge_density", "structure_score", "symbol",
                      (F.floor(F.col("diffraction") * 10000) / 10000).alias("diffraction"), "speckle",
                      (F.floor(F.col("texture") * 10000) / 10000).alias("texture"))


# --- across frames -----------------------------------------------------------------------

W1 = f"""{otsu_sql()}, masks AS (SELECT c.frame_id, c.capture_id, c.frame_index, list(v > t ORDER BY y, x) AS m
  FROM cells c JOIN otsu USING (frame_id) GROUP BY ALL),
prev AS (SELECT *, lag(m) OVER (PARTITION BY capture_id ORDER BY frame_index) AS q FROM masks),
ious AS (SELECT frame_id, capture_id, frame_index, CASE WHEN any_value(q) IS NULL THEN 0
    ELSE coalesce(count(*) FILTER (WHERE m[i] AND q[i]) / nullif(count(*) FILTER (WHERE m[i] OR q[i]), 0), 0) END AS iou
  FROM prev, (SELECT unnest(range(1, 65)) AS i) GROUP BY frame_id, capture_id, frame_index),
persist AS (SELECT capture_id, frame_id, round(greatest(iou, coalesce(lead(iou) OVER (PARTITION BY capture_id ORDER BY frame_index), 0)), 6) AS persistence_score FROM ious)"""


@query("w1_persistence", f"WITH {CELLS}, {W1} SELECT capture_id, frame_id, persistence_score FROM persist")
def _(spark, sf):
    return X.persistence(frames(spark, sf), ["capture_id"], [F.col("frame_index")], "frame_id")


@query("w2_registration")
def _(spark, sf):
    return X.registration(frames(spark, sf), ["capture_id"], [F.col("frame_index")], "frame_id")


TIES = ["variant", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
BEST = f"""best AS (SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, {', '.join(TIES)}) = 1)"""


@query("w3_best_variant", f"WITH {RESULTS}, {BEST} SELECT sample_id, variant, score, persistence, unblinded_label FROM best")
def _(spark, sf):
    return X.best_variant(results(spark, sf), score="score", ties=TIES).select("sample_id", "variant", "score", "persistence", "unblinded_label")


@query("w4_candidate_rank", f"WITH {RESULTS}, {BEST} SELECT sample_id, score, row_number() OVER (ORDER BY score DESC, sample_id) AS rank FROM best")
def _(spark, sf):
    best = X.best_variant(results(spark, sf), score="score", ties=TIES).select("sample_id", "score", "variant")
    return global_rank(best, [F.desc("score"), F.col("sample_id")]).select("sample_id", "score", "rank")


@query("w5_running_minimum", """SELECT event_id, user_id, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS running FROM events""")
def _(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return running_min(ev, ["user_id"], [F.col("ts"), F.col("event_id")], F.to_date("ts"), "value", "running").select(
        "event_id", "user_id", "running")


# --- controls ----------------------------------------------------------------------------

CONTROL_OUT = "'ctrl-' || frame_id || '-{t}' AS sample_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(v AS INTEGER) AS v"


def control_cells(spark, sf, kind, level="standard", source=frames):
    made = K.matched_controls(source(spark, sf), level).filter(F.col("control_type") == kind)
    return P.to_cells(made, "sample_id")


@query("c1_blank_mean", f"""WITH {CELLS}, means AS (SELECT frame_id, CAST(floor(avg(v)) AS INTEGER) AS m FROM cells GROUP BY 1)
SELECT 'ctrl-' || frame_id || '-blank_mean' AS sample_id, y, x, m AS v FROM cells JOIN means USING (frame_id) WHERE role = 'laser'""")
def _(spark, sf):
    return control_cells(spark, sf, "blank_mean")


@query("c2_rotated", f"WITH {CELLS} SELECT 'ctrl-' || frame_id || '-rotated' AS sample_id, x AS y, CAST(7 - y AS INTEGER) AS x, v FROM cells WHERE role = 'laser'")
def _(spark, sf):
    return control_cells(spark, sf, "rotated")


def laser_mosaics(spark, sf):
    return mosaics(spark, sf).withColumns({"capture_id": F.lit("cap-mosaic"), "role": F.lit("laser")})


@query("c3_block_shuffle", f"""WITH {MOSAIC}, tile_order AS (SELECT i AS src, row_number() OVER (ORDER BY md5('12345:' || i)) - 1 AS dst FROM (SELECT unnest(range(4)) AS i))
SELECT 'ctrl-' || frame_id || '-block_shuffle' AS sample_id, CAST((dst // 2) * 32 + y % 32 AS INTEGER) AS y, CAST((dst % 2) * 32 + x % 32 AS INTEGER) AS x, v
FROM mosaic JOIN tile_order ON src = (y // 32) * 2 + x // 32""")
def _(spark, sf):
    return control_cells(spark, sf, "block_shuffle", source=laser_mosaics)


@query("c4_noise_matched", f"""WITH {CELLS}, stats AS (SELECT frame_id, avg(v) AS m, stddev_pop(v) AS d FROM cells GROUP BY 1),
hashed AS (SELECT frame_id, y, x, md5('20260710:' || frame_id || ':' || (y * 8 + x)) AS h FROM cells WHERE role = 'laser')
SELECT 'ctrl-' || frame_id || '-noise_matched' AS sample_id, y, x, CAST(least(255, greatest(0, floor(m + d * sqrt(-2.0 * ln((CAST(('0x' || substr(h, 1, 8)) AS BIGINT) + 1.0) / 4294967297.0))
  * cos(2 * pi() * (CAST(('0x' || substr(h, 9, 8)) AS BIGINT) / 4294967296.0))))) AS INTEGER) AS v FROM hashed JOIN stats USING (frame_id)""")
def _(spark, sf):
    return control_cells(spark, sf, "noise_matched", "strict")


@query("c5_intensity_inverted", f"WITH {CELLS} SELECT 'ctrl-' || frame_id || '-intensity_inverted' AS sample_id, y, x, CAST(255 - v AS INTEGER) AS v FROM cells WHERE role = 'laser'")
def _(spark, sf):
    return control_cells(spark, sf, "intensity_inverted", "strict")


@query("c6_control_level", f"""WITH {FRAMES}, levels(level, n) AS (VALUES ('none', 0), ('standard', 3), ('strict', 5))
SELECT level, CAST(count(frame_id) * n AS BIGINT) AS controls FROM levels, frames WHERE role = 'laser' GROUP BY level, n""")
def _(spark, sf):
    listed = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(len(v)).alias("n")) for k, v in K.CONTROL_TYPES.items()])
    laser = frames(spark, sf).filter("role = 'laser'").select(F.explode(listed).alias("l"))
    return laser.groupBy("l.level").agg(F.sum("l.n").alias("controls"))


@query("c7_control_records", f"""WITH {FRAMES}, types(t) AS (VALUES ('blank_mean'), ('rotated'), ('block_shuffle'), ('noise_matched'), ('intensity_inverted'))
SELECT 'ctrl-' || frame_id || '-' || t AS sample_id, capture_id AS parent_capture_id, frame_id AS parent_frame_id, t AS control_type, frame_index,
  'control' AS unblinded_label, true AS synthetic FROM frames, types WHERE role = 'laser'""")
def _(spark, sf):
    return K.matched_controls(frames(spark, sf), "strict").select(
        "sample_id", "parent_capture_id", "parent_frame_id", "control_type", "frame_index", "unblinded_label", "synthetic")


@query("c8_calibration_sample", f"""WITH {FRAMES}
SELECT frame_id AS sample_id, role AS unblinded_label, false AS synthetic FROM frames
UNION ALL SELECT 'synthetic-positive-known-text', 'synthetic_positive', true""")
def _(spark, sf):
    return K.all_samples(frames(spark, sf), "none").select("sample_id", "unblinded_label", "synthetic")


@query("u1_all_samples", f"""WITH {FRAMES}, types(t) AS (VALUES ('blank_mean'), ('rotated'), ('block_shuffle'))
SELECT frame_id AS sample_id, capture_id, NULL AS parent_capture_id, NULL AS control_type, role AS unblinded_label, false AS synthetic FROM frames
UNION ALL SELECT 'ctrl-' || frame_id || '-' || t, NULL, capture_id, t, 'control', true FROM frames, types WHERE role = 'laser'
UNION ALL SELECT 'synthetic-positive-known-text', NULL, NULL, NULL, 'synthetic_positive', true""")
def _(spark, sf):
    return K.all_samples(frames(spark, sf)).select("sample_id", "capture_id", "parent_capture_id", "control_type", "unblinded_label", "synthetic")


@query("d11_first_per_key", """SELECT l_orderkey, l_linenumber, min_by(l_partkey, (l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS l_partkey
FROM (SELECT *, l_orderkey * 10 + l_linenumber AS sample_id FROM lineitem) GROUP BY l_orderkey, l_linenumber""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("sample_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    return K.first_per_key(li, "sample_id", order).select("l_orderkey", "l_linenumber", "l_partkey")
