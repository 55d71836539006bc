"""Queries over frames: sources, sampling, preprocessing (IO, F1-F3, D, G)."""

import functools

from pyspark.sql import functions as F

from ..functions.columns import hamming, height, let, pixels, signature_hex, width
from ..operators import hashtree, preprocess as P, sampling as S
from ..sources import media
from ..session import cut
from ..sources.tables import document_signatures, frames, mosaics, table
from .registry import (
    CELL_OUT, CELLS, DOC_SIGNATURES, FRAMES, MOSAIC, PACKED, at, hash_tree_sql, mirrored, otsu_sql, query, repeated,
)


def signed_documents(spark, sf):
    """Signatures are small next to the texts and read in every round, so they are kept."""
    return cut(document_signatures(spark, sf))


def cells(df):
    return P.to_cells(df, "frame_id")


# --- sources -----------------------------------------------------------------------------


@query("io1_image_set_scan")
def _(spark, sf):
    return media.list_media(spark, sf, ["parquet"]).select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "size_bytes")


@query("io2_frame_table", f"""WITH {CELLS}
SELECT frame_id, 8 AS height, 8 AS width, string_agg(CAST(v AS VARCHAR), ',' ORDER BY y, x) AS pixels FROM cells GROUP BY frame_id""")
def _(spark, sf):
    return frames(spark, sf).select("frame_id", "height", "width", F.concat_ws(",", pixels().cast("array<string>")).alias("pixels"))


@query("io3_cells", f"WITH {CELLS} SELECT {CELL_OUT} FROM cells")
def _(spark, sf):
    return cells(frames(spark, sf))


@query("io4_content_hash", "SELECT page_id, sha256(html) AS sha256 FROM pages")
def _(spark, sf):
    return media.content_hash(table(spark, sf, "pages"), "html").select("page_id", "sha256")


@query("io5_record_hash", """SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment
  || '","c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}') AS record_hash FROM customer""")
def _(spark, sf):
    df = table(spark, sf, "customer")
    return media.record_hash(df, ["c_name", "c_custkey", "c_nationkey", "c_mktsegment"]).select("c_custkey", "record_hash")


DOC_RECORDS = "SELECT source, sha256(doc_id || ':' || sha256(text)) AS h FROM documents"


@query("io6_group_fingerprint", f"""WITH {hash_tree_sql(DOC_RECORDS, 'source')}
SELECT source, CAST(n AS BIGINT) AS records, digest AS fingerprint FROM l0""")
def _(spark, sf):
    docs = media.content_hash(table(spark, sf, "documents").select("source", "doc_id", "text"), "text")
    return media.group_fingerprint(docs, ["source"], "doc_id", "sha256")


@query("io6_changed_records", """WITH kept AS (SELECT source, doc_id, sha256(text) AS was,
    sha256(regexp_replace(text, '[0-9]{6,}', '#', 'g')) AS now_ FROM documents)
SELECT source, sha256(doc_id || ':' || was) AS h, 'a' AS side FROM kept WHERE was <> now_
UNION ALL SELECT source, sha256(doc_id || ':' || now_), 'b' FROM kept WHERE was <> now_""")
def _(spark, sf):
    # Long numbers are masked; the trees of both states lead to the records that differ.
    docs = table(spark, sf, "documents").select("source", "doc_id", "text")
    edited = docs.withColumn("text", F.regexp_replace("text", "[0-9]{6,}", "#"))
    rows = [media.group_records(media.content_hash(d, "text"), ["source"], "doc_id", "sha256") for d in (docs, edited)]
    trees = [hashtree.tree(r, ["source"]) for r in rows]
    return hashtree.changed_rows(*rows, *trees, ["source"])


@query("io7_json_records", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(spark, sf):
    df = table(spark, sf, "supplier")
    text = df.select(F.to_json(F.struct(*sorted(df.columns))).alias("j"))
    return text.select(F.from_json("j", df.schema).alias("r")).select("r.*")


@query("io10_preview", f"""WITH {FRAMES}, placed AS (
  SELECT capture_id, frame_id, row_number() OVER (PARTITION BY capture_id ORDER BY frame_index) - 1 AS position,
         count(*) OVER (PARTITION BY capture_id) AS total FROM frames)
SELECT capture_id, frame_id, position FROM placed
WHERE position % greatest(1, total // 4) = 0 AND position // greatest(1, total // 4) < 4""")
def _(spark, sf):
    from ..operators.review import preview

    return preview(frames(spark, sf).select("capture_id", "frame_id", "frame_index"), 4).select("capture_id", "frame_id", "position")


# --- selection ---------------------------------------------------------------------------


@query("f1_interval_sample", f"""WITH {FRAMES}, placed AS (
  SELECT capture_id, frame_id, row_number() OVER (PARTITION BY capture_id ORDER BY frame_index) - 1 AS position FROM frames)
SELECT capture_id, frame_id, position FROM placed WHERE position % 5 = 0""")
def _(spark, sf):
    return S.interval_sample(frames(spark, sf).select("capture_id", "frame_id", "frame_index"), 5).select("capture_id", "frame_id", "position")


@query("f2_capped_all_frames", f"""WITH {FRAMES}, placed AS (
  SELECT capture_id, frame_id, row_number() OVER (PARTITION BY capture_id ORDER BY frame_index) - 1 AS position FROM frames)
SELECT capture_id, frame_id FROM placed WHERE position < 25""")
def _(spark, sf):
    return S.cap_frames(frames(spark, sf).select("capture_id", "frame_id", "frame_index"), 25).select("capture_id", "frame_id")


@query("f3_roi_crop", f"WITH {CELLS} SELECT frame_id, CAST(y AS INTEGER) AS y, CAST(x - 2 AS INTEGER) AS x, v FROM cells WHERE y < 4 AND x BETWEEN 2 AND 6")
def _(spark, sf):
    return cells(P.crop(frames(spark, sf), 2, -1, 5, 4))


@query("f7_sampling_plan", """WITH profiles(profile, mode, frame_interval, max_frames, deduplicate, scene_change_threshold) AS (VALUES
  ('quick', 'interval', 15, 25, true, 0.12), ('baseline', 'interval', 5, 250, true, 0.10),
  ('wide', 'interval', 2, 1000, true, 0.08), ('exhaustive', 'all_frames', 1, NULL, true, 0.05)),
asked AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'quick' WHEN 1 THEN 'baseline' WHEN 2 THEN 'wide' ELSE 'exhaustive' END AS profile,
  CASE WHEN c_nationkey % 5 = 0 THEN 'capped_all_frames' WHEN c_nationkey % 5 = 1 THEN 'scene_change' END AS want_mode,
  CASE WHEN c_nationkey % 3 = 0 THEN c_nationkey + 1 END AS want_interval FROM customer)
SELECT c_custkey, profile, coalesce(want_mode, mode) AS mode,
  CASE WHEN coalesce(want_mode, mode) IN ('all_frames', 'capped_all_frames') THEN 1 ELSE coalesce(want_interval, frame_interval) END AS frame_interval,
  CASE WHEN coalesce(want_mode, mode) = 'all_frames' THEN NULL ELSE max_frames END AS max_frames, deduplicate,
  CAST(scene_change_threshold AS DOUBLE) AS scene_change_threshold
FROM asked JOIN profiles USING (profile)""")
def _(spark, sf):
    n = F.col("c_nationkey")
    captures = table(spark, sf, "customer").select(
        "c_custkey", F.element_at(F.array(*[F.lit(p) for p in ("quick", "baseline", "wide", "exhaustive")]),
                                  (F.col("c_custkey") % 4 + 1).cast("int")).alias("profile"),
        F.when(n % 5 == 0, "capped_all_frames").when(n % 5 == 1, "scene_change").alias("want_mode"),
        F.when(n % 3 == 0, n + 1).alias("want_frame_interval"), F.lit(None).cast("int").alias("want_max_frames"),
        F.lit(None).cast("boolean").alias("want_deduplicate"), F.lit(None).cast("double").alias("want_scene_change_threshold"))
    return S.resolve_plan(captures, S.profiles(spark))


# --- signatures and scene change ---------------------------------------------------------


@query("d1_signature", f"""WITH {CELLS}, sums AS (SELECT frame_id, sum(v) AS t FROM cells GROUP BY 1)
SELECT frame_id, lower(lpad(to_hex(CAST(sum(CASE WHEN v * 64 >= t THEN CAST(pow(2, 63 - (y * 8 + x)) AS HUGEINT) ELSE 0 END) AS UBIGINT)), 16, '0')) AS signature
FROM cells JOIN sums USING (frame_id) GROUP BY frame_id""")
def _(spark, sf):
    sig = let(pixels(), lambda p: S.signature(p, height(), width()))
    return frames(spark, sf).select("frame_id", signature_hex(sig).alias("signature"))


COLOUR = CELLS + """, packed_cells AS (SELECT frame_id, list(v ORDER BY y, x) AS px FROM cells GROUP BY frame_id),
gray AS (SELECT frame_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x,
    (114 * px[i + 1] + 587 * px[(i + 1) % 64 + 1] + 299 * px[(i + 2) % 64 + 1] + 500) // 1000 AS v
  FROM packed_cells, (SELECT unnest(range(64)) AS i))"""


@query("d1_colour_signature", f"""WITH {COLOUR}, sums AS (SELECT frame_id, sum(v) AS t FROM gray GROUP BY 1)
SELECT frame_id, lower(lpad(to_hex(CAST(sum(CASE WHEN v * 64 >= t THEN CAST(pow(2, 63 - (y * 8 + x)) AS HUGEINT) ELSE 0 END) AS UBIGINT)), 16, '0')) AS signature
FROM gray JOIN sums USING (frame_id) GROUP BY frame_id""")
def _(spark, sf):
    sig = let(pixels(), lambda p: S.signature(p, height(), width()))
    return in_colour(frames(spark, sf)).select("frame_id", signature_hex(sig).alias("signature"))


def in_colour(df):
    """Three channels a cell: the cell and the two after it."""
    return df.withColumn("pixels", let(pixels(), lambda p: F.flatten(F.transform(p, lambda v, i: F.array(v, p[(i + 1) % 64], p[(i + 2) % 64])))))


@query("d1_mosaic_signature", f"""WITH {MOSAIC}, blocks AS (
  SELECT frame_id, y // 8 AS ty, x // 8 AS tx, floor(sum(v) / 64.0 + 0.5) AS v FROM mosaic GROUP BY ALL),
sums AS (SELECT frame_id, sum(v) AS t FROM blocks GROUP BY 1)
SELECT frame_id, lower(lpad(to_hex(CAST(sum(CASE WHEN v * 64 >= t THEN CAST(pow(2, 63 - (ty * 8 + tx)) AS HUGEINT) ELSE 0 END) AS UBIGINT)), 16, '0')) AS signature
FROM blocks JOIN sums USING (frame_id) GROUP BY frame_id""")
def _(spark, sf):
    sig = let(pixels(), lambda p: S.signature(p, height(), width()))
    return mosaics(spark, sf).select("frame_id", signature_hex(sig).alias("signature"))


@query("d2_hamming", f"""WITH {DOC_SIGNATURES}
SELECT capture_id, frame_index, CAST(bit_count(xor(signature, lag(signature) OVER (PARTITION BY capture_id ORDER BY frame_index))) AS INTEGER) AS distance FROM sigs""")
def _(spark, sf):
    from ..operators.ordering import with_previous

    sigs = signed_documents(spark, sf)
    out = with_previous(sigs, ["capture_id"], ["frame_index"], F.floor(F.col("frame_index") / S.CHUNK), ["signature"])
    return out.select("capture_id", "frame_index", hamming(F.col("signature"), F.col("prev_signature")).alias("distance"))


@query("d3_mean_intensity", f"WITH {CELLS} SELECT frame_id, round(avg(v), 6) AS mean_intensity FROM cells GROUP BY frame_id")
def _(spark, sf):
    return frames(spark, sf).select("frame_id", let(pixels(), S.mean_intensity).alias("mean_intensity"))


@query("d4_scene_change", f"""WITH {PACKED}, prev AS (
  SELECT frame_id, px, lag(px) OVER (PARTITION BY capture_id ORDER BY frame_index) AS qx FROM packed)
SELECT frame_id, CASE WHEN any_value(qx) IS NULL THEN 1.0 ELSE round(sum(abs(px[i] - qx[i])) / 64.0 / 255.0, 6) END AS scene_change
FROM prev, (SELECT unnest(range(1, 65)) AS i) GROUP BY frame_id""")
def _(spark, sf):
    return S.with_scene_change(frames(spark, sf)).select("frame_id", "scene_change")


def scene_frames(spark, sf):
    return frames(spark, sf).select("capture_id", "frame_id", "frame_index", S.scene_thumbnail(pixels(), height(), width()).alias("thumb"))


SCENES = f"""WITH RECURSIVE {PACKED}, ordered AS (
  SELECT capture_id, frame_id, frame_index, px, row_number() OVER (PARTITION BY capture_id ORDER BY frame_index) AS rn FROM packed),
walk AS (
  SELECT capture_id, frame_id, frame_index, rn, px AS ref, true AS kept FROM ordered WHERE rn = 1
  UNION ALL
  SELECT capture_id, frame_id, frame_index, rn, CASE WHEN passes THEN px ELSE ref END, passes FROM (
    SELECT o.capture_id, o.frame_id, o.frame_index, o.rn, o.px, w.ref,
      list_sum(list_transform(range(1, 65), lambda i: abs(o.px[i] - w.ref[i]))) / 64.0 / 255.0 >= 0.12 AS passes
    FROM walk w JOIN ordered o ON o.capture_id = w.capture_id AND o.rn = w.rn + 1))"""


@query("d5_scene_change_sampler", SCENES + " SELECT capture_id, frame_id, CASE WHEN kept THEN 'kept' ELSE 'same_scene' END AS status FROM walk")
def _(spark, sf):
    out = S.select_frames(scene_frames(spark, sf), threshold=0.12, deduplicate=False)
    return out.select("capture_id", "frame_id", "status")


GREEDY = f"""WITH RECURSIVE {DOC_SIGNATURES}, ordered AS (
  SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY frame_index) AS rn FROM sigs),
walk AS (
  SELECT capture_id, frame_index, signature, mean_intensity, rn, false AS dup,
         [{{'s': signature, 'm': mean_intensity, 'f': frame_index}}] AS kept, [{{'s': signature, 'm': mean_intensity, 'f': frame_index}}][:0] AS near
  FROM ordered WHERE rn = 1
  UNION ALL
  SELECT capture_id, frame_index, signature, mean_intensity, rn, len(near) > 0,
         CASE WHEN len(near) > 0 THEN kept ELSE list_append(kept, {{'s': signature, 'm': mean_intensity, 'f': frame_index}}) END, near
  FROM (SELECT o.capture_id, o.frame_index, o.signature, o.mean_intensity, o.rn, w.kept,
          list_filter(w.kept, lambda k: bit_count(xor(k.s, o.signature)) <= 3 AND abs(k.m - o.mean_intensity) <= 4.0) AS near
        FROM walk w JOIN ordered o ON o.capture_id = w.capture_id AND o.rn = w.rn + 1))"""


@query("d6_near_duplicates", GREEDY + """
SELECT capture_id, frame_index, CASE WHEN dup THEN 'duplicate' ELSE 'kept' END AS status FROM walk""")
def _(spark, sf):
    return S.select_frames(signed_documents(spark, sf)).select("capture_id", "frame_index", "status")


@query("d6_duplicate_log", GREEDY + """, options AS (
  SELECT capture_id, frame_index, signature, mean_intensity, unnest(near) AS k FROM walk WHERE dup),
ranked AS (SELECT *, bit_count(xor(k.s, signature)) AS distance, abs(k.m - mean_intensity) AS diff FROM options)
SELECT capture_id, frame_index, k.f AS duplicate_of, CAST(distance AS BIGINT) AS signature_distance, round(diff, 6) AS mean_difference
FROM ranked QUALIFY row_number() OVER (PARTITION BY capture_id, frame_index ORDER BY distance, diff, k.f) = 1""")
def _(spark, sf):
    return S.match_duplicates(S.select_frames(signed_documents(spark, sf)))


@query("j7_near_pairs", f"""WITH {DOC_SIGNATURES}, classes AS (
  SELECT capture_id, signature, mean_intensity, min(frame_index) AS first_, count(*) AS n FROM sigs GROUP BY ALL)
SELECT a.capture_id, a.first_ AS l_first, b.first_ AS r_first, a.n AS l_n, b.n AS r_n,
       CAST(bit_count(xor(a.signature, b.signature)) AS INTEGER) AS distance
FROM classes a JOIN classes b ON a.capture_id = b.capture_id AND a.first_ < b.first_
WHERE bit_count(xor(a.signature, b.signature)) <= 3 AND abs(a.mean_intensity - b.mean_intensity) <= 4.0""")
def _(spark, sf):
    return S.near_pairs(signed_documents(spark, sf)).select(
        "capture_id", "l_first", "r_first", "l_n", "r_n", hamming(F.col("l_signature"), F.col("r_signature")).alias("distance"))


@query("j7_near_clusters", f"""WITH RECURSIVE {DOC_SIGNATURES}, classes AS (
  SELECT capture_id, signature, mean_intensity, min(frame_index) AS first_, count(*) AS n FROM sigs GROUP BY ALL),
links AS (SELECT a.capture_id, a.first_ AS u, b.first_ AS v FROM classes a JOIN classes b ON a.capture_id = b.capture_id
  WHERE bit_count(xor(a.signature, b.signature)) <= 3 AND abs(a.mean_intensity - b.mean_intensity) <= 4.0),
reach AS (SELECT capture_id, first_ AS u, first_ AS v FROM classes
  UNION SELECT r.capture_id, r.u, l.v FROM reach r JOIN links l ON l.capture_id = r.capture_id AND l.u = r.v),
least_reached AS (SELECT capture_id, u, min(v) AS cluster FROM reach GROUP BY ALL)
SELECT c.capture_id, c.first_ AS "first", c.n, l.cluster FROM classes c JOIN least_reached l ON l.capture_id = c.capture_id AND l.u = c.first_""")
def _(spark, sf):
    return S.near_clusters(signed_documents(spark, sf))


CAPPED = GREEDY + """, numbered AS (
  SELECT *, sum(CASE WHEN dup THEN 0 ELSE 1 END) OVER (PARTITION BY capture_id ORDER BY rn) AS kept_so_far FROM walk),
looked_at AS (SELECT * FROM numbered WHERE kept_so_far < 100 OR (kept_so_far = 100 AND NOT dup))"""


@query("d7_max_frames", CAPPED + " SELECT capture_id, frame_index, CASE WHEN dup THEN 'duplicate' ELSE 'kept' END AS status FROM looked_at")
def _(spark, sf):
    return S.cap_selection(S.select_frames(signed_documents(spark, sf)), 100).select("capture_id", "frame_index", "status")


@query("d8_sampling_diagnostics", GREEDY + """
SELECT capture_id, count(*) AS available_frames, count(*) FILTER (WHERE NOT dup) AS selected_frames,
  count(*) FILTER (WHERE dup) AS duplicate_frames_skipped,
  coalesce(string_agg(CAST(frame_index AS VARCHAR), ',' ORDER BY frame_index) FILTER (WHERE dup AND dup_rank <= 1000), '') AS duplicates
FROM (SELECT *, sum(CASE WHEN dup THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id ORDER BY rn) AS dup_rank FROM walk)
GROUP BY capture_id""")
def _(spark, sf):
    out = S.sampling_diagnostics(S.select_frames(signed_documents(spark, sf)))
    return out.withColumn("duplicates", F.concat_ws(",", F.col("duplicates").cast("array<string>")))


@query("d9_dense_numbering", f"""WITH {FRAMES}
SELECT frame_index, format('{{}}-frame-{{:06d}}', capture_id, row_number() OVER (PARTITION BY capture_id ORDER BY frame_index) - 1) AS frame_id
FROM frames""")
def _(spark, sf):
    kept = frames(spark, sf).select("capture_id", "frame_index")
    return S.number_frames(kept).select("frame_index", "frame_id")


@query("d10_media_timestamp", """SELECT event_id, CASE WHEN user_id % 4 > 0
  THEN CAST(floor(event_id / CAST(CASE user_id % 4 WHEN 1 THEN 24.0 WHEN 2 THEN 29.97 ELSE 60.0 END AS DOUBLE) * 1000) AS BIGINT) END AS timestamp_ms FROM events""")
def _(spark, sf):
    kind = F.col("user_id") % 4
    fps = F.when(kind == 1, 24.0).when(kind == 2, 29.97).when(kind == 3, 60.0).otherwise(0.0)
    return table(spark, sf, "events").select("event_id", S.timestamp_ms(F.col("event_id"), fps).alias("timestamp_ms"))


@query("d12_neighbourhood", f"""WITH {FRAMES}, placed AS (
  SELECT capture_id, frame_id, row_number() OVER (PARTITION BY capture_id ORDER BY frame_index) - 1 AS position FROM frames)
SELECT a.frame_id, a.position, string_agg(b.frame_id, ',' ORDER BY b.position) AS neighbours
FROM placed a JOIN placed b ON a.capture_id = b.capture_id AND b.position BETWEEN a.position - 10 AND a.position + 10 GROUP BY ALL""")
def _(spark, sf):
    out = S.neighbourhood(frames(spark, sf), 10)
    return out.select("frame_id", "position", F.concat_ws(",", "neighbours").alias("neighbours"))


# --- preprocessing steps -----------------------------------------------------------------


def step_query(name, steps, sql, source=frames):
    @query(name, sql)
    def _(spark, sf):
        return cells(P.apply_steps(source(spark, sf), steps))


@query("g1_grayscale", f"""WITH {PACKED}
SELECT frame_id, y, x, CAST((114 * px[y * 8 + x + 1] + 587 * px[(y * 8 + x + 1) % 64 + 1] + 299 * px[(y * 8 + x + 2) % 64 + 1] + 500) // 1000 AS INTEGER) AS v
FROM packed, ys, xs""")
def _(spark, sf):
    return cells(P.apply_steps(in_colour(frames(spark, sf)), ["grayscale"]))


GAUSS5 = """taps AS (SELECT * FROM (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) t(d, w)),
blurred AS (SELECT frame_id, y, x, CAST(floor((sum(a.w * b.w * {p}) + 128) / 256.0) AS INTEGER) AS v
  FROM packed, ys, xs, taps a, taps b GROUP BY frame_id, y, x)""".replace("{p}", at(mirrored("y + a.d"), mirrored("x + b.d")))

step_query("g2_gaussian_blur", ["gaussian_blur"], f"WITH {PACKED}, {GAUSS5} SELECT {CELL_OUT} FROM blurred")
step_query("g3_otsu_threshold", ["otsu_threshold"], f"""WITH {CELLS}, {otsu_sql()}
SELECT frame_id, y, x, CAST(CASE WHEN v > t THEN 255 ELSE 0 END AS INTEGER) AS v FROM cells JOIN otsu USING (frame_id)""")
step_query("g4_threshold_128", ["threshold_128"], f"WITH {CELLS} SELECT frame_id, y, x, CAST(CASE WHEN v > 128 THEN 255 ELSE 0 END AS INTEGER) AS v FROM cells")


def adaptive_sql(size, offset):
    sigma = f"(0.3 * (({size} - 1) * 0.5 - 1) + 0.8)"
    r = size // 2
    return f"""WITH {PACKED}, raw AS (SELECT d, exp(-(d * d) / (2 * {sigma} * {sigma})) AS w FROM (SELECT unnest(range(-{r}, {r + 1})) AS d)),
taps AS (SELECT d, w / sum(w) OVER () AS w FROM raw),
along AS (SELECT frame_id, y, x, sum(w * {at('y', repeated('x + d'))}) AS s FROM packed, ys, xs, taps GROUP BY ALL),
lines AS (SELECT frame_id, x, list(s ORDER BY y) AS col FROM along GROUP BY ALL),
means AS (SELECT frame_id, y, x, floor(sum(w * col[{repeated('y + d')} + 1]) + 0.5) AS m FROM lines, ys, taps GROUP BY frame_id, y, x)
SELECT frame_id, y, x, CAST(CASE WHEN {at('y', 'x')} > m - {offset} THEN 255 ELSE 0 END AS INTEGER) AS v FROM means JOIN packed USING (frame_id)"""


step_query("g5_adaptive_threshold", ["adaptive_threshold"], adaptive_sql(31, 5))
step_query("g5_adaptive_threshold_15", ["adaptive_threshold_15"], adaptive_sql(15, 5))
step_query("g6_histogram_equalization", ["histogram_equalization"], f"""WITH {CELLS}, hist AS (SELECT frame_id, v, count(*) AS c FROM cells GROUP BY ALL),
cum AS (SELECT frame_id, v, sum(c) OVER (PARTITION BY frame_id ORDER BY v) AS n, sum(c) OVER (PARTITION BY frame_id) AS total,
               first_value(c) OVER (PARTITION BY frame_id ORDER BY v) AS f FROM hist),
lut AS (SELECT frame_id, v, CASE WHEN total = f THEN v ELSE floor(CAST(n - f AS DOUBLE) * 255.0 / CAST(total - f AS DOUBLE) + 0.5) END AS nv FROM cum)
SELECT frame_id, y, x, CAST(nv AS INTEGER) AS v FROM cells JOIN lut USING (frame_id, v)""")
step_query("g7_clahe", ["clahe"], None, mosaics)
step_query("g8_invert", ["invert"], f"WITH {CELLS} SELECT frame_id, y, x, CAST(255 - v AS INTEGER) AS v FROM cells")
step_query("g9_sharpen", ["sharpen"], f"""WITH {PACKED} SELECT frame_id, y, x, CAST(least(255, greatest(0, 5 * {at('y', 'x')}
  - {at(mirrored('y - 1'), 'x')} - {at(mirrored('y + 1'), 'x')} - {at('y', mirrored('x - 1'))} - {at('y', mirrored('x + 1'))})) AS INTEGER) AS v
FROM packed, ys, xs""")


def _sobel(dy, dx, n=8):
    return at(repeated(f"y + {dy}", n), repeated(f"x + {dx}", n), n=n)


def canny_sql(low, high, packed=PACKED, n=8):
    sobel = functools.partial(_sobel, n=n)
    gx = f"({sobel(-1, 1)} + 2 * {sobel(0, 1)} + {sobel(1, 1)}) - ({sobel(-1, -1)} + 2 * {sobel(0, -1)} + {sobel(1, -1)})"
    gy = f"({sobel(1, -1)} + 2 * {sobel(1, 0)} + {sobel(1, 1)}) - ({sobel(-1, -1)} + 2 * {sobel(-1, 0)} + {sobel(-1, 1)})"
    return f"""{packed}, grad AS (SELECT frame_id, y, x, {gx} AS gx, {gy} AS gy FROM packed, ys, xs),
mags AS (SELECT *, abs(gx) + abs(gy) AS m FROM grad),
aimed AS (SELECT *, CASE WHEN abs(gy) < abs(gx) * tan(radians(22.5)) THEN 'flat'
                         WHEN abs(gy) > abs(gx) * (tan(radians(22.5)) + 2.0) THEN 'steep' ELSE 'diagonal' END AS way,
                 CASE WHEN (gx < 0) <> (gy < 0) THEN -1 ELSE 1 END AS side FROM mags),
sided AS (SELECT c.*, coalesce(a.m, 0) AS ma, coalesce(b.m, 0) AS mb FROM aimed c
  LEFT JOIN mags a ON a.frame_id = c.frame_id AND a.y = c.y - (CASE WHEN way = 'flat' THEN 0 ELSE 1 END)
    AND a.x = c.x - (CASE way WHEN 'flat' THEN 1 WHEN 'steep' THEN 0 ELSE side END)
  LEFT JOIN mags b ON b.frame_id = c.frame_id AND b.y = c.y + (CASE WHEN way = 'flat' THEN 0 ELSE 1 END)
    AND b.x = c.x + (CASE way WHEN 'flat' THEN 1 WHEN 'steep' THEN 0 ELSE side END)),
thin AS (SELECT frame_id, y, x, m > {high} AS strong FROM sided
  WHERE m > {low} AND m > ma AND (CASE WHEN way = 'diagonal' THEN m > mb ELSE m >= mb END)),
linked AS (SELECT frame_id, y, x FROM thin WHERE strong
  UNION SELECT t.frame_id, t.y, t.x FROM linked l JOIN thin t ON t.frame_id = l.frame_id AND abs(t.y - l.y) <= 1 AND abs(t.x - l.x) <= 1),
edge_cells AS (SELECT p.frame_id, ys.y, xs.x, CAST(CASE WHEN l.frame_id IS NULL THEN 0 ELSE 255 END AS INTEGER) AS v
  FROM packed p CROSS JOIN ys CROSS JOIN xs LEFT JOIN linked l ON l.frame_id = p.frame_id AND l.y = ys.y AND l.x = xs.x)"""


step_query("g10_canny_edges", ["canny_edges"], f"WITH RECURSIVE {canny_sql(50, 150)} SELECT {CELL_OUT} FROM edge_cells")
step_query("g10_canny_low", ["canny_low"], f"WITH RECURSIVE {canny_sql(25, 100)} SELECT {CELL_OUT} FROM edge_cells")
step_query("g10_canny_high", ["canny_high"], f"WITH RECURSIVE {canny_sql(100, 220)} SELECT {CELL_OUT} FROM edge_cells")


def box_sql(source, out, pick, lo, hi):
    """Box minimum or maximum; cells outside do not take part."""
    return f"""{out} AS (SELECT c.frame_id, c.y, c.x, {pick}(n.v) AS v FROM {source} c JOIN {source} n
  ON n.frame_id = c.frame_id AND n.y BETWEEN c.y + ({lo}) AND c.y + ({hi}) AND n.x BETWEEN c.x + ({lo}) AND c.x + ({hi}) GROUP BY c.frame_id, c.y, c.x)"""


step_query("g11_morph_close", ["morph_close_2"], f"WITH {CELLS}, {box_sql('cells', 'grown', 'max', -1, 0)}, {box_sql('grown', 'shut', 'min', -1, 0)} SELECT {CELL_OUT} FROM shut")
step_query("g11_morph_open", ["morph_open_2"], f"WITH {CELLS}, {box_sql('cells', 'shrunk', 'min', -1, 0)}, {box_sql('shrunk', 'opened', 'max', -1, 0)} SELECT {CELL_OUT} FROM opened")
step_query("g11_morph_gradient", ["morph_gradient_3"], f"""WITH {CELLS}, {box_sql('cells', 'grown', 'max', -1, 1)}, {box_sql('cells', 'shrunk', 'min', -1, 1)}
SELECT frame_id, y, x, CAST(g.v - s.v AS INTEGER) AS v FROM grown g JOIN shrunk s USING (frame_id, y, x)""")
step_query("g17_morph_close_3", ["morph_close_3"], f"WITH {CELLS}, {box_sql('cells', 'grown', 'max', -1, 1)}, {box_sql('grown', 'shut', 'min', -1, 1)} SELECT {CELL_OUT} FROM shut")

# Cubic weights (a = -0.75) of the four source cells around a target cell.
CUBIC = """dist AS (SELECT i, k, abs((i + 0.5) / 2 - 0.5 - (floor((i + 0.5) / 2 - 0.5) + k)) AS t,
    CAST(least(greatest(floor((i + 0.5) / 2 - 0.5) + k, 0), 7) AS INTEGER) AS src
  FROM (SELECT unnest(range(16)) AS i), (SELECT unnest(range(-1, 3)) AS k)),
taps AS (SELECT i, src, CASE WHEN t <= 1 THEN (1.25 * t - 2.25) * t * t + 1 ELSE ((-0.75 * t + 3.75) * t - 6.0) * t + 3.0 END AS w FROM dist)"""
step_query("g12_resize_2x", ["resize_2x"], f"""WITH {PACKED}, {CUBIC}
SELECT frame_id, CAST(a.i AS INTEGER) AS y, CAST(b.i AS INTEGER) AS x,
  CAST(least(255, greatest(0, floor(sum(a.w * b.w * px[a.src * 8 + b.src + 1]) + 0.5))) AS INTEGER) AS v
FROM packed, taps a, taps b GROUP BY frame_id, a.i, b.i""")


def _profile_sql(profile):
    rows = []
    for i, (name, steps) in enumerate(P.PROFILES[profile]):
        listed, spaced = ",".join(f'"{s}"' for s in steps), " ".join(steps)
        rows.append(f"('{profile}', {i}, '{name}', '{spaced}', '{{\"profile\":\"{profile}\",\"variant\":{{\"name\":\"{name}\",\"steps\":[{listed}]}}}}')")
    return f"variants(profile, ordinal, variant, steps, def) AS (VALUES {', '.join(rows)})"


def _crossed(spark, sf, profile):
    samples = table(spark, sf, "orders").select("o_orderkey")
    listed = P.variants(spark, profile)
    # The variant list is a fixed 5 or 19 entries; it rides along as one array.
    packed = listed.agg(F.array_sort(F.collect_list(F.struct("ordinal", "profile", "variant", "steps", "hash")))).scalar()
    return samples.withColumn("v", F.explode(packed)).select("o_orderkey", "v.*")


@query("g13_profile_baseline", f"""WITH {_profile_sql('baseline')} SELECT o_orderkey, ordinal, variant, steps FROM orders, variants""")
def _(spark, sf):
    return _crossed(spark, sf, "baseline").select("o_orderkey", "ordinal", "variant", F.concat_ws(" ", "steps").alias("steps"))


@query("g13_profile_wide", f"""WITH {_profile_sql('wide')} SELECT o_orderkey, count(*) AS variants, string_agg(variant, ',' ORDER BY ordinal) AS names
FROM orders, variants GROUP BY o_orderkey""")
def _(spark, sf):
    return _crossed(spark, sf, "wide").groupBy("o_orderkey").agg(
        F.count(F.lit(1)).alias("variants"),
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "variant"))), lambda s: s["variant"])).alias("names"))


@query("g14_variant_hash", f"WITH {_profile_sql('baseline')} SELECT o_orderkey, variant, sha256(def) AS hash FROM orders, variants")
def _(spark, sf):
    return _crossed(spark, sf, "baseline").select("o_orderkey", "variant", "hash")


step_query("g15_median_blur", ["median_5"], f"""WITH {PACKED}, offs AS (SELECT unnest(range(-2, 3)) AS d),
near AS (SELECT frame_id, y, x, list_sort(list({at(repeated('y + a.d'), repeated('x + b.d'))})) AS l FROM packed, ys, xs, offs a, offs b GROUP BY frame_id, y, x)
SELECT frame_id, y, x, CAST(l[13] AS INTEGER) AS v FROM near""")
step_query("g16_bilateral", ["bilateral"], f"""WITH {PACKED}, offs AS (SELECT unnest(range(-4, 5)) AS d),
near AS (SELECT frame_id, y, x, {at(mirrored('y + a.d'), mirrored('x + b.d'))} AS n, {at('y', 'x')} AS c, a.d * a.d + b.d * b.d AS r2
  FROM packed, ys, xs, offs a, offs b WHERE a.d * a.d + b.d * b.d <= 16),
weighed AS (SELECT frame_id, y, x, n, exp(-r2 / (2.0 * 75 * 75)) * exp(-((n - c) * (n - c)) / (2.0 * 75 * 75)) AS w FROM near)
SELECT frame_id, y, x, CAST(floor(sum(w * n) / sum(w) + 0.5) AS INTEGER) AS v FROM weighed GROUP BY frame_id, y, x""")


@query("g18_text_preparation")
def _(spark, sf):
    out = P.expand_variants(frames(spark, sf).select("frame_id", "pixels", "height", "width"), "text_preparation")
    return P.to_cells(out, "frame_id", "variant")


step_query("g18_blur_otsu", ["gaussian_blur", "otsu_threshold"], f"""WITH {PACKED}, {GAUSS5}, {otsu_sql('blurred')}
SELECT frame_id, y, x, CAST(CASE WHEN v > t THEN 255 ELSE 0 END AS INTEGER) AS v FROM blurred JOIN otsu USING (frame_id)""")


@query("j1_variant_cross", f"""WITH {PACKED}, {otsu_sql()},
gray AS (SELECT frame_id, 'grayscale' AS variant, sum(v) AS total FROM cells GROUP BY 1),
otsued AS (SELECT frame_id, 'threshold_128' AS variant, sum(CASE WHEN v > 128 THEN 255 ELSE 0 END) AS total FROM cells GROUP BY 1)
SELECT frame_id, variant, CAST(total AS BIGINT) AS total FROM gray UNION ALL SELECT frame_id, variant, CAST(total AS BIGINT) FROM otsued""")
def _(spark, sf):
    out = P.expand_variants(frames(spark, sf).select("frame_id", "pixels", "height", "width"), "wide")
    total = F.aggregate("pixels", F.lit(0).cast("bigint"), lambda a, v: a + v)
    return out.filter(F.col("variant").isin("grayscale", "threshold_128")).select("frame_id", "variant", total.alias("total"))


@query("j1_wide_variants")
def _(spark, sf):
    out = P.expand_variants(frames(spark, sf).select("frame_id", "pixels", "height", "width"), "wide")
    return out.select("frame_id", "variant", "height", "width", F.sha2(F.concat_ws(",", F.col("pixels").cast("array<string>")), 256).alias("sha256"))
