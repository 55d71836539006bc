"""Grid steps, detectors and selection against small brute-force versions."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalblind.functions import grids
from signalblind.functions.columns import let
from signalblind.operators import controls as K, crossframe as X, detectors as D, preprocess as P, sampling as S
from signalblind.sources import media
from signalblind.sources.tables import document_signatures


def frame(spark, *arrays, **extra):
    rows = [(f"f{i}", i, a.shape[0], a.shape[1], [int(v) for v in a.ravel()]) for i, a in enumerate(arrays)]
    df = spark.createDataFrame(rows, "frame_id string, frame_index bigint, height int, width int, pixels array<int>")
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def pixels_of(df):
    return [np.array(r.pixels).reshape(r.height, r.width) for r in df.orderBy("frame_id").collect()]


def noise(h, w, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w))


def grating(h=180, w=320):
    return np.tile(((np.sin(2 * np.pi * np.arange(w) / 16) + 1) * 110 + 20).astype(int), (h, 1))


def test_steps_handle_shapes_that_are_not_square(spark):
    a = noise(5, 9)
    df = frame(spark, a)
    assert (pixels_of(P.apply_steps(df, ["invert"]))[0] == 255 - a).all()
    pad = np.pad(a, 2, mode="reflect")
    kernel = np.outer([1, 4, 6, 4, 1], [1, 4, 6, 4, 1])
    want = np.array([[(pad[y:y + 5, x:x + 5] * kernel).sum() for x in range(9)] for y in range(5)])
    assert (pixels_of(P.apply_steps(df, ["gaussian_blur"]))[0] == (want + 128) // 256).all()
    near = np.pad(a, 2, mode="edge")
    med = np.array([[np.median(near[y:y + 5, x:x + 5]) for x in range(9)] for y in range(5)])
    assert (pixels_of(P.apply_steps(df, ["median_5"]))[0] == med).all()


def test_resize_doubles_the_frame(spark):
    out = P.apply_steps(frame(spark, np.full((4, 6), 77)), ["resize_2x"]).first()
    assert (out.height, out.width, set(out.pixels)) == (8, 12, {77})


def clahe(img, tiles=8, clip=2.0):
    """Plain loops: clipped tile tables, blended between tile centres."""
    th, tw = img.shape[0] // tiles, img.shape[1] // tiles
    luts = np.zeros((tiles, tiles, 256))
    for ty, tx in np.ndindex(tiles, tiles):
        h = np.bincount(img[ty * th:(ty + 1) * th, tx * tw:(tx + 1) * tw].ravel(), minlength=256)
        limit = max(int(clip * th * tw / 256), 1)
        over = np.maximum(h - limit, 0).sum()
        h = np.minimum(h, limit) + over // 256
        rest = over % 256
        step = max(256 // rest, 1) if rest else 1
        for i in range(rest):
            h[i * step] += 1
        luts[ty, tx] = np.clip(np.floor(np.cumsum(h) * 255 / (th * tw) + 0.5), 0, 255)
    out = np.zeros(img.shape, int)
    clamp = lambda i: min(max(i, 0), tiles - 1)
    for y, x in np.ndindex(img.shape):
        fy, fx = y / th - 0.5, x / tw - 0.5
        y1, x1 = int(np.floor(fy)), int(np.floor(fx))
        wy, wx, v = fy - y1, fx - x1, img[y, x]
        upper = luts[clamp(y1), clamp(x1), v] * (1 - wx) + luts[clamp(y1), clamp(x1 + 1), v] * wx
        lower = luts[clamp(y1 + 1), clamp(x1), v] * (1 - wx) + luts[clamp(y1 + 1), clamp(x1 + 1), v] * wx
        out[y, x] = np.floor(upper * (1 - wy) + lower * wy + 0.5)
    return out


def test_clahe_matches_plain_loops(spark):
    busy, smooth = noise(64, 80, 6), (np.indices((48, 64)).sum(axis=0) * 2) % 256
    for got, img in zip(pixels_of(P.apply_steps(frame(spark, busy, smooth), ["clahe"])), (busy, smooth)):
        assert (got == clahe(img)).all()


def test_unknown_step_and_profile_are_refused(spark):
    with pytest.raises(ValueError):
        P.apply_steps(frame(spark, noise(4, 4)), ["emboss"])
    with pytest.raises(ValueError):
        P.expand_variants(frame(spark, noise(4, 4)), "narrow")


def test_profiles_have_their_variants(spark):
    assert P.variants(spark, "baseline").count() == 5
    assert P.variants(spark, "wide").count() == 19


def test_registered_step_and_variants_in_one_scan(spark):
    P.register_step("halve", lambda df: df.withColumn("pixels", F.transform("pixels", lambda v: F.floor(v / 2).cast("int"))))
    a = noise(4, 4)
    assert (pixels_of(P.apply_steps(frame(spark, a), ["halve"]))[0] == a // 2).all()
    plan = P.expand_variants(frame(spark, a), "wide")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan ") == 1


@pytest.mark.parametrize("profile", ["baseline", "wide", "text_preparation"])
def test_variants_equal_their_steps(spark, profile):
    df = frame(spark, noise(16, 24, 1), noise(9, 9, 2))
    both = {(r.frame_id, r.variant): (r.height, r.width, r.pixels) for r in P.expand_variants(df, profile).collect()}
    assert len(both) == 2 * len(P.PROFILES[profile])
    for name, steps in P.PROFILES[profile]:
        for r in P.apply_steps(df, steps).collect():
            assert both[r.frame_id, name] == (r.height, r.width, r.pixels), name


def test_detection_does_not_shuffle_frames(spark):
    plan = D.measure(frame(spark, noise(8, 8)), ["frame_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_packed_masks_round_trip(spark):
    a = (noise(7, 11) > 128).astype(int)
    row = frame(spark, a).select(grids.pack_bits(F.col("pixels")).alias("w")).select(
        F.transform(F.sequence(F.lit(0), F.lit(76)), lambda i: grids.bit_at(F.col("w"), i, F.lit(77))).alias("b")).first()
    assert row.b == a.ravel().tolist()


def flood(dark):
    h, w = dark.shape
    label, boxes = np.zeros((h, w), int), []
    for y in range(h):
        for x in range(w):
            if dark[y, x] and not label[y, x]:
                stack, cells = [(y, x)], []
                label[y, x] = 1
                while stack:
                    cy, cx = stack.pop()
                    cells.append((cy, cx))
                    for ny in range(max(0, cy - 1), min(h, cy + 2)):
                        for nx in range(max(0, cx - 1), min(w, cx + 2)):
                            if dark[ny, nx] and not label[ny, nx]:
                                label[ny, nx] = 1
                                stack.append((ny, nx))
                ys, xs = zip(*cells)
                boxes.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(cells)))
    return sorted(boxes)


def test_components_match_flood_fill(spark):
    arrays = [np.where(np.random.default_rng(s).random((13, 21)) < 0.45, 0, 255) for s in range(4)]
    spiral = np.full((15, 15), 255)
    for r in range(0, 7, 2):
        spiral[r, r:15 - r] = spiral[r:15 - r, 14 - r] = spiral[14 - r, r:15 - r] = 0
        spiral[r + 2:15 - r, r] = 0
    arrays.append(spiral)
    got = {}
    for r in D.components(frame(spark, *arrays), ["frame_id"], min_area=1).collect():
        got.setdefault(r.frame_id, []).append((r.x, r.y, r.w, r.h, r.area))
    for i, a in enumerate(arrays):
        assert sorted(got[f"f{i}"]) == flood(a == 0)


def test_enclosed_regions_are_not_candidates(spark):
    ring = np.full((40, 40), 255)
    ring[5:30, 5:30] = 0
    ring[8:27, 8:27] = 255
    ring[12:20, 12:20] = 0
    rois = D.candidate_rois(frame(spark, ring), ["frame_id"]).collect()
    assert [(r.x, r.y, r.width, r.height, r.area) for r in rois] == [(1, 1, 33, 33, 625)]


def test_line_evidence_finds_a_long_edge(spark):
    a = np.zeros((80, 120))
    a[40:, :] = 255
    lines = D.hough_lines(D.edges(frame(spark, a)), ["frame_id"]).collect()
    assert any(r.theta == 90 and r.votes >= 100 and r.length >= 100 for r in lines)


def test_votes_and_runs_by_plain_loops(spark):
    rng = np.random.default_rng(8)
    edge = (rng.random((30, 45)) < 0.2) * 255
    edge[12, 3:20] = edge[12, 31:44] = 255
    empty = np.zeros((6, 7))
    on = {}
    for y, x in zip(*np.nonzero(edge)):
        for d in range(180):
            c, s = np.cos(np.radians(d)), np.sin(np.radians(d))
            on.setdefault((d, int(np.floor(x * c + y * s + 0.5))), []).append((y * c - x * s, y, x))
    df = frame(spark, edge, empty)
    votes = {(r.frame_id, r.theta, r.rho): r.votes for r in D.hough_votes(df, ["frame_id"], 15).collect()}
    assert votes == {("f0", *k): len(v) for k, v in on.items() if len(v) >= 15}
    want = []
    for (d, rho), cells in on.items():
        cells, run, number = sorted(cells), [], 0
        for cell in [*cells, None] if len(cells) >= 15 else []:
            if run and (cell is None or cell[0] - run[-1][0] > 8):
                length = np.hypot(run[-1][2] - run[0][2], run[-1][1] - run[0][1])
                want += [(-len(cells), d, rho, number, round(length, 6))] if length >= 10 else []
                run, number = [], number + 1
            run.append(cell)
    got = D.hough_lines(df, ["frame_id"], votes=15, k=10**6).orderBy("rank").collect()
    assert [(r.frame_id, -r.votes, r.theta, r.rho, round(r.length, 6)) for r in got] == [("f0", a, d, rho, n) for a, d, rho, _, n in sorted(want)]
    assert [(r.line_count, r.mean_line_length) for r in D.line_evidence(df, ["frame_id"], votes=10**6).collect()] == [(0, 0.0)] * 2


def test_spectrum_of_a_grating_stands_out(spark):
    out = D.spectrum(frame(spark, grating()), ["frame_id"]).first()
    assert out.prominence >= 8.0 and abs(out.angle) in (0.0, 180.0)


def test_local_contrast_of_rayleigh_noise(spark):
    a = np.clip(np.random.default_rng(314).rayleigh(70, (90, 160)), 0, 255).astype(int)
    out = D.speckle(frame(spark, a), ["frame_id"]).first()
    assert 0.3 <= out.contrast_mean <= 1.5


def test_registration_recovers_a_shift(spark):
    base = np.random.default_rng(5).integers(0, 255, (96, 128)).astype(float)
    base = sum(np.roll(base, (dy, dx), (0, 1)) for dy in range(3) for dx in range(3)) / 9
    moved = np.roll(base, (4, 7), (0, 1))
    df = frame(spark, base.astype(int), moved.astype(int), capture_id="c")
    out = {r.frame_id: r for r in X.registration(df, ["capture_id"], [F.col("frame_index")], "frame_id").collect()}
    assert (out["f0"].shift_x, out["f0"].response) == (0.0, 0.0)
    assert abs(abs(out["f1"].shift_x) - 7) < 0.5 and abs(abs(out["f1"].shift_y) - 4) < 0.5 and out["f1"].response >= 0.5


def test_persistence_across_shapes_and_chunks(spark):
    arrays = [np.where(np.random.default_rng(s).random((6, 8)) < 0.5, 20, 200) for s in range(9)]
    df = frame(spark, *arrays, capture_id="c")
    whole = {r.frame_id: r.persistence_score for r in X.persistence(df, ["capture_id"], [F.col("frame_index")], "frame_id").collect()}
    split = {r.frame_id: r.persistence_score for r in X.persistence(
        df, ["capture_id"], [F.col("frame_index")], "frame_id", bucket=F.floor(F.col("frame_index") / 2)).collect()}
    masks = [a > 100 for a in arrays]
    iou = [0.0] + [(masks[i] & masks[i - 1]).sum() / (masks[i] | masks[i - 1]).sum() for i in range(1, 9)]
    want = {f"f{i}": round(max(iou[i], iou[i + 1] if i < 8 else 0.0), 6) for i in range(9)}
    assert whole == split == pytest.approx(want)
    turned = [arrays[0], np.rot90(arrays[0])]
    assert X.persistence(frame(spark, *turned, capture_id="c"), ["capture_id"], [F.col("frame_index")], "frame_id").count() == 2


def brute_select(rows, threshold, dedup):
    kept, scene, out = [], None, {}
    for pos, sig, mean, thumb in rows:
        thumb = np.array(thumb)
        if threshold is not None and scene is not None and np.abs(scene - thumb).mean() / 255 < threshold:
            out[pos] = "same_scene"
            continue
        if dedup and any(bin((sig ^ s) & (2**64 - 1)).count("1") <= 3 and abs(mean - m) <= 4.0 for s, m in kept):
            out[pos] = "duplicate"
            continue
        kept.append((sig, mean))
        scene = thumb
        out[pos] = "kept"
    return out


@pytest.mark.parametrize("threshold,dedup", [(None, True), (0.08, False), (0.05, True)])
def test_selection_equals_the_sequential_scan(spark, threshold, dedup):
    """A drifting signal makes every decision depend on the ones before, across chunks."""
    rng = random.Random(4)
    rows, sig, level = [], rng.getrandbits(63), 100
    for pos in range(0, 400):
        for _ in range(rng.choice([0, 0, 1, 2])):
            sig ^= 1 << rng.randrange(64)
        signed = sig - 2**64 if sig >= 2**63 else sig
        level = max(0, min(255, level + rng.choice([-20, -5, 0, 5, 20])))
        if rng.random() < 0.3 and rows:
            rows.append((pos * 2, *rows[rng.randrange(len(rows))][1:]))
        else:
            rows.append((pos * 2, signed, float(level), [level] * 4))
    df = spark.createDataFrame([("cap", *r) for r in rows], "capture_id string, frame_index bigint, signature bigint, mean_intensity double, thumb array<int>")
    trace = []
    got = {r.frame_index: r.status for r in S.select_frames(df, threshold=threshold, deduplicate=dedup, chunk=64, trace=trace).collect()}
    assert got == brute_select(rows, threshold, dedup)
    # every round leaves settled chunks behind and scans no more than what is open
    assert all(scanned <= left for left, scanned in trace)
    assert [left for left, _ in trace] == sorted({left for left, _ in trace}, reverse=True)


def test_selection_settles_captures_apart(spark):
    """A capture without anything left to decide is not read again; null captures drop out, empty tables give no rows."""
    still = spark.range(300).selectExpr("'still' capture_id", "id frame_index", "cast(id * 7919 as bigint) signature", "cast(id * 5 as double) mean_intensity")
    same = spark.range(300).selectExpr("'same' capture_id", "id frame_index", "cast(1 as bigint) signature", "2.0 mean_intensity")
    trace = []
    out = S.select_frames(still.unionByName(same), chunk=50, trace=trace)
    kept = {r.capture_id: r["count"] for r in out.filter("status = 'kept'").groupBy("capture_id").count().collect()}
    assert kept == {"still": 300, "same": 1} and out.count() == 600
    # all chunks ran once, then those of the repeated frame; nothing else was scanned
    assert [scanned for _, scanned in trace] == [250, 0]
    assert S.select_frames(same.filter("frame_index < 0")).count() == 0


@pytest.mark.parametrize("drift", [False, True])
def test_many_chunks_take_few_rounds(spark, drift):
    """Scattered and mutually near frames are decided in a few rounds however many chunks there are; drift too is decided rightly."""
    rng = random.Random(9)
    base = [rng.getrandbits(63) for _ in range(60)]
    rows, sig = [], base[0]
    for pos in range(900):
        sig = sig ^ (1 << rng.randrange(63)) if drift else base[rng.randrange(60)] ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(3)))
        rows.append((pos, sig, 50.0 + rng.randrange(3), []))
    df = spark.createDataFrame([("cap", *r[:3]) for r in rows], "capture_id string, frame_index bigint, signature bigint, mean_intensity double")
    trace = []
    got = {r.frame_index: r.status for r in S.select_frames(df, chunk=100 if drift else 10, trace=trace, few_chunks=4).collect()}
    assert got == brute_select(rows, None, True)
    assert drift or len(trace) <= 8


def test_large_group_of_near_frames_is_marked_once(spark):
    """Frames that are all near each other give one mark a frame, in groups beyond the small ones too."""
    df = spark.range(400).selectExpr("'cap' capture_id", "id frame_index", "shiftleft(1L, cast(id % 40 as int)) signature", "cast(id % 3 as double) mean_intensity")
    out = S.select_frames(df, chunk=10, few_chunks=0)
    assert [r.frame_index for r in out.filter("status = 'kept'").collect()] == [0] and out.count() == 400


@pytest.mark.parametrize("threshold", [None, 0.05])
def test_interleaved_captures_are_one_chunk_each(spark, threshold):
    """A chunk is measured in frames of its capture: what fits one is scanned once, whatever lies between."""
    rng = random.Random(6)
    rows = [(f"cap{pos % 8}", pos, rng.getrandbits(6), float(rng.randrange(9)), [rng.randrange(40)] * 4) for pos in range(400)]
    df = spark.createDataFrame(rows, "capture_id string, frame_index bigint, signature bigint, mean_intensity double, thumb array<int>")
    trace = []
    got = {r.frame_index: r.status for r in S.select_frames(df, threshold=threshold, chunk=64, trace=trace, few_chunks=64).collect()}
    want = {}
    for cap in range(8):
        want.update(brute_select([r[1:] for r in rows if r[0] == f"cap{cap}"], threshold, True))
    assert got == want and trace == [(0, 0)]


def test_classes_that_fit_a_chunk_are_scanned_at_once(spark):
    """A drifting capture without room for rounds: one look at what is near, one scan; rows without keys drop out."""
    rng = random.Random(3)
    rows, sig = [], 0
    for pos in range(300):
        sig ^= 1 << rng.randrange(63)
        rows += [(pos * 2, sig, 50.0), (pos * 2 + 1, sig, 50.0)]
    schema = "capture_id string, frame_index bigint, signature bigint, mean_intensity double"
    df = spark.createDataFrame([("cap", *r) for r in rows] + [(None, 1, 1, 1.0), ("cap", None, 1, 1.0)], schema)
    trace = []
    got = {r.frame_index: r.status for r in S.select_frames(df, trace=trace, few_chunks=0).collect()}
    assert got == brute_select([(*r, []) for r in rows], None, True)
    assert len(trace) == 2 and trace[-1] == (0, 0)


def test_many_kept_frames_of_one_key(spark):
    """Kept frames that share a key are too many to be looked at one by one."""
    rng = random.Random(5)
    codes = [sum(0b1111 << 25 + 4 * k for k in range(9) if c >> k & 1) | 0x155 for c in range(512)]
    assert len(codes) > 4 * S.FEW_KEPT
    sigs = [rng.choice(codes) ^ sum(1 << b for b in rng.sample(range(61), rng.choice([0, 0, 1, 2, 4]))) for _ in range(600)]
    rows = [(pos, sig, float(rng.choice([10, 13, 15]))) for pos, sig in enumerate(sigs)]
    df = spark.createDataFrame([("cap", *r) for r in rows], "capture_id string, frame_index bigint, signature bigint, mean_intensity double")
    got = {r.frame_index: r.status for r in S.select_frames(df).collect()}
    assert got == brute_select([(*r, []) for r in rows], None, True)


def test_large_pictures_make_small_chunks(spark, monkeypatch):
    """The cells of a chunk's pictures are bounded, the result is the sequential one."""
    rng = random.Random(2)
    rows = [(pos, rng.getrandbits(6), float(rng.randrange(9)), [rng.randrange(60)] * 16) for pos in range(200)]
    df = spark.createDataFrame([("cap", *r) for r in rows], "capture_id string, frame_index bigint, signature bigint, mean_intensity double, thumb array<int>")
    want = brute_select(rows, 0.05, True)
    for cells, rounds in ((16 * 200, 1), (16 * 50, 2)):
        monkeypatch.setattr(S, "SCAN_CELLS", cells)
        trace = []
        assert {r.frame_index: r.status for r in S.select_frames(df, threshold=0.05, trace=trace).collect()} == want
        assert (len(trace) == 1) == (rounds == 1)


def test_near_signatures_share_one_of_few_keys(spark):
    """Ten keys find all signatures of up to three bits apart; before, twenty did."""
    rng = random.Random(8)
    pairs = [(s, s ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(4)))) for s in (rng.getrandbits(63) for _ in range(200))]
    keys = spark.createDataFrame(pairs, "a bigint, b bigint").select(S._blocking_keys(F.col("a"), 3).alias("a"), S._blocking_keys(F.col("b"), 3).alias("b"))
    found = keys.select(F.size("a").alias("n"), F.arrays_overlap("a", "b").alias("shared")).collect()
    assert all(r.shared and r.n == 10 for r in found)


def test_blocks_hold_every_near_pair(spark):
    """Classes on both sides of a slot's border meet, and only those close to it go to two slots."""
    rng = random.Random(1)
    means = [0.0, 3.9, 4.0, 8.0, 12.0, 15.5, 16.0, 17.0, 20.0, 24.0, 31.9, 32.0, 36.0]
    rows = [(i, rng.getrandbits(3), rng.choice(means) + rng.choice([0.0, 0.0, 1e-9, 4.0, -0.1])) for i in range(200)]
    df = spark.createDataFrame([("cap", *r) for r in rows], "capture_id string, frame_index bigint, signature bigint, mean_intensity double")
    got = {r.frame_index: r.status for r in S.select_frames(df, chunk=20, few_chunks=0).collect()}
    assert got == brute_select([(*r, []) for r in rows], None, True)
    apart = spark.createDataFrame([("cap", 0, 5, 8.0, 0), ("cap", 1, 5, 12.0, 1), ("cap", 2, 5, 15.0, 2)], "capture_id string, frame_index bigint, signature bigint, mean_intensity double, node bigint")
    assert S.near_blocks(apart, "capture_id").count() == 30


def test_document_signatures_without_a_row_a_word(spark, tmp_path):
    """Odd texts, ids and languages against hashing word by word; no row is made for a word."""
    texts = ["a b  a", " ", "", None, "x\ty z\n", "ü ß ü", "word " * 300, "a b"]
    rows = [(i, "de" if i % 2 else "en", t) for i, t in enumerate(texts)]
    rows += [(0, "en", "c"), (0, "fr", "c"), (None, "en", "a"), (None, "en", "b"), (5, None, "a b c"), (5, None, "")]
    spark.createDataFrame(rows, "doc_id bigint, lang string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    counts = {}
    for doc, lang, text in rows:
        for word in filter(None, (text or "").split(" ")):
            bucket = hashlib.md5(word.encode()).digest()[0] // 4
            counts.setdefault((lang, doc), [0] * 64)[bucket] += 1
    want = set()
    for key, c in counts.items():
        bits = sum(1 << (63 - i) for i in range(64) if c[i] * 64 >= sum(c))
        want.add((*key, bits - (1 << 64) if bits >> 63 else bits, float(sum(c))))
    out = document_signatures(spark, str(tmp_path))
    assert out.count() == len(want) and {tuple(r) for r in out.collect()} == want
    assert out.schema.simpleString() == "struct<capture_id:string,frame_index:bigint,signature:bigint,mean_intensity:double>"
    assert "Generate" not in out._jdf.queryExecution().toString()


def test_copies_do_not_multiply_out(spark):
    copies = spark.range(5000).select(F.lit("cap").alias("capture_id"), F.col("id").alias("frame_index"), F.lit(7).cast("bigint").alias("signature"), F.lit(9.0).alias("mean_intensity"))
    assert S.near_pairs(copies).count() == 0
    out = S.select_frames(copies, chunk=1000)
    assert out.filter("status = 'kept'").count() == 1
    assert S.match_duplicates(out).count() == 4999


def test_invalid_plan_is_refused(spark):
    caps = spark.createDataFrame([("c", "quick", None, 0, None, None, None)], "id string, profile string, want_mode string, want_frame_interval int, want_max_frames int, want_deduplicate boolean, want_scene_change_threshold double")
    with pytest.raises(Exception, match="frame_interval must be >= 1"):
        S.resolve_plan(caps, S.profiles(spark)).collect()


def test_signature_of_uneven_frame(spark):
    a = noise(20, 28)
    sig = frame(spark, a).select(let(F.col("pixels"), lambda p: S.signature(p, F.col("height"), F.col("width"))).alias("s")).first().s
    small = np.zeros((8, 8))
    for i in range(8):
        for j in range(8):
            y0, y1, x0, x1 = i * 2.5, i * 2.5 + 2.5, j * 3.5, j * 3.5 + 3.5
            for y in range(20):
                for x in range(28):
                    oy, ox = max(0, min(y1, y + 1) - max(y0, y)), max(0, min(x1, x + 1) - max(x0, x))
                    small[i, j] += oy * ox * a[y, x]
    small = np.floor(small / 8.75 + 0.5)
    want = int("".join("1" if v >= small.mean() else "0" for v in small.ravel()), 2)
    assert sig % 2**64 == want


def test_block_shuffle_keeps_uncovered_cells(spark):
    a = noise(40, 70)
    out = K.matched_controls(frame(spark, a, capture_id="c", role="laser"), "standard").filter("control_type = 'block_shuffle'").first()
    got = np.array(out.pixels).reshape(40, 70)
    order = [i for _, i in sorted((__import__("hashlib").md5(f"12345:{i}".encode()).hexdigest(), i) for i in range(6))]
    want = a.copy()
    for target, source in enumerate(order):
        ty, tx, sy, sx = target // 3 * 32, target % 3 * 32, source // 3 * 32, source % 3 * 32
        block = a[sy:sy + 32, sx:sx + 32]
        view = want[ty:ty + block.shape[0], tx:tx + block.shape[1]]
        view[:] = block[:view.shape[0], :view.shape[1]]
    assert (got == want).all()


def test_colour_frames_keep_their_channels(spark):
    a = np.random.default_rng(4).integers(0, 256, (40, 70, 3))
    df = spark.createDataFrame([("f", "c", "laser", 0, 40, 70, [int(v) for v in a.ravel()])], "frame_id string, capture_id string, role string, frame_index long, height int, width int, pixels array<int>")
    made = {r.control_type: r for r in K.matched_controls(df, "standard").collect()}
    turned = made["rotated"]
    assert (turned.height, turned.width) == (70, 40)
    assert (np.array(turned.pixels).reshape(70, 40, 3) == np.rot90(a, -1)).all()
    order = [i for _, i in sorted((__import__("hashlib").md5(f"12345:{i}".encode()).hexdigest(), i) for i in range(6))]
    want = a.copy()
    for target, source in enumerate(order):
        ty, tx, sy, sx = target // 3 * 32, target % 3 * 32, source // 3 * 32, source % 3 * 32
        block = a[sy:sy + 32, sx:sx + 32]
        view = want[ty:ty + block.shape[0], tx:tx + block.shape[1]]
        view[:] = block[:view.shape[0], :view.shape[1]]
    assert (np.array(made["block_shuffle"].pixels).reshape(40, 70, 3) == want).all()
    cut = P.crop(df, x=5, y=3, width=9, height=4).first()
    assert (np.array(cut.pixels).reshape(4, 9, 3) == a[3:7, 5:14]).all()
    gray = (114 * a[..., 0] + 587 * a[..., 1] + 299 * a[..., 2] + 500) // 1000
    assert (pixels_of(P.apply_steps(df, ["invert"]))[0] == 255 - gray).all()
    with pytest.raises(Exception, match="one or three channels"):
        P.apply_steps(df.withColumn("width", F.lit(71)), ["invert"]).collect()


def test_controls_only_for_laser_frames(spark):
    df = frame(spark, noise(8, 8), capture_id="c", role="control")
    assert K.matched_controls(df, "strict").count() == 0
    assert K.matched_controls(df, "none").count() == 0


def png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].astype("uint8").tobytes() for y in range(h))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_set_scan(spark, tmp_path):
    rgb = np.random.default_rng(1).integers(0, 256, (6, 10, 3))
    png(tmp_path / "b.PNG", rgb)
    png(tmp_path / "a.png", rgb[::-1])
    (tmp_path / "broken.png").write_bytes(b"no image")
    (tmp_path / "notes.txt").write_text("x")
    assert media.list_media(spark, str(tmp_path)).count() == 3
    rows = {r.path.rsplit("/", 1)[1]: r for r in media.read_frames(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["a.png", "b.PNG"]
    assert rows["b.PNG"].pixels == rgb[:, :, ::-1].ravel().tolist()
    gray = P.apply_steps(media.read_frames(spark, str(tmp_path)).filter("path like '%b.PNG'"), ["grayscale"]).first()
    luma = (114 * rgb[:, :, 2] + 587 * rgb[:, :, 1] + 299 * rgb[:, :, 0] + 500) // 1000
    assert gray.pixels == luma.ravel().tolist()


def test_record_hash_ignores_column_order(spark):
    df = spark.createDataFrame([(2, [3, 1])], "b int, a array<int>")
    one, two = (media.record_hash(df, cols).first().record_hash for cols in (["a", "b"], ["b", "a"]))
    import hashlib

    assert one == two == hashlib.sha256(b'{"a":[3,1],"b":2}').hexdigest()


def test_near_clusters_by_plain_search(spark):
    rng = random.Random(4)
    rows = []
    for cap in ("hot", "hot", "hot", "cold", None):
        sig, mean = rng.getrandbits(63), rng.uniform(0, 50)
        for _ in range(60):
            if rng.random() < 0.3:
                sig, mean = rng.getrandbits(63), rng.uniform(0, 50)
            sig ^= 1 << rng.randrange(63) | 1 << rng.randrange(63)
            rows.append((cap, len(rows), sig, mean + rng.uniform(-3, 3)))
            if rng.random() < 0.2:
                rows.append((cap, len(rows), *rows[-1][2:]))
    rows += [("hot", 900, None, 3.0), ("hot", 901, None, 3.0), ("hot", 902, 5, None)]
    df = spark.createDataFrame(rows, "capture_id string, frame_index bigint, signature bigint, mean_intensity double")
    classes = {}
    for cap, i, sig, mean in rows:
        classes.setdefault((cap, sig, mean), []).append(i)
    near = lambda a, b: a[0] == b[0] and None not in a[1:] + b[1:] and (a[1] ^ b[1]).bit_count() <= 3 and abs(a[2] - b[2]) <= 4.0
    want = set()
    for c in classes:
        seen, todo = {c}, [c]
        while todo:
            x = todo.pop()
            more = [y for y in classes if y not in seen and near(x, y)]
            seen.update(more), todo.extend(more)
        want.add((c[0], min(classes[c]), len(classes[c]), min(min(classes[y]) for y in seen)))
    for block in (1024, 7):
        out = S.near_clusters(df, block=block)
        assert {tuple(r) for r in out.collect()} == want and out.count() == len(classes)
    assert len({w[3] for w in want}) < len(classes)
    assert S.near_clusters(df.filter("frame_index < 0")).count() == 0


def test_a_hot_slot_is_many_groups(spark):
    # all classes share their lower bands and their slot
    hot = spark.range(3000).select(F.lit("cap").alias("capture_id"), F.shiftleft("id", 44).alias("signature"), F.lit(9.0).alias("mean_intensity"), F.col("id").cast("string").alias("node"))
    groups = S.near_blocks(hot, "capture_id", block=200).groupBy("_group", "_i", "_j").count()
    busiest = groups.groupBy("_group").agg(F.count("*").alias("groups"), F.sum("count").alias("rows")).orderBy(F.desc("rows")).first()
    assert busiest.groups == 15 * 16 // 2 and groups.agg(F.max("count")).first()[0] < 3 * 200


def test_lines_and_edges_are_handed_on_in_slices(monkeypatch):
    """However many frames a batch has, a task holds the lists of one slice of it."""
    import pyarrow as pa

    from signalblind.functions import lines, stencils

    rng = np.random.default_rng(5)
    cells = [*(rng.random((99, 256)) < 0.4) * 255, np.zeros(256)]
    batch = (pa.array([c.astype("int32") for c in cells], pa.list_(pa.int32())), *[pa.array([16] * 100, pa.int32())] * 2)
    for udf in (lines.vote_lists(6), lines.line_lists(6, 2, 5), stencils.edge_grid(50, 150)):
        whole = list(udf.func(iter([batch])))
        with monkeypatch.context() as m:
            m.setattr(stencils, "SLICE", 2560)
            parts = list(udf.func(iter([batch, tuple(c.slice(0, 0) for c in batch)])))
        assert [len(p) for p in whole] == [100] and [len(p) for p in parts] == [10] * 10
        assert [x for p in parts for x in p.to_pylist()] == whole[0].to_pylist() and any(whole[0].to_pylist()[0])


def test_boxes_and_shifts_of_a_whole_stack(monkeypatch):
    """Boxes of frames of mixed sizes come out as columns, in slices; shifts equal those of single frames."""
    import pyarrow as pa

    from signalblind.functions import features, kernels, stencils

    rng = np.random.default_rng(8)
    sides = [(4, 6), (8, 8), (6, 4), (8, 8), (5, 5)] * 4
    cells = [rng.integers(0, 256, h * w).astype("int32") for h, w in sides]
    batch = (pa.array(cells, pa.list_(pa.int32())), *(pa.array(list(c), pa.int32()) for c in zip(*sides)))
    monkeypatch.setattr(stencils, "SLICE", 200)
    parts = list(features.dark_boxes.func(iter([batch])))
    got = [x for p in parts for x in p.to_pylist()]
    assert len(parts) > 3 and len(got) == 20
    for (h, w), frame_cells, boxes in zip(sides, cells, got):
        left = {(i // w, i % w) for i in np.flatnonzero(features.binary(frame_cells.reshape(1, h, w)).ravel() == 0)}
        want = []
        while left:
            region, open_cells = [], [min(left)]
            left.discard(open_cells[0])
            while open_cells:
                y, x = open_cells.pop()
                region.append((y, x))
                near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
                left -= near
                open_cells += near
            ys, xs = zip(*region)
            want.append((min(ys) * w + min(x for y, x in region if y == min(ys)), min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(region)))
        assert [tuple(b[c] for c in ("label", "x", "y", "w", "h", "area")) for b in boxes] == want
    a, b = rng.random((2, 30, 8, 8)) * 255
    b[::2] = np.roll(a[::2], 2, axis=1)
    alone = np.concatenate([kernels._shift(a[i : i + 1], b[i : i + 1]) for i in range(30)])
    assert np.allclose(kernels._shift(a, b), alone, atol=1e-9)
