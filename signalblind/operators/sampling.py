"""Frame sampling and near-duplicate suppression."""

import functools
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import grids
from ..functions.columns import hamming, let, round6
from ..session import cut, shuffle_partitions
from . import clusters
from .ordering import running_count, with_previous

# Sampling profiles (profile, mode, interval, cap, deduplicate, scene threshold).
SAMPLING_PROFILES = [
    ("quick", "interval", 15, 25, True, 0.12),
    ("baseline", "interval", 5, 250, True, 0.10),
    ("wide", "interval", 2, 1000, True, 0.08),
    ("exhaustive", "all_frames", 1, None, True, 0.05),
]
SAMPLING_SCHEMA = "profile string, mode string, frame_interval int, max_frames int, deduplicate boolean, scene_change_threshold double"

# Sampling modes.
SAMPLING_MODES = ["interval", "all_frames", "capped_all_frames", "scene_change"]

# Frames a single task looks at in order-dependent steps.
CHUNK = 4096


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLING_PROFILES, SAMPLING_SCHEMA)


def resolve_plan(captures: DataFrame, profile_table: DataFrame) -> DataFrame:
    """profile defaults under per-capture overrides (``want_*`` columns), validated.

    The profile table has a fixed handful of rows, so it is broadcast.
    """
    joined = captures.join(F.broadcast(profile_table), "profile", "left")
    pick = lambda name: F.coalesce(F.col(f"want_{name}"), F.col(name))
    mode, interval, cap, threshold = (pick(c) for c in ("mode", "frame_interval", "max_frames", "scene_change_threshold"))
    known = F.col("frame_interval").isNotNull()
    problem = (
        F.when(~known, F.concat(F.lit("unknown sampling profile: "), F.col("profile")))
        .when(~mode.isin(*SAMPLING_MODES), F.concat(F.lit("unknown sampling mode: "), mode))
        .when(interval < 1, F.lit("frame_interval must be >= 1"))
        .when(cap < 1, F.lit("max_frames must be >= 1"))
        .when(~threshold.between(0.0, 1.0), F.lit("scene_change_threshold must be between 0 and 1"))
    )
    every = mode.isin("all_frames", "capped_all_frames")
    checked = F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(mode)
    own = [c for c in captures.columns if not c.startswith("want_")]
    return joined.select(
        *own, checked.alias("mode"),
        F.when(every, 1).otherwise(interval).alias("frame_interval"),
        F.when(mode == "all_frames", F.lit(None).cast("int")).otherwise(cap).alias("max_frames"),
        pick("deduplicate").alias("deduplicate"), threshold.alias("scene_change_threshold"),
    )


def _positions(frames, by, order, name, extra=()):
    """Positions over the key columns alone, so that pixels stay out of the ordering."""
    keys = frames.select(by, order, *extra)
    return running_count(keys, [by], [F.col(order)], F.floor(F.col(order) / CHUNK), name).withColumn(name, F.col(name) - 1)


def _back(frames, keys, by, order):
    """Frames of the given keys; few keys make this a broadcast join."""
    wide = [c for c in frames.columns if c not in keys.columns]
    return frames.join(keys.drop(*[c for c in keys.columns if c in frames.columns and c not in (by, order)]), [by, order]) if wide else keys


def with_position(frames: DataFrame, by="capture_id", order="frame_index", name="position") -> DataFrame:
    """0-based position of every frame in its capture, unreadable ones included."""
    return _back(frames, _positions(frames, by, order, name), by, order)


def interval_sample(frames: DataFrame, k, by="capture_id", order="frame_index") -> DataFrame:
    """every k-th frame. F2 is the same with k = 1. ``k`` is a number or a column name."""
    step, extra = (F.col(k), [k]) if isinstance(k, str) else (F.lit(k), [])
    keys = _positions(frames, by, order, "position", extra).filter(F.col("position") % step == 0)
    return _back(frames, keys, by, order)


def cap_frames(frames: DataFrame, cap: int, by="capture_id", order="frame_index") -> DataFrame:
    """The first ``cap`` frames of each capture."""
    if cap is None:
        return frames
    keys = _positions(frames, by, order, "_p").filter(F.col("_p") < cap)
    return _back(frames, keys, by, order).drop("_p")


def number_frames(frames: DataFrame, by="capture_id", order="frame_index") -> DataFrame:
    """Dense identifiers in accepted order; ``frame_index`` keeps the source position."""
    numbered = with_position(frames, by, order, "_p")
    return numbered.withColumn("frame_id", F.format_string("%s-frame-%06d", F.col(by), F.col("_p"))).drop("_p")


def timestamp_ms(index: Column, fps: Column) -> Column:
    """D10"""
    return F.when(fps > 0, F.floor(index.cast("double") / fps * 1000).cast("long"))


def signature(px: Column, height: Column, width: Column) -> Column:
    """8x8 area means, one bit per cell at or above their mean, first cell highest."""
    small = let(grids.one_channel(px, height, width), lambda p: grids.area_resize(p, height, width, 8, 8))

    def bits(cells):
        total = F.aggregate(cells, F.lit(0), lambda a, v: a + v)
        return let(total, lambda t: F.aggregate(
            cells, F.lit(0).cast("bigint"),
            lambda a, v: F.shiftleft(a, 1).bitwiseOR(F.when(v * 64 >= t, 1).otherwise(0).cast("bigint"))))

    return let(small, bits)


def mean_intensity(px: Column) -> Column:
    """D3"""
    return round6(F.aggregate(px, F.lit(0).cast("bigint"), lambda a, v: a + v) / F.size(px))


def scene_thumbnail(px: Column, height: Column, width: Column) -> Column:
    """64x64 area thumbnail. A grid that divides 64 is kept: repeating its cells
    would leave every mean difference as it is."""
    kept = (F.lit(64) % height == 0) & (F.lit(64) % width == 0)
    return let(grids.one_channel(px, height, width), lambda g: F.when(kept, g).otherwise(grids.area_resize(g, height, width, 64, 64)))


def scene_change(previous: Column, current: Column) -> Column:
    """Mean absolute difference of two thumbnails over 255; no previous frame scores 1."""
    diff = F.aggregate(
        F.zip_with(previous, current, lambda a, b: F.abs(a - b)), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return F.when(previous.isNull(), F.lit(1.0)).otherwise(diff / F.size(current) / 255.0)


def with_scene_change(frames: DataFrame, by="capture_id", order="frame_index") -> DataFrame:
    """D4 against the previous frame of the capture."""
    thumbs = frames.withColumn("thumb", scene_thumbnail(F.col("pixels"), F.col("height"), F.col("width")))
    paired = with_previous(thumbs, [by], [F.col(order)], F.floor(F.col(order) / CHUNK), ["thumb"])
    return paired.withColumn("scene_change", round6(scene_change(F.col("prev_thumb"), F.col("thumb")))).drop("thumb", "prev_thumb")


# --- near duplicates -----------------------------------------------------------------

def _band_masks(max_distance: int) -> list:
    """Masks of signatures (signed); two within ``max_distance`` bits agree under at least one of them.

    d + 2 bands; d differing bits spoil at most d bands, so some two bands agree.
    Keying on two together (25 bits and more at d = 3, ten keys) keeps keys selective.
    """
    if not 0 <= max_distance <= 5:
        raise ValueError("max_distance must be between 0 and 5")
    borders = [64 * i // (max_distance + 2) for i in range(max_distance + 3)]
    bands = [(lo, hi - lo) for lo, hi in itertools.pairwise(borders)]
    masks = (sum(((1 << size) - 1) << start for start, size in chosen) for chosen in itertools.combinations(bands, 2))
    return [mask - (1 << 64) if mask >= 1 << 63 else mask for mask in masks]


def _blocking_keys(sig: Column, max_distance: int) -> Column:
    """Keys two signatures within ``max_distance`` bits must share at least one of."""
    return F.array(*[
        F.struct(F.lit(i).alias("i"), sig.bitwiseAND(F.lit(mask).cast("bigint")).alias("bits"))
        for i, mask in enumerate(_band_masks(max_distance))])


def near_classes(left: DataFrame, right: DataFrame, by: str, max_distance=3, max_mean_diff=4.0) -> DataFrame:
    """Pairs of (signature, mean) classes that are near, ``l_*`` against ``r_*`` columns.

    Both sides hold distinct classes per capture: copies are collapsed before, so a
    group of copies never multiplies out. Exact: blocking only prunes. A class on the left
    goes to the next slots too where it is close to them, so that should be the smaller side.
    """
    reach = max(max_mean_diff, 1e-9)
    width = 4 * reach
    # Classes fan out into many keys, so they are spread evenly first.
    n = shuffle_partitions(left.sparkSession)
    left, right = left.repartition(n, by, "signature"), right.repartition(n, by, "signature")
    slot = F.floor(F.col("mean_intensity") / width).cast("long")
    past = F.col("mean_intensity") - slot * width
    # Half as far again as needed, so rounding cannot part two classes.
    slots = F.array_compact(F.array(slot, F.when(past <= 1.5 * reach, slot - 1), F.when(past >= width - 1.5 * reach, slot + 1)))
    l = left.select(
        F.col(by).alias("l_by"), F.col("signature").alias("l_signature"), F.col("mean_intensity").alias("l_mean"),
        *[F.col(c).alias(f"l_{c}") for c in left.columns if c not in (by, "signature", "mean_intensity")],
        F.explode(_blocking_keys(F.col("signature"), max_distance)).alias("key"), slots.alias("slots")).withColumn(
        "slot", F.explode("slots")).drop("slots")
    r = right.select(
        F.col(by).alias("r_by"), F.col("signature").alias("r_signature"), F.col("mean_intensity").alias("r_mean"),
        *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in (by, "signature", "mean_intensity")],
        F.explode(_blocking_keys(F.col("signature"), max_distance)).alias("r_key"), slot.alias("r_slot"))
    pairs = l.join(r, (l.l_by == r.r_by) & (l.key == r.r_key) & (l.slot == r.r_slot)).filter(
        (hamming(F.col("l_signature"), F.col("r_signature")) <= max_distance)
        & (F.abs(F.col("l_mean") - F.col("r_mean")) <= max_mean_diff))
    # A pair may share several keys; keep the lowest one it shares.
    agree = F.filter(
        F.zip_with(_blocking_keys(F.col("l_signature"), max_distance), _blocking_keys(F.col("r_signature"), max_distance),
                   lambda a, b: F.when(a == b, a["i"])), lambda i: i.isNotNull())
    return pairs.filter(F.col("key.i") == F.array_min(agree)).drop("key", "r_key", "slot", "r_slot", "r_by").withColumnRenamed("l_by", by)


def near_pairs(frames: DataFrame, by="capture_id", order="frame_index", max_distance=3, max_mean_diff=4.0) -> DataFrame:
    """Near pairs of distinct classes with the number of frames in each."""
    classes = frames.groupBy(by, "signature", "mean_intensity").agg(
        F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    return near_classes(classes, classes, by, max_distance, max_mean_diff).filter(F.col("l_first") < F.col("r_first"))


#: Most classes of one blocking key and slot that a task compares with as many others.
NEAR_BLOCK = 1024


def near_blocks(classes: DataFrame, by: str, max_distance=3, max_mean_diff=4.0, block=NEAR_BLOCK, extra=()) -> DataFrame:
    """Classes beside all they may be near to, in groups (``_group``, ``_i``, ``_j``) of at most
    about two blocks; ``extra`` columns come along.

    A class goes to its own slot of every blocking key and, as ``_upper``, to the slot below
    if that ends close to its mean. A key and slot of many classes is dealt into blocks by a hash of the class, and every pair
    of blocks is a group of its own, so one hot slot spreads over many tasks.
    """
    reach = max(max_mean_diff, 1e-9)
    width = 4 * reach
    slot = F.floor(F.col("mean_intensity") / width).cast("long")
    own, below = F.struct(slot.alias("slot"), F.lit(False).alias("upper")), F.struct((slot - 1).alias("slot"), F.lit(True).alias("upper"))
    # Half as far again as needed, so rounding cannot part two classes.
    close = F.col("mean_intensity") - slot * width <= 1.5 * reach
    keyed = classes.withColumn("_at", F.explode(F.when(close, F.array(own, below)).otherwise(F.array(own)))).withColumn(
        "_k", F.explode(_blocking_keys(F.col("signature"), max_distance)))
    placed = keyed.select(by, "signature", "mean_intensity", "node", *extra, F.xxhash64(by, "_k", "_at.slot").alias("_group"), F.col("_at.upper").alias("_upper"))
    sizes = placed.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(~F.col("_upper"), 1)).alias("_own"))
    # Alone, or with classes of the next slot only: those meet in their own slot.
    sizes = sizes.filter("_n > 1 and _own > 0").select("_group", F.ceil(F.col("_n") / block).cast("int").alias("_b"))
    mine = F.pmod(F.xxhash64("node"), F.col("_b")).cast("int")
    dealt = placed.join(sizes, "_group").withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    return dealt.withColumn("_i", F.least("_mine", "_other")).withColumn("_j", F.greatest("_mine", "_other")).drop("_b", "_other")


def _whole_groups(batches):
    """(rows, borders of their groups) of one partition sorted by group, a group never in two pieces."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        keys = pdf[["_group", "_i", "_j"]].to_numpy()
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        whole = cuts[-1] if len(cuts) else 0
        rest = pdf.iloc[whole:].reset_index(drop=True)
        if whole:
            yield pdf, np.append(0, cuts)
    if rest is not None and len(rest):
        yield rest, np.array([0, len(rest)])


def _forest(max_distance, max_mean_diff):
    """Links of the classes of one sorted partition, as (place, smallest place it reaches) inside each group."""

    def reach(sig, mean, upper, who):
        near = np.bitwise_count((sig[:, None] ^ sig[None]).view("uint64")) <= max_distance
        near &= (np.abs(mean[:, None] - mean[None]) <= max_mean_diff) & ~(upper[:, None] & upper[None]) & (who[:, None] == who[None])
        label = np.arange(len(sig))
        while True:
            least = np.minimum(label, np.where(near, label[None], len(sig)).min(axis=1))
            # a root takes over the best label any of its members has seen
            np.minimum.at(least, label, least.copy())
            least = least[least]
            if (least == label).all():
                return label
            label = least

    def run(batches):
        for pdf, borders in _whole_groups(batches):
            yield linked(pdf, borders)

    def linked(pdf, borders):
        sig, mean, upper, who = (pdf[c].to_numpy() for c in ("signature", "mean_intensity", "_upper", "_who"))
        a, b = [], []
        for lo, hi in zip(borders[:-1], borders[1:]):
            if hi - lo > 1:
                label = reach(sig[lo:hi], mean[lo:hi], upper[lo:hi], who[lo:hi])
                moved = np.flatnonzero(label != np.arange(hi - lo))
                a.append(lo + moved), b.append(lo + label[moved])
        a, b = (np.concatenate(x) if x else np.empty(0, int) for x in (a, b))
        node = pdf["node"].to_numpy()
        return pd.DataFrame({"a": node[a], "b": node[b]})

    return run


def near_clusters(frames: DataFrame, by="capture_id", order="frame_index", max_distance=3, max_mean_diff=4.0, block=NEAR_BLOCK) -> DataFrame:
    """(signature, mean) classes of each capture with their cluster: ``by``, first, n, cluster.

    Two classes link when they are near; a cluster is what links reach, named by its smallest
    ``first`` frame. No list of pairs is made: a group of ``near_blocks`` sends one link per
    class at most. ``order`` must be unique per capture. Frames without a signature or mean
    are in clusters of their own class; a null capture is a capture.
    """
    classes = frames.groupBy(by, "signature", "mean_intensity").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    classes = cut(classes.withColumn("node", F.struct(F.col(by).alias("c"), F.col("first").alias("f"))))
    named = classes.withColumn("node", F.to_json("node", {"ignoreNullFields": "false"}))
    blocks = near_blocks(named.filter("signature is not null and mean_intensity is not null"), by, max_distance, max_mean_diff, block)
    n = shuffle_partitions(frames.sparkSession)
    sorted_blocks = blocks.select("_group", "_i", "_j", "signature", "mean_intensity", "_upper", "node", F.xxhash64(by).alias("_who")).repartition(
        n, "_group", "_i", "_j").sortWithinPartitions("_group", "_i", "_j")
    links = sorted_blocks.mapInPandas(_forest(max_distance, max_mean_diff), "a string, b string").distinct()
    found = clusters.connected(links, "a", "b")
    out = named.join(found, "node", "left").select(by, "first", "n", F.coalesce("root", "node").alias("root"))
    least = out.groupBy("root").agg(F.min("first").alias("cluster"))
    return out.join(least, "root").select(by, "first", "n", "cluster")


#: States of a class while ``first_kept`` looks for the classes that are kept.
UNDECIDED, KEPT = 1, 2

#: Groups of at most so many classes are compared all at once, along diagonals.
SMALL_GROUP = 64


def _marks(max_distance, max_mean_diff):
    """(node, mark) of the classes of one sorted partition that are near another one.

    The mark is the highest state among the near classes that come earlier, 0 when all come later.
    """

    def compare(pdf, borders):
        sig, mean, upper, who, first, state = (pdf[c].to_numpy() for c in ("signature", "mean_intensity", "_upper", "_who", "first", "state"))
        mark = np.full(len(pdf), -1, dtype="int32")

        def meet(x, y):
            near = (np.bitwise_count((sig[x] ^ sig[y]).view("uint64")) <= max_distance) & (np.abs(mean[x] - mean[y]) <= max_mean_diff)
            near &= ~(upper[x] & upper[y]) & (who[x] == who[y]) & (first[x] != first[y])
            x, y = x[near], y[near]
            early, late = np.where(first[x] < first[y], x, y), np.where(first[x] < first[y], y, x)
            np.maximum.at(mark, early, 0)
            np.maximum.at(mark, late, state[early])

        sizes = np.diff(borders)
        small = sizes <= SMALL_GROUP
        at = np.concatenate([np.arange(0), *(np.arange(lo, hi) for lo, hi in zip(borders[:-1][small], borders[1:][small]))])
        end = np.repeat(borders[1:][small], sizes[small])
        for step in range(1, SMALL_GROUP):
            inside = at + step < end
            at, end = at[inside], end[inside]
            if not len(at):
                break
            meet(at, at + step)
        for lo, hi in zip(borders[:-1][~small], borders[1:][~small]):
            for x in range(lo, hi - 1):
                y = np.arange(x + 1, hi)
                meet(np.full(len(y), x), y)
        found = mark >= 0
        return pd.DataFrame({"node": pdf["node"].to_numpy()[found], "mark": mark[found]})

    def run(batches):
        for pdf, borders in _whole_groups(batches):
            if len(pdf) > 1:
                yield compare(pdf, borders)

    return run


def _marked(classes, by, max_distance, max_mean_diff):
    """(node, mark) of the classes that are near another one of the table; no pair leaves a task."""
    blocks = near_blocks(classes, by, max_distance, max_mean_diff, extra=("first", "state"))
    dealt = blocks.select("_group", "_i", "_j", "signature", "mean_intensity", "_upper", "node", "first", "state", F.xxhash64(by).alias("_who")).repartition(
        shuffle_partitions(classes.sparkSession), "_group", "_i", "_j").sortWithinPartitions("_group", "_i", "_j")
    return cut(dealt.mapInPandas(_marks(max_distance, max_mean_diff), "node bigint, mark int").groupBy("node").agg(F.max("mark").alias("mark")))


def first_kept(frames: DataFrame, by, order, max_distance, max_mean_diff, chunk, trace=None) -> DataFrame:
    """(``by``, signature, mean_intensity, first, kept) of all classes, as the one-pass scan decides.

    Copies follow the first frame of their class, so only classes are decided. A class near
    no earlier one is kept, one near an earlier kept one is a duplicate; what is near an
    undecided one waits for the next round. After the first round only classes near another
    one take part, and kept ones leave with the last class near them. What fits one chunk a
    capture, or a drifting capture, where few are decided in a round, is left to the scan of
    chunks.
    """
    near = (by, max_distance, max_mean_diff)
    classes = cut(frames.filter(F.col(by).isNotNull()).groupBy(by, "signature", "mean_intensity").agg(F.min(order).alias("first")).withColumn(
        "node", F.monotonically_increasing_id()))
    marks = _marked(classes.withColumn("state", F.lit(UNDECIDED)), *near)
    rest = cut(classes.join(marks, "node").withColumn("state", F.when(F.col("mark") == 0, KEPT).otherwise(UNDECIDED)).drop("mark"))
    dropped, before = [], None
    while True:
        each = rest.groupBy(by).agg(F.count_if(F.col("state") == UNDECIDED).alias("left"), F.count(F.lit(1)).alias("n"))
        left, most, all_left = each.agg(F.sum("left"), F.max("n"), F.sum("n")).first()
        if not left:
            break
        if trace is not None:
            trace.append((left, all_left))
        if most <= chunk or before is not None and left * 2 > before:
            scanned = _scan_chunks(rest.select(by, F.col("first").alias("_first"), "signature", "mean_intensity", "node"), by, "_first", max_distance=max_distance, max_mean_diff=max_mean_diff, chunk=chunk, trace=trace)
            dropped.append(scanned.filter("status = 'duplicate'").select("node"))
            break
        before = left
        marks = _marked(rest, *near).withColumnRenamed("mark", "_mark")
        # Without a mark nothing is near any more, so the class is kept and has no say in later rounds.
        told = cut(rest.join(marks, "node").withColumn("_mark", F.when(F.col("state") == UNDECIDED, F.col("_mark")).otherwise(0)))
        dropped.append(told.filter(F.col("_mark") == KEPT).select("node"))
        rest = told.filter(F.col("_mark") < KEPT).withColumn("state", F.when(F.col("_mark") == UNDECIDED, UNDECIDED).otherwise(KEPT)).drop("_mark")
    if not dropped:
        return classes.drop("node").withColumn("kept", F.lit(True))
    out = functools.reduce(DataFrame.unionByName, dropped).withColumn("_out", F.lit(True))
    return classes.join(out, "node", "left").select(by, "signature", "mean_intensity", "first", F.col("_out").isNull().alias("kept"))


#: Up to so many chunks are scanned at once; more are first decided class by class.
FEW_CHUNKS = 24

#: Frames of a chunk of the scan, unless pictures of so many cells together make it smaller.
SCAN_CHUNK, SCAN_CELLS = 65536, 4096 * 4096

#: Up to so many kept frames that share a key with one are compared one by one, else all kept ones at once.
FEW_KEPT = 64


def _greedy(threshold, deduplicate, update_on_duplicate, max_distance, max_mean_diff, schema):
    """Ordered scan of one bounded chunk, given what earlier chunks left behind.

    ``start`` holds the picture the chunk is compared with at first, if there is one.
    """
    masks = np.array(_band_masks(max_distance) if deduplicate else [], dtype="int64")

    def scan(pdf: pd.DataFrame, start) -> pd.DataFrame:
        pdf = pdf.sort_values("_order")
        sigs, means, hits = (pdf[c].to_numpy() for c in ("signature", "mean_intensity", "_hit"))
        scene = None if start is None or not len(start) else np.asarray(start["_picture"].iloc[0], dtype="int32")
        thumbs = [np.asarray(t, dtype="int32") for t in pdf["thumb"]] if threshold is not None else None
        status = np.zeros(len(pdf), dtype="int32")  # 0 unchanged scene, 1 duplicate, 2 kept
        kept_sig, kept_mean = np.empty(len(pdf), dtype=sigs.dtype), np.empty(len(pdf))
        kept = 0
        keys = (sigs[:, None] & masks).tolist() if deduplicate else None
        # For every mask the kept frames of each key, as (signature, mean).
        known = [{} for _ in masks]

        def near_kept(i):
            some = [k for at, key in zip(known, keys[i]) if (k := at.get(key))]
            if sum(map(len, some)) > FEW_KEPT:
                close = np.abs(kept_mean[:kept] - means[i]) <= max_mean_diff
                return (close & (np.bitwise_count((kept_sig[:kept] ^ sigs[i]).view("uint64")) <= max_distance)).any()
            sig, mean = int(sigs[i]), float(means[i])
            return any(((s ^ sig) & (1 << 64) - 1).bit_count() <= max_distance and abs(m - mean) <= max_mean_diff for k in some for s, m in k)

        reference = -1
        for i in range(len(pdf)):
            if threshold is not None:
                if scene is not None and np.abs(scene - thumbs[i]).mean() / 255.0 < threshold:
                    continue
                if update_on_duplicate:
                    scene, reference = thumbs[i], i
            if deduplicate:
                if hits[i] or near_kept(i):
                    status[i] = 1
                    continue
                kept_sig[kept], kept_mean[kept] = sigs[i], means[i]
                kept += 1
                for at, key in zip(known, keys[i]):
                    at.setdefault(key, []).append((int(sigs[i]), float(means[i])))
            status[i] = 2
            if threshold is not None and not update_on_duplicate:
                scene, reference = thumbs[i], i
        out = pdf[[c.name for c in schema if c.name in pdf]].copy()
        out["status"] = status
        out["_picture"] = [thumbs[i] if i == reference else None for i in range(len(pdf))]
        return out[[c.name for c in schema]]

    return scan


def select_frames(
    frames: DataFrame, by="capture_id", order="frame_index", threshold=None, deduplicate=True,
    update_on_duplicate=False, max_distance=3, max_mean_diff=4.0, chunk=None, trace=None, few_chunks=FEW_CHUNKS,
) -> DataFrame:
    """The frames an ordered one-pass scan would keep, found in parallel.

    Without a scene threshold, more than ``few_chunks`` chunks are decided class by class
    (``first_kept``), in a number of rounds that does not grow with the chunks; else chunks
    are scanned (``_scan_chunks``). Both give the sequential answer.

    Needs ``signature`` (bigint) and ``mean_intensity`` to de-duplicate and ``thumb``
    for a scene threshold; ``order`` must be a unique integer per capture.
    Adds ``status``: kept / duplicate / same_scene; frames without capture or order drop out.
    A list given as ``trace`` receives (open rows, scanned rows) of every round.
    """
    if not deduplicate and threshold is None:
        return frames.withColumn("status", F.lit("kept"))
    scan = functools.partial(_scan_chunks, frames, by, order, threshold, deduplicate, update_on_duplicate, max_distance, max_mean_diff, chunk, trace)
    if threshold is not None or frames.select(by, F.floor(F.col(order) / (chunk or CHUNK))).distinct().limit(few_chunks + 1).count() <= few_chunks:
        return scan()
    measured = frames.dropna(subset=[by, order, "signature", "mean_intensity"])
    classes = first_kept(measured, by, order, max_distance, max_mean_diff, chunk or SCAN_CHUNK, trace)
    # Joined by frame, so copies of a class do not meet in one task.
    kept = classes.filter("kept").select(by, F.col("first").alias(order), F.lit("kept").alias("status")).distinct()
    return measured.join(kept, [by, order], "left").select(*frames.columns, F.coalesce("status", F.lit("duplicate")).alias("status"))


def _chunks(keys: DataFrame, by, order, chunk) -> DataFrame:
    """Buckets of ``chunk`` source positions (``by``, _bucket) with the chunk they are part of.

    Frames of other captures lie between those of one, so buckets in a row are one chunk
    until it holds ``chunk`` frames, and never twice as many.
    """
    buckets = keys.groupBy(by, F.floor(F.col(order) / chunk).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    across = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(across), F.lit(0))
    return buckets.select(by, "_bucket", F.floor(before / chunk).cast("long").alias("_chunk"))


def _scan_chunks(
    frames: DataFrame, by="capture_id", order="frame_index", threshold=None, deduplicate=True,
    update_on_duplicate=False, max_distance=3, max_mean_diff=4.0, chunk=None, trace=None,
) -> DataFrame:
    """``select_frames`` by scans of chunks.

    Whether a frame is kept depends on the frames kept before it, so a hot capture
    would be one long sequential task. Instead every chunk of about ``chunk`` frames
    is scanned as a function of its incoming state: the reference picture and which of its
    frames are near one kept in an earlier chunk. A round runs only the chunks whose state
    is not the one they last ran with. Chunks before a capture's first such chunk are
    settled, and so is that one once it ran: their decisions are laid aside, what they kept
    is marked on the open rows for good, and no later round reads them. Each round settles
    at least one chunk of every open capture, so it ends, with the sequential answer.
    """
    scenes = threshold is not None
    parts, near = shuffle_partitions(frames.sparkSession), (by, max_distance, max_mean_diff)
    rows = cut(frames.dropna(subset=[by, order]).select(
        by, F.col(order).alias("_order"),
        *(["signature", "mean_intensity"] if deduplicate else [F.lit(0).cast("bigint").alias("signature"), F.lit(0.0).alias("mean_intensity")]),
        *(["thumb"] if scenes else []), F.lit(False).alias("_hit"), F.lit(False).alias("_sure")), by, "_order")
    if chunk is None:
        cells = scenes and rows.agg(F.max(F.size("thumb"))).first()[0] or 1
        chunk = max(1, min(SCAN_CHUNK, SCAN_CELLS // max(cells, 1)))
    at = cut(_chunks(rows, by, "_order", chunk))
    rows = rows.withColumn("_bucket", F.floor(F.col("_order") / chunk)).join(at, [by, "_bucket"]).drop("_bucket")
    by_type = frames.schema[by].dataType.simpleString()
    out_schema = spark_schema(f"{by} {by_type}, _chunk bigint, _order bigint, signature bigint, mean_intensity double, status int, _picture array<int>")
    scan = _greedy(threshold, deduplicate, update_on_duplicate, max_distance, max_mean_diff, out_schema)

    # One group is one chunk, so at most ``chunk`` rows whatever the capture holds.
    first = rows.repartition(parts, by, "_chunk").groupBy(by, "_chunk").applyInPandas(lambda pdf: scan(pdf, None), out_schema)
    decided = cut(first, by, "_order")
    sizes = decided.groupBy(by, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    ran = cut(sizes.withColumns({"_from": F.lit(None).cast("bigint"), "_hits": F.lit(None).cast("bigint")}))
    changed, settled, base = ran, [], None
    while True:
        # --- settle: everything up to the first chunk that ran in this round
        frontier = cut(changed.groupBy(by).agg(F.min("_chunk").alias("_upto")))
        placed = decided.join(frontier, by, "left")
        done, decided = placed.filter("_upto is null or _chunk <= _upto").drop("_upto"), placed.filter("_chunk > _upto").drop("_upto")
        settled.append(done.select(by, "_order", "status"))
        if sizes.join(frontier, by).filter("_chunk > _upto").isEmpty():
            if trace is not None:
                trace.append((0, 0))
            break
        rows = rows.join(frontier, by).filter("_chunk > _upto").drop("_upto")
        if scenes:
            left = done.filter("_picture is not null").select(by, "_order", "_picture")
            left = left if base is None else left.unionByName(base)
            base = cut(left.groupBy(by).agg(F.max_by("_picture", "_order").alias("_picture"), F.max("_order").alias("_order")))
        # --- the state every open chunk would start from now
        if deduplicate:
            kept = done.join(frontier.select(by), by).withColumn("_final", F.lit(True)).unionByName(
                decided.withColumn("_final", F.lit(False))).filter("status = 2")
            kept = kept.groupBy(by, "signature", "mean_intensity").agg(F.min("_chunk").alias("at"), F.max("_final").alias("final"))
            classes = rows.select(by, "signature", "mean_intensity").distinct()
            seen = near_classes(classes, kept, *near).groupBy(
                by, F.col("l_signature").alias("signature"), F.col("l_mean").alias("mean_intensity")
            ).agg(F.min("r_at").alias("_seen"), F.max("r_final").alias("_final"))
            rows = rows.join(seen, [by, "signature", "mean_intensity"], "left").withColumn(
                "_sure", F.col("_sure") | F.coalesce("_final", F.lit(False))).withColumn(
                "_hit", F.col("_sure") | F.coalesce(F.col("_seen") < F.col("_chunk"), F.lit(False))).drop("_seen", "_final")
        rows = cut(rows, by, "_order")
        state = rows.groupBy(by, "_chunk").agg(
            F.count(F.lit(1)).alias("_n"), F.bit_xor(F.when(F.col("_hit"), F.xxhash64("_order"))).alias("_hits"))
        if scenes:
            last = decided.groupBy(by, "_chunk").agg(F.max(F.when(F.col("_picture").isNotNull(), F.col("_order"))).alias("_set"))
            across = Window.partitionBy(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
            start = last.select(by, "_chunk", F.last("_set", ignorenulls=True).over(across).alias("_earlier"))
            start = start.join(base.select(by, F.col("_order").alias("_base")), by, "left").select(
                by, "_chunk", F.coalesce("_earlier", "_base").alias("_from"))
            state = state.join(start, [by, "_chunk"])
        else:
            state = state.withColumn("_from", F.lit(None).cast("bigint"))
        state = cut(state)
        before = ran.select(by, "_chunk", F.struct("_from", "_hits").alias("_before"))
        changed = cut(state.join(before, [by, "_chunk"]).filter(
            ~F.struct("_from", "_hits").eqNullSafe(F.col("_before"))).drop("_before"))
        scanned = changed.agg(F.sum("_n")).first()[0] or 0
        if trace is not None:
            trace.append((rows.count(), scanned))
        if not scanned:
            settled.append(decided.select(by, "_order", "status"))
            break
        # --- run the chunks whose state is a new one
        todo = rows.join(changed.select(by, "_chunk"), [by, "_chunk"], "left_semi").repartition(parts, by, "_chunk").groupBy(by, "_chunk")
        if scenes:
            pictures = decided.filter("_picture is not null").select(by, "_order", "_picture").unionByName(base)
            start = changed.join(pictures.withColumnRenamed("_order", "_from"), [by, "_from"]).select(
                F.col(by).alias("_owner"), F.col("_chunk").alias("_of"), "_picture")
            now = todo.cogroup(start.groupBy("_owner", "_of")).applyInPandas(scan, out_schema)
        else:
            now = todo.applyInPandas(lambda pdf: scan(pdf, None), out_schema)
        stay = decided.join(changed.select(by, "_chunk"), [by, "_chunk"], "left_anti")
        decided, ran = cut(stay.unionByName(now), by, "_order"), state
    names = F.element_at(F.array(F.lit("same_scene"), F.lit("duplicate"), F.lit("kept")), F.col("status") + 1)
    verdict = functools.reduce(DataFrame.unionByName, settled)
    return frames.join(verdict.select(F.col(by), F.col("_order").alias(order), names.alias("status")), [by, order])


def spark_schema(ddl):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def match_duplicates(selected: DataFrame, by="capture_id", order="frame_index", max_distance=3, max_mean_diff=4.0) -> DataFrame:
    """Skip log of D6: for every duplicate the nearest frame kept before it.

    Nearest by bit distance, then mean difference, then the earlier frame. Candidates
    are found per class; kept frames are pairwise not near, so a class has few.
    """
    kept = selected.filter("status = 'kept'").groupBy(by, "signature", "mean_intensity").agg(F.min(order).alias("at"))
    dropped = selected.filter("status = 'duplicate'")
    classes = dropped.select(by, "signature", "mean_intensity").distinct()
    options = near_classes(classes, kept, by, max_distance, max_mean_diff).select(
        by, F.col("l_signature").alias("signature"), F.col("l_mean").alias("mean_intensity"), F.col("r_at").alias("at"),
        hamming(F.col("l_signature"), F.col("r_signature")).cast("long").alias("distance"),
        F.abs(F.col("l_mean") - F.col("r_mean")).alias("diff"))
    nearest = dropped.select(by, order, "signature", "mean_intensity").join(
        options, [by, "signature", "mean_intensity"]).filter(F.col("at") < F.col(order)).groupBy(by, order).agg(
        F.min(F.struct("distance", "diff", "at")).alias("best"))
    return nearest.select(
        by, order, F.col("best.at").alias("duplicate_of"), F.col("best.distance").alias("signature_distance"),
        round6(F.col("best.diff")).alias("mean_difference"))


def cap_selection(selected: DataFrame, cap: int, by="capture_id", order="frame_index") -> DataFrame:
    """D7 on a selection: rows after the ``cap``-th kept frame were never looked at."""
    if cap is None:
        return selected
    kept = with_position(selected.filter("status = 'kept'").select(by, order), by, order, "_p")
    end = kept.filter(F.col("_p") == cap - 1).select(by, F.col(order).alias("_end"))
    return selected.join(end, by, "left").filter(F.col("_end").isNull() | (F.col(order) <= F.col("_end"))).drop("_end")


def sampling_diagnostics(selected: DataFrame, by="capture_id", order="frame_index", log_size=1000) -> DataFrame:
    """Counts per capture and the first ``log_size`` skipped positions (K3)."""
    counts = selected.groupBy(by).agg(
        F.count(F.lit(1)).alias("available_frames"),
        F.count_if(F.col("status") == "kept").alias("selected_frames"),
        F.count_if(F.col("status") == "duplicate").alias("duplicate_frames_skipped"))
    skipped = cap_frames(selected.filter("status = 'duplicate'").select(by, order), log_size, by, order)
    log = skipped.groupBy(by).agg(F.array_sort(F.collect_list(order)).alias("duplicates"))
    return counts.join(log, by, "left").withColumn(
        "duplicates", F.coalesce("duplicates", F.array().cast(f"array<{selected.schema[order].dataType.simpleString()}>")))


def neighbourhood(frames: DataFrame, n: int, by="capture_id", order="frame_index", value="frame_id") -> DataFrame:
    """The frames at most ``n`` positions away, by an equi-join on position blocks."""
    placed = with_position(frames.select(by, order, value), by, order)
    block = max(2 * n, 1)
    left = placed.withColumn("_block", F.explode(F.sequence(
        F.floor((F.col("position") - n) / block), F.floor((F.col("position") + n) / block))))
    right = placed.select(F.col(by), F.floor(F.col("position") / block).alias("_block"),
                          F.col("position").alias("_p"), F.col(value).alias("_v"))
    near = left.join(right, [by, "_block"]).filter(F.abs(F.col("_p") - F.col("position")) <= n)
    # At most 2n + 1 entries per frame.
    return near.groupBy(by, order, value, "position").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_p", "_v"))), lambda s: s["_v"]).alias("neighbours"))
