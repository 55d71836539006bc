"""Case/control statistics (S1-S16). Every function takes extra group columns ``by``.

Scores are summed as whole millionths, so means do not depend on how rows were split.
"""

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import columns as C
from ..functions.columns import micros, round6
from ..session import cut
from .ordering import attach_totals, running_min, running_sum

MICRO = 1e6


def sample_scores(results: DataFrame, by=(), sample="sample_id", label="unblinded_label",
                  score="primary_metric_score", fallback=None, persistence="persistence_score") -> DataFrame:
    """Mean score and persistence of a sample over its variants."""
    value = F.coalesce(F.col(score), F.col(fallback)) if fallback else F.col(score)
    # A sample has one label; grouping by it keeps the aggregate hash-based.
    sums = results.groupBy(*by, sample, F.col(label).alias("unblinded_label")).agg(
        F.count(F.lit(1)).alias("variants"),
        F.sum(micros(F.coalesce(value, F.lit(0.0)))).alias("_s"),
        F.sum(micros(F.coalesce(F.col(persistence), F.lit(0.0)))).alias("_p"))
    return sums.select(
        *by, F.col(sample).alias("sample_id"), "unblinded_label", "variants",
        (F.col("_s") / F.col("variants") / MICRO).alias("score"),
        (F.col("_p") / F.col("variants") / MICRO).alias("persistence"),
        C.statistical_role(F.col("unblinded_label")).alias("role"))


def _grouped(df, by):
    return df.groupBy(*by) if by else df.groupBy()


def role_means(scores: DataFrame, by=()) -> DataFrame:
    """S2, S9, S10 in one aggregate; null where a role is empty."""
    of = lambda role, c="score": F.when(F.col("role") == role, F.col(c))
    return _grouped(scores, by).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count(of("laser")).alias("laser_count"), F.count(of("control")).alias("control_count"),
        F.count(of("calibration")).alias("synthetic_positive_count"),
        round6(F.avg(of("laser"))).alias("laser_mean_score"),
        round6(F.avg(of("control"))).alias("control_mean_score"),
        round6(F.avg(of("calibration"))).alias("synthetic_positive_mean_score"),
        round6(F.avg(of("laser", "persistence"))).alias("laser_mean_persistence"),
        F.coalesce(F.max(of("calibration")) > 0.05, F.lit(False)).alias("calibration_passed"))


def cohen_d(scores: DataFrame, by=(), value="score") -> DataFrame:
    """S3: difference of means over the pooled population deviation."""
    of = lambda role: F.when(F.col("role") == role, F.col(value))
    m = _grouped(scores, by).agg(
        F.count(of("laser")).alias("na"), F.count(of("control")).alias("nb"),
        F.avg(of("laser")).alias("ma"), F.avg(of("control")).alias("mb"),
        F.stddev_pop(of("laser")).alias("sa"), F.stddev_pop(of("control")).alias("sb"))
    pooled = F.sqrt((F.col("sa") * F.col("sa") + F.col("sb") * F.col("sb")) / 2)
    d = F.when((F.col("na") >= 2) & (F.col("nb") >= 2), F.when(pooled < 1e-12, 0.0).otherwise(
        round6((F.col("ma") - F.col("mb")) / F.greatest(pooled, F.lit(1e-300)))))
    return m.select(*by, d.alias("cohen_d"))


def mean_ci(df: DataFrame, value: str, by=()) -> DataFrame:
    """Mean with a normal 95% interval; one value gives an interval of width zero."""
    m = _grouped(df, by).agg(
        F.count(value).alias("count"), F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    margin = 1.96 * F.col("_s") / F.sqrt(F.greatest("count", F.lit(1)))
    return m.select(*by, "count", round6(F.col("_m")).alias("mean"), round6(F.col("_m") - margin).alias("low"),
                    round6(F.col("_m") + margin).alias("high"))


def _score_bucket(c):
    """Coarse order-preserving bucket of a score or probability in thousandths."""
    return F.floor(c * 1000)


def empirical_p(scores: DataFrame, by=(), value="score") -> DataFrame:
    """Share of controls scoring at least as high, with the add-one rule.

    Rows collapse to distinct scores before anything is ordered. Every sample is a
    candidate, controls and the calibration sample included. ``scores`` is read twice,
    so hand in a stored table.
    """
    keyed = scores.withColumn("_v", micros(F.col(value) * 1000))
    # Few next to the samples and read three times, so written out once.
    levels = cut(keyed.groupBy(*by, "_v").agg(F.count(F.when(F.col("role") == "control", 1)).alias("_c")))
    above = running_sum(levels, list(by), [F.desc("_v")], F.floor(-F.col("_v") / 1e6), "_c", "_ge")
    totals = _grouped(levels, by).agg(F.sum("_c").alias("_n"))
    above = attach_totals(above, totals, by)
    p = round6((F.col("_ge") + 1) / (F.col("_n") + 1))
    return keyed.join(above.select(*by, "_v", p.alias("p_value")), [*by, "_v"]).drop("_v")


def bh_q(df: DataFrame, p="p_value", by=(), name="q_value") -> DataFrame:
    """Benjamini-Hochberg step-up over distinct p-values; ties share the highest rank."""
    clipped = df.withColumn("_p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(p))))
    levels = cut(clipped.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_n")))
    totals = _grouped(levels, by).agg(F.sum("_n").alias("_m"))
    ranked = running_sum(levels, list(by), [F.col("_p")], _score_bucket(F.col("_p")), "_n", "_k")
    ranked = attach_totals(ranked, totals, by)
    raw = ranked.withColumn("_raw", F.col("_p") * F.col("_m") / F.col("_k"))
    stepped = running_min(raw, list(by), [F.desc("_p")], -_score_bucket(F.col("_p")), "_raw", "_q")
    q = stepped.select(*by, "_p", round6(F.least(F.lit(1.0), F.col("_q"))).alias(name))
    return clipped.join(q, [*by, "_p"]).drop("_p")


# Samples one task takes in a permutation pass, at most, and rows of one cell it may leave to sort.
PART, PER_CELL = 1 << 18, 1024


def _draw_keys(ids, seed, permutations):
    """(first permutation, 32-bit keys of four permutations) from one md5 a sample: eight hex digits each."""
    tails = [b"" if i is None else b":" + i.encode() for i in ids]
    for block in range(-(-permutations // 4)):
        head = f"{seed}:{block}".encode()
        digests = b"".join([md5(head + t, usedforsecurity=False).digest() for t in tails])
        yield 4 * block, np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64) if tails else np.zeros((0, 4), np.int64)


def _exact_sums(cells, values):
    """Sums of whole numbers per cell; halves of 26 bits and the rest stay exact as doubles."""
    low, high = values & ((1 << 26) - 1), values >> 26
    sums = [np.bincount(cells, x, 256).astype(np.int64) for x in (low, high)]
    return sums[0] + (sums[1] << 26)


def _prefixes(edge, permutations):
    """The prefix each permutation is cut at; -1, which no key has, where it is settled already."""
    out = np.full(permutations, -1, np.int64)
    out[edge["_perm"].to_numpy()] = edge["_prefix"].to_numpy()
    return out


def _constant(table, by, n):
    """The group columns of a task's table for ``n`` rows."""
    return {c: table[c].take(pa.array(np.zeros(n, np.int64))) for c in by}


def _cell_counts(by, seed, permutations, level):
    """Arrow pass: samples and their sum in each of the 256 cells below a permutation's prefix."""

    def run(pool, edge):
        values, rows = pool["_v"].to_numpy(), []
        prefix = np.zeros(permutations, np.int64) if edge is None else _prefixes(edge, permutations)
        for first, keys in _draw_keys(pool["_s"].to_pylist(), seed, permutations):
            for i in range(min(4, permutations - first)):
                key, v = keys[:, i], values
                if level:
                    inside = key >> (32 - 8 * level) == prefix[first + i]
                    key, v = key[inside], v[inside]
                cells = (key >> (24 - 8 * level)) & 255
                n = np.bincount(cells, minlength=256)
                some = np.flatnonzero(n)
                rows.append((np.full(len(some), first + i), prefix[first + i] * 256 + some, n[some], _exact_sums(cells, v)[some]))
        perm, cell, n, total = (np.concatenate(c) for c in zip(*rows))
        return pa.table({**_constant(pool, by, len(perm)), "_perm": perm, "_prefix": cell, "_n": n, "_t": total})

    return run if level else lambda pool: run(pool, None)


def _edge_samples(by, seed, permutations, level):
    """Arrow pass: the samples of the one cell in which a permutation is cut."""

    def run(pool, edge):
        prefix, rows = _prefixes(edge, permutations), []
        for first, keys in _draw_keys(pool["_s"].to_pylist(), seed, permutations):
            for i in range(min(4, permutations - first)):
                at = np.flatnonzero(keys[:, i] >> (32 - 8 * level) == prefix[first + i])
                rows.append((np.full(len(at), first + i), keys[at, i], at))
        perm, key, at = (np.concatenate(c) for c in zip(*rows))
        return pa.table({**_constant(pool, by, len(perm)), "_perm": perm, "_key": key, "_id": pool["_id"].take(pa.array(at)), "_v": pool["_v"].take(pa.array(at))})

    return run


def _added_up(cells, by):
    return cells.groupBy(*by, "_perm", "_prefix").agg(F.sum("_n").alias("_n"), F.sum("_t").alias("_t"))


def permutation_p(scores: DataFrame, seed: int, permutations=1000, by=(), value="score", sample="sample_id") -> DataFrame:
    """One-sided label permutation test.

    In every permutation the samples are ordered by a hash of (seed, permutation,
    sample) and the first n_laser of them play the laser group. The groups' total is
    fixed, so comparing sums equals comparing mean differences; sums are whole millionths.

    No permutation is sorted and none has a row per sample. A task takes a bounded part of
    a group's samples and adds them up, in place, in 256 cells by the leading byte of the
    hash; the sums settle every cell but the one that holds the n_laser-th sample. Large
    groups look into that cell again by the next byte, until about a thousand samples a
    permutation are left in it, and only those are ordered. Rows of other roles are ignored;
    the p-value is null where a group lacks one of the two roles.
    """
    by, kinds = list(by), {f.name: f.dataType.simpleString() for f in scores.schema}
    pool = cut(scores.filter(F.col("role").isin("laser", "control")).select(
        *by, F.col(sample).alias("_id"), F.col(sample).cast("string").alias("_s"),
        (F.col("role") == "laser").alias("_laser"), F.coalesce(micros(F.col(value)), F.lit(0).cast("bigint")).alias("_v")))
    observed = cut(_grouped(pool, by).agg(
        F.count_if("_laser").alias("_na"), F.count(F.lit(1)).alias("_all"),
        F.coalesce(F.sum(F.when(F.col("_laser"), F.col("_v"))), F.lit(0)).alias("_observed")))
    # Small groups still use all cores; a part never has more than about PART samples.
    cores = scores.sparkSession.sparkContext.defaultParallelism
    parts = F.ceil(F.greatest(F.col("_all") / PART, F.least(F.col("_all") / 4096, F.lit(cores)), F.lit(1.0)))
    sized = observed.select(*by, parts.cast("int").alias("_parts"))
    dealt = attach_totals(pool, sized, by).withColumn("_part", F.pmod(F.xxhash64("_s"), F.col("_parts").cast("bigint"))).drop("_parts", "_laser")
    keys = [*by, "_part"]
    group = "".join(f"`{c}` {kinds[c]}, " for c in by)
    most = observed.agg(F.max("_all")).first()[0] or 0
    across = Window.partitionBy(*by, "_perm").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def beside(edge):
        """The cut points of a group, one copy for each of its parts."""
        spread = attach_totals(edge.select(*by, "_perm", "_prefix"), sized, by)
        return spread.select(*by, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts").cast("bigint") - 1)).alias("_part"), "_perm", "_prefix").groupBy(*keys)

    edge, level = None, 0
    while level == 0 or (most >> 8 * level > PER_CELL and level < 4):
        count, cells = _cell_counts(by, seed, permutations, level), f"{group}_perm bigint, _prefix bigint, _n bigint, _t bigint"
        if edge is None:
            found = dealt.groupBy(*keys).applyInArrow(count, cells)
            known = attach_totals(_added_up(found, by), observed.select(*by, F.col("_na").alias("_need"), F.lit(0).cast("bigint").alias("_before")), by)
        else:
            found = dealt.groupBy(*keys).cogroup(beside(edge)).applyInArrow(count, cells)
            known = _added_up(found, by).join(edge.drop("_prefix"), [*by, "_perm"])
        ranked = known.withColumns({"_upto": F.sum("_n").over(across), "_sum": F.sum("_t").over(across)})
        edge = cut(ranked.filter((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_n") < F.col("_need"))).select(
            *by, "_perm", "_prefix", (F.col("_before") + F.col("_sum") - F.col("_t")).alias("_before"),
            (F.col("_need") - F.col("_upto") + F.col("_n")).alias("_need")))
        level += 1
    tail = dealt.groupBy(*keys).cogroup(beside(edge)).applyInArrow(
        _edge_samples(by, seed, permutations, level), f"{group}_perm bigint, _key bigint, _id {kinds[sample]}, _v bigint")
    rest = tail.join(edge, [*by, "_perm"]).withColumn("_r", F.row_number().over(
        Window.partitionBy(*by, "_perm").orderBy("_key", "_id"))).filter(F.col("_r") <= F.col("_need"))
    drawn = rest.groupBy(*by, "_perm", "_before").agg(F.sum("_v").alias("_tail")).withColumn(
        "_drawn", F.col("_before") + F.col("_tail"))
    hits = _grouped(attach_totals(drawn, observed, by), by).agg(
        F.count_if(F.col("_drawn") >= F.col("_observed")).alias("_hits"))
    out = observed.join(hits, by, "left") if by else attach_totals(observed, hits, by)
    both = (F.col("_na") > 0) & (F.col("_all") > F.col("_na"))
    p = F.when(both, round6((F.col("_hits") + 1) / F.lit(permutations + 1.0)))
    return out.select(*by, p.alias("permutation_p_value"))


def family_statistics(results: DataFrame, by=(), label="unblinded_label") -> DataFrame:
    """Mean interval of each family over laser records; all four families appear."""
    laser = results.filter(C.statistical_role(F.col(label)) == "laser")
    long = laser.select(*by, F.explode(F.array(*[
        F.struct(F.lit(f).alias("family"), F.col(f).alias("value")) for f in C.FAMILIES])).alias("f")).select(*by, "f.*")
    measured = mean_ci(long, "value", [*by, "family"])
    listed = results.select(*by).distinct() if by else results.sparkSession.range(1).select()
    families = listed.withColumn("family", F.explode(F.array(*[F.lit(f) for f in C.FAMILIES])))
    return families.join(measured, [*by, "family"], "left").fillna(0, ["count"])


def attach_q(results: DataFrame, q: DataFrame, sample="sample_id") -> DataFrame:
    """Every variant of a sample gets the sample's q-value."""
    return results.join(q.select(F.col("sample_id").alias(sample), "q_value"), sample, "left")


def _single(parts: list, by: list) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        # Without group columns each part is a single row.
        out = out.join(part, by, "left") if by else attach_totals(out, part, by)
    return out


def summarize(results: DataFrame, seed: int, permutations=1000, metric="structure_score", by=(), **names) -> DataFrame:
    """One row of statistics per group.

    The per-sample scores are read by every statistic, so they are written out once
    instead of running the detectors again for each.
    """
    return summarize_scores(cut(sample_scores(results, by, **names)), seed, permutations, metric, by)


def summarize_scores(scores: DataFrame, seed: int, permutations=1000, metric="structure_score", by=()) -> DataFrame:
    by = list(by)
    q = bh_q(empirical_p(scores, by), by=by)
    ci = lambda role: mean_ci(scores.filter(F.col("role") == role), "score", by).select(
        *by, *[F.col(c).alias(f"{role}_ci_{c}") for c in ("low", "high", "count")])
    out = _single([
        role_means(scores, by), cohen_d(scores, by), permutation_p(scores, seed, permutations, by),
        _grouped(q, by).agg(F.min("q_value").alias("minimum_q_value")), ci("laser"), ci("control"),
    ], by)
    out = out.withColumn("mean_difference", round6(F.col("laser_mean_score") - F.col("control_mean_score")))
    ladder = C.evidence_ladder(
        F.col("laser_count"), F.col("control_count"), F.col("mean_difference"), F.col("permutation_p_value"),
        F.col("cohen_d"), F.col("laser_mean_persistence"))
    return out.withColumns({"primary_metric": F.lit(metric), "fdr_method": F.lit("benjamini_hochberg")}).withColumn(
        "evidence_ladder", ladder).withColumn("interpretation", C.interpretation(F.col("evidence_ladder"))).withColumn(
        "null_result_language", C.null_result_language(F.col("evidence_ladder")))


def summarize_blinded(results: DataFrame, metric="structure_score", by=(), **names) -> DataFrame:
    """What may be shown while roles are sealed."""
    scores = sample_scores(results, by, **names)
    none = lambda t: F.lit(None).cast(t)
    return role_means(scores, by).select(
        *by, (F.col("sample_count") - F.col("synthetic_positive_count")).alias("sample_count"),
        none("bigint").alias("laser_count"), none("bigint").alias("control_count"), "synthetic_positive_count",
        "calibration_passed", F.lit(metric).alias("primary_metric"), none("double").alias("laser_mean_score"),
        none("double").alias("control_mean_score"), "synthetic_positive_mean_score", none("double").alias("mean_difference"),
        none("double").alias("cohen_d"), none("double").alias("permutation_p_value"), none("double").alias("minimum_q_value"),
        F.lit("deferred_until_unblind").alias("fdr_method"), F.lit("blinded review").alias("evidence_ladder"),
        C.interpretation(F.lit("blinded review")).alias("interpretation"))


# Generated controls per laser frame at each control level.
CONTROLS_PER_FRAME = {"none": 0, "standard": 3, "strict": 5}


def estimate(frames: DataFrame, variants: int, level="standard", by=(), role="role") -> DataFrame:
    """Size of a run before it starts."""
    per = CONTROLS_PER_FRAME.get(level, CONTROLS_PER_FRAME["standard"])
    laser = F.count_if(F.col(role) == "laser")
    sized = _grouped(frames, by).agg((F.count(F.lit(1)) + laser * per + 1).alias("sample_count"))
    records = F.col("sample_count") * max(variants, 1)
    label = F.when(records < 250, "short").when(records < 2000, "medium").otherwise("long")
    return sized.select(*by, "sample_count", F.lit(max(variants, 1)).cast("bigint").alias("preprocessing_variants"),
                        records.alias("detector_records"), label.alias("runtime_label"))


def warning_count(captures: DataFrame, by=(), warnings="warnings") -> DataFrame:
    """S15"""
    return _grouped(captures, by).agg(F.sum(F.size(warnings)).cast("bigint").alias("warning_count"))


def known_confidence(words: DataFrame, by=(), conf="conf") -> DataFrame:
    """Mean confidence over words whose confidence is not -1."""
    known = F.when(F.col(conf) != -1, F.col(conf))
    return _grouped(words, by).agg(F.count(known).alias("known"), round6(F.avg(known)).alias("mean_confidence"))
