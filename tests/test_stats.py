"""Statistics: known values, bounds and behaviour on hot groups."""

import random

import pytest
from pyspark.sql import functions as F

from signalblind.functions import columns as C
from signalblind.operators import stats as S
from signalblind.operators.ordering import attach_totals, global_rank, running_count, running_min, running_sum, with_previous


def scores(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, unblinded_label string, score double, persistence double").withColumn(
        "role", C.statistical_role(F.col("unblinded_label")))


def test_step_up_known_values(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03])], "i int, p_value double")
    assert [r.q_value for r in S.bh_q(df).orderBy("i").collect()] == [0.03, 0.04, 0.04]


def step_up(ps):
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    out, low = [0.0] * len(ps), 1.0
    for rank in range(len(ps), 0, -1):
        low = min(low, ps[order[rank - 1]] * len(ps) / rank)
        out[order[rank - 1]] = round(low, 6)
    return out


def test_step_up_matches_brute_force_with_ties(spark):
    rng = random.Random(3)
    ps = [round(rng.choice([rng.random(), 0.02, 0.5]), 3) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(ps)), "i int, p_value double")
    got = [r.q_value for r in S.bh_q(df).orderBy("i").collect()]
    assert got == pytest.approx(step_up(ps), abs=1.1e-6)
    pairs = sorted(zip(ps, got))
    assert all(a[1] <= b[1] for a, b in zip(pairs, pairs[1:]))


def test_empirical_p_counts_controls_at_or_above(spark):
    df = scores(spark, [("a", "laser", 0.9, 0.0), ("b", "laser", 0.2, 0.0), ("c", "control", 0.5, 0.0), ("d", "control", 0.2, 0.0), ("e", "synthetic_positive", 1.0, 0.0)])
    got = {r.sample_id: r.p_value for r in S.empirical_p(df).collect()}
    assert got == {"a": round(1 / 3, 6), "b": 1.0, "c": round(2 / 3, 6), "d": 1.0, "e": round(1 / 3, 6)}


def test_empirical_p_without_controls_is_one(spark):
    df = scores(spark, [("a", "laser", 0.9, 0.0), ("b", "laser", 0.2, 0.0)])
    assert {r.p_value for r in S.empirical_p(df).collect()} == {1.0}


def test_groups_do_not_mix(spark):
    rows = [("x", f"x{i}", "laser" if i % 2 else "control", i / 10, 0.0) for i in range(8)]
    rows += [("y", f"y{i}", "laser" if i % 3 else "control", i / 20, 0.0) for i in range(9)]
    both = spark.createDataFrame(rows, "experiment string, sample_id string, unblinded_label string, score double, persistence double").withColumn(
        "role", C.statistical_role(F.col("unblinded_label")))
    together = {r.experiment: r for r in S.summarize_scores(both, 5, 50, by=["experiment"]).collect()}
    for name in ("x", "y"):
        alone = S.summarize_scores(both.filter(F.col("experiment") == name).drop("experiment"), 5, 50).first()
        for column in ("laser_count", "cohen_d", "permutation_p_value", "minimum_q_value", "evidence_ladder"):
            assert together[name][column] == alone[column], column


def test_permutation_bounds_and_direction(spark):
    rows = [(f"l{i}", "laser", 0.8 + i / 1000, 0.3) for i in range(30)] + [(f"c{i}", "control", 0.2 + i / 1000, 0.1) for i in range(30)]
    up = S.permutation_p(scores(spark, rows), 1, 200).first()[0]
    assert up == round(1 / 201, 6)
    swapped = [(i, "control" if r == "laser" else "laser", s, p) for i, r, s, p in rows]
    assert S.permutation_p(scores(spark, swapped), 1, 200).first()[0] == 1.0


def test_permutation_splits_a_large_pool(spark):
    """Enough samples for several hash digits; the answer must equal plain sorting."""
    import hashlib

    n, permutations = 3000, 12
    rng = random.Random(9)
    rows = [(f"s{i}", "laser" if i % 3 == 0 else "control", round(rng.random(), 6), 0.0) for i in range(n)]
    got = S.permutation_p(scores(spark, rows), 4, permutations).first()[0]
    values = {i: round(s * 1e6) for i, _, s, _ in rows}
    na = sum(r == "laser" for _, r, _, _ in rows)
    observed = sum(values[i] for i, r, _, _ in rows if r == "laser")
    hits = 0
    for perm in range(permutations):
        key = lambda i: (hashlib.md5(f"4:{perm // 4}:{i}".encode()).hexdigest()[8 * (perm % 4):8 * (perm % 4) + 8], i)
        hits += sum(values[i] for i in sorted(values, key=key)[:na]) >= observed
    assert got == round((hits + 1) / (permutations + 1), 6)


def test_null_groups_stay_low(spark):
    rng = random.Random(1)
    rows = [(f"l{i}", "laser", 0.4 + rng.random() / 50, 0.5) for i in range(20)] + [(f"c{i}", "control", 0.4 + rng.random() / 50, 0.5) for i in range(20)]
    out = S.summarize_scores(scores(spark, rows), 1, 200).first()
    assert out.evidence_ladder not in ("repeatable candidate", "above-control candidate")


def test_single_value_interval_and_empty_roles(spark):
    one = scores(spark, [("a", "laser", 0.4, 0.2)])
    ci = S.mean_ci(one, "score").first()
    assert (ci["count"], ci["mean"], ci["low"], ci["high"]) == (1, 0.4, 0.4, 0.4)
    assert S.cohen_d(one).first()[0] is None
    assert S.permutation_p(one, 1, 20).first()[0] is None
    assert S.summarize_scores(one, 1, 20).first().evidence_ladder == "no signal"


def test_unknown_primary_metric_is_refused(spark):
    with pytest.raises(ValueError):
        C.primary_score("loudness", F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))


def hot(spark, n=3000):
    """One group holds two thirds of the rows; order keys have gaps."""
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"g{i % 7}", i * 3 + (i % 2), rng.randint(0, 50)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, k bigint, v bigint")


def test_running_operators_match_plain_python(spark):
    rows, df = hot(spark)
    bucket = F.floor(F.col("k") / 100)
    count = {(r.g, r.k): r["rank"] for r in running_count(df, ["g"], [F.col("k")], bucket).collect()}
    total = {(r.g, r.k): r.t for r in running_sum(df, ["g"], [F.col("k")], bucket, "v", "t").collect()}
    low = {(r.g, r.k): r.m for r in running_min(df, ["g"], [F.desc("k")], -bucket, "v", "m").collect()}
    prev = {(r.g, r.k): r.prev_v for r in with_previous(df, ["g"], [F.col("k")], bucket, ["v"]).collect()}
    for g in {r[0] for r in rows}:
        seen, acc, last = 0, 0, None
        mine = sorted(r for r in rows if r[0] == g)
        for _, k, v in mine:
            seen, acc = seen + 1, acc + v
            assert (count[g, k], total[g, k], prev[g, k]) == (seen, acc, last)
            last = v
        least = None
        for _, k, v in reversed(mine):
            least = v if least is None else min(least, v)
            assert low[g, k] == least


def test_totals_without_groups_need_no_join(spark):
    df = spark.range(5).withColumn("v", F.col("id"))
    out = attach_totals(df, df.agg(F.sum("v").alias("s")), [])
    assert {r.s for r in out.collect()} == {10}
    assert "CartesianProduct" not in out._jdf.queryExecution().toString()


def test_permutation_keeps_groups_apart(spark, monkeypatch):
    """Several parts, a second pass inside the cut cell, and a group without a laser sample."""
    import hashlib

    monkeypatch.setattr(S, "PART", 128)
    monkeypatch.setattr(S, "PER_CELL", 1)
    rng, permutations = random.Random(3), 10
    rows = [(g, f"s{i}", "laser" if g != "c" and rng.random() < share else "control", round(rng.random(), 6)) for g, n, share in (("a", 900, 0.4), ("b", 7, 0.5), ("c", 3, 0), (None, 40, 0.5)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, sample_id string, role string, score double").filter("g is not null")
    got = {r.g: r.permutation_p_value for r in S.permutation_p(df, 6, permutations, ["g"]).collect()}
    for g in "abc":
        own = [(i, r, round(s * 1e6)) for h, i, r, s in rows if h == g]
        na = sum(r == "laser" for _, r, _ in own)
        observed, hits = sum(v for _, r, v in own if r == "laser"), 0
        for k in range(permutations):
            digest = lambda i: hashlib.md5(f"6:{k // 4}:{i}".encode()).hexdigest()[8 * (k % 4):8 * (k % 4) + 8]
            hits += sum(v for _, _, v in sorted(own, key=lambda t: (digest(t[0]), t[0]))[:na]) >= observed
        assert got[g] == (round((hits + 1) / (permutations + 1), 6) if 0 < na < len(own) else None), g


def test_global_rank_needs_no_single_task(spark):
    df = spark.range(3000).selectExpr("id", "cast(id % 7 as double) / 3 score", "repeat('x', 5) wide")
    out = global_rank(df, [F.desc("score"), F.col("id")])
    got = {r.id: r["rank"] for r in out.collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda t: t[1])] == sorted(range(3000), key=lambda i: (-(i % 7), i))
    assert sorted(got.values()) == list(range(1, 3001)) and out.columns == ["id", "score", "wide", "rank"]
    assert "Window" not in out._jdf.queryExecution().toString()
    assert global_rank(df.filter("id < 0"), [F.col("id")]).count() == 0
