"""An experiment from capture to reveal: gates, leaks, tampering, exports."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalblind.operators import blinding as B, review as R
from signalblind.plans import experiment as E
from signalblind.sources import sinks

FORBIDDEN = {"unblinded_label", "capture_id", "parent_capture_id", "frame_id", "parent_frame_id", "control_type", "frame_index", "timestamp_ms"}


def captures(spark):
    rng = np.random.default_rng(11)
    rows = []
    for capture, role in (("cap-a", "laser"), ("cap-b", "control")):
        for i in range(4):
            a = rng.integers(0, 256, (12, 16))
            if role == "laser":
                a[:, ::4] = 250
            rows.append((capture, i, role, 12, 16, [int(v) for v in a.ravel()]))
    rows.append(("cap-a", 4, "laser", 12, 16, rows[0][5]))
    return spark.createDataFrame(rows, "capture_id string, frame_index bigint, role string, height int, width int, pixels array<int>")


def test_whole_experiment(spark, tmp_path):
    exp = E.Experiment.create(spark, str(tmp_path / "exp"))
    exp.add_capture(captures(spark), metadata={"camera": "bench"}, interval=1)
    frames = exp.frames()
    assert frames.count() == 8, "the byte copy is dropped"
    assert exp.estimate("baseline").first().asDict() == {"sample_count": 8 + 12 + 1, "preprocessing_variants": 5, "detector_records": 105, "runtime_label": "short"}
    assert exp.preview(2).count() == 4
    exp.update_plan("speckle")
    exp.run("baseline", seed=3, calibration=(16, 32))

    sealed = exp.results()
    assert not FORBIDDEN & set(sealed.columns)
    assert sealed.count() == 20 * 5
    assert sealed.filter(F.col("sample_id") != F.col("blind_id")).count() == 0
    assert sealed.filter(F.col("q_value").isNotNull()).count() == 0
    before = exp.summary().first()
    assert (before.sample_count, before.evidence_ladder, before.cohen_d) == (20, "blinded review", None)
    for action in (lambda: exp.add_capture(captures(spark)), lambda: exp.run(), lambda: exp.update_plan("ocr"),
                   lambda: exp.export_bundle(str(tmp_path / "b"), include_media=True)):
        with pytest.raises(ValueError):
            action()

    one = sealed.first().blind_id
    exp.annotate(one, " first ", ["interesting"])
    exp.annotate(one, "second", ["artifact", "interesting", "artifact"])
    with pytest.raises(ValueError):
        exp.annotate("B999999", "x")
    with pytest.raises(ValueError):
        exp.annotate(one, "x", ["pretty"])
    exp.complete_review()
    badges = exp.report().first().badges
    assert badges[:2] == ["review blinded", "source roles sealed"] and "blind review complete" in badges
    assert "provenance warnings: 6" in badges
    exp.export_bundle(str(tmp_path / "blind"))
    text = "".join(p.read_text() for p in (tmp_path / "blind").rglob("*.json"))
    assert "cap-a" not in text and "laser\"" not in text and "digest" not in text

    summary = exp.unblind(permutations=100).first()
    assert (summary.laser_count, summary.control_count, summary.synthetic_positive_count) == (4, 16, 1)
    assert 1 / 101 <= summary.permutation_p_value <= 1
    shown = exp.results()
    assert shown.count() == 21 * 5 and shown.filter("q_value is null").count() == 0
    assert exp.unblind().first() == summary, "a second reveal changes nothing"
    top = {r.blind_id: r for r in exp.candidates().collect()}
    assert len(top) == 20 and top[one].review_note == "second" and top[one].review_flags == "artifact,interesting"
    assert "synthetic_positive" not in {r.unblinded_label for r in top.values()}
    assert "review unblinded" in exp.report().first().badges
    exp.export_candidates(str(tmp_path / "csv"))
    header = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()[0].split(",")
    assert header[:4] == ["rank", "blind_id", "sample_id", "unblinded_label"]
    exp.export_bundle(str(tmp_path / "open"), include_media=True)
    assert len(json.loads(next((tmp_path / "open" / "media").glob("*.json")).read_text().splitlines()[0])["pixels"]) == 192


def sample_table(spark, n=500):
    return spark.range(n).select(
        F.format_string("s%d", "id").alias("sample_id"),
        F.when(F.col("id") == 0, "synthetic_positive").when(F.col("id") % 3 == 0, "laser").otherwise("control").alias("unblinded_label"))


def test_blind_ids_are_a_bijection_that_depends_on_the_seed(spark):
    one = {r.sample_id: r.blind_id for r in B.assign_blind_ids(sample_table(spark), 1).collect()}
    two = {r.sample_id: r.blind_id for r in B.assign_blind_ids(sample_table(spark), 2).collect()}
    assert sorted(one.values()) == [f"B{i:06d}" for i in range(1, 501)]
    assert one != two and set(one.values()) == set(two.values())


def test_seal_then_restore_is_the_identity(spark):
    mapped = B.assign_blind_ids(sample_table(spark), 1).select("blind_id", "sample_id", "unblinded_label")
    results = mapped.withColumn("structure_score", F.length("sample_id") / 10)
    expected = B.digest(mapped).first().digest
    shown = B.unblind(B.seal(results, mapped), mapped, B.calibration_results(results, mapped), expected)
    columns = ["blind_id", "sample_id", "unblinded_label", "structure_score"]
    assert sorted(shown.select(columns).collect()) == sorted(results.select(columns).collect())


def test_tampering_reveals_nothing(spark):
    mapped = B.assign_blind_ids(sample_table(spark), 1).select("blind_id", "sample_id", "unblinded_label")
    expected = B.digest(mapped).first().digest
    assert B.digest(mapped.repartition(7)).first().digest == expected
    changed = mapped.withColumn("unblinded_label", F.when(F.col("sample_id") == "s1", "laser").otherwise(F.col("unblinded_label")))
    with pytest.raises(ValueError, match="integrity"):
        B.unblind(B.seal(mapped, mapped), changed, B.calibration_results(mapped, mapped), expected)


def test_missing_mapping_is_an_error(spark):
    mapped = B.assign_blind_ids(sample_table(spark), 1).select("blind_id", "sample_id", "unblinded_label")
    with pytest.raises(Exception, match="missing sealed sample mapping"):
        B.restore(B.seal(mapped, mapped), mapped.filter("sample_id <> 's5'")).collect()


def test_unknown_protocol_and_flags(spark):
    presets = R.protocols(spark)
    assert presets.count() == 4
    asked = spark.createDataFrame([("seance",)], "protocol string")
    with pytest.raises(Exception, match="unknown protocol preset"):
        R.with_protocol(asked, presets).collect()
    with pytest.raises(Exception, match="unknown review flags"):
        spark.range(1).select(R.normalized_flags(F.array(F.lit("pretty")))).collect()
    texts = {r.protocol: r.text for r in R.describe_protocol(presets).collect()}
    assert texts["ocr"].startswith("OCR / symbol recovery: ") and texts["ocr"].endswith("known-text calibration.")


def test_media_stays_in_while_sealed(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.export_bundle({"media": sample_table(spark)}, str(tmp_path), unblinded=False, include_media=True)


def test_ingest_modes(spark):
    df = E.with_measures(captures(spark))
    with pytest.raises(ValueError):
        E.ingest(df, mode="guess")
    assert E.ingest(df, mode="all_frames").count() == 8
    assert E.ingest(df, mode="capped_all_frames", cap=3).groupBy("capture_id").count().filter("count <> 3").count() == 0
    assert E.ingest(df, mode="scene_change", threshold=0.0, video=False).count() == 8
    assert E.ingest(df, mode="interval", interval=2, deduplicate=False).count() == 5


def test_reveal_numbers_the_samples_once(spark, monkeypatch):
    """The seal map is made once and stored, whatever reads it after that."""
    from signalblind.operators import blinding
    from signalblind.plans import load

    calls, rank = [], blinding.global_rank
    monkeypatch.setattr(blinding, "global_rank", lambda *a: calls.append(1) or rank(*a))
    for n, name in enumerate(("b4_unblind", "j2_unblind_join", "j3_seal_anti_filter", "f5_seal_projection"), 1):
        load().QUERIES[name](spark, "/root/testdata/sf0.001")
        assert len(calls) == n, name
