"""Golden fixtures for jobs, schema operators, sources and images."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marktrace.plans import images as I
from marktrace.plans import timeline as T
from marktrace.plans.observation import observation_report
from marktrace.session import scratch_path
from marktrace.sources import readers as R
from marktrace.sources import schema_ops as M
from marktrace.sources import sinks as K


def test_observation_golden(spark):
    edges = spark.createDataFrame(
        [(0, "RISING", "ACCEPTED", None), (3000, "FALLING", "FALLING", None), (20000, "RISING", "SUSPICIOUS_EARLY_TRIGGER", 20000.0), (21000, "FALLING", "INVALID_PLC_PULSE", None), (95000, "RISING", "ACCEPTED", 75000.0)],
        "ts_ms long, edge_type string, decision string, since_rising_ms double",
    )
    sup = spark.createDataFrame([("DUPLICATE",)], "decision string")
    sessions = spark.createDataFrame([("a", "X1", "SUCCESS", "p"), ("b", "X1", "SUCCESS", "p"), ("c", "NO_READ", "NO_READ", "p"), ("d", "NO_READ", "TIMEOUT", "")], "session_id string, identifier string, status string, image_path string")
    engines = spark.createDataFrame([("a", "ABCU", 10.0), ("a", "ABCV", 20.0), ("a", "ABCU", 30.0)], "session_id string, text string, latency_ms double")
    pairs = spark.createDataFrame([("U", "V")], "a string, b string")
    r = observation_report(edges, sup, sessions, engines, pairs, 24, "b").first()
    assert (r.rising_total, r.accepted, r.early, r.invalid_pulse) == (3, 2, 1, 1)
    assert (r.records, r.duplicates, r.missing_evidence, r.conflicts, r.mean_latency_ms) == (4, 1, 1, 1, 20.0)
    assert r.status == "NOT COMPLETED"


def test_schema_operators(spark):
    df = spark.createDataFrame([(1, "x"), (2, " ")], "id long, session_id string")
    wide, added = M.ensure_columns(df, StructType.fromDDL("id long, note string"))
    assert added == ["note"] and M.ensure_columns(wide, StructType.fromDDL("note string"))[1] == []
    with pytest.raises(M.MissingColumns) as err:
        M.require_columns(df, ["id", "status", "path"])
    assert err.value.columns == ["status", "path"]
    assert [r.session_id for r in M.backfill_session_keys(df).orderBy("id").collect()] == ["x", "legacy-2"]


def test_empty_key_is_refused(spark):
    t = spark.createDataFrame([("a", 1)], "k string, id long")
    with pytest.raises(ValueError):
        K.insert_new(t, spark.createDataFrame([(" ", 2)], "k string, id long"), "k", ["id"])


def test_headerless_truth_and_missing_path(spark):
    path = scratch_path(spark, "truth")
    spark.createDataFrame([("a/x.jpg,ab1",), ("y.jpg,cd2",)], "value string").coalesce(1).write.text(path)
    got = {tuple(r) for r in R.read_truth(spark, path).collect()}
    assert got == {("x.jpg", "AB1", "ACCEPT"), ("y.jpg", "CD2", "ACCEPT")}
    assert R.read_jsonl(spark, path + "-no", StructType.fromDDL("a int")).count() == 0


def test_image_jobs_match_numpy(spark):
    rng = np.random.default_rng(1)
    pics = {"noise": rng.integers(0, 256, (32, 40)), "flat": np.full((16, 18), 250), "ramp": np.tile(np.arange(36) * 7, (8, 1))}
    rows = [(n, p.shape[0], p.shape[1], 1, bytes(p.astype(np.uint8).tobytes())) for n, p in pics.items()] + [("bad", None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, height int, width int, channels int, data binary")
    got = {r.id: r for r in I.image_features(df, ["id"]).collect()}
    assert got["bad"]["mean"] is None and got["flat"].saturated_ratio == 1.0 and got["flat"].blur == 0.0
    p = pics["noise"].astype(float)
    assert abs(got["noise"]["mean"] - p.mean()) < 1e-9 and abs(got["noise"]["std"] - p.std()) < 1e-9
    total = 0.0
    for y in range(32):
        for x in range(40):
            at = lambda a, n: -a if a < 0 else 2 * n - 2 - a if a >= n else a
            total += (p[at(y - 1, 32), x] + p[at(y + 1, 32), x] + p[y, at(x - 1, 40)] + p[y, at(x + 1, 40)] - 4 * p[y, x]) ** 2
    assert got["noise"].blur <= total / 1280 + 1e-6
    hashes = {r.id: r["hash"] for r in I.image_hashes(df, ["id"]).collect()}
    assert hashes["bad"] is None and hashes["flat"] == 0 and hashes["ramp"] == -1


def test_failing_model_gives_error_rows(spark):
    def broken(batch):
        raise RuntimeError("no model")

    rows = I.score_batch(spark.range(5), ["id"], broken, "score double").collect()
    assert len(rows) == 5 and all(r.error == "RuntimeError: no model" for r in rows)


def test_single_signal_timeline(spark):
    acc = spark.createDataFrame([("s", 1, 0), ("s", 2, 100_000)], "k string, session_id long, start_ms long")
    ids = spark.createDataFrame([(1, 10, 5_000, "A", 0.9), (1, 11, 6_000, "B", 0.9), (2, 12, 130_000, "C", 0.9), (9, 13, 1, "D", 0.5)], "session_id long, result_id long, at_ms long, value string, confidence double")
    tags = spark.createDataFrame([(1, 20, 7_000, "T")], "session_id long, result_id long, at_ms long, value string")
    exits = spark.createDataFrame([], "k string, exit_id long, at_ms long")
    rows, verdicts = T.session_timeline(acc, ids, tags, exits, ["k"], T.SessionParams(exit_mode=False))
    got = {r.session_id: r for r in rows.collect()}
    assert (got[1].status, got[1].identifier, got[1].tag, got[1].finalised_ms) == ("SUCCESS", "A", "T", 7_000)
    assert (got[2].status, got[2].identifier, got[2].tag, got[2].finalised_ms) == ("TIMEOUT", "C", "NO_TAG", 130_000)
    v = {r.result_id: r.verdict for r in verdicts.collect()}
    assert v[13] == "UNKNOWN_SESSION" and v[12] == "ACCEPTED"


def test_skew_join_equals_plain_join(spark, sliced):
    from marktrace.operators.joins import skew_join

    big = spark.range(500).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 20)).alias("k"), "id")
    small = spark.range(15).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = sorted(map(str, big.join(small, "k", "left").collect()))
    sliced(20)
    assert sorted(map(str, skew_join(big, small, ["k"], "left").collect())) == want


def test_exact_percentile_on_one_hot_key(spark, sliced):
    from marktrace.operators.aggregates import latency_summary

    sliced(15)
    df = spark.range(1000).select(F.lit("e").alias("k"), ((F.col("id") * 37) % 1000).cast("double").alias("v"))
    r = latency_summary(df, ["k"], "v").first()
    assert (r.n, r.p50, r.p95) == (1000, 499.5, 949.0)


def test_manifests_with_byte_order_mark(spark, tmp_path):
    """Windows tools put a mark in front of the header; a split without file gives no rows."""
    (tmp_path / "train.csv").write_bytes("\ufeffpath,label\na.png,K1\n".encode())
    (tmp_path / "test.csv").write_bytes(b"path,label\nb.png,K2\n")
    got = R.read_manifests(spark, str(tmp_path), ["train", "validation", "test"], StructType.fromDDL("path string, label string"))
    assert sorted(map(tuple, got.collect())) == [("a.png", "K1", "train"), ("b.png", "K2", "test")]
    assert sorted(got.filter("path = 'a.png'").select("label").first()) == ["K1"]


def test_review_dataset_ladders(spark):
    """Image classes and priorities of random rows by the written ladders; names and splits are checked by statements."""
    from marktrace.plans.curation import prepare_review_dataset

    rng = np.random.default_rng(12)
    pick = lambda *v: v[int(rng.integers(len(v)))]
    name, rows, told = "KDTA5C12304567890", [], []
    for i in range(400):
        rows.append((f"/img/a/S{i}_{pick(name, 'short')}_20240101-1200.jpg", int(pick(70, 80, 200)), int(pick(17, 18, 60)), float(pick(50, 65, 120, 190, 200)), float(pick(7, 8, 15, 16, 21, 22, 24, 25, 60)), float(pick(11, 12, 34, 35, 79, 80, 200)), float(pick(0.1, 0.55, 0.56)), float(pick(0.12, 0.13)), float(pick(0.0, 0.025, 0.026, 0.08, 0.09))))
        told.append((rows[-1][0], pick(name, "KDTA5C12304567891", "", "bad"), pick("ACCEPT", "NO_READ"), pick(name, "")))
    images = spark.createDataFrame(rows, "path string, width int, height int, mean double, std double, blur double, dark_ratio double, bright_ratio double, saturated_ratio double")
    out = prepare_review_dataset(images, spark.createDataFrame(told, "path string, ocr_suggested string, ocr_status string, ocr_raw_best string")).collect()
    assert len(out) == 400 and {r.review_priority for r in out} == {1, 2, 3, 4, 5}
    for r in out:
        light = "glare" if r.saturated_ratio > 0.025 and r.bright_ratio > 0.12 else "dark" if r["mean"] < 65 else "bright" if r["mean"] > 190 else "low_contrast" if r.std < 22 else "normal"
        if r.height < 18 or r.width < 80 or r.blur < 12 or r.std < 8:
            grade = "reject"
        elif r.blur < 35 or r.std < 16 or r.dark_ratio > 0.55 or r.saturated_ratio > 0.08:
            grade = "poor"
        else:
            grade = "medium" if r.blur < 80 or r.std < 25 or light != "normal" else "good"
        order = [not r.best_suggestion, r.ocr_status != "ACCEPT", bool(r.filename_guess) and r.filename_guess != r.ocr_suggested, grade in ("reject", "poor"), True]
        assert (r.lighting, r.quality, r.review_priority) == (light, grade, order.index(True) + 1), r
        assert r.agreement == ("yes" if r.filename_guess and r.filename_guess == r.ocr_suggested else "no")
