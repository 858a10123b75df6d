"""Splits, weights and reasons of records written out by hand."""

from ostinato.operators import trust

#: record_id, performance_id, start, end, paths, version, window_id, granularity, label_status, confidence -> tier, score, weight, split, reasons
CASES = [
    (("a", "p", 0.0, 1.0, "{}", "1", "w1", "bin", "derived_observation", 0.5), ("high", 0.9, 1.0, trust.ACCEPTED, ["observed"])),
    (("b", "p", 0.0, 1.0, "{}", "1", "w2", "bin", "raw_observation", 0.4), ("medium", 0.6, 0.7, trust.ACCEPTED, ["observed"])),
    (("c", "p", 0.0, 1.0, "{}", "1", "w1", "bin", "derived_observation", 0.39), ("high", 0.9, 1.0, trust.REVIEW, ["rest"])),
    (("d", "p", 0.0, 1.0, "{}", "1", "w2", "bin", "other", 0.5), ("medium", 0.6, 0.6, trust.PLAIN, ["plain"])),
    (("e", "p", 0.0, 1.0, "{}", "1", "w1", "bin", None, 0.5), ("high", 0.9, 0.7, trust.WEAK, ["weak"])),
    (("f", "p", 0.0, 1.0, "{}", "1", "w1", "bin", "model_prediction", None), ("high", 0.9, 1.0, trust.REVIEW, ["weak_unsure"])),
    (("g", "p", 0.0, 1.0, "{}", "1", "w3", "bin", "weak_label", 0.9), ("failed", 0.0, 0.0, trust.REVIEW, ["weak_unsure"])),
    (("h", "p", 0.0, 1.0, "{}", "1", "none", "bin", "human_verified_label", 0.0), ("low", 0.0, 0.9, trust.ACCEPTED, ["verified"])),
    (("i", "p", 0.0, 0.0, "{}", "1", None, "segment", "derived_observation", 0.5), ("high", 0.95, 1.0, trust.ACCEPTED, ["observed"])),
    (("j", "p", 0.0, 1.0, "{}", "1", "w3", "segment", "derived_observation", 0.5), ("failed", 0.0, 0.0, trust.REVIEW, ["rest"])),
    (("k", "barred", 0.0, 1.0, "{}", "1", "w1", "bin", "human_verified_label", 0.9), ("high", 0.9, 1.0, trust.REVIEW, ["gate"])),
    (("l", "unknown", 0.0, 1.0, "{}", "1", "w1", None, "human_verified_label", 0.9), ("high", 0.9, 1.0, trust.ACCEPTED, ["verified"])),
    ((" ", None, 2.0, 1.0, None, None, "w1", "bin", "human_verified_label", 0.9), (None, None, None, trust.QUARANTINED, ["missing record_id", "missing performance_id", "invalid time range", "missing source_artifact_paths", "missing feature_version"])),
    (("n", "barred", None, 1.0, "{}", "1", "w1", "bin", "human_verified_label", 0.9), (None, None, None, trust.QUARANTINED, ["invalid time range"])),
]
COLUMNS = "record_id string, performance_id string, start_seconds double, end_seconds double, source_artifact_paths string, feature_version string, window_id string, granularity string, label_status string, confidence double"


def test_each_case(spark):
    records = spark.createDataFrame([c for c, _ in CASES], COLUMNS)
    windows = spark.createDataFrame([("w1", "high", 0.9, 1.0), ("w2", "medium", 0.6, 0.5), ("w3", "failed", 0.0, 0.0), (None, "high", 1.0, 1.0)], "window_id string, tier string, score double, weight double")
    gates = spark.createDataFrame([("p", "accepted"), ("barred", "quarantined"), (None, "accepted")], "performance_id string, gate_status string")
    got = {r["record_id"]: (r["tier"], r["score"], r["weight"], r["split"], r["reasons"]) for r in trust.classified(records, windows, gates).collect()}
    assert got == {c[0]: (*told[:4], [trust.REASONS.get(x, x) for x in told[4]]) for c, told in CASES}
    assert trust.classified(records.limit(0), windows, gates).collect() == []


def test_repeated_records_and_other_columns_stay(spark):
    records = spark.createDataFrame([CASES[0][0]] * 3, COLUMNS).selectExpr("*", "1 as other")
    windows = spark.createDataFrame([("w1", "high", 0.9, 1.0)], "window_id string, tier string, score double, weight double")
    rows = trust.classified(records, windows, spark.createDataFrame([], "performance_id string, gate_status string")).collect()
    assert len(rows) == 3 and {r["other"] for r in rows} == {1}
