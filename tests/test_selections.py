"""Selections on literal rows: nulls, ties, blanks and what is missing."""

from pyspark.sql import functions as F

from ostinato.operators import selections


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_sources(spark):
    runs = spark.createDataFrame([(1, "m1"), (2, None), (3, "gone"), (4, None)], "run long, merged string")
    windows = spark.createDataFrame([(2, 20, "success", " w20 "), (2, 21, "pending", "w21"), (2, 22, None, "w22"), (3, 30, "success", "w30"), (3, 31, "success", " "), (3, 32, "success", "lost"), (1, 10, "success", "w10")], "run long, window_id long, status string, path string")
    files = spark.createDataFrame([("m1",), ("w20",), ("w21",), ("w22",), ("w30",), ("w10",), ("w20",)], "path string")
    assert rows(selections.midi_sources(runs, windows, files), "run", "mode", "path", "window_id") == [(1, "merged", "m1", None), (2, "window_fallback", "w20", 20), (3, "window_fallback", "w30", 30), (4, "no_midi", None, None)]


def test_latest_pointer(spark):
    c = spark.createDataFrame([("a", "run", 9), ("a", "legacy", 1), ("b", "run", 3), ("b", "run", 5), ("c", "latest", 2), ("c", "legacy", 8)], "source string, pointer string, run_id long")
    assert rows(selections.latest_pointed(c), "source", "pointer", "run_id") == [("a", "legacy", 1), ("b", "run", 5), ("c", "latest", 2)]


def test_range_and_fields(spark):
    ends = spark.createDataFrame([("1", "2"), ("2", "1"), ("1", "1"), (None, "1"), ("x", "1"), ("1", None)], "s string, e string")
    assert [r[0] for r in ends.select(selections.range_valid(F.col("s"), F.col("e"))).collect()] == [True, False, True, False, False, False]
    records = spark.createDataFrame([(1, 0.5, "m", None), (2, None, None, "h"), (3, None, None, None)], "id long, start_seconds double, tag string, secret string")
    assert rows(selections.whitelisted(records, ["id"], selections.ACCEPTED_FIELDS), "id", "kept", "excluded") == [(1, "start_seconds", "tag"), (2, "", "secret"), (3, "", "")]
    assert rows(selections.field_trust(records, ["id"]), "id", "trust") == [(1, "weak_label"), (2, "empty"), (3, "empty")]


def test_last_wins_and_same_kind(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "id long, k string")
    right = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 5, "n")], "k string, seq long, v string")
    assert rows(selections.last_wins(left, right, "k", "seq", "v"), "id", "v") == [(1, "y"), (2, "n"), (3, None)]
    own = spark.createDataFrame([(1, "w", "bin"), (2, "w", "window"), (3, "q", "bin")], "id long, key string, kind string")
    other = spark.createDataFrame([("w", "bin", 9, "b9"), ("w", "bin", 4, "b4"), ("w", "phrase", 1, "p1")], "key string, kind string, seq long, v string")
    assert rows(selections.same_kind_first(own, other, ["key"], ["id"], "seq", "v"), "id", "v") == [(1, "b4"), (2, "p1"), (3, None)]


def test_batches_and_tuning(spark):
    songs = spark.createDataFrame([(1, "a", True, "own", True), (2, " ", None, "Splice", True), (2, "x/*", True, None, False)], "batch long, path string, authorized boolean, source string, training boolean")
    samples = spark.createDataFrame([(2, 200)], "batch long, items long")
    assert rows(selections.batch_plan(songs, samples), "batch", "errors", "burden", "status") == [(1, "", "low", "valid"), (2, "folder_or_wildcard,missing_path,not_authorized,splice_training,too_many_samples", "high", "invalid")]
    bends = spark.createDataFrame([("p", 0), ("p", 3), ("q", 0), ("q", None)], "perf string, pitch int")
    assert rows(selections.tuning_evidence(bends), "perf", "evidence", "confidence") == [("p", "pitch_bend", 0.36), ("q", "external_analyzer_required", 0.15)]


def test_regions_and_windows(spark):
    lengths = spark.createDataFrame([("p", 30.0), ("q", 0.0), ("r", 800.0)], "perf string, seconds double")
    assert rows(selections.fallback_regions(lengths).where("perf = 'p'"), "idx", "lo", "hi") == [(0, 0.0, 12.0), (1, 12.0, 24.0), (2, 24.0, 30.0)]
    assert selections.fallback_regions(lengths).where("perf = 'r'").count() == 17
    groups = spark.createDataFrame([("g", [1, 2, 3]), ("h", [2, 9]), ("i", [])], "group string, ids array<int>")
    windows = spark.createDataFrame([(1,), (3,), (9,)], "window int")
    assert rows(selections.first_two_windows(groups, windows), "group", "first", "second") == [("g", 1, 3)]
