"""Harmony listings, root sequences and chord runs on literal rows."""

import pytest

from ostinato.operators import harmony


def test_listings_and_sequences(spark):
    rows = [("a", 0, 3, 0.5, "5 5 2 7 1"), ("a", 1, 1, 0.2, "5 5 2 7 9"), ("a", 2, 3, 0.9, "2 2"), ("a", 3, 0, 0.49, ""), ("b", 0, 2, 0.1, "5 5 2 7")]
    motion = spark.createDataFrame(rows, "perf string, part int, changes long, repeated double, intervals string")
    got = sorted((r["perf"], r["listing"], r["rank"], r["part"]) for r in harmony.motion_regions(motion, vamps=2, listed=2).collect())
    assert got == [("a", "active", 1, 0), ("a", "active", 2, 2), ("a", "static", 1, 3), ("a", "static", 2, 1), ("a", "vamp", 1, 0), ("a", "vamp", 2, 2), ("b", "active", 1, 0), ("b", "static", 1, 0)]
    assert [tuple(r) for r in harmony.root_sequences(motion).collect()] == [("a", 1, "5-5-2-7", 2)]
    assert [tuple(r) for r in harmony.common_intervals(motion, k=2).orderBy("perf", "rank").collect()] == [("a", 1, 5, 4), ("a", 2, 2, 4), ("b", 1, 5, 2), ("b", 2, 2, 1)]


@pytest.mark.parametrize("block", [1, 2, 1024])
def test_runs_end_at_other_chords_and_at_gaps(spark, monkeypatch, block):
    monkeypatch.setattr(harmony, "RUN_BLOCK", block)
    chords = [(0, 0, "major"), (1, 0, "major"), (2, 0, "minor"), (3, 0, "minor"), (5, 0, "minor"), (6, 0, "minor"), (7, 0, "minor"), (8, 2, "minor")]
    timeline = spark.createDataFrame([("a", i, i * 4.0, i * 4.0 + 4, r, q) for i, r, q in chords], "perf string, idx int, lo double, hi double, root int, quality string")
    got = sorted((r["run"], r["first"], r["last"], r["bins"], r["lo"], r["hi"]) for r in harmony.chord_runs(timeline).collect())
    assert got == [(1, 0, 1, 2, 0.0, 8.0), (2, 2, 3, 2, 8.0, 16.0), (3, 5, 7, 3, 20.0, 32.0), (4, 8, 8, 1, 32.0, 36.0)]
