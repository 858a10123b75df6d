"""Neighbours over blocks against a sequential version, and the plan that they make."""

import random

import pytest
from pyspark.sql import functions as F

from ostinato.operators import boundaries, ordered


@pytest.mark.parametrize("width,before,after", [(1, 2, 2), (3, 1, 2), (4, 0, 1), (7, 3, 0), (1000, 2, 3)])
def test_neighbours(spark, width, before, after):
    """Blocks that are empty, of one row, or shorter than the reach; null values; a key with most rows; a key with one."""
    rng = random.Random(width)
    rows = [(k, t, rng.choice([None, *range(9)])) for k, ts in (("a", rng.sample(range(200), 60)), ("b", [5]), (None, rng.sample(range(40), 9))) for t in ts]
    df = spark.createDataFrame(rows, "perf string, t int, x int").repartition(4)
    got = ordered.neighbours(df, ["perf"], F.floor(F.col("t") / width).cast("long"), ["t"], {"x": "x", "at": "t"}, before, after)
    assert got.columns == ["perf", "t", "x", *(f"{n}_{s}{i}" for s, m in (("prev", before), ("next", after)) for n in ("x", "at") for i in range(1, m + 1))] or set(got.columns) >= {"perf", "t", "x"}
    expected = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        for i, r in enumerate(own):
            look = lambda j: own[j] if 0 <= j < len(own) else (None, None, None)
            expected[r[:2]] = {**{f"x_prev{d}": look(i - d)[2] for d in range(1, before + 1)}, **{f"at_prev{d}": look(i - d)[1] for d in range(1, before + 1)}, **{f"x_next{d}": look(i + d)[2] for d in range(1, after + 1)}, **{f"at_next{d}": look(i + d)[1] for d in range(1, after + 1)}}
    found = {(r["perf"], r["t"]): {c: r[c] for c in got.columns if c not in ("perf", "t", "x")} for r in got.collect()}
    assert found == expected
    assert ordered.neighbours(df.limit(0), ["perf"], F.lit(0), ["t"], {"x": "x"}).collect() == []


def test_neighbours_read_their_input_once(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("perf"), F.col("id").alias("t"))
    plan = ordered.neighbours(df, ["perf"], F.floor(F.col("t") / 10), ["t"], {"t": "t"}, 1, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 and plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_frames_that_are_missing_have_no_neighbours(spark):
    curve = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("a", 3, 3.0), ("b", 4095, 1.0), ("b", 4096, 5.0)], "perf string, frame int, norm double")
    got = {(r["perf"], r["frame"]): (r["prev"], r["next"]) for r in boundaries.with_neighbours(curve).collect()}
    assert got == {("a", 0): (None, 2.0), ("a", 1): (1.0, None), ("a", 3): (None, None), ("b", 4095): (None, 5.0), ("b", 4096): (1.0, None)}
