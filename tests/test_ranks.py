"""Exact quantiles against sorted lists: small keys, keys over the bracket's limit, skewed and equal values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ostinato.operators import ranks


def plain(values, p, linear):
    v = sorted(values)
    at = (len(v) - 1) * p
    return float(np.percentile(v, 100 * p)) if linear else v[round(at)]


@pytest.mark.parametrize("linear", [False, True])
def test_quantiles(spark, linear):
    rng = random.Random(1)
    sets = {
        "uniform": [rng.random() for _ in range(9000)], "skewed": [rng.lognormvariate(0, 5) for _ in range(7001)], "equal": [1.0] * 5000, "two": [0.0] * 3000 + [1.0] * 3001,
        "heavy": [0.5] * 4000 + [rng.random() for _ in range(2001)], "one": [3.0], "pair": [1.0, 2.0], "three": [5.0, 1.0, 9.0], None: [rng.gauss(0, 1) for _ in range(2500)], "edge": [float(i) for i in range(2000)], "over": [float(i) for i in range(2001)],
    }
    rows = [(k, x) for k, v in sets.items() for x in v] + [("one", None), ("none", None)]
    rng.shuffle(rows)
    points = {"least": 0.0, "low": 0.001, "q": 0.25, "half": 0.5, "odd": 0.777, "most": 1.0}
    df = spark.createDataFrame(rows, "perf string, x double").repartition(4)
    got = {r["perf"]: r for r in ranks.quantiles(df, ["perf"], "x", points, linear, small=2000).collect()}
    assert set(got) == set(sets)
    for k, v in sets.items():
        assert got[k]["n"] == len(v)
        for name, p in points.items():
            assert got[k][name] == pytest.approx(plain(v, p, linear), abs=1e-12, rel=1e-12), (k, name)


def test_distribution_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 2.0), (None, 5.0), ("a", None)], "perf string, x double")
    got = {r["perf"]: tuple(r)[1:] for r in ranks.distribution(df, ["perf"], "x", F.avg("x")).collect()}
    assert got == {"a": (3, 2.0, 1.0, 1.0, 2.0, 3.0, 3.0), None: (1, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0)}
    assert ranks.quantiles(df.limit(0), ["perf"], "x", {"p": 0.5}).collect() == []
    with pytest.raises(ValueError):
        ranks.quantiles(df, ["perf"], "x", {"p": 0.5}, small=10)
