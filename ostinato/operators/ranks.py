"""Exact quantiles of keys of any size: distributed selection by rank.

A mergeable sketch of each key brackets every wanted rank between two values, with a guaranteed rank error; only rows inside a bracket are
counted by value, and how many lie below it is a pre-aggregated sum. So no key's rows are sorted, listed or held in one task: of a large
key the brackets keep about one row in 500 a quantile, and small keys, of at most SMALL rows, are their own bracket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sketch's ranks are off by at most n / ACCURACY; a bracket reaches REACH of all ranks to both sides, which is far more.
SMALL, ACCURACY, REACH = 20_000, 10_000, 0.001


def quantiles(rows: DataFrame, key: list[str], value: str, points: dict[str, float], linear: bool = False, small: int = SMALL) -> DataFrame:
    """key, n and one column for each of ``points`` (name: p): the value at rank (n - 1) p of the key's sorted values.

    ``linear`` interpolates between the two ranks beside it; otherwise the rank is rounded, halves to even. Null values don't count, keys
    without values have no row, null keys are keys. Equal values are counted, not listed. ``small`` must be at least 2000, for brackets
    to hold their ranks. ``rows`` is read three times: write it first if it is dear.
    """
    if small < 2_000:
        raise ValueError("brackets need keys of at least 2000 values")
    have = rows.where(F.col(value).isNotNull()).select(*key, F.col(value).alias("_x"))
    names, ps = list(points), list(points.values())
    edges = [max(0.0, p - REACH) for p in ps] + [min(1.0, p + REACH) for p in ps]
    marks = have.groupBy(*key).agg(F.count("*").alias("_n"), F.percentile_approx("_x", edges, ACCURACY).alias("_m"))
    named = marks.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], "_n", "_m")
    same = F.lit(True)
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    placed = have.join(named, same)
    whole = F.col("_n") <= small
    low, high = (lambda i: F.get("_m", F.lit(i))), (lambda i: F.get("_m", F.lit(len(ps) + i)))
    # Beside its bracket a row is only counted: -1 below, and nothing above.
    side = lambda i: F.when(whole | F.col("_x").between(low(i), high(i)), F.struct(F.lit(i).alias("i"), F.lit(True).alias("in"))).when(F.col("_x") < low(i), F.struct(F.lit(i).alias("i"), F.lit(False).alias("in")))
    met = placed.select(*key, "_n", "_x", F.explode(F.array_compact(F.array(*[side(i) for i in range(len(ps))]))).alias("s"))
    counted = met.groupBy(*key, "_n", "s.i", F.when(F.col("s.in"), F.col("_x")).alias("_x")).agg(F.count("*").alias("c"), F.first("s.in").alias("in"))
    order = Window.partitionBy(*key, "i").orderBy(F.col("in"), "_x")
    ranked = counted.withColumn("_end", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = (F.col("_n") - 1) * F.get(F.array(*[F.lit(float(p)) for p in ps]), F.col("i"))
    first, last = (F.floor(at), F.ceil(at)) if linear else (F.bround(at), F.bround(at))
    holds = lambda k: F.col("in") & (F.col("_end") - F.col("c") <= k) & (k < F.col("_end"))
    picked = ranked.groupBy(*key, F.col("_n").alias("n"), "i").agg(F.max(F.when(holds(first), F.col("_x"))).alias("a"), F.max(F.when(holds(last), F.col("_x"))).alias("b"), F.max(at - F.floor(at)).alias("part"))
    result = F.when(F.col("part") == 0, F.col("a")).otherwise((1 - F.col("part")) * F.col("a") + F.col("part") * F.col("b")) if linear else F.col("a")
    return picked.groupBy(*key, "n").agg(*[F.max(F.when(F.col("i") == i, result)).alias(name) for i, name in enumerate(names)])


def distribution(rows: DataFrame, key: list[str], value: str, mean: Column) -> DataFrame:
    """key, n, mean, least, p25, p50, p75, most of a value: nearest ranks; ``mean`` is the aggregate that gives the mean."""
    base = rows.where(F.col(value).isNotNull()).groupBy(*key).agg(mean.alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    named = base.select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(key)], "mean", "least", "most")
    same = F.lit(True)
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_j{i}"))
    picked = quantiles(rows, key, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return picked.join(named, same).select(*key, "n", "mean", "least", "p25", "p50", "p75", "most")
