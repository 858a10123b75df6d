"""Joins of points and intervals with intervals: equal buckets first, so that Spark shuffles by key, then the exact condition.

An interval is listed under each bucket that it touches; a point under its own. The bucket width should be near the usual length of
an interval: then an interval has two or three buckets, and a bucket holds the rows of a stretch of one performance, however long
the performance is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bucket(x: Column, width: float) -> Column:
    return F.floor(x / F.lit(width)).cast("long")


def _listed(regions: DataFrame, lo: str, hi: str, width: float, name: str = "_bucket") -> DataFrame:
    return regions.withColumn(name, F.explode(F.sequence(_bucket(F.col(lo), width), _bucket(F.col(hi), width))))


def points_in(points: DataFrame, regions: DataFrame, width: float, key: str = "perf", t: str = "t", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Rows of ``points`` beside each region with lo <= t <= hi, both ends closed; empty regions (hi <= lo) match nothing.

    A point on a common edge matches both neighbours. Nulls match nothing. The regions' other columns come first.
    """
    # Where lo <= hi holds for all regions the sequence runs upwards; others are left out before.
    listed = _listed(regions.where(F.col(hi) > F.col(lo)), lo, hi, width)
    located = points.where(F.col(t).isNotNull()).withColumn("_at", _bucket(F.col(t), width))
    same = (listed[key] == located[key]) & (listed["_bucket"] == located["_at"])
    within = located[t].between(listed[lo], listed[hi])
    others = [located[c] for c in points.columns if c != key]
    return listed.join(located, same & within).select(*[listed[c] for c in regions.columns], *others)


def overlapping(left: DataFrame, right: DataFrame, width: float, key: str = "perf", closed: bool = True, how: str = "inner") -> DataFrame:
    """Pairs of intervals (lo, hi) and (r_lo, r_hi) of the same key that overlap; ``closed``: common ends count.

    A pair meets in one bucket only: the first that both touch. ``overlap`` is its length. how='left' keeps intervals alone.
    """
    a = _listed(left.where("hi >= lo"), "lo", "hi", width)
    b = _listed(right.where("r_hi >= r_lo").withColumnRenamed(key, "_key"), "r_lo", "r_hi", width, "_other")
    meets = (F.col("r_hi") >= F.col("lo")) & (F.col("r_lo") <= F.col("hi")) if closed else F.least("hi", "r_hi") > F.greatest("lo", "r_lo")
    first = a["_bucket"] == F.greatest(_bucket(F.col("lo"), width), _bucket(F.col("r_lo"), width))
    found = a.join(b, (a[key] == b["_key"]) & (a["_bucket"] == b["_other"]) & meets & first).drop("_key", "_bucket", "_other")
    found = found.withColumn("overlap", F.greatest(F.lit(0.0), F.least("hi", "r_hi") - F.greatest("lo", "r_lo")))
    if how == "inner":
        return found
    extra = [c for c in found.columns if c not in left.columns]
    alone = left.join(found.select(*left.columns).distinct(), left.columns, "left_anti")
    return found.unionByName(alone.select("*", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in extra]))


def near_equal(left: DataFrame, right: DataFrame, tolerance: float, key: str = "perf") -> DataFrame:
    """Pairs whose starts and ends both differ by at most ``tolerance``: a band join on the starts' buckets and their neighbours."""
    a = left.withColumn("_bucket", _bucket(F.col("lo"), tolerance))
    near = F.explode(F.array(*[_bucket(F.col("r_lo"), tolerance) + d for d in (-1, 0, 1)]))
    b = right.withColumnRenamed(key, "_key").withColumn("_other", near)
    # The ends of a binary fraction differ by rounding; a millionth of a second more is no difference.
    close = (F.abs(F.col("lo") - F.col("r_lo")) <= tolerance + 1e-9) & (F.abs(F.col("hi") - F.col("r_hi")) <= tolerance + 1e-9)
    return a.join(b, (a[key] == b["_key"]) & (a["_bucket"] == b["_other"]) & close).drop("_key", "_bucket", "_other")
