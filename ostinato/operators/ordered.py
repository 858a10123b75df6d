"""Neighbours in a long order without one task per key: blocks of the order first, then the blocks' edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(df: DataFrame, key: list[str], block: Column, order: list[str], values: dict[str, str], before: int = 0, after: int = 1) -> DataFrame:
    """Adds ``<name>_prev<i>`` (i up to ``before``) and ``<name>_next<i>`` (i up to ``after``) for each name -> column of ``values``.

    ``block`` is a whole number that never falls along ``order`` within ``key``; ``order`` must leave no ties. The input is evaluated
    once and joined with nothing: a first window gives every row its neighbours inside its block, and the number of rows to the
    block's ends. Only the rows near an end meet in a second window by key, where the blocks' ends follow each other; all others
    keep their block. So a key with a third of all rows is as many tasks as it has blocks.
    """
    reach = max(before, after)
    rows = df.withColumn("_block", block)
    inside = Window.partitionBy(*key, "_block").orderBy(*order)
    shifts = [(name, c, "prev", i) for name, c in values.items() for i in range(1, before + 1)] + [(name, c, "next", i) for name, c in values.items() for i in range(1, after + 1)]
    step = lambda c, side, i, w: (F.lag if side == "prev" else F.lead)(F.struct(F.col(c).alias("x")), i).over(w)
    rows = rows.withColumns({f"_{name}_{side}{i}": step(c, side, i, inside) for name, c, side, i in shifts})
    # A row whose reach leaves the block is an edge, and so is every row that it then needs.
    rows = rows.withColumns({"_first": F.row_number().over(inside), "_size": F.count("*").over(Window.partitionBy(*key, "_block"))})
    edge = (F.col("_first") <= reach) | (F.col("_first") > F.col("_size") - reach)
    rows = rows.withColumn("_group", F.when(~edge, F.col("_block")))
    across = Window.partitionBy(*key, "_group").orderBy(*order)
    own = {f"{name}_{side}{i}": F.coalesce(f"_{name}_{side}{i}", F.when(F.col("_group").isNull(), step(c, side, i, across)))["x"] for name, c, side, i in shifts}
    return rows.withColumns(own).drop("_block", "_first", "_size", "_group", *(f"_{name}_{side}{i}" for name, _, side, i in shifts))


def with_next(df: DataFrame, key: list[str], block: Column, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the value of the next row in the order of ``order`` within ``key``; see :func:`neighbours`."""
    return neighbours(df, key, block, order, {"_v": value}, after=1).withColumnRenamed("_v_next1", name)


def running_sum(df: DataFrame, key: list[str], block: Column, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` up to and with each row, in two steps as above."""
    blocked = df.withColumn("_block", block)
    inside = Window.partitionBy(*key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = blocked.groupBy(*key, "_block").agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sums.select(*key, "_block", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    return blocked.withColumn("_own", F.sum(value).over(inside)).join(earlier, [*key, "_block"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_block", "_own", "_before")


def nearest_rank(values: Column, p: float) -> Column:
    """The element of a sorted list at (n - 1) p, rounded half to even: no interpolation."""
    ordered = F.sort_array(values)
    return F.get(ordered, F.bround((F.size(ordered) - 1) * F.lit(p)).cast("int"))
