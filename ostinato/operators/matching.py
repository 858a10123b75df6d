"""One-to-one matching of two lists of times, and what two runs have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.operators import ordered

#: Sums of binary fractions differ by rounding; so much more than the tolerance is no difference.
SLACK = 1e-9

_STATE = "struct<waiting: array<double>, side: int, found: array<struct<first: double, second: double>>>"


def one_to_one(first: DataFrame, second: DataFrame, tolerance: float, key: str = "perf", t: str = "t") -> DataFrame:
    """key, first, second: as many pairs at most ``tolerance`` apart as can be, each time in one pair only; those alone have a null partner.

    From left to right each time takes the earliest that waits on the other side. Only times in a chain of gaps up to the tolerance
    can meet, so chains are found first, by windows over blocks of time, and each is matched by itself. In lists whose own times lie
    more than twice the tolerance apart a chain has two times at most. Repeated times are matched each; null times and null keys are
    left out.
    """
    side = lambda df, n: df.where(F.col(t).isNotNull() & F.col(key).isNotNull()).select(key, F.col(t).cast("double").alias("_t"), F.lit(n).alias("_side"))
    both = side(first, 0).unionByName(side(second, 1)).groupBy(key, "_t", "_side").agg(F.count("*").alias("_n"))
    width = max(tolerance, 1e-6) * 256
    block = F.floor(F.col("_t") / F.lit(width)).cast("long")
    chained = ordered.neighbours(both, [key], block, ["_t", "_side"], {"_at": "_t"}, before=1, after=0)
    apart = F.coalesce(F.col("_t") - F.col("_at_prev1") > tolerance + SLACK, F.lit(True))
    numbered = ordered.running_sum(chained.withColumn("_new", apart.cast("long")), [key], block, ["_t", "_side"], "_new", "_chain")
    listed = numbered.groupBy(key, "_chain").agg(F.array_sort(F.collect_list(F.struct("_t", "_side", "_n"))).alias("_x"))
    single = F.flatten(F.transform("_x", lambda e: F.array_repeat(F.struct(e["_t"].alias("t"), e["_side"].alias("side")), e["_n"].cast("int"))))
    start = F.expr(f"cast(struct(array(), 0, array()) as {_STATE})")
    pairs = F.aggregate(single, start, lambda state, e: _step(state, e, tolerance), lambda state: F.concat(state["found"], _alone(state["waiting"], state["side"])))
    return listed.select(key, F.explode(pairs).alias("_p")).select(key, "_p.first", "_p.second")


def _pair(a: Column, b: Column) -> Column:
    return F.struct(a.cast("double").alias("first"), b.cast("double").alias("second"))


def _alone(times: Column, side: Column) -> Column:
    return F.transform(times, lambda x: _pair(F.when(side == 0, x), F.when(side == 1, x)))


def _step(state: Column, e: Column, tolerance: float) -> Column:
    """One time more: those too early for it are alone, then it takes the first that waits on the other side, or waits itself."""
    late = lambda x: e["t"] - x > tolerance + SLACK
    waiting, gone = F.filter(state["waiting"], lambda x: ~late(x)), _alone(F.filter(state["waiting"], late), state["side"])
    meets = (F.size(waiting) > 0) & (state["side"] != e["side"])
    head = F.get(waiting, F.lit(0))
    partners = _pair(F.when(e["side"] == 0, e["t"]).otherwise(head), F.when(e["side"] == 0, head).otherwise(e["t"]))
    left = F.when(meets, F.filter(waiting, lambda x, i: i > 0)).otherwise(F.concat(waiting, F.array(e["t"])))
    side = F.when(meets, state["side"]).otherwise(e["side"])
    found = F.concat(state["found"], gone, F.when(meets, F.array(partners)).otherwise(F.expr("cast(array() as array<struct<first: double, second: double>>)")))
    return F.struct(left.alias("waiting"), side.alias("side"), found.alias("found"))


def status(pairs: DataFrame) -> DataFrame:
    """Adds ``status``: in both runs, or only in one of them."""
    return pairs.withColumn("status", F.when(F.col("second").isNull(), "only_first").when(F.col("first").isNull(), "only_second").otherwise("both"))


def run_summary(evaluated: DataFrame, key: list[str], top: int = 3) -> DataFrame:
    """evaluated(key, t, tuned, reason) -> key, candidates, reasons as name:count, the ``top`` candidates as time@confidence.

    Reasons are counted before they are listed; of candidates a bounded heap of ``top`` is what a group keeps: ranks cut the rows first.
    """
    from pyspark.sql import Window

    reasons = evaluated.groupBy(*key, "reason").agg(F.count("*").alias("n"))
    named = F.transform(F.array_sort(F.collect_list(F.struct("reason", "n"))), lambda r: F.concat_ws(":", r["reason"], r["n"].cast("string")))
    counted = reasons.groupBy(*key).agg(F.sum("n").alias("candidates"), F.array_join(named, ",").alias("reasons"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("tuned"), "t"))
    first = evaluated.withColumn("_rank", rank).where(F.col("_rank") <= top)
    shown = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "t", "tuned"))), lambda c: F.concat_ws("@", c["t"].cast("string"), c["tuned"].cast("string")))
    return counted.join(first.groupBy(*key).agg(F.array_join(shown, ",").alias("top_candidates")), key)
