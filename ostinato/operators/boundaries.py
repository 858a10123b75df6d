"""Boundaries in curves: normalising, peaks with a least distance, fusing near duplicates, greedy choice, segmentation.

Curves are rows (perf, frame, value). The greedy steps need their own earlier choices, so they run over one performance's
candidates as an array, inside Spark's ``aggregate``; candidates are peaks, a small part of the frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ostinato.functions.scalars import clamp01, round6
from ostinato.operators import ordered


def normalised(curve: DataFrame) -> DataFrame:
    """Adds ``norm``: the value between the performance's least (0) and largest (1); flat curves are 0."""
    span = curve.groupBy("perf").agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    wide = F.col("_high") - F.col("_low")
    return curve.join(span, "perf").withColumn("norm", F.when(wide > 1e-9, (F.col("value") - F.col("_low")) / wide).otherwise(0.0)).drop("_low", "_high")


#: Frames in a block of a curve: neighbours are looked up block by block, so no task holds a whole curve.
FRAMES = 4096


def with_neighbours(curve: DataFrame, value: str = "norm") -> DataFrame:
    """Adds ``prev`` and ``next``: the values of the frames beside each one, null where there is no such frame."""
    block = F.floor(F.col("frame") / FRAMES).cast("long")
    beside = ordered.neighbours(curve.withColumn("_of", F.struct("frame", F.col(value).alias("x"))), ["perf"], block, ["frame"], {"_v": "_of"}, before=1, after=1)
    at = lambda c, shift: F.when(F.col(c)["frame"] == F.col("frame") + shift, F.col(c)["x"])
    return beside.withColumn("prev", at("_v_prev1", -1)).withColumn("next", at("_v_next1", 1)).drop("_of", "_v_prev1", "_v_next1")


def derivative(curve: DataFrame, value: str = "norm") -> DataFrame:
    """Adds ``change``: the absolute difference from the frame before, 0 for the first."""
    return with_neighbours(curve, value).withColumn("change", F.coalesce(F.abs(F.col(value) - F.col("prev")), F.lit(0.0))).drop("prev", "next")


def local_peaks(curve: DataFrame, threshold: float, value: str = "norm") -> DataFrame:
    """Frames at or over the threshold that no neighbour exceeds; the first and the last frame are none."""
    v = F.col(value)
    return with_neighbours(curve, value).where((v >= threshold) & (v >= F.col("prev")) & (v >= F.col("next"))).drop("prev", "next")


def refractory(peaks: DataFrame, distance: int) -> DataFrame:
    """perf, frame: peaks from left to right, each at least ``distance`` frames after the one taken before."""
    state = F.aggregate(
        F.array_sort(F.collect_list("frame")),
        F.array().cast("array<int>"),
        lambda taken, f: F.when((F.size(taken) == 0) | (f - F.element_at(taken, -1) >= distance), F.concat(taken, F.array(f))).otherwise(taken),
    )
    return peaks.groupBy("perf").agg(state.alias("f")).select("perf", F.explode("f").alias("frame"))


def fused(candidates: DataFrame, apart: float, bonus: float = 0.04) -> DataFrame:
    """candidates(perf, t, confidence, feature) -> perf, island, t, confidence, features: chains of gaps up to ``apart`` are one.

    The strongest of a chain gives the time (ties: the earliest, then by feature); each further feature adds ``bonus``.
    """
    order = Window.partitionBy("perf").orderBy("t", "feature")
    new = (F.col("t") - F.lag("t").over(order) > apart).cast("int")
    marked = candidates.withColumn("island", F.sum(F.coalesce(new, F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max_by(F.col("t"), F.struct(F.col("confidence"), -F.col("t")))
    grouped = marked.groupBy("perf", "island").agg(best.alias("t"), F.max("confidence").alias("c"), F.count_distinct("feature").alias("features"), F.count("*").alias("members"))
    return grouped.select("perf", "island", "t", round6(F.least(F.lit(1.0), F.col("c") + bonus * (F.col("features") - 1))).alias("confidence"), "features", "members")


def greedy_choice(candidates: DataFrame, distance: float, most: int) -> DataFrame:
    """perf, rank, t, confidence: the strongest first, none nearer than ``distance`` to one chosen before, ``most`` at most.

    Ties go to the earlier. ``most`` is the operator's own limit, per performance.
    """
    by_strength = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("minus"), F.col("t"))))
    chosen = F.aggregate(
        by_strength,
        F.array().cast("array<struct<minus: double, t: double>>"),
        lambda taken, c: F.when((F.size(taken) < most) & ~F.exists(taken, lambda x: F.abs(x["t"] - c["t"]) < distance), F.concat(taken, F.array(c))).otherwise(taken),
    )
    listed = candidates.groupBy("perf").agg(chosen.alias("x"))
    return listed.select("perf", F.posexplode("x").alias("i", "x")).select("perf", (F.col("i") + 1).alias("rank"), F.col("x.t").alias("t"), (-F.col("x.minus")).alias("confidence"))


def fixed_segments(duration: Column, width: float) -> Column:
    """An array of (idx, lo, hi) of equal width, the last one clipped."""
    n = F.greatest(F.lit(1), F.ceil(duration / width).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("idx"), (i * F.lit(width)).alias("lo"), F.least(duration, (i + 1) * F.lit(width)).alias("hi")))


def greedy_segments(boundaries: DataFrame, duration: float, target: float, shortest: float, longest: float) -> DataFrame:
    """perf, idx, lo, hi, reason: from each cut on, the boundary nearest to ``target`` seconds later becomes the next one.

    Boundaries under ``shortest`` or over ``longest`` from the cut don't count; without one the cut falls at the target. A rest of
    no more than ``longest`` is the last segment.
    """
    usable = F.filter(F.array_sort(F.collect_list("t")), lambda t: (t >= shortest) & (t <= duration - shortest))
    steps = F.sequence(F.lit(1), F.lit(int(duration // shortest) + 2))
    empty = F.array().cast("array<struct<lo: double, hi: double, reason: string>>")

    def step(done: Column, bounds: Column) -> Column:
        at = F.coalesce(F.get(done, F.size(done) - 1)["hi"], F.lit(0.0))
        near = F.filter(bounds, lambda t: t.between(at + shortest, F.least(F.lit(duration), at + longest)))
        best = F.array_min(F.transform(near, lambda t: F.struct(F.abs(t - (at + target)).alias("d"), t.alias("t"))))["t"]
        part = lambda hi, reason: F.struct(at.alias("lo"), hi.cast("double").alias("hi"), F.lit(reason).alias("reason"))
        rest = F.lit(duration) - at
        last = F.when(rest > target, part(F.lit(duration), "max_window_split")).otherwise(part(F.lit(duration), "low_energy_boundary"))
        cut = F.when(best.isNotNull(), part(best, "low_energy_boundary")).otherwise(part(F.least(F.lit(duration), at + target), "uncertain_fallback"))
        return F.when(at >= duration, done).otherwise(F.concat(done, F.array(F.when(rest <= longest, last).otherwise(cut))))

    listed = boundaries.groupBy("perf").agg(usable.alias("b"))
    parts = listed.select("perf", F.aggregate(steps, empty, lambda done, _: step(done, F.col("b"))).alias("s"))
    return parts.select("perf", F.posexplode("s").alias("idx", "s")).select("perf", "idx", round6(F.col("s.lo")).alias("lo"), round6(F.col("s.hi")).alias("hi"), "s.reason")


def linked(segments: DataFrame) -> DataFrame:
    """Adds the ids of a segment and of those before and after it."""
    order = Window.partitionBy("perf").orderBy("lo")
    name = lambda i: F.format_string("seg_%04d", i)
    n = F.row_number().over(order) - 1
    numbered = segments.withColumn("n", n).withColumn("last", F.lead("lo").over(order).isNull())
    return numbered.select("perf", name(F.col("n")).alias("segment_id"), F.when(F.col("n") > 0, name(F.col("n") - 1)).alias("previous_id"), F.when(~F.col("last"), name(F.col("n") + 1)).alias("next_id"), "lo", "hi")


def confidence(own: Column, novelty: Column) -> Column:
    return round6(clamp01(own * 0.65 + novelty * 0.35))
