"""Segments along scored boundary candidates, and what became of each candidate.

Candidates are rows (perf, t, confidence, tuned, eligible): a small part of a curve's frames. The walk from cut to cut needs its own
earlier choices, so it runs inside Spark's ``aggregate`` over one performance's candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ostinato.functions.scalars import clamp01, round6

#: What a segment rests on.
CHOSEN, FIXED = "audio_structure", "fixed_coverage"


def tuned(confidence: Column, evidence: Column) -> Column:
    """A candidate's confidence with a fifth of its evidence in it."""
    return clamp01(confidence * 0.8 + evidence * 0.2)


def usable(duration: float, shortest: float, threshold: float) -> Column:
    return F.col("eligible") & F.col("t").between(shortest, duration - shortest) & (F.col("tuned") >= threshold)


def structure_segments(candidates: DataFrame, duration: float, target: float, shortest: float, longest: float, threshold: float) -> DataFrame:
    """perf, idx, lo, hi, confidence, source: the next cut is the candidate whose confidence less its distance from the target is most.

    Candidates between ``shortest`` and ``longest`` seconds after the last cut count, ties go to the earlier; without one the cut
    falls at the target. A rest of no more than ``longest`` is the last segment. Performances without candidates have no rows.
    """
    steps = F.sequence(F.lit(1), F.lit(int(duration // shortest) + 2))
    empty = F.array().cast("array<struct<lo: double, hi: double, confidence: double, source: string>>")
    wide = max(1.0, target)

    def step(done: Column, bounds: Column) -> Column:
        at = F.coalesce(F.get(done, F.size(done) - 1)["hi"], F.lit(0.0))
        found = F.exists(done, lambda s: s["source"] == CHOSEN)
        near = F.filter(bounds, lambda c: c["t"].between(at + shortest, F.least(F.lit(duration), at + longest)))
        best = F.array_max(F.transform(near, lambda c: F.struct((c["confidence"] - F.abs(c["t"] - (at + target)) / wide).alias("gain"), (-c["t"]).alias("minus"), c["tuned"].alias("tuned"))))
        part = lambda hi, sure, source: F.struct(at.alias("lo"), hi.cast("double").alias("hi"), sure.cast("double").alias("confidence"), source.alias("source"))
        last = part(F.lit(duration), F.when(found, 0.6).otherwise(0.2), F.when(found, CHOSEN).otherwise(FIXED))
        cut = F.when(best.isNotNull(), part(-best["minus"], best["tuned"], F.lit(CHOSEN))).otherwise(part(F.least(F.lit(duration), at + target), F.lit(0.2), F.lit(FIXED)))
        return F.when(at >= duration, done).otherwise(F.concat(done, F.array(F.when(F.lit(duration) - at <= longest, last).otherwise(cut))))

    bounds = F.array_sort(F.collect_list(F.when(usable(duration, shortest, threshold), F.struct("t", "confidence", "tuned"))))
    listed = candidates.groupBy("perf").agg(bounds.alias("b"))
    parts = listed.select("perf", F.aggregate(steps, empty, lambda done, _: step(done, F.col("b"))).alias("s"))
    return parts.select("perf", F.posexplode("s").alias("idx", "s")).select("perf", "idx", "s.lo", "s.hi", round6(F.col("s.confidence")).alias("confidence"), "s.source")


def nearest(points: DataFrame, marks: DataFrame) -> DataFrame:
    """points(perf, t, ...) with ``distance`` to the nearest of marks(perf, t); null without any. No pairs are made."""
    both = points.withColumn("_mark", F.lit(None).cast("double")).unionByName(marks.select("perf", "t", F.col("t").alias("_mark")), allowMissingColumns=True)
    up, down = (Window.partitionBy("perf").orderBy(order).rangeBetween(Window.unboundedPreceding, 0) for order in (F.asc("t"), F.desc("t")))
    side = lambda window: F.abs(F.col("t") - F.last("_mark", ignorenulls=True).over(window))
    # Each mark is a row of its own; those rows go again.
    return both.withColumn("distance", F.least(side(up), side(down))).where("_mark is null").drop("_mark")


def candidate_evaluations(candidates: DataFrame, segments: DataFrame, duration: float, shortest: float, longest: float, threshold: float) -> DataFrame:
    """Each candidate with its distance to the nearest cut that was chosen, and why it was accepted or not."""
    cuts = segments.where((F.col("source") == CHOSEN) & (F.col("hi") < duration)).select("perf", F.col("hi").alias("t"))
    d = F.col("distance")
    reason = (
        F.when(d <= 1e-6, "accepted")
        .when(~F.col("eligible"), "unused_candidate")
        .when(~F.col("t").between(shortest, duration - shortest), "violates_min_segment_seconds")
        .when(F.col("tuned") < threshold, "below_threshold")
        .when(d < shortest, "too_close_to_previous_boundary")
        .when(d > longest, "exceeds_max_segment_seconds_split")
        .otherwise("unused_candidate")
    )
    return nearest(candidates, cuts).withColumn("distance", round6(d)).withColumn("reason", reason)
