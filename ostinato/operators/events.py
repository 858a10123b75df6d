"""Note events: on/off pairing, reliability of windows, stitching, and transforms of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ostinato.functions.scalars import round6

LEAST_LENGTH = 1e-4


def pair_on_off(messages: DataFrame, least: float = LEAST_LENGTH) -> DataFrame:
    """messages(perf, channel, note, seq, t, vel, delta: 1 on, -1 off) -> perf, channel, note, vel, start, end; first on, first off.

    Each key is a queue. An off takes something only if the queue isn't empty: with S the running sum of deltas and m its running
    minimum (0 at most), S - m is the queue's length. So the k-th off that takes something belongs to the k-th on. Ons that stay
    in the queue are dropped; no length is under ``least``. Messages at the same time keep the order of ``seq``.
    """
    key = ["perf", "channel", "note"]
    order = Window.partitionBy(*key).orderBy("t", "seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    run = messages.withColumn("s", F.sum("delta").over(upto))
    run = run.withColumn("queue", F.col("s") - F.least(F.lit(0), F.min("s").over(upto)))
    run = run.withColumn("before", F.coalesce(F.lag("queue").over(order), F.lit(0)))
    counts = run.withColumn("nth", F.sum(F.when(F.col("delta") > 0, 1).when(F.col("before") > 0, 1).otherwise(0)).over(Window.partitionBy(*key, "delta").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)))
    ons = counts.where("delta > 0").select(*key, "nth", "vel", F.col("t").alias("start"))
    offs = counts.where("delta < 0 and before > 0").select(*key, "nth", F.col("t").alias("end"))
    return ons.join(offs, [*key, "nth"]).select(*key, "vel", "start", F.greatest(F.col("end"), F.col("start") + least).alias("end"))


def window_metrics(in_windows: DataFrame, region: list[str]) -> DataFrame:
    """Counts of a window's notes, their density against the last time, close pairs (.06) and share of long gaps (.5)."""
    gap = F.lead("t").over(Window.partitionBy(*region).orderBy("t", "seq")) - F.col("t")
    g = in_windows.withColumn("gap", gap)
    return g.groupBy(*region).agg(
        F.count("*").alias("notes"),
        round6(F.count("*") / F.greatest(F.lit(0.001), F.max(F.col("t") - F.col("lo")))).alias("density"),
        round6(F.count_if(F.col("gap") <= 0.06) / F.greatest(F.lit(1), F.count("*") - 1)).alias("polyphony"),
        round6(F.coalesce(F.count_if(F.col("gap") >= 0.5) / F.nullif(F.count_if(F.col("gap") > 0), F.lit(0)), F.lit(0.0))).alias("silence"),
    )


def reliability(metrics: DataFrame, status: Column, size: Column) -> DataFrame:
    """Adds score, tier and training weight of each window from its status, note count, density, silence and file size."""
    n, d = F.col("notes"), F.col("density")
    points = (
        F.lit(0.45)
        + F.when(n >= 12, 0.2).when(n >= 4, 0.1).otherwise(0.0)
        + F.when(d.between(0.4, 15.0), 0.15).otherwise(0.0)
        + F.when(F.col("silence") <= 0.75, 0.1).otherwise(0.0)
        + F.when(size >= 256, 0.1).otherwise(0.0)
    )
    scored = metrics.withColumn("score", F.when(status == "success", round6(F.least(F.lit(1.0), points))).otherwise(0.0))
    tier = F.when(status != "success", "failed").when(F.col("score") >= 0.8, "high").when(F.col("score") >= 0.55, "medium").otherwise("low")
    scored = scored.withColumn("tier", tier)
    return scored.withColumn("weight", F.when(F.col("tier") == "high", 1.0).when(F.col("tier") == "medium", 0.7).when(F.col("tier") == "low", 0.35).otherwise(0.0))


def stitched(in_context: DataFrame) -> DataFrame:
    """Events of context-padded windows on the performance's own time: local = t - ctx_lo; kept where lo <= ctx_lo + local <= hi."""
    local = F.col("t") - F.col("ctx_lo")
    at = F.col("ctx_lo") + local
    return in_context.withColumn("local", local).withColumn("at", at).where(F.col("at").between(F.col("lo"), F.col("hi")))


def stitch_report(in_context: DataFrame) -> DataFrame:
    """For each window: events with context, kept, and lost to the trim."""
    kept = F.col("t").between(F.col("lo"), F.col("hi"))
    return in_context.groupBy("perf", "idx").agg(F.count("*").alias("events"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("trimmed"))


def transposed(events: DataFrame, semitones: int) -> DataFrame:
    """Notes moved by semitones, kept between 0 and 127."""
    return events.withColumn("note", F.least(F.lit(127), F.greatest(F.lit(0), F.col("note") + semitones)))


def thinned(events: DataFrame, nth: Column, every: int) -> DataFrame:
    """Each ``every``-th event by its number from 0."""
    return events.where(nth % every == 0)


def delta_ticks(messages: DataFrame, ticks_per_beat: int = 480, tempo: int = 500_000) -> DataFrame:
    """Ticks since the message before, offs before ons at the same time: what a MIDI writer needs."""
    order = Window.partitionBy("perf", "channel").orderBy("t", F.col("delta"), "seq")
    before = F.coalesce(F.lag("t").over(order), F.lit(0.0))
    return messages.withColumn("ticks", F.bround((F.col("t") - before) * ticks_per_beat * 1e6 / tempo).cast("long"))
