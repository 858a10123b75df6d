"""Training records: a region's rhythm beside its harmony, the sound and meter that it overlaps, its section and its surest tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.functions.scalars import round6
from ostinato.operators import intervals, keyed_tags, selections

#: Labels and statuses of records, and the sureness below which a tag asks for a review.
READY, REVIEW = "feature_ready", "needs_review"
AGGREGATED, STATUSES = ["performance", "segment", "window"], ("heuristic_estimate", "weak_label")
LEAST_SURE = 0.45


def most_overlap_or_first(regions: DataFrame, slices: DataFrame, width: float, value: str) -> DataFrame:
    """record_id and ``value`` of the slice that a region overlaps longest, else of the performance's first slice; ties to the smaller seq.

    regions(perf, record_id, lo, hi); slices(perf, seq, lo, hi, value). Ends alone are no overlap; a region without times takes the first.
    """
    right = slices.select("perf", F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi"), "seq", value)
    met = intervals.overlapping(regions.select("perf", "lo", "hi", "record_id"), right, width, closed=False)
    best = met.groupBy("record_id").agg(F.min_by(value, F.struct(-F.col("overlap"), F.col("seq"))).alias("_best"))
    first = slices.groupBy("perf").agg(F.min_by(value, "seq").alias("_first"))
    return regions.select("perf", "record_id").join(best, "record_id", "left").join(first, "perf", "left").select("record_id", F.coalesce("_best", "_first").alias(value))


def _window(perf: Column) -> Column:
    return F.concat_ws("|", perf, F.coalesce("window_id", F.lit("None")))


def built(regions: DataFrame, harmonies: DataFrame, slices: DataFrame, meters: DataFrame, sections: DataFrame, tags: DataFrame, width: float) -> DataFrame:
    """A record for each row of ``regions``, none lost or doubled as long as record_id is unique.

    regions(perf, record_id, window_id, granularity, lo, hi, notes, density, confidence); harmonies(perf, window_id, granularity, seq, key, mode,
    score); slices(perf, seq, lo, hi, sonority); meters(perf, seq, lo, hi, subdivision, grid_confidence, pulse_stability, candidates, ambiguity);
    sections(perf, seq, lo, hi, section); tags(seq, perf, window_id, granularity, lo, hi, tag, sure). The harmony is that of the same window and
    granularity, else the window's first; regions and harmonies without a window share one of their performance. The sound is that of the first
    slice that touches the region, meter and section those of the longest overlap, each else the performance's first. A record is as sure as
    the less sure of its rhythm and its harmony, without one not at all. Whatever is missing stays null; a null sureness is 0.
    """
    r = regions.withColumns({"_window": _window(F.col("perf")), "kind": F.coalesce("granularity", F.lit("window"))})
    h = harmonies.select(_window(F.col("perf")).alias("_window"), F.coalesce("granularity", F.lit("window")).alias("kind"), "seq", F.struct("key", "mode", "score").alias("harmony"))
    harmony = selections.same_kind_first(r.select("_window", "kind", "record_id"), h, ["_window"], ["record_id"], "seq", "harmony")
    touched = intervals.overlapping(r.select("perf", "lo", "hi", "record_id"), slices.select("perf", F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi"), "seq", "sonority"), width)
    sound = selections.first_overlap_or_first(r.select("perf", "record_id"), touched, slices, ["record_id"], "sonority").select("record_id", "sonority")
    meter = most_overlap_or_first(r, meters.select("perf", "seq", "lo", "hi", F.struct("subdivision", "grid_confidence", "pulse_stability", "candidates", "ambiguity").alias("meter")), width, "meter")
    section = most_overlap_or_first(r, sections, width, "section")
    keyed = lambda d: d.withColumn("window_id", _window(F.col("perf")))
    top = keyed_tags.top_tags(keyed(r).select(F.col("record_id").alias("record"), "window_id", F.col("kind").alias("granularity"), "lo", "hi"), keyed(tags).drop("perf"), width)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "tag"))), lambda x: x["tag"]), ",")
    top = top.groupBy(F.col("record").alias("record_id")).agg(listed.alias("top_tags"), F.min("sure").alias("least_sure"))
    joined = r
    for part in (harmony, sound, meter, section, top):
        joined = joined.join(part, "record_id", "left")
    sure = F.least(F.coalesce("confidence", F.lit(0.0)), F.coalesce("harmony.score", F.lit(0.0)))
    status = F.when(F.col("kind").isin(*AGGREGATED), STATUSES[0]).otherwise(STATUSES[1])
    return joined.select(
        "record_id", "perf", "window_id", F.col("kind").alias("granularity"), "lo", "hi", (F.col("hi") - F.col("lo")).alias("duration"), "notes", round6(F.col("density")).alias("density"),
        "harmony.key", "harmony.mode", F.col("harmony.score").alias("harmony_score"), "sonority", "meter.subdivision", "meter.grid_confidence", "meter.pulse_stability",
        F.col("meter.candidates").alias("meters"), F.col("meter.ambiguity").alias("meter_ambiguity"), "section", F.coalesce("top_tags", F.lit("")).alias("top_tags"),
        F.when(F.col("least_sure") < LEAST_SURE, REVIEW).otherwise(READY).alias("label"), status.alias("label_status"), round6(sure).alias("confidence"),
    )
