"""Which records may leave: quarantine with its reasons, gates of performances, reliability of windows or inherited, split and weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Label statuses, tiers, splits and the texts of reasons as they are in exported records.
WEAK_LABELS = ["weak_label", "heuristic_estimate", "interpretive_weak_label", "model_prediction"]
OBSERVATIONS = ["raw_observation", "derived_observation"]
TRUSTED, UNSURE = ["high", "medium"], ["low", "missing", "failed"]
INHERITING = ["performance", "segment"]
INHERITED = ("high", 0.95, 1.0)
QUARANTINED, REVIEW, ACCEPTED, WEAK, PLAIN = "quarantined_records", "review_required_records", "accepted_records", "weak_label_records", "audio_midi_only_records"
REASONS = {
    "gate": "quality gates quarantined this performance",
    "verified": "human verified label",
    "weak_unsure": "weak/heuristic label with insufficient confidence or reliability",
    "weak": "weak label separated from accepted observations",
    "observed": "high/medium reliability observation record",
    "plain": "reliable timing/transcription context without safe labels",
    "rest": "ambiguous or low-confidence record",
}


def _blank(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit(""))) == ""


def quarantine_reasons() -> Column:
    """All that is missing in a record, in a fixed order; none for a whole one. Null stands for a field that isn't there."""
    faults = [
        (_blank("record_id"), "missing record_id"),
        (_blank("performance_id"), "missing performance_id"),
        (~F.coalesce(F.col("end_seconds") >= F.col("start_seconds"), F.lit(False)), "invalid time range"),
        (F.col("source_artifact_paths").isNull(), "missing source_artifact_paths"),
        (F.col("feature_version").isNull(), "missing feature_version"),
    ]
    return F.filter(F.array(*[F.when(fault, reason) for fault, reason in faults]), lambda r: r.isNotNull())


def classified(records: DataFrame, reliability: DataFrame, gates: DataFrame) -> DataFrame:
    """Adds tier, score, weight, split and reasons to each record.

    records(record_id, performance_id, start_seconds, end_seconds, source_artifact_paths, feature_version, window_id, granularity,
    label_status, confidence); reliability(window_id, tier, score, weight), a row a window; gates(performance_id, gate_status), a row
    a performance, records without one need review. Records without a known window are of low tier, but performances and segments
    inherit a high one. Quarantined records have no tier, score or weight. The two lookups are joins by key, of sizes that Spark judges;
    a null key meets nothing, and records are neither lost nor doubled as long as lookups have one row a key.
    """
    known = records.join(reliability.select("window_id", F.col("tier").alias("_tier"), F.col("score").alias("_score"), F.col("weight").alias("_weight")), "window_id", "left")
    known = known.join(gates.select("performance_id", F.col("gate_status").alias("_gate")), "performance_id", "left")
    inherits = F.col("_tier").isNull() & F.coalesce(F.col("granularity").isin(*INHERITING), F.lit(False))
    of = lambda name, own, without: F.when(inherits, F.lit(own)).otherwise(F.coalesce(f"_{name}", F.lit(without)))
    known = known.select("*", *[of(n, own, low).alias(n) for n, own, low in zip(("tier", "score", "weight"), INHERITED, ("low", 0.0, 0.0))], quarantine_reasons().alias("_faults"))
    label, sure = F.coalesce("label_status", F.lit("weak_label")), F.coalesce("confidence", F.lit(0.0))
    weight, trusted = F.col("weight"), F.col("tier").isin(*TRUSTED) & (sure >= 0.4)
    rungs = [
        (F.coalesce("_gate", F.lit("review_required")) == "quarantined", REVIEW, "gate", weight),
        (label == "human_verified_label", ACCEPTED, "verified", F.greatest(weight, F.lit(0.9))),
        (label.isin(*WEAK_LABELS) & ((sure < 0.35) | F.col("tier").isin(*UNSURE)), REVIEW, "weak_unsure", weight),
        (label.isin(*WEAK_LABELS), WEAK, "weak", F.least(weight, F.lit(0.7))),
        (label.isin(*OBSERVATIONS) & trusted, ACCEPTED, "observed", F.greatest(weight, F.lit(0.7))),
        (trusted, PLAIN, "plain", F.greatest(weight, F.lit(0.6))),
    ]
    whole = F.size("_faults") == 0
    answer = lambda split, reason, given: F.struct(F.lit(split).alias("split"), F.array(F.lit(REASONS[reason])).alias("reasons"), given.alias("given"))
    told = answer(REVIEW, "rest", weight)
    for condition, split, reason, given in reversed(rungs):
        told = F.when(condition, answer(split, reason, given)).otherwise(told)
    told = F.when(whole, told).otherwise(F.struct(F.lit(QUARANTINED).alias("split"), F.col("_faults").alias("reasons"), F.lit(None).cast("double").alias("given")))
    kept = [F.when(whole, F.col(c)).alias(c) for c in ("tier", "score")]
    return known.withColumn("_told", told).select(*records.columns, *kept, F.col("_told.given").alias("weight"), "_told.split", "_told.reasons")
