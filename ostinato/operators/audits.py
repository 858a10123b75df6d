"""What kind of asset a recording is, what of its records can be trained on, and whether a corpus may be ingested at large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.functions.scalars import round6

#: Asset types with their confidences and reasons, in the order in which ties are settled. The conditions are below.
ASSETS = [
    ("unknown", 0.2, "default fallback"),
    ("full_song", 0.72, "long-form duration"),
    ("performance_recording", 0.8, "multi-segment long performance"),
    ("rap_song", 0.64, "strong vocal/flow tags"),
    ("speech_heavy", 0.68, "speech-like tag evidence"),
    ("ambient_texture", 0.7, "ambient tags with low note density"),
    ("drum_loop", 0.66, "percussive tags with weak harmony"),
    ("one_shot_drum", 0.66, "percussive tags with weak harmony"),
    ("chord_loop", 0.67, "harmonic confidence"),
    ("full_song", 0.67, "harmonic confidence"),
    ("one_shot_drum", 0.74, "very short percussive asset"),
    ("vocal_sample", 0.7, "very short vocal asset"),
    ("one_shot_synth", 0.62, "very short non-percussive asset"),
    ("melodic_loop", 0.6, "loop-like structure with melodic note density"),
]
UNSTITCHED, UNSEGMENTED, UNTRANSCRIBED = ["one_shot_drum", "one_shot_synth", "vocal_sample", "speech_heavy"], ["one_shot_drum", "one_shot_synth"], ["ambient_texture", "speech_heavy"]
NO_RECORDS = "No AI training records found; classification confidence reduced."
NO_WINDOWS = "No window-level records found; asset type may be coarse."


def _conditions() -> list[Column]:
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    seconds, dense, poly, chords = number("seconds"), number("density"), number("poly"), number("chord")
    vocal, speech, ambient, drums, loop = number("vocal"), number("speech"), number("ambient"), number("percussive"), F.coalesce("loop", F.lit(False))
    beats, chordal, short = (drums >= 0.55) & (chords < 0.35), (chords >= 0.65) & (poly >= 0.15), seconds <= 5
    return [
        F.lit(True),
        seconds >= 120,
        (seconds >= 180) & (number("segments") >= 3),
        (vocal >= 0.6) & (speech < 0.35),
        speech >= 0.55,
        (ambient >= 0.55) & (dense < 1),
        beats & loop,
        beats & ~loop,
        chordal & loop & (seconds < 90),
        chordal & ~(loop & (seconds < 90)),
        short & (drums >= 0.45),
        short & (drums < 0.45) & (vocal >= 0.45),
        short & (drums < 0.45) & (vocal < 0.45),
        (seconds < 60) & loop & (chords < 0.5) & (dense >= 1),
    ]


def asset_types(assets: DataFrame) -> DataFrame:
    """Adds asset_type, confidence, reason, up to three alternates, limitations, what to do with the asset and how many windows to take.

    assets(seconds, segments, windows, records, density, poly, chord, vocal, speech, ambient, percussive, loop); a null number is 0, a
    null flag false. The surest type wins, ties go to the earlier in ASSETS. Other columns stay; rows are judged each on its own.
    """
    each = [F.when(c, F.struct(F.lit(-sure).alias("s"), F.lit(nth).alias("nth"), F.lit(name).alias("asset_type"), F.lit(reason).alias("reason"))) for nth, (c, (name, sure, reason)) in enumerate(zip(_conditions(), ASSETS))]
    ranked = assets.withColumn("_ranked", F.array_sort(F.filter(F.array(*each), lambda x: x.isNotNull())))
    best = F.col("_ranked")[0]
    name, seconds = best["asset_type"], F.coalesce("seconds", F.lit(0.0))
    lacks = lambda c, text: F.when(F.coalesce(F.col(c), F.lit(0)) <= 0, text)
    return ranked.withColumns({
        "asset_type": name,
        "asset_confidence": -best["s"],
        "reason": best["reason"],
        "alternates": F.transform(F.slice("_ranked", 2, 3), lambda x: x["asset_type"]),
        "limitations": F.filter(F.array(lacks("records", NO_RECORDS), lacks("windows", NO_WINDOWS)), lambda x: x.isNotNull()),
        "should_stitch": ~name.isin(*UNSTITCHED),
        "should_segment": ~name.isin(*UNSEGMENTED),
        "should_transcribe": ~name.isin(*UNTRANSCRIBED),
        "most_windows": F.when(seconds <= 5, 1).when(seconds <= 60, 2).otherwise(4),
    }).drop("_ranked")


#: At which counts routing is well calibrated or no longer, and from which confidence on meters are observations.
HEALTHY_HARMONIC, BAD_FALSE, BAD_HARMONIC = 3, 20, 50
METER_SURE, METER_CLEAR = 0.65, 0.45


def calibration(false: Column, harmonic: Column) -> Column:
    """Whether routing holds back too much: by its likely false suppressions and by regions with harmonic evidence that it doesn't call harmonic."""
    return F.when((false == 0) & (harmonic <= HEALTHY_HARMONIC), "healthy").when((false >= BAD_FALSE) | (harmonic >= BAD_HARMONIC), "needs_recalibration").otherwise("monitor")


def training_audit(records: DataFrame, meters: DataFrame, gates: DataFrame) -> DataFrame:
    """A row a performance: what its records allow, what routing keeps back, upgrades by label family, use of its meters, and its verdict.

    records(performance, label_status, verified, suppressed, recommendation, family, false_suppression, harmonic_suppressed), a row a
    record: ``suppressed`` counts labels, recommendation is null where none is due, null flags are false, a null status is unknown.
    meters(performance, confidence, ambiguity) and gates(performance, quality_status, split), at most a row a performance; one without
    meters is unsure, one without gates needs review. Performances without records have no row. Counts are summed by (performance,
    status, family) first, so nothing larger than that product is ever gathered.
    """
    status, family = F.coalesce("label_status", F.lit("unknown")), F.coalesce("family", F.lit("unknown"))
    told = lambda *names: F.count_if(F.col("recommendation").isin(*names))
    cells = records.groupBy("performance", status.alias("status"), family.alias("family")).agg(
        F.count("*").alias("n"),
        F.count_if("verified").alias("verified"),
        F.sum(F.coalesce("suppressed", F.lit(0))).alias("suppressed"),
        told("upgrade_candidate").alias("up"),
        told("downgrade_candidate", "suppress_candidate").alias("down"),
        told("needs_human_review").alias("review"),
        F.count_if("false_suppression").alias("false"),
        F.count_if("harmonic_suppressed").alias("harmonic"),
    )
    totals = cells.groupBy("performance").agg(F.sum("n").alias("records"), *[F.sum(c).alias(c) for c in ("verified", "suppressed", "up", "down", "review", "false", "harmonic")])

    def listed(by: str, counts: list[str]) -> DataFrame:
        """name=n, ... of each performance in order of names, as many entries as there are names."""
        few = cells.groupBy("performance", by).agg(*[F.sum(c).alias(c) for c in counts])
        text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c) > 0, F.struct(F.col(by).alias("k"), F.col(c).alias("v"))))), lambda x: F.concat_ws("=", x["k"], x["v"])), ",")
        return few.groupBy("performance").agg(*[text(c).alias(f"{c}_by_{by}") for c in counts])

    joined = totals.join(listed("status", ["n"]), "performance").join(listed("family", ["up", "down"]), "performance")
    joined = joined.join(meters.select("performance", F.col("confidence").alias("_sure"), F.col("ambiguity").alias("_unclear")), "performance", "left").join(gates.select("performance", "quality_status", "split"), "performance", "left")
    sure, unclear = F.coalesce("_sure", F.lit(0.0)), F.coalesce("_unclear", F.lit(1.0))
    return joined.select(
        "performance", "records", F.col("n_by_status").alias("label_statuses"), F.when(F.col("verified") == 0, "human verification labels").alias("missing"),
        F.col("suppressed").alias("suppressed_labels"), F.col("false").alias("false_suppressions"), F.col("harmonic").alias("harmonic_suppressed"), calibration(F.col("false"), F.col("harmonic")).alias("calibration"),
        F.col("up").alias("upgrades"), F.col("up_by_family").alias("upgrades_by_family"), F.col("down").alias("downgrades"), F.col("down_by_family").alias("downgrades_by_family"), F.col("review").alias("to_review"),
        round6(sure).alias("meter_confidence"), round6(unclear).alias("meter_ambiguity"), F.when((sure >= METER_SURE) & (unclear <= METER_CLEAR), "safe_for_observation_fields").otherwise("weak_or_review_only").alias("meter_use"),
        F.coalesce("quality_status", F.lit("review_required")).alias("inclusion"), F.coalesce("split", F.lit("review")).alias("recommended_split"),
    )


#: What stands in the way of ingestion at large, by the sign that is missing, in the order in which they are told.
BLOCKERS = [
    ("no_new_leaks", "privacy leak scan reports new public leaks"),
    ("authorized", "source authorization validation failed"),
    ("scrub_planned", "historical path scrub plan is missing"),
    ("queued", "manual review queue artifacts are missing"),
    ("scored", "quality scorecards are missing"),
    ("corpus_ready", "symbolic corpus export is not training-ready"),
    ("feedback", "human feedback loop artifacts are missing"),
]
DEBT = "historical privacy debt remains above zero"
MOST_REVIEWS, HOURS_A_REVIEW, TOLD_BLOCKERS = 100, 0.08, 6


def ingestion_readiness(signs: DataFrame, key: str) -> DataFrame:
    """A row a key: ready for a controlled batch, for training, for ingestion at large; blockers, and what its reviews come to.

    signs(key, new_leaks, debt, unauthorized, planned, queued, scored, examples, feedback, evaluated, reviews): counts; null is 0, but a null
    debt is one, as it hasn't been looked at. Each step needs the one before: no leaks; then authorized sources, a queue, scores,
    an export with examples, feedback and an evaluation; then a plan for old leaks and none of them left.
    """
    n = lambda c, without=0: F.coalesce(F.col(c), F.lit(without))
    holds = {"no_new_leaks": n("new_leaks") == 0, "authorized": n("unauthorized") == 0, "scrub_planned": n("planned") > 0, "queued": n("queued") > 0, "scored": n("scored") > 0, "corpus_ready": n("examples") > 0, "feedback": n("feedback") > 0}
    batch = holds["no_new_leaks"]
    training = batch & holds["authorized"] & holds["queued"] & holds["scored"] & holds["corpus_ready"] & holds["feedback"] & (n("evaluated") > 0)
    at_large = training & holds["scrub_planned"] & (n("debt", 1) == 0)
    told = F.filter(F.array(*[F.when(~holds[sign], text) for sign, text in BLOCKERS], F.when(~at_large, DEBT)), lambda x: x.isNotNull())
    return signs.select(
        key, batch.alias("ready_for_batch"), training.alias("ready_for_training"), at_large.alias("ready_at_large"), F.size(told).alias("blockers"),
        F.when(F.size(told) == 0, "none").otherwise(F.array_join(F.slice(told, 1, TOLD_BLOCKERS), "; ")).alias("top_blockers"),
        n("reviews").alias("reviews"), F.round(n("reviews") * HOURS_A_REVIEW, 2).alias("review_hours"), F.when(n("reviews") > MOST_REVIEWS, "blocked").otherwise("partial").alias("review_burden"),
    )
