"""Policies on files, samples and records: leak scans, redaction, asset classes, training routes and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Asset rules in their order: class, confidence, length ('short', 'long' or any), keywords in the path.
ASSET_RULES = [
    ("drum_one_shot", 0.7, "short", ["kick", "snare", "hat", "hihat", "clap", "rim", "tom"]),
    ("bass_one_shot", 0.62, "short", ["bass", "sub", "808"]),
    ("chord_stab", 0.62, "short", ["stab", "chord", "chrd"]),
    ("vocal_chop", 0.62, "short", ["vox", "vocal", "chop"]),
    ("synth_one_shot", 0.64, "short", ["synth", "lead", "pluck", "arp", "keys"]),
    ("drum_break", 0.68, "long", ["breakbeat", "drum break", "drumbreak", "amen break", "break"]),
    ("drum_loop", 0.66, "long", ["drum loop", "drumloop", "beat loop"]),
    ("percussion_loop", 0.64, "long", ["perc loop", "percussion loop", "shaker loop"]),
    ("riser", 0.6, "", ["riser", "sweep up", "sweep", "uplifter"]),
    ("fx", 0.58, "", ["impact", "boom", "hit fx", "whoosh", "fx"]),
    ("drone", 0.58, "", ["drone", "sustain"]),
    ("texture", 0.56, "", ["texture", "ambient", "ambience", "atmo", "atmos", "pad"]),
    ("field_recording", 0.56, "", ["field", "foley", "location", "recording"]),
    ("full_phrase", 0.55, "long", ["phrase", "melody", "riff", "vocal phrase"]),
]
SEEDS, LOOPS = ["synth_one_shot", "bass_one_shot", "chord_stab", "vocal_chop"], ["drum_break", "drum_loop", "percussion_loop"]


def asset_class(path: Column, seconds: Column) -> tuple[Column, Column]:
    """(class, confidence) of the first rule that a sample's path and length meet; two seconds divide short from long."""
    hint = F.lower(path)
    name, sure = F.lit("unknown"), F.lit(0.25)
    for kind, confidence, length, words in reversed(ASSET_RULES):
        met = F.lit(False)
        for w in words:
            met = met | F.contains(hint, F.lit(w))
        met = {"short": seconds <= 2.0, "long": seconds > 2.0, "": F.lit(True)}[length] & met
        name, sure = F.when(met, kind).otherwise(name), F.when(met, confidence).otherwise(sure)
    return name, sure


def seed_eligibility(kind: Column) -> Column:
    return F.when(kind.isin(SEEDS), "eligible").when(kind.isin(LOOPS), "ineligible").otherwise("review_required")


def training_route(records: DataFrame) -> DataFrame:
    """Adds status and reason: may a record train? From source_type, source_policy, authorization_status and review."""
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    restricted = F.contains(low("source_type"), F.lit("splice")) | F.contains(low("source_policy"), F.lit("splice"))
    unknown = low("authorization_status").isin("", "unknown", "undeclared") | low("source_policy").isin("unknown_blocked", "unknown")
    trusted = (low("source_policy") == "user_owned_training_candidate") | low("authorization_status").isin("trusted_for_training", "approved_for_training", "authorized_for_training")
    rungs = [(restricted, "block", "splice_source_production_only_training_excluded"), (unknown, "block", "unknown_authorization_blocks_training"), (F.col("requires_human_review"), "allow_review_only", "review_required_before_train_split"), (trusted, "allow_train", "authorized_for_training")]
    status, reason = F.lit("allow_review_only"), F.lit("not_authorized_for_training_but_review_allowed")
    for condition, s, r in reversed(rungs):
        status, reason = F.when(condition, s).otherwise(status), F.when(condition, r).otherwise(reason)
    return records.withColumns({"status": status, "reason": reason})


def feedback_trainable(records: DataFrame) -> DataFrame:
    """Adds trainable and semantics: what feedback may be learned from."""
    source, auth, kind = F.lower("source_type"), F.lower(F.coalesce("authorization_status", F.lit(""))), F.lower("feedback_type")
    rungs = [
        (source.isin("splice", "production_only", "copyrighted"), F.lit(False), "excluded"),
        (auth.isin("", "unknown", "undeclared", "copyrighted", "restricted"), F.lit(False), "excluded"),
        (source.isin("separated_stem", "demucs_stem"), F.lit(False), "weak_evidence"),
        (source.isin("transcription_witness", "yourmt3", "basic_pitch"), F.lit(False), "witness_not_truth"),
        (kind.isin("ranker_feedback", "preference_feedback"), F.lit(True), "feedback_allowed"),
        (source == "generated_midi", F.col("human_reviewed"), "human_review_required"),
    ]
    may, what = F.lit(False), F.lit("validated_corpus_required")
    for condition, m, w in reversed(rungs):
        may, what = F.when(condition, m).otherwise(may), F.when(condition, w).otherwise(what)
    return records.withColumns({"trainable": may, "semantics": what})


def marker_counts(files: DataFrame, markers: dict[str, str], text: str = "text") -> DataFrame:
    """One row for each file and marker (name -> pattern) with how often it occurs, where it does."""
    found = F.array(*[F.struct(F.lit(n).alias("marker"), F.regexp_count(F.col(text), F.lit(p)).alias("n")) for n, p in markers.items()])
    others = [c for c in files.columns if c != text]
    return files.select(*others, F.explode(F.filter(found, lambda x: x["n"] > 0)).alias("m")).select(*others, "m.*")


def leak_kind(changed: Column, enforced: Column) -> Column:
    return F.when(changed, "new_or_changed_public_leak").when(enforced, "enforced_public_leak").otherwise("pre_existing_historical_path_debt")
