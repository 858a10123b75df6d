"""Which rows stand for others: source selection, latest results, picks by preference or overlap, field policies, plans of batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The fields that an accepted observation may carry, and those that make a record a weak label or ask for a review.
ACCEPTED_FIELDS = [
    "record_id", "performance_id", "segment_run_id", "granularity", "start_seconds", "end_seconds", "duration_seconds", "audio_ref", "midi_ref",
    "merged_midi_ref", "window_id", "segment_id", "note_on_count", "note_on_density_per_second", "velocity_mean", "velocity_std",
    "pitch_class_histogram", "pitch_range", "pitch_class_summary", "interval_class_summary", "register_summary", "voicing_span",
    "note_density_polyphony", "voice_count_estimate", "polyphonic_density", "silence_ratio_proxy", "transcription_reliability_score",
    "recommended_training_weight", "provenance", "feature_refs",
]
WEAK_FIELDS = [
    "chord_candidates", "chord_label_candidate", "key_estimate", "rhythm_family_matches", "best_rhythm_family_match", "motif_group_refs",
    "rhythm_concepts", "philosophy_sources", "label", "tag", "sonority_type_candidate", "contour_summary", "voice_leading_summary",
    "counterpoint_summary", "tuning_summary", "pitch_harmony_refs", "cadence_modulation_candidates", "macro_key_hypotheses",
]
REVIEW_FIELDS = ["ambiguous_family_candidates", "ambiguity_score", "mismatch_reasons", "syncopation_proxy_score", "repetition_proxy_score", "external_conflict_warnings"]
#: Limits of a controlled batch.
MAX_SONGS, MAX_SAMPLES = 5, 100


def path_or(active: Column, legacy: Column) -> Column:
    """The active path, else the legacy one; blank paths are none."""
    return F.coalesce(F.nullif(F.trim(active), F.lit("")), F.nullif(F.trim(legacy), F.lit("")))


def successful_windows(windows: DataFrame, files: DataFrame) -> DataFrame:
    """windows(run, window_id, status, path, lo, hi) that succeeded and whose file exists; files(path)."""
    named = windows.where((F.coalesce("status", F.lit("pending")) == "success") & (F.trim("path") != ""))
    return named.withColumn("path", F.trim("path")).join(files.select("path").distinct(), "path", "left_semi")


def midi_sources(runs: DataFrame, windows: DataFrame, files: DataFrame) -> DataFrame:
    """runs(run, merged) -> one row per source: run, mode, path, window_id, limitation; a run without any source has one row, too.

    The merged file goes before the windows' files; both must exist.
    """
    there = files.select(F.col("path").alias("merged")).distinct().withColumn("_there", F.lit(True))
    known = runs.join(there, "merged", "left").select("run", F.when(F.col("_there"), F.col("merged")).alias("merged"))
    parts = successful_windows(windows, files).select("run", "path", "window_id")
    merged = known.where("merged is not null").select("run", F.lit("merged").alias("mode"), F.col("merged").alias("path"), F.lit(None).cast("long").alias("window_id"))
    rest = known.where("merged is null").select("run").join(parts, "run", "left")
    rest = rest.select("run", F.when(F.col("path").isNull(), "no_midi").otherwise("window_fallback").alias("mode"), "path", "window_id")
    why = F.when(F.col("mode") == "window_fallback", "merged file missing; window files stand for it").when(F.col("mode") == "no_midi", "no merged file and no successful window")
    return merged.unionByName(rest).withColumn("limitation", why)


def latest_pointed(candidates: DataFrame) -> DataFrame:
    """candidates(source, pointer, run_id): the latest pointer's run, else the legacy one, else the newest of the others."""
    rank = F.when(F.col("pointer") == "latest", 0).when(F.col("pointer") == "legacy", 1).otherwise(2)
    best = F.min_by(F.struct("pointer", "run_id"), F.struct(rank.alias("r"), (-F.col("run_id")).alias("newest")))
    return candidates.groupBy("source").agg(best.alias("b"), F.count("*").alias("candidates")).select("source", "b.pointer", "b.run_id", "candidates")


def range_valid(start: Column, end: Column) -> Column:
    """Both ends are numbers and the end isn't before the start; never null."""
    return F.coalesce(end.try_cast("double") >= start.try_cast("double"), F.lit(False))


def filled_count(items: Column) -> Column:
    """Rows whose array has an item, as an aggregate."""
    return F.count_if(items.isNotNull() & (F.size(items) > 0))


def whitelisted(records: DataFrame, key: list[str], allowed: list[str]) -> DataFrame:
    """key, kept: the fields that a record has and may carry, excluded: those that it has and may not, both sorted, joined by commas.

    Every column but the key is a field; a null is a field that the record hasn't.
    """
    fields = [c for c in records.columns if c not in key]
    has = F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in fields]), lambda x: x.isNotNull())
    permitted = F.array(*[F.lit(c) for c in allowed])
    text = lambda x: F.array_join(F.array_sort(x), ",")
    return records.select(*key, text(F.array_intersect(has, permitted)).alias("kept"), text(F.array_except(has, permitted)).alias("excluded"))


def field_trust(records: DataFrame, key: list[str]) -> DataFrame:
    """key, with how many accepted, weak and review fields each record has, and what that makes of it."""
    n = lambda names: sum((F.col(c).isNotNull().cast("int") for c in names if c in records.columns), F.lit(0))
    counted = records.select(*key, n(ACCEPTED_FIELDS).alias("accepted"), n(WEAK_FIELDS).alias("weak"), n(REVIEW_FIELDS).alias("review"))
    return counted.withColumn("trust", F.when(F.col("review") > 0, "review_required").when(F.col("weak") > 0, "weak_label").when(F.col("accepted") > 0, "accepted_observation").otherwise("empty"))


def last_wins(left: DataFrame, right: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``left`` with the last ``value`` of its key in ``right``; rows without a key share one, as if it were named None."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    last = right.groupBy(named(key).alias("_key")).agg(F.max_by(value, order).alias(value))
    return left.withColumn("_key", named(key)).join(last, "_key", "left").drop("_key")


def same_kind_first(left: DataFrame, right: DataFrame, keys: list[str], own: list[str], order: str, value: str) -> DataFrame:
    """``left`` (keys, own, kind) with ``value`` of the row of ``right`` (keys, kind, order, value): the first of its own kind, else the first."""
    first = right.groupBy(*keys, "kind").agg(F.min(order).alias("_seq"), F.min_by(value, order).alias("_value"))
    any_kind = first.groupBy(*keys).agg(F.min_by("_value", "_seq").alias("_any"))
    joined = left.join(first.select(*keys, "kind", "_value"), [*keys, "kind"], "left").join(any_kind, keys, "left")
    return joined.select(*own, F.coalesce("_value", "_any").alias(value))


def top_tags(met: DataFrame, record: list[str], k: int) -> DataFrame:
    """met(record, tag, sure): the record's k surest tags in order, joined by commas; a tag counts once."""
    once = met.groupBy(*record, "tag").agg(F.max("sure").alias("sure"))
    ranked = once.withColumn("nth", F.row_number().over(Window.partitionBy(*record).orderBy(F.desc("sure"), "tag"))).where(F.col("nth") <= k)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "tag"))), lambda x: x["tag"]), ",")
    return ranked.groupBy(*record).agg(F.count("*").alias("tags"), listed.alias("top_tags"))


def first_overlap_or_first(left: DataFrame, met: DataFrame, slices: DataFrame, own: list[str], value: str) -> DataFrame:
    """``left``(perf, own) with ``value`` of the first slice that it overlaps, else of the performance's first slice.

    met(perf, own, seq, value): overlaps; slices(perf, seq, value).
    """
    first = met.groupBy("perf", *own).agg(F.min_by(value, "seq").alias("_met"))
    start = slices.groupBy("perf").agg(F.min_by(value, "seq").alias("_first"))
    joined = left.join(first, ["perf", *own], "left").join(start, "perf", "left")
    return joined.select("perf", *own, F.coalesce("_met", "_first").alias(value), F.col("_met").isNotNull().alias("overlaps"))


def first_two_windows(groups: DataFrame, windows: DataFrame) -> DataFrame:
    """groups(group, ids) -> group, first, second: the first listed window that exists and the next one that does; fewer than two: no row."""
    listed = groups.select("group", F.posexplode("ids").alias("pos", "window"))
    there = listed.join(windows.select("window").distinct(), "window", "left_semi")
    nth = F.row_number().over(Window.partitionBy("group").orderBy("pos"))
    return there.withColumn("nth", nth).where("nth <= 2").groupBy("group").agg(F.max(F.when(F.col("nth") == 1, F.col("window"))).alias("first"), F.max(F.when(F.col("nth") == 2, F.col("window"))).alias("second")).where("second is not null")


def first_by_id(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key: the one that was made first."""
    whole = F.min_by(F.struct(*[c for c in rows.columns if c not in key]), order).alias("r")
    return rows.groupBy(*key).agg(whole).select(*key, "r.*")


def extremes(rows: DataFrame, key: list[str], value: str, k: int, *ties: str) -> DataFrame:
    """The k rows of each key with the largest values and the k with the smallest: end is most or least."""
    out = None
    for end, order in (("most", F.desc(value)), ("least", F.asc(value))):
        part = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(order, *ties))).where(F.col("rank") <= k).withColumn("end", F.lit(end))
        out = part if out is None else out.unionByName(part)
    return out


def batch_plan(songs: DataFrame, samples: DataFrame) -> DataFrame:
    """A row per batch: counts, errors (joined, sorted), the burden of its reviews and its status.

    songs(batch, path, authorized, source, training), samples(batch, items). Limits are MAX_SONGS and MAX_SAMPLES.
    """
    yes = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    path, source = F.lower(F.trim(F.coalesce("path", F.lit("")))), F.lower(F.trim(F.coalesce("source", F.lit(""))))
    counted = songs.groupBy("batch").agg(
        F.count("*").alias("songs"), yes("authorized").alias("authorized"), yes("training").alias("trainable"),
        F.count_if(path == "").alias("no_path"), F.count_if(path.endswith("/") | path.contains("*")).alias("dumps"),
        F.count_if(source.contains("splice") & F.coalesce("training", F.lit(False))).alias("splice"),
    )
    wanted = samples.groupBy("batch").agg(F.sum("items").alias("items"))
    b = counted.join(wanted, "batch", "left").withColumn("items", F.coalesce("items", F.lit(0)))
    error = lambda condition, name: F.when(condition, F.lit(name))
    errors = F.concat_ws(
        ",", error(F.col("dumps") > 0, "folder_or_wildcard"), error(F.col("no_path") > 0, "missing_path"), error(F.col("authorized") < F.col("songs"), "not_authorized"),
        error(F.col("splice") > 0, "splice_training"), error(F.col("items") > MAX_SAMPLES, "too_many_samples"), error(F.col("songs") > MAX_SONGS, "too_many_songs"),
    )
    burden = F.when((F.col("authorized") <= 2) & (F.col("items") <= 30), "low").when((F.col("authorized") <= 5) & (F.col("items") <= 100), "medium").otherwise("high")
    actions = F.col("authorized") + F.least(F.lit(MAX_SAMPLES), F.col("items"))
    return b.select("batch", "songs", "authorized", "trainable", "items", errors.alias("errors"), actions.alias("review_actions"), burden.alias("burden"), F.when(errors == "", "valid").otherwise("invalid").alias("status"))


def tuning_evidence(bends: DataFrame) -> DataFrame:
    """bends(perf, pitch; pitch null: another event) -> what tells of tuning other than twelve equal steps, and how surely."""
    n = F.count_if(F.coalesce("pitch", F.lit(0)) != 0)
    found = bends.groupBy("perf").agg(n.alias("bends"), F.count("*").alias("events"))
    kind = F.when(F.col("bends") > 0, "pitch_bend").when(F.col("events") > 0, "external_analyzer_required").otherwise("unavailable")
    sure = F.when(F.col("bends") > 0, F.least(F.lit(0.9), 0.35 + F.col("bends") / 100.0)).when(F.col("events") > 0, 0.15).otherwise(0.0)
    return found.select("perf", "bends", kind.alias("evidence"), F.round(sure, 6).alias("confidence"))


def fallback_regions(lengths: DataFrame) -> DataFrame:
    """lengths(perf, seconds) -> perf, idx, lo, hi: an eighth of the length each, 12 to 48 seconds, the last one clipped."""
    width = F.greatest(F.lit(12.0), F.least(F.lit(48.0), F.col("seconds") / 8.0))
    cut = lengths.where("seconds > 0").select("perf", "seconds", width.alias("width"))
    idx = F.explode(F.sequence(F.lit(0), F.ceil(F.col("seconds") / F.col("width")).cast("int") - 1))
    return cut.select("perf", "seconds", "width", idx.alias("idx")).select("perf", "idx", (F.col("idx") * F.col("width")).alias("lo"), F.least("seconds", (F.col("idx") + 1) * F.col("width")).alias("hi"))
