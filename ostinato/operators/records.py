"""Training records: confidence, content states, tags, trust, export splits and label upgrades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ostinato.functions.scalars import clamp01, round6

#: Label statuses that aren't observations.
WEAK_STATUSES = ["weak_label", "heuristic_label", "review_required"]


def rhythm_confidence(n: Column, pulse: Column, base: float = 0.9) -> Column:
    """More notes make a region surer; few notes or no pulse cap it."""
    c = F.least(F.lit(base), 0.35 + F.least(F.lit(0.6), n / 120.0))
    c = F.when(n < 8, F.least(c, F.lit(0.45))).otherwise(c)
    return round6(F.when(pulse <= 0, F.least(c, F.lit(0.35))).otherwise(c))


def given(df: DataFrame, name: str, default: float = 0.0) -> Column:
    """A column that may be left out, as a double; missing columns and nulls are the default."""
    return F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in df.columns else F.lit(default)


def content_scores(evidence: DataFrame) -> DataFrame:
    """Adds rhythm, harmony, melody, low_info and mix scores from notes, density, poly, silence, chord, classes, activity, motif.

    ``rhythm_tag`` (0 to 1), ``features_missing`` (0 or 1) and ``seconds`` may be given too.
    """
    n, d = clamp01(F.col("notes") / 32.0), clamp01(F.col("density") / 3.0)
    poly, pc = clamp01(F.col("poly")), clamp01(F.col("classes") / 7.0)
    quiet, motif = clamp01(F.col("silence")), F.col("motif").cast("double")
    moderate = clamp01(1 - F.abs(F.col("density") - 1.4) / 1.4)
    seconds = given(evidence, "seconds")
    brief = ((seconds > 0) & (seconds <= 1)).cast("double")
    scored = evidence.withColumns({
        "rhythm": clamp01(0.34 * d + 0.22 * n + 0.18 * motif + 0.16 * given(evidence, "rhythm_tag") + 0.1 * clamp01(1 - F.col("silence"))),
        "harmony": clamp01(0.26 * pc + 0.29 * clamp01(F.col("chord")) + 0.2 * clamp01(F.col("activity") / 3.0) + 0.15 * poly + 0.1 * (F.col("chord") > 0).cast("double")),
        "melody": clamp01(0.3 * pc + 0.25 * moderate + 0.25 * clamp01(1 - poly) + 0.2 * clamp01(F.col("movement"))),
        "low_info": clamp01(0.33 * quiet + 0.24 * clamp01(1 - n) + 0.18 * given(evidence, "features_missing") + 0.15 * clamp01(1 - F.col("confidence")) + 0.1 * brief),
    })
    return scored.withColumn("mix", clamp01(0.34 * F.col("rhythm") + 0.34 * F.col("harmony") + 0.2 * poly + 0.12 * n))


def content_states(scored: DataFrame) -> DataFrame:
    """Adds content_state, state_confidence and margin: the first rung of the ladder that holds.

    ``speech``, ``rap``, ``vocal`` and ``transition`` scores may be given; without them their rungs don't hold.
    """
    r, h, m, low, mix = (F.col(c) for c in ("rhythm", "harmony", "melody", "low_info", "mix"))
    speech, rap, vocal, transition = (given(scored, c) for c in ("speech", "rap", "vocal", "transition"))
    bare = (F.col("classes") <= 3) & (F.col("chord") < 0.45) & (F.col("poly") < 0.18)
    rungs = [
        ((low >= 0.83) & (F.col("notes") <= 1) & (h < 0.3) & (r < 0.42), "silence_or_noise", F.lit(0.86)),
        ((speech >= 0.72) & (h < 0.35), "speech_like", F.lit(0.8)),
        ((rap >= 0.58) & (r >= 0.45), "rap_vocal_dominant", F.lit(0.78)),
        ((vocal >= 0.62) & (r >= 0.35), "vocal_dominant", F.lit(0.74)),
        (mix >= 0.68, "polyphonic_full_mix", F.least(F.lit(0.9), 0.65 + (mix - 0.68))),
        ((h >= 0.62) & (h - r >= 0.08), "harmonic_dominant", F.least(F.lit(0.88), 0.62 + (h - 0.62))),
        ((r >= 0.62) & (h < 0.52) & bare, "percussive_only", F.least(F.lit(0.86), 0.66 + (r - 0.62))),
        ((r >= 0.62) & (h < 0.52), "rhythm_dominant", F.least(F.lit(0.84), 0.62 + (r - 0.62))),
        ((m >= 0.58) & (h >= 0.42), "melodic_lead", F.least(F.lit(0.8), 0.58 + (m - 0.58))),
        ((low >= 0.5) & (F.col("notes") <= 10) & (F.col("silence") >= 0.4) & (h < 0.65), "ambient_low_information", F.least(F.lit(0.82), 0.58 + (low - 0.5))),
        (transition >= 0.64, "transition_build", F.lit(0.7)),
    ]
    state, sure = F.lit("unknown"), F.lit(0.45)
    for condition, name, value in reversed(rungs):
        state, sure = F.when(condition, name).otherwise(state), F.when(condition, value).otherwise(sure)
    ranked = F.sort_array(F.array(low, mix, h, r, m, low * 0.92, r * (1 - F.least(F.lit(1.0), h + 0.1)), speech, vocal, rap, transition, F.lit(0.3)), asc=False)
    return scored.withColumns({"content_state": state, "state_confidence": round6(clamp01(sure)), "margin": round6(clamp01(ranked[0] - ranked[1]))})


#: Families of analyses, and for each content state those it allows, those it rules out, and rules for labels.
FAMILIES = "chord_movement,harmony,melody,rhythm,semantic,stitching,swing_groove,tempo_grid,texture,timbre,training_export,transcription,transient,vocal_flow"
ROUTES = [
    ("percussive_only", "rhythm,semantic,swing_groove,tempo_grid,training_export,transient", "chord_movement,harmony,melody", "suppress_hard_chord_labels,allow_rhythm_motif_labels"),
    ("rhythm_dominant", "rhythm,semantic,swing_groove,tempo_grid,training_export,transient", "harmony", "downgrade_chord_labels_without_harmonic_evidence,prefer_rhythm_labels"),
    ("harmonic_dominant", "chord_movement,harmony,melody,rhythm,semantic,training_export", "transient", "allow_chord_labels_if_confident,allow_rhythm_if_onset_evidence_present"),
    ("melodic_lead", "harmony,melody,rhythm,semantic,training_export", "transient", "prefer_melodic_phrase_labels,downgrade_transient_only_labels"),
    ("vocal_dominant", "rhythm,semantic,timbre,training_export,vocal_flow", "chord_movement", "mark_harmony_labels_weak_without_accompaniment_evidence"),
    ("rap_vocal_dominant", "rhythm,semantic,tempo_grid,training_export,vocal_flow", "chord_movement,melody", "prefer_flow_and_phrase_labels,downgrade_chord_labels_without_support"),
    ("polyphonic_full_mix", ",".join(f for f in FAMILIES.split(",") if f not in ("stitching", "transcription")), "", "require_confidence_and_evidence_for_semantic_labels"),
    ("ambient_low_information", "semantic,texture,timbre,training_export", "chord_movement,harmony,swing_groove,tempo_grid", "suppress_strong_music_theory_labels,allow_texture_observations"),
    ("speech_like", "semantic,timbre,training_export,vocal_flow", "chord_movement,harmony,melody", "suppress_music_theory_labels,mark_review_required"),
    ("transition_build", "rhythm,semantic,texture,training_export,transient", "chord_movement", "prefer_transition_descriptors,downgrade_key_labels_if_unstable"),
    ("silence_or_noise", "semantic,texture,training_export", ",".join(f for f in FAMILIES.split(",") if f not in ("semantic", "texture", "training_export")), "suppress_hard_rhythm_and_harmony_labels,mark_low_information"),
    ("unknown", "semantic,training_export", "chord_movement", "mark_review_required_when_label_is_semantic"),
]


def routed(states: DataFrame) -> DataFrame:
    """Each state's policy: allowed and suppressed families and rules; a state without one has that of unknown. A fixed short table."""
    policy = states.sparkSession.createDataFrame(ROUTES, "_state string, allowed string, suppressed string, rules string")
    known = F.when(F.col("content_state").isin([r[0] for r in ROUTES]), F.col("content_state")).otherwise("unknown")
    return states.join(F.broadcast(policy), known == F.col("_state")).drop("_state")


def tagged(vectors: DataFrame) -> DataFrame:
    """One row for each tag that a region's thresholds give it, with the tag's confidence."""
    tag = lambda condition, name, sure: F.when(condition, F.struct(F.lit(name).alias("tag"), F.round(sure, 6).cast("double").alias("tag_confidence")))
    d = F.col("density")
    tags = F.array(
        tag(d >= 6, "dense_region", F.least(F.lit(0.9), d / 10)),
        tag(d <= 1, "sparse_region", F.lit(0.6)),
        tag(F.col("syncopation") >= 0.3, "irregular_groove", F.col("syncopation") * 2),
        tag(F.col("syncopation") <= 0.16, "steady_pulse", 1 - F.col("syncopation")),
        tag(F.col("polyphonic_density") >= 0.3, "polyphonic_texture", F.col("polyphonic_density")),
        tag(F.col("repetition") >= 0.5, "repetitive_pattern", F.col("repetition")),
        tag(F.col("accent_ratio") >= 0.2, "accented", F.col("accent_ratio")),
    )
    keys = ["perf", "kind", "idx"]
    return vectors.select(*keys, F.explode(F.filter(tags, lambda x: x.isNotNull())).alias("x")).select(*keys, "x.*")


def tag_groups(tags: DataFrame, region: list[str] | None = None) -> DataFrame:
    """Each tag of a performance: how often, its best and mean confidence, and the last region that has the best."""
    best = F.max_by("idx", F.struct("tag_confidence", "idx"))
    grouped = tags.groupBy("perf", "tag").agg(F.count("*").alias("n"), F.max("tag_confidence").alias("best"), round6(F.avg("tag_confidence")).alias("mean"), best.alias("example_idx"))
    rank = F.row_number().over(Window.partitionBy("perf").orderBy(F.desc("best"), F.desc("n"), "tag"))
    return grouped.withColumn("rank", rank)


def export_splits(records: DataFrame) -> DataFrame:
    """Adds export_split and training_weight from label_status, confidence, tier, weight and whether the record is whole."""
    trusted, weak = F.col("tier").isin("high", "medium"), F.col("label_status").isin(*WEAK_STATUSES)
    c, w = F.col("confidence"), F.col("weight")
    rungs = [
        (~F.col("whole"), "quarantined_records", w),
        (F.col("label_status") == "human_verified_label", "accepted_records", F.greatest(w, F.lit(0.9))),
        (weak & ((c < 0.35) | ~trusted), "review_required_records", w),
        (weak, "weak_label_records", F.least(w, F.lit(0.7))),
        (F.col("label_status").isin("raw_observation", "derived_observation") & trusted & (c >= 0.4), "accepted_records", F.greatest(w, F.lit(0.7))),
        (trusted & (c >= 0.4), "audio_midi_only_records", F.greatest(w, F.lit(0.6))),
    ]
    split, weight = F.lit("review_required_records"), w
    for condition, name, value in reversed(rungs):
        split, weight = F.when(condition, name).otherwise(split), F.when(condition, value).otherwise(weight)
    return records.withColumns({"export_split": split, "training_weight": weight})


def label_upgrades(records: DataFrame) -> DataFrame:
    """Adds recommendation from content_state, family, supported, tier, score, confidence, ambiguity and whether evidence is given."""
    family, state, amb = F.col("family"), F.col("content_state"), F.col("ambiguity")
    reliable = F.col("tier").isin("high", "medium") | (F.col("score") >= 0.65)
    decision = (
        F.when(state.isin("percussive_only", "ambient_low_information", "speech_like", "silence_or_noise") & (family == "harmony"), "suppress_candidate")
        .when(F.col("supported") & reliable & (F.col("confidence") >= 0.58) & (amb <= 0.35) & F.col("has_evidence") & family.isin("rhythm", "harmony", "semantic"), "upgrade_candidate")
        .when((family == "rhythm") & (amb >= 0.45), "keep_weak")
        .when(amb >= 0.55, "needs_human_review")
        .when(~F.col("supported"), "downgrade_candidate")
        .when(~F.col("has_evidence"), "downgrade_candidate")
        .when((F.col("confidence") < 0.4) | (F.col("score") < 0.45), "downgrade_candidate")
        .otherwise("keep_weak")
    )
    return records.withColumn("recommendation", decision)


#: Label statuses whose labels are exported apart from observations.
LABEL_STATUSES = ["weak_label", "heuristic_estimate", "interpretive_weak_label", "model_prediction"]


def fanned_out(split: DataFrame, record_id: str) -> DataFrame:
    """One row for each record that an input of ``export_splits`` gives: quarantine alone, or observation, weak label and review.

    Adds export_record_id, part, and the part's own export_split and training_weight. A record that nothing applies to gives none.
    """
    w, own = F.col("training_weight"), F.col("export_split")
    part = lambda holds, name, target, weight: F.when(holds, F.struct(F.lit(name).alias("part"), F.lit(target).alias("target"), weight.alias("w")))
    out = own == "quarantined_records"
    sure = F.col("tier").isin("high", "medium") & (w >= 0.6)
    parts = F.array(
        part(out, "quarantine", "quarantined_records", w),
        part(~out & sure, "observation", "accepted_records", w),
        part(~out & ~sure & (own == "audio_midi_only_records"), "observation", "audio_midi_only_records", w),
        part(~out & F.col("label_status").isin(LABEL_STATUSES), "weak_label", "weak_label_records", F.least(w, F.lit(0.7))),
        part(own == "review_required_records", "review", "review_required_records", F.least(w, F.lit(0.4))),
    )
    rest = [c for c in split.columns if c not in ("export_split", "training_weight")]
    # Filtered after the explode: before it, the optimizer would repeat all that the parts are made of in a filter of its own.
    each = split.select(*rest, F.explode(parts).alias("x")).where("x is not null")
    name = F.concat_ws(":", F.col(record_id).cast("string"), "x.part", F.lit("0"))
    return each.select(*rest, name.alias("export_record_id"), F.col("x.part").alias("part"), F.col("x.target").alias("export_split"), F.col("x.w").alias("training_weight"))


#: The gates, what a failed one is, and its severity then.
GATES = [
    ("source_file_exists", "fail", "critical"),
    ("source_duration_known", "warn", "warning"),
    ("source_checksum_exists", "warn", "warning"),
    ("source_decodes_checkable", "not_applicable", "warning"),
    ("active_analysis_path_exists", "warn", "warning"),
    ("active_segments_manifest_exists", "fail", "critical"),
    ("successful_transcription_window_exists", "fail", "critical"),
    ("merged_midi_exists_if_complete", "warn", "warning"),
    ("feature_pack_exists", "fail", "critical"),
    ("feature_pack_validates", "fail", "critical"),
    ("ai_jsonl_exists", "fail", "critical"),
    ("tags_have_evidence", "warn", "warning"),
    ("ai_confidence_fields_exist", "warn", "warning"),
    ("ai_provenance_fields_exist", "warn", "warning"),
]


def quality_gates(facts: DataFrame, key: str) -> DataFrame:
    """One row per gate: key, gate, status, severity. ``facts`` has a row per performance.

    Its columns: source_exists, duration, checksum, analysis_exists, manifest_exists, successful, remaining, merged_exists, pack_exists,
    pack_valid, jsonl_exists, tags, tags_with_evidence, records, with_confidence, with_provenance. Null counts are 0, null flags false. Tags that
    don't all have evidence warn; no tags at all fail, without being critical. Fields are looked for in all records.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    holds = [
        flag("source_exists"), F.col("duration").isNotNull(), F.coalesce(F.trim("checksum"), F.lit("")) != "", flag("source_exists"), flag("analysis_exists"), flag("manifest_exists"), n("successful") > 0,
        (n("remaining") > 0) | flag("merged_exists"), flag("pack_exists"), flag("pack_exists") & flag("pack_valid"), flag("jsonl_exists"),
        (n("tags") > 0) & (n("tags_with_evidence") == n("tags")), n("with_confidence") == n("records"), n("with_provenance") == n("records"),
    ]
    row = lambda gate, ok: F.struct(F.lit(gate[0]).alias("gate"), F.when(ok, "pass").otherwise(F.when((F.lit(gate[0]) == "tags_have_evidence") & (n("tags") == 0), "fail").otherwise(gate[1])).alias("status"), F.when(ok, "info").otherwise(gate[2]).alias("severity"))
    return facts.select(key, F.explode(F.array(*[row(g, ok) for g, ok in zip(GATES, holds, strict=True)])).alias("g")).select(key, "g.*")


def gate_verdicts(gates: DataFrame, key: str) -> DataFrame:
    """passed, warned and failed gates of each performance, its quality status and the split that follows."""
    bad, warned = F.count_if(F.col("status") == "fail"), F.count_if(F.col("status") == "warn")
    critical = F.bool_or((F.col("status") == "fail") & (F.col("severity") == "critical"))
    g = gates.groupBy(key).agg(F.count_if(F.col("status") == "pass").alias("passed"), warned.alias("warned"), bad.alias("failed"), critical.alias("critical"))
    rung = lambda a, b, c, d: F.when(F.col("critical"), a).when(F.col("failed") > 0, b).when(F.col("warned") > 0, c).otherwise(d)
    return g.withColumns({"quality_status": rung("quarantined", "review_required", "weak_accept", "accepted"), "split": rung("quarantine", "review", "weak_labels", "train")})


def density_score(n: Column, seconds: Column) -> Column:
    d = n / F.greatest(seconds, F.lit(1e-6))
    return F.when(d < 0.08, 0.1).when(d < 0.25, 0.35).when(d < 1.0, 0.65).when(d < 4.0, 0.85).otherwise(0.75)


#: States in which something sounds, and of each task the states it allows, its least seconds and its least notes.
SOUNDING = ["rhythm_dominant", "percussive_only", "harmonic_dominant", "melodic_lead", "vocal_dominant", "rap_vocal_dominant", "polyphonic_full_mix"]
TASKS = {
    "continuation": (["rhythm_dominant", "harmonic_dominant", "melodic_lead", "polyphonic_full_mix", "vocal_dominant", "rap_vocal_dominant"], 4.0, 2),
    "call_response": (["vocal_dominant", "rap_vocal_dominant", "melodic_lead", "rhythm_dominant", "polyphonic_full_mix"], 2.0, 2),
    "buildup_to_release": (["rhythm_dominant", "harmonic_dominant", "polyphonic_full_mix"], 6.0, 2),
}


def by_task(value, otherwise) -> Column:
    """A column of each row's task; ``value(task)`` gives it."""
    out = F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise
    for task in TASKS:
        out = F.when(F.col("task") == task, value(task)).otherwise(out)
    return out


def task_allowed(state: Column) -> Column:
    """Whether a row's task may have this state; an answer may be in any state that sounds."""
    return by_task(lambda t: state.isin(TASKS[t][0]) | ((F.lit(t) == "call_response") & state.isin(SOUNDING)), False)


def states_compatible(a: Column, b: Column) -> Column:
    """Whether what sounds in state ``a`` can go on in state ``b``."""
    voices = ["melodic_lead", "vocal_dominant", "rap_vocal_dominant"]
    chords = a.isin("harmonic_dominant", "polyphonic_full_mix") & b.isin("harmonic_dominant", "polyphonic_full_mix", "melodic_lead")
    beats = a.isin("rhythm_dominant", "percussive_only") & b.isin("rhythm_dominant", "percussive_only", "polyphonic_full_mix")
    return (a == b) | chords | beats | (a.isin(voices) & b.isin(*voices, "polyphonic_full_mix"))


def boundary_evidence(pairs: DataFrame) -> DataFrame:
    """Adds the nine parts of phrase-boundary evidence and ``evidence``, their weighted sum.

    From context_ and target_density, context_ and target_state, distance (of the target's start to a segment's end; null: none), phrase_refs,
    arrival_refs (records that overlap the target), motif, target_lo, target_hi, target_notes and task.
    """
    before, after, seconds = F.col("context_density"), F.col("target_density"), F.greatest(F.lit(1e-6), F.col("target_hi") - F.col("target_lo"))
    changed = (F.col("context_state") != F.col("target_state")) & (F.col("target_state") != "silence_or_noise")
    least = by_task(lambda t: F.lit(max(4.0, TASKS[t][1])), 4.0)
    parts = [
        ("density_change", 0.14, clamp01(F.abs(after - before) / 2.0)),
        ("onset_balance", 0.12, clamp01((clamp01(before / 4.0) + clamp01(after / 4.0)) * 0.5)),
        ("segment_proximity", 0.12, clamp01(1 - F.least(F.coalesce("distance", F.lit(999.0)), F.lit(8.0)) / 8.0)),
        ("state_change", 0.1, F.when(changed, 1.0).when(F.col("target_state").isin(SOUNDING), 0.55).otherwise(0.0)),
        ("phrase_part", 0.12, clamp01(F.coalesce("phrase_refs", F.lit(0)) / 3.0)),
        ("arrival_part", 0.12, clamp01(F.coalesce("arrival_refs", F.lit(0)) / 4.0)),
        ("repetition_part", 0.12, clamp01(F.col("motif"))),
        ("duration_part", 0.08, clamp01(seconds / least)),
        ("density_part", 0.08, density_score(F.col("target_notes"), seconds)),
    ]
    named = pairs.withColumns({name: round6(value) for name, _, value in parts})
    return named.withColumn("evidence", round6(clamp01(sum(weight * value for _, weight, value in parts))))


#: How far witnesses agree, as a score.
WITNESS = {"supportive": 0.84, "conflicted": 0.42, "missing": 0.58}


def pair_quality(pairs: DataFrame) -> DataFrame:
    """Adds suitability, completeness, novelty, final_score and split to context/target pairs with ``boundary_evidence``.

    Also looks at reliability, boundary, motif, blocked and, where given, ambiguity, witness (a status), disputed, unresolved, review_heavy and
    long_form. A target in a state that its task doesn't allow goes to review at best.
    A filter on what is added here is pushed below it and repeats the score's expressions: rank or write first, then filter.
    """
    flag = lambda c: given(pairs, c) > 0
    state, notes = F.col("target_state"), F.col("target_notes")
    suitable = F.when(by_task(lambda t: state.isin(TASKS[t][0]), False), 1.0).when(state.isin(SOUNDING), 0.25).otherwise(0.05)
    complete = clamp01(notes / by_task(lambda t: F.lit(float(max(1, TASKS[t][2]))), 4.0) * 0.8 + 0.2)
    for refs in ("phrase_refs", "arrival_refs"):
        complete = clamp01(complete + F.when(given(pairs, refs) > 0, 0.04).otherwise(0.0))
    dense = density_score(notes, F.col("target_hi") - F.col("target_lo"))
    status = F.col("witness") if "witness" in pairs.columns else F.lit("missing")
    witness = F.when(status == "supportive", WITNESS["supportive"]).when(status == "conflicted", WITNESS["conflicted"]).otherwise(WITNESS["missing"])
    weighted = 0.24 * clamp01(F.col("reliability")) + 0.14 * suitable + 0.06 * clamp01(F.col("boundary")) + 0.08 * clamp01(F.col("evidence")) + 0.14 * dense + 0.14 * complete + 0.1 * clamp01(F.col("motif")) + 0.14 * witness
    weighted = weighted + F.when(flag("long_form"), 0.06).otherwise(0.0)
    lost = F.when(given(pairs, "ambiguity") > 0.72, 0.1).otherwise(0.0) + F.when(flag("disputed"), 0.08).otherwise(0.0) + F.when(flag("unresolved"), 0.06).otherwise(0.0) + F.when(flag("review_heavy"), 0.06).otherwise(0.0)
    scored = pairs.withColumns({"suitability": suitable, "completeness": round6(complete), "final_score": round6(clamp01(weighted - lost))})
    f = F.col("final_score")
    bonus = F.when(state.isin("polyphonic_full_mix", "harmonic_dominant"), 0.03).otherwise(0.0)
    novelty = round6(clamp01(0.45 * f + 0.35 * clamp01(F.col("motif")) + 0.2 * dense + bonus))
    may = task_allowed(state)
    split = F.when(F.col("blocked"), "exclude").when((f >= 0.72) & may, "train").when((f >= 0.6) & may, "validation").when(f >= 0.35, "review").otherwise("exclude")
    return scored.withColumns({"novelty": novelty, "split": split})
