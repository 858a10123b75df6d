"""What surrounds generation: example retrieval, candidate scores, notes of candidates, palettes, session checks, dry runs, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Splits from best to worst, ticks in a beat, least length of a note in seconds.
SPLITS = ["train", "validation", "review", "exclude"]
TICKS, SHORTEST = 480.0, 0.05


def retrieved(examples: DataFrame, request: list[str], k: int, splits: list[str]) -> DataFrame:
    """The k best examples of each value of ``request`` among the given splits: by split, then score, then the rest; with rank.

    ``examples`` has split, final_score and example_id. Null scores count as 0, ids decide ties.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in SPLITS]), F.lower(F.trim("split")))
    order = Window.partitionBy(*request).orderBy(F.desc("_fits"), "_place", F.desc("_score"), "example_id")
    # Others sort last and go after the ranks: a filter before them would be pushed down and repeat all that makes a split.
    placed = examples.withColumns({"_fits": F.coalesce(F.lower(F.trim("split")).isin(splits), F.lit(False)), "_place": place, "_score": F.coalesce("final_score", F.lit(0.0))})
    return placed.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) & F.col("_fits")).drop("_fits", "_place", "_score")


def candidate_scores(candidates: DataFrame, request: str, candidate: str, notes: str) -> DataFrame:
    """request, candidate, score (a sixteenth for each note, at most 1) and whether it is chosen: best score, ties to the smaller id."""
    score = F.least(F.lit(1.0), F.coalesce(notes, F.lit(0)) / 16.0)
    order = Window.partitionBy(request).orderBy(F.desc("score"), candidate)
    return candidates.select(request, candidate, score.alias("score")).withColumn("chosen", F.row_number().over(order) == 1)


def note_seconds(notes: DataFrame) -> DataFrame:
    """Notes in ticks (start_tick, duration_tick, tempo, pitch, velocity) with ``start`` and ``end`` in seconds, and playable pitch and velocity."""
    beat = 60.0 / F.greatest(F.lit(1.0), F.col("tempo"))
    start = F.greatest(F.lit(0.0), F.col("start_tick") / TICKS * beat)
    end = F.greatest(start + SHORTEST, (F.col("start_tick") + F.col("duration_tick")) / TICKS * beat)
    clamp = lambda c, lo: F.greatest(F.lit(lo), F.least(F.lit(127), F.col(c)))
    return notes.withColumns({"start": start, "end": end, "pitch": clamp("pitch", 0), "velocity": clamp("velocity", 1)})


#: Start in ticks, steps over the base pitch and velocity of the notes that stand in for a model.
STAND_IN = [(0, 0, 82), (480, 3, 80), (960, 7, 86), (1440, 10, 84)]


def stand_in_notes(prompts: DataFrame, prompt_id: str, text: str) -> DataFrame:
    """Four notes for each prompt, their pitch from the sum of its characters; the same prompt always gives the same notes. Null is empty."""
    total = F.aggregate(F.split(F.coalesce(text, F.lit("")), ""), F.lit(0).cast("long"), lambda s, c: s + F.ascii(c))
    base = (48 + total % 24).cast("int")
    notes = F.array(*[F.struct(F.lit(at).alias("start_tick"), F.lit(480).alias("duration_tick"), (base + step).alias("pitch"), F.lit(v).alias("velocity")) for at, step, v in STAND_IN])
    return prompts.select(prompt_id, F.explode(notes).alias("n")).select(prompt_id, "n.*")


#: The register of each role of a palette.
REGISTERS = {"bass": "low", "drums": "low", "chords": "mid", "texture_bed": "mid", "lead": "high", "transition_fx": "high"}


def palettes(tracks: DataFrame, project: str, role: str) -> DataFrame:
    """One row per project: how many tracks each register has, roles that are missing, and risks of masking. Other roles count as mid."""
    own = tracks.withColumn("_role", F.lower(F.coalesce(role, F.lit("unknown"))))
    in_register = lambda name: F.count_if(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in REGISTERS.items() for x in kv]), F.col("_role")), F.lit("mid")) == name)
    g = own.groupBy(project).agg(F.count("*").alias("tracks"), in_register("low").alias("low"), in_register("mid").alias("mid"), in_register("high").alias("high"), F.collect_set(F.when(F.col("_role").isin(list(REGISTERS)), F.col("_role"))).alias("_roles"))
    both = lambda a, b: F.array_contains("_roles", a) & F.array_contains("_roles", b)
    missing = F.array_except(F.array(*[F.lit(r) for r in sorted(REGISTERS)]), F.col("_roles"))
    risks = F.concat_ws(",", F.when(both("lead", "chords"), "lead/chords"), F.when(both("texture_bed", "transition_fx"), "texture_bed/transition_fx"))
    return g.select(project, "tracks", "low", "mid", "high", F.array_join(missing, ",").alias("missing"), risks.alias("masking_risks"))


#: Policies that rule out training.
RESTRICTED = ["production_only_training_excluded", "splice_production_only", "unknown_blocked"]


def session_errors(rows: DataFrame, required: list[str], policies: list[str]) -> Column:
    """What is wrong with a row of session results, as a sorted array: absent fields, an unknown policy, a rating out of 1 to 5, training under a restricted policy."""
    absent = [F.when(F.col(c).isNull(), F.lit(f"missing:{c}")) for c in required]
    policy = F.coalesce("source_policy_inherited", F.lit(""))
    others = [
        F.when(~policy.isin(policies), F.lit("invalid_source_policy_inherited")),
        F.when(~F.coalesce(F.col("human_rating").between(1, 5), F.lit(False)), F.lit("human_rating must be 1-5")),
        F.when(policy.isin(RESTRICTED) & F.coalesce("training_allowed", F.lit(False)), F.lit("training_allowed must be false for restricted source policy")),
    ]
    return F.array_sort(F.array_compact(F.array(*absent, *others)))


def dry_runs(batches: DataFrame, items: DataFrame, batch: str) -> DataFrame:
    """One row per batch: status, runnable and skipped items, errors. Nothing is run: a batch is blocked, a dry run, or not integrated.

    ``batches`` has valid, execute and for transcription and modal whether they are requested and allowed; null flags are false. ``items`` has authorized.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    counted = items.groupBy(batch).agg(F.count_if(flag("authorized")).alias("runnable"), F.count_if(~flag("authorized")).alias("skipped"))
    asked = lambda what: F.when(flag(f"{what}_requested") & ~flag(f"allow_{what}"), f"{what} requested but not allowed")
    errors = F.concat_ws(",", F.when(~flag("valid"), "invalid manifest"), asked("transcription"), asked("modal"))
    status = F.when(errors != "", "blocked_invalid_manifest").when(flag("execute"), "execution_blocked_not_integrated").otherwise("dry_run_success")
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return batches.join(counted, batch, "left").select(batch, status.alias("status"), n("runnable"), n("skipped"), errors.alias("errors"))


def readiness(counts: DataFrame, key: str) -> DataFrame:
    """key, subsystem, state: what each subsystem is ready for, from counts of symbolic, exports, sessions, textures, seeds, arrangements and handoffs."""
    has = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    conditioned = lambda c: F.when(has(c), "conditioning_ready").otherwise("not_ready")
    seeded = F.when(~has("seeds"), "blocked").when(has("sessions"), "ranker_training_ready").otherwise("conditioning_ready")
    states = {
        "symbolic_generator": conditioned("symbolic"),
        "symbolic_ranker": F.when(has("symbolic") & has("exports"), "ranker_training_ready").otherwise("not_ready"),
        "texture_embedding": conditioned("textures"),
        "seed_selector": seeded,
        "arrangement": conditioned("arrangements"),
        "controller": conditioned("handoffs"),
    }
    each = F.array(*[F.struct(F.lit(name).alias("subsystem"), state.alias("state")) for name, state in states.items()])
    return counts.select(key, F.explode(each).alias("x")).select(key, "x.*")
