"""Generation examples: which stretches of a performance are context and target for which task, and what their task's policy says.

Regions stand in one row each with their state; a row sees the region before it and the two after it from one pass (``ordered.neighbours``),
lists the examples that begin at it as an array, and the array is exploded. So all ten kinds come from one evaluation of the regions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ostinato.functions.scalars import clamp01, round6
from ostinato.operators import ordered
from ostinato.operators.records import SOUNDING, states_compatible

#: Task, the states that it allows, least and most seconds of its target, least notes. Infilling allows what sounds.
POLICIES = [
    ("continuation", "rhythm_dominant,harmonic_dominant,melodic_lead,polyphonic_full_mix,vocal_dominant,rap_vocal_dominant", 4.0, 120.0, 2),
    ("phrase_continuation", "melodic_lead,vocal_dominant,rap_vocal_dominant,harmonic_dominant,polyphonic_full_mix", 6.0, 180.0, 2),
    ("groove_continuation", "rhythm_dominant,percussive_only,polyphonic_full_mix", 2.0, 90.0, 2),
    ("harmony_continuation", "harmonic_dominant,polyphonic_full_mix", 4.0, 120.0, 2),
    ("melody_continuation", "melodic_lead,vocal_dominant,polyphonic_full_mix,rap_vocal_dominant", 3.0, 90.0, 2),
    ("call_response", "vocal_dominant,rap_vocal_dominant,melodic_lead,rhythm_dominant,polyphonic_full_mix", 2.0, 90.0, 2),
    ("motif_transformation", "rhythm_dominant,melodic_lead,polyphonic_full_mix,harmonic_dominant", 1.5, 60.0, 2),
    ("section_transition", "rhythm_dominant,harmonic_dominant,melodic_lead,polyphonic_full_mix,vocal_dominant", 6.0, 180.0, 2),
    ("buildup_to_release", "rhythm_dominant,harmonic_dominant,polyphonic_full_mix", 6.0, 180.0, 2),
    ("infill_missing_region", ",".join(SOUNDING), 1.0, 60.0, 1),
]
#: How strong a motif each kind assumes, and the least difference of densities at a phrase's edge.
MOTIF = {"continuation": 0.48, "long": 0.54, "phrase": 0.46, "phrase_windows": 0.52, "groove": 0.56, "harmony": 0.6, "melody": 0.58, "response": 0.58, "section": 0.5, "release": 0.58, "infill": 0.52}
EDGE, RATIO, SECTION_SECONDS = 0.35, 3.5, 12.0
BLOCK = 64


def _example(task: str, when: Column, context: tuple[Column, Column], target: Column, motif: Column, note: Column, target_hi: Column | None = None) -> Column:
    made = F.struct(
        F.lit(task).alias("task"), context[0].alias("context_lo"), context[1].alias("context_hi"), target["lo"].alias("target_lo"), (target["hi"] if target_hi is None else target_hi).alias("target_hi"),
        target["idx"].alias("target_idx"), target["content_state"].alias("target_state"), target["notes"].alias("target_notes"), target["harmony_refs"].alias("harmony_refs"), target["melody_refs"].alias("melody_refs"),
        round6(motif).alias("motif"), note.alias("note"),
    )
    return F.when(when, made)


def candidates(regions: DataFrame, long_form: bool, meter_confidence: float = 0.0) -> DataFrame:
    """regions(perf, kind, idx, lo, hi, notes, density, content_state, activity, harmony_refs, melody_refs) -> one row an example.

    ``kind`` is 'window' or 'segment', other kinds are left out; harmony_refs and melody_refs say how many such records overlap the
    region. Regions without events may be missing: examples go over neighbouring numbers only. ``long_form`` performances have contexts of
    two windows and phrases between windows. ``note`` says how an example came about.
    """
    names = ["idx", "lo", "hi", "notes", "density", "content_state", "activity", "harmony_refs", "melody_refs"]
    own = regions.where(F.col("kind").isin("window", "segment")).select("perf", "kind", F.struct(*names).alias("at"), F.col("idx").alias("_idx"))
    beside = ordered.neighbours(own, ["perf", "kind"], F.floor(F.col("_idx") / BLOCK).cast("int"), ["_idx"], {"at": "at"}, before=1, after=2)
    near = lambda c, d: F.when(F.col(c)["idx"] == F.col("at")["idx"] + d, F.col(c))
    rows = beside.withColumns({"before": near("at_prev1", -1), "then": near("at_next1", 1), "last": near("at_next2", 2)})
    a, b, c, p = F.col("at"), F.col("then"), F.col("last"), F.col("before")
    window, segment = F.col("kind") == "window", F.col("kind") == "segment"
    has = lambda *xs: F.lit(True) if not xs else xs[0].isNotNull() & has(*xs[1:])
    whole = (a["lo"], a["hi"])
    compatible = lambda x, y: states_compatible(x["content_state"], y["content_state"])

    goes_on = window & has(b) & (b["content_state"] != "silence_or_noise") & compatible(a, b)
    two = F.lit(long_form) & has(p) & F.coalesce(compatible(p, a), F.lit(False))
    edge = (F.abs(b["density"] - a["density"]) > EDGE) | (F.abs(a["density"] - p["density"]) > EDGE)
    in_states = lambda x, task: x["content_state"].isin(next(s for t, s, *_ in POLICIES if t == task).split(","))
    ratio = F.greatest(a["notes"], b["notes"]) / F.greatest(F.lit(1), F.least(a["notes"], b["notes"]))
    contrast = clamp01(F.abs(b["density"] - a["density"]) / 2.0)
    arrival = clamp01(0.2 + c["activity"] / 4.0)
    tail = F.least(F.lit(SECTION_SECONDS), a["hi"] - a["lo"])
    text = F.lit
    each = [
        _example("continuation", goes_on, (F.when(two, p["lo"]).otherwise(a["lo"]), a["hi"]), b, text(MOTIF["long" if long_form else "continuation"]), F.when(two, "two_window_context").otherwise("compatible_states")),
        _example("phrase_continuation", segment & has(b), whole, b, text(MOTIF["phrase"]), text("segments")),
        _example("phrase_continuation", window & F.lit(long_form) & has(p, b) & edge, (p["lo"], a["hi"]), b, text(MOTIF["phrase_windows"]), text("density_boundary")),
        _example("groove_continuation", window & has(b) & in_states(b, "groove_continuation"), whole, b, text(MOTIF["groove"]), text("target_state")),
        _example("harmony_continuation", window & has(b) & (in_states(b, "harmony_continuation") | (b["harmony_refs"] > 0)), whole, b, text(MOTIF["harmony"]), F.when(b["harmony_refs"] > 0, "harmony_evidence").otherwise("target_state")),
        _example("melody_continuation", window & has(b) & in_states(b, "melody_continuation"), whole, b, text(MOTIF["melody"]), text("target_state")),
        _example("call_response", window & has(b) & (a["notes"] >= 4) & (b["notes"] >= 4) & (ratio <= RATIO), whole, b, MOTIF["response"] + 0.2 * contrast, text("density_response")),
        _example("section_transition", segment & has(b), (F.greatest(a["lo"], a["hi"] - tail), a["hi"]), b, text(MOTIF["section"]), text("sections"), F.least(b["hi"], b["lo"] + F.least(F.lit(SECTION_SECONDS), b["hi"] - b["lo"]))),
        _example("buildup_to_release", window & has(b, c) & (b["notes"] > a["notes"]) & (c["notes"] < b["notes"]), (a["lo"], b["hi"]), c, clamp01(MOTIF["release"] + 0.22 * meter_confidence + 0.2 * arrival), text("density_ramp")),
        _example("infill_missing_region", window & has(b, c) & (a["notes"] >= 2) & (c["notes"] >= 2) & (b["notes"] >= 2), (a["lo"], c["hi"]), b, text(MOTIF["infill"]), text("context_on_both_sides")),
    ]
    return rows.select("perf", "kind", F.col("at.idx").alias("idx"), F.col("at.content_state").alias("context_state"), F.col("at.notes").alias("own_notes"), F.explode(F.array_compact(F.array(*each))).alias("x")).select("perf", "kind", "idx", "context_state", "own_notes", "x.*")


def checked(examples: DataFrame) -> DataFrame:
    """Adds allowed, failed (checks that a task's policy fails, in order) and blocked to examples; see ``candidates``.

    The policy is a fixed short table. Harmony may go on in any state if a harmony record overlaps the target; a melody or an answer in any
    state that sounds if a record of melody (for answers: or harmony) does. A task without a policy is never allowed.
    """
    policy = examples.sparkSession.createDataFrame(POLICIES, "task string, states string, least_seconds double, most_seconds double, least_notes int")
    rows = examples.join(F.broadcast(policy), "task", "left")
    sounds = F.col("target_state").isin(SOUNDING)
    harmony, melody = F.col("harmony_refs") > 0, F.col("melody_refs") > 0
    task = F.col("task")
    by_evidence = ((task == "harmony_continuation") & harmony) | ((task == "melody_continuation") & melody & sounds) | ((task == "call_response") & (melody | harmony) & sounds)
    allowed = F.coalesce(F.array_contains(F.split("states", ","), F.col("target_state")) | by_evidence, F.lit(False))
    seconds = F.greatest(F.lit(1e-6), F.col("target_hi") - F.col("target_lo"))
    fits = seconds.between(F.col("least_seconds"), F.col("most_seconds"))
    checks = [(~allowed, "task_policy_failed"), (~fits, "duration_out_of_range"), (F.col("target_notes") < F.col("least_notes"), "target_too_sparse")]
    failed = F.array_compact(F.array(*[F.when(bad, name) for bad, name in checks]))
    return rows.withColumns({"allowed": allowed, "failed": F.array_join(failed, ","), "blocked": F.col("target_notes") == 0}).drop("states", "least_seconds", "most_seconds", "least_notes")


def motif_candidates(places: DataFrame, regions: DataFrame, long_form: bool = False, most: int = 64) -> DataFrame:
    """places(perf, motif, idx, n): how often a motif occurs in a window; regions as for ``candidates`` -> examples of motif_transformation.

    A motif's first window is the context and its second the target. ``most`` is the operator's own limit of motifs a performance: those
    with most occurrences, ties by name. Confidence grows with the occurrences. Windows that ``regions`` doesn't have are skipped.
    """
    windows = regions.where("kind = 'window'")
    known = places.join(windows.select("perf", "idx").distinct(), ["perf", "idx"], "left_semi")
    by_motif = Window.partitionBy("perf", "motif")
    ranked = known.withColumns({"nth": F.row_number().over(by_motif.orderBy("idx")), "repeats": F.sum("n").over(by_motif)})
    pairs = ranked.where("nth <= 2").groupBy("perf", "motif", "repeats").agg(F.min("idx").alias("idx"), F.max("idx").alias("then")).where(F.col("then") > F.col("idx"))
    limited = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("perf").orderBy(F.desc("repeats"), "motif"))).where(F.col("rank") <= most)
    whole = ["lo", "hi", "content_state", "notes"]
    context = windows.select("perf", "idx", *[F.col(c).alias(f"own_{c}") for c in whole])
    target = windows.select("perf", F.col("idx").alias("then"), *whole, "harmony_refs", "melody_refs")
    return limited.join(context, ["perf", "idx"]).join(target, ["perf", "then"]).select(
        "perf", F.lit("window").alias("kind"), "idx", F.col("own_content_state").alias("context_state"), "own_notes", F.lit("motif_transformation").alias("task"), F.col("own_lo").alias("context_lo"), F.col("own_hi").alias("context_hi"),
        F.col("lo").alias("target_lo"), F.col("hi").alias("target_hi"), F.col("then").alias("target_idx"), F.col("content_state").alias("target_state"), F.col("notes").alias("target_notes"), "harmony_refs", "melody_refs",
        round6(clamp01(F.least(F.lit(0.95), 0.25 + F.col("repeats") / 6.0))).alias("motif"), F.concat(F.lit("motif="), "motif").alias("note"),
    )
