"""What surrounds generation, and pitch records, on literal and random rows."""

import random

from pyspark.sql import functions as F

from ostinato.operators import generation, harmony


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_retrieval(spark):
    e = spark.createDataFrame([("a", " Train", 0.8, "t"), ("b", "validation", 0.99, "t"), ("c", "train", None, "t"), ("d", "train", 0.8, "t"), ("e", "review", 1.0, "t"), ("f", None, 1.0, "t"), ("g", "review", 1.0, "u")], "example_id string, split string, final_score double, task string")
    assert rows(generation.retrieved(e, ["task"], 3, ["train", "validation"]), "task", "rank", "example_id") == [("t", 1, "a"), ("t", 2, "d"), ("t", 3, "c")]
    assert generation.retrieved(e.limit(0), ["task"], 3, ["train"]).count() == 0


def test_candidates_and_notes(spark):
    c = spark.createDataFrame([(1, "b", 16), (1, "a", 40), (1, "c", None), (2, "x", None)], "request long, candidate string, notes int")
    assert rows(generation.candidate_scores(c, "request", "candidate", "notes"), "request", "candidate", "score", "chosen") == [(1, "a", 1.0, True), (1, "b", 1.0, False), (1, "c", 0.0, False), (2, "x", 0.0, True)]
    prompts = spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string")
    assert rows(generation.stand_in_notes(prompts, "id", "text"), "id", "start_tick", "pitch")[:2] == [(1, 0, 48 + (97 + 98) % 24), (1, 1440, 58 + (97 + 98) % 24)]
    n = spark.createDataFrame([(480, 960, 120.0, 130, 0), (-5, 0, 0.0, -3, 200)], "start_tick int, duration_tick int, tempo double, pitch int, velocity int")
    assert rows(generation.note_seconds(n), "start", "end", "pitch", "velocity") == [(0.0, 0.05, 0, 127), (0.5, 1.5, 127, 1)]


def test_palettes(spark):
    t = spark.createDataFrame([(1, "Lead"), (1, "chords"), (1, None), (1, "lead"), (2, "texture_bed"), (2, "transition_fx")], "project long, role string")
    assert rows(generation.palettes(t, "project", "role"), "project", "tracks", "low", "mid", "high", "missing", "masking_risks") == [
        (1, 4, 0, 2, 2, "bass,drums,texture_bed,transition_fx", "lead/chords"), (2, 2, 0, 1, 1, "bass,chords,drums,lead", "texture_bed/transition_fx"),
    ]


def test_sessions_and_batches(spark):
    s = spark.createDataFrame([(1, "s", "ok", 3, True), (2, None, "splice_production_only", 0, True), (3, "s", None, None, None)], "id long, session_id string, source_policy_inherited string, human_rating int, training_allowed boolean")
    got = {r["id"]: r["e"] for r in s.select("id", generation.session_errors(s, ["session_id"], ["ok", *generation.RESTRICTED]).alias("e")).collect()}
    assert got == {1: [], 2: ["human_rating must be 1-5", "missing:session_id", "training_allowed must be false for restricted source policy"], 3: ["human_rating must be 1-5", "invalid_source_policy_inherited"]}
    b = spark.createDataFrame([(1, True, False, True, True, None, None), (2, True, True, False, False, False, False), (3, True, True, None, None, True, None), (4, None, None, None, None, None, None)], "batch long, valid boolean, execute boolean, transcription_requested boolean, allow_transcription boolean, modal_requested boolean, allow_modal boolean")
    items = spark.createDataFrame([(1, True), (1, None), (1, False)], "batch long, authorized boolean")
    assert rows(generation.dry_runs(b, items, "batch"), "batch", "status", "runnable", "skipped") == [(1, "dry_run_success", 1, 2), (2, "execution_blocked_not_integrated", 0, 0), (3, "blocked_invalid_manifest", 0, 0), (4, "blocked_invalid_manifest", 0, 0)]


def test_readiness(spark):
    c = spark.createDataFrame([("a", 1, 0, 1, None, 1, 0, 2), ("b", 0, 5, 1, 1, 0, 1, 0)], "site string, symbolic int, exports int, sessions int, textures int, seeds int, arrangements int, handoffs int")
    got = {(r["site"], r["subsystem"]): r["state"] for r in generation.readiness(c, "site").collect()}
    assert (got["a", "symbolic_ranker"], got["a", "seed_selector"], got["a", "texture_embedding"], got["a", "controller"]) == ("not_ready", "ranker_training_ready", "not_ready", "conditioning_ready")
    assert (got["b", "symbolic_generator"], got["b", "seed_selector"], got["b", "arrangement"]) == ("not_ready", "blocked", "conditioning_ready")


def test_pitch_records(spark):
    """Against a plain reading of the definitions, over regions of 1 to 40 events."""
    draw = random.Random(5)
    regions = {i: [(float(t), draw.randrange(20, 110), draw.randrange(1, 128)) for t in range(n)] for i, n in enumerate((1, 2, 5, 6, 7, 40))}
    data = [("p", "bin", i, 0.0, 40.0, k, t, note, vel) for i, events in regions.items() for k, (t, note, vel) in enumerate(events)]
    in_regions = spark.createDataFrame(data, "perf string, kind string, idx int, lo double, hi double, seq long, t double, note int, vel int")
    records = harmony.pitch_harmony(in_regions)
    got = {r["idx"]: r for r in records.collect()}
    for i, events in regions.items():
        notes = [e[1] for e in events]
        counts = [sum(x % 12 == c for x in notes) for c in range(12)]
        top = counts.index(max(counts))
        steps = [b - a for a, b in zip(notes, notes[1:])]
        upper, lower = notes[::2], notes[1::2]
        pairs = min(len(upper), len(lower)) - 1
        against = sum((upper[k + 1] - upper[k]) * (lower[k + 1] - lower[k]) < 0 for k in range(pairs)) / pairs if len(notes) >= 6 and pairs > 0 else 0.0
        r = got[i]
        assert (r["lowest"], r["highest"], r["arrival"], r["contrary"]) == (min(notes), max(notes), notes[-1] % 12 == top, round(against, 6))
        assert r["common_tones"] == sum(s % 12 == 0 for s in steps) and r["ups"] == sum(s > 0 for s in steps)
        assert abs(r["mean_motion"] - sum(map(abs, steps)) / max(1, len(steps))) < 1e-6
        assert r["confidence"] == round(min(0.45 if len(notes) < 8 else 0.95, 0.25 + len(notes) / 120), 6)
    assert harmony.record_kind(records, "counterpoint").where(F.col("voices") >= 1).count() == len(regions)
    assert harmony.pitch_harmony_macro(records).first()["regions"] == len(regions)
    assert records.limit(0).count() == harmony.pitch_harmony(in_regions.limit(0)).count() == 0
