"""Operators on small literal cases, and random ones against sequential versions."""

import random
import struct
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from ostinato.functions.scalars import slug
from ostinato.operators import boundaries, events, harmony, intervals, lexicon, ordered, policies, records, rhythm
from ostinato.sources import files
from ostinato.streaming import live


def region_rows(spark, times, pulse_vel=80, notes=None, lo=0.0, hi=8.0):
    rows = [("p", "window", 0, lo, hi, i, float(t), (notes or [60])[i % len(notes or [60])], pulse_vel) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "perf string, kind string, idx int, lo double, hi double, seq long, t double, note int, vel int")


def steps(iois):
    t, out = 0.0, [0.0]
    for x in iois:
        t += x
        out.append(t)
    return out


def irregular(n):
    """Gaps of any size up to more than two pulses, so spread widely: over 0.48 pulses make a rhythm random."""
    rng = random.Random(11)
    return [rng.uniform(0.1, 2.3) for _ in range(n)]


@pytest.mark.parametrize("iois,expected", [([0.5] * 16, {"straight", "triplet"}), ([0.333, 0.667] * 8, {"triplet", "swing"}), (irregular(12), {"random", "free"}), ([1.0, 1.0], {"sparse"})])
def test_subdivision(spark, iois, expected):
    got = rhythm.subdivisions(rhythm.with_gaps(region_rows(spark, steps(iois), hi=20.0)), pulse=1.0).first()
    assert got["subdivision"] in expected


def test_edges_count_on_both_sides(spark):
    points = spark.createDataFrame([("p", 4.0), ("p", 3.9), ("q", 4.0), (None, 1.0), ("p", None)], "perf string, t double")
    tiles = spark.createDataFrame([("p", 0, 0.0, 4.0), ("p", 1, 4.0, 8.0), ("p", 2, 5.0, 5.0)], "perf string, idx int, lo double, hi double")
    got = sorted((r["idx"], r["t"]) for r in intervals.points_in(points, tiles, 4.0).collect())
    assert got == [(0, 3.9), (0, 4.0), (1, 4.0)]


def test_interval_joins_match_nested_loops(spark):
    rng = random.Random(4)
    spans = lambda n: [(rng.choice("ab"), i, lo := rng.uniform(0, 100), lo + rng.uniform(0, 20)) for i in range(n)]
    a, b = spans(80), spans(90)
    left = spark.createDataFrame(a, "perf string, i int, lo double, hi double")
    right = spark.createDataFrame(b, "perf string, j int, r_lo double, r_hi double")
    expected = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and y[3] >= x[2] and y[2] <= x[3])
    assert sorted((r["i"], r["j"]) for r in intervals.overlapping(left, right, 10.0).collect()) == expected
    kept = intervals.overlapping(left, right.limit(0), 10.0, how="left")
    assert kept.count() == 80 and kept.where("j is not null").count() == 0


def test_neighbours_across_blocks(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.uniform(0, 50)) for k in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i int, t double")
    got = {(r["k"], r["i"]): r["n"] for r in ordered.with_next(df, ["k"], F.floor(F.col("t") / 5).cast("int"), ["t", "i"], "t", "n").collect()}
    sums = {(r["k"], r["i"]): r["s"] for r in ordered.running_sum(df, ["k"], F.floor(F.col("t") / 5).cast("int"), ["t", "i"], "i", "s").collect()}
    for k in "ab":
        mine, total = sorted((t, i) for kk, i, t in rows if kk == k), 0
        for n, (t, i) in enumerate(mine):
            total += i
            assert got[k, i] == (mine[n + 1][0] if n + 1 < len(mine) else None) and sums[k, i] == total


def fifo(messages):
    queues, out = defaultdict(deque), []
    for perf, channel, note, seq, t, vel, delta in sorted(messages, key=lambda m: (m[4], m[3])):
        if delta > 0:
            queues[perf, channel, note].append((t, vel))
        elif queues[perf, channel, note]:
            start, v = queues[perf, channel, note].popleft()
            out.append((channel, note, v, start, max(t, start + 1e-4)))
    return sorted(out)


def test_pairing_is_first_in_first_out(spark):
    rng = random.Random(9)
    messages = [("p", rng.randrange(3), rng.randrange(3), i, float(rng.randrange(60)), rng.randrange(1, 128), rng.choice([1, -1])) for i in range(500)]
    df = spark.createDataFrame(messages, "perf string, channel int, note int, seq long, t double, vel int, delta int")
    got = sorted((r["channel"], r["note"], r["vel"], r["start"], r["end"]) for r in events.pair_on_off(df).collect())
    assert got == fifo(messages)


def test_pairing_on_a_stream(spark, sf_dir, tmp_path):
    stream = live.live_pairs(live.event_stream(spark, sf_dir))
    got = live.run_to_end(stream, "pairs", str(tmp_path / "a"))
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts", "event_id").collect()
    import json

    messages = [("p", r["user_id"], json.loads(r["props"])["k"] % 4, r["event_id"], float(i), 1, 1 if r["event_type"] in ("click", "view", "signup") else -1) for i, r in enumerate(raw)]
    assert got.count() == len(fifo(messages))


def test_tumbling_stream_is_the_batch(spark, sf_dir, tmp_path):
    stream = live.tumbling_rhythm(live.event_stream(spark, sf_dir))
    got = live.run_to_end(stream, "tumbling", str(tmp_path / "b"), "complete")
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()
    once = live.without_duplicates(live.event_stream(spark, sf_dir))
    assert live.run_to_end(once, "once", str(tmp_path / "c")).count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()


@pytest.mark.parametrize("pcs,expected", [([0, 4, 7], "triadic"), ([0, 5, 10], "quartal"), ([0, 1, 2, 6, 7], "cluster"), ([3], "single")])
def test_sonority(spark, pcs, expected):
    rows = region_rows(spark, [0.1 * i for i in range(len(pcs))], notes=[60 + p for p in pcs])
    assert harmony.sonorities(harmony.chords(rows)).first()["sonority"].startswith(expected)


def plain_chord(h):
    best, out = 0, None
    for root in range(12):
        major, minor, sus = (h[root] + h[(root + a) % 12] + h[(root + 7) % 12] for a in (4, 3, 5))
        for ok, score, name in ((major >= minor, major, "major"), (minor > major, minor, "minor"), (True, sus, "suspended_or_open")):
            if ok and score > best:
                best, out = score, (name, root)
    return out


def test_chords_match_the_sequential_rule(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for i in range(120):
        pcs = [rng.randrange(12) for _ in range(rng.randint(1, 9))]
        rows += [("p", "bin", i, 0.0, 4.0, n, 0.1 * n, 60 + pc, 80) for n, pc in enumerate(pcs)]
        expected[i] = plain_chord([pcs.count(k) for k in range(12)])
    df = spark.createDataFrame(rows, "perf string, kind string, idx int, lo double, hi double, seq long, t double, note int, vel int")
    assert {r["idx"]: (r["quality"], r["root"]) for r in harmony.chords(df).collect()} == expected


def test_peaks_and_choice(spark):
    novelty = [0, 0.1, 0.9, 0.2, 0.1, 0.92, 0.1, 0.1]
    curve = spark.createDataFrame([("p", i, float(v)) for i, v in enumerate(novelty)], "perf string, frame int, value double")
    peaks = boundaries.local_peaks(boundaries.normalised(curve), 0.55)
    assert sorted(r["frame"] for r in boundaries.refractory(peaks, 1).collect()) == [2, 5]
    assert sorted(r["frame"] for r in boundaries.refractory(peaks, 4).collect()) == [2]
    near = spark.createDataFrame([("p", 1.0, 0.5, "a"), ("p", 2.0, 0.7, "b"), ("p", 9.0, 0.6, "a")], "perf string, t double, confidence double, feature string")
    assert [(r["t"], r["confidence"]) for r in boundaries.fused(near, 1.5).orderBy("t").collect()] == [(2.0, 0.74), (9.0, 0.6)]
    assert [r["t"] for r in boundaries.greedy_choice(near, 2.0, 5).orderBy("rank").collect()] == [2.0, 9.0]


def test_nearest_rank(spark):
    got = spark.range(1).select(ordered.nearest_rank(F.array(*[F.lit(float(x)) for x in (5, 1, 4, 2, 3, 6)]), 0.5).alias("m")).first()["m"]
    assert got == 3.0


@pytest.mark.parametrize("e,expected", [((64, 4.8, 0.05, 0.06, 0.15, 2, 0.0, True), "percussive_only"), ((26, 1.8, 0.34, 0.2, 0.83, 6, 2.5, False), "harmonic_dominant"), ((72, 3.7, 0.62, 0.08, 0.78, 7, 2.8, True), "polyphonic_full_mix"), ((6, 0.22, 0.16, 0.58, 0.56, 5, 0.9, False), "ambient_low_information")])
def test_content_states(spark, e, expected):
    df = spark.createDataFrame([(*e, 0.0, 0.0)], "notes int, density double, poly double, silence double, chord double, classes int, activity double, motif boolean, movement double, confidence double")
    assert records.content_states(records.content_scores(df)).first()["content_state"] == expected


GIVEN = "notes int, density double, poly double, silence double, chord double, classes int, activity double, motif boolean, movement double, confidence double, speech double, rap double, vocal double, transition double"


@pytest.mark.parametrize("given,expected", [((0.9, 0.9, 0.9, 0.9), "rap_vocal_dominant"), ((0.0, 0.0, 0.7, 0.0), "vocal_dominant"), ((0.0, 0.5, 0.5, 1.0), "percussive_only"), ((None, None, None, None), "percussive_only")])
def test_voices_go_before_the_mix(spark, given, expected):
    df = spark.createDataFrame([(64, 4.8, 0.05, 0.06, 0.4, 3, 0.5, True, 0.0, 0.0, *given)], GIVEN)
    assert records.content_states(records.content_scores(df)).first()["content_state"] == expected


def test_speech_and_transition(spark):
    thin = (3, 0.5, 0.0, 0.2, 0.0, 1, 0.0, False, 0.0, 1.0)
    df = spark.createDataFrame([(*thin, 0.72, 0.0, 0.0, 0.0), (*thin, 0.71, 0.0, 0.0, 0.64), (*thin, 0.0, 0.0, 0.0, 0.63)], GIVEN)
    assert [r["content_state"] for r in records.content_states(records.content_scores(df)).collect()] == ["speech_like", "transition_build", "unknown"]


def test_routes(spark):
    got = {r["content_state"]: r for r in records.routed(spark.createDataFrame([("speech_like",), ("no such state",), (None,)], "content_state string")).collect()}
    assert got["speech_like"]["suppressed"] == "chord_movement,harmony,melody"
    assert got["no such state"]["allowed"] == got[None]["allowed"] == "semantic,training_export"


def test_fan_out(spark):
    rows = [("q", "quarantined_records", "high", "weak_label", 1.0), ("o", "accepted_records", "high", "raw_observation", 0.7), ("w", "weak_label_records", "medium", "weak_label", 0.65), ("r", "review_required_records", "low", "heuristic_estimate", 0.5), ("n", "accepted_records", "low", "raw_observation", 0.9), ("m", "audio_midi_only_records", "low", "raw_observation", 0.6), ("z", "weak_label_records", "high", None, None)]
    got = records.fanned_out(spark.createDataFrame(rows, "id string, export_split string, tier string, label_status string, training_weight double"), "id")
    assert sorted((r["export_record_id"], r["export_split"], r["training_weight"]) for r in got.collect()) == [
        ("m:observation:0", "audio_midi_only_records", 0.6), ("o:observation:0", "accepted_records", 0.7), ("q:quarantine:0", "quarantined_records", 1.0),
        ("r:review:0", "review_required_records", 0.4), ("r:weak_label:0", "weak_label_records", 0.5), ("w:observation:0", "accepted_records", 0.65), ("w:weak_label:0", "weak_label_records", 0.65),
    ]


def test_gates(spark):
    schema = "run long, source_exists boolean, duration double, checksum string, analysis_exists boolean, manifest_exists boolean, successful int, remaining int, merged_exists boolean, pack_exists boolean, pack_valid boolean, jsonl_exists boolean, tags int, tags_with_evidence int, records int, with_confidence int, with_provenance int"
    whole = (True, 1.0, "c", True, True, 3, 0, True, True, True, True, 2, 2, 5, 5, 5)
    change = lambda run, **new: (run, *[new.get(c.split()[0], v) for c, v in zip(schema.split(", ")[1:], whole)])
    rows = [change(1), change(2, checksum=" "), change(3, tags=0, tags_with_evidence=0), change(4, successful=0), change(5, merged_exists=False, remaining=2), (6, *[None] * 16)]
    gates = records.quality_gates(spark.createDataFrame(rows, schema), "run")
    assert gates.count() == 14 * len(rows)
    verdicts = {r["run"]: (r["passed"], r["warned"], r["failed"], r["quality_status"], r["split"]) for r in records.gate_verdicts(gates, "run").collect()}
    assert verdicts[1] == verdicts[5] == (14, 0, 0, "accepted", "train")
    assert verdicts[2] == (13, 1, 0, "weak_accept", "weak_labels")
    assert verdicts[3] == (13, 0, 1, "review_required", "review")
    assert verdicts[4] == (13, 0, 1, "quarantined", "quarantine")
    assert verdicts[6][3:] == ("quarantined", "quarantine")


def test_pair_quality(spark):
    schema = "id string, task string, context_density double, target_density double, context_state string, target_state string, distance double, phrase_refs int, arrival_refs int, motif double, target_lo double, target_hi double, target_notes int, reliability double, boundary double, blocked boolean"
    rows = [
        ("a", "continuation", 2.0, 4.0, "rhythm_dominant", "polyphonic_full_mix", 0.0, 3, 4, 1.0, 0.0, 4.0, 8, 1.0, 1.0, False),
        ("b", "buildup_to_release", 2.0, 4.0, "rhythm_dominant", "melodic_lead", 0.0, 3, 4, 1.0, 0.0, 4.0, 8, 1.0, 1.0, False),
        ("c", "continuation", 2.0, 4.0, "rhythm_dominant", "silence_or_noise", None, None, None, 0.0, 0.0, 4.0, 0, 0.0, 0.0, True),
    ]
    got = {r["id"]: r for r in records.pair_quality(records.boundary_evidence(spark.createDataFrame(rows, schema))).collect()}
    evidence = 0.14 + 0.12 * 0.75 + 0.12 + 0.1 + 0.12 + 0.12 + 0.12 + 0.08 + 0.08 * 0.85
    assert got["a"]["evidence"] == pytest.approx(evidence, abs=1e-6)
    assert got["a"]["final_score"] == pytest.approx(0.24 + 0.14 + 0.06 + 0.08 * evidence + 0.14 * 0.85 + 0.14 + 0.1 + 0.14 * 0.58, abs=2e-6) and got["a"]["split"] == "train"
    assert got["b"]["suitability"] == 0.25 and got["b"]["final_score"] >= 0.72 and got["b"]["split"] == "review"  # its task doesn't allow the state
    assert got["c"]["state_change"] == 0.0 and got["c"]["segment_proximity"] == 0.0 and got["c"]["split"] == "exclude"


def test_export_trust(spark):
    rows = [("a", True, "raw_observation", 0.8, "high", 1.0), ("b", False, "raw_observation", 0.8, "high", 1.0), ("c", True, "weak_label", 0.3, "high", 1.0), ("d", True, "weak_label", 0.6, "medium", 0.9), ("e", True, "human_verified_label", 0.1, "low", 0.2), ("f", True, "raw_observation", 0.2, "high", 1.0)]
    got = {r["id"]: (r["export_split"], r["training_weight"]) for r in records.export_splits(spark.createDataFrame(rows, "id string, whole boolean, label_status string, confidence double, tier string, weight double")).collect()}
    assert got == {"a": ("accepted_records", 1.0), "b": ("quarantined_records", 1.0), "c": ("review_required_records", 1.0), "d": ("weak_label_records", 0.7), "e": ("accepted_records", 0.9), "f": ("review_required_records", 1.0)}


@pytest.mark.parametrize("path,seconds,expected", [("beats/amen_break_loop.wav", 6.5, "drum_break"), ("synth/hyper_synth_hit.wav", 0.6, "synth_one_shot"), ("misc/mystery_blob.wav", None, "unknown")])
def test_assets(spark, path, seconds, expected):
    name, _ = policies.asset_class(F.lit(path), F.lit(seconds).cast("double"))
    assert spark.range(1).select(name.alias("n")).first()["n"] == expected


def test_policies(spark):
    rows = [("splice", "x", "approved_for_training", False), ("user", "standard", "", False), ("user", "standard", "approved_for_training", True), ("user", "user_owned_training_candidate", "reviewed", False), ("user", "standard", "reviewed", False)]
    got = [r["status"] for r in policies.training_route(spark.createDataFrame(rows, "source_type string, source_policy string, authorization_status string, requires_human_review boolean")).collect()]
    assert got == ["block", "block", "allow_review_only", "allow_train", "allow_review_only"]


MOTIF = "motif_id string, pattern string, accents string, ratios array<double>, repeats int"


def test_lexicon_finds_its_own_patterns(spark):
    rows = [(name, tokens[0], accents, ratios[0], 4) for name, _, tokens, ratios, accents, _ in lexicon.PATTERNS]
    best = lexicon.family_matches(spark.createDataFrame(rows, MOTIF), k=1).collect()
    assert len(best) == len(rows) and all(r["token"] == 1.0 and r["confidence"] > 0.85 for r in best)
    alone = {r["motif_id"]: r["match"] for r in best}
    assert alone["tresillo_3_3_2"] == "tresillo_3_3_2" and alone["habanera"] == "habanera" and alone["son_clave_2_3"] == "clave"


def test_lexicon_by_hand(spark):
    rows = [("tresillo", "x..x..x.", "X..x..x.", [1.5, 1.5, 1.0], 4), ("turned", "x..x.x..", "", None, 1), ("full", "xxxxxxxx", "", [], 8), ("empty", None, None, None, 1), ("half", "x.x.x.x.", "X.X.X.X.", [2.0], 8)]
    got = {(r["motif_id"], r["rank"]): r for r in lexicon.family_matches(spark.createDataFrame(rows, MOTIF)).collect()}
    first = got["tresillo", 1]
    assert (first["family"], first["confidence"], first["reasons"], first["strength"]) == ("tresillo_3_3_2", 1.0, 0, "moderate") and first["ambiguity"] == 0.5  # the waltz has 0.94
    assert first["specificity"] == round(0.6 + 0.25 + 0.15 * (0.25 * 8 / 12 + 0.35 * 5 / 7 + 0.2 * 5 / 8 + 0.2 * 0.5), 6)
    turned = got["turned", 1]  # a rotation of the tresillo, but without its skeleton, and seen once
    assert (turned["family"], turned["token"], turned["reasons"], turned["confidence"]) == ("tresillo_3_3_2", 1.0, 1, round(0.6 * 0.85 * 0.93, 6))
    assert got["full", 1]["strength"] in ("weak", "ambiguous") and got["full", 1]["confidence"] < 0.3
    assert got["empty", 1]["confidence"] == 0.0 and got["empty", 1]["ambiguity"] == 1.0 and got["empty", 1]["match"] == "tresillo_3_3_2"
    march = [r for (m, _), r in got.items() if m == "half" and r["family"] == "march_duple"][0]
    assert (march["token"], march["accent"], march["ratio"]) == (1.0, 0.5, 0.0)


def midi_bytes():
    track = b"\x00\xff\x51\x03\x07\xa1\x20" + b"\x00\x90\x3c\x40" + b"\x83\x60\x80\x3c\x00" + b"\x00\x90\x40\x40" + b"\x83\x60\x40\x00" + b"\x00\xff\x2f\x00"
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, 480) + b"MTrk" + struct.pack(">I", len(track)) + track


def test_midi(spark, tmp_path):
    (tmp_path / "a.mid").write_bytes(midi_bytes())
    (tmp_path / "broken.mid").write_bytes(midi_bytes()[:40])
    (tmp_path / "other.mid").write_bytes(b"no midi")
    read = files.midi_seconds(files.midi_files(spark, str(tmp_path)))
    whole = read.where(F.col("path").endswith("a.mid") & (F.col("kind") != "tempo")).orderBy("seq").collect()
    assert [(r["kind"], r["a"], r["t"]) for r in whole] == [("on", 60, 0.0), ("off", 60, 0.5), ("on", 64, 0.5), ("off", 64, 1.0)]
    messages = read.where("kind <> 'tempo'").select(F.col("path").alias("perf"), "channel", F.col("a").alias("note"), "seq", "t", F.col("b").alias("vel"), F.when(F.col("kind") == "on", 1).otherwise(-1).alias("delta"))
    assert events.pair_on_off(messages.where(F.col("perf").endswith("a.mid"))).count() == 2


def test_json_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": "a", "n": 1}\nnot json\n\n[1]\n{"id": "b", "n": 2}\n')
    path, schema = str(tmp_path / "r.jsonl"), "id string, n int"
    assert sorted(r["id"] for r in files.json_lines(spark, path, schema).collect()) == ["a", "b"]
    assert tuple(files.json_lines_counted(spark, path, schema).first()) == (2, 2)
    files.write_json_lines(spark.createDataFrame([("c", 3)], schema), str(tmp_path / "out"), append=True)
    assert files.json_lines(spark, str(tmp_path / "out"), schema).count() == 1


def test_manifests_splits_and_logs(spark, tmp_path):
    for perf in ("p1", "p2"):
        (tmp_path / perf).mkdir()
        (tmp_path / perf / "export_manifest.json").write_text('{"n": 3}')
    got = files.manifests(spark, f"{tmp_path}/*/export_manifest.json", "n int", r"/([^/]+)/export_manifest\.json$", ["performance_id"])
    assert sorted(map(tuple, got.collect())) == [(3, "p1"), (3, "p2")]
    rows = spark.createDataFrame([("p", "train", 1), ("p", "review", 2), ("p", "train", 3)], "performance_id string, export_split string, x int")
    assert {(r["export_split"], r["n"]) for r in files.write_splits(rows, str(tmp_path / "splits")).collect()} == {("train", 2), ("review", 1)}
    log = spark.createDataFrame([("r", 1, "running"), ("r", 2, "done"), ("s", 1, "failed")], "run string, at int, status string")
    assert {(r["run"], r["status"], r["created"]) for r in files.latest_by_key(log, ["run"], "at").collect()} == {("r", "done", 1), ("s", "failed", 1)}
    text = files.report_lines(rows.groupBy("export_split").count(), "Splits", F.concat_ws(": ", "export_split", F.col("count").cast("string"))).first()["text"]
    assert text == "# Splits\n\nreview: 1\ntrain: 2"


def test_slug(spark):
    assert spark.range(1).select(slug(F.lit("__a b/c!!.wav_")).alias("s")).first()["s"] == "a_b_c_.wav"
