"""Matching of two runs' cuts, the step machine against a sequential version, target tokens and WAV files."""

import random
import struct
import wave
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ostinato.operators import boundaries, matching, targets
from ostinato.sources import wav_source
from ostinato.streaming import steps


def largest_matching(a, b, tolerance):
    """The largest number of pairs, tried out in full: augmenting paths."""
    partner = {}

    def try_one(i, seen):
        for j in range(len(b)):
            if abs(a[i] - b[j]) <= tolerance + 1e-9 and j not in seen:
                seen.add(j)
                if j not in partner or try_one(partner[j], seen):
                    partner[j] = i
                    return True
        return False

    return sum(try_one(i, set()) for i in range(len(a)))


def test_matching_is_one_to_one_and_largest(spark):
    rng = random.Random(4)
    runs = {(p, side): [round(rng.uniform(0, span), 1) for _ in range(n)] for p, span, n in [("dense", 30, 40), ("sparse", 5000, 60), ("long", 400, 150)] for side in (0, 1)}
    runs |= {("one", 0): [1.0, 2.0, 2.0], ("one", 1): [], ("twice", 0): [5.0, 5.0], ("twice", 1): [5.0, 5.0, 6.5]}
    frame = lambda side: spark.createDataFrame([(p, t) for (p, s), ts in runs.items() if s == side for t in ts] + [("null", None), (None, 1.0)], "perf string, t double")
    rows = matching.status(matching.one_to_one(frame(0), frame(1), 1.0)).collect()
    for p in {p for p, _ in runs}:
        mine = [r for r in rows if r["perf"] == p]
        for side, column in enumerate(("first", "second")):
            assert Counter(r[column] for r in mine if r[column] is not None) == Counter(runs[p, side])
        both = [r for r in mine if r["status"] == "both"]
        assert all(abs(r["first"] - r["second"]) <= 1.0 + 1e-9 for r in both)
        assert len(both) == largest_matching(runs[p, 0], runs[p, 1], 1.0)
    assert {r["perf"] for r in rows} == {p for p, _ in runs}
    assert matching.one_to_one(frame(0).limit(0), frame(1).limit(0), 1.0).collect() == []


def test_run_summary(spark):
    rows = [("p", 1.0, 0.5, "accepted"), ("p", 2.0, 0.9, "late"), ("p", 3.0, 0.9, "late"), ("p", 4.0, 0.7, "accepted"), ("q", 1.0, 0.1, "late")]
    got = matching.run_summary(spark.createDataFrame(rows, "perf string, t double, tuned double, reason string"), ["perf"]).collect()
    assert sorted(map(tuple, got)) == [("p", 4, "accepted:2,late:2", "2.0@0.9,3.0@0.9,4.0@0.7"), ("q", 1, "late:1", "1.0@0.1")]


def sequential(requests, tries, limit, until):
    """One performance after the other, row by row, with plain dictionaries."""
    out = []
    for perf in {r[0] for r in requests}:
        status, attempts, created, active = {}, Counter(), {}, None

        def overdue(now):
            nonlocal active
            if active and active[1] <= now:
                step, due = active
                active, status[step] = None, "failed"
                out.append((perf, -1, step, "failed", "time_limit", attempts[step], created[step], due))

        for _, seq, at, step, action in sorted((r for r in requests if r[0] == perf), key=lambda r: (r[2], r[1])):
            overdue(at)
            place = steps.STEPS.index(step) if step in steps.STEPS else None
            if place is None or action not in ("begin", "force", "success", "failure"):
                said = "refused", "unknown_request"
            elif action in ("success", "failure"):
                if active and active[0] == step:
                    active, status[step] = None, "success" if action == "success" else "failed"
                    said = status[step], None
                else:
                    said = "refused", "not_running"
            elif active:
                said = "refused", "busy"
            elif place > 0 and status.get(steps.STEPS[place - 1]) != "success":
                said = "refused", "earlier_step_open"
            elif action == "begin" and status.get(step) == "success":
                said = "refused", "already_done"
            elif action == "begin" and attempts[step] >= tries:
                said = "refused", "no_tries_left"
            else:
                attempts[step] += 1
                created.setdefault(step, at)
                active, status[step], said = (step, at + limit), "running", ("running", action)
            out.append((perf, seq, step, *said, attempts[step], created.get(step), at))
        overdue(until)
    return out


def test_step_machine_goes_on_after_a_restart(spark, tmp_path):
    rng, requests, at = random.Random(11), [], 1_700_000_000_000
    for seq in range(400):
        at += rng.choice([0, 1000, 20_000, 90_000])
        step = rng.choices([*steps.STEPS, "other"], [20, 14, 5, 3, 2, 1, 1])[0]
        requests.append((rng.choice("abcd"), seq, at, step, rng.choices(["begin", "force", "success", "failure", "odd"], [10, 1, 8, 4, 1])[0]))
    # The last row moves the watermark past every time limit.
    requests.append(("z", 400, at + 10_000_000, "analysis", "begin"))
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "perf string, seq long, ms long, step string, action string"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", steps.STORE)

    def feed(part):
        spark.createDataFrame(part, schema).coalesce(1).withColumn("ts", F.timestamp_millis("ms")).drop("ms").write.mode("append").parquet(source)

    def go_on():
        stream = spark.readStream.schema("perf string, seq long, step string, action string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
        log = steps.step_log(stream, tries=5, limit_ms=400_000, late="1 minute")
        query = log.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        assert query.awaitTermination(240)

    try:
        feed(requests[:150])
        go_on()
        feed(requests[150:])
        go_on()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    log = spark.read.parquet(sink)
    expected = sequential(requests, 5, 400_000, requests[-1][2] - 60_000)
    assert sorted(map(tuple, log.collect()), key=str) == sorted(expected, key=str)
    assert {r[3] for r in expected} == {"running", "success", "failed", "refused"} and any(r[4] == "time_limit" for r in expected)
    last = {}
    for r in sorted((r for r in expected if r[3] != "refused"), key=lambda r: (r[7], r[1])):
        last[r[0], r[2]] = (r[3], r[4], r[5], r[6], r[7])
    assert {(r["perf"], r["step"]): tuple(r)[2:] for r in steps.latest_steps(log).collect()} == last


def test_target_tokens_of_a_full_and_a_small_region(spark):
    notes = [(0, 1, 4.0, 8.0, 4.25, 4.5, 0, 60, 100), (0, 1, 4.0, 8.0, 4.75, 5.75, 0, 64, 50), (0, 1, 4.0, 8.0, 5.0, 5.00001, 0, 52, 60)]
    notes += [(0, 2, 8.0, 12.0, 8.0 + i / 256, 9.0 + i, 0, 60 + i % 13, 64) for i in range(900)]
    rows = {r["idx"]: r for r in targets.tokens(spark.createDataFrame(notes, "perf int, idx int, lo double, hi double, start double, end double, channel int, note int, vel int"), ["perf", "idx"]).collect()}
    one, full = rows[1], rows[2]
    assert one["rhythm_tokens"] == "on_0.25_dur_0.25 on_0.75_dur_1.0 ioi_0.5 on_1.0_dur_0.0 ioi_0.25"
    assert (one["pitch_tokens"], one["contour_tokens"], one["chord_tokens"]) == ("n60 n64 n52", "up down", "pc4 pc0")
    assert (one["vel_mean"], one["vel_max"], one["vel_min"], one["swing"], one["density_score"], one["polyphony"]) == (70.0, 100, 50, 0.4, 0.65, round(0.75 / 7, 6))
    assert full["n"] == 128 and [len(full[c].split()) for c in ("rhythm_tokens", "pitch_tokens", "contour_tokens", "chord_tokens", "first_notes")] == [128, 128, 127, 6, 16]
    assert full["last_notes"].split() == [f"n{60 + i % 13}" for i in range(112, 128)]


def write_wav(path, samples, channels, rate=8000):
    with wave.open(str(path), "wb") as out:
        out.setnchannels(channels)
        out.setsampwidth(2)
        out.setframerate(rate)
        out.writeframes(struct.pack(f"<{len(samples)}h", *samples))


def test_wav_frames(spark, tmp_path):
    rng = random.Random(2)
    plain = {"mono": [rng.randint(-32768, 32767) for _ in range(5001)], "stereo": [rng.randint(-32768, 32767) for _ in range(2 * 3000)], "none": []}
    for name, samples in plain.items():
        write_wav(tmp_path / f"{name}.wav", samples, 2 if name == "stereo" else 1)
    whole = (tmp_path / "mono.wav").read_bytes()
    # A chunk of odd length before the samples, and a last frame that is cut off.
    (tmp_path / "cut.WAV").write_bytes(whole[:36] + b"LIST" + struct.pack("<I", 3) + b"abc\0" + whole[36:44] + whole[44:1001])
    (tmp_path / "empty.wav").write_bytes(b"")
    (tmp_path / "text.wav").write_bytes(b"no sound in here")
    spark.dataSource.register(wav_source.WavSource)
    expected = {"mono.wav": [x / 32768 for x in plain["mono"]], "stereo.wav": [(a + b) / 2 / 32768 for a, b in zip(plain["stereo"][::2], plain["stereo"][1::2])], "cut.WAV": [x / 32768 for x in plain["mono"][:478]]}
    for folder, size in ((str(tmp_path), 777), (f"file://{tmp_path}", wav_source.RANGE_BYTES)):
        got = {}
        for r in spark.read.format("wav").option("rangeBytes", size).load(folder).orderBy("frame").collect():
            got.setdefault(r["path"].rpartition("/")[2], []).append(r["value"])
            assert r["rate"] == 8000 and r["frame"] == len(got[r["path"].rpartition("/")[2]]) - 1
        assert got == expected


def test_energy_of_a_recording_has_peaks(spark, tmp_path):
    loud = {3, 9}
    write_wav(tmp_path / "a.wav", [(20000 if i // 4000 in loud else 500) * (1 if i % 2 else -1) for i in range(12 * 4000)], 1)
    spark.dataSource.register(wav_source.WavSource)
    curve = wav_source.energy_curve(spark.read.format("wav").option("rangeBytes", 10_000).load(str(tmp_path)))
    assert {r["frame"]: round(r["value"] * 32768) for r in curve.collect()} == {i: 20000 if i in loud else 500 for i in range(12)}
    peaks = boundaries.local_peaks(boundaries.normalised(curve), 0.5)
    assert {r["frame"] for r in peaks.collect()} == loud


def test_wav_of_other_widths_is_an_error(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as out:
        out.setnchannels(1)
        out.setsampwidth(3)
        out.setframerate(8000)
        out.writeframes(b"abcabc")
    spark.dataSource.register(wav_source.WavSource)
    with pytest.raises(Exception, match="only 16-bit PCM"):
        spark.read.format("wav").load(str(tmp_path)).collect()
