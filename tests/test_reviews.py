"""Structural segments, nearest marks, witnesses and the MIDI sink on small cases."""

import random

from pyspark.sql import functions as F

from ostinato.operators import segmentation, witnesses
from ostinato.sources import files, midi_out


def walk(candidates, duration, target, shortest, longest, threshold):
    """The same cuts, one after the other."""
    good = sorted(c for c in candidates if c[3] and shortest <= c[0] <= duration - shortest and c[2] >= threshold)
    at, out = 0.0, []
    while at < duration:
        near = [c for c in good if at + shortest <= c[0] <= min(duration, at + longest)]
        if duration - at <= longest:
            end = duration
        elif near:
            end = max(near, key=lambda c: c[1] - abs(c[0] - (at + target)) / max(1.0, target))[0]
        else:
            end = min(duration, at + target)
        out.append((at, end))
        at = end
    return out


def test_structure_segments(spark):
    rng = random.Random(6)
    rows = [(p, float(rng.randrange(400)), rng.random(), rng.random(), rng.random() < 0.9) for p in "abc" for _ in range(30)] + [("none", 5.0, 0.1, 0.1, False)]
    df = spark.createDataFrame(rows, "perf string, t double, confidence double, tuned double, eligible boolean")
    got = segmentation.structure_segments(df, 400.0, 30.0, 12.0, 45.0, 0.4)
    for p in ["a", "b", "c", "none"]:
        own = [r[1:] for r in rows if r[0] == p]
        assert [(r["lo"], r["hi"]) for r in sorted(got.where(F.col("perf") == p).collect(), key=lambda r: r["idx"])] == walk(own, 400.0, 30.0, 12.0, 45.0, 0.4)
    kept = segmentation.candidate_evaluations(df, got, 400.0, 12.0, 45.0, 0.4)
    assert kept.count() == len(rows)
    assert segmentation.structure_segments(df.limit(0), 400.0, 30.0, 12.0, 45.0, 0.4).count() == 0


def test_nearest(spark):
    rng = random.Random(2)
    points = [(p, float(rng.randrange(50)), i) for i in range(60) for p in "ab"] + [("lonely", 1.0, 0)]
    marks = [(p, float(rng.randrange(50))) for p in "ab" for _ in range(5)]
    got = segmentation.nearest(spark.createDataFrame(points, "perf string, t double, i int"), spark.createDataFrame(marks, "perf string, t double")).collect()
    expected = {(p, i): min((abs(t - m) for q, m in marks if q == p), default=None) for p, t, i in points}
    assert {(r["perf"], r["i"]): r["distance"] for r in got} == expected and len(got) == len(points)


def test_consensus(spark):
    schema = "perf string, bpm double, key int, tags array<string>"
    a = spark.createDataFrame([("same", 100.0, 1, ["x"]), ("far", 100.0, 1, ["x"]), ("alone", 90.0, None, []), ("keyed", 90.0, 2, None)], schema)
    b = spark.createDataFrame([("same", 104.0, 1, ["x", "y"]), ("far", 120.0, 1, ["y"]), ("other", None, None, None)], schema)
    got = {r["perf"]: (r["status"], r["boosts"], r["penalties"]) for r in witnesses.consensus(a, b).collect()}
    assert got["same"] == ("supportive", ["semantic_tag_overlap", "tempo_alignment", "tonal_alignment"], [])
    assert got["far"] == ("conflicted", ["tonal_alignment"], ["semantic_tag_mismatch", "tempo_conflict"])
    assert got["alone"][0] == got["other"][0] == "monitor" and got["keyed"][0] == "conflicted"


def test_midi_goes_out_and_comes_back(spark, tmp_path):
    rng = random.Random(8)
    notes = [(p, rng.randrange(4), rng.randrange(128), rng.randrange(1, 128), at := rng.randrange(4000) / 960, at + rng.randrange(1, 900) / 960) for p in ("one", "two") for _ in range(40)]
    odd = [("one", 0, 60, 64, -1.0, 2.0), ("one", 0, 60, 64, 3.0, 3.0), ("one", 0, -5, 64, 0.0, 1.0)]
    df = spark.createDataFrame(notes + odd, "perf string, channel int, note int, vel int, start double, end double")
    written = {r["perf"]: r["messages"] for r in midi_out.write_midi(df, f"file://{tmp_path}").collect()}
    assert written == {"one": 80, "two": 80}
    back = files.midi_seconds(files.midi_files(spark, str(tmp_path))).where("kind = 'on'").collect()
    found = sorted((r["path"].rpartition("/")[2][:-4], r["channel"], r["a"], r["b"], round(r["t"], 2)) for r in back)
    plain = sorted((p, c, n, v, round(s, 2)) for p, c, n, v, s, _ in notes)
    assert [x[:4] for x in found] == [x[:4] for x in plain] and all(abs(x[4] - y[4]) < 0.05 for x, y in zip(found, plain))
