"""Files of an inbox and what becomes of them; readers that no query uses."""

import datetime
import hashlib
import struct
import wave

import pytest
from pyspark.sql import functions as F

from ostinato.sources import files, ingest
from ostinato.streaming import live

NOW, LATER = datetime.datetime(2024, 5, 6, 7, 8, 9, 123), datetime.datetime(2024, 5, 7)


def recording(path, seconds, channels=2, rate=100):
    path.parent.mkdir(exist_ok=True)
    with wave.open(str(path), "wb") as out:
        out.setparams((channels, 2, rate, 0, "NONE", ""))
        out.writeframes(struct.pack("<h", 5) * int(seconds * rate) * channels)


def test_inbox_is_taken_in_once(spark, tmp_path):
    inbox, log = tmp_path / "in", str(tmp_path / "log")
    recording(inbox / "My song (1).wav", 1.5)
    recording(inbox / "My.song -1-.WAV", 0)
    (inbox / "broken.wav").write_bytes(b"RIFF")
    (inbox / "notes.txt").write_text("x")
    first = {r["source_name"]: r for r in ingest.ingest(spark, str(inbox), log, F.lit(NOW)).collect()}
    assert {n: (r["performance_id"], r["duration_seconds"]) for n, r in first.items()} == {
        "My song (1).wav": ("20240506T070809000123_My_song_1", 1.5),
        "My.song -1-.WAV": ("20240506T070809000123_My.song_-1-", 0.0),
        "broken.wav": ("20240506T070809000123_broken", None),
    }
    assert all(r["checksum"] == hashlib.sha256((inbox / n).read_bytes()).hexdigest() for n, r in first.items())
    song = first["My song (1).wav"]
    assert [(s["step"], s["status"]) for s in song["steps"]] == [(s, "pending") for s in ingest.STEPS]
    assert song["status"] == "ingested" and song["created_at"] == "2024-05-06T07:08:09.000123" and {song[p] for p in ingest.PATHS} == {None}
    assert ingest.ingest(spark, str(inbox), log, F.lit(LATER)).count() == 3
    recording(inbox / "new.wav", 2)
    assert {r["performance_id"] for r in ingest.ingest(spark, str(inbox), log, F.lit(LATER)).collect()} - {r["performance_id"] for r in first.values()} == {"20240507T000000000000_new"}


def test_manifests_of_equal_names_repeated_and_missing_paths(spark):
    found = spark.createDataFrame([("/b/x.wav", 1.0, "c"), ("/a/x.wav", None, None), ("/a/x.wav", None, None), ("/c/x.mp3", 2.0, "d"), (None, 1.0, "e"), ("/old", 1.0, "f"), ("/.hidden", 1.0, "g")], "path string, duration_seconds double, checksum string")
    known = spark.createDataFrame([("/old",), (None,)], "source_path string")
    got = {r["source_path"]: r["performance_id"][22:] for r in ingest.manifests(found, known, F.lit(NOW)).collect()}
    tail = lambda p: hashlib.sha256(p.encode()).hexdigest()[:8]
    assert got == {"/a/x.wav": "x", "/b/x.wav": "x_" + tail("/b/x.wav"), "/c/x.mp3": "x_" + tail("/c/x.mp3"), "/.hidden": ".hidden"}
    assert ingest.manifests(found.limit(0), known, F.lit(NOW)).collect() == []


def test_file_index(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.JSON").write_bytes(b"{}")
    (tmp_path / "b.txt").write_bytes(b"x")
    assert [tuple(r)[:1] + tuple(r)[2:] for r in files.file_index(spark, str(tmp_path), ["json"]).collect()] == [("a.JSON", "json", 2, hashlib.sha256(b"{}").hexdigest())]


def test_best_partition(spark):
    rows = [("k", "train_song_2020"), ("k", "song_train"), ("k", "train_song"), ("k", "other"), ("l", "zzz"), ("l", "yy")]
    best = files.best_partition(spark.createDataFrame(rows, "key string, name string"), F.lit("train_song"))
    assert {r["key"]: r["name"] for r in best.collect()} == {"k": "train_song", "l": "yy"}


def test_one_object_a_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"n":\n 1}')
    assert [r["n"] for r in files.json_object(spark, str(tmp_path), "n int").collect()] == [1]
    (tmp_path / "b.json").write_text("{broken")
    with pytest.raises(Exception):
        files.json_object(spark, str(tmp_path), "n int").collect()


def test_sessions_are_chains_of_small_gaps(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    minutes = [0, 60, 119, 238, 358, 479, 3000]
    rows = [(i, start + datetime.timedelta(minutes=m), 1, "p", 1.0, "{}") for i, m in enumerate(minutes)] + [(99, start + datetime.timedelta(days=30), 1, "q", 1.0, "{}")]
    spark.createDataFrame(rows, live.EVENTS).coalesce(1).write.parquet(str(tmp_path / "ev"))
    found = live.run_to_end(live.sessions(live.event_stream(spark, str(tmp_path / "ev"), name="*.parquet")), "chains", str(tmp_path / "check"))
    got = sorted((r["perf"], (r["start"] - start).total_seconds() / 60, (r["end"] - start).total_seconds() / 60, r["n"]) for r in found.collect())
    # A gap of 120 minutes still belongs to a chain, one of 121 ends it; the last event's chain stays open.
    assert got == [("p", 0.0, 478.0, 5), ("p", 479.0, 599.0, 1), ("p", 3000.0, 3120.0, 1)]
