"""The MIDI data source with bends and intervals, and the walk over nested JSON."""

import struct

from ostinato.operators import selections
from ostinato.sources import files, json_walk, midi_out, midi_source


def track(*events):
    body = b"".join(midi_out.variable_length(d) + bytes(e) for d, e in events) + b"\x00\xff\x2f\x00"
    return b"MTrk" + struct.pack(">I", len(body)) + body


def test_midi_source(spark, tmp_path):
    tempo = track((0, [0xFF, 0x51, 3, 0x07, 0xA1, 0x20]), (960, [0xFF, 0x51, 3, 0x0F, 0x42, 0x40]))
    play = track((0, [0x90, 60, 100]), (480, [0xE0, 0, 0x50]), (0, [0x90, 60, 90]), (480, [0x80, 60, 0]), (480, [0x90, 60, 0]), (0, [0xE1, 0x7F, 0x3F]))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.mid").write_bytes(b"MThd" + struct.pack(">IHHH", 6, 1, 2, 480) + tempo + play)
    (tmp_path / "empty.mid").write_bytes(b"")
    (tmp_path / "b.txt").write_bytes(b"MThd")
    spark.dataSource.register(midi_source.MidiSource)
    for folder in (str(tmp_path), f"file://{tmp_path}"):
        read = spark.read.format("midi").option("partitionBytes", 10).load(folder)
        assert [f.name for f in read.schema] == [f.name for f in files.midi_files(spark, str(tmp_path)).schema]
        # First on, first off; the second tempo halves the speed from the second beat.
        assert sorted(tuple(r)[1:] for r in midi_source.midi_intervals(read).collect()) == [(0, 60, 90, 0.5, 2.0), (0, 60, 100, 0.0, 1.0)]
        assert sorted((r["channel"], r["a"]) for r in read.where("kind = 'bend'").collect()) == [(0, 2048), (1, -1)]
        told = selections.tuning_evidence(midi_source.midi_bends(read)).collect()
        assert [(r["bends"], r["evidence"], r["confidence"]) for r in told] == [(2, "pitch_bend", 0.37)]


def test_source_reads_what_the_sink_writes(spark, tmp_path):
    notes = [("p", 0, 60, 80, 0.0, 1.0), ("p", 1, 64, 70, 0.5, 0.75), ("q", 0, 60, 80, 1.0, 2.5)]
    midi_out.write_midi(spark.createDataFrame(notes, "perf string, channel int, note int, vel int, start double, end double"), f"file://{tmp_path}")
    spark.dataSource.register(midi_source.MidiSource)
    read = spark.read.format("midi").load(f"file://{tmp_path}")
    got = sorted((r["perf"].rpartition("/")[2][:-4], *tuple(r)[1:]) for r in midi_source.midi_intervals(read).collect())
    assert got == notes


def test_walk(spark):
    docs = ['{"k": 1, "a": {"k": [1, {"k": "x"}], "b": null}, "text": "\\"k\\": 5, {\\"k\\": 6}"}', "[[[{\"k\": true}]], 2]", "{", None, "3", "{}", '{"k": {"k": 3}}', '{"k": "quote \\" and } brace"}', '{"k": null}']
    table = spark.createDataFrame(list(enumerate(docs)), "id long, doc string")
    rows = json_walk.walk(table, "doc").collect()
    assert sorted((r["key"], r["kind"], r["value"], r["depth"]) for r in rows if r["id"] == 0 and r["key"]) == sorted([("k", "BIGINT", "1", 1), ("a", "OBJECT", None, 1), ("k", "ARRAY", None, 2), ("b", "VOID", None, 2), ("k", "STRING", "x", 4), ("text", "STRING", '"k": 5, {"k": 6}', 1)])
    assert {(r["policy"], r["n"]) for r in json_walk.counts_under(table, "doc", "k").collect()} == {("1", 1), ("x", 1), ("true", 1), ("3", 1), ('quote " and } brace', 1)}
    assert json_walk.walk(table.limit(0), "doc").collect() == []
