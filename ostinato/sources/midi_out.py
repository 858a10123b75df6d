"""Standard MIDI files as a sink: one file for each performance, written by tasks into a shared folder.

Order and delta ticks are relational; a task only turns one file's messages into bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TICKS_PER_BEAT, TEMPO = 480, 500_000


def messages(notes: DataFrame) -> DataFrame:
    """notes(perf, channel, note, vel, start, end) -> perf, t, is_on, channel, note, vel: both ends of each note.

    Notes that begin before 0, don't end after their start or have a negative pitch are left out; pitches and velocities are kept
    within what the format holds.
    """
    good = notes.where("start >= 0 and end > start and note >= 0")
    clamp = lambda c, low: F.least(F.lit(127), F.greatest(F.lit(low), F.col(c))).cast("int")
    ends = F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("is_on")), F.struct(F.col("end").alias("t"), F.lit(0).alias("is_on"))))
    return good.select("perf", F.pmod("channel", F.lit(16)).cast("int").alias("channel"), clamp("note", 0).alias("note"), clamp("vel", 1).alias("vel"), ends.alias("e")).select("perf", "e.t", "e.is_on", "channel", "note", "vel")


def with_delta(messages: DataFrame, ticks_per_beat: int = TICKS_PER_BEAT, tempo: int = TEMPO) -> DataFrame:
    """Adds ``delta``: ticks since the performance's message before; offs go before ons at the same time."""
    order = Window.partitionBy("perf").orderBy("t", "is_on", "channel", "note", "vel")
    before = F.coalesce(F.lag("t").over(order), F.lit(0.0))
    ticks = F.bround((F.col("t") - before) * ticks_per_beat * 1e6 / tempo).cast("long")
    return messages.withColumn("delta", ticks).withColumn("nth", F.row_number().over(order))


def variable_length(value: int) -> bytes:
    out = [value & 0x7F]
    while value := value >> 7:
        out.append(value & 0x7F | 0x80)
    return bytes(reversed(out))


def file_bytes(rows: Iterator[tuple[int, int, int, int, int]], ticks_per_beat: int = TICKS_PER_BEAT, tempo: int = TEMPO) -> bytes:
    """(delta, is_on, channel, note, vel) in order -> a file of one track."""
    track = bytearray(b"\x00\xff\x51\x03" + tempo.to_bytes(3, "big"))
    for delta, is_on, channel, note, vel in rows:
        track += variable_length(delta) + bytes([(0x90 if is_on else 0x80) | channel, note, vel if is_on else 0])
    track += b"\x00\xff\x2f\x00"
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, ticks_per_beat) + b"MTrk" + struct.pack(">I", len(track)) + bytes(track)


def write_midi(notes: DataFrame, folder: str, ticks_per_beat: int = TICKS_PER_BEAT, tempo: int = TEMPO) -> DataFrame:
    """Writes ``perf.mid`` for each performance into ``folder`` (a URI that all executors reach) -> perf, path, messages, bytes.

    Files are written under a name of their attempt and moved, so lost tasks leave no half of one. A performance is one file, so its
    messages are in one task: that is the format's own unit.
    """
    ordered = with_delta(messages(notes), ticks_per_beat, tempo).select("perf", "nth", "delta", "is_on", "channel", "note", "vel")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        files, root = fs.FileSystem.from_uri(folder)
        group = group.sort_values("nth")
        data = file_bytes(zip(*(group[c].tolist() for c in ("delta", "is_on", "channel", "note", "vel"))), ticks_per_beat, tempo)
        name = str(group["perf"].iloc[0])
        own = f"{root}/.{name}.{TaskContext.get().taskAttemptId()}"
        files.create_dir(root, recursive=True)
        with files.open_output_stream(own) as out:
            out.write(data)
        try:
            files.move(own, f"{root}/{name}.mid")
        except OSError:
            # An earlier attempt of the same task has written it; its content is the same.
            if files.get_file_info(f"{root}/{name}.mid").type != fs.FileType.File:
                raise
            files.delete_file(own)
        return pd.DataFrame({"perf": [name], "path": [f"{folder}/{name}.mid"], "messages": [len(group)], "bytes": [len(data)]})

    written = ordered.groupBy("perf").applyInPandas(run, "perf string, path string, messages long, bytes long")
    # Writing is an effect: it happens once, and the list of what was written lies beside the files.
    written.write.mode("overwrite").parquet(f"{folder}/_written")
    return written.sparkSession.read.schema(written.schema).parquet(f"{folder}/_written")
