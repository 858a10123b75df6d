"""MIDI files as a Spark data source, and what is made of their messages: intervals of notes and pitch bends.

    spark.dataSource.register(MidiSource)
    spark.read.format("midi").load("/shared/folder")

A partition is a bounded number of bytes of files; tasks read the files by their URIs, so the folder must be one that all executors reach.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ostinato.operators.events import pair_on_off
from ostinato.sources.files import midi_messages, midi_seconds

SCHEMA = "path string, ticks_per_beat int, track int, seq int, tick long, kind string, channel int, a int, b int"
PARTITION_BYTES = 32 << 20


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class MidiReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[Files]:
        """Whole files in order of their paths, PARTITION_BYTES together at most, a larger file alone: names and sizes are all the driver sees."""
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)
        parts, held = [], 0
        for info in sorted(files.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda i: i.path):
            if info.type == fs.FileType.File and info.path.endswith(".mid"):
                if not parts or held + info.size > self.partition_bytes:
                    parts.append([])
                    held = 0
                parts[-1].append(info.path)
                held += info.size
        return [Files(p) for p in parts] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        from pyarrow import fs

        files = fs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder else fs.LocalFileSystem()
        for path in partition.paths:
            with files.open_input_stream(path) as stream:
                data = stream.read()
            beat = struct.unpack(">H", data[12:14])[0] if len(data) >= 14 else 480
            for message in midi_messages(data):
                yield (path, beat, *message)


class MidiSource(DataSource):
    """Messages of the MIDI files below a folder: on, off, tempo, and bend (a: -8192 to 8191)."""

    @classmethod
    def name(cls) -> str:
        return "midi"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MidiReader:
        return MidiReader(self.options)


def midi_intervals(messages: DataFrame) -> DataFrame:
    """Messages -> perf, channel, note, vel, start, end in seconds under the tempo map: first on, first off in each channel and pitch."""
    timed = midi_seconds(messages).where("kind in ('on', 'off')")
    order = F.col("track") * F.lit(1 << 32) + F.col("seq")
    return pair_on_off(timed.select(F.col("path").alias("perf"), "channel", F.col("a").alias("note"), order.alias("seq"), "t", F.col("b").alias("vel"), F.when(F.col("kind") == "on", 1).otherwise(-1).alias("delta")))


def midi_bends(messages: DataFrame) -> DataFrame:
    """Messages -> perf, pitch: each bend's amount, and null for each note that begins; what ``selections.tuning_evidence`` looks at."""
    return messages.where("kind in ('bend', 'on')").select(F.col("path").alias("perf"), F.when(F.col("kind") == "bend", F.col("a")).alias("pitch"))
