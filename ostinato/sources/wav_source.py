"""WAV files of 16-bit samples as a Spark data source, and their energy as a curve.

    spark.dataSource.register(WavSource)
    spark.read.format("wav").load("/shared/folder")

A partition is a range of one file's bytes, so a long recording is many tasks. The driver sees names and sizes; every task reads the
file's header itself, takes the frames whose first byte lies in its range, and gives them on in batches of bounded size.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, rate int, frame long, value double"
RANGE_BYTES, BATCH_FRAMES = 32 << 20, 1 << 16

#: Sample formats of the container, plain and extensible, and full scale of 16 bits.
PCM, EXTENSIBLE, FULL_SCALE = 1, 0xFFFE, 32768.0


class Range(InputPartition):
    def __init__(self, path: str | None, lo: int = 0, hi: int = 0, size: int = 0):
        super().__init__((path, lo, hi))
        self.path, self.lo, self.hi, self.size = path, lo, hi, size


def opened(folder: str):
    """The file system of a folder, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def layout(stream, size: int) -> tuple[int, int, int, int] | None:
    """rate, channels, first byte and end of the samples; None where there are none. Other formats than 16-bit PCM are an error."""
    head = stream.read_at(12, 0) if size >= 12 else b""
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    at, sound = 12, None
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", stream.read_at(8, at))
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", stream.read_at(16, at + 8))
            if kind not in (PCM, EXTENSIBLE) or bits != 16 or not channels:
                raise ValueError(f"samples of {bits} bits in format {kind}: only 16-bit PCM is read")
            sound = rate, channels
        elif name == b"data" and sound:
            return *sound, at + 8, min(size, at + 8 + length)
        # Chunks are padded to even lengths.
        at += 8 + length + length % 2
    return None


class WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        files, root = opened(self.folder)
        found = sorted((i.path, i.size) for i in files.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File and i.path.lower().endswith(".wav"))
        return [Range(path, lo, min(size, lo + self.range_bytes), size) for path, size in found for lo in range(0, size, self.range_bytes)] or [Range(None)]

    def read(self, partition: Range) -> Iterator:
        import numpy as np
        import pyarrow as pa

        if partition.path is None:
            return
        with opened(self.folder)[0].open_input_file(partition.path) as stream:
            found = layout(stream, partition.size)
            if found is None:
                return
            rate, channels, start, end = found
            width = 2 * channels
            # The first frames that begin at or after the range's two ends; a last frame that is cut off is none.
            first, last = (min(max(0, -(-(edge - start) // width)), (end - start) // width) for edge in (partition.lo, partition.hi))
            for at in range(first, last, BATCH_FRAMES):
                n = min(BATCH_FRAMES, last - at)
                samples = np.frombuffer(stream.read_at(n * width, start + at * width), dtype="<i2").reshape(n, channels)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.path] * n, pa.string()), pa.array(np.full(n, rate, np.int32)), pa.array(np.arange(at, at + n, dtype=np.int64)), pa.array(samples.mean(axis=1) / FULL_SCALE)],
                    names=["path", "rate", "frame", "value"],
                )


class WavSource(DataSource):
    """Frames of the WAV files below a folder: the mean of the channels, from -1 to 1. Files without a header or samples have no rows."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)


def energy_curve(frames: DataFrame, hop: float = 0.5) -> DataFrame:
    """Frames -> perf, frame, value: the root of the mean square of each ``hop`` seconds; partly summed before the shuffle."""
    step = F.greatest(F.lit(1), F.round(F.col("rate") * F.lit(hop)).cast("int"))
    grouped = frames.groupBy(F.col("path").alias("perf"), F.floor(F.col("frame") / step).cast("int").alias("frame"))
    return grouped.agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("value"))
