"""Readers and writers of the workspace's files: lenient JSON lines, globbed manifests, MIDI, partitioned exports."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def json_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one a file; anything but an object is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that aren't objects of the schema are left out."""
    return _with_corrupt(spark, path, schema).where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def json_lines_counted(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row: rows and parse_errors of JSON lines."""
    lines = _with_corrupt(spark, path, schema)
    bad = F.col(CORRUPT).isNotNull()
    return lines.agg(F.count_if(~bad).alias("rows"), F.count_if(bad).alias("parse_errors"))


def _with_corrupt(spark: SparkSession, path: str, schema: str) -> DataFrame:
    full = T.StructType.fromDDL(schema).add(CORRUPT, "string")
    # Blank lines are no records; the text reader keeps the file a plain, splittable source.
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", full, {"columnNameOfCorruptRecord": CORRUPT}).alias("r"), "value")
    broken = F.when(F.col("r").isNull() | ~F.trim("value").startswith("{"), F.col("value")).otherwise(F.col(f"r.{CORRUPT}"))
    return parsed.select(*[F.col(f"r.{f.name}").alias(f.name) for f in full if f.name != CORRUPT], broken.alias(CORRUPT))


def manifests(spark: SparkSession, glob: str, schema: str, pattern: str, names: list[str]) -> DataFrame:
    """JSON documents of a glob with the parts of their path as columns: the groups of ``pattern`` by name."""
    read = json_object(spark, glob, schema).withColumn("_path", F.col("_metadata.file_path"))
    parts = [F.regexp_extract("_path", pattern, i + 1).alias(n) for i, n in enumerate(names)]
    return read.select("*", *parts).drop("_path")


def best_partition(candidates: DataFrame, wanted: Column, name: str = "name") -> DataFrame:
    """Of the candidates of each key: most tokens in common with ``wanted``, then the same beginning, then the shorter name."""
    tokens = lambda c: F.array_distinct(F.split(F.lower(c), "[^a-z0-9]+"))
    common = F.size(F.array_intersect(tokens(F.col(name)), tokens(wanted)))
    same = F.col(name).startswith(F.split(wanted, "_")[0]).cast("int")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc(common), F.desc(same), F.length(name), name))
    return candidates.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def file_index(spark: SparkSession, path: str, extensions: list[str]) -> DataFrame:
    """relative name, extension, length and SHA-256 of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.withColumn("extension", ext).where(F.col("extension").isin(extensions)).select(F.regexp_extract("path", "[^/]*$", 0).alias("filename"), "path", "extension", "length", F.sha2("content", 256).alias("sha256"))


def not_yet_ingested(found: DataFrame, manifests: DataFrame) -> DataFrame:
    return found.join(manifests.select(F.col("source_path").alias("path")), "path", "left_anti")


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A MIDI variable-length number and where it ends."""
    value = 0
    while True:
        byte = data[at]
        value, at = value << 7 | byte & 0x7F, at + 1
        if byte < 0x80:
            return value, at


def midi_messages(data: bytes) -> Iterator[tuple[int, int, int, str, int, int, int]]:
    """(track, seq, tick, kind, channel, a, b) of a standard MIDI file; kinds: on, off, tempo, bend (a: its amount). Broken files end where they break."""
    if data[:4] != b"MThd":
        return
    at, track = 8 + struct.unpack(">I", data[4:8])[0], 0
    seq = 0
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack(">I", data[at + 4 : at + 8])[0]
        at, end = at + 8, min(len(data), at + 8 + size)
        if kind == b"MTrk":
            tick, status, i = 0, 0, at
            try:
                while i < end:
                    delta, i = _number(data, i)
                    tick += delta
                    if data[i] & 0x80:
                        status, i = data[i], i + 1
                    if status == 0xFF:
                        meta = data[i]
                        length, i = _number(data, i + 1)
                        if meta == 0x51:
                            yield track, seq, tick, "tempo", 0, int.from_bytes(data[i : i + length], "big"), 0
                            seq += 1
                        i += length
                    elif status in (0xF0, 0xF7):
                        length, i = _number(data, i)
                        i += length
                    elif status >> 4 in (0xC, 0xD):
                        i += 1
                    else:
                        a, b, i = data[i], data[i + 1], i + 2
                        if status >> 4 in (0x8, 0x9):
                            yield track, seq, tick, "on" if status >> 4 == 9 and b else "off", status & 15, a, b
                            seq += 1
                        elif status >> 4 == 0xE:
                            yield track, seq, tick, "bend", status & 15, (a | b << 7) - 8192, 0
                            seq += 1
            except IndexError:
                pass
            track += 1
        at = end


def midi_files(spark: SparkSession, path: str) -> DataFrame:
    """path, ticks_per_beat, track, seq, tick, kind, channel, a, b: the messages of MIDI files below a folder.

    Parsing bytes is the only Python here; tempo and pairing are relational (see :func:`midi_seconds` and ``pair_on_off``).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.mid").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "ticks_per_beat", "track", "seq", "tick", "kind", "channel", "a", "b"]
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                beat = struct.unpack(">H", data[12:14])[0] if len(data) >= 14 else 480
                yield pd.DataFrame([(name, beat, *m) for m in midi_messages(data)], columns=names)

    return files.mapInPandas(run, "path string, ticks_per_beat int, track int, seq int, tick long, kind string, channel int, a int, b int")


def midi_seconds(messages: DataFrame) -> DataFrame:
    """Adds ``t``: seconds under the file's whole tempo map, all tracks together; 120 beats a minute until a tempo is set."""
    order = Window.partitionBy("path").orderBy("tick", F.when(F.col("kind") == "tempo", 0).otherwise(1), "track", "seq")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    tempo = F.coalesce(F.last(F.when(F.col("kind") == "tempo", F.col("a")), ignorenulls=True).over(upto), F.lit(500_000))
    step = (F.col("tick") - F.coalesce(F.lag("tick").over(order), F.lit(0))) * tempo / 1e6 / F.col("ticks_per_beat")
    stepped = messages.withColumn("_step", step)
    return stepped.withColumn("t", F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_splits(df: DataFrame, path: str, by: tuple[str, ...] = ("performance_id", "export_split")) -> DataFrame:
    """Writes rows into a folder for each split and gives the rows' counts, read back from what was written."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    return df.sparkSession.read.parquet(path).groupBy(*by).agg(F.count("*").alias("n"))


def report_lines(df: DataFrame, title: str, line: Column) -> DataFrame:
    """A Markdown report as one row of text: for tables that are short already, such as roll-ups."""
    listed = F.array_join(F.array_sort(F.collect_list(line)), "\n")
    return df.agg(F.concat(F.lit(f"# {title}\n\n"), listed).alias("text"))


def latest_by_key(log: DataFrame, key: list[str], order: str) -> DataFrame:
    """The present state from an append-only log: each key's last row, and when it was first there."""
    row = F.max_by(F.struct(*[c for c in log.columns if c not in key]), order)
    return log.groupBy(*key).agg(row.alias("_r"), F.min(order).alias("created")).select(*key, "_r.*", "created")
