"""Recordings of an inbox as manifests: which are new, how long they are, their checksums, an id, and the steps that lie ahead."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.functions.scalars import slug
from ostinato.sources import files, scratch, wav_source

#: Steps of a new performance, and the paths that they will fill.
STEPS = ["analysis", "segmentation", "transcription", "benchmark", "review", "stitch"]
PATHS = ["analysis_path", "segments_manifest_path", "merged_midi_path", "active_analysis_path", "active_segments_manifest_path", "active_merged_midi_path"]
CHUNK = 8 << 20


def listed(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """path, length, modified of the files below a folder that have one of the extensions; their bytes aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    return found.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(extensions))


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, length in zip(batch["path"], batch["length"]):
            # Spark writes local paths with one slash or three.
            system, name = wav_source.opened(re.sub(r"^file:/+", "/", path))
            digest = hashlib.sha256()
            with system.open_input_file(name) as stream:
                try:
                    found = wav_source.layout(stream, length)
                except ValueError:
                    found = None
                seconds = (found[3] - found[2]) // (2 * found[1]) / found[0] if found and found[0] else None
                stream.seek(0)
                while block := stream.read(CHUNK):
                    digest.update(block)
            yield pd.DataFrame({"path": [path], "duration_seconds": [seconds], "checksum": [digest.hexdigest()]})


def measured(found: DataFrame) -> DataFrame:
    """path, duration_seconds, checksum of listed files: each is read once, in pieces of 8 MB, by a task; files of other kinds than 16-bit WAV have no duration."""
    return found.select("path", "length").mapInPandas(_measured, "path string, duration_seconds double, checksum string")


def manifests(found: DataFrame, known: DataFrame, now: Column) -> DataFrame:
    """A manifest for each path of found(path, duration_seconds, checksum) that known(source_path) doesn't have.

    ``now`` is the time of the run. An id is that time and the name without its ending; where several new paths share it, all but the first
    in order of paths get the beginning of their path's hash behind it. A path counts once, rows without one are left out. ``found`` is evaluated twice.
    """
    new = files.not_yet_ingested(found.where("path is not null").dropDuplicates(["path"]), known)
    name = F.regexp_extract("path", "[^/]*$", 0)
    stem = slug(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))
    new = new.withColumn("_stem", stem)
    # A name that a third of all paths have is one row here, and the join's large side may be split.
    first = new.groupBy("_stem").agg(F.min("path").alias("_first"))
    ident = F.concat_ws("_", F.date_format(now, "yyyyMMdd'T'HHmmssSSSSSS"), "_stem", F.when(F.col("path") != F.col("_first"), F.substring(F.sha2("path", 256), 1, 8)))
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    steps = F.array(*[F.struct(F.lit(s).alias("step"), F.lit("pending").alias("status"), stamp.alias("updated_at")) for s in STEPS])
    return new.join(first, "_stem").select(
        ident.alias("performance_id"), F.col("path").alias("source_path"), name.alias("source_name"), F.round("duration_seconds", 6).alias("duration_seconds"), "checksum",
        stamp.alias("created_at"), F.lit("ingested").alias("status"), *[F.lit(None).cast("string").alias(p) for p in PATHS], steps.alias("steps"),
    )


def ingest(spark: SparkSession, inbox: str, log: str, now: Column, extensions: tuple[str, ...] = ("wav",)) -> DataFrame:
    """Appends manifests of new recordings to the log and gives the log. A run that is repeated adds nothing.

    The log is Parquet in a shared folder, which may not be there yet. What was read from the files is written first, so they are read once.
    """
    schema = manifests(spark.createDataFrame([], "path string, duration_seconds double, checksum string"), spark.createDataFrame([], "source_path string"), now).schema
    # An empty append makes the folder, so that the log can be read before anything is in it.
    spark.createDataFrame([], schema).write.mode("append").parquet(log)
    known = spark.read.schema(schema).parquet(log).select("source_path")
    fresh = listed(spark, inbox, list(extensions)).join(known, F.col("path") == F.col("source_path"), "left_anti")
    manifests(scratch.written(measured(fresh), "measured"), known, now).write.mode("append").parquet(log)
    return spark.read.schema(schema).parquet(log)
