"""Performances as tables: note events, windows, segments, bins and curves derived from the event stream.

One event type is one performance, an hour of the stream is one second of it; ``props.k`` is the note and ``value`` gives the
velocity. Regions are half of arithmetic, so they cost no scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DURATION, BIN, WINDOW, CONTEXT, SEGMENT = 720.0, 4.0, 60.0, 5.0, 24.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """perf, seq, t, note, vel, channel"""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("perf"),
        F.col("event_id").alias("seq"),
        (micros / F.lit(3.6e9)).alias("t"),
        F.get_json_object("props", "$.k").cast("int").alias("note"),
        (F.floor("value").cast("int") % 127 + 1).alias("vel"),
        F.col("user_id").alias("channel"),
    )


def performances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("perf")).distinct()


def tiled(perfs: DataFrame, width: float, kind: str, duration: float = DURATION) -> DataFrame:
    """perf, kind, idx, lo, hi: tumbling regions, the last one clipped."""
    n = int(-(-duration // width))
    idx = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tiles = perfs.select("perf", F.lit(kind).alias("kind"), idx.alias("idx"))
    return tiles.select("perf", "kind", "idx", (F.col("idx") * width).cast("double").alias("lo"), F.least(F.lit(duration), (F.col("idx") + 1) * width).alias("hi"))


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiled(performances(spark, sf_dir), BIN, "bin")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiled(performances(spark, sf_dir), SEGMENT, "segment")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with their context on both sides, clipped to the performance."""
    core = tiled(performances(spark, sf_dir), WINDOW, "window")
    return core.withColumn("ctx_lo", F.greatest(F.lit(0.0), F.col("lo") - CONTEXT)).withColumn("ctx_hi", F.least(F.lit(DURATION), F.col("hi") + CONTEXT))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of regions, in a fixed order: the whole performance, segments, windows, bins."""
    perfs = performances(spark, sf_dir)
    kinds = [("performance", DURATION), ("segment", SEGMENT), ("window", WINDOW), ("bin", BIN)]
    out = None
    for order, (kind, width) in enumerate(kinds):
        part = tiled(perfs, width, kind).withColumn("kind_order", F.lit(order))
        out = part if out is None else out.unionByName(part)
    return out


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """perf, frame, value: events in each second of the performance, gaps filled with zero."""
    frames = performances(spark, sf_dir).select("perf", F.explode(F.sequence(F.lit(0), F.lit(int(DURATION) - 1))).alias("frame"))
    counted = notes(spark, sf_dir).groupBy("perf", F.floor("t").cast("int").alias("frame")).agg(F.count("*").alias("n"))
    return frames.join(counted, ["perf", "frame"], "left").select("perf", "frame", F.coalesce("n", F.lit(0)).cast("double").alias("value"))


#: The same tables in SQL, for oracles.
NOTES_SQL = """notes as (
  select event_type as perf, event_id as seq, date_diff('microsecond', timestamp '2024-01-01', ts) / 3.6e9::double as t,
         json_extract_string(props, '$.k')::int as note, 1 + floor(value)::int % 127 as vel, user_id as channel
  from events)"""
PERFS_SQL = "perfs as (select distinct event_type as perf from events)"


def tiles_sql(name: str, width: float, kind: str, duration: float = DURATION) -> str:
    n = int(-(-duration // width))
    return f"""{name} as (
  select perf, '{kind}' as kind, i::int as idx, (i * {width})::double as lo, least({duration}, (i + 1) * {width})::double as hi
  from perfs, unnest(range(0, {n})) as r(i))"""


BINS_SQL, WINDOWS_SQL, SEGMENTS_SQL = tiles_sql("bins", BIN, "bin"), tiles_sql("windows", WINDOW, "window"), tiles_sql("segments", SEGMENT, "segment")
CURVE_SQL = f"""curve as (
  select p.perf, f.frame::int as frame, coalesce(n, 0)::double as value
  from perfs p cross join (select unnest(range(0, {int(DURATION)})) as frame) f
  left join (select perf, floor(t)::int as frame, count(*) as n from notes group by all) c on c.perf = p.perf and c.frame = f.frame)"""


def with_sql(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"
