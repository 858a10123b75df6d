"""The batch operators' twins on streams: tumbling rhythm, live note pairing, sessions of boundaries, bounded work."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The event stream's schema, as its files have it.
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1, name: str = "events.parquet") -> DataFrame:
    """Files of events as they come; ``files_per_trigger`` is the budget of one step. Times are UTC."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", name).parquet(folder)
    utc = F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts))")
    return raw.withColumn("ts", utc)


def tumbling_rhythm(events: DataFrame, width: str = "4 hours", late: str = "1 day") -> DataFrame:
    """Counts and mean velocity of each performance in each window; rows later than ``late`` are left out."""
    vel = F.floor("value").cast("int") % 127 + 1
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), F.col("event_type").alias("perf")).agg(F.count("*").alias("n"), F.avg(vel).alias("vel")).select("perf", F.col("window.start").alias("start"), "n", "vel")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Chains of events whose gaps don't exceed ``gap``: the streaming form of fusing near duplicates."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), F.col("event_type").alias("perf")).agg(F.count("*").alias("n")).select("perf", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def without_duplicates(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events that overlapping windows bring twice count once, as long as they come within ``late``."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def live_pairs(events: DataFrame) -> DataFrame:
    """channel, note, start, end as notes end: first on, first off, with the open ons as state of each channel and note."""
    on = F.col("event_type").isin("click", "view", "signup")
    rows = events.select(F.col("user_id").alias("channel"), (F.get_json_object("props", "$.k").cast("int") % 4).alias("note"), F.col("event_id").alias("seq"), F.col("ts").cast("double").alias("t"), F.when(on, 1).otherwise(-1).alias("delta"))

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        open_ons = list(state.get[0]) if state.exists else []
        rows, out = pd.concat(list(batches)).sort_values(["t", "seq"]), []
        for t, delta in zip(rows["t"], rows["delta"]):
            if delta > 0:
                open_ons.append(float(t))
            elif open_ons:
                out.append((key[0], key[1], open_ons.pop(0), float(t)))
        state.update((open_ons,))
        yield pd.DataFrame(out, columns=["channel", "note", "start", "end"])

    return rows.groupBy("channel", "note").applyInPandasWithState(step, "channel long, note int, start double, end double", "open array<double>", "append", "NoTimeout")


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, step by step, into a table in memory; for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
