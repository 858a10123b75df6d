"""Tags of records by the window that both name, their granularity and their time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ostinato.operators import intervals

#: Rows without a window share one key, apart from that of every named window.
NONE, NAMED = "-", "w"


def _keyed(rows: DataFrame) -> DataFrame:
    named = F.when(F.col("window_id").isNull(), NONE).otherwise(F.concat(F.lit(NAMED), F.col("window_id")))
    return rows.withColumn("key", F.concat_ws("|", F.coalesce("granularity", F.lit("")), named))


def _first(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("sure"), "seq"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= k)


def top_tags(records: DataFrame, tags: DataFrame, width: float, k: int = 5) -> DataFrame:
    """record, nth, tag, sure: the k surest tags of each record; ties go to the smaller seq, a tag may come twice.

    records(record, window_id, granularity, lo, hi); tags(seq, window_id, granularity, lo, hi, tag, sure), seq being unique. A tag is a record's
    if both name the same window, or none, and the same granularity, and their times overlap, ends included; without both times of
    either they count as overlapping. A null sureness is 0, a null granularity takes tags without one. Records without tags have no row.

    A record needs k rows of a key at most where times don't matter, so those are ranked by key first: a key that a third of all rows
    share costs no pairs. Timed rows meet by buckets of ``width`` seconds.
    """
    r, t = _keyed(records), _keyed(tags.withColumn("sure", F.coalesce("sure", F.lit(0.0))))
    timed = lambda d: d.where("lo is not null and hi is not null")
    untimed = lambda d: d.where("lo is null or hi is null")
    columns = ["record", "seq", "tag", "sure"]
    of_key = _first(t, ["key"], k).select("key", "seq", "tag", "sure")
    of_key_untimed = _first(untimed(t), ["key"], k).select("key", "seq", "tag", "sure")
    right = timed(t).select("key", F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi"), "seq", "tag", "sure")
    met = intervals.overlapping(timed(r).select("key", "lo", "hi", "record"), right, width, key="key").select(*columns)
    every = met.unionByName(timed(r).join(of_key_untimed, "key").select(*columns)).unionByName(untimed(r).join(of_key, "key").select(*columns))
    return _first(every, ["record"], k).select("record", "nth", "tag", "sure")
