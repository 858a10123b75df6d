"""A walk over JSON text of any depth, without regular expressions: level by level, a VARIANT exploded at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.sources import scratch


def walk(docs: DataFrame, json_col: str, most_levels: int = 64) -> DataFrame:
    """docs(id, <json_col>) -> (id, depth, key, pos, kind, value): every member of every object and every element of every array.

    ``key`` is null for elements, ``pos`` the place in the array or object; ``kind`` is OBJECT, ARRAY, or a scalar's type; ``value`` the text of a
    scalar, null for JSON null and for what has members. Text that is no JSON has no rows. Keys inside of strings are no keys. The rounds
    end with the deepest level there is; text nested deeper than ``most_levels`` is an error, not a shorter result.
    """
    spark = docs.sparkSession
    level = docs.select("id", F.try_parse_json(json_col).alias("v"), F.lit(0).alias("depth")).where("v is not null")
    out, depth = None, 0
    while True:
        found = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).alias("e")).select("id", (F.col("depth") + 1).alias("depth"), F.col("e.key").alias("key"), F.col("e.pos").alias("pos"), F.col("e.value").alias("v"))
        kind = F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)
        members = scratch.written(found.withColumn("kind", kind), "walk")
        nested = F.col("kind").isin("OBJECT", "ARRAY")
        rows = members.select("id", "depth", "key", "pos", "kind", F.when(~nested, F.try_variant_get("v", "$", "string")).alias("value"))
        out = rows if out is None else out.unionByName(rows)
        level, depth = members.where(nested).select("id", "v", "depth"), depth + 1
        if level.isEmpty():
            return out
        if depth >= most_levels:
            raise ValueError(f"JSON nested deeper than {most_levels} levels")


def counts_under(docs: DataFrame, json_col: str, key: str) -> DataFrame:
    """policy, n: how often each scalar stands under ``key``, at whatever depth; objects, arrays and null aren't policies."""
    return walk(docs, json_col).where((F.col("key") == key) & F.col("value").isNotNull()).groupBy(F.col("value").alias("policy")).agg(F.count("*").alias("n"))
