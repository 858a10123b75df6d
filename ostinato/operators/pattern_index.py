"""What a performance's rhythm patterns come to: its leading groups, accents, families and the patterns that no family explains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many rows each list has, and from which repeats or information on a group is in it.
LENGTHS = {"top_groups": 10, "accents": 12, "dense_bursts": 10, "sparse_calls": 10, "families": 20, "unknown": 20}
LEAST_DENSE, LEAST_SPARSE, LEAST_UNKNOWN, LEAST_WEAK, LEAST_TAGGED = 4, 3, 8, 15, 10


def accent_counts(grid: DataFrame, shortest: int = 3, longest: int = 12) -> DataFrame:
    """perf, pattern, repeats, regions: accent texts of whole regions, and parts with two accents or more that a region repeats.

    grid(perf, idx, accents); null or empty accents give nothing. A region's text is at most 64 steps, so it has at most 600 parts.
    """
    known = grid.where(F.length("accents") > 0)
    whole = known.select("perf", "idx", F.col("accents").alias("pattern"), F.lit(1).cast("long").alias("n"))
    sizes = known.withColumn("size", F.explode(F.sequence(F.lit(shortest), F.lit(longest)))).where(F.col("size") <= F.length("accents"))
    parts = sizes.withColumn("place", F.explode(F.sequence(F.lit(1), F.length("accents") - F.col("size") + 1)))
    parts = parts.groupBy("perf", "idx", F.substr("accents", F.col("place"), F.col("size")).alias("pattern")).agg(F.count("*").alias("n"))
    parts = parts.where((F.col("n") >= 2) & (F.length(F.replace("pattern", F.lit("."), F.lit(""))) >= 2))
    both = whole.unionByName(parts)
    return both.groupBy("perf", "pattern").agg(F.sum("n").alias("repeats"), F.count_distinct("idx").alias("regions"))


def _information() -> Column:
    return F.col("repeats") + F.col("regions")


def lists(groups: DataFrame, accents: DataFrame) -> DataFrame:
    """perf, list, rank, pattern, repeats, regions, family, strength, confidence: the lists of LENGTHS of each performance.

    groups(perf, pattern, repeats, regions, family, match, strength, confidence): motif groups with their best known pattern; ``match`` is
    null where no family is clearly the nearest. accents(perf, pattern, repeats, regions). Groups go by repeats, then regions, families by
    strong before moderate and then confidence, unknown patterns by repeats and regions together; ties by the pattern. A row count is a
    limit of the report itself: Spark keeps no more than that of a list and performance before it exchanges them.
    """
    # Each group is a row for every list that it is in, with three numbers to order it by.
    n, regions, matched = F.col("repeats"), F.col("regions"), F.col("match").isNotNull()
    sure = matched & F.col("strength").isin("strong", "moderate")
    entry = lambda name, holds, *by: F.when(holds, F.struct(F.lit(name).alias("list"), *[b.cast("double").alias(f"by{i}") for i, b in enumerate(by)]))
    entries = F.array(
        entry("top_groups", F.lit(True), n, regions, F.lit(0)),
        entry("dense_bursts", F.contains("pattern", F.lit("x")) & (n >= LEAST_DENSE), n, regions, F.lit(0)),
        entry("sparse_calls", F.contains("pattern", F.lit(".")) & (n >= LEAST_SPARSE), n, regions, F.lit(0)),
        entry("families", sure, (F.col("strength") == "strong").cast("int"), F.col("confidence"), n),
        entry("unknown", ~matched & (_information() >= LEAST_UNKNOWN), _information(), n, regions),
    )
    shown = ["perf", "pattern", "repeats", "regions", "family", "strength", "confidence"]
    of_groups = groups.select(*shown, F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).select(*shown, "e.*")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("family", "string"), ("strength", "string"), ("confidence", "double"))]
    of_accents = accents.where("repeats >= 2").select("perf", "pattern", "repeats", "regions", *none, F.lit("accents").alias("list"), n.cast("double").alias("by0"), F.lit(0.0).alias("by1"), F.lit(0.0).alias("by2"))
    order = Window.partitionBy("perf", "list").orderBy(F.desc("by0"), F.desc("by1"), F.desc("by2"), "pattern")
    ranked = of_groups.unionByName(of_accents).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(LENGTHS.values()))
    length = F.coalesce(*[F.when(F.col("list") == name, F.lit(k)) for name, k in LENGTHS.items()])
    return ranked.where(F.col("rank") <= length).select("perf", "list", "rank", "pattern", "repeats", "regions", "family", "strength", "confidence")


def diagnostics(groups: DataFrame) -> DataFrame:
    """A row a performance: groups, those of onsets only, ambiguous ones, weak matches in spite of many repeats, repeats that may be tagged.

    groups as in ``lists``, with ``ambiguity``. A match may be tagged if it is strong, or moderate with enough information and little ambiguity.
    """
    matched, strength = F.col("match").isNotNull(), F.col("strength")
    taggable = matched & ((strength == "strong") | ((strength == "moderate") & (_information() >= LEAST_TAGGED) & (F.coalesce("ambiguity", F.lit(1.0)) <= 0.3)))
    return groups.groupBy("perf").agg(
        F.count("*").alias("groups"),
        F.count_if(F.col("pattern").rlike("^x+$")).alias("all_onset_groups"),
        F.count_if(~matched).alias("ambiguous_groups"),
        F.count_if(matched & ~strength.isin("strong", "moderate") & (_information() >= LEAST_WEAK)).alias("weak_high_frequency_groups"),
        F.coalesce(F.sum(F.when(taggable, F.col("repeats"))), F.lit(0).cast("long")).alias("taggable_repeats"),
    )
