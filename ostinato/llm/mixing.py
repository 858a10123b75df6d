"""Mixing sources to target weights, in DataFrame operations only.

Each document gets a hash-random key; within its source documents are sorted by it in ranges of the key, sizes are summed along
that order by a prefix sum in two steps (over ranges, then inside each range), and the source is cut at its exact budget: whole
passes over the source first, then the documents up to the budget, the last one in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ostinato.llm.common import WORD_PATTERN, cut, require

#: Rows of a source that one window sorts, about.
RANGE_ROWS = 1 << 14


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def random_key(*columns: Column) -> Column:
    """A random order that reruns, and other engines, agree on: the MD5 of the id as text."""
    return F.md5(F.concat_ws(":", F.lit("mix"), *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns]))


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """sizes(source, source_size) -> with target: ``share`` of all sizes by weight, none over ``most`` times its own size.

    Weights go round by code point order of the sources, null last. Excess is shared again by weight until none is above; that is
    one level for which the capped shares add up to the whole: sources are capped in the order of size for weight, so two running
    sums over the sources find it. The two windows hold one row per source.
    """
    nth = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weighed = sizes.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(nth, F.lit(len(weights)))))
    cap = F.lit(float(most)) * F.col("source_size")
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = (
        weighed.withColumn("cap", cap)
        .withColumn("whole", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("left", F.col("whole") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("weight_left"))
    )
    # A source is capped if at the level that those before it leave its share is above its cap; the first that isn't sets the level.
    free = F.col("level") * F.col("weight") <= F.col("cap")
    final = F.min(F.when(free, F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"]
    share_of = F.when(final.isNotNull(), F.least(F.col("cap"), final * F.col("weight"))).otherwise(F.col("cap"))
    return summed.select("source", "source_size", share_of.alias("target"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), *more)
    return sized.withColumn("key", random_key(F.col("doc_id")))


def _taken(own: DataFrame, rows: DataFrame, weights: list[float] | None, share: float, most: float) -> DataFrame:
    """``rows`` (doc_id, source, size, key and others) with source_size, target and taken; own: the same, without the others."""
    digits, n = 1, own.count()
    while n // 16**digits > RANGE_ROWS:
        digits += 1
    of = lambda df: df.withColumn("range", F.substring("key", 1, digits))
    ranges = of(own).groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    ranges = cut(ranges.withColumn("before", F.sum("range_size").over(Window.partitionBy("source").orderBy("range")) - F.col("range_size")), "ranges")
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights or [5.0, 2.0, 1.0], share, most)
    targets = targets.select(F.col("source").alias("target_source"), "source_size", "target")
    ranges = ranges.join(targets, ranges["source"].eqNullSafe(targets["target_source"])).select(F.col("source").alias("range_source"), F.col("range").alias("range_key"), "before", "source_size", "target")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = of(rows).withColumn("upto", F.sum("size").over(inside))
    joined = placed.join(ranges, placed["source"].eqNullSafe(ranges["range_source"]) & (placed["range"] == ranges["range_key"]))
    budget = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - passes * F.col("source_size")
    start = F.col("before") + F.col("upto") - F.col("size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - start))
    return joined.withColumn("taken", passes * F.col("size") + part)


def mix(docs: DataFrame, weights: list[float] | None = None, share: float = 1.0, most: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target (both its source's), taken (words that the mix takes of it).

    Each source's taken words are its target, rounded. Null texts and texts without words have size 0 and nothing taken. Null is a
    source of its own, the last. Ties in the random order (repeated ids) are broken by size; rows that are equal in both share what
    is taken in any order. Very long texts count whole. An empty table gives no rows, and sources without words take nothing. Other
    columns are not read.
    """
    require(docs, id_col, text_col, source_col)
    own = cut(_sized(docs, id_col, text_col, source_col), "sized")
    return _taken(own, own, weights, share, most).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: list[float] | None = None, share: float = 1.0, most: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each document as often as it is taken whole, and, where a budget ends inside it, once more in part.

    The columns are those of ``docs``. A part is the document's first words, joined by spaces. What the mix leaves out isn't in it,
    nor are documents without words. Nulls, ties and repeated rows as in :func:`mix`.
    """
    require(docs, id_col, text_col, source_col)
    rows = _sized(docs, id_col, text_col, source_col, F.struct(*docs.columns).alias("row"))
    taken = _taken(cut(_sized(docs, id_col, text_col, source_col), "sized"), rows, weights, share, most).where("taken > 0")
    whole, part = F.floor(F.col("taken") / F.col("size")).cast("int"), F.col("taken") % F.col("size")
    times = taken.select("row", whole.alias("whole"), part.cast("int").alias("part")).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("whole") + (F.col("part") > 0).cast("int"))))
    text = F.col("row")[text_col]
    first_words = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0)), F.lit(1), F.greatest("part", F.lit(1))), " ")
    return times.select(*[F.when(F.col("nth") <= F.col("whole"), text).otherwise(first_words).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
