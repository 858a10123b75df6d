"""Targets of examples as tokens: rhythm, pitch, contour and chord tokens of the first notes of a region, and their profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ostinato.functions.scalars import clamp01, round6

#: Notes and tokens that a target keeps, pitch classes it names, and the ladder of densities (notes a second, score).
NOTES, TOKENS, CLASSES, VARIETY, EDGE = 128, 128, 6, 32, 16
DENSITIES, DENSEST = [(0.08, 0.1), (0.25, 0.35), (1.0, 0.65), (4.0, 0.85)], 0.75
SHORTEST_NOTE, FULL_POLYPHONY = 1e-4, 7.0


def thousandths(x: Column) -> Column:
    """Three decimals as text, halves upwards."""
    return (F.floor(x * 1000 + 0.5) / 1000).cast("string")


def density_score(n: Column, seconds: Column) -> Column:
    rate = n / F.greatest(seconds, F.lit(1e-6))
    ladder = F.when((n <= 0) | (seconds <= 0), 0.0)
    for below, score in DENSITIES:
        ladder = ladder.when(rate < below, score)
    return ladder.otherwise(DENSEST)


def first_notes(located: DataFrame, key: list[str], order: list[str], most: int = NOTES) -> DataFrame:
    """The first ``most`` rows of each region: Spark drops the others before the shuffle, so a region is bounded however full it is."""
    return located.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_k") <= most)


def tokens(located: DataFrame, key: list[str], most: int = NOTES) -> DataFrame:
    """located(key, lo, hi, start, end, note, vel) -> key, n, the tokens as texts, and the profiles; of a region's first notes.

    ``lo`` and ``hi`` belong to the key. Notes in the order of start, channel, pitch and end. Regions without notes have no row.
    """
    kept = first_notes(located, [*key, "lo", "hi"], ["start", "channel", "note", "end"], most)
    listed = F.array_sort(F.collect_list(F.struct("_k", "start", "end", "note", "vel")))
    rows = kept.groupBy(*key, "lo", "hi").agg(listed.alias("x"))
    n, seconds = F.size("x"), F.greatest(F.lit(1e-6), F.col("hi") - F.col("lo"))
    before = lambda i: F.get("x", i - 1)
    on = lambda e: F.concat(F.lit("on_"), thousandths(F.greatest(F.lit(0.0), e["start"] - F.col("lo"))), F.lit("_dur_"), thousandths(F.greatest(F.lit(SHORTEST_NOTE), e["end"] - e["start"])))
    step = lambda e, i: F.concat(F.lit("ioi_"), thousandths(F.greatest(F.lit(0.0), e["start"] - before(i)["start"])))
    rhythm = F.flatten(F.transform("x", lambda e, i: F.when(i == 0, F.array(on(e))).otherwise(F.array(on(e), step(e, i)))))
    rows = rows.withColumn("_rhythm", rhythm)
    turn = lambda e, i: F.when(e["note"] > before(i)["note"], "up").when(e["note"] < before(i)["note"], "down").otherwise("same")
    contour = F.filter(F.transform("x", lambda e, i: F.when(i > 0, turn(e, i))), lambda c: c.isNotNull())
    classes = F.transform("x", lambda e: F.pmod(e["note"], F.lit(12)))
    counted = F.transform(F.array_distinct(classes), lambda pc: F.struct((-F.size(F.filter(classes, lambda c: c == pc))).alias("minus"), F.array_position(classes, pc).alias("at"), pc.alias("pc")))
    chord = F.transform(F.slice(F.array_sort(counted), 1, CLASSES), lambda c: F.concat(F.lit("pc"), c["pc"].cast("string")))
    pitches = F.transform("x", lambda e: F.concat(F.lit("n"), e["note"].cast("string")))
    vel = F.transform("x", lambda e: e["vel"])
    text = lambda tokens, most: F.array_join(F.slice(tokens, 1, most), " ")
    return rows.select(
        *key,
        n.alias("n"),
        text(F.col("_rhythm"), TOKENS).alias("rhythm_tokens"),
        text(pitches, TOKENS).alias("pitch_tokens"),
        text(contour, TOKENS).alias("contour_tokens"),
        F.array_join(chord, " ").alias("chord_tokens"),
        F.array_join(F.slice(pitches, 1, EDGE), " ").alias("first_notes"),
        F.array_join(F.slice(pitches, F.greatest(F.lit(1), n - EDGE + 1), EDGE), " ").alias("last_notes"),
        round6(F.aggregate(vel, F.lit(0).cast("long"), lambda s, v: s + v) / n).alias("vel_mean"),
        F.array_max(vel).alias("vel_max"),
        F.array_min(vel).alias("vel_min"),
        round6(clamp01(F.size(F.array_distinct(F.slice("_rhythm", 1, VARIETY))) / float(VARIETY))).alias("humanization"),
        round6(clamp01((n - 1) / F.size("_rhythm"))).alias("swing"),
        density_score(n, seconds).alias("density_score"),
        round6(clamp01(n / seconds / FULL_POLYPHONY)).alias("polyphony"),
    )
