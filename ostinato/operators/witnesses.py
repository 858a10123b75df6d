"""What two witnesses of a performance say beside each other, and how far they agree; comparisons of iterations and of roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ostinato.functions.scalars import round6

#: Fixed value: tempos agree within so many beats a minute.
TEMPO_TOLERANCE = 8.0

#: The kinds of samples that a track role takes.
ROLE_KINDS = [
    ("bass", ["bass_one_shot"]),
    ("drums", ["drum_one_shot", "drum_break", "drum_loop"]),
    ("percussion", ["percussion_loop"]),
    ("harmony", ["chord_stab", "synth_one_shot"]),
    ("lead", ["synth_one_shot", "vocal_chop", "full_phrase"]),
    ("texture", ["texture", "drone", "field_recording"]),
    ("transition", ["riser", "fx"]),
]


def _named(*pairs: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(condition, name) for condition, name in pairs]), lambda x: x.isNotNull())


def consensus(internal: DataFrame, external: DataFrame, tolerance: float = TEMPO_TOLERANCE) -> DataFrame:
    """internal, external (perf, bpm, key, tags) -> per performance: delta_bpm, boosts and penalties (arrays), status.

    A side that is missing neither agrees nor disagrees on the tempo; one key alone is a conflict; without common tags there is a
    penalty but no disagreement. Any disagreement makes the status conflicted, else any agreement supportive, else monitor.
    """
    a, b = internal.alias("a"), external.alias("b")
    both = a.join(b, F.col("a.perf") == F.col("b.perf"), "full_outer").select(
        F.coalesce("a.perf", "b.perf").alias("perf"),
        round6(F.abs(F.col("a.bpm") - F.col("b.bpm"))).alias("delta_bpm"),
        F.coalesce(F.col("a.key") == F.col("b.key"), F.lit(False)).alias("same_key"),
        (F.col("a.key").isNotNull() | F.col("b.key").isNotNull()).alias("any_key"),
        F.coalesce(F.arrays_overlap("a.tags", "b.tags"), F.lit(False)).alias("same_tags"),
    )
    delta, same, tags = F.col("delta_bpm"), F.col("same_key"), F.col("same_tags")
    far, other_key = delta > tolerance, ~same & F.col("any_key")
    agrees = (delta <= tolerance) | same | tags
    return both.select(
        "perf",
        "delta_bpm",
        _named((tags, "semantic_tag_overlap"), (delta <= tolerance, "tempo_alignment"), (same, "tonal_alignment")).alias("boosts"),
        _named((~tags, "semantic_tag_mismatch"), (far, "tempo_conflict"), (other_key, "tonal_conflict")).alias("penalties"),
        F.when(far | other_key, "conflicted").when(agrees, "supportive").otherwise("monitor").alias("status"),
    )


def iteration_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """before, after (role, channel) -> per role: notes on both sides, their difference, and distinct channels after."""
    count = lambda df, n, c: df.groupBy("role").agg(F.count("*").alias(n), F.count_distinct("channel").alias(c))
    both = count(before, "notes_before", "channels_before").join(count(after, "notes_after", "channels_after"), "role", "full_outer")
    whole = both.na.fill(0, ["notes_before", "channels_before", "notes_after", "channels_after"])
    return whole.select("role", "notes_before", "notes_after", (F.col("notes_after") - F.col("notes_before")).alias("delta"), F.col("channels_after").alias("channels"))


def role_samples(samples: DataFrame, k: int = 5) -> DataFrame:
    """samples(sample_id, kind, confidence) -> the k best for each role that takes their kind; ties to the smaller id.

    Roles are a fixed short table, joined on the kind; Spark ranks within partitions before the shuffle.
    """
    takes = samples.sparkSession.createDataFrame([(kind, role) for role, kinds in ROLE_KINDS for kind in kinds], "kind string, role string")
    rank = F.row_number().over(Window.partitionBy("role").orderBy(F.desc("confidence"), "sample_id"))
    return samples.join(F.broadcast(takes), "kind").withColumn("rank", rank).where(F.col("rank") <= k).select("role", "rank", "sample_id", "kind", "confidence")
