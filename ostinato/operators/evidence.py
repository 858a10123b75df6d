"""Evidence of content at several granularities from one pass over the events.

A bin's events become a state that merges: counts, velocity moments, pitch classes, filled tiles, gaps inside, and the first and the last
event. States of bins next to each other meet at a seam, the gap from one's last event to the other's first; it belongs to a region if both
bins do. So segments, windows and whole performances are sums over bins and seams. Events are shuffled once, by bin; what follows
is one row a bin, pre-aggregated before it is shuffled, and a performance with a third of all events is as many tasks as it has bins.

Regions are half open here: an event on a common edge belongs to the later one, so that bins are disjoint and add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ostinato.functions.scalars import counts_of, pitch_class
from ostinato.operators import harmony, ordered
from ostinato.operators.records import rhythm_confidence

#: Events at most this far apart sound together; melodic moves are steps of so many semitones.
CLOSE, MOVE = 0.08, (1, 4)
#: Bins in a block when seams are looked up.
BLOCK = 1024


def _moves(step: Column) -> Column:
    return F.abs(step).between(*MOVE)


def bin_states(notes: DataFrame, width: float, duration: float, tile: float = 1.0) -> DataFrame:
    """notes(perf, seq, t, note, vel) -> one mergeable state for each bin with events: perf, bin and the state's columns.

    ``width`` must be a multiple of ``tile``, the unit of silence. Events outside 0 to ``duration``, or of no time, take no part; one at
    ``duration`` belongs to the last bin. Events without a note count, but have no pitch class and no step.
    """
    last = lambda w: F.lit(int(-(-duration // w)) - 1)
    own = notes.where(F.col("t").between(0, duration)).withColumn("bin", F.least(F.floor(F.col("t") / width), last(width)).cast("int"))
    inside = Window.partitionBy("perf", "bin").orderBy("t", "seq")
    gaps = own.withColumns({"gap": F.lead("t").over(inside) - F.col("t"), "step": F.lead("note").over(inside) - F.col("note")})
    event = F.struct("t", "note")
    at = F.struct("t", "seq")
    return gaps.groupBy("perf", "bin").agg(
        F.count("*").alias("n"),
        F.sum(F.col("vel").cast("long")).alias("vel_sum"),
        F.sum((F.col("vel") * F.col("vel")).cast("long")).alias("vel_squares"),
        F.min("note").alias("low"),
        F.array(*counts_of(pitch_class(F.col("note")), 12)).alias("h"),
        F.size(F.collect_set(F.least(F.floor(F.col("t") / tile), last(tile)))).alias("tiles"),  # at most width / tile
        F.count_if(F.col("gap") <= CLOSE).alias("close"),
        F.count_if(F.col("gap") > 0).alias("positive"),
        F.count_if(_moves(F.col("step"))).alias("moves"),
        F.count("step").alias("steps"),
        F.min_by(event, at).alias("first"),
        F.max_by(event, at).alias("last"),
    )


def rolled(states: DataFrame, kinds: list[tuple[str, float]], width: float, duration: float, tile: float = 1.0) -> DataFrame:
    """States of bins -> one row a region of each kind (name, width): perf, kind, kind_order, idx, lo, hi and the merged state.

    Each width is a multiple of the bins' or at least the whole duration. Regions without events have no row. ``changes`` counts the
    neighbouring bins with events of one region whose best triads differ; ``most`` is the largest bin's number of events.
    """
    for kind, w in kinds:
        if w < duration and abs(w / width - round(w / width)) > 1e-9:
            raise ValueError(f"{kind}: {w} is no multiple of the bins' {width}")
    chord = F.struct("root", "quality")
    bins = harmony.with_chord(states).withColumn("chord_of", chord)
    block = F.floor(F.col("bin") / BLOCK).cast("int")
    seams = ordered.neighbours(bins, ["perf"], block, ["bin"], {"first": "first", "bin": "bin", "chord": "chord_of"}, after=1)
    per = [int(round(w / width)) if w < duration else 1 << 30 for _, w in kinds]
    of = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("kind_order"), F.lit(float(w)).alias("wide"), F.floor(F.col("bin") / p).cast("int").alias("idx"), F.floor(F.col("bin_next1") / p).cast("int").alias("then")) for i, ((kind, w), p) in enumerate(zip(kinds, per))])
    member = seams.withColumn("r", F.explode(of)).withColumn("seam", F.coalesce(F.col("r.idx") == F.col("r.then"), F.lit(False)))
    gap, step = F.col("first_next1.t") - F.col("last.t"), F.col("first_next1.note") - F.col("last.note")
    plus = lambda c, also: F.sum(F.col(c) + (F.col("seam") & F.coalesce(also, F.lit(False))).cast("int")).alias(c)
    merged = member.groupBy("perf", "r.kind", "r.kind_order", "r.wide", "r.idx").agg(
        F.sum("n").alias("n"),
        F.max("n").alias("most"),
        F.sum("vel_sum").alias("vel_sum"),
        F.sum("vel_squares").alias("vel_squares"),
        F.min("low").alias("low"),
        F.array(*[F.sum(F.get("h", F.lit(i))) for i in range(12)]).alias("h"),
        F.sum("tiles").alias("tiles"),
        plus("close", gap <= CLOSE),
        plus("positive", gap > 0),
        plus("moves", _moves(step)),
        plus("steps", step.isNotNull()),
        F.count_if(F.col("seam") & (F.col("chord_next1") != F.col("chord_of"))).alias("changes"),
    )
    lo = F.col("idx") * F.col("wide")
    hi = F.least(F.lit(float(duration)), lo + F.col("wide"))
    return merged.withColumns({"lo": lo, "hi": hi, "all_tiles": F.ceil((hi - lo) / tile)}).drop("wide")


def evidence(regions: DataFrame, motif_notes: int = 16) -> DataFrame:
    """What the content scores look at, for each merged region; see ``records.content_scores``."""
    n = F.col("n")
    named = harmony.with_chord(regions)
    mean = F.col("vel_sum") / n
    return named.select(
        "perf",
        "kind",
        "kind_order",
        "idx",
        "lo",
        "hi",
        n.alias("notes"),
        (n / (F.col("hi") - F.col("lo"))).alias("density"),
        F.when(n > 1, F.col("close") / (n - 1)).otherwise(0.0).alias("poly"),
        ((F.col("all_tiles") - F.col("tiles")) / F.col("all_tiles")).alias("silence"),
        F.col("confidence").alias("chord"),
        F.size("active").alias("classes"),
        F.col("changes").cast("double").alias("activity"),
        F.coalesce(F.try_divide("moves", "steps"), F.lit(0.0)).alias("movement"),
        (F.col("most") >= motif_notes).alias("motif"),
        rhythm_confidence(n, F.col("positive").cast("double")).alias("confidence"),
        (F.col("hi") - F.col("lo")).alias("seconds"),
        mean.alias("vel_mean"),
        F.sqrt(F.greatest(F.lit(0.0), F.col("vel_squares") / n - mean * mean)).alias("vel_std"),
    )
