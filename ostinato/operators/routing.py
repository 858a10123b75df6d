"""What routing may have got wrong: labels that it rules out by state, harmonic regions that it doesn't call harmonic, chords held back in spite of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ostinato.functions.scalars import mean6
from ostinato.operators.records import routed

#: Harmonic states, the evidence that speaks for one of them, that from which a held-back chord label is suspect, and the report's length.
HARMONIC = ["harmonic_dominant", "polyphonic_full_mix", "melodic_lead"]
EVIDENCE, CLASSES, SUSPECT, LONGEST = 0.58, 5, 0.62, 100
CHORDS = "chord_movement"


def suppressed_by_state(routes: DataFrame) -> DataFrame:
    """perf, content_state, label, n: how often a state rules a label out. routes(perf, content_state); a state without a policy has that of unknown."""
    labels = F.explode(F.split(F.nullif("suppressed", F.lit("")), ","))
    return routed(routes).select("perf", "content_state", labels.alias("label")).groupBy("perf", "content_state", "label").agg(F.count("*").alias("n"))


def state_metrics(routes: DataFrame) -> DataFrame:
    """Means of density, pitch classes, chord confidence and simultaneous notes by state; null counts as 0, as a route without evidence has none."""
    mean = lambda c: mean6(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    return routes.groupBy("perf", "content_state").agg(F.count("*").alias("n"), mean("density").alias("mean_density"), mean("classes").alias("mean_classes"), mean("chord").alias("mean_chord"), mean("poly").alias("mean_poly"))


def suspects(routes: DataFrame) -> DataFrame:
    """perf, suspicion, rank, route_id, content_state, harmony, chord, classes: at most LONGEST routes of each suspicion and performance.

    routes(perf, route_id, kind_order, idx, content_state, harmony, chord, classes); null evidence is 0, a null state unknown. Routes with
    harmonic evidence come by harmony, chord and classes, highest first; held-back chords in order of routes. The length is the report's, and
    Spark keeps no more than that of a group before it exchanges rows.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    h, c, n = zero("harmony"), zero("chord"), zero("classes")
    state = F.coalesce("content_state", F.lit("unknown"))
    judged = routed(routes.withColumn("content_state", state))
    entry = lambda name, holds, by: F.when(holds, F.struct(F.lit(name).alias("suspicion"), *[x.cast("double").alias(f"by{i}") for i, x in enumerate(by)]))
    found = F.array(
        entry("harmonic_not_classified", ((h >= EVIDENCE) | (c >= EVIDENCE) | (n >= CLASSES)) & ~state.isin(*HARMONIC), [h, c, n]),
        entry("false_suppression", F.array_contains(F.split("suppressed", ","), CHORDS) & ((h >= SUSPECT) | (c >= SUSPECT)), [F.lit(0)] * 3),
    )
    rows = judged.select("perf", "route_id", "kind_order", "idx", "content_state", "harmony", "chord", "classes", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("s"))
    order = Window.partitionBy("perf", "s.suspicion").orderBy(F.desc("s.by0"), F.desc("s.by1"), F.desc("s.by2"), "kind_order", "idx", "route_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LONGEST).select("perf", "s.suspicion", "rank", "route_id", "content_state", "harmony", "chord", "classes")
