"""Harmony of regions: pitch-class histograms, keys, chords, root motion, pedals, pitch slices and sonorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ostinato.functions.scalars import counts_of, joined, mean6, pitch_class, pitch_class_name, round6
from ostinato.operators import ordered

REGION = ["perf", "kind", "idx"]
#: The chord kinds in the order in which they are tried, with their intervals over the root.
CHORDS = [("major", (0, 4, 7)), ("minor", (0, 3, 7)), ("suspended_or_open", (0, 5, 7))]


def pitch_counts(in_regions: DataFrame) -> DataFrame:
    """REGION, pc, n: one row for each pitch class that a region has."""
    return in_regions.groupBy(*REGION, pitch_class(F.col("note")).alias("pc")).agg(F.count("*").alias("n"))


def key_candidates(counts: DataFrame, k: int = 3) -> DataFrame:
    """The k most frequent pitch classes of each region, ties to the lower; classes that don't occur follow with score 0."""
    every = counts.select(*REGION).distinct().withColumn("pc", F.explode(F.sequence(F.lit(0), F.lit(11))))
    filled = every.join(counts, [*REGION, "pc"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(*REGION))
    rank = F.row_number().over(Window.partitionBy(*REGION).orderBy(F.desc("n"), "pc"))
    ranked = filled.withColumn("score", round6(F.col("n") / F.greatest(F.lit(1), total))).withColumn("rank", rank)
    return ranked.where(F.col("rank") <= k).select(*REGION, "rank", pitch_class_name(F.col("pc")).alias("key"), "score")


def _sum_over(hist: Column, root: int, steps: tuple[int, ...]) -> Column:
    return sum((F.get(hist, F.lit((root + s) % 12)) for s in steps[1:]), F.get(hist, F.lit(root)))


def with_chord(regions: DataFrame) -> DataFrame:
    """Adds quality, root, confidence, bass and active classes to rows with ``h`` (counts of 12 classes), ``low`` and ``n``.

    The best of 36 triads by covered notes; a tie goes to the lower root and, within a root, to the chord that is tried first.
    """
    tried = F.array(*[F.struct(_sum_over(F.col("h"), r, steps).alias("score"), F.lit(-r).alias("r"), F.lit(-i).alias("i")) for r in range(12) for i, (_, steps) in enumerate(CHORDS)])
    best = regions.withColumn("_b", F.array_max(tried))
    kind = F.get(F.array(*[F.lit(k) for k, _ in CHORDS]), -F.col("_b.i"))
    active = F.filter(F.sequence(F.lit(0), F.lit(11)), lambda i: F.get(F.col("h"), i) > 0)
    return best.withColumns({"quality": kind, "root": -F.col("_b.r"), "confidence": round6(F.col("_b.score") / F.col("n")), "bass": pitch_class(F.col("low")), "active": active}).drop("_b")


def chords(in_bins: DataFrame) -> DataFrame:
    """One row per bin with events: chord, root, confidence, bass and active classes; see :func:`with_chord`."""
    hist = F.array(*[F.count_if(pitch_class(F.col("note")) == i) for i in range(12)])
    base = in_bins.groupBy(*REGION, "lo", "hi").agg(hist.alias("h"), F.min("note").alias("low"), F.count("*").alias("n"))
    return with_chord(base).select(*REGION, "lo", "hi", "quality", "root", "confidence", "bass", "active", "n")


def root_motion(timeline: DataFrame, part: Column) -> DataFrame:
    """perf, part: chord changes and shares of kinds of root motion over the bins of each part of a performance."""
    order = Window.partitionBy("perf", "part").orderBy("idx")
    moved = timeline.withColumn("part", part).withColumn("step", F.pmod(F.lead("root").over(order) - F.col("root"), F.lit(12)))
    of = lambda *values: round6(F.count_if(F.col("step").isin(*values)) / F.greatest(F.lit(1), F.count("step")))
    return moved.groupBy("perf", "part").agg(
        F.count("*").alias("chords"),
        F.count_if(F.col("step") != 0).alias("changes"),
        of(0).alias("repeated"),
        of(1, 11).alias("chromatic"),
        of(1, 2, 10, 11).alias("stepwise"),
        of(5, 7).alias("circle"),
        joined(F.transform(F.array_sort(F.collect_list(F.when(F.col("step").isNotNull(), F.struct("idx", "step")))), lambda x: x["step"].cast("string"))).alias("intervals"),
    )


def pedal_tones(timeline: DataFrame, part: Column, least: float = 0.5) -> DataFrame:
    """The bass class that at least half of a part's bins have."""
    basses = timeline.withColumn("part", part).groupBy("perf", "part", "bass").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("perf", "part"))
    rank = F.row_number().over(Window.partitionBy("perf", "part").orderBy(F.desc("n"), "bass"))
    ranked = basses.withColumn("dominance", round6(F.col("n") / total)).withColumn("rank", rank)
    return ranked.where((F.col("rank") == 1) & (F.col("dominance") >= least)).select("perf", "part", "bass", "dominance")


def motion_regions(motion: DataFrame, vamps: int = 20, listed: int = 10) -> DataFrame:
    """``root_motion`` -> perf, listing, rank, part, changes, repeated: vamps (at least half of the moves stay) in order of time, and the
    parts that change least ('static') and most ('active'), ties in order of time. The numbers listed are the operator's own limits."""
    by = lambda *order: F.row_number().over(Window.partitionBy("perf").orderBy(*order))
    lists = [("vamp", motion.where("repeated >= 0.5"), by("part"), vamps), ("static", motion, by("changes", "part"), listed), ("active", motion, by(F.desc("changes"), "part"), listed)]
    parts = [rows.withColumn("rank", rank).where(F.col("rank") <= most).select("perf", F.lit(name).alias("listing"), "rank", "part", "changes", "repeated") for name, rows, rank, most in lists]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def root_sequences(motion: DataFrame, size: int = 4, least: int = 2, k: int = 12) -> DataFrame:
    """perf, rank, sequence, n: the first ``size`` root intervals of each part, where ``least`` parts or more begin alike; ties: the earliest."""
    first = F.slice(F.split("intervals", " "), 1, size)
    keyed = motion.where("intervals <> ''").groupBy("perf", F.array_join(first, "-").alias("sequence")).agg(F.count("*").alias("n"), F.min("part").alias("first"))
    rank = F.row_number().over(Window.partitionBy("perf").orderBy(F.desc("n"), "first", "sequence"))
    return keyed.where(F.col("n") >= least).withColumn("rank", rank).where(F.col("rank") <= k).select("perf", "rank", "sequence", "n")


def common_intervals(motion: DataFrame, k: int = 5) -> DataFrame:
    """perf, rank, step, n: the root intervals that a performance's parts have most, ties as first seen."""
    steps = motion.where("intervals <> ''").select("perf", "part", F.posexplode(F.split("intervals", " ")).alias("at", "step"))
    counted = steps.groupBy("perf", F.col("step").cast("int").alias("step")).agg(F.count("*").alias("n"), F.min(F.struct("part", "at")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("perf").orderBy(F.desc("n"), "first"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= k).select("perf", "rank", "step", "n")


#: Bins in a block when runs are looked for.
RUN_BLOCK = 1024


def chord_runs(timeline: DataFrame) -> DataFrame:
    """perf, run, first, last, bins, root, quality, lo, hi: stretches of consecutive bins with one chord (gaps and islands, block by block).

    A bin without events ends a run. Runs are numbered from 1 in order of time.
    """
    block = F.floor(F.col("idx") / RUN_BLOCK).cast("int")
    own = timeline.select("perf", "idx", "lo", "hi", "root", "quality", F.struct("idx", "root", "quality").alias("at"))
    beside = ordered.neighbours(own, ["perf"], block, ["idx"], {"at": "at"}, before=1, after=0)
    goes_on = (F.col("at_prev1.idx") == F.col("idx") - 1) & (F.col("at_prev1.root") == F.col("root")) & (F.col("at_prev1.quality") == F.col("quality"))
    marked = beside.withColumn("new", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    numbered = ordered.running_sum(marked, ["perf"], block, ["idx"], "new", "run")
    return numbered.groupBy("perf", "run", "root", "quality").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("bins"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def motion_index(timeline: DataFrame, size: int = 4, k: int = 12) -> DataFrame:
    """The k most frequent runs of ``size`` roots in each performance that occur twice or more, ties as first met."""
    order = Window.partitionBy("perf").orderBy("idx")
    ahead = [F.lead("root", i).over(order) for i in range(size)]
    grams = timeline.select("perf", "idx", F.array(*ahead).alias("g")).where(F.forall("g", lambda x: x.isNotNull()))
    counted = grams.groupBy("perf", F.array_join(F.transform("g", lambda r: pitch_class_name(r)), "-").alias("roots")).agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    rank = F.row_number().over(Window.partitionBy("perf").orderBy(F.desc("n"), "first"))
    return counted.where("n >= 2").withColumn("rank", rank).where(F.col("rank") <= k).select("perf", "rank", "roots", "n")


def pitch_slices(in_regions: DataFrame, contour: int = 64) -> DataFrame:
    """Melodic intervals of each region: steps, leaps, contour, register and span."""
    order = Window.partitionBy(*REGION).orderBy("t", "seq")
    moved = in_regions.withColumn("step", F.lead("note").over(order) - F.col("note")).withColumn("nth", F.row_number().over(order))
    size, n = F.abs("step"), F.greatest(F.lit(1), F.count("step"))
    shape = F.when(F.col("step") > 0, "U").when(F.col("step") < 0, "D").otherwise("S")
    letters = F.array_sort(F.collect_list(F.when(F.col("step").isNotNull() & (F.col("nth") <= contour), F.struct("nth", shape.alias("c")))))
    return moved.groupBy(*REGION).agg(
        F.count("*").alias("n"),
        F.min("note").alias("lowest"),
        F.max("note").alias("highest"),
        round6(F.avg("note")).alias("mean_note"),
        round6(F.count_if((size > 0) & (size <= 2)) / n).alias("step_share"),
        round6(F.count_if(size > 2) / n).alias("leap_share"),
        round6(F.count_if(F.pmod(size, F.lit(12)).isin(5, 7)) / n).alias("fourth_fifth_share"),
        round6(F.count_if(F.pmod(size, F.lit(12)) == 6) / n).alias("tritone_share"),
        round6(F.count_if(size == 1) / n).alias("chromatic_share"),
        F.array_join(F.transform(letters, lambda x: x["c"]), "").alias("contour"),
    )


def sonority_kind(active: Column) -> Column:
    """What kind of sound sorted pitch classes make; a cluster has five classes or more and two within a whole tone."""
    size = F.size(active)
    has = lambda *steps: F.exists(active, lambda r: F.forall(F.array(*[F.lit(s) for s in steps]), lambda s: F.array_contains(active, F.pmod(r + s, F.lit(12)))))
    near = F.exists(F.zip_with(F.slice(active, 1, size - 1), F.slice(active, 2, size - 1), lambda x, y: y - x), lambda d: d <= 2)
    return (
        F.when(size <= 1, "single_pitch_or_drone_candidate")
        .when((size >= 5) & near, "cluster_sonority_candidate")
        .when(has(0, 4, 7) | has(0, 3, 7), "triadic_sonority_candidate")
        .when(has(0, 5, 10), "quartal_sonority_candidate")
        .when(size >= 6, "extended_or_color_sonority_candidate")
        .otherwise("ambiguous_or_nonfunctional_sonority_candidate")
    )


def sonorities(timeline: DataFrame) -> DataFrame:
    """The kind of sound that the active classes of each bin make."""
    active = F.col("active")
    return timeline.select(*REGION, sonority_kind(active).alias("sonority"), F.size("active").alias("classes"), joined(F.transform(active, lambda r: pitch_class_name(r))).alias("active"))


#: Columns of each kind of record that ``pitch_harmony`` makes; all share REGION and confidence.
RECORD_KINDS = {
    "pitch": ["lowest", "highest", "low", "mid", "high", "pitch_classes", "center", "center_share", "mean_velocity"],
    "interval": ["small_share", "fourth_fifth_share", "tritone_share", "chromatic_share", "cluster_share"],
    "contour": ["ups", "downs", "statics", "contour_shape", "contour_score", "arrival", "arrival_confidence"],
    "sonority": ["sonority", "voicing_span", "chord_label", "chord_confidence", "color", "extended"],
    "movement": ["common_tones", "mean_motion", "stepwise_share", "cadence_confidence"],
    "counterpoint": ["voices", "contrary", "parallel", "response_confidence", "rhythm_independence", "pitch_independence"],
    "tuning": ["tuning_confidence"],
}


def pitch_harmony(in_regions: DataFrame, contour: int = 64) -> DataFrame:
    """One row per region with events: what the seven kinds of pitch and harmony records say of it (see RECORD_KINDS).

    Everything comes from one window over the region in order of time. The center is the most frequent pitch class, ties to the lower; a region
    arrives where it ends on it. Even and odd events stand for two voices; where there are six events or more, their moves against each
    other are contrary motion. Regions must be bounded.
    """
    order = Window.partitionBy(*REGION).orderBy("t", "seq")
    ahead = lambda k: F.lead("note", k).over(order)
    moved = in_regions.withColumns({"nth": F.row_number().over(order), "step": ahead(1) - F.col("note"), "upper": ahead(2) - F.col("note"), "lower": ahead(3) - ahead(1), "gap": F.round(F.lead("t").over(order) - F.col("t"), 4)})
    size, pc = F.abs("step"), pitch_class(F.col("note"))
    inside = size % 12
    shaped = F.col("nth") <= contour
    pair = (F.col("nth") % 2 == 1) & F.col("lower").isNotNull()
    g = moved.groupBy(*REGION, "lo", "hi").agg(
        F.count("*").alias("n"),
        F.count("step").alias("steps"),
        F.min("note").alias("lowest"),
        F.max("note").alias("highest"),
        F.count_if(F.col("note") < 48).alias("low"),
        F.count_if(F.col("note").between(48, 71)).alias("mid"),
        F.count_if(F.col("note") >= 72).alias("high"),
        F.array(*counts_of(pc, 12)).alias("pcs"),
        F.avg("vel").alias("vel"),
        F.count_if(size <= 2).alias("small"),
        F.count_if(inside.isin(5, 7)).alias("fifths"),
        F.count_if(inside == 6).alias("tritones"),
        F.count_if(size == 1).alias("semitones"),
        F.count_if((size > 0) & (F.least(inside, 12 - inside) <= 2)).alias("seconds"),
        F.count_if(shaped & (F.col("step") > 0)).alias("ups"),
        F.count_if(shaped & (F.col("step") < 0)).alias("downs"),
        F.count_if(shaped & (F.col("step") == 0)).alias("statics"),
        F.max_by(pc, "nth").alias("last"),
        F.count_if(F.pmod("step", F.lit(12)) == 0).alias("common_tones"),
        F.sum(size).alias("motion"),
        F.count_if(F.pmod("step", F.lit(12)).isin(1, 2, 10, 11)).alias("stepwise"),
        F.count_if(pair).alias("pairs"),
        F.count_if(pair & (F.col("upper") * F.col("lower") < 0)).alias("against"),
        F.count_if(F.col("gap") > 0).alias("n_ioi"),
        F.count_distinct(F.when(F.col("gap") > 0, F.col("gap"))).alias("iois"),
        F.count_distinct("note").alias("notes"),
    )
    n, steps = F.col("n"), F.greatest(F.lit(1), F.col("steps"))
    sure = F.least(F.lit(0.95), 0.25 + n / 120.0)
    center = F.array_position("pcs", F.array_max("pcs")) - 1
    active = F.filter(F.sequence(F.lit(0), F.lit(11)), lambda i: F.get(F.col("pcs"), i) > 0)
    g = g.withColumns({"confidence": F.when(n < 8, F.least(sure, F.lit(0.45))).otherwise(sure), "center_at": center.cast("int"), "share": F.array_max("pcs") / n, "contrary": F.when((n >= 6) & (F.col("pairs") > 0), F.col("against") / F.col("pairs")).otherwise(0.0)})
    c, arrival = F.col("confidence"), F.col("last") == F.col("center_at")
    per_step = lambda name: round6(F.col(name) / steps)
    turns = F.greatest(F.lit(1), F.col("ups") + F.col("downs") + F.col("statics"))
    return g.select(
        *REGION,
        round6(c).alias("confidence"),
        "lowest", "highest", "low", "mid", "high",
        joined(F.col("pcs").cast("array<string>")).alias("pitch_classes"),
        pitch_class_name(F.col("center_at")).alias("center"),
        round6(F.col("share")).alias("center_share"),
        round6(F.col("vel")).alias("mean_velocity"),
        per_step("small").alias("small_share"),
        per_step("fifths").alias("fourth_fifth_share"),
        per_step("tritones").alias("tritone_share"),
        per_step("semitones").alias("chromatic_share"),
        per_step("seconds").alias("cluster_share"),
        "ups", "downs", "statics",
        F.when(F.col("ups") > F.col("downs"), "ascending_tendency_candidate").otherwise("descending_or_balanced_candidate").alias("contour_shape"),
        round6(F.abs(F.col("ups") - F.col("downs")) / turns).alias("contour_score"),
        arrival.alias("arrival"),
        F.when(arrival, round6(F.least(F.lit(0.92), 0.45 + F.col("share")))).alias("arrival_confidence"),
        sonority_kind(active).alias("sonority"),
        (F.col("highest") - F.col("lowest")).alias("voicing_span"),
        F.concat(pitch_class_name(F.col("center_at")), F.lit("_centered_candidate")).alias("chord_label"),
        round6(F.least(F.lit(0.78), c * 0.85)).alias("chord_confidence"),
        F.when(F.col("seconds") >= 3, "cluster_color_candidate").otherwise("non_cluster_candidate").alias("color"),
        (F.col("notes") >= 5).alias("extended"),
        "common_tones",
        round6(F.coalesce("motion", F.lit(0)) / steps).alias("mean_motion"),
        per_step("stepwise").alias("stepwise_share"),
        F.when(arrival, round6(F.least(F.lit(0.7), c * 0.8))).alias("cadence_confidence"),
        F.greatest(F.lit(1), F.least(F.lit(6), F.bround(n / F.greatest(F.lit(1.0), F.col("hi") - F.col("lo")) * 0.6).cast("int"))).alias("voices"),
        round6(F.col("contrary")).alias("contrary"),
        round6(F.greatest(F.lit(0.0), 1 - F.col("contrary"))).alias("parallel"),
        F.when(F.col("n_ioi") >= 3, round6(F.least(F.lit(0.65), 0.25 + F.col("n_ioi") / 30.0))).alias("response_confidence"),
        round6(F.least(F.lit(1.0), F.col("iois") / 6.0)).alias("rhythm_independence"),
        round6(F.least(F.lit(1.0), F.col("notes") / 12.0)).alias("pitch_independence"),
        round6(F.least(c, F.lit(0.72))).alias("tuning_confidence"),
    )


def record_kind(records: DataFrame, kind: str) -> DataFrame:
    """The records of one kind; Spark prunes what the other kinds need."""
    return records.select(*REGION, "confidence", *RECORD_KINDS[kind])


def pitch_harmony_macro(records: DataFrame) -> DataFrame:
    """One row per performance: mean confidence, key hypotheses, share of regions with clusters, and the most frequent sonorities."""
    kinds = records.groupBy("perf", "sonority").agg(F.count("*").alias("n"))
    families = kinds.groupBy("perf").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "sonority"))), 1, 6).alias("f"))  # six kinds exist
    whole = records.groupBy("perf").agg(mean6(F.col("confidence")).alias("confidence"), F.count("*").alias("regions"), round6(F.avg((F.col("cluster_share") > 0.2).cast("int"))).alias("cluster_regions"), F.count_if("arrival").alias("arrivals"))
    c = F.col("confidence")
    return whole.join(families, "perf").select(
        "perf", "confidence", "regions", "cluster_regions", "arrivals",
        F.least(F.lit(0.8), c).alias("tonal_center"),
        round6(F.greatest(F.lit(0.2), 1 - c)).alias("no_clear_center"),
        F.array_join(F.transform("f", lambda x: F.concat_ws(":", x["sonority"], (-x["m"]).cast("string"))), " ").alias("families"),
    )
