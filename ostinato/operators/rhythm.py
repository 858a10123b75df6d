"""Rhythm of regions: inter-onset intervals, pulse, accents, subdivision, meter, cycles, token grids and motifs.

Rows ``in_regions`` are events beside their region: perf, kind, idx, lo, hi, seq, t, note, vel. A region is bounded by its kind's
width: its rows meet in one window over REGION, and all that follows keeps that partitioning, so a query shuffles for the interval
join and once more. Whole performances aren't bounded: ``block`` and ``bounded=False`` take their gaps block by block and their
figures from partial sums, joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ostinato.functions.scalars import clamp01, counts_of, joined, pitch_class, round6
from ostinato.operators import ordered

REGION = ["perf", "kind", "idx"]
#: Beats in a bar of the candidate meters, in their order.
METERS = [("4/4", 4, 4), ("3/4", 3, 4), ("6/8", 6, 8), ("12/8", 12, 8), ("5/4", 5, 4), ("7/8", 7, 8)]


def with_gaps(in_regions: DataFrame, block: float | None = None) -> DataFrame:
    """Adds ``gap``, the time to the region's next event; ``block``: over tiles of that many seconds, for regions without bound."""
    if block is None:
        return in_regions.withColumn("gap", F.lead("t").over(Window.partitionBy(*REGION).orderBy("t", "seq")) - F.col("t"))
    following = ordered.with_next(in_regions, REGION, F.floor(F.col("t") / block).cast("long"), ["t", "seq"], "t", "_following")
    return following.withColumn("gap", F.col("_following") - F.col("t")).drop("_following")


def _ioi() -> Column:
    return F.when(F.col("gap") > 0, F.col("gap"))


def pulses(gaps: DataFrame) -> DataFrame:
    """One row per region with events: n, velocity mean and spread, pulse (median positive gap), close pairs, pitch classes."""
    pcs = F.array(*counts_of(pitch_class(F.col("note")), 12))
    return gaps.groupBy(*REGION, "lo", "hi").agg(
        F.count("*").alias("n"),
        F.avg("vel").alias("vel_mean"),
        F.stddev_pop("vel").alias("vel_std"),
        F.coalesce(F.percentile(_ioi(), 0.5), F.lit(0.0)).alias("pulse"),
        F.count(_ioi()).alias("n_ioi"),
        F.count_if(F.col("gap") <= 0.08).alias("close"),
        pcs.alias("pcs"),
    )


def with_stats(gaps: DataFrame, bounded: bool = True) -> DataFrame:
    """``gaps`` with each region's n, n_ioi, vel_mean, vel_std and pulse: by a window, or by partial sums for regions without bound."""
    if not bounded:
        return gaps.join(pulses(gaps).select(*REGION, "n", "n_ioi", "vel_mean", "vel_std", "pulse"), REGION)
    region = Window.partitionBy(*REGION)
    return gaps.withColumns({
        "n": F.count("*").over(region),
        "n_ioi": F.count(_ioi()).over(region),
        "vel_mean": F.avg("vel").over(region),
        "vel_std": F.stddev_pop("vel").over(region),
        "pulse": F.coalesce(F.percentile(_ioi(), 0.5).over(region), F.lit(0.0)),
    })


def ioi_histogram(gaps: DataFrame) -> DataFrame:
    """REGION, ioi (to two places), n, first (when it is first seen)."""
    own = gaps.where("gap > 0").withColumn("ioi", F.round("gap", 2))
    return own.groupBy(*REGION, "ioi").agg(F.count("*").alias("n"), F.min("t").alias("first"))


def common_iois(histogram: DataFrame, k: int = 3) -> DataFrame:
    """The k most frequent intervals of each region, ties as first seen, with rank."""
    rank = F.row_number().over(Window.partitionBy(*REGION).orderBy(F.desc("n"), "first", "ioi"))
    return histogram.withColumn("rank", rank).where(F.col("rank") <= k).select(*REGION, "rank", "ioi", "n")


def sub_bins(in_regions: DataFrame, width: float = 4.0) -> DataFrame:
    """REGION, sub, events: how many events each tile of ``width`` in a region has; tiles are closed and empty ones are there."""
    regions = in_regions.select(*REGION, "lo", "hi").distinct()
    tiles = regions.withColumn("sub", F.explode(F.sequence(F.lit(0), F.ceil((F.col("hi") - F.col("lo")) / width).cast("int") - 1)))
    own = F.array_distinct(_tiles_of(width)[0])
    counted = in_regions.withColumn("sub", F.explode(own)).groupBy(*REGION, "sub").agg(F.count("*").alias("events"))
    spans = (F.least(F.col("hi"), F.col("lo") + (F.col("sub") + 1) * width) - (F.col("lo") + F.col("sub") * width)).alias("span")
    return tiles.join(counted, [*REGION, "sub"], "left").select(*REGION, "lo", "sub", spans, F.coalesce("events", F.lit(0)).alias("events"))


def _tiles_of(width: float = 4.0):
    """The tiles of ``width`` that an event of a region lies in (two on a common edge), and how many a region has."""
    n = F.ceil((F.col("hi") - F.col("lo")) / width).cast("int")
    at = (F.col("t") - F.col("lo")) / width
    return F.array(F.least(F.floor(at).cast("int"), n - 1), F.greatest(F.ceil(at).cast("int") - 1, F.lit(0))), n


def rhythm_vector(in_regions: DataFrame, block: float | None = None) -> DataFrame:
    """One row per region with events: the whole vector of rhythm statistics. ``block``: see ``with_gaps``."""
    gaps = with_gaps(in_regions, block)
    base = with_stats(gaps, bounded=block is None)
    phase = F.when(F.col("pulse") > 0, ((F.col("t") - F.col("lo")) % F.col("pulse")) / F.col("pulse"))
    tiles, n_tiles = _tiles_of()
    stats = base.groupBy(*REGION, "lo", "hi", "n", "n_ioi", "vel_mean", "vel_std", "pulse").agg(
        F.avg((F.col("vel") >= F.col("vel_mean") + F.col("vel_std")).cast("int")).alias("accents"),
        F.coalesce(F.avg(F.least(phase, 1 - phase)), F.lit(0.0)).alias("syncopation"),
        F.count_if(F.col("gap") <= 0.08).alias("close"),
        F.array(*counts_of(pitch_class(F.col("note")), 12)).alias("pcs"),
        F.array_union(F.collect_set(tiles[0]), F.collect_set(tiles[1])).alias("filled"),  # as many as a region has tiles
    )
    common = common_iois(ioi_histogram(gaps)).groupBy(*REGION).agg(
        joined(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ioi"))), lambda x: F.format_number(x["ioi"], 2))).alias("common_iois"), F.max("n").alias("most")
    )
    n, span = F.col("n"), F.col("hi") - F.col("lo")
    return (
        stats.join(common, REGION, "left").select(
            *REGION,
            n.alias("note_on_count"),
            round6(F.when(span > 0, n / span).otherwise(n)).alias("density"),
            round6(F.col("vel_mean")).alias("mean_velocity"),
            round6(F.col("vel_std")).alias("std_velocity"),
            round6(F.col("accents")).alias("accent_ratio"),
            round6((n_tiles - F.size("filled")) / n_tiles).alias("silence_ratio"),
            round6(F.when(n > 1, F.col("close") / (n - 1)).otherwise(0.0)).alias("polyphonic_density"),
            F.coalesce("common_iois", F.lit("")).alias("common_iois"),
            round6(F.col("pulse")).alias("pulse_seconds"),
            round6(F.col("pulse") / 2).alias("grid_seconds"),
            round6(F.when(F.col("pulse") > 0, 60 / F.col("pulse")).otherwise(0.0)).alias("estimated_bpm"),
            round6(F.col("syncopation")).alias("syncopation"),
            round6(F.when(F.col("n_ioi") > 0, F.col("most") / F.col("n_ioi")).otherwise(0.0)).alias("repetition"),
            joined(F.col("pcs").cast("array<string>")).alias("pitch_classes"),
        )
    )


def burst_and_sparse(in_regions: DataFrame, k: int = 3) -> DataFrame:
    """The k densest and the k sparsest tiles of each region, ties to the earlier."""
    dense = sub_bins(in_regions).withColumn("density", F.col("events") / F.greatest(F.lit(0.001), F.col("span")))
    by = lambda order: F.row_number().over(Window.partitionBy(*REGION).orderBy(order, "sub"))
    ranked = dense.withColumn("burst", by(F.desc("density"))).withColumn("sparse", by(F.asc("density")))
    both = F.explode(F.filter(F.array(F.struct(F.lit("burst").alias("end"), F.col("burst").alias("rank")), F.struct(F.lit("sparse").alias("end"), F.col("sparse").alias("rank"))), lambda x: x["rank"] <= k))
    return ranked.select(*REGION, both.alias("x"), "sub", round6(F.col("density")).alias("density")).select(*REGION, "x.end", "x.rank", "sub", "density")


def _nearness(ratio: Column, targets: list[float]) -> Column:
    return F.array_min(F.array(*[F.abs(ratio - t) for t in targets]))


def subdivisions(gaps: DataFrame, pulse: float | None = None) -> DataFrame:
    """One row per region: straight, triplet, swing, free, random or sparse, with scores, confidence and ambiguity.

    Intervals are measured in pulses: the given one, or each region's own.
    """
    base = (with_stats(gaps) if pulse is None else gaps.withColumn("pulse", F.lit(pulse))).where("gap > 0")
    ratio = F.when(F.col("pulse") > 0, F.col("gap") / F.col("pulse"))
    third = 1.0 / 3.0
    scored = base.groupBy(*REGION).agg(
        F.count("*").alias("n"),
        F.avg(_nearness(ratio, [0.5, 1.0, 2.0])).alias("a"),
        F.avg(_nearness(ratio, [third, 2 * third, 1.0, 4 * third])).alias("b"),
        F.stddev_pop(ratio).alias("spread"),
    )
    enough = (F.col("n") >= 3) & F.col("a").isNotNull()
    scored = scored.withColumn("straight", clamp01(1 - F.least(F.lit(1.0), F.col("a")))).withColumn("triplet", clamp01(1 - F.least(F.lit(1.0), F.col("b"))))
    scored = scored.withColumn("randomness", clamp01(F.col("spread") / 0.6))
    # The swing targets are those of triplets in another order, so both have one score and the triplet comes first.
    best = F.greatest("straight", "triplet", 1 - F.col("randomness"))
    name = F.when(F.col("straight") == best, "straight").when(F.col("triplet") == best, "triplet").otherwise("free")
    second = F.element_at(F.sort_array(F.array("straight", "triplet", "triplet", 1 - F.col("randomness")), asc=False), 2)
    scored = scored.withColumn("best", best).withColumn("unsure", clamp01(1 - (best - second))).withColumn("sure", clamp01(best * 0.75 + (1 - F.col("randomness")) * 0.25))
    wild, loose = F.col("randomness") > 0.8, (F.col("randomness") > 0.55) & (F.col("unsure") > 0.6)
    return scored.select(
        *REGION,
        F.when(~enough, "sparse").when(wild | loose, "random").otherwise(name).alias("subdivision"),
        round6(F.when(~enough, 0.15).when(wild, F.least("sure", F.lit(0.45))).when(loose, F.least("sure", F.lit(0.5))).otherwise(F.col("sure"))).alias("grid_confidence"),
        round6(F.when(~enough, 0.9).when(wild, F.greatest("unsure", F.lit(0.75))).when(loose, F.greatest("unsure", F.lit(0.7))).otherwise(F.col("unsure"))).alias("ambiguity"),
        round6(F.when(enough, F.col("straight")).otherwise(0.0)).alias("straightness"),
        round6(F.when(enough, F.col("triplet")).otherwise(0.0)).alias("tripletness"),
        round6(F.when(enough, F.col("randomness")).otherwise(1.0)).alias("randomness"),
    )


def pulse_stability(gaps: DataFrame) -> DataFrame:
    stats = gaps.groupBy(*REGION).agg(F.stddev_pop(_ioi()).alias("spread"), F.percentile(_ioi(), 0.5).alias("pulse"), F.count(_ioi()).alias("n"))
    stable = clamp01(1 - F.col("spread") / F.greatest("pulse", F.lit(1e-6)))
    return stats.select(*REGION, round6(F.when((F.col("n") >= 2) & (F.col("pulse") > 0), stable).otherwise(0.0)).alias("pulse_stability"))


def microtiming(gaps: DataFrame) -> DataFrame:
    """Mean and spread, in milliseconds, of events' distances from the grid of a half or, for triplets and swing, a third pulse."""
    kinds = subdivisions(gaps).select(*REGION, "subdivision")
    base = with_stats(gaps).where("pulse > 0").join(kinds, REGION, "left")
    step = F.col("pulse") / F.when(F.col("subdivision").isin("triplet", "swing"), 3.0).otherwise(2.0)
    at = F.greatest(F.lit(0.0), F.col("t") - F.col("lo"))
    rest = at - F.bround(at / F.greatest(step, F.lit(1e-6))) * step
    out = base.withColumn("rest", rest).groupBy(*REGION).agg(F.avg("rest").alias("bias"), F.stddev_pop("rest").alias("jitter"))
    return out.select(*REGION, round6(F.col("bias") * 1000).alias("bias_ms"), round6(F.col("jitter") * 1000).alias("jitter_ms"))


def meter_hypotheses(gaps: DataFrame, k: int = 4) -> DataFrame:
    """The k best of six meters for each region of at least eight events and a pulse; weak ones are called undetermined."""
    base = with_stats(gaps).where("pulse > 0 and n >= 8")
    meters = F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(m).alias("meter"), F.lit(b).alias("beats")) for i, (m, b, _) in enumerate(METERS)])
    each = base.withColumn("m", F.explode(meters)).select(*REGION, "lo", "t", "pulse", (F.col("vel") >= F.col("vel_mean") + F.col("vel_std") * 0.4).alias("accent"), "m.*")
    at = F.greatest(F.lit(0.0), F.col("t") - F.col("lo"))
    each = each.withColumn("bar", F.floor(at / (F.col("pulse") * F.col("beats"))))
    each = each.withColumn("phase", (at - F.col("bar") * (F.col("pulse") * F.col("beats"))) / F.col("pulse"))
    each = each.withColumn("down", F.bround("phase").cast("int") % F.col("beats") == 0)
    summed = each.groupBy(*REGION, "nth", "meter", "beats").agg(
        F.sum(F.when(F.col("down"), F.when(F.col("accent"), 1.3).otherwise(1.0)).otherwise(0.0)).alias("hits"),
        F.sum(F.when(~F.col("down"), F.when(F.col("accent"), 1.2).otherwise(1.0)).otherwise(0.0)).alias("off"),
        F.coalesce(F.avg(F.when(F.col("down"), F.abs(F.col("phase") - F.bround("phase")))), F.lit(0.5)).alias("offset"),
        F.max("bar").alias("bars"),
    )
    ratio = F.col("hits") / F.greatest(F.lit(1.0), F.col("off"))
    support = clamp01((F.col("bars") + 1) / 6.0)
    scored = summed.withColumn("raw", round6(clamp01(ratio / 2.5 * 0.45 + clamp01(1 - F.col("offset")) * 0.35 + support * 0.2)))
    order = Window.partitionBy(*REGION).orderBy(F.desc("raw"), "nth")
    ranked = scored.withColumn("rank", F.row_number().over(order)).withColumn("second", F.lead("raw").over(order))
    top = F.max(F.when(F.col("rank") == 1, F.col("raw") - F.col("second"))).over(Window.partitionBy(*REGION))
    ranked = ranked.withColumn("ambiguity", round6(clamp01(1 - top)))
    return ranked.where(F.col("rank") <= k).select(*REGION, "rank", F.when(F.col("raw") < 0.35, "undetermined").otherwise(F.col("meter")).alias("meter"), "beats", F.col("raw").alias("confidence"), "ambiguity")


def cycles(gaps: DataFrame, most: int = 24) -> DataFrame:
    """The lag, in beats, at which a region's onsets per beat repeat best (autocorrelation), for regions of 16 events or more.

    Lags of 2 up to half of the beats and less than ``most`` are tried. The first event of a region brings a zero for each beat.
    """
    order = Window.partitionBy(*REGION).orderBy("t", "seq")
    base = with_stats(gaps).withColumn("first", F.row_number().over(order) == 1).where("pulse > 0 and n >= 16")
    beats = F.greatest(F.lit(1), ((F.col("hi") - F.col("lo")) / F.col("pulse")).cast("int"))
    onset = F.struct(((F.col("t") - F.col("lo")) / F.col("pulse")).cast("int").alias("beat"), (1 + F.col("vel") / 127.0 * 0.2).alias("x"), F.lit(1).alias("own"))
    empty = F.transform(F.sequence(F.lit(0), F.col("beats") - 1), lambda b: F.struct(b.alias("beat"), F.lit(0.0).alias("x"), F.lit(0).alias("own")))
    each = base.withColumn("beats", beats).withColumn("e", F.explode(F.when(F.col("first"), F.concat(F.array(onset), empty)).otherwise(F.array(onset))))
    series = each.where("e.beat >= 0 and e.beat < beats").groupBy(*REGION, "beats", "e.beat").agg(F.sum("e.x").alias("x"), F.sum("e.own").alias("own"))
    region = Window.partitionBy(*REGION)
    moments = series.withColumns({"c": F.avg("x").over(region), "den": F.var_pop("x").over(region) * F.count("*").over(region)})
    lags = range(2, most)
    later = moments.withColumns({f"y{k}": F.lead("x", k).over(region.orderBy("beat")) for k in lags})
    summed = later.groupBy(*REGION, "beats", "den").agg(F.sum("own").alias("own"), *[F.sum((F.col("x") - F.col("c")) * (F.col(f"y{k}") - F.col("c"))).alias(f"s{k}") for k in lags]).where("own > 0")
    tried = F.array(*[F.struct(F.when((F.col("den") > 0) & (F.floor(F.col("beats") / 2) >= k), round6(F.col(f"s{k}") / F.col("den"))).alias("r"), F.lit(-k).alias("minus")) for k in lags])
    best = summed.withColumn("best", F.array_max(F.filter(tried, lambda x: x["r"] > 0)))
    peak = F.coalesce("best.r", F.lit(0.0))
    return best.select(*REGION, F.coalesce(-F.col("best.minus"), F.lit(0)).alias("cycle_beats"), round6(peak).alias("peak"), round6(clamp01((peak + 0.1) / 1.1)).alias("confidence"), F.col("beats").alias("series_beats"))


def phrase_shapes(in_regions: DataFrame) -> DataFrame:
    """Whether a region's second half is denser than its first; an event at the middle counts in both."""
    half = (F.col("lo") + F.col("hi")) / 2
    counted = in_regions.groupBy(*REGION, "lo", "hi").agg(F.count_if(F.col("t") <= half).alias("a"), F.count_if(F.col("t") >= half).alias("b"))
    width = F.greatest(half - F.col("lo"), F.lit(1e-6))
    a, b = F.col("a") / width, F.col("b") / width
    shape = F.when((a == 0) & (b == 0), "free_or_silent").when(b > a * 1.2, "expanding").when(a > b * 1.2, "contracting").otherwise("stable")
    return counted.select(*REGION, shape.alias("phrase_shape"), round6(a).alias("first_density"), round6(b).alias("second_density"))


def macro_sections(vectors: DataFrame, duration: float, width: float) -> DataFrame:
    """Names of sections by their place and density."""
    middle = (F.col("idx") + 0.5) * width / duration
    name = F.when(middle >= 0.9, "outro_or_coda").when(middle <= 0.1, "intro_or_prelude").when(F.col("density") >= 5.0, "climactic_peak").when(F.col("density") <= 1.5, "sparse_break_or_interlude").otherwise("verse_or_chorus_candidate")
    return vectors.select(*REGION, name.alias("section"), "density")


def token_grid(gaps: DataFrame) -> DataFrame:
    """REGION, steps, tokens, accents: each region's onsets on a grid of half pulses, as text of x and dots; A marks accents.

    The last event of a step decides on its accent. Between 8 and 64 steps; without a pulse the grid is a sixteenth of the region.
    """
    base = with_stats(gaps)
    span = F.col("hi") - F.col("lo")
    grid = F.when(F.col("pulse") > 0, F.col("pulse") / 2).otherwise(F.greatest(F.lit(0.1), span / 16))
    steps = F.least(F.lit(64), F.greatest(F.lit(8), F.bround(span / grid).cast("int")))
    placed = base.withColumn("steps", steps).withColumn("step", F.least(F.col("steps") - 1, F.greatest(F.lit(0), F.bround((F.col("t") - F.col("lo")) / grid).cast("int"))))
    marks = placed.groupBy(*REGION, "steps", "step").agg(F.max_by((F.col("vel") >= F.col("vel_mean") + 6).cast("int"), F.struct("t", "seq")).alias("accent"))
    listed = marks.groupBy(*REGION, "steps").agg(F.map_from_entries(F.collect_list(F.struct("step", "accent"))).alias("m"))
    every = F.sequence(F.lit(0), F.col("steps") - 1)
    text = lambda mark: F.array_join(F.transform(every, lambda s: mark(F.try_element_at(F.col("m"), s))), "")
    return listed.select(
        *REGION,
        "steps",
        text(lambda a: F.when(a.isNotNull(), "x").otherwise(".")).alias("tokens"),
        text(lambda a: F.when(a == 1, "A").otherwise(".")).alias("accents"),
    )


def motif_ngrams(grid: DataFrame, shortest: int = 3, longest: int = 12) -> DataFrame:
    """REGION, size, place, gram, marks: every run of tokens that has at least two onsets, and its accents."""
    sizes = grid.withColumn("size", F.explode(F.sequence(F.lit(shortest), F.lit(longest)))).where(F.col("size") <= F.col("steps"))
    runs = sizes.withColumn("place", F.explode(F.sequence(F.lit(1), F.col("steps") - F.col("size") + 1)))
    gram, marks = (F.substr(F.col(c), F.col("place"), F.col("size")) for c in ("tokens", "accents"))
    runs = runs.select(*REGION, "size", F.col("place").alias("place"), gram.alias("gram"), marks.alias("marks"))
    return runs.where(F.length("gram") - F.length(F.replace("gram", F.lit("x"), F.lit(""))) >= 2)


def onset_ratios(gram: Column) -> Column:
    """Steps between a pattern's onsets in pulses, a step being half a pulse."""
    at = F.filter(F.sequence(F.lit(1), F.length(gram)), lambda i: F.substr(gram, i, F.lit(1)) == "x")
    return F.zip_with(F.slice(at, 2, F.size(at)), F.slice(at, 1, F.size(at) - 1), lambda b, a: (b - a) / 2.0)


def motif_groups(grams: DataFrame, least: int = 2) -> DataFrame:
    """Motifs that a performance repeats: how often, in how many regions, and where first."""
    grouped = grams.groupBy("perf", "gram").agg(F.count("*").alias("repeats"), F.count_distinct("idx").alias("regions"), F.min(F.struct("idx", "place")).alias("at"))
    return grouped.where(F.col("repeats") >= least).select("perf", "gram", "repeats", "regions", F.col("at.idx").alias("first_idx"), F.col("at.place").alias("first_place"), round6(F.least(F.lit(0.95), 0.25 + F.col("repeats") / 6.0)).alias("confidence"))
