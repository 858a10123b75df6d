"""Queries that compare runs: two segmentations of the same candidates, and the cuts that they share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.functions.scalars import mean6
from ostinato.operators import matching, segmentation
from ostinato.plans import reviews
from ostinato.plans.events import _METRICS, _RELIABLE, reliable_windows
from ostinato.plans.reviews import LONGEST, SHORTEST, TARGET
from ostinato.sources import music, scratch
from ostinato.sources.music import with_sql

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: The runs' names and thresholds, and how far apart cuts of the same place may be.
RUNS, TOLERANCE = {"first": 0.6, "second": 0.72}, 4.0


def runs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Segments and evaluated candidates of both runs; the candidates, which all four need, are written once."""
    candidates = scratch.written(reviews.scored_candidates(spark, sf_dir), "candidates")
    segments = evaluated = None
    for name, threshold in RUNS.items():
        cut = segmentation.structure_segments(candidates, music.DURATION, TARGET, SHORTEST, LONGEST, threshold)
        told = segmentation.candidate_evaluations(candidates, cut, music.DURATION, SHORTEST, LONGEST, threshold)
        cut, told = cut.withColumn("run", F.lit(name)), told.select(F.lit(name).alias("run"), "perf", "t", F.round("tuned", 6).alias("tuned"), "reason")
        segments = cut if segments is None else segments.unionByName(cut)
        evaluated = told if evaluated is None else evaluated.unionByName(told)
    return scratch.written(segments, "run-segments"), evaluated


def matches(segments: DataFrame) -> DataFrame:
    """perf, first, second, status of all cuts inside the performances."""
    cuts = lambda name: segments.where((F.col("run") == name) & (F.col("hi") < music.DURATION)).select("perf", F.col("hi").alias("t"))
    return matching.status(matching.one_to_one(cuts("first"), cuts("second"), TOLERANCE))


def _of_runs(sql: str) -> str:
    """A query's SQL for both runs, with the run's name in front."""
    each = [f"select '{name}' as run, * from ({sql.replace('tuned >= 0.6', f'tuned >= {threshold}').replace('tuned < 0.6', f'tuned < {threshold}')})" for name, threshold in RUNS.items()]
    return " union all ".join(each)


_SEGMENTS = f"sg as materialized ({_of_runs(reviews.ORACLES['segments_structure'])})"
#: Both lists from left to right: the two next times are a pair if they are near, or else the earlier one is alone.
_MATCHES = f"""lists as (select perf, list(hi order by hi) filter (where run = 'first' and hi < {music.DURATION}) as a, list(hi order by hi) filter (where run = 'second' and hi < {music.DURATION}) as b from sg group by perf),
walk as (
  select perf, a, b, 1 as i, 1 as j, null::double as first, null::double as second from lists
  union all
  select perf, a, b, i + (case when near or x_first then 1 else 0 end), j + (case when near or not x_first then 1 else 0 end), case when near or x_first then x end, case when near or not x_first then y end
  from (select *, coalesce(abs(x - y) <= {TOLERANCE} + 1e-9, false) as near, y is null or coalesce(x < y, false) as x_first from (select perf, a, b, i, j, a[i] as x, b[j] as y from walk) where x is not null or y is not null)),
matched as (select perf, first, second, case when second is null then 'only_first' when first is null then 'only_second' else 'both' end as status from walk where first is not null or second is not null)"""


@query(f"with recursive {_SEGMENTS}, {_MATCHES} select perf, first, second, status from matched")
def run_boundary_matches(spark, sf_dir):
    """The cuts of both runs one to one within four seconds, and those of one run alone."""
    return matches(runs(spark, sf_dir)[0]).select("perf", "first", "second", "status")


@query(f"with recursive {_SEGMENTS}, ev as materialized ({_of_runs(reviews.ORACLES['candidate_evaluations'])}), {_MATCHES}," + f"""
cut as (select run, perf, count(*) as segments, max(hi - lo) as longest, round(sum(round((hi - lo) * 1e9::double)::bigint)::double / count(*) / 1e9::double, 6) as mean_length, count(case when source = 'audio_structure' then 1 end) as found from sg group by all),
rs as (select run, perf, sum(n)::bigint as candidates, string_agg(reason || ':' || n, ',' order by reason) as reasons from (select run, perf, reason, count(*) as n from ev group by all) group by all),
tops as (select run, perf, string_agg(t::varchar || '@' || tuned::varchar, ',' order by tuned desc, t) as top_candidates from (select * from ev qualify row_number() over (partition by run, perf order by tuned desc, t) <= 3) group by all),
w as (select perf, count(case when status = 'success' then 1 end) as successful_windows, count(case when status <> 'success' then 1 end) as failed_windows, coalesce(sum(case when status = 'success' then notes end), 0)::bigint as note_total from ({with_sql(*_METRICS, _RELIABLE)} select * from weighted) group by perf),
own as (select 'first' as run, perf, count(case when status = 'both' then 1 end) as shared, count(case when status = 'only_first' then 1 end) as alone from matched group by perf union all select 'second', perf, count(case when status = 'both' then 1 end), count(case when status = 'only_second' then 1 end) from matched group by perf)
select cut.run, cut.perf, segments, longest, mean_length, found, candidates, reasons, top_candidates, shared, alone, successful_windows, failed_windows, note_total
from cut left join rs using (run, perf) left join tops using (run, perf) left join own using (run, perf) left join w using (perf)""")
def run_comparison(spark, sf_dir):
    """A row for each run and performance: its segments, why candidates were refused, the best three, cuts shared with the other run, notes."""
    segments, evaluated = runs(spark, sf_dir)
    length = F.col("hi") - F.col("lo")
    cut = segments.groupBy("run", "perf").agg(F.count("*").alias("segments"), F.max(length).alias("longest"), mean6(length).alias("mean_length"), F.count_if(F.col("source") == segmentation.CHOSEN).alias("found"))
    is_ = lambda s: F.count_if(F.col("status") == s)
    counted = matches(segments).groupBy("perf").agg(is_("both").alias("shared"), is_("only_first").alias("first"), is_("only_second").alias("second"))
    own = counted.select("perf", "shared", F.explode(F.map_from_arrays(F.array(*map(F.lit, RUNS)), F.array(*RUNS))).alias("run", "alone"))
    done = F.col("status") == "success"
    windows = reliable_windows(spark, sf_dir).groupBy("perf").agg(F.count_if(done).alias("successful_windows"), F.count_if(~done).alias("failed_windows"), F.coalesce(F.sum(F.when(done, F.col("notes"))), F.lit(0)).alias("note_total"))
    joined = cut.join(matching.run_summary(evaluated, ["run", "perf"]), ["run", "perf"], "left").join(own, ["run", "perf"], "left").join(windows, "perf", "left")
    return joined.select("run", "perf", "segments", "longest", "mean_length", "found", "candidates", "reasons", "top_candidates", "shared", "alone", "successful_windows", "failed_windows", "note_total")
