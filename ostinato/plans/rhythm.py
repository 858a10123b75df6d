"""Queries on rhythm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.operators import intervals, ordered, ranks, rhythm
from ostinato.sources import music, scratch
from ostinato.sources.music import BINS_SQL, NOTES_SQL, PERFS_SQL, SEGMENTS_SQL, WINDOWS_SQL, with_sql

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def in_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.points_in(music.notes(spark, sf_dir), music.bins(spark, sf_dir), music.BIN)


def in_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.points_in(music.notes(spark, sf_dir), music.windows(spark, sf_dir), music.WINDOW)


def in_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.points_in(music.notes(spark, sf_dir), music.segments(spark, sf_dir), music.SEGMENT)


def in_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.points_in(music.notes(spark, sf_dir), music.regions(spark, sf_dir).drop("kind_order"), music.SEGMENT)


def located_sql(regions: str, name: str = "located") -> str:
    return f"{name} as (select b.perf, b.kind, b.idx, b.lo, b.hi, n.seq, n.t, n.note, n.vel from {regions} b join notes n on n.perf = b.perf and n.t between b.lo and b.hi)"


def gaps_sql(located: str = "located") -> str:
    return f"gaps as (select *, lead(t) over (partition by perf, kind, idx order by t, seq) - t as gap from {located})"


BINNED = [NOTES_SQL, PERFS_SQL, BINS_SQL, located_sql("bins"), gaps_sql()]
WINDOWED = [NOTES_SQL, PERFS_SQL, WINDOWS_SQL, located_sql("windows"), gaps_sql()]
SEGMENTED = [NOTES_SQL, PERFS_SQL, SEGMENTS_SQL, located_sql("segments"), gaps_sql()]
PULSES = """pulses as (
  select perf, kind, idx, lo, hi, count(*) as n, avg(vel) as vel_mean, stddev_pop(vel) as vel_std,
         coalesce(quantile_cont(case when gap > 0 then gap end, 0.5), 0) as pulse, count(case when gap > 0 then 1 end) as n_ioi,
         count(case when gap <= 0.08 then 1 end) as near
  from gaps group by perf, kind, idx, lo, hi)"""
_PCS = " || ' ' || ".join(f"count(case when note % 12 = {i} then 1 end)::varchar" for i in range(12))


def _vector_sql(ctes: list[str]) -> str:
    return with_sql(
        *ctes,
        PULSES,
        """second as (
  select g.perf, g.kind, g.idx, avg(case when g.vel >= vel_mean + vel_std then 1.0::double else 0 end) as accents,
         coalesce(avg(least((t - g.lo) % nullif(pulse, 0) / nullif(pulse, 0), 1 - (t - g.lo) % nullif(pulse, 0) / nullif(pulse, 0))), 0) as syncopation
  from gaps g join pulses p using (perf, kind, idx) group by all)""",
        f"pcs as (select perf, kind, idx, {_PCS} as pitch_classes from located group by perf, kind, idx)",
        """hist as (select perf, kind, idx, round(gap, 2) as ioi, count(*) as n, min(t) as first from gaps where gap > 0 group by perf, kind, idx, round(gap, 2)),
common as (select perf, kind, idx, ioi, n, row_number() over (partition by perf, kind, idx order by n desc, first, ioi) as rank from hist),
top as (select perf, kind, idx, string_agg(printf('%.2f', ioi), ' ' order by rank) as common_iois, max(n) as most from common where rank <= 3 group by perf, kind, idx)""",
        """tiles as (
  select distinct perf, kind, idx, lo, hi, unnest(range(0, ceil((hi - lo) / 4.0)::int)) as sub from located),
silent as (
  select t.perf, t.kind, t.idx, avg(case when l.t is null then 1.0::double else 0 end) as silence
  from tiles t left join (select distinct perf, kind, idx, sub, 1 as t from (
    select perf, kind, idx, unnest(list_distinct([least(floor((t - lo) / 4.0)::int, ceil((hi - lo) / 4.0)::int - 1), greatest(ceil((t - lo) / 4.0)::int - 1, 0)])) as sub from located)) l
    on l.perf = t.perf and l.kind = t.kind and l.idx = t.idx and l.sub = t.sub group by 1, 2, 3)""",
    ) + """
select p.perf, p.kind, p.idx, n as note_on_count, round(case when hi > lo then n / (hi - lo) else n end, 6) as density,
       round(vel_mean, 6) as mean_velocity, round(vel_std, 6) as std_velocity, round(accents, 6) as accent_ratio, round(silence, 6) as silence_ratio,
       round(case when n > 1 then near::double / (n - 1) else 0 end, 6) as polyphonic_density, coalesce(common_iois, '') as common_iois,
       round(pulse, 6) as pulse_seconds, round(pulse / 2, 6) as grid_seconds, round(case when pulse > 0 then 60 / pulse else 0 end, 6) as estimated_bpm,
       round(syncopation, 6) as syncopation, round(case when n_ioi > 0 then most::double / n_ioi else 0 end, 6) as repetition, pitch_classes
from pulses p join second using (perf, kind, idx) join pcs using (perf, kind, idx) join silent using (perf, kind, idx) left join top using (perf, kind, idx)
"""


@query(_vector_sql(BINNED[:-1] + [gaps_sql()]))
def region_rhythm_profile(spark, sf_dir):
    return rhythm.rhythm_vector(in_bins(spark, sf_dir))


_ALL_REGIONS = [NOTES_SQL, PERFS_SQL, BINS_SQL, WINDOWS_SQL, SEGMENTS_SQL, music.tiles_sql("whole", music.DURATION, "performance"), "regions as (select * from whole union all select * from segments union all select * from windows union all select * from bins)", located_sql("regions"), gaps_sql()]


@query(_vector_sql(_ALL_REGIONS))
def rhythm_vector_multi_granularity(spark, sf_dir):
    whole = F.col("kind") == "performance"
    every = in_regions(spark, sf_dir)
    return rhythm.rhythm_vector(every.where(~whole)).unionByName(rhythm.rhythm_vector(every.where(whole), block=music.SEGMENT))


@query(with_sql(*WINDOWED) + """, hist as (select perf, kind, idx, round(gap, 2) as ioi, count(*) as n, min(t) as first from gaps where gap > 0 group by perf, kind, idx, round(gap, 2))
select perf, kind, idx, (row_number() over (partition by perf, kind, idx order by n desc, first, ioi))::int as rank, ioi, n from hist qualify rank <= 3""")
def ioi_histogram_top3(spark, sf_dir):
    return rhythm.common_iois(rhythm.ioi_histogram(rhythm.with_gaps(in_windows(spark, sf_dir))))


@query(with_sql(NOTES_SQL, "ordered as (select perf, lead(t) over (partition by perf order by t, seq) - t as gap from notes)") + """
select perf, round(gap, 2) as ioi, count(*) as n from ordered where gap > 0 group by perf, round(gap, 2)""")
def performance_ioi_histogram(spark, sf_dir):
    """Over whole performances: neighbours are found block by block, so a long performance is many tasks."""
    near = ordered.with_next(music.notes(spark, sf_dir), ["perf"], F.floor(F.col("t") / music.WINDOW).cast("int"), ["t", "seq"], "t", "next_t")
    gap = F.col("next_t") - F.col("t")
    return near.where(gap > 0).groupBy("perf", F.round(gap, 2).alias("ioi")).agg(F.count("*").alias("n"))


@query(with_sql(NOTES_SQL) + "select perf, seq, sum(vel) over (partition by perf order by t, seq rows unbounded preceding)::bigint as energy from notes")
def cumulative_energy(spark, sf_dir):
    out = ordered.running_sum(music.notes(spark, sf_dir), ["perf"], F.floor(F.col("t") / music.WINDOW).cast("int"), ["t", "seq"], "vel", "energy")
    return out.select("perf", "seq", F.col("energy").cast("long").alias("energy"))


@query(with_sql(*WINDOWED[:-1]) + """, tiles as (select distinct perf, kind, idx, lo, hi, unnest(range(0, ceil((hi - lo) / 4.0)::int)) as sub from located),
dense as (select t.perf, t.kind, t.idx, t.sub::int as sub, count(l.t) / (least(t.hi, t.lo + (t.sub + 1) * 4.0) - (t.lo + t.sub * 4.0))::double as density
  from tiles t left join located l on l.perf = t.perf and l.kind = t.kind and l.idx = t.idx and l.t between t.lo + t.sub * 4.0 and least(t.hi, t.lo + (t.sub + 1) * 4.0) group by t.perf, t.kind, t.idx, t.lo, t.hi, t.sub),
ranked as (select *, row_number() over (partition by perf, kind, idx order by density desc, sub) as b, row_number() over (partition by perf, kind, idx order by density, sub) as s from dense)
select perf, kind, idx, 'burst' as "end", b::int as rank, sub, round(density, 6) as density from ranked where b <= 3
union all select perf, kind, idx, 'sparse', s::int, sub, round(density, 6) from ranked where s <= 3""")
def burst_sparse_regions(spark, sf_dir):
    return rhythm.burst_and_sparse(in_windows(spark, sf_dir))


_SUBDIVISION = """near as (
  select g.perf, g.kind, g.idx, gap / nullif(pulse, 0) as r from gaps g join pulses using (perf, kind, idx) where gap > 0),
scored as (
  select perf, kind, idx, count(*) as n, avg(least(abs(r - 0.5), abs(r - 1.0), abs(r - 2.0))) as a,
         avg(least(abs(r - 1.0 / 3), abs(r - 2.0 / 3), abs(r - 1.0), abs(r - 4.0 / 3))) as b, stddev_pop(r) as spread
  from (select perf, kind, idx, r::double as r from near) group by perf, kind, idx),
s as (select *, greatest(0, 1 - least(1, a)) as straight, greatest(0, 1 - least(1, b)) as triplet, greatest(0, least(1, spread / 0.6)) as wild from scored),
k as (select *, greatest(straight, triplet, 1 - wild) as best, list_sort([straight, triplet, triplet, 1 - wild], 'DESC')[2] as second from s),
u as (select *, greatest(0, least(1, 1 - (best - second))) as unsure, greatest(0, least(1, best * 0.75 + (1 - wild) * 0.25)) as sure from k),
subdivisions as (
  select perf, kind, idx,
    case when n < 3 or a is null then 'sparse' when wild > 0.8 or (wild > 0.55 and unsure > 0.6) then 'random' when straight = best then 'straight' when triplet = best then 'triplet' else 'free' end as subdivision,
    round(case when n < 3 or a is null then 0.15 when wild > 0.8 then least(sure, 0.45) when wild > 0.55 and unsure > 0.6 then least(sure, 0.5) else sure end, 6) as grid_confidence,
    round(case when n < 3 or a is null then 0.9 when wild > 0.8 then greatest(unsure, 0.75) when wild > 0.55 and unsure > 0.6 then greatest(unsure, 0.7) else unsure end, 6) as ambiguity,
    round(case when n < 3 or a is null then 0 else straight end, 6) as straightness, round(case when n < 3 or a is null then 0 else triplet end, 6) as tripletness,
    round(case when n < 3 or a is null then 1 else wild end, 6) as randomness
  from u)"""


@query(with_sql(*WINDOWED, PULSES, _SUBDIVISION) + "select * from subdivisions")
def subdivision_type(spark, sf_dir):
    return rhythm.subdivisions(rhythm.with_gaps(in_windows(spark, sf_dir)))


@query(with_sql(*WINDOWED) + """select perf, kind, idx, round(case when n >= 2 and pulse > 0 then greatest(0, least(1, 1 - spread / greatest(pulse, 1e-6))) else 0 end, 6) as pulse_stability
from (select perf, kind, idx, stddev_pop(case when gap > 0 then gap end) as spread, quantile_cont(case when gap > 0 then gap end, 0.5) as pulse, count(case when gap > 0 then 1 end) as n from gaps group by all)""")
def pulse_stability(spark, sf_dir):
    return rhythm.pulse_stability(rhythm.with_gaps(in_windows(spark, sf_dir)))


@query(with_sql(*WINDOWED, PULSES, _SUBDIVISION) + """, r as (
  select g.perf, g.kind, g.idx, greatest(0, t - g.lo) as rel, pulse / case when subdivision in ('triplet', 'swing') then 3.0::double else 2.0::double end as step
  from gaps g join pulses p using (perf, kind, idx) left join subdivisions s using (perf, kind, idx) where pulse > 0)
select perf, kind, idx, round(avg(rel - round_even(rel / greatest(step, 1e-6), 0) * step) * 1000, 6) as bias_ms, round(stddev_pop(rel - round_even(rel / greatest(step, 1e-6), 0) * step) * 1000, 6) as jitter_ms from r group by perf, kind, idx""")
def microtiming(spark, sf_dir):
    return rhythm.microtiming(rhythm.with_gaps(in_windows(spark, sf_dir)))


@query(with_sql(*WINDOWED, PULSES) + """, m as (select * from (values (0, '4/4', 4), (1, '3/4', 3), (2, '6/8', 6), (3, '12/8', 12), (4, '5/4', 5), (5, '7/8', 7)) as m(nth, meter, beats)),
e as (select g.perf, g.kind, g.idx, m.nth, m.meter, m.beats, pulse, vel >= vel_mean + vel_std * 0.4::double as accent, greatest(0, t - g.lo) as rel
  from gaps g join pulses p using (perf, kind, idx) cross join m where pulse > 0 and n >= 8),
b as (select *, floor(rel / (pulse * beats)) as bar from e),
q as (select *, (rel - bar * (pulse * beats)) / pulse as phase from b),
d as (select *, round_even(phase, 0)::int % beats = 0 as down from q),
h as (select perf, kind, idx, nth, meter, beats, sum(case when down then case when accent then 1.3::double else 1 end else 0 end) as hits,
    sum(case when not down then case when accent then 1.2::double else 1 end else 0 end) as off,
    coalesce(avg(case when down then abs(phase - round_even(phase, 0)) end), 0.5) as offset_, max(bar) as bars from d group by perf, kind, idx, nth, meter, beats),
c as (select perf, kind, idx, nth, meter, beats, round(greatest(0, least(1, hits / greatest(1, off) / 2.5::double * 0.45::double + greatest(0, least(1, 1 - offset_)) * 0.35::double + least(1, (bars + 1) / 6.0::double) * 0.2::double)), 6) as raw from h),
r as (select *, row_number() over w as rank, lead(raw) over w as second from c window w as (partition by perf, kind, idx order by raw desc, nth)),
a as (select *, round(greatest(0, least(1, 1 - max(case when rank = 1 then raw - second end) over (partition by perf, kind, idx))), 6) as ambiguity from r)
select perf, kind, idx, rank::int as rank, case when raw < 0.35 then 'undetermined' else meter end as meter, beats, raw as confidence, ambiguity from a where rank <= 4""")
def meter_hypotheses(spark, sf_dir):
    return rhythm.meter_hypotheses(rhythm.with_gaps(in_windows(spark, sf_dir)))


@query(with_sql(*WINDOWED, PULSES) + """, o as (select g.perf, g.kind, g.idx, greatest(1, trunc((g.hi - g.lo) / pulse)::int) as beats, trunc((t - g.lo) / pulse)::int as beat, vel
  from gaps g join pulses p using (perf, kind, idx) where pulse > 0 and n >= 16),
heads as (select distinct perf, kind, idx, beats from o where beat >= 0 and beat < beats),
s as (select perf, kind, idx, beat, sum(1 + vel / 127.0::double * 0.2::double) as x from o where beat >= 0 and beat < beats group by perf, kind, idx, beat),
f as (select h.perf, h.kind, h.idx, h.beats, h.beat, coalesce(s.x, 0) as x from (select *, unnest(range(0, beats)) as beat from heads) h left join s on s.perf = h.perf and s.kind = h.kind and s.idx = h.idx and s.beat = h.beat),
c as (select *, x - avg(x) over w as y, var_pop(x) over w * count(*) over w as den from f window w as (partition by perf, kind, idx)),
l as (select a.perf, a.kind, a.idx, lag_ as lag, round(sum(a.y * b.y) / max(a.den), 6) as r
  from (select *, unnest(range(2, least(24, beats // 2 + 1))) as lag_ from c) a join c b on b.perf = a.perf and b.kind = a.kind and b.idx = a.idx and b.beat = a.beat + a.lag_ group by a.perf, a.kind, a.idx, lag_),
best as (select perf, kind, idx, lag, r from l where r > 0 qualify row_number() over (partition by perf, kind, idx order by r desc, lag) = 1)
select perf, kind, idx, coalesce(lag, 0)::int as cycle_beats, round(coalesce(r, 0), 6) as peak, round(greatest(0, least(1, (coalesce(r, 0) + 0.1::double) / 1.1::double)), 6) as confidence, beats as series_beats from heads left join best using (perf, kind, idx)""")
def cycle_autocorrelation(spark, sf_dir):
    return rhythm.cycles(rhythm.with_gaps(in_windows(spark, sf_dir)))


@query(with_sql(*SEGMENTED[:-1]) + """, h as (select perf, kind, idx, count(case when t <= (lo + hi) / 2 then 1 end) / ((hi - lo) / 2) as a, count(case when t >= (lo + hi) / 2 then 1 end) / ((hi - lo) / 2) as b from located group by perf, kind, idx, lo, hi)
select perf, kind, idx, case when a = 0 and b = 0 then 'free_or_silent' when b > a * 1.2::double then 'expanding' when a > b * 1.2::double then 'contracting' else 'stable' end as phrase_shape, round(a, 6) as first_density, round(b, 6) as second_density from h""")
def phrase_shape(spark, sf_dir):
    return rhythm.phrase_shapes(in_segments(spark, sf_dir))


@query(with_sql(*SEGMENTED[:-1]) + """, d as (select perf, kind, idx, round(count(*) / (hi - lo), 6) as density from located group by perf, kind, idx, lo, hi)
select perf, kind, idx, case when (idx + 0.5) * 24 / 720 >= 0.9 then 'outro_or_coda' when (idx + 0.5) * 24 / 720 <= 0.1 then 'intro_or_prelude' when density >= 5 then 'climactic_peak' when density <= 1.5 then 'sparse_break_or_interlude' else 'verse_or_chorus_candidate' end as section, density from d""")
def macro_section(spark, sf_dir):
    counted = in_segments(spark, sf_dir).groupBy("perf", "kind", "idx", "lo", "hi").agg(F.round(F.count("*") / (F.col("hi") - F.col("lo")), 6).alias("density"))
    return rhythm.macro_sections(counted, music.DURATION, music.SEGMENT)


_GRID = """base as (
  select g.perf, g.kind, g.idx, g.t, g.seq, g.vel >= vel_mean + 6 as accent, g.t - g.lo as rel,
         case when pulse > 0 then pulse / 2 else greatest(0.1, (g.hi - g.lo) / 16) end as grid, g.hi - g.lo as span
  from gaps g join pulses p using (perf, kind, idx)),
placed as (select *, least(64, greatest(8, round_even(span / grid, 0)::int)) as steps, round_even(rel / grid, 0)::int as raw from base),
marks as (select perf, kind, idx, steps, least(steps - 1, greatest(0, raw)) as step, arg_max(accent, (t, seq)) as accent from placed group by perf, kind, idx, steps, least(steps - 1, greatest(0, raw))),
every as (select distinct perf, kind, idx, steps, unnest(range(0, steps)) as step from marks),
grids as (
  select e.perf, e.kind, e.idx, e.steps, string_agg(case when m.step is null then '.' else 'x' end, '' order by e.step) as tokens, string_agg(case when m.accent then 'A' else '.' end, '' order by e.step) as accents
  from every e left join marks m on m.perf = e.perf and m.kind = e.kind and m.idx = e.idx and m.step = e.step group by e.perf, e.kind, e.idx, e.steps)"""
_GRAMS = """grams as (
  select perf, kind, idx, size, place, substr(tokens, place, size) as gram, substr(accents, place, size) as marks
  from (select *, unnest(range(1, steps - size + 2)) as place from (select *, unnest(range(3, least(12, steps) + 1)) as size from grids))
  where length(substr(tokens, place, size)) - length(replace(substr(tokens, place, size), 'x', '')) >= 2)"""


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rhythm.token_grid(rhythm.with_gaps(in_bins(spark, sf_dir)))


@query(with_sql(*BINNED, PULSES, _GRID) + "select perf, kind, idx, steps::int as steps, tokens, accents from grids")
def token_grid(spark, sf_dir):
    return grids(spark, sf_dir)


@query(with_sql(*BINNED, PULSES, _GRID, _GRAMS) + "select perf, size::int as size, gram, count(*) as n from grams group by perf, size, gram")
def motif_ngrams(spark, sf_dir):
    return rhythm.motif_ngrams(grids(spark, sf_dir)).groupBy("perf", "size", "gram").agg(F.count("*").alias("n"))


@query(with_sql(*BINNED, PULSES, _GRID, _GRAMS) + """, g as (select perf, gram, count(*) as repeats, count(distinct idx) as regions, min((idx, place)) as rel from grams group by perf, gram having count(*) >= 2)
select perf, gram, repeats, regions, rel[1]::int as first_idx, rel[2]::int as first_place, round(least(0.95, 0.25 + repeats / 6.0::double), 6) as confidence from g""")
def motif_groups(spark, sf_dir):
    return rhythm.motif_groups(rhythm.motif_ngrams(grids(spark, sf_dir)))


@query(with_sql(NOTES_SQL) + """, g as (select perf, lead(t) over (partition by perf order by t, seq) - t as gap from notes)
select perf, count(*) as n, round(quantile_cont(gap, 0.25), 6) as p25, round(quantile_cont(gap, 0.5), 6) as pulse, round(quantile_cont(gap, 0.75), 6) as p75 from g where gap > 0 group by perf""")
def performance_pulses(spark, sf_dir):
    """The median gap between the events of whole performances, and the quartiles beside it: exact, and no performance in one task."""
    near = ordered.with_next(music.notes(spark, sf_dir), ["perf"], F.floor(F.col("t") / music.WINDOW).cast("int"), ["t", "seq"], "t", "next_t")
    gaps = scratch.written(near.select("perf", (F.col("next_t") - F.col("t")).alias("gap")).where("gap > 0"), "gaps")
    found = ranks.quantiles(gaps, ["perf"], "gap", {"p25": 0.25, "pulse": 0.5, "p75": 0.75}, linear=True)
    return found.select("perf", "n", *[F.round(c, 6).alias(c) for c in ("p25", "pulse", "p75")])
