"""Queries on note events, windows, boundaries and runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ostinato.functions.scalars import mean6
from ostinato.operators import boundaries, events, intervals
from ostinato.plans.rhythm import in_windows, located_sql
from ostinato.sources import music
from ostinato.sources.music import BINS_SQL, CURVE_SQL, NOTES_SQL, PERFS_SQL, SEGMENTS_SQL, WINDOWS_SQL, with_sql

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def messages(spark, sf_dir):
    """Some event types switch notes on, the others off, for each user as a channel and a note class."""
    on = F.col("perf").isin("click", "view", "signup")
    return music.notes(spark, sf_dir).select(F.lit("all").alias("perf"), "channel", F.pmod("note", F.lit(4)).alias("note"), "seq", "t", "vel", F.when(on, 1).otherwise(-1).alias("delta"))


_MESSAGES = "messages as (select channel, note % 4 as note, seq, t, vel, case when perf in ('click', 'view', 'signup') then 1 else -1 end as delta from notes)"
_PAIRS = """run as (select *, sum(delta) over w as s from messages window w as (partition by channel, note order by t, seq rows unbounded preceding)),
queued as (select *, s - least(0, min(s) over (partition by channel, note order by t, seq rows unbounded preceding)) as q from run),
before as (select *, coalesce(lag(q) over (partition by channel, note order by t, seq), 0) as b from queued),
ons as (select channel, note, vel, t, row_number() over (partition by channel, note order by t, seq) as k from before where delta > 0),
offs as (select channel, note, t, row_number() over (partition by channel, note order by t, seq) as k from before where delta < 0 and b > 0),
pairs as (select o.channel, o.note, o.vel, o.t as start, greatest(f.t, o.t + 0.0001::double) as "end" from ons o join offs f using (channel, note, k))"""


@query(with_sql(NOTES_SQL, _MESSAGES, _PAIRS) + 'select channel, note, vel, round(start, 6) as start, round("end", 6) as "end" from pairs')
def note_on_off_pairs(spark, sf_dir):
    return events.pair_on_off(messages(spark, sf_dir)).select("channel", "note", "vel", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(with_sql(NOTES_SQL, _MESSAGES, _PAIRS) + 'select note, count(*) as n, round(sum(round(("end" - start) * 1e9::double)::bigint)::double / count(("end" - start)) / 1e9::double, 6) as mean_length, round(max("end" - start), 6) as longest from pairs group by note')
def note_duration_metrics(spark, sf_dir):
    length = F.col("end") - F.col("start")
    return events.pair_on_off(messages(spark, sf_dir)).groupBy("note").agg(F.count("*").alias("n"), mean6(length).alias("mean_length"), F.round(F.max(length), 6).alias("longest"))


@query(with_sql(NOTES_SQL, _MESSAGES) + "select channel, note, seq, round_even((t - coalesce(lag(t) over (partition by channel order by t, delta, seq), 0)) * 480 * 1e6 / 500000, 0)::bigint as ticks from messages")
def delta_ticks(spark, sf_dir):
    return events.delta_ticks(messages(spark, sf_dir)).select("channel", "note", "seq", "ticks")


_METRICS = [NOTES_SQL, PERFS_SQL, WINDOWS_SQL, located_sql("windows"), """gaps as (select *, lead(t) over (partition by perf, idx order by t, seq) - t as gap from located)""", """metrics as (
  select perf, idx, count(*) as notes, round(count(*) / greatest(0.001, max(t - lo)), 6) as density, round(count(case when gap <= 0.06 then 1 end) / greatest(1, count(*) - 1)::double, 6) as polyphony,
         round(coalesce(count(case when gap >= 0.5 then 1 end)::double / nullif(count(case when gap > 0 then 1 end), 0), 0), 6) as silence from gaps group by perf, idx)"""]
_RELIABLE = """scored as (select *, case when idx % 6 = 5 then 'failed' else 'success' end as status, case when idx % 6 = 5 then 0.0 else round(least(1.0, 0.45 + case when notes >= 12 then 0.2 when notes >= 4 then 0.1 else 0 end
    + case when density between 0.4 and 15 then 0.15 else 0 end + case when silence <= 0.75 then 0.1 else 0 end + case when notes * 8 >= 256 then 0.1 else 0 end), 6) end::double as score from metrics),
reliable as (select *, case when status <> 'success' then 'failed' when score >= 0.8 then 'high' when score >= 0.55 then 'medium' else 'low' end as tier from scored),
weighted as (select *, case tier when 'high' then 1.0 when 'medium' then 0.7 when 'low' then 0.35 else 0.0 end::double as weight from reliable)"""


def reliable_windows(spark, sf_dir):
    """Every sixth window counts as failed; eight bytes a note stand for the file size."""
    metrics = events.window_metrics(in_windows(spark, sf_dir), ["perf", "idx"])
    status = F.when(F.col("idx") % 6 == 5, "failed").otherwise("success")
    return events.reliability(metrics.withColumn("status", status), F.col("status"), F.col("notes") * 8)


@query(with_sql(*_METRICS, _RELIABLE) + "select perf, idx, notes, density, polyphony, silence, score, tier, weight from weighted")
def reliability_tier(spark, sf_dir):
    return reliable_windows(spark, sf_dir).select("perf", "idx", "notes", "density", "polyphony", "silence", "score", "tier", "weight")


_CONTEXT = [NOTES_SQL, PERFS_SQL, WINDOWS_SQL, f"context as (select w.perf, w.idx, w.lo, w.hi, greatest(0, lo - {music.CONTEXT}) as ctx_lo, least({music.DURATION}, hi + {music.CONTEXT}) as ctx_hi, n.seq, n.t, n.note, n.vel from windows w join notes n on n.perf = w.perf and n.t between greatest(0, w.lo - {music.CONTEXT}) and least({music.DURATION}, w.hi + {music.CONTEXT}))"]


def in_context(spark, sf_dir):
    return intervals.points_in(music.notes(spark, sf_dir), music.windows(spark, sf_dir), music.WINDOW, lo="ctx_lo", hi="ctx_hi")


@query(with_sql(*_CONTEXT) + "select perf, idx, seq, note, round(t - ctx_lo, 6) as local, round(t, 6) as at from context where t between lo and hi".replace(" as at", ' as "at"'))
def stitched_timeline(spark, sf_dir):
    return events.stitched(in_context(spark, sf_dir)).select("perf", "idx", "seq", "note", F.round("local", 6).alias("local"), F.round("at", 6).alias("at"))


@query(with_sql(*_CONTEXT) + "select perf, idx, count(*) as events, count(case when t between lo and hi then 1 end) as kept, count(case when not t between lo and hi then 1 end) as trimmed from context group by perf, idx")
def stitch_report(spark, sf_dir):
    return events.stitch_report(in_context(spark, sf_dir))


@query(with_sql(NOTES_SQL) + "select perf, seq, least(127, greatest(0, note + 7)) as note, least(127, vel) as vel, round(t * 1.5::double, 6) as t from notes where seq % 3 = 0")
def event_transforms(spark, sf_dir):
    """Transposed by a fifth, every third event, at two thirds of the tempo."""
    moved = events.thinned(events.transposed(music.notes(spark, sf_dir), 7), F.col("seq"), 3)
    return moved.select("perf", "seq", "note", F.least(F.lit(127), F.col("vel")).alias("vel"), F.round(F.col("t") * 1.5, 6).alias("t"))


_NORM = "norm as (select *, case when max(value) over w - min(value) over w > 1e-9 then (value - min(value) over w) / (max(value) over w - min(value) over w) else 0 end as norm from curve window w as (partition by perf))"
_CURVES = [NOTES_SQL, PERFS_SQL, CURVE_SQL, _NORM]
_PEAKS = "peaks as (select * from (select *, lag(norm) over w as prev, lead(norm) over w as next from norm window w as (partition by perf order by frame)) where norm >= 0.55 and norm >= prev and norm >= next)"


def normal_curve(spark, sf_dir):
    return boundaries.normalised(music.curve(spark, sf_dir))


def peaks(spark, sf_dir):
    return boundaries.local_peaks(normal_curve(spark, sf_dir), 0.55)


@query(with_sql(*_CURVES) + "select perf, frame, round(norm, 6) as norm, round(coalesce(abs(norm - lag(norm) over (partition by perf order by frame)), 0), 6) as change from norm")
def curve_normalize_derivative(spark, sf_dir):
    return boundaries.derivative(normal_curve(spark, sf_dir)).select("perf", "frame", F.round("norm", 6).alias("norm"), F.round("change", 6).alias("change"))


@query(with_sql(*_CURVES, _PEAKS) + "select perf, frame, round(norm, 6) as norm from peaks")
def local_peaks(spark, sf_dir):
    return peaks(spark, sf_dir).select("perf", "frame", F.round("norm", 6).alias("norm"))


@query("with recursive " + ",\n".join([*_CURVES, _PEAKS, """taken as (
  select perf, min(frame) as frame from peaks group by perf
  union all
  select t.perf, (select min(p.frame) from peaks p where p.perf = t.perf and p.frame >= t.frame + 12) as frame from taken t where frame is not null)"""]) + "\nselect perf, frame from taken where frame is not null")
def peak_pick_refractory(spark, sf_dir):
    return boundaries.refractory(peaks(spark, sf_dir), 12)


_CANDIDATES = """candidates as (
  select perf, frame::double as t, round(norm, 6) as confidence, 'level' as feature from peaks
  union all select perf, frame::double, round(change, 6), 'change' from (select *, coalesce(abs(norm - lag(norm) over (partition by perf order by frame)), 0) as change from norm) where change >= 0.4)"""
_FUSED = """marked as (select *, case when t - lag(t) over w > 2 then 1 when lag(t) over w is null then 1 else 0 end as new from candidates window w as (partition by perf order by t, feature)),
islands as (select *, sum(new) over (partition by perf order by t, feature rows unbounded preceding) as island from marked),
fused as (select perf, island, arg_max(t, (confidence, -t)) as t, round(least(1.0, max(confidence) + 0.04::double * (count(distinct feature) - 1)), 6) as confidence, count(distinct feature) as features, count(*) as members from islands group by perf, island)"""


def candidates(spark, sf_dir):
    level = peaks(spark, sf_dir).select("perf", F.col("frame").cast("double").alias("t"), F.round("norm", 6).alias("confidence"), F.lit("level").alias("feature"))
    change = boundaries.derivative(normal_curve(spark, sf_dir)).where("change >= 0.4")
    return level.unionByName(change.select("perf", F.col("frame").cast("double").alias("t"), F.round("change", 6).alias("confidence"), F.lit("change").alias("feature")))


@query(with_sql(*_CURVES, _PEAKS, _CANDIDATES, _FUSED) + "select perf, island::bigint as island, t, confidence, features, members from fused")
def fused_boundaries(spark, sf_dir):
    return boundaries.fused(candidates(spark, sf_dir), 2.0)


@query("with recursive " + ",\n".join([*_CURVES, _PEAKS, _CANDIDATES, _FUSED, """sorted as (select perf, t, confidence, row_number() over (partition by perf order by confidence desc, t) as k from fused),
walk as (
  select perf, 1::bigint as k, [t] as taken, [confidence] as sure from sorted where k = 1
  union all
  select s.perf, s.k, case when len(w.taken) < 20 and len(list_filter(w.taken, lambda x: abs(x - s.t) < 15)) = 0 then list_append(w.taken, s.t) else w.taken end,
         case when len(w.taken) < 20 and len(list_filter(w.taken, lambda x: abs(x - s.t) < 15)) = 0 then list_append(w.sure, s.confidence) else w.sure end
  from walk w join sorted s on s.perf = w.perf and s.k = w.k + 1),
done as (select * from walk qualify row_number() over (partition by perf order by k desc) = 1)"""]) + "\nselect perf, i::int as rank, taken[i] as t, sure[i] as confidence from (select *, unnest(range(1, len(taken) + 1)) as i from done)")
def boundary_nms(spark, sf_dir):
    return boundaries.greedy_choice(boundaries.fused(candidates(spark, sf_dir), 2.0), 15.0, 20)


@query(with_sql(NOTES_SQL, PERFS_SQL) + "select perf, i::int as idx, (i * 25)::double as lo, least(720, (i + 1) * 25)::double as hi from perfs, unnest(range(0, 29)) as r(i)")
def segments_fixed(spark, sf_dir):
    parts = music.performances(spark, sf_dir).select("perf", F.explode(boundaries.fixed_segments(F.lit(music.DURATION), 25.0)).alias("s"))
    return parts.select("perf", "s.idx", F.col("s.lo").cast("double").alias("lo"), F.col("s.hi").cast("double").alias("hi"))


@query("with recursive " + ",\n".join([*_CURVES, _PEAKS, _CANDIDATES, _FUSED, """cuts as (
  select perf, -1 as idx, 0.0::double as lo, 0.0::double as hi, '' as reason from (select distinct perf from fused)
  union all
  select perf, idx + 1, hi, case when 720 - hi <= 45 then 720 else coalesce(best, least(720, hi + 30)) end::double,
         case when 720 - hi <= 45 then case when 720 - hi > 30 then 'max_window_split' else 'low_energy_boundary' end when best is not null then 'low_energy_boundary' else 'uncertain_fallback' end
  from (select c.*, (select arg_min(f.t, (abs(f.t - (c.hi + 30)), f.t)) from fused f where f.perf = c.perf and f.t >= 12 and f.t <= 708 and f.t between c.hi + 12 and least(720, c.hi + 45)) as best from cuts c where c.hi < 720))"""]) + "\nselect perf, idx::int as idx, round(lo, 6) as lo, round(hi, 6) as hi, reason from cuts where idx >= 0")
def segments_energy(spark, sf_dir):
    fused = boundaries.fused(candidates(spark, sf_dir), 2.0)
    return boundaries.greedy_segments(fused, music.DURATION, target=30.0, shortest=12.0, longest=45.0)


@query(with_sql(NOTES_SQL, PERFS_SQL, SEGMENTS_SQL) + "select perf, printf('seg_%04d', idx) as segment_id, case when idx > 0 then printf('seg_%04d', idx - 1) end as previous_id, case when idx < 29 then printf('seg_%04d', idx + 1) end as next_id, lo, hi from segments")
def segment_graph_edges(spark, sf_dir):
    return boundaries.linked(music.segments(spark, sf_dir).select("perf", "lo", "hi"))


@query(with_sql(*_CURVES, _PEAKS, _CANDIDATES, _FUSED, SEGMENTS_SQL) + "select f.perf, f.t, min(least(abs(f.t - s.lo), abs(f.t - s.hi))) as distance from fused f join segments s using (perf) group by f.perf, f.t")
def nearest_segment_boundary(spark, sf_dir):
    """Segments have one width, so the nearest edge of any is that of the segment that holds the point."""
    fused = boundaries.fused(candidates(spark, sf_dir), 2.0).select("perf", "t")
    held = intervals.points_in(fused, music.segments(spark, sf_dir), music.SEGMENT)
    return held.groupBy("perf", "t").agg(F.min(F.least(F.col("t") - F.col("lo"), F.col("hi") - F.col("t"))).alias("distance"))


@query("""select user_id, count(*) as runs, arg_max(event_type, (ts, event_id)) as status, min(event_id) as first_run, max(event_id) as last_run from events group by user_id""")
def run_history_latest(spark, sf_dir):
    """Events as a log of runs: each user's runs, and the status of the latest."""
    log = music.table(spark, sf_dir, "events")
    return log.groupBy("user_id").agg(F.count("*").alias("runs"), F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.min("event_id").alias("first_run"), F.max("event_id").alias("last_run"))


@query(with_sql(*_METRICS, _RELIABLE) + "select perf, idx, tier, (row_number() over (partition by perf order by idx))::int as turn, row_number() over (partition by perf order by idx) <= 5 as scheduled from weighted where tier <> 'high'")
def resumable_budget(spark, sf_dir):
    """Windows still to do, the first five of each performance scheduled now."""
    turn = F.row_number().over(Window.partitionBy("perf").orderBy("idx"))
    left = reliable_windows(spark, sf_dir).where("tier <> 'high'").withColumn("turn", turn)
    return left.select("perf", "idx", "tier", "turn", (F.col("turn") <= 5).alias("scheduled"))


@query(with_sql(NOTES_SQL, PERFS_SQL, BINS_SQL, SEGMENTS_SQL) + "select b.perf, b.idx, s.idx as segment from bins b join (select perf, idx, lo, lo + 4.1::double as hi from segments) s on s.perf = b.perf and abs(b.lo - s.lo) <= 0.15 + 1e-9 and abs(b.hi - s.hi) <= 0.15 + 1e-9")
def band_join_records(spark, sf_dir):
    """Bins whose start and end are within .15 s of the head of a segment."""
    heads = music.segments(spark, sf_dir).select("perf", F.col("idx").alias("segment"), F.col("lo").alias("r_lo"), (F.col("lo") + 4.1).alias("r_hi"))
    return intervals.near_equal(music.bins(spark, sf_dir), heads, 0.15).select("perf", "idx", "segment")


@query(with_sql(NOTES_SQL, _MESSAGES, _PAIRS, WINDOWS_SQL.replace("from perfs", "from (select 'all' as perf) p")) + 'select idx, count(*) as notes, round(sum(least(hi, "end") - greatest(lo, start)), 6) as sounding from windows join pairs on "end" >= lo and start <= hi group by idx')
def note_interval_overlap(spark, sf_dir):
    """Notes as intervals against windows, closed at both ends."""
    notes = events.pair_on_off(messages(spark, sf_dir)).select(F.col("perf"), F.col("start").alias("r_lo"), F.col("end").alias("r_hi"))
    one = music.tiled(spark.createDataFrame([("all",)], "perf string"), music.WINDOW, "window")
    found = intervals.overlapping(one, notes, music.WINDOW)
    return found.groupBy("idx").agg(F.count("*").alias("notes"), F.round(F.sum("overlap"), 6).alias("sounding"))
