"""Queries that review other results: structural segments, rejected candidates, witnesses, benchmarks, validators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ostinato.functions.scalars import clamp01, mean6, pitch_class
from ostinato.operators import boundaries, policies, rhythm, segmentation, witnesses
from ostinato.plans import events as event_plans
from ostinato.plans import rhythm as rhythm_plans
from ostinato.plans.corpus import _HINTS, _asset_case
from ostinato.plans.events import _CANDIDATES, _CURVES, _FUSED, _METRICS, _PEAKS, _RELIABLE
from ostinato.plans.rhythm import PULSES, WINDOWED, in_segments, in_windows, located_sql
from ostinato.sources import music
from ostinato.sources.music import NOTES_SQL, SEGMENTS_SQL, with_sql

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


TARGET, SHORTEST, LONGEST, THRESHOLD = 30.0, 12.0, 45.0, 0.6
_CUTS = """f as (select perf, t, confidence, greatest(0, least(1, confidence * 0.8::double + greatest(0, least(1, features / 2.0::double)) * 0.2::double)) as tuned, members < 4 as eligible from fused),
usable as (select * from f where eligible and t between 12 and 708 and tuned >= 0.6),
cuts as (
  select perf, -1 as idx, 0.0::double as lo, 0.0::double as hi, 0.0::double as sure, 'fixed_coverage' as source, false as found from (select distinct perf from f)
  union all
  select perf, idx + 1, hi, case when 720 - hi <= 45 then 720 else coalesce(best, least(720, hi + 30)) end::double,
         case when 720 - hi <= 45 then case when found then 0.6 else 0.2 end when best is not null then tuned else 0.2 end::double,
         case when 720 - hi <= 45 then case when found then 'audio_structure' else 'fixed_coverage' end when best is not null then 'audio_structure' else 'fixed_coverage' end,
         found or best is not null
  from (select c.*, (select arg_max(u.t, (u.confidence - abs(u.t - (c.hi + 30)) / 30.0::double, -u.t)) from usable u where u.perf = c.perf and u.t between c.hi + 12 and least(720, c.hi + 45)) as best,
          (select arg_max(u.tuned, (u.confidence - abs(u.t - (c.hi + 30)) / 30.0::double, -u.t)) from usable u where u.perf = c.perf and u.t between c.hi + 12 and least(720, c.hi + 45)) as tuned
        from cuts c where c.hi < 720))"""
_STRUCTURE = "with recursive " + ",\n".join([*_CURVES, _PEAKS, _CANDIDATES, _FUSED, _CUTS])


def scored_candidates(spark, sf_dir) -> DataFrame:
    """Fused boundaries; those of four members or more stand for busy stretches and aren't eligible."""
    fused = boundaries.fused(event_plans.candidates(spark, sf_dir), 2.0)
    return fused.select("perf", "t", "confidence", segmentation.tuned(F.col("confidence"), clamp01(F.col("features") / 2.0)).alias("tuned"), (F.col("members") < 4).alias("eligible"))


@query(_STRUCTURE + "\nselect perf, idx::int as idx, lo, hi, round(sure, 6) as confidence, source from cuts where idx >= 0")
def segments_structure(spark, sf_dir):
    return segmentation.structure_segments(scored_candidates(spark, sf_dir), music.DURATION, TARGET, SHORTEST, LONGEST, THRESHOLD)


@query(_STRUCTURE + """, chosen as (select perf, hi as cut from cuts where idx >= 0 and source = 'audio_structure' and hi < 720),
near as (select f.perf, f.t, f.tuned, f.eligible, round(min(abs(f.t - c.cut)), 6) as distance from f left join chosen c on c.perf = f.perf group by f.perf, f.t, f.tuned, f.eligible)
select perf, t, round(tuned, 6) as tuned, distance, case when distance <= 1e-6 then 'accepted' when not eligible then 'unused_candidate' when not t between 12 and 708 then 'violates_min_segment_seconds' when tuned < 0.6 then 'below_threshold'
  when distance < 12 then 'too_close_to_previous_boundary' when distance > 45 then 'exceeds_max_segment_seconds_split' else 'unused_candidate' end as reason from near""")
def candidate_evaluations(spark, sf_dir):
    candidates = scored_candidates(spark, sf_dir)
    segments = segmentation.structure_segments(candidates, music.DURATION, TARGET, SHORTEST, LONGEST, THRESHOLD)
    found = segmentation.candidate_evaluations(candidates, segments, music.DURATION, SHORTEST, LONGEST, THRESHOLD)
    return found.select("perf", "t", F.round("tuned", 6).alias("tuned"), "distance", "reason")


def _witness(in_regions: DataFrame, notes: DataFrame) -> DataFrame:
    """perf, bpm (mean over regions), key (most frequent pitch class, ties to the lower), tags (dense or sparse)."""
    bpm = F.avg(F.when(F.col("pulse") > 0, 60 / F.col("pulse")).otherwise(0.0)).alias("bpm")
    tempo = rhythm.pulses(rhythm.with_gaps(in_regions)).groupBy("perf").agg(bpm, F.avg(F.col("n") / (F.col("hi") - F.col("lo"))).alias("density"))
    counted = notes.groupBy("perf", pitch_class(F.col("note")).alias("pc")).agg(F.count("*").alias("n"))
    keys = counted.groupBy("perf").agg(F.max_by("pc", F.struct(F.col("n"), -F.col("pc"))).alias("key"))
    return tempo.join(keys, "perf", "left").select("perf", "bpm", "key", F.array(F.when(F.col("density") >= 3, "dense").otherwise("sparse")).alias("tags"))


_WITNESS_SQL = """{n} as (select t.perf, bpm, key, dense from (select perf, avg(case when pulse > 0 then 60 / pulse else 0 end) as bpm, avg(n / (hi - lo)) >= 3 as dense from {pulses} group by perf) t
  left join (select perf, arg_max(pc, (n, -pc)) as key from (select perf, note % 12 as pc, count(*) as n from notes {where} group by all) group by perf) k on k.perf = t.perf)"""
_BOTH = [
    *WINDOWED,
    PULSES,
    SEGMENTS_SQL,
    located_sql("segments", "slocated"),
    rhythm_plans.gaps_sql("slocated").replace("gaps as", "sgaps as"),
    PULSES.replace("pulses as", "spulses as").replace("from gaps", "from sgaps"),
    _WITNESS_SQL.format(n="a", pulses="pulses", where=""),
    _WITNESS_SQL.format(n="b", pulses="spulses", where="where vel >= 96"),
    "j as (select coalesce(a.perf, b.perf) as perf, round(abs(a.bpm - b.bpm), 6) as delta_bpm, coalesce(a.key = b.key, false) as same_key, a.key is not null or b.key is not null as any_key, coalesce(a.dense = b.dense, false) as same_tags from a full join b on a.perf = b.perf)",
]


@query(with_sql(*_BOTH) + """select perf, delta_bpm, concat_ws(' ', case when same_tags then 'semantic_tag_overlap' end, case when delta_bpm <= 8 then 'tempo_alignment' end, case when same_key then 'tonal_alignment' end) as boosts,
  concat_ws(' ', case when not same_tags then 'semantic_tag_mismatch' end, case when delta_bpm > 8 then 'tempo_conflict' end, case when not same_key and any_key then 'tonal_conflict' end) as penalties,
  case when delta_bpm > 8 or (not same_key and any_key) then 'conflicted' when delta_bpm <= 8 or same_key or same_tags then 'supportive' else 'monitor' end as status from j""")
def witness_consensus(spark, sf_dir):
    """Windows and all notes as one witness, segments and loud notes as the other."""
    notes = music.notes(spark, sf_dir)
    found = witnesses.consensus(_witness(in_windows(spark, sf_dir), notes), _witness(in_segments(spark, sf_dir), notes.where("vel >= 96")))
    return found.select("perf", "delta_bpm", F.array_join("boosts", " ").alias("boosts"), F.array_join("penalties", " ").alias("penalties"), "status")


@query(with_sql(*_METRICS, _RELIABLE) + """select perf, count(*) as windows, count(case when status = 'success' then 1 end) as successful, 60.0::double * count(case when status = 'success' then 1 end) as represented_seconds,
  round(60.0::double * count(case when status = 'success' then 1 end) / 720, 6) as coverage, sum(case when status = 'success' then notes else 0 end)::bigint as notes, round(sum(round(score * 1e9::double)::bigint)::double / count(score) / 1e9::double, 6) as mean_score from weighted group by perf""")
def segment_benchmark(spark, sf_dir):
    """How much of a performance its successful windows stand for, and what they hold."""
    ok = F.col("status") == "success"
    seconds = music.WINDOW * F.count_if(ok)
    return event_plans.reliable_windows(spark, sf_dir).groupBy("perf").agg(
        F.count("*").alias("windows"),
        F.count_if(ok).alias("successful"),
        seconds.alias("represented_seconds"),
        F.round(seconds / music.DURATION, 6).alias("coverage"),
        F.sum(F.when(ok, F.col("notes")).otherwise(0)).alias("notes"),
        mean6(F.col("score")).alias("mean_score"),
    )


@query(with_sql(NOTES_SQL) + """, a as (select perf as role, count(*) as n from notes where seq % 2 = 0 group by perf), b as (select perf as role, count(*) as n, count(distinct channel) as c from notes where seq % 2 = 1 and vel >= 20 group by perf)
select coalesce(a.role, b.role) as role, coalesce(a.n, 0) as notes_before, coalesce(b.n, 0) as notes_after, coalesce(b.n, 0) - coalesce(a.n, 0) as delta, coalesce(b.c, 0) as channels from a full join b on a.role = b.role""")
def iteration_changes(spark, sf_dir):
    """Even events as one iteration; the louder odd ones as the next."""
    rows = music.notes(spark, sf_dir).select(F.col("perf").alias("role"), "channel", "seq", "vel")
    return witnesses.iteration_changes(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1 and vel >= 20"))


_ROLES = ", ".join(f"('{kind}', '{role}')" for role, kinds in witnesses.ROLE_KINDS for kind in kinds)


@query(f"with p as (select p_partkey, p_size, lower({_HINTS}[(p_partkey % 15 + 1)::int] || '/' || p_name) as hint from part), s as (select p_partkey as sample_id, {_asset_case(0)} as kind, {_asset_case(1)} as confidence from p), r as (select * from (values {_ROLES}) as t(kind, role)) select role, (row_number() over (partition by role order by confidence desc, sample_id))::int as rank, sample_id, kind, confidence from s join r using (kind) qualify rank <= 5")
def role_samples(spark, sf_dir):
    """The five best samples for each role: a session plan."""
    hints = F.array(*[F.lit(h) for h in _HINTS.strip("[]").replace("'", "").split(", ")])
    path = F.concat(F.get(hints, (F.col("p_partkey") % 15).cast("int")), F.lit("/"), F.col("p_name"))
    name, sure = policies.asset_class(path, F.col("p_size") / 10.0)
    return witnesses.role_samples(music.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sample_id"), name.alias("kind"), sure.alias("confidence")))


@query(f"""with m as (select *, lag(confidence) over (partition by perf, kind, idx order by rank) as before from ({rhythm_plans.ORACLES['meter_hypotheses']})),
s as (select * from ({rhythm_plans.ORACLES['pulse_stability']})), e as (select *, lag(hi) over (partition by perf order by idx) as before from ({event_plans.ORACLES['segments_energy']}))
select 'meter_time' as validator, count(*) as checked, count(case when confidence not between 0 and 1 or (confidence < 0.35 and meter <> 'undetermined') or before < confidence then 1 end) as violations from m
union all select 'rhythm', count(*), count(case when pulse_stability not between 0 and 1 then 1 end) from s
union all select 'segments', count(*), count(case when hi <= lo or hi - lo > 45 or lo <> coalesce(before, 0) then 1 end) from e""")
def validators_features(spark, sf_dir):
    """What each validator checked, and how many rows break its rules."""
    lag = lambda c, order, *keys: F.lag(c).over(Window.partitionBy(*keys).orderBy(order))
    counted = lambda df, name, bad: df.agg(F.count("*").alias("checked"), F.count_if(bad).alias("violations")).select(F.lit(name).alias("validator"), "checked", "violations")
    meters = rhythm.meter_hypotheses(rhythm.with_gaps(in_windows(spark, sf_dir))).withColumn("before", lag("confidence", "rank", "perf", "kind", "idx"))
    c = F.col("confidence")
    meter = counted(meters, "meter_time", ~c.between(0, 1) | ((c < 0.35) & (F.col("meter") != "undetermined")) | (F.col("before") < c))
    stable = counted(rhythm_plans.pulse_stability(spark, sf_dir), "rhythm", ~F.col("pulse_stability").between(0, 1))
    parts = event_plans.segments_energy(spark, sf_dir).withColumn("before", F.coalesce(lag("hi", "idx", "perf"), F.lit(0.0)))
    segments = counted(parts, "segments", (F.col("hi") <= F.col("lo")) | (F.col("hi") - F.col("lo") > 45) | (F.col("lo") != F.col("before")))
    return meter.unionByName(stable).unionByName(segments)
