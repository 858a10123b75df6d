"""Queries of the selections. Runs, windows, files and batches are made of orders and line items; such stand-ins are inputs only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ostinato.functions.scalars import mean6, pitch_class_name
from ostinato.operators import intervals, rhythm, selections
from ostinato.operators import records as record_operators
from ostinato.plans import reviews
from ostinato.plans.harmony import _CHORDS, _NAMES, timeline
from ostinato.plans.records import _SMALL_VECTOR, _STATES, _TAGS, states, vectors
from ostinato.plans.rhythm import BINNED, PULSES, WINDOWED, in_bins, in_windows
from ostinato.sources import json_walk, music
from ostinato.sources.music import NOTES_SQL, PERFS_SQL, WINDOWS_SQL, with_sql

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def run_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stand-ins: a run per customer, a window per order, files of both."""
    runs = music.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run"), F.expr("case when c_custkey % 3 = 0 then ' ' when c_custkey % 3 = 1 then concat(' m/', c_custkey) end").alias("active"), F.expr("case when c_custkey % 2 = 0 then concat('m/', c_custkey) end").alias("legacy"))
    windows = music.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("window_id"), F.expr("case o_orderstatus when 'F' then 'success' when 'O' then 'pending' end").alias("status"), F.expr("case when o_orderkey % 5 = 0 then ' ' else concat('w/', o_orderkey) end").alias("path"))
    files = music.table(spark, sf_dir, "lineitem").where("l_linenumber = 2").select(F.expr("concat('w/', l_orderkey)").alias("path")).unionByName(runs.where("run % 4 = 0").select(F.expr("concat('m/', run)").alias("path")))
    return runs.select("run", selections.path_or(F.col("active"), F.col("legacy")).alias("merged")), windows, files


_RUNS = """runs as (select c_custkey as run, coalesce(nullif(trim(case when c_custkey % 3 = 0 then ' ' when c_custkey % 3 = 1 then ' m/' || c_custkey end), ''), nullif(trim(case when c_custkey % 2 = 0 then 'm/' || c_custkey end), '')) as merged from customer),
files as (select distinct 'w/' || l_orderkey as path from lineitem where l_linenumber = 2 union select 'm/' || c_custkey from customer where c_custkey % 4 = 0),
good as (select o_custkey as run, o_orderkey as window_id, 'w/' || o_orderkey as path from orders where o_orderstatus = 'F' and o_orderkey % 5 <> 0 and 'w/' || o_orderkey in (select path from files))"""


@query(with_sql(_RUNS) + "select run, merged as path from runs")
def active_paths(spark, sf_dir):
    return run_tables(spark, sf_dir)[0].select("run", F.col("merged").alias("path"))


@query(with_sql(_RUNS) + "select run, window_id, path from good")
def successful_windows(spark, sf_dir):
    _, windows, files = run_tables(spark, sf_dir)
    return selections.successful_windows(windows, files).select("run", "window_id", "path")


@query(with_sql(_RUNS) + """, m as (select run, merged from runs where merged in (select path from files))
select run, 'merged' as mode, merged as path, null::bigint as window_id, null::varchar as limitation from m
union all select r.run, case when g.path is null then 'no_midi' else 'window_fallback' end, g.path, g.window_id, case when g.path is null then 'no merged file and no successful window' else 'merged file missing; window files stand for it' end
from (select run from runs where run not in (select run from m)) r left join good g on g.run = r.run""")
def midi_source_selection(spark, sf_dir):
    return selections.midi_sources(*run_tables(spark, sf_dir)).select("run", "mode", "path", "window_id", "limitation")


@query("""with c as (select o_custkey as source, o_orderkey as run_id, case o_orderpriority when '1-URGENT' then 'latest' when '2-HIGH' then 'legacy' else 'run' end as pointer from orders)
select source, pointer, run_id, count(*) over (partition by source) as candidates from c qualify row_number() over (partition by source order by case pointer when 'latest' then 0 when 'legacy' then 1 else 2 end, run_id desc) = 1""")
def latest_analysis(spark, sf_dir):
    pointer = F.expr("case o_orderpriority when '1-URGENT' then 'latest' when '2-HIGH' then 'legacy' else 'run' end")
    return selections.latest_pointed(music.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), pointer.alias("pointer"), F.col("o_orderkey").alias("run_id")))


@query("""select l_returnflag as flag, count(*) as n, count(case when l_linenumber <> 4 and l_linenumber <> 6 and l_tax >= l_discount then 1 end) as valid from lineitem group by l_returnflag""")
def time_range_validity(spark, sf_dir):
    """Ends are texts, some of them no numbers and some missing."""
    start = F.when(F.col("l_linenumber") == 4, "soon").otherwise(F.col("l_discount").cast("string"))
    end = F.when(F.col("l_linenumber") != 6, F.col("l_tax").cast("string"))
    return music.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), F.count_if(selections.range_valid(start, end)).alias("valid"))


@query("select source, count(*) as n, count(case when len(string_split(text, chr(10))) > 1 then 1 end) as with_more_lines from documents group by source")
def filled_field_counts(spark, sf_dir):
    more = F.filter(F.split("text", "\n"), lambda x, i: i > 0)
    return music.table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), selections.filled_count(more).alias("with_more_lines"))


def field_records(spark, sf_dir) -> DataFrame:
    """Stand-ins: bins as records, of which some miss fields and some carry weak ones and ones to review."""
    s = states(spark, sf_dir)
    some = lambda n, c: F.when(F.col("idx") % n == 0, c)
    return s.select("perf", "idx", F.col("lo").alias("start_seconds"), F.col("hi").alias("end_seconds"), F.col("notes").alias("note_on_count"), F.col("poly").alias("polyphonic_density"), some(3, F.col("chord")).alias("chord_candidates"), some(7, F.lit("x")).alias("mismatch_reasons"), some(5, F.col("state_confidence")).alias("hidden_score"))


@query(with_sql(*_STATES) + """select perf, idx, 'end_seconds,note_on_count,polyphonic_density,start_seconds' as kept,
concat_ws(',', case when idx % 3 = 0 then 'chord_candidates' end, case when idx % 5 = 0 then 'hidden_score' end, case when idx % 7 = 0 then 'mismatch_reasons' end) as excluded from states""")
def accepted_field_projection(spark, sf_dir):
    return selections.whitelisted(field_records(spark, sf_dir), ["perf", "idx"], selections.ACCEPTED_FIELDS)


@query(with_sql(*_STATES) + """select perf, idx, 4 as accepted, (idx % 3 = 0)::int as weak, (idx % 7 = 0)::int as review,
case when idx % 7 = 0 then 'review_required' when idx % 3 = 0 then 'weak_label' else 'accepted_observation' end as trust from states""")
def field_trust(spark, sf_dir):
    return selections.field_trust(field_records(spark, sf_dir), ["perf", "idx"])


_BY_WINDOW = 'case when idx % 4 = 3 then null else floor(lo / 60)::int end as "window"'


def windowed_chords(spark, sf_dir) -> DataFrame:
    """Chords of bins with the window that they name; each fourth names none."""
    return timeline(spark, sf_dir).select("perf", "idx", "lo", "root", F.when(F.col("idx") % 4 != 3, F.floor(F.col("lo") / 60).cast("int")).alias("window"))


@query(with_sql(*BINNED[:-1], _CHORDS) + f""", c as (select perf, idx, root, {_BY_WINDOW} from chords),
h as (select coalesce(perf || '/' || "window", 'None') as k, arg_max(root, idx * 100000 + ascii(perf) * 100 + length(perf)) as root from c group by 1)
select c.perf, c.idx, h.root as harmony_root from c left join h on h.k = coalesce(c.perf || '/' || c."window", 'None')""")
def harmony_last_wins(spark, sf_dir):
    """A bin takes the root of the last chord that names its window; all that name none share the last of these."""
    c = windowed_chords(spark, sf_dir).withColumn("key", F.expr("perf || '/' || window"))
    order = F.expr("idx * 100000 + ascii(perf) * 100 + length(perf)")
    return selections.last_wins(c.select("perf", "idx", "key"), c.select("key", F.col("root").alias("harmony_root"), order.alias("seq")), "key", "seq", "harmony_root").drop("key")


_TWO_KINDS = [NOTES_SQL, PERFS_SQL, WINDOWS_SQL, BINNED[2], """regions as (select * from windows union all select * from bins), located as (select b.perf, b.kind, b.idx, b.lo, b.hi, n.seq, n.t, n.note, n.vel from regions b join notes n on n.perf = b.perf and n.t between b.lo and b.hi)""", _CHORDS]


@query(with_sql(*_TWO_KINDS) + """, r as (select perf, kind, idx, root, floor(lo / 60)::int as w, (lo * 10)::bigint * 2 + (kind = 'bin')::int as seq from chords),
h as (select * from r where (kind = 'window' and idx % 2 = 0) or (kind = 'bin' and idx % 30 < 3))
select r.perf, r.kind, r.idx, h.root as harmony_root from r left join h on h.perf = r.perf and h.w = r.w qualify row_number() over (partition by r.perf, r.kind, r.idx order by (h.kind = r.kind)::int desc nulls last, h.seq) = 1""")
def rhythm_with_harmony(spark, sf_dir):
    """Regions with the chord of their window: of their own kind if there is one, else the first."""
    from ostinato.operators import harmony

    located = intervals.points_in(music.notes(spark, sf_dir), music.bins(spark, sf_dir).unionByName(music.windows(spark, sf_dir).drop("ctx_lo", "ctx_hi")), music.WINDOW)
    seq = (F.col("lo") * 10).cast("long") * 2 + (F.col("kind") == "bin").cast("int")
    r = harmony.chords(located).select("perf", "kind", "idx", F.col("root").alias("harmony_root"), F.floor(F.col("lo") / 60).cast("int").alias("w"), seq.alias("seq"))
    h = r.where("(kind = 'window' and idx % 2 = 0) or (kind = 'bin' and idx % 30 < 3)")
    return selections.same_kind_first(r.select("perf", "kind", "idx", "w"), h, ["perf", "w"], ["perf", "kind", "idx"], "seq", "harmony_root")


@query(with_sql(*WINDOWED, PULSES, _SMALL_VECTOR, _TAGS, BINNED[2]) + """, met as (select b.perf, b.idx, tag, max(tag_confidence) as sure from bins b join windows w on w.perf = b.perf and w.hi >= b.lo and w.lo <= b.hi join tags t on t.perf = w.perf and t.idx = w.idx group by all),
ranked as (select *, row_number() over (partition by perf, idx order by sure desc, tag) as nth from met)
select perf, idx, count(*) as tags, string_agg(tag, ',' order by nth) as top_tags from ranked where nth <= 5 group by perf, idx""")
def record_tags(spark, sf_dir):
    """The five surest tags of the windows that a bin touches."""
    found = record_operators.tagged(vectors(spark, sf_dir)).select("perf", F.col("idx").alias("window"), "tag", F.col("tag_confidence").alias("sure"))
    windows = music.windows(spark, sf_dir).select("perf", F.col("idx").alias("window"), F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi"))
    met = intervals.overlapping(music.bins(spark, sf_dir).select("perf", "idx", "lo", "hi"), windows, music.WINDOW).join(found, ["perf", "window"])
    return selections.top_tags(met, ["perf", "idx"], 5)


@query(with_sql(*BINNED[:-1], _CHORDS, WINDOWS_SQL) + """, slices as (select perf, idx as seq, lo, hi, root from chords where idx >= 40 and idx % 25 < 5),
f as (select perf, root from slices qualify row_number() over (partition by perf order by seq) = 1)
select w.perf, w.idx, coalesce(s.root, f.root) as root, s.root is not null as overlaps from windows w left join slices s on s.perf = w.perf and s.hi >= w.lo and s.lo <= w.hi left join f on f.perf = w.perf
qualify row_number() over (partition by w.perf, w.idx order by s.seq) = 1""")
def slice_pick(spark, sf_dir):
    """A window takes the first slice that it touches, else the performance's first."""
    slices = timeline(spark, sf_dir).where("idx >= 40 and idx % 25 < 5").select("perf", F.col("idx").alias("seq"), F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi"), "root")
    windows = music.windows(spark, sf_dir).select("perf", "idx", "lo", "hi")
    return selections.first_overlap_or_first(windows, intervals.overlapping(windows, slices, music.WINDOW), slices, ["idx"], "root")


@query(with_sql(NOTES_SQL, PERFS_SQL, WINDOWS_SQL, WINDOWED[3], WINDOWED[4]) + """select perf, idx, count(*) as note_on_count, round(sum(vel)::double / count(*), 6) as mean_velocity, round(coalesce(quantile_cont(case when gap > 0 then gap end, 0.5), 0), 6) as median_ioi_seconds,
round(case when quantile_cont(case when gap > 0 then gap end, 0.5) > 0 then 60 / quantile_cont(case when gap > 0 then gap end, 0.5) else 0 end, 6) as estimated_bpm, round(max(t) - min(t), 6) as duration_seconds,
round(case when max(t) > min(t) then count(*) / (max(t) - min(t)) else count(*) end, 6) as note_density_per_second from gaps group by perf, idx""")
def simple_rhythm_features(spark, sf_dir):
    """Counts, median gap and tempo of a window, from its notes alone."""
    gaps = rhythm.with_gaps(in_windows(spark, sf_dir))
    length = F.max("t") - F.min("t")
    median = F.coalesce(F.percentile(F.when(F.col("gap") > 0, F.col("gap")), 0.5), F.lit(0.0))
    base = gaps.groupBy("perf", "idx").agg(F.count("*").alias("note_on_count"), F.round(F.sum("vel") / F.count("*"), 6).alias("mean_velocity"), median.alias("m"), length.alias("length"))
    n, m, length = F.col("note_on_count"), F.col("m"), F.col("length")
    return base.select("perf", "idx", "note_on_count", "mean_velocity", F.round(m, 6).alias("median_ioi_seconds"), F.round(F.when(m > 0, 60 / m).otherwise(0.0), 6).alias("estimated_bpm"), F.round(length, 6).alias("duration_seconds"), F.round(F.when(length > 0, n / length).otherwise(n.cast("double")), 6).alias("note_density_per_second"))


@query(with_sql(*BINNED[:-1], _CHORDS) + f""", k as (select perf, idx, n, h, list_position(h, list_max(h)) - 1 as tonic from hist),
m as (select *, h[(tonic + 4) % 12 + 1] as major, h[(tonic + 3) % 12 + 1] as minor, h[(tonic + 7) % 12 + 1] as fifth from k)
select perf, idx, n as note_on_count, len(list_filter(h, lambda x: x > 0))::int as unique_pitch_classes, {_NAMES}[tonic + 1] as estimated_key, case when major >= minor then 'major' else 'minor' end as estimated_mode, round((greatest(major, minor) + fifth) / n::double, 6) as triad_match_score from m""")
def simple_harmony_features(spark, sf_dir):
    """Tonic as the most frequent pitch class, mode by its thirds."""
    hist = F.array(*[F.count_if(F.pmod("note", F.lit(12)) == i) for i in range(12)])
    tonic = (F.array_position("h", F.array_max("h")) - 1).cast("int")
    base = in_bins(spark, sf_dir).groupBy("perf", "idx").agg(hist.alias("h"), F.count("*").alias("n")).withColumn("tonic", tonic)
    at = lambda step: F.get("h", (F.col("tonic") + step) % 12)
    return base.select("perf", "idx", F.col("n").alias("note_on_count"), F.size(F.filter("h", lambda x: x > 0)).alias("unique_pitch_classes"), pitch_class_name(F.col("tonic")).alias("estimated_key"), F.when(at(4) >= at(3), "major").otherwise("minor").alias("estimated_mode"), F.round((F.greatest(at(4), at(3)) + at(7)) / F.col("n"), 6).alias("triad_match_score"))


_EVALUATED = reviews.ORACLES["candidate_evaluations"].rpartition("select perf, t,")
_EVALUATIONS = _EVALUATED[0].rstrip() + ", evaluated as (select perf, t," + _EVALUATED[2] + ")"


@query(_EVALUATIONS + """ select perf, count(*) as candidates, min(tuned) as candidate_min, max(tuned) as candidate_max, round(sum(round(tuned * 1e9::double)::bigint)::double / count(tuned) / 1e9::double, 6) as candidate_mean,
min(case when reason = 'accepted' then tuned end) as accepted_min, max(case when reason = 'accepted' then tuned end) as accepted_max from evaluated group by perf""")
def candidate_confidence(spark, sf_dir):
    accepted = F.when(F.col("reason") == "accepted", F.col("tuned"))
    return reviews.candidate_evaluations(spark, sf_dir).groupBy("perf").agg(F.count("*").alias("candidates"), F.min("tuned").alias("candidate_min"), F.max("tuned").alias("candidate_max"), mean6(F.col("tuned")).alias("candidate_mean"), F.min(accepted).alias("accepted_min"), F.max(accepted).alias("accepted_max"))


@query(_EVALUATIONS + " select perf, reason, count(*) as n from evaluated group by perf, reason")
def rejection_reason_counts(spark, sf_dir):
    return reviews.candidate_evaluations(spark, sf_dir).groupBy("perf", "reason").agg(F.count("*").alias("n"))


@query(_EVALUATIONS + " select perf, t, tuned, reason, (row_number() over w)::int as rank from evaluated where reason <> 'accepted' window w as (partition by perf order by tuned desc, t) qualify row_number() over w <= 10")
def rejected_candidates_top(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("perf").orderBy(F.desc("tuned"), "t"))
    return reviews.candidate_evaluations(spark, sf_dir).where("reason <> 'accepted'").withColumn("rank", rank).where("rank <= 10").select("perf", "t", "tuned", "reason", "rank")


@query(with_sql(*BINNED, PULSES) + """, d as (select perf, idx, round(n / (hi - lo), 6) as density from pulses)
select perf, 'most' as "end", (row_number() over w)::int as rank, idx, density from d window w as (partition by perf order by density desc, idx) qualify row_number() over w <= 5
union all select perf, 'least', (row_number() over w)::int, idx, density from d window w as (partition by perf order by density, idx) qualify row_number() over w <= 5""")
def region_extremes(spark, sf_dir):
    """The five densest and the five sparsest bins of a performance."""
    d = in_bins(spark, sf_dir).groupBy("perf", "idx", "lo", "hi").agg(F.count("*").alias("n")).select("perf", "idx", F.round(F.col("n") / (F.col("hi") - F.col("lo")), 6).alias("density"))
    return selections.extremes(d, ["perf"], "density", 5, "idx").select("perf", "end", "rank", "idx", "density")


@query(with_sql(*_STATES) + """, r as (select content_state, perf, idx, round(harmony, 6) as harmony, density, state_confidence from states)
select content_state, (row_number() over w)::int as rank, perf, idx, harmony, density from r window w as (partition by content_state order by harmony desc, density desc, state_confidence desc, perf, idx) qualify row_number() over w <= 10""")
def routing_examples(spark, sf_dir):
    """Ten examples of each content state: most harmony, then density, then confidence."""
    s = states(spark, sf_dir).withColumn("harmony", F.round("harmony", 6))
    order = Window.partitionBy("content_state").orderBy(F.desc("harmony"), F.desc("density"), F.desc("state_confidence"), "perf", "idx")
    return s.withColumn("rank", F.row_number().over(order)).where("rank <= 10").select("content_state", "rank", "perf", "idx", "harmony", "density")


@query(with_sql(*_STATES) + """, a as (select perf, idx, unnest([('rhythm_dominant', round(rhythm, 6)), ('harmonic_dominant', round(harmony, 6)), ('melodic_lead', round(melody, 6)), ('ambient_low_information', round(low_info, 6)), ('polyphonic_full_mix', round(mix, 6))]) as x, content_state from states)
select perf, idx, (row_number() over w)::int as rank, x[1] as alternate, x[2] as score from a where x[1] <> content_state window w as (partition by perf, idx order by x[2] desc, x[1]) qualify row_number() over w <= 3""")
def alternate_states(spark, sf_dir):
    """The three states that would come next by their scores: an array sort in the row, no shuffle."""
    names = (("rhythm_dominant", "rhythm"), ("harmonic_dominant", "harmony"), ("melodic_lead", "melody"), ("ambient_low_information", "low_info"), ("polyphonic_full_mix", "mix"))
    scored = F.array(*[F.struct((-F.round(c, 6)).alias("minus"), F.lit(n).alias("alternate")) for n, c in names])
    s = states(spark, sf_dir)
    others = F.slice(F.array_sort(F.filter(scored, lambda x: x["alternate"] != F.col("content_state"))), 1, 3)
    return s.select("perf", "idx", F.posexplode(others).alias("pos", "a")).select("perf", "idx", (F.col("pos") + 1).alias("rank"), "a.alternate", (-F.col("a.minus")).alias("score"))


@query(with_sql(NOTES_SQL) + """, b as (select perf, count(case when note % 7 = 3 and perf <> 'click' then 1 end) as bends from notes group by perf)
select perf, bends, case when bends > 0 then 'pitch_bend' else 'external_analyzer_required' end as evidence, round(case when bends > 0 then least(0.9, 0.35 + bends / 100.0::double) else 0.15 end, 6)::double as confidence from b""")
def tuning_evidence(spark, sf_dir):
    """Stand-in for pitch bends: notes of one remainder, in all performances but one."""
    bends = music.notes(spark, sf_dir).select("perf", F.when((F.col("note") % 7 == 3) & (F.col("perf") != "click"), F.col("note")).alias("pitch"))
    return selections.tuning_evidence(bends)


@query("""with l as (select o_custkey as perf, (sum(o_totalprice) / 1000)::double as seconds from orders group by o_custkey), w as (select *, greatest(12, least(48, seconds / 8)) as width from l where seconds > 0)
select perf, i::int as idx, round(i * width, 6) as lo, round(least(seconds, (i + 1) * width), 6) as hi from w, unnest(range(0, ceil(seconds / width)::bigint)) as r(i)""")
def fallback_regions(spark, sf_dir):
    lengths = music.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("perf")).agg((F.sum("o_totalprice") / 1000).cast("double").alias("seconds"))
    return selections.fallback_regions(lengths).select("perf", "idx", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("""with s as (select l_orderkey as batch, case when l_linenumber = 5 and l_orderkey % 3 = 0 then 'songs/*' when l_linenumber = 6 then '' else 'song' end as path, l_returnflag <> 'R' as authorized, case when l_suppkey % 7 = 0 then 'Splice Sounds' else 'own' end as source, l_linestatus = 'F' as training, l_quantity as q from lineitem),
c as (select batch, count(*) as songs, count(case when authorized then 1 end) as authorized, count(case when training then 1 end) as trainable, count(case when path = '' then 1 end) as no_path, count(case when path = 'songs/*' then 1 end) as dumps, count(case when source like 'Splice%' and training then 1 end) as splice, sum(q)::bigint as items from s group by batch),
e as (select *, concat_ws(',', case when dumps > 0 then 'folder_or_wildcard' end, case when no_path > 0 then 'missing_path' end, case when authorized < songs then 'not_authorized' end, case when splice > 0 then 'splice_training' end, case when items > 100 then 'too_many_samples' end, case when songs > 5 then 'too_many_songs' end) as errors from c)
select batch, songs, authorized, trainable, items, errors, (authorized + least(100, items))::bigint as review_actions, case when authorized <= 2 and items <= 30 then 'low' when authorized <= 5 and items <= 100 then 'medium' else 'high' end as burden, case when errors = '' then 'valid' else 'invalid' end as status from e""")
def batch_plan(spark, sf_dir):
    """Stand-in batches: an order's line items as songs, their quantities as samples."""
    items = music.table(spark, sf_dir, "lineitem")
    path = F.expr("case when l_linenumber = 5 and l_orderkey % 3 = 0 then 'songs/*' when l_linenumber = 6 then '' else 'song' end")
    songs = items.select(F.col("l_orderkey").alias("batch"), path.alias("path"), (F.col("l_returnflag") != "R").alias("authorized"), F.expr("case when l_suppkey % 7 = 0 then 'Splice Sounds' else 'own' end").alias("source"), (F.col("l_linestatus") == "F").alias("training"))
    return selections.batch_plan(songs, items.select(F.col("l_orderkey").alias("batch"), F.col("l_quantity").cast("long").alias("items")))


@query("""select l_partkey as part, l_suppkey as supplier, arg_min(l_orderkey, l_orderkey * 10 + l_linenumber) as order_key, arg_min(l_quantity, l_orderkey * 10 + l_linenumber) as quantity from lineitem group by all""")
def first_by_composite_id(spark, sf_dir):
    rows = music.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_orderkey").alias("order_key"), F.col("l_quantity").alias("quantity"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("made"))
    return selections.first_by_id(rows, ["part", "supplier"], "made").drop("made")


#: Fixed values of the stand-in: the tasks that a set of examples should cover.
TASKS = ["AIR", "MAIL", "RAIL", "SHIP", "TRUCK"]
_MODES = ["AIR", "FOB", "MAIL", "RAIL", "REG", "SHIP", "TRUCK"]


@query("""with m as (select l_orderkey as batch, list_sort(list(distinct ['AIR', 'FOB', 'MAIL', 'RAIL', 'REG', 'SHIP', 'TRUCK'][l_suppkey % 7 + 1])) as have, count(*) as n, round(sum(round(l_discount * 1e9::double)::bigint)::double / count(*) / 1e9::double, 6) as mean_quality from lineitem group by l_orderkey)
select batch, n, mean_quality, array_to_string(have, ',') as tasks, array_to_string(list_filter(['AIR', 'MAIL', 'RAIL', 'SHIP', 'TRUCK'], lambda x: not list_contains(have, x)), ',') as missing from m""")
def example_manifest(spark, sf_dir):
    """A set of examples in one row: how many, how good, which tasks it has and which it misses."""
    grouped = music.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("batch")).agg(F.count("*").alias("n"), mean6(F.col("l_discount").cast("double")).alias("mean_quality"), F.array_sort(F.collect_set(F.get(F.array(*[F.lit(m) for m in _MODES]), (F.col("l_suppkey") % 7).cast("int")))).alias("have"))
    missing = F.array_except(F.array(*[F.lit(t) for t in TASKS]), "have")
    return grouped.select("batch", "n", "mean_quality", F.array_join("have", ",").alias("tasks"), F.array_join(missing, ",").alias("missing"))


@query("""with o as (select l_orderkey as batch, sum((l_extendedprice * 100)::bigint)::bigint as cents from lineitem group by 1)
select o_orderkey as batch, round(coalesce(cents, 0) / 100.0::double, 2) as parts, o_totalprice::double as stored, abs(coalesce(cents, 0) / 100.0::double - o_totalprice) <= 0.01 as consistent from orders left join o on batch = o_orderkey""")
def batch_consistency(spark, sf_dir):
    """Stored totals against the sums of their parts; batches without parts are checked, too."""
    parts = music.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("batch")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    both = music.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch"), F.col("o_totalprice").cast("double").alias("stored")).join(parts, "batch", "left")
    total = F.coalesce("cents", F.lit(0)) / 100.0
    return both.select("batch", F.round(total, 2).alias("parts"), "stored", (F.abs(total - F.col("stored")) <= 0.01).alias("consistent"))


@query("""with d as (select '{"own": ' || props || ', "list": [' || props || ', {"deep": {"k": "text ' || event_type || '"}}, {"k": null}], "note": "\\"k\\": 99"}' as doc from events)
select t.atom ->> '$' as policy, count(*) as n from d, json_tree(d.doc) t where t.key = 'k' and t.atom is not null and json_type(t.atom) <> 'NULL' group by 1""")
def policy_counts(spark, sf_dir):
    """How often each value stands under a key, at whatever depth of nested JSON; a key inside a text is none."""
    doc = F.concat(F.lit('{"own": '), "props", F.lit(', "list": ['), "props", F.lit(', {"deep": {"k": "text '), "event_type", F.lit('"}}, {"k": null}], "note": "\\"k\\": 99"}'))
    return json_walk.counts_under(music.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), doc.alias("doc")), "doc", "k")


@query("""with g as (select o_custkey as g, o_orderkey as w, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as pos from orders),
e as (select g, w, row_number() over (partition by g order by pos) as nth from g where w in (select l_orderkey from lineitem where l_linenumber = 3))
select a.g as "group", a.w as first, b.w as second from e a join e b on a.g = b.g and a.nth = 1 and b.nth = 2""")
def motif_windows(spark, sf_dir):
    """The first two windows of a group's list that exist."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x["o_orderkey"])
    groups = music.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("group")).agg(listed.alias("ids"))
    return selections.first_two_windows(groups, music.table(spark, sf_dir, "lineitem").where("l_linenumber = 3").select(F.col("l_orderkey").alias("window")))


@query("""with a as (select distinct l_partkey as id from lineitem where l_returnflag = 'R'), b as (select distinct l_partkey as id from lineitem where l_returnflag = 'A')
select 'in_both' as problem, id from a where id in (select id from b) union all select 'missing', p_partkey from part where p_partkey not in (select id from a union select id from b)""")
def split_disjointness(spark, sf_dir):
    """Ids that are in two splits at once, and ids that are in none."""
    items = music.table(spark, sf_dir, "lineitem")
    a, b = (items.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("id")).distinct() for f in ("R", "A"))
    both = a.join(b, "id", "left_semi").select(F.lit("in_both").alias("problem"), "id")
    none = music.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).join(a.unionByName(b).distinct(), "id", "left_anti")
    return both.unionByName(none.select(F.lit("missing").alias("problem"), "id"))
