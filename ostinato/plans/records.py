"""Queries on training records: confidence, content states, tags, exports, pairs and their audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ostinato.functions.scalars import clamp01, mean6
from ostinato.operators import intervals, ordered, ranks, records, rhythm, targets
from ostinato.plans import events as event_plans
from ostinato.plans.events import _METRICS, _RELIABLE
from ostinato.plans.harmony import _CHORDS, timeline
from ostinato.plans.rhythm import BINNED, PULSES, WINDOWED, in_bins, in_windows
from ostinato.sources import music, scratch
from ostinato.sources.music import SEGMENTS_SQL, WINDOWS_SQL, with_sql

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Seconds of the tiles of a bin whose empty share is its silence.
SILENCE_TILE = 1.0


def evidence(spark, sf_dir) -> DataFrame:
    """For each bin: what the content scores look at, from its rhythm and its chord."""
    gaps = rhythm.with_gaps(in_bins(spark, sf_dir))
    stats = rhythm.pulses(gaps)
    chords = timeline(spark, sf_dir).select("perf", "idx", F.col("confidence").alias("chord"), F.size("active").alias("classes"))
    n = F.col("n")
    moves = gaps.withColumn("step", F.lead("note").over(Window.partitionBy("perf", "idx").orderBy("t", "seq")) - F.col("note")).groupBy("perf", "idx").agg(F.coalesce(F.avg((F.abs("step").between(1, 4)).cast("int")), F.lit(0.0)).alias("movement"))
    silent = rhythm.sub_bins(in_bins(spark, sf_dir), SILENCE_TILE).groupBy("perf", "idx").agg(F.avg((F.col("events") == 0).cast("int")).alias("silence"))
    base = stats.join(chords, ["perf", "idx"]).join(moves, ["perf", "idx"]).join(silent, ["perf", "idx"])
    return base.select(
        "perf",
        "idx",
        "lo",
        "hi",
        n.alias("notes"),
        (n / (F.col("hi") - F.col("lo"))).alias("density"),
        F.when(n > 1, F.col("close") / (n - 1)).otherwise(0.0).alias("poly"),
        "silence",
        "chord",
        "classes",
        (F.col("classes") / 4.0).alias("activity"),
        "movement",
        (n >= 16).alias("motif"),
        records.rhythm_confidence(n, F.col("pulse")).alias("confidence"),
    )


_EVIDENCE = """quiet as (
  select t.perf, t.idx, avg(case when l.sub is null then 1.0::double else 0 end) as silence
  from (select distinct perf, idx, unnest(range(0, ceil(hi - lo)::int)) as sub from located) t
  left join (select distinct perf, idx, unnest([least(floor(t - lo)::int, ceil(hi - lo)::int - 1), greatest(ceil(t - lo)::int - 1, 0)]) as sub from located) l
    on l.perf = t.perf and l.idx = t.idx and l.sub = t.sub group by 1, 2),
moves as (select perf, idx, coalesce(avg(case when abs(step) between 1 and 4 then 1.0::double when step is not null then 0 end), 0) as movement
  from (select *, lead(note) over (partition by perf, idx order by t, seq) - note as step from gaps) group by perf, idx),
evidence as (
  select p.perf, p.idx, p.lo, p.hi, p.n as notes, p.n / (p.hi - p.lo) as density, case when p.n > 1 then near::double / (p.n - 1) else 0 end as poly, silence,
         c.confidence as chord, len(c.active) as classes, len(c.active) / 4.0::double as activity, movement, p.n >= 16 as motif,
         round(case when pulse <= 0 then least(0.35, case when p.n < 8 then least(0.45, least(0.9, 0.35 + least(0.6, p.n / 120.0::double))) else least(0.9, 0.35 + least(0.6, p.n / 120.0::double)) end)
                    when p.n < 8 then least(0.45, least(0.9, 0.35 + least(0.6, p.n / 120.0::double))) else least(0.9, 0.35 + least(0.6, p.n / 120.0::double)) end, 6) as confidence
  from pulses p join chords c using (perf, idx) join moves using (perf, idx) join quiet using (perf, idx))"""
_SCORES = """s1 as (select *, greatest(0, least(1, notes / 32.0::double)) as nn, greatest(0, least(1, density / 3)) as dn, greatest(0, least(1, poly)) as pn, greatest(0, least(1, classes / 7.0::double)) as pc,
  greatest(0, least(1, 1 - abs(density - 1.4) / 1.4)) as moderate, greatest(0, least(1, chord)) as ch from evidence),
s2 as (select *, greatest(0, least(1, 0.34::double * dn + 0.22::double * nn + 0.18::double * motif::int + 0.1::double * (1 - silence))) as rhythm,
  greatest(0, least(1, 0.26::double * pc + 0.29::double * ch + 0.2::double * greatest(0, least(1, activity / 3)) + 0.15::double * pn + 0.1::double * (chord > 0)::int)) as harmony,
  greatest(0, least(1, 0.3::double * pc + 0.25::double * moderate + 0.25::double * (1 - pn) + 0.2::double * greatest(0, least(1, movement)))) as melody,
  greatest(0, least(1, 0.33::double * silence + 0.24::double * (1 - nn) + 0.15::double * (1 - confidence))) as low_info from s1),
s3 as (select *, greatest(0, least(1, 0.34::double * rhythm + 0.34::double * harmony + 0.2::double * pn + 0.12::double * nn)) as mix from s2),
states as (
  select *, case when low_info >= 0.83 and notes <= 1 and harmony < 0.3 and rhythm < 0.42 then 'silence_or_noise' when mix >= 0.68 then 'polyphonic_full_mix' when harmony >= 0.62 and harmony - rhythm >= 0.08 then 'harmonic_dominant'
    when rhythm >= 0.62 and harmony < 0.52 and classes <= 3 and chord < 0.45 and poly < 0.18 then 'percussive_only' when rhythm >= 0.62 and harmony < 0.52 then 'rhythm_dominant' when melody >= 0.58 and harmony >= 0.42 then 'melodic_lead'
    when low_info >= 0.5 and notes <= 10 and silence >= 0.4 and harmony < 0.65 then 'ambient_low_information' else 'unknown' end as content_state,
  round(greatest(0, least(1, case when low_info >= 0.83 and notes <= 1 and harmony < 0.3 and rhythm < 0.42 then 0.86 when mix >= 0.68 then least(0.9, 0.65 + (mix - 0.68)) when harmony >= 0.62 and harmony - rhythm >= 0.08 then least(0.88, 0.62 + (harmony - 0.62))
    when rhythm >= 0.62 and harmony < 0.52 and classes <= 3 and chord < 0.45 and poly < 0.18 then least(0.86, 0.66 + (rhythm - 0.62)) when rhythm >= 0.62 and harmony < 0.52 then least(0.84, 0.62 + (rhythm - 0.62)) when melody >= 0.58 and harmony >= 0.42 then least(0.8, 0.58 + (melody - 0.58))
    when low_info >= 0.5 and notes <= 10 and silence >= 0.4 and harmony < 0.65 then least(0.82, 0.58 + (low_info - 0.5)) else 0.45 end)), 6) as state_confidence,
  list_sort([low_info, mix, harmony, rhythm, melody, low_info * 0.92, rhythm * (1 - least(1, harmony + 0.1)), 0.3], 'DESC') as ranked from s3)"""
_STATES = [*BINNED, PULSES, _CHORDS, _EVIDENCE, _SCORES]


def states(spark, sf_dir) -> DataFrame:
    return records.content_states(records.content_scores(evidence(spark, sf_dir)))


@query(with_sql(*_STATES) + "select perf, idx, notes, round(rhythm, 6) as rhythm, round(harmony, 6) as harmony, round(melody, 6) as melody, round(low_info, 6) as low_info, round(mix, 6) as mix, content_state, state_confidence, round(greatest(0, least(1, ranked[1] - ranked[2])), 6) as margin from states")
def content_routes(spark, sf_dir):
    s = states(spark, sf_dir)
    return s.select("perf", "idx", "notes", *[F.round(c, 6).alias(c) for c in ("rhythm", "harmony", "melody", "low_info", "mix")], "content_state", "state_confidence", "margin")


_POLICY = "policy as (select * from (values " + ", ".join(map(str, records.ROUTES)) + ") as t(content_state, allowed, suppressed, rules))"


@query(with_sql(*_STATES, _POLICY) + "select perf, idx, s.content_state, allowed, suppressed, rules from states s left join policy p on p.content_state = s.content_state")
def routing_decisions(spark, sf_dir):
    return records.routed(states(spark, sf_dir)).select("perf", "idx", "content_state", "allowed", "suppressed", "rules")


@query(with_sql(*_STATES) + "select perf, content_state, count(*) as n, round(sum(round(notes * 1e9::double)::bigint)::double / count(notes) / 1e9::double, 6) as mean_notes, round(sum(round(state_confidence * 1e9::double)::bigint)::double / count(state_confidence) / 1e9::double, 6) as mean_confidence, grouping(perf)::int * 2 + grouping(content_state)::int as level from states group by rollup (perf, content_state)")
def routing_diagnostics(spark, sf_dir):
    rolled = states(spark, sf_dir).rollup("perf", "content_state").agg(F.count("*").alias("n"), mean6(F.col("notes")).alias("mean_notes"), mean6(F.col("state_confidence")).alias("mean_confidence"), F.grouping_id().cast("int").alias("level"))
    return rolled.select("perf", "content_state", "n", "mean_notes", "mean_confidence", "level")


@query(with_sql(*_STATES, WINDOWS_SQL) + """, o as (select w.perf, w.idx, s.content_state, sum(greatest(0, least(w.hi, s.hi) - greatest(w.lo, s.lo))) as seconds, max(state_confidence) as sure from windows w join states s on s.perf = w.perf and s.hi >= w.lo and s.lo <= w.hi group by w.perf, w.idx, s.content_state)
select perf, idx, content_state, seconds, sure as confidence from o qualify row_number() over (partition by perf, idx order by (content_state = 'unknown')::int, seconds desc, content_state) = 1""")
def dominant_state_overlap(spark, sf_dir):
    """The state with the longest overlap in each window; a known state goes before unknown."""
    right = states(spark, sf_dir).select("perf", F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi"), "content_state", "state_confidence")
    met = intervals.overlapping(music.windows(spark, sf_dir).select("perf", "idx", "lo", "hi"), right, music.WINDOW)
    votes = met.groupBy("perf", "idx", "content_state").agg(F.sum("overlap").alias("seconds"), F.max("state_confidence").alias("sure"))
    best = F.min(F.struct((F.col("content_state") == "unknown").cast("int").alias("u"), (-F.col("seconds")).alias("s"), "content_state", "sure"))
    return votes.groupBy("perf", "idx").agg(best.alias("b")).select("perf", "idx", "b.content_state", (-F.col("b.s")).alias("seconds"), F.col("b.sure").alias("confidence"))


def vectors(spark, sf_dir):
    return rhythm.rhythm_vector(in_windows(spark, sf_dir))


_SMALL_VECTOR = """v as (select p.perf, p.kind, p.idx, round(p.n / (p.hi - p.lo), 6) as density, round(case when p.n > 1 then near::double / (p.n - 1) else 0 end, 6) as poly,
   round((select avg(case when g.vel >= p.vel_mean + p.vel_std then 1.0::double else 0 end) from gaps g where g.perf = p.perf and g.idx = p.idx), 6) as accents,
   round(coalesce((select avg(least((t - g.lo) % nullif(pulse, 0) / nullif(pulse, 0), 1 - (t - g.lo) % nullif(pulse, 0) / nullif(pulse, 0))) from gaps g where g.perf = p.perf and g.idx = p.idx), 0), 6) as sync,
   round(case when n_ioi > 0 then (select max(c) from (select count(*) as c from gaps g where g.perf = p.perf and g.idx = p.idx and gap > 0 group by round(gap, 2))) / n_ioi::double else 0 end, 6) as rep from pulses p)"""
_TAGS = """tags as (select perf, kind, idx, tag, round(sure, 6) as tag_confidence from (
  select perf, kind, idx, 'dense_region' as tag, least(0.9, density / 10) as sure from v where density >= 6 union all select perf, kind, idx, 'sparse_region', 0.6 from v where density <= 1
  union all select perf, kind, idx, 'irregular_groove', sync * 2 from v where sync >= 0.3 union all select perf, kind, idx, 'steady_pulse', 1 - sync from v where sync <= 0.16
  union all select perf, kind, idx, 'polyphonic_texture', poly from v where poly >= 0.3 union all select perf, kind, idx, 'repetitive_pattern', rep from v where rep >= 0.5
  union all select perf, kind, idx, 'accented', accents from v where accents >= 0.2))"""


@query(with_sql(*WINDOWED, PULSES, _SMALL_VECTOR, _TAGS) + "select perf, kind, idx, tag, tag_confidence from tags")
def tags(spark, sf_dir):
    return records.tagged(vectors(spark, sf_dir))


@query(with_sql(*WINDOWED, PULSES, _SMALL_VECTOR, _TAGS) + ", g as (select perf, tag, count(*) as n, max(tag_confidence) as best, round(sum(round(tag_confidence * 1e9::double)::bigint)::double / count(tag_confidence) / 1e9::double, 6) as mean, arg_max(idx, (tag_confidence, idx)) as example_idx from tags group by perf, tag) select *, (row_number() over (partition by perf order by best desc, n desc, tag))::int as rank from g")
def tag_groups(spark, sf_dir):
    return records.tag_groups(records.tagged(vectors(spark, sf_dir)))


#: Concepts that a tag stands for.
CONCEPTS = [("dense_region", "density"), ("sparse_region", "space"), ("sparse_region", "density"), ("irregular_groove", "syncopation"), ("steady_pulse", "pulse"), ("polyphonic_texture", "texture"), ("repetitive_pattern", "motif"), ("accented", "accent")]


@query(with_sql(*WINDOWED, PULSES, _SMALL_VECTOR, _TAGS, "concepts as (select * from (values " + ", ".join(map(str, CONCEPTS)) + ") as t(tag, concept))") + "select concept, count(*) as n, count(distinct perf) as performances from tags join concepts using (tag) group by concept")
def ontology_counts(spark, sf_dir):
    concepts = spark.createDataFrame(CONCEPTS, "tag string, concept string")
    return records.tagged(vectors(spark, sf_dir)).join(F.broadcast(concepts), "tag").groupBy("concept").agg(F.count("*").alias("n"), F.count_distinct("perf").alias("performances"))


def ai_record_rows(spark, sf_dir):
    """A record for each bin: its content state, and the reliability of the window that holds most of it (ties: the earlier)."""
    windows = music.windows(spark, sf_dir).select("perf", F.col("idx").alias("window"), F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi"))
    bins = states(spark, sf_dir)
    met = intervals.overlapping(bins.select("perf", "idx", "lo", "hi"), windows, music.WINDOW)
    best = met.groupBy("perf", "idx").agg(F.max_by("window", F.struct(F.col("overlap"), -F.col("window"))).alias("window"))
    tiers = event_plans.reliable_windows(spark, sf_dir).select("perf", F.col("idx").alias("window"), "tier", "score", "weight")
    joined = bins.drop("score").join(best, ["perf", "idx"]).join(tiers, ["perf", "window"], "left")
    status = F.when(F.col("idx") % 11 == 0, "human_verified_label").when(F.col("idx") % 3 == 0, "weak_label").when(F.col("idx") % 5 == 0, "review_required").otherwise("derived_observation")
    return joined.select("perf", "idx", "window", F.coalesce("tier", F.lit("low")).alias("tier"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("weight", F.lit(0.0)).alias("weight"), "content_state", F.col("confidence"), status.alias("label_status"), (F.col("notes") > 2).alias("whole"), "notes", "rhythm", "harmony", "margin", "chord", "classes")


_WINDOW_TIERS = _METRICS[3].replace("located as", "wlocated as").replace("b.idx", "b.idx"), _METRICS[4].replace("gaps as", "wgaps as").replace("from located", "from wlocated"), _METRICS[5].replace("from gaps", "from wgaps")
_RECORDS = """matched as (select b.perf, b.idx, w.idx as "window" from states b join windows w on w.perf = b.perf and w.hi >= b.lo and w.lo <= b.hi
  qualify row_number() over (partition by b.perf, b.idx order by greatest(0, least(b.hi, w.hi) - greatest(b.lo, w.lo)) desc, w.idx) = 1),
records as (select s.perf, s.idx, m."window", coalesce(t.tier, 'low') as tier, coalesce(t.score, 0) as score, coalesce(t.weight, 0) as weight, content_state, confidence,
  case when s.idx % 11 = 0 then 'human_verified_label' when s.idx % 3 = 0 then 'weak_label' when s.idx % 5 = 0 then 'review_required' else 'derived_observation' end as label_status,
  s.notes > 2 as whole, s.notes, rhythm, harmony, greatest(0, least(1, ranked[1] - ranked[2])) as margin, chord, classes
  from states s join matched m using (perf, idx) left join weighted t on t.perf = s.perf and t.idx = m."window")"""
_RECORD_CTES = [*_STATES, WINDOWS_SQL, *_WINDOW_TIERS, _RELIABLE, _RECORDS]


@query(with_sql(*_RECORD_CTES) + 'select perf, idx, "window", tier, score, weight, content_state, confidence, label_status, whole from records')
def ai_records(spark, sf_dir):
    return ai_record_rows(spark, sf_dir).select("perf", "idx", "window", "tier", "score", "weight", "content_state", "confidence", "label_status", "whole")


_SPLITS = """splits as (select *, case when not whole then 'quarantined_records' when label_status = 'human_verified_label' then 'accepted_records'
    when label_status in ('weak_label', 'heuristic_label', 'review_required') and (confidence < 0.35 or tier not in ('high', 'medium')) then 'review_required_records' when label_status in ('weak_label', 'heuristic_label', 'review_required') then 'weak_label_records'
    when label_status in ('raw_observation', 'derived_observation') and tier in ('high', 'medium') and confidence >= 0.4 then 'accepted_records' when tier in ('high', 'medium') and confidence >= 0.4 then 'audio_midi_only_records' else 'review_required_records' end as export_split,
  (case when not whole then weight when label_status = 'human_verified_label' then greatest(weight, 0.9) when label_status in ('weak_label', 'heuristic_label', 'review_required') and (confidence < 0.35 or tier not in ('high', 'medium')) then weight
    when label_status in ('weak_label', 'heuristic_label', 'review_required') then least(weight, 0.7) when label_status in ('raw_observation', 'derived_observation') and tier in ('high', 'medium') and confidence >= 0.4 then greatest(weight, 0.7)
    when tier in ('high', 'medium') and confidence >= 0.4 then greatest(weight, 0.6) else weight end)::double as training_weight from records)"""


@query(with_sql(*_RECORD_CTES, _SPLITS) + "select perf, idx, tier, label_status, export_split, training_weight from splits")
def export_splits(spark, sf_dir):
    return records.export_splits(ai_record_rows(spark, sf_dir)).select("perf", "idx", "tier", "label_status", "export_split", "training_weight")


@query(with_sql(*_RECORD_CTES, _SPLITS) + "select perf, export_split, count(*) as n, round(sum(training_weight), 6) as weight from splits group by perf, export_split")
def export_manifest_counts(spark, sf_dir):
    return records.export_splits(ai_record_rows(spark, sf_dir)).groupBy("perf", "export_split").agg(F.count("*").alias("n"), F.round(F.sum("training_weight"), 6).alias("weight"))


_FANNED = """fanned as (
  select perf, idx, 'quarantine' as part, 'quarantined_records' as export_split, training_weight from splits where export_split = 'quarantined_records'
  union all select perf, idx, 'observation', 'accepted_records', training_weight from splits where export_split <> 'quarantined_records' and tier in ('high', 'medium') and training_weight >= 0.6::double
  union all select perf, idx, 'observation', 'audio_midi_only_records', training_weight from splits where export_split = 'audio_midi_only_records' and not (tier in ('high', 'medium') and training_weight >= 0.6::double)
  union all select perf, idx, 'weak_label', 'weak_label_records', least(training_weight, 0.7::double) from splits where export_split <> 'quarantined_records' and label_status = 'weak_label'
  union all select perf, idx, 'review', 'review_required_records', least(training_weight, 0.4::double) from splits where export_split = 'review_required_records')"""


def fanned(spark, sf_dir):
    split = records.export_splits(ai_record_rows(spark, sf_dir)).withColumn("record_id", F.concat_ws("-", "perf", "idx"))
    return records.fanned_out(split, "record_id")


@query(with_sql(*_RECORD_CTES, _SPLITS, _FANNED) + "select perf || '-' || idx || ':' || part || ':0' as export_record_id, export_split, training_weight from fanned")
def export_fan_out(spark, sf_dir):
    """The records that each record gives in the splits: none, one or several."""
    return fanned(spark, sf_dir).select("export_record_id", "export_split", "training_weight")


@query(with_sql(*_RECORD_CTES, _SPLITS, _FANNED) + "select perf, export_split, count(*) as n, count(distinct idx) as records, round(sum(round(training_weight * 1e9::double)::bigint)::double / 1e9::double, 6) as weight from fanned group by perf, export_split")
def export_fan_out_counts(spark, sf_dir):
    return fanned(spark, sf_dir).groupBy("perf", "export_split").agg(F.count("*").alias("n"), F.count_distinct("idx").alias("records"), F.round(F.sum(F.round(F.col("training_weight") * 1e9).cast("long")) / 1e9, 6).alias("weight"))


def gate_facts(spark, sf_dir) -> DataFrame:
    """Stand-ins, inputs only: a performance per customer, its windows are orders, its records and tags their line items."""
    c = music.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run"), (F.col("c_custkey") % 13 != 0).alias("source_exists"), F.expr("case when c_custkey % 5 > 0 then c_acctbal end").alias("duration"), F.expr("case when c_custkey % 7 = 0 then ' ' else md5(c_name) end").alias("checksum"), (F.col("c_custkey") % 3 > 0).alias("analysis_exists"), (F.col("c_custkey") % 4 > 0).alias("merged_exists"), (F.col("c_nationkey") > 0).alias("pack_valid"))
    o = music.table(spark, sf_dir, "orders")
    windows = o.groupBy(F.col("o_custkey").alias("run")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("successful"), F.count_if(F.col("o_orderstatus") == "P").alias("remaining"))
    items = music.table(spark, sf_dir, "lineitem").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    counted = items.groupBy(F.col("o_custkey").alias("run")).agg(F.count("*").alias("records"), F.count_if(F.col("l_quantity") <= 49).alias("with_confidence"), F.count_if(F.col("l_discount") < 0.1).alias("with_provenance"), F.count_if(F.col("l_returnflag") == "R").alias("tags"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_tax") < 0.08)).alias("tags_with_evidence"))
    there = lambda column, name: F.col(column).isNotNull().alias(name)
    facts = c.join(windows, "run", "left").join(counted, "run", "left")
    return facts.select("*", there("successful", "manifest_exists"), there("records", "pack_exists"), there("records", "jsonl_exists"))


_GATES = """w as (select o_custkey as run, count(case when o_orderstatus = 'F' then 1 end) as successful, count(case when o_orderstatus = 'P' then 1 end) as remaining from orders group by 1),
i as (select o_custkey as run, count(*) as records, count(case when l_quantity <= 49 then 1 end) as conf, count(case when l_discount < 0.1 then 1 end) as prov, count(case when l_returnflag = 'R' then 1 end) as tags, count(case when l_returnflag = 'R' and l_tax < 0.08 then 1 end) as told from lineitem join orders on l_orderkey = o_orderkey group by 1),
f as (select c_custkey as run, c.*, w.run is not null as manifest, i.run is not null as pack, coalesce(successful, 0) as ok, coalesce(remaining, 0) as remaining, coalesce(records, 0) as records, coalesce(conf, 0) as conf, coalesce(prov, 0) as prov, coalesce(tags, 0) as tags, coalesce(told, 0) as told
  from customer c left join w on w.run = c_custkey left join i on i.run = c_custkey),
gates as (
  select run, 'source_file_exists' as gate, case when run % 13 <> 0 then 'pass' else 'fail' end as status, 'critical' as severity from f
  union all select run, 'source_duration_known', case when run % 5 > 0 then 'pass' else 'warn' end, 'warning' from f
  union all select run, 'source_checksum_exists', case when run % 7 <> 0 then 'pass' else 'warn' end, 'warning' from f
  union all select run, 'source_decodes_checkable', case when run % 13 <> 0 then 'pass' else 'not_applicable' end, 'warning' from f
  union all select run, 'active_analysis_path_exists', case when run % 3 > 0 then 'pass' else 'warn' end, 'warning' from f
  union all select run, 'active_segments_manifest_exists', case when manifest then 'pass' else 'fail' end, 'critical' from f
  union all select run, 'successful_transcription_window_exists', case when ok > 0 then 'pass' else 'fail' end, 'critical' from f
  union all select run, 'merged_midi_exists_if_complete', case when remaining > 0 or run % 4 > 0 then 'pass' else 'warn' end, 'warning' from f
  union all select run, 'feature_pack_exists', case when pack then 'pass' else 'fail' end, 'critical' from f
  union all select run, 'feature_pack_validates', case when pack and c_nationkey > 0 then 'pass' else 'fail' end, 'critical' from f
  union all select run, 'ai_jsonl_exists', case when pack then 'pass' else 'fail' end, 'critical' from f
  union all select run, 'tags_have_evidence', case when tags = 0 then 'fail' when told = tags then 'pass' else 'warn' end, 'warning' from f
  union all select run, 'ai_confidence_fields_exist', case when conf = records then 'pass' else 'warn' end, 'warning' from f
  union all select run, 'ai_provenance_fields_exist', case when prov = records then 'pass' else 'warn' end, 'warning' from f)"""


@query(with_sql(_GATES) + "select run, gate, status, case when status = 'pass' then 'info' else severity end as severity from gates")
def training_quality_gates(spark, sf_dir):
    return records.quality_gates(gate_facts(spark, sf_dir), "run")


@query(with_sql(_GATES) + """, v as (select run, count(case when status = 'pass' then 1 end) as passed, count(case when status = 'warn' then 1 end) as warned, count(case when status = 'fail' then 1 end) as failed, bool_or(status = 'fail' and severity = 'critical') as critical from gates group by run)
select *, case when critical then 'quarantined' when failed > 0 then 'review_required' when warned > 0 then 'weak_accept' else 'accepted' end as quality_status, case when critical then 'quarantine' when failed > 0 then 'review' when warned > 0 then 'weak_labels' else 'train' end as split from v""")
def training_gate_verdicts(spark, sf_dir):
    return records.gate_verdicts(records.quality_gates(gate_facts(spark, sf_dir), "run"), "run")


@query(with_sql(*_RECORD_CTES, _SPLITS) + """select perf, count(*) as records, count(case when export_split = 'accepted_records' then 1 end) as accepted, round(count(*) / 12.0::double, 6) as records_per_minute,
  round(100 * count(case when export_split = 'review_required_records' then 1 end) / count(*)::double, 6) as review_pct,
  concat_ws(',', case when count(case when content_state = 'silence_or_noise' then 1 end) / count(*)::double >= 0.45 then 'too_many_silence_or_noise_regions' end, case when 100 * count(case when export_split = 'review_required_records' then 1 end) / count(*)::double >= 60 then 'high_review_required_percentage' end,
    case when count(case when content_state in ('harmonic_dominant', 'polyphonic_full_mix') then 1 end) = 0 then 'zero_harmonic_or_full_mix_states_with_pitch_evidence' end) as risk_flags from splits group by perf""")
def yield_audit(spark, sf_dir):
    """Yields per minute of a performance, shares of splits, and flags for what looks wrong."""
    n = F.count("*")
    review = 100 * F.count_if(F.col("export_split") == "review_required_records") / n
    flag = lambda condition, name: F.when(condition, name)
    rows = records.export_splits(ai_record_rows(spark, sf_dir))
    return rows.groupBy("perf").agg(
        n.alias("records"),
        F.count_if(F.col("export_split") == "accepted_records").alias("accepted"),
        F.round(n / (music.DURATION / 60), 6).alias("records_per_minute"),
        F.round(review, 6).alias("review_pct"),
        F.concat_ws(
            ",",
            flag(F.count_if(F.col("content_state") == "silence_or_noise") / n >= 0.45, "too_many_silence_or_noise_regions"),
            flag(review >= 60, "high_review_required_percentage"),
            flag(F.count_if(F.col("content_state").isin("harmonic_dominant", "polyphonic_full_mix")) == 0, "zero_harmonic_or_full_mix_states_with_pitch_evidence"),
        ).alias("risk_flags"),
    )


@query(with_sql(*_RECORD_CTES, _SPLITS) + "select count(distinct perf) as performances, count(*) as records, count(case when export_split = 'accepted_records' then 1 end) as accepted, round(100 * count(case when export_split = 'accepted_records' then 1 end) / count(*)::double, 6) as accepted_pct, round(sum(training_weight), 4) as weight from splits")
def export_summary(spark, sf_dir):
    n, accepted = F.count("*"), F.count_if(F.col("export_split") == "accepted_records")
    return records.export_splits(ai_record_rows(spark, sf_dir)).agg(F.count_distinct("perf").alias("performances"), n.alias("records"), accepted.alias("accepted"), F.round(100 * accepted / n, 6).alias("accepted_pct"), F.round(F.sum("training_weight"), 4).alias("weight"))


def upgraded(weak: DataFrame) -> DataFrame:
    """Records with the family of their label, in turn rhythm and harmony, and what becomes of it."""
    family = F.when(F.col("idx") % 2 == 0, "rhythm").otherwise("harmony")
    state = F.col("content_state")
    weak = weak.withColumn("family", family).withColumn("ambiguity", F.round(1 - F.col("margin"), 6)).withColumn("has_evidence", F.col("notes") > 4)
    weak = weak.withColumn("supported", F.when(F.col("family") == "rhythm", state.isin("rhythm_dominant", "percussive_only", "polyphonic_full_mix")).otherwise(state.isin("harmonic_dominant", "polyphonic_full_mix", "melodic_lead")))
    return records.label_upgrades(weak)


_UPGRADES = """u as (select *, case when idx % 2 = 0 then 'rhythm' else 'harmony' end as family, round(1 - margin, 6) as ambiguity from records where label_status in ('weak_label', 'review_required')),
w as (select *, case when family = 'rhythm' then content_state in ('rhythm_dominant', 'percussive_only', 'polyphonic_full_mix') else content_state in ('harmonic_dominant', 'polyphonic_full_mix', 'melodic_lead') end as supported from u)"""


@query(with_sql(*_RECORD_CTES, _UPGRADES) + """select perf, idx, family, case when content_state in ('percussive_only', 'ambient_low_information', 'speech_like', 'silence_or_noise') and family = 'harmony' then 'suppress_candidate'
  when supported and (tier in ('high', 'medium') or score >= 0.65) and confidence >= 0.58 and ambiguity <= 0.35 and notes > 4 then 'upgrade_candidate' when family = 'rhythm' and ambiguity >= 0.45 then 'keep_weak' when ambiguity >= 0.55 then 'needs_human_review'
  when not supported then 'downgrade_candidate' when not notes > 4 then 'downgrade_candidate' when confidence < 0.4 or score < 0.45 then 'downgrade_candidate' else 'keep_weak' end as recommendation from w""")
def label_upgrades(spark, sf_dir):
    weak = ai_record_rows(spark, sf_dir).where(F.col("label_status").isin("weak_label", "review_required"))
    return upgraded(weak).select("perf", "idx", "family", "recommendation")


def gate_statuses(rows: DataFrame) -> DataFrame:
    n = F.count("*")
    g = rows.groupBy("perf").agg(n.alias("n"), F.avg("score").alias("score"), F.count_if(F.col("tier") == "failed").alias("failed"), F.count_if(F.col("content_state") == "unknown").alias("unknown"))
    gate = lambda name, passed, critical: F.struct(F.lit(name).alias("gate"), passed.alias("passed"), F.lit(critical).alias("critical"))
    gates = g.select("perf", F.explode(F.array(gate("has_records", F.col("n") > 0, True), gate("mean_reliability", F.col("score") >= 0.55, False), gate("failed_share", F.col("failed") / F.col("n") <= 0.2, True), gate("unknown_share", F.col("unknown") / F.col("n") <= 0.5, False))).alias("g")).select("perf", "g.*")
    verdict = F.when(F.bool_or(~F.col("passed") & F.col("critical")), "quarantined").when(F.bool_or(~F.col("passed")), "review_required").otherwise("accepted")
    return gates.groupBy("perf").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), verdict.alias("status"))


@query(with_sql(*_RECORD_CTES) + """, g as (select perf, count(*) as n, avg(score) as score, count(case when tier = 'failed' then 1 end) as failed, count(case when content_state = 'unknown' then 1 end) as unknown from records group by perf),
gates as (select perf, 'has_records' as gate, n > 0 as passed, true as critical from g union all select perf, 'mean_reliability', score >= 0.55, false from g union all select perf, 'failed_share', failed / n::double <= 0.2, true from g union all select perf, 'unknown_share', unknown / n::double <= 0.5, false from g)
select perf, count(case when passed then 1 end) as passed, count(case when not passed then 1 end) as failed, case when bool_or(not passed and critical) then 'quarantined' when bool_or(not passed) then 'review_required' else 'accepted' end as status from gates group by perf""")
def quality_gates(spark, sf_dir):
    """One row per gate, then a verdict: a failed critical gate quarantines the performance."""
    return gate_statuses(ai_record_rows(spark, sf_dir))


def pair_task() -> Column:
    """What kind of example a pair of neighbours is."""
    a, b = F.col("context_notes"), F.col("target_notes")
    c, d = F.col("context_density"), F.col("target_density")
    return F.when((a >= 4) & (b >= 4) & (F.greatest(a, b) / F.least(a, b) <= 3.5), "call_response").when((d > c * 1.2) | (c > d * 1.2), "buildup_to_release").otherwise("continuation")


def phrase_refs(spark, sf_dir) -> DataFrame:
    """perf, idx, hits, distance: the windows and segments that a bin overlaps, and how far its start is from a segment's end."""
    parts = [regions.select("perf", "kind", F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi")) for regions in (music.windows(spark, sf_dir), music.segments(spark, sf_dir))]
    met = intervals.overlapping(music.bins(spark, sf_dir).select("perf", "idx", "lo", "hi"), parts[0].unionByName(parts[1]), music.SEGMENT, closed=False)
    near = F.min(F.when(F.col("kind") == "segment", F.least(F.abs(F.col("lo") - F.col("r_lo")), F.abs(F.col("lo") - F.col("r_hi")))))
    return met.groupBy("perf", "idx").agg(F.count("*").alias("hits"), near.alias("distance"))


def pair_rows(spark, sf_dir) -> DataFrame:
    """Neighbouring bins as context and target, with what the pairs' quality looks at."""
    rows = states(spark, sf_dir).select("perf", "idx", "lo", "hi", "notes", "density", "content_state", "confidence", "poly", "classes", "chord").join(phrase_refs(spark, sf_dir), ["perf", "idx"], "left")
    block = F.floor(F.col("idx") / 64).cast("int")
    target = F.struct("idx", "lo", "hi", "notes", "density", "content_state", "chord", "classes", "hits", "distance")
    paired = ordered.with_next(rows.withColumn("target", target), ["perf"], block, ["idx"], "target", "next").where("next is not null")
    change = clamp01(F.abs(F.col("next.density") - F.col("density")) / 2.0)
    moved = F.when(F.col("next.content_state") != F.col("content_state"), 1.0).otherwise(0.55)
    pairs = paired.select(
        "perf",
        F.col("idx").alias("context_idx"),
        F.col("next.idx").alias("target_idx"),
        F.col("notes").alias("context_notes"),
        F.col("next.notes").alias("target_notes"),
        F.col("next.lo").alias("target_lo"),
        F.col("next.hi").alias("target_hi"),
        F.col("density").alias("context_density"),
        F.col("next.density").alias("target_density"),
        F.col("content_state").alias("context_state"),
        F.col("next.content_state").alias("target_state"),
        F.col("confidence").alias("reliability"),
        (F.lit(0.45) * change + F.lit(0.55) * moved).alias("boundary"),
        F.col("next.distance").alias("distance"),
        F.col("next.hits").alias("phrase_refs"),
        ((F.col("next.chord") > 0).cast("int") + (F.col("next.classes") >= 2).cast("int")).alias("arrival_refs"),
        clamp01(F.col("poly") + F.col("classes") / 24.0).alias("motif"),
        F.lit(music.DURATION >= 600).alias("long_form"),
        (F.col("next.notes") < 3).alias("blocked"),
    )
    return records.boundary_evidence(pairs.withColumn("task", pair_task()))


_SOUNDING = "(" + ", ".join(f"'{s}'" for s in records.SOUNDING) + ")"
_ALLOWED = " or ".join(f"(task = '{t}' and target_state in (" + ", ".join(f"'{s}'" for s in states) + "))" for t, (states, _, _) in records.TASKS.items())
_PAIR = f"""refs as (select b.perf, b.idx, count(*) as hits, min(case when r.kind = 'segment' then least(abs(b.lo - r.lo), abs(b.lo - r.hi)) end) as distance
  from bins b join (select perf, kind, lo, hi from windows union all select perf, kind, lo, hi from segments) r on r.perf = b.perf and least(b.hi, r.hi) > greatest(b.lo, r.lo) group by b.perf, b.idx),
paired as (select *, lead(idx) over w as target_idx, lead(notes) over w as target_notes, lead(lo) over w as target_lo, lead(hi) over w as target_hi, lead(density) over w as target_density, lead(content_state) over w as target_state, lead(chord) over w as target_chord, lead(classes) over w as target_classes
  from states window w as (partition by perf order by idx)),
p1 as (select *, greatest(0, least(1, abs(target_density - density) / 2)) as change, case when target_state <> content_state then 1.0 else 0.55 end::double as moved,
  case when notes >= 4 and target_notes >= 4 and greatest(notes, target_notes) / least(notes, target_notes)::double <= 3.5::double then 'call_response' when target_density > density * 1.2::double or density > target_density * 1.2::double then 'buildup_to_release' else 'continuation' end as task
  from paired where target_idx is not null),
p2 as (select p1.*, r.distance, r.hits, (target_chord > 0)::int + (target_classes >= 2)::int as arrivals, {_ALLOWED} as fits, 0.45::double * change + 0.55::double * moved as boundary, greatest(0, least(1, poly + classes / 24.0::double)) as motif_, target_notes < 3 as blocked,
  target_notes / greatest(target_hi - target_lo, 1e-6) as td from p1 join refs r on r.perf = p1.perf and r.idx = p1.target_idx),
p3 as (select *, case when td < 0.08 then 0.1 when td < 0.25 then 0.35 when td < 1 then 0.65 when td < 4 then 0.85 else 0.75 end::double as dense,
  greatest(0, least(1, (greatest(0, least(1, density / 4)) + greatest(0, least(1, target_density / 4))) * 0.5::double)) as balance, greatest(0, least(1, 1 - least(distance, 8) / 8.0::double)) as proximity,
  case when content_state <> target_state and target_state <> 'silence_or_noise' then 1.0 when target_state in {_SOUNDING} then 0.55 else 0 end::double as turn,
  greatest(0, least(1, hits / 3.0::double)) as phrase, greatest(0, least(1, arrivals / 4.0::double)) as arrival, greatest(0, least(1, (target_hi - target_lo) / case task when 'buildup_to_release' then 6.0 else 4.0 end::double)) as lasting from p2),
p4 as (select *, round(greatest(0, least(1, 0.14::double * change + 0.12::double * balance + 0.12::double * proximity + 0.1::double * turn + 0.12::double * phrase + 0.12::double * arrival + 0.12::double * motif_ + 0.08::double * lasting + 0.08::double * dense)), 6) as evidence_,
  case when fits then 1.0 when target_state in {_SOUNDING} then 0.25 else 0.05 end::double as suitability,
  least(1, least(1, least(1, target_notes / 2.0::double * 0.8::double + 0.2::double) + case when hits > 0 then 0.04 else 0 end::double) + case when arrivals > 0 then 0.04 else 0 end::double) as complete from p3),
scored_pairs as (select *, round(greatest(0, least(1, 0.24::double * greatest(0, least(1, confidence)) + 0.14::double * suitability + 0.06::double * greatest(0, least(1, boundary)) + 0.08::double * greatest(0, least(1, evidence_)) + 0.14::double * dense
  + 0.14::double * complete + 0.1::double * motif_ + 0.14::double * 0.58::double + 0.06::double)), 6) as final_score from p4),
split_pairs as (select *, round(greatest(0, least(1, 0.45::double * final_score + 0.35::double * motif_ + 0.2::double * dense + case when target_state in ('polyphonic_full_mix', 'harmonic_dominant') then 0.03 else 0 end::double)), 6) as novelty,
  case when blocked then 'exclude' when final_score >= 0.72 and may then 'train' when final_score >= 0.6 and may then 'validation' when final_score >= 0.35 then 'review' else 'exclude' end as split from (select *, fits or (task = 'call_response' and target_state in {_SOUNDING}) as may from scored_pairs))"""
_PAIR_CTES = [*_STATES, WINDOWS_SQL, SEGMENTS_SQL, _PAIR]


@query(with_sql(*_PAIR_CTES) + "select perf, idx as context_idx, target_idx, task, round(change, 6) as density_change, round(balance, 6) as onset_balance, round(proximity, 6) as segment_proximity, turn as state_change, round(phrase, 6) as phrase_part, arrival as arrival_part, round(motif_, 6) as repetition_part, round(lasting, 6) as duration_part, dense as density_part, evidence_ as evidence from p4")
def pair_boundary_evidence(spark, sf_dir):
    """The nine parts of the evidence that a pair meets at a phrase boundary."""
    parts = ("density_change", "onset_balance", "segment_proximity", "state_change", "phrase_part", "arrival_part", "repetition_part", "duration_part", "density_part", "evidence")
    return pair_rows(spark, sf_dir).select("perf", "context_idx", "target_idx", "task", *parts)


@query(with_sql(*_PAIR_CTES) + """select perf, idx as context_idx, novelty, suitability, round(complete, 6) as completeness, may as allowed,
  content_state = target_state or (content_state in ('harmonic_dominant', 'polyphonic_full_mix') and target_state in ('harmonic_dominant', 'polyphonic_full_mix', 'melodic_lead')) or (content_state in ('rhythm_dominant', 'percussive_only') and target_state in ('rhythm_dominant', 'percussive_only', 'polyphonic_full_mix'))
  or (content_state in ('melodic_lead', 'vocal_dominant', 'rap_vocal_dominant') and target_state in ('melodic_lead', 'vocal_dominant', 'rap_vocal_dominant', 'polyphonic_full_mix')) as compatible from split_pairs""")
def pair_policies(spark, sf_dir):
    """Novelty, suitability and completeness of each pair, and whether its task and its states allow it."""
    scored = records.pair_quality(pair_rows(spark, sf_dir))
    return scored.select("perf", "context_idx", "novelty", "suitability", "completeness", records.task_allowed(F.col("target_state")).alias("allowed"), records.states_compatible(F.col("context_state"), F.col("target_state")).alias("compatible"))


@query(with_sql(*_PAIR_CTES) + "select perf, idx as context_idx, target_idx, context_state, target_state, final_score, split from (select *, content_state as context_state from split_pairs)")
def pair_split_decisions(spark, sf_dir):
    return records.pair_quality(pair_rows(spark, sf_dir)).select("perf", "context_idx", "target_idx", "context_state", "target_state", "final_score", "split")


@query(with_sql(*_PAIR_CTES) + """select perf, idx as context_idx, target_idx, case when notes >= 4 and target_notes >= 4 and greatest(notes, target_notes) / least(notes, target_notes)::double <= 3.5 then 'call_response'
  when target_density > density * 1.2::double then 'buildup' when density > target_density * 1.2::double then 'release' else 'continuation' end as task from paired where target_idx is not null""")
def pair_tasks(spark, sf_dir):
    """What kind of example a pair of neighbours is."""
    a, b = F.col("context_notes"), F.col("target_notes")
    c, d = F.col("context_density"), F.col("target_density")
    task = F.when((a >= 4) & (b >= 4) & (F.greatest(a, b) / F.least(a, b) <= 3.5), "call_response").when(d > c * 1.2, "buildup").when(c > d * 1.2, "release").otherwise("continuation")
    return pair_rows(spark, sf_dir).select("perf", "context_idx", "target_idx", task.alias("task"))


@query(with_sql(*_STATES) + """, t as (select perf, idx, density, lead(density, 1) over w as d1, lead(density, 2) over w as d2, lead(idx, 2) over w as last from states window w as (partition by perf order by idx))
select perf, idx as first_idx, last as last_idx, round(d1 - density, 6) as rise, round(d1 - d2, 6) as fall from t where last is not null and d1 > density * 1.2::double and d1 > d2 * 1.2::double""")
def buildup_release(spark, sf_dir):
    """Three bins in a row of which the middle one is densest."""
    block = F.floor(F.col("idx") / 64).cast("int")
    rows = states(spark, sf_dir).select("perf", "idx", "density", F.struct("idx", "density").alias("own"))
    one = ordered.with_next(rows, ["perf"], block, ["idx"], "own", "n1").withColumn("n1_of", F.col("n1"))
    two = ordered.with_next(one, ["perf"], block, ["idx"], "n1_of", "n2").where("n2 is not null")
    d0, d1, d2 = F.col("density"), F.col("n1.density"), F.col("n2.density")
    return two.where((d1 > d0 * 1.2) & (d1 > d2 * 1.2)).select("perf", F.col("idx").alias("first_idx"), F.col("n2.idx").alias("last_idx"), F.round(d1 - d0, 6).alias("rise"), F.round(d1 - d2, 6).alias("fall"))


@query(with_sql(*_PAIR_CTES) + "select split, count(*) as n, round(sum(round(final_score * 1e9::double)::bigint)::double / count(final_score) / 1e9::double, 6) as mean_score, round(sum(round(boundary * 1e9::double)::bigint)::double / count(boundary) / 1e9::double, 6) as mean_boundary, round(sum(round(motif_ * 1e9::double)::bigint)::double / count(motif_) / 1e9::double, 6) as mean_motif from split_pairs group by split")
def pair_diagnostics(spark, sf_dir):
    return records.pair_quality(pair_rows(spark, sf_dir)).groupBy("split").agg(F.count("*").alias("n"), *[mean6(F.col(c)).alias(a) for c, a in (("final_score", "mean_score"), ("boundary", "mean_boundary"), ("motif", "mean_motif"))])


@query(with_sql(*_PAIR_CTES) + """, s as (select perf, list_sort(list(final_score)) as x, round(sum(round(final_score * 1e9::double)::bigint)::double / count(final_score) / 1e9::double, 6) as mean from scored_pairs group by perf)
select perf, len(x) as n, mean, x[1] as least, x[round_even((len(x) - 1) * 0.25, 0)::int + 1] as p25, x[round_even((len(x) - 1) * 0.5, 0)::int + 1] as p50, x[round_even((len(x) - 1) * 0.75, 0)::int + 1] as p75, x[len(x)] as most from s""")
def nearest_rank_distribution(spark, sf_dir):
    """Seven statistics of the pairs' scores; quantiles are elements of the sorted scores: rank round((n - 1) p), half to even."""
    scores = scratch.written(records.pair_quality(pair_rows(spark, sf_dir)).select("perf", "final_score"), "scores")
    return ranks.distribution(scores, ["perf"], "final_score", mean6(F.col("final_score")))


@query(with_sql(*_PAIR_CTES) + "select perf, idx as context_idx, final_score, round(0.6 - final_score, 6) as missing from split_pairs where split = 'review' and final_score >= 0.56 order by final_score desc, perf, idx limit 25")
def salvage_topk(spark, sf_dir):
    """The 25 pairs that miss validation by least."""
    scored = records.pair_quality(pair_rows(spark, sf_dir)).select("perf", "context_idx", F.when((F.col("split") == "review") & (F.col("final_score") >= 0.56), F.col("final_score")).alias("final_score"))
    # Others sort last and go after the limit; a filter before it would be pushed down and repeat the whole score.
    top = scored.orderBy(F.desc_nulls_last("final_score"), "perf", "context_idx").limit(25).where("final_score is not null")
    return top.select("perf", "context_idx", "final_score", F.round(F.lit(0.6) - F.col("final_score"), 6).alias("missing"))


_TARGETS = f"""placed as (select channel % 8 as part, floor(start / {music.BIN})::bigint as idx, floor(start / {music.BIN}) * {music.BIN} as lo, start, "end", channel, note, vel from pairs),
kept as (select *, row_number() over w as k, start - lag(start) over w as ioi, lag(note) over w as prior from placed window w as (partition by part, idx order by start, channel, note, "end") qualify row_number() over w <= 128),
texts as (select *, 'on_' || (floor(greatest(0, start - lo) * 1000 + 0.5) / 1000)::varchar || '_dur_' || (floor(greatest(1e-4::double, "end" - start) * 1000 + 0.5) / 1000)::varchar as played, 'ioi_' || (floor(greatest(0, ioi) * 1000 + 0.5) / 1000)::varchar as step from kept),
tok as (select part, idx, greatest(1, 2 * k - 2) as pos, played as token from texts union all select part, idx, 2 * k - 1, step from texts where k > 1),
rhythms as (select part, idx, string_agg(token, ' ' order by pos) filter (where pos <= 128) as rhythm_tokens, round(count(distinct case when pos <= 32 then token end) / 32.0::double, 6) as humanization from tok group by all),
classes as (select part, idx, string_agg('pc' || pc, ' ' order by n desc, place) as chord_tokens from (select part, idx, note % 12 as pc, count(*) as n, min(k) as place from kept group by part, idx, note % 12 qualify row_number() over (partition by part, idx order by count(*) desc, min(k)) <= 6) group by all),
profiles as (select part, idx, count(*) as n, string_agg('n' || note, ' ' order by k) as pitch_tokens, coalesce(string_agg(case when note > prior then 'up' when note < prior then 'down' when note = prior then 'same' end, ' ' order by k), '') as contour_tokens,
  round(sum(vel)::double / count(*), 6) as vel_mean, max(vel) as vel_max, min(vel) as vel_min from kept group by all),
edges as (select part, idx, string_agg('n' || note, ' ' order by k) filter (where k <= 16) as first_notes, string_agg('n' || note, ' ' order by k) filter (where k > size - 16) as last_notes from (select *, count(*) over (partition by part, idx) as size from kept) group by all)"""


@query(with_sql(music.NOTES_SQL, event_plans._MESSAGES, event_plans._PAIRS, _TARGETS) + f"""select part, idx, n::int as n, rhythm_tokens, pitch_tokens, contour_tokens, chord_tokens, first_notes, last_notes, vel_mean, vel_max, vel_min, humanization, round((n - 1) / (2 * n - 1)::double, 6) as swing,
case when n / {music.BIN} < 0.08 then 0.1 when n / {music.BIN} < 0.25 then 0.35 when n / {music.BIN} < 1 then 0.65 when n / {music.BIN} < 4 then 0.85 else 0.75 end::double as density_score, round(least(1, n / {music.BIN}::double / 7.0::double), 6) as polyphony
from profiles join rhythms using (part, idx) join classes using (part, idx) join edges using (part, idx)""")
def target_tokens(spark, sf_dir):
    """Paired notes of each bin of four seconds, channels in eight parts, as tokens: the first 128 of a bin."""
    paired = event_plans.events.pair_on_off(event_plans.messages(spark, sf_dir))
    idx = F.floor(F.col("start") / music.BIN)
    placed = paired.select((F.col("channel") % 8).alias("part"), idx.alias("idx"), (idx * music.BIN).alias("lo"), ((idx + 1) * music.BIN).alias("hi"), "start", "end", "channel", "note", "vel")
    return targets.tokens(placed, ["part", "idx"])


@query(with_sql(*_RECORD_CTES, _SPLITS) + """, v as (select perf, idx, 'confidence out of range' as violation from splits where confidence < 0 or confidence > 1 union all select perf, idx, 'accepted without reliability' from splits where export_split = 'accepted_records' and tier in ('low', 'failed', 'missing')
  union all select perf, idx, 'weight over tier' from splits where training_weight > 1) select violation, count(*) as n, min(idx) as first_idx from v group by violation""")
def validators_exports(spark, sf_dir):
    """What breaks the rules of an export, as rows."""
    rule = lambda condition, name: F.when(condition, name)
    bad = F.filter(F.array(rule(~F.col("confidence").between(0, 1), "confidence out of range"), rule((F.col("export_split") == "accepted_records") & F.col("tier").isin("low", "failed", "missing"), "accepted without reliability"), rule(F.col("training_weight") > 1, "weight over tier")), lambda x: x.isNotNull())
    rows = records.export_splits(ai_record_rows(spark, sf_dir)).select("idx", F.explode(bad).alias("violation"))
    return rows.groupBy("violation").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))


@query(with_sql(*BINNED, PULSES, _CHORDS, SEGMENTS_SQL) + """, i as (select s.perf, s.idx, count(*) as n, mode(c.quality order by c.quality) as quality from segments s join chords c on c.perf = s.perf and c.lo >= s.lo and c.hi <= s.hi group by s.perf, s.idx),
w as (select (o_custkey % 30)::int as idx, count(*) as orders, round(avg(o_totalprice), 2) as price from orders group by 1)
select i.perf, i.idx, i.n, w.orders, case when w.orders is null then 'missing' when abs(i.n - 6) <= 1 and w.price > 140000 then 'supportive' when w.price < 100000 then 'conflicted' else 'neutral' end as consensus from i left join w using (idx)""".replace("mode(c.quality order by c.quality)", "min(c.quality)"))
def witness_alignment(spark, sf_dir):
    """Segments' chords beside another witness's figures (from orders), and how far they agree."""
    chords = timeline(spark, sf_dir).select("perf", F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi"), "quality")
    met = intervals.overlapping(music.segments(spark, sf_dir), chords, music.SEGMENT).where("r_lo >= lo and r_hi <= hi")
    own = met.groupBy("perf", "idx").agg(F.count("*").alias("n"))
    other = music.table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 30).cast("int").alias("idx")).agg(F.count("*").alias("orders"), F.round(F.avg("o_totalprice"), 2).alias("price"))
    verdict = F.when(F.col("orders").isNull(), "missing").when((F.abs(F.col("n") - 6) <= 1) & (F.col("price") > 140000), "supportive").when(F.col("price") < 100000, "conflicted").otherwise("neutral")
    return own.join(other, "idx", "left").select("perf", "idx", "n", "orders", verdict.alias("consensus"))


