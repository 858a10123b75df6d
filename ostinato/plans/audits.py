"""Queries on pattern lists, asset types, training audits, readiness and tags by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.functions.scalars import mean6
from ostinato.operators import audits, keyed_tags, lexicon, pattern_index, records, rhythm
from ostinato.plans import corpus
from ostinato.plans import records as record_plans
from ostinato.plans import rhythm as rhythm_plans
from ostinato.plans.corpus import _MOTIF_CTES
from ostinato.plans.granularities import _ALL_STATES, content_regions
from ostinato.plans.rhythm import in_windows
from ostinato.sources import ingest, music, scratch
from ostinato.sources.music import table, with_sql

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def pattern_groups(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Repeated motifs with their best known pattern, and accents, from grids that are made once."""
    grid = scratch.written(rhythm_plans.grids(spark, sf_dir), "grid")
    grouped = rhythm.motif_ngrams(grid).groupBy("perf", "gram").agg(F.count("*").alias("repeats"), F.count_distinct("idx").alias("regions"), F.min_by("marks", F.struct("idx", "place")).alias("marks")).where("repeats >= 2")
    motifs = grouped.select("perf", F.concat("gram", F.lit("@"), "perf").alias("motif_id"), F.col("gram").alias("pattern"), F.translate("marks", "A", "X").alias("accents"), "repeats", "regions", rhythm.onset_ratios(F.col("gram")).alias("ratios"))
    motifs = scratch.written(motifs, "motifs")
    best = lexicon.family_matches(motifs, k=1).select("motif_id", "family", "match", "strength", "confidence", "ambiguity")
    return motifs.join(best, "motif_id"), pattern_index.accent_counts(grid)


_GROUPS = """groups as (select f.perf, f.gram as pattern, f.repeats, f.regions, m.family, m.match, m.strength, m.confidence, m.ambiguity from firsts f join matched m on m.motif_id = f.gram || '@' || f.perf and m.rank = 1),
runs as (select perf, idx, substr(accents, place, size) as pattern from (select *, unnest(range(1, length(accents) - size + 2)) as place from (select *, unnest(range(3, least(12, length(accents)) + 1)) as size from grids))),
parts as (select perf, idx, pattern, count(*) as n from runs where length(replace(pattern, '.', '')) >= 2 group by all having count(*) >= 2),
accented as (select perf, pattern, sum(n)::bigint as repeats, count(distinct idx) as regions from (select perf, idx, accents as pattern, 1 as n from grids union all select * from parts) group by all)"""


@query(with_sql(*_MOTIF_CTES, _GROUPS) + """, l as (
  select perf, 'top_groups' as list, pattern, repeats, regions, family, strength, confidence, row_number() over w as rank, 10 as k from groups window w as (partition by perf order by repeats desc, regions desc, pattern)
  union all select perf, 'dense_bursts', pattern, repeats, regions, family, strength, confidence, row_number() over w, 10 from groups where contains(pattern, 'x') and repeats >= 4 window w as (partition by perf order by repeats desc, regions desc, pattern)
  union all select perf, 'sparse_calls', pattern, repeats, regions, family, strength, confidence, row_number() over w, 10 from groups where contains(pattern, '.') and repeats >= 3 window w as (partition by perf order by repeats desc, regions desc, pattern)
  union all select perf, 'families', pattern, repeats, regions, family, strength, confidence, row_number() over w, 20 from groups where match is not null and strength in ('strong', 'moderate') window w as (partition by perf order by (strength = 'strong')::int desc, confidence desc, repeats desc, pattern)
  union all select perf, 'unknown', pattern, repeats, regions, family, strength, confidence, row_number() over w, 20 from groups where match is null and repeats + regions >= 8 window w as (partition by perf order by repeats + regions desc, repeats desc, regions desc, pattern)
  union all select perf, 'accents', pattern, repeats, regions, null, null, null, row_number() over w, 12 from accented where repeats >= 2 window w as (partition by perf order by repeats desc, pattern))
select perf, list, rank::int as rank, pattern, repeats, regions, family, strength, confidence::double as confidence from l where rank <= k""")
def pattern_lists(spark, sf_dir):
    """The leading motif groups, accents and family matches of each performance, and its patterns without a family."""
    return pattern_index.lists(*pattern_groups(spark, sf_dir))


@query(with_sql(*_MOTIF_CTES, _GROUPS) + """ select perf, count(*) as "groups", count(case when not contains(pattern, '.') then 1 end) as all_onset_groups, count(case when match is null then 1 end) as ambiguous_groups,
  count(case when match is not null and strength not in ('strong', 'moderate') and repeats + regions >= 15 then 1 end) as weak_high_frequency_groups,
  coalesce(sum(case when match is not null and (strength = 'strong' or (strength = 'moderate' and repeats + regions >= 10 and coalesce(ambiguity, 1) <= 0.3::double)) then repeats end), 0)::bigint as taggable_repeats from groups group by perf""")
def pattern_diagnostics(spark, sf_dir):
    """How well the known patterns explain what each performance repeats."""
    return pattern_index.diagnostics(pattern_groups(spark, sf_dir)[0])


_ASSET_CONDITIONS = [
    "true", "seconds >= 120", "seconds >= 180 and segments >= 3", "false", "false", "ambient >= 0.55 and density < 1", "drums >= 0.55 and chord < 0.35 and loops", "drums >= 0.55 and chord < 0.35 and not loops",
    "chord >= 0.65 and poly >= 0.15 and loops and seconds < 90", "chord >= 0.65 and poly >= 0.15 and not (loops and seconds < 90)", "seconds <= 5 and drums >= 0.45", "false", "seconds <= 5 and drums < 0.45", "seconds < 60 and loops and chord < 0.5 and density >= 1",
]
_ASSETS_SQL = "[" + ", ".join(f"case when {c} then {{'s': {-s}::double, 'nth': {i}, 'name': '{n}', 'reason': '{r}'}} end" for i, (c, (n, s, r)) in enumerate(zip(_ASSET_CONDITIONS, audits.ASSETS))) + "]"


@query(with_sql(*_ALL_STATES) + f""", a as (select perf, kind, idx, notes, density, poly, chord, hi - lo as seconds, ceil((hi - lo) / {music.SEGMENT}) as segments, floor((hi - lo) / {music.WINDOW}) as windows, (content_state = 'ambient_low_information')::int as ambient, (content_state in ('rhythm_dominant', 'percussive_only'))::int as drums, hi - lo <= 64 as loops from states),
r as (select *, list_sort(list_filter({_ASSETS_SQL}, lambda x: x is not null)) as ranked from a)
select perf, kind, idx, ranked[1].name as asset_type, -ranked[1].s as asset_confidence, ranked[1].reason as reason, array_to_string(list_transform(ranked[2:4], lambda x: x.name), ',') as alternates, case when windows <= 0 then '{audits.NO_WINDOWS}' else '' end as limitations,
  ranked[1].name not in ('one_shot_drum', 'one_shot_synth', 'vocal_sample', 'speech_heavy') as should_stitch, ranked[1].name not in ('one_shot_drum', 'one_shot_synth') as should_segment, ranked[1].name not in ('ambient_texture', 'speech_heavy') as should_transcribe, case when seconds <= 5 then 1 when seconds <= 60 then 2 else 4 end as most_windows from r""")
def asset_candidates(spark, sf_dir):
    """The kind of asset that each region would be on its own. Tags of drums and ambience come from its content state; it has none of voices."""
    seconds, state = F.col("hi") - F.col("lo"), F.col("content_state")
    facts = content_regions(spark, sf_dir).select(
        "perf", "kind", "idx", F.col("notes").alias("records"), "density", "poly", "chord", seconds.alias("seconds"), F.ceil(seconds / music.SEGMENT).alias("segments"), F.floor(seconds / music.WINDOW).alias("windows"),
        F.lit(0.0).alias("vocal"), F.lit(0.0).alias("speech"), (state == "ambient_low_information").cast("double").alias("ambient"), state.isin("rhythm_dominant", "percussive_only").cast("double").alias("percussive"), (seconds <= 64).alias("loop"),
    )
    told = audits.asset_types(facts)
    return told.select("perf", "kind", "idx", "asset_type", "asset_confidence", "reason", F.array_join("alternates", ",").alias("alternates"), F.array_join("limitations", " ").alias("limitations"), "should_stitch", "should_segment", "should_transcribe", "most_windows")


def audited_records(rows: DataFrame) -> DataFrame:
    """Records with what routing keeps back from them, and for weak ones what becomes of their labels.

    Harmonic evidence is a score or a chord of 0.58 or five pitch classes; a suppression of chords is likely false from 0.62 on.
    """
    weak = F.col("label_status").isin("weak_label", "review_required")
    harmonic = F.col("content_state").isin("harmonic_dominant", "polyphonic_full_mix", "melodic_lead")
    judged = record_plans.upgraded(rows).withColumn("recommendation", F.when(weak, F.col("recommendation")))
    routed = records.routed(judged)
    return routed.select(
        F.col("perf").alias("performance"), "label_status", (F.col("label_status") == "human_verified_label").alias("verified"),
        F.when(F.col("suppressed") == "", 0).otherwise(F.size(F.split("suppressed", ","))).alias("suppressed"), "recommendation", F.when(weak, F.col("family")).alias("family"),
        (F.contains("suppressed", F.lit("chord_movement")) & ((F.col("harmony") >= 0.62) | (F.col("chord") >= 0.62))).alias("false_suppression"),
        (((F.col("harmony") >= 0.58) | (F.col("chord") >= 0.58) | (F.col("classes") >= 5)) & ~harmonic).alias("harmonic_suppressed"),
    )


_AUDIT = f"""rec as (select * from ({with_sql(*record_plans._RECORD_CTES)} select * from records)), up as ({record_plans.ORACLES["label_upgrades"]}),
meters as (select perf, round(sum(round(confidence * 1e9::double)::bigint)::double / count(confidence) / 1e9::double, 6) as sure, round(sum(round(ambiguity * 1e9::double)::bigint)::double / count(ambiguity) / 1e9::double, 6) as unclear from ({rhythm_plans.ORACLES["meter_hypotheses"]}) where rank = 1 group by perf),
gate as ({record_plans.ORACLES["quality_gates"]}), {record_plans._POLICY},
b as (select r.perf, r.label_status, u.family, u.recommendation, case when suppressed = '' then 0 else len(string_split(suppressed, ',')) end as kept_back, contains(suppressed, 'chord_movement') and (harmony >= 0.62::double or chord >= 0.62::double) as wrong,
  (harmony >= 0.58::double or chord >= 0.58::double or classes >= 5) and r.content_state not in ('harmonic_dominant', 'polyphonic_full_mix', 'melodic_lead') as harmonic
  from rec r join policy p on p.content_state = r.content_state left join up u on u.perf = r.perf and u.idx = r.idx),
t as (select perf, count(*) as records, count(case when label_status = 'human_verified_label' then 1 end) as verified, sum(kept_back)::bigint as kept_back, count(case when wrong then 1 end) as wrong, count(case when harmonic then 1 end) as harmonic,
  count(case when recommendation = 'upgrade_candidate' then 1 end) as up, count(case when recommendation in ('downgrade_candidate', 'suppress_candidate') then 1 end) as down, count(case when recommendation = 'needs_human_review' then 1 end) as review from b group by perf),
s as (select perf, string_agg(label_status || '=' || n, ',' order by label_status) as statuses from (select perf, label_status, count(*) as n from b group by all) group by perf),
f as (select perf, string_agg(family || '=' || up, ',' order by family) filter (where up > 0) as ups, string_agg(family || '=' || down, ',' order by family) filter (where down > 0) as downs
  from (select perf, family, count(case when recommendation = 'upgrade_candidate' then 1 end) as up, count(case when recommendation in ('downgrade_candidate', 'suppress_candidate') then 1 end) as down from b where family is not null group by all) group by perf)"""


@query("with " + _AUDIT + """ select perf as performance, records, statuses as label_statuses, case when verified = 0 then 'human verification labels' end as missing, kept_back as suppressed_labels, wrong as false_suppressions, harmonic as harmonic_suppressed,
  case when wrong = 0 and harmonic <= 3 then 'healthy' when wrong >= 20 or harmonic >= 50 then 'needs_recalibration' else 'monitor' end as calibration, up as upgrades, coalesce(ups, '') as upgrades_by_family, down as downgrades, coalesce(downs, '') as downgrades_by_family, review as to_review,
  coalesce(sure, 0) as meter_confidence, coalesce(unclear, 1) as meter_ambiguity, case when sure >= 0.65::double and unclear <= 0.45::double then 'safe_for_observation_fields' else 'weak_or_review_only' end as meter_use,
  coalesce(g.status, 'review_required') as inclusion, case g.status when 'accepted' then 'train' when 'quarantined' then 'quarantine' else 'review' end as recommended_split
from t join s using (perf) left join f using (perf) left join meters using (perf) left join gate g using (perf)""")
def training_audit(spark, sf_dir):
    """What the records of each performance can be trained on; records are made once, the meters are those of its windows."""
    rows = scratch.written(record_plans.ai_record_rows(spark, sf_dir), "records")
    found = rhythm.meter_hypotheses(rhythm.with_gaps(in_windows(spark, sf_dir))).where("rank = 1")
    meters = found.groupBy(F.col("perf").alias("performance")).agg(mean6(F.col("confidence")).alias("confidence"), mean6(F.col("ambiguity")).alias("ambiguity"))
    split = F.when(F.col("status") == "accepted", "train").when(F.col("status") == "quarantined", "quarantine").otherwise("review")
    gates = record_plans.gate_statuses(rows).select(F.col("perf").alias("performance"), F.col("status").alias("quality_status"), split.alias("split"))
    return audits.training_audit(audited_records(rows), meters, gates)


_SIGNS = f"""leaks as (select source, sum(case when kind = 'new_or_changed_public_leak' then n end) as fresh, sum(case when kind <> 'new_or_changed_public_leak' then n end) as debt from ({corpus.ORACLES["privacy_scan"]}) group by source),
docs as (select source, count(case when quality = 0 then 1 end) as queued, count(quality) as scored, count(case when quality = 1 then 1 end) as examples, count(case when toxic = 1 then 1 end) as feedback, count(case when doc_id % 7 = 0 and quality = 0 then 1 end) as unauthorized from documents left join labels using (doc_id) group by source),
s as (select d.*, coalesce(fresh, 0) as fresh, coalesce(debt, case when fresh is null then 1 else 0 end) as debt from docs d left join leaks l on l.source is not distinct from d.source)"""


@query("with " + _SIGNS + """, h as (select *, fresh = 0 as a, unauthorized = 0 as b, scored > 0 as c, queued > 0 as d, examples > 0 as e, feedback > 0 as f from s),
r as (select *, a and b and c and d and e and f as trained, a and b and c and d and e and f and debt = 0 as large from h),
t as (select *, list_filter([case when not a then 'privacy leak scan reports new public leaks' end, case when not b then 'source authorization validation failed' end, case when not c then 'historical path scrub plan is missing' end, case when not d then 'manual review queue artifacts are missing' end,
  case when not c then 'quality scorecards are missing' end, case when not e then 'symbolic corpus export is not training-ready' end, case when not f then 'human feedback loop artifacts are missing' end, case when not large then 'historical privacy debt remains above zero' end], lambda x: x is not null) as told from r)
select source, a as ready_for_batch, trained as ready_for_training, large as ready_at_large, len(told)::int as blockers, case when len(told) = 0 then 'none' else array_to_string(told[1:6], '; ') end as top_blockers, queued as reviews, round(queued * 0.08::double, 2) as review_hours, case when queued > 100 then 'blocked' else 'partial' end as review_burden from t""")
def ingestion_readiness(spark, sf_dir):
    """Stand-ins, inputs only: a source of documents is a corpus, its labels are scores, those of low quality wait for review, toxic ones are feedback."""
    leaks = corpus.privacy_scan(spark, sf_dir).groupBy("source", (F.col("kind") == "new_or_changed_public_leak").alias("fresh")).agg(F.sum("n").alias("n"))
    leaks = leaks.groupBy(F.col("source").alias("_source")).agg(F.sum(F.when(F.col("fresh"), F.col("n"))).alias("new_leaks"), F.coalesce(F.sum(F.when(~F.col("fresh"), F.col("n"))), F.lit(0)).alias("debt"))
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    low = F.col("quality") == 0
    docs = joined.groupBy("source").agg(F.count_if(low).alias("queued"), F.count("quality").alias("scored"), F.count("quality").alias("planned"), F.count("quality").alias("evaluated"), F.count_if(F.col("quality") == 1).alias("examples"), F.count_if(F.col("toxic") == 1).alias("feedback"), F.count_if(low & (F.col("doc_id") % 7 == 0)).alias("unauthorized"), F.count_if(low).alias("reviews"))
    return audits.ingestion_readiness(docs.join(leaks, docs["source"].eqNullSafe(leaks["_source"]), "left"), "source")


_KEYED = with_sql(*record_plans.WINDOWED, record_plans.PULSES, record_plans._SMALL_VECTOR, record_plans._TAGS) + f""", r as (select perf || ':' || kind || ':' || idx as record, case when idx % 4 <> 3 then perf || ':' || idx end as window_id, case when idx % 6 = 5 then null else lo end as lo, hi from windows),
g as (select perf || ':' || idx || ':' || tag as seq, case when idx % 4 <> 3 then perf || ':' || idx end as window_id, case when idx % 5 <> 4 then idx * {music.WINDOW} end as lo, (idx + 1) * {music.WINDOW} as hi, tag, tag_confidence as sure from tags),
met as (select record, tag, sure, row_number() over (partition by record order by sure desc, seq) as nth from r join g on g.window_id is not distinct from r.window_id where r.lo is null or g.lo is null or (g.hi >= r.lo and g.lo <= r.hi))
select record, nth::int as nth, tag, sure from met where nth <= 5"""


@query(_KEYED)
def window_tags(spark, sf_dir):
    """The five surest tags of the window that a record names. Stand-ins, inputs only: each fourth window has no name, some rows no start."""
    named = F.when(F.col("idx") % 4 != 3, F.concat_ws(":", "perf", "idx")).alias("window_id")
    w = music.windows(spark, sf_dir).select(F.concat_ws(":", "perf", "kind", "idx").alias("record"), named, F.col("kind").alias("granularity"), F.when(F.col("idx") % 6 != 5, F.col("lo")).alias("lo"), "hi")
    found = records.tagged(record_plans.vectors(spark, sf_dir))
    t = found.select(F.concat_ws(":", "perf", "idx", "tag").alias("seq"), named, F.lit("window").alias("granularity"), F.when(F.col("idx") % 5 != 4, F.col("idx") * music.WINDOW).alias("lo"), ((F.col("idx") + 1) * music.WINDOW).alias("hi"), "tag", F.col("tag_confidence").alias("sure"))
    return keyed_tags.top_tags(scratch.written(w, "named"), scratch.written(t, "tags"), music.WINDOW)


@query(r"""with p as (select url as path, min(html) as html from pages where url is not null group by url), n as (select *, regexp_extract(path, '[^/]*$', 0) as name from p where path not in (select url from pages where page_id % 10 = 0 and url is not null)),
s as (select *, regexp_replace(regexp_replace(regexp_replace(name, '(.)\.[^.]*$', '\1'), '[^a-zA-Z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') as stem from n)
select path as source_path, name as source_name, '20240101T000000000000_' || stem || case when row_number() over (partition by stem order by path) > 1 then '_' || substr(sha256(path), 1, 8) else '' end as performance_id, sha256(html) as checksum, 'ingested' as status, 6 as pending from s""")
def ingest_manifests(spark, sf_dir):
    """Stand-ins, inputs only: pages are files by their address, each tenth is in the log already."""
    pages = table(spark, sf_dir, "pages").where("url is not null")
    found = pages.groupBy(F.col("url").alias("path")).agg(F.sha2(F.min("html"), 256).alias("checksum")).withColumn("duration_seconds", F.lit(None).cast("double"))
    known = pages.where("page_id % 10 = 0").select(F.col("url").alias("source_path"))
    rows = ingest.manifests(found, known, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return rows.select("source_path", "source_name", "performance_id", "checksum", "status", F.size(F.filter("steps", lambda x: x["status"] == "pending")).alias("pending"))
