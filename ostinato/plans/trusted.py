"""Queries on what may be exported of the records of all four granularities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.operators import trust
from ostinato.plans.events import _METRICS, _RELIABLE, reliable_windows
from ostinato.plans.granularities import _ALL_STATES, content_regions
from ostinato.sources import music
from ostinato.sources.music import with_sql

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def exported(spark, sf_dir) -> DataFrame:
    """Records of all regions with events; the tables have no faulty ones, so faults are planted by the numbers of notes.

    A performance is quarantined if its windows have an odd number of notes: a planted fault, too.
    """
    windows = reliable_windows(spark, sf_dir).select("perf", F.concat_ws(":", "perf", "idx").alias("window_id"), "notes", "tier", "score", "weight")
    gates = windows.groupBy(F.col("perf").alias("performance_id")).agg(F.when(F.sum("notes") % 2 == 1, "quarantined").otherwise("accepted").alias("gate_status"))
    n, idx = F.col("notes"), F.col("idx")
    every = lambda k, value: F.when(n % k != 0, value)
    own_window = F.when(F.col("kind").isin("window", "bin"), F.concat_ws(":", "perf", F.floor(F.col("lo") / music.WINDOW)))
    label = F.when(idx % 11 == 3, "human_verified_label").when(idx % 3 == 0, "weak_label").when(idx % 5 == 0, "unlabelled").when(idx % 7 != 0, "derived_observation")
    rows = content_regions(spark, sf_dir).select(
        F.concat_ws(":", "perf", "kind", "idx").alias("region"), "kind", "perf", F.coalesce(every(13, F.concat_ws(":", "perf", "kind", "idx")), F.lit(" ")).alias("record_id"), every(29, F.col("perf")).alias("performance_id"),
        F.col("lo").alias("start_seconds"), every(17, F.col("hi")).alias("end_seconds"), every(19, F.col("kind")).alias("source_artifact_paths"), every(23, F.lit("1")).alias("feature_version"),
        own_window.alias("window_id"), F.col("kind").alias("granularity"), label.alias("label_status"), F.col("state_confidence").alias("confidence"),
    )
    return trust.classified(rows, windows.drop("perf", "notes"), gates)


_EXPORTED = f"""gate as (select perf, sum(notes) % 2 = 1 as barred from weighted group by perf),
recs as (select s.perf, s.kind, s.idx, s.perf || ':' || s.kind || ':' || s.idx as region, state_confidence as confidence,
  case when s.idx % 11 = 3 then 'human_verified_label' when s.idx % 3 = 0 then 'weak_label' when s.idx % 5 = 0 then 'unlabelled' when s.idx % 7 <> 0 then 'derived_observation' else 'weak_label' end as label,
  concat_ws('; ', case when s.notes % 13 = 0 then 'missing record_id' end, case when s.notes % 29 = 0 then 'missing performance_id' end, case when s.notes % 17 = 0 then 'invalid time range' end, case when s.notes % 19 = 0 then 'missing source_artifact_paths' end, case when s.notes % 23 = 0 then 'missing feature_version' end) as faults,
  case when s.kind in ('performance', 'segment') then 'high' else coalesce(w.tier, 'low') end as tier, case when s.kind in ('performance', 'segment') then 0.95::double else coalesce(w.score, 0) end::double as score,
  case when s.kind in ('performance', 'segment') then 1::double else coalesce(w.weight, 0) end::double as weight, coalesce(g.barred, false) as barred
  from states s left join weighted w on w.perf = s.perf and w.idx = floor(s.lo / {music.WINDOW}) left join gate g on g.perf = s.perf),
told as (select *, case when faults <> '' then 'quarantined_records' when barred then 'review_required_records' when label = 'human_verified_label' then 'accepted_records'
    when label = 'weak_label' then case when confidence < 0.35 or tier in ('low', 'failed') then 'review_required_records' else 'weak_label_records' end
    when tier in ('high', 'medium') and confidence >= 0.4 then case when label = 'derived_observation' then 'accepted_records' else 'audio_midi_only_records' end else 'review_required_records' end as split from recs)"""
_WINDOWED = _METRICS[3].replace("located as", "wlocated as"), _METRICS[4].replace("gaps as", "wgaps as").replace("from located", "from wlocated"), _METRICS[5].replace("from gaps", "from wgaps")
_TRUST = [*_ALL_STATES, *_METRICS[1:3], *_WINDOWED, _RELIABLE, _EXPORTED]


@query(with_sql(*_TRUST) + """select region, kind, perf, case when faults = '' then tier end as tier, case when faults = '' then score end as score, split,
case when faults <> '' then faults when barred then 'quality gates quarantined this performance' when label = 'human_verified_label' then 'human verified label' when label = 'weak_label' and split = 'weak_label_records' then 'weak label separated from accepted observations'
  when label = 'weak_label' then 'weak/heuristic label with insufficient confidence or reliability' when split = 'accepted_records' then 'high/medium reliability observation record' when split = 'audio_midi_only_records' then 'reliable timing/transcription context without safe labels' else 'ambiguous or low-confidence record' end as reasons,
case when faults <> '' then null when barred then weight when label = 'human_verified_label' then greatest(weight, 0.9) when split = 'weak_label_records' then least(weight, 0.7) when split = 'accepted_records' then greatest(weight, 0.7) when split = 'audio_midi_only_records' then greatest(weight, 0.6) else weight end::double as weight from told""")
def export_trust(spark, sf_dir):
    """Split, weight and reasons of each record."""
    return exported(spark, sf_dir).select("region", "kind", "perf", "tier", "score", "split", F.array_join("reasons", "; ").alias("reasons"), "weight")


@query(with_sql(*_TRUST) + "select kind, split, count(*) as n, count(distinct perf) as performances from told group by kind, split")
def export_trust_counts(spark, sf_dir):
    return exported(spark, sf_dir).groupBy("kind", "split").agg(F.count("*").alias("n"), F.count_distinct("perf").alias("performances"))
