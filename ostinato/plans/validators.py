"""Validators of feature packs, of pitch and harmony records and of examples, over records that the tables' own odd rows make wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.operators import examples, validation
from ostinato.plans.granularities import _ALL_STATES, _CHECKED, _EXAMPLE_COLUMNS, _EXAMPLES, _POLICIES, content_regions, generation_examples
from ostinato.sources.music import with_sql

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _every(n: int, column: str = "notes"):
    return F.col(column) % n == 0


#: Which section of a pack a region's record stands in.
SECTIONS = {"bin": "rhythm", "segment": "harmony", "window": "ai_record", "performance": "tag"}


def _json(*columns):
    """The fields of a record as JSON; null ones are left out."""
    return F.to_json(F.struct(*columns))


def feature_records(spark, sf_dir) -> DataFrame:
    """A record of each region as JSON. By its number of notes some lack a field, have a confidence over 1, end before they begin, or are cut off."""
    rows = content_regions(spark, sf_dir)
    section = F.lit(None).cast("string")
    for kind, name in SECTIONS.items():
        section = F.when(F.col("kind") == kind, name).otherwise(section)
    lists = [F.when(~_every(3), F.array(F.lit("x"))).alias(c) for c in ("rhythm_concepts", "philosophy_sources", "detection_targets")]
    payload = _json(
        F.concat_ws(":", "perf", "kind", "idx").alias("record_id"), F.col("perf").alias("performance_id"), F.col("kind").alias("granularity"), F.col("lo").cast("long").alias("start_seconds"), F.when(_every(23), F.col("lo") - 1).otherwise(F.col("hi")).cast("long").alias("end_seconds"),
        F.round(F.col("state_confidence") + _every(17).cast("int"), 6).alias("confidence"), F.array().cast("array<string>").alias("limitations"), F.when(~_every(19), "derived_observation").alias("label_status"), F.array("content_state").alias("evidence_refs"), F.array("content_state").alias("evidence"),
        F.lit("score").alias("confidence_reason"), F.lit("unverified").alias("verification_status"), F.lit(False).alias("review_required"), *lists,
    )
    return rows.select(F.concat_ws(":", "perf", "kind", "idx").alias("record"), section.alias("section"), F.when(_every(31), F.substring(payload, 1, 9)).otherwise(payload).alias("payload"))


_FEATURE = """records as (select perf || ':' || kind || ':' || idx as record, case kind when 'bin' then 'rhythm' when 'segment' then 'harmony' when 'window' then 'ai_record' else 'tag' end as section, notes as n, lo, state_confidence as c from states),
whole as (select * from records where n % 31 <> 0),
broken as (
  select record, section, 'parse_error' as rule, 'error' as severity, '9' as value from records where n % 31 = 0
  union all select record, section, 'confidence_range', 'warning', round(c + 1, 6)::varchar from whole where n % 17 = 0 and c > 0
  union all select record, section, 'time_range', 'error', lo::bigint::varchar from whole where n % 23 = 0
  union all select record, section, 'missing_label_status', 'warning', null from whole where n % 19 = 0 and section in ('ai_record', 'tag')
  union all select record, section, 'missing_' || f, 'warning', null from whole, (select unnest(['rhythm_concepts', 'philosophy_sources', 'detection_targets']) as f) where n % 3 = 0 and section = 'tag')"""


@query(with_sql(*_ALL_STATES, _FEATURE) + "select * from broken")
def feature_pack_violations(spark, sf_dir):
    return validation.violations(feature_records(spark, sf_dir), validation.FEATURE_RULES)


_VERDICT = """counted as (select section, 'checked' as rule, 'info' as severity, count(*) as n from records group by section union all select section, rule, severity, count(*) from broken group by all),
told as (select * from counted union all select s, 'missing_section', 'error', 0 from (select unnest({required}) as s) where s not in (select section from records))
select section, rule, severity, n::bigint as n from told
union all select null, 'status', case when count(case when severity <> 'info' then 1 end) > 0 then 'failed' else 'success' end, coalesce(sum(case when severity <> 'info' then greatest(n, 1) end), 0)::bigint from told"""


@query(with_sql(*_ALL_STATES, _FEATURE) + ", " + _VERDICT.format(required="['rhythm', 'harmony', 'tag', 'ai_record', 'motif_group']"))
def feature_pack_verdict(spark, sf_dir):
    """What the validator says of the pack as a whole; no record is a motif group, so that section lacks."""
    return validation.verdicts(feature_records(spark, sf_dir), validation.FEATURE_RULES, ["rhythm", "harmony", "tag", "ai_record", "motif_group"])


def pitch_records(spark, sf_dir) -> DataFrame:
    """Pitch and harmony records of the bins in turn: intervals, sonorities, chord movement, tuning, some of them with a fault."""
    rows = content_regions(spark, sf_dir).where("kind = 'bin'")
    names = F.array(*[F.lit(s) for s in ("interval_analysis", "harmony_sonority", "chord_movement", "tuning_system")])
    payload = _json(
        F.col("lo").cast("long").alias("start_seconds"), F.col("hi").cast("long").alias("end_seconds"), F.when(~_every(13), F.struct(F.col("classes").alias("p1"))).alias("interval_class_histogram"), F.col("chord").alias("confidence"), _every(2).alias("hard_label"),
        F.when(~_every(11), F.array(F.lit("symbolic"))).alias("limitations"), F.struct("notes").alias("evidence"), F.lit(True).alias("microtonal_analysis_available"), F.when(_every(7), "guess").otherwise("pitch_bend").alias("microtonal_evidence_type"),
    )
    return rows.select(F.concat_ws(":", "perf", "idx").alias("record"), F.get(names, F.col("idx") % 4).alias("section"), payload.alias("payload"))


_PITCH = """records as (select perf || ':' || idx as record, ['interval_analysis', 'harmony_sonority', 'chord_movement', 'tuning_system'][idx % 4 + 1] as section, notes as n, chord from states where kind = 'bin'),
broken as (
  select record, section, 'no_interval_histogram' as rule, 'error' as severity, null as value from records where section = 'interval_analysis' and n % 13 = 0
  union all select record, section, 'hard_label_unsure', 'error', chord::varchar from records where section = 'harmony_sonority' and n % 2 = 0 and chord < 0.8
  union all select record, section, 'no_limitations', 'error', null from records where section in ('harmony_sonority', 'chord_movement') and n % 11 = 0
  union all select record, section, 'evidence_type', 'error', 'guess' from records where section = 'tuning_system' and n % 7 = 0)"""


@query(with_sql(*_ALL_STATES, _PITCH) + "select * from broken")
def pitch_harmony_violations(spark, sf_dir):
    return validation.violations(pitch_records(spark, sf_dir), validation.PITCH_RULES)


def example_records(spark, sf_dir) -> DataFrame:
    """Examples as JSON records, with splits and scores of which some don't fit."""
    made = generation_examples(spark, sf_dir)
    split = F.get(F.array(*[F.lit(s) for s in ("train", "validation", "test", "review", "exclude")]), (F.col("context_notes") % 5).cast("int"))
    empty = F.array().cast("array<string>")
    payload = _json(
        F.col("task").alias("task_type"), split.alias("split_recommendation"), F.col("context_lo").alias("context_start_seconds"), F.col("context_hi").alias("context_end_seconds"), F.col("target_lo").alias("target_start_seconds"), F.col("target_hi").alias("target_end_seconds"),
        F.col("context_lo").alias("start_seconds"), F.col("target_hi").alias("end_seconds"), F.struct(F.col("motif").alias("final_score")).alias("quality_score"), F.struct("motif").alias("quality_component_breakdown"), F.struct("context_state").alias("conditioning"),
        empty.alias("split_reason_codes"), empty.alias("failed_policy_checks"), F.when(~_every(8, "context_notes"), empty).alias("missing_refs"), F.when(~_every(9, "target_notes"), "target.mid").alias("target_midi_ref"), F.lit("merged.mid").alias("full_midi_ref"),
        F.sequence(F.lit(1).cast("long"), F.least(F.col("target_notes"), F.lit(300))).alias("target_representation"),
    )
    return made.select(F.concat_ws(":", "perf", "kind", "idx", "task", "note").alias("record"), F.lit("example").alias("section"), payload.alias("payload"))


_EXAMPLE_RECORDS = f"""rows as (select {_EXAMPLE_COLUMNS} from judged),
records as (select perf || ':' || kind || ':' || idx || ':' || task || ':' || note as record, 'example' as section, context_notes as a, target_notes as b, motif from rows),
broken as (
  select record, section, 'split' as rule, 'error' as severity, 'test' as value from records where a % 5 = 2
  union all select record, section, 'poor_train', 'error', motif::varchar from records where a % 5 = 0 and motif < 0.72
  union all select record, section, 'poor_validation', 'error', motif::varchar from records where a % 5 = 1 and motif < 0.6
  union all select record, section, 'no_missing_refs', 'error', null from records where a % 8 = 0
  union all select record, section, 'missing_target_midi_ref', 'error', null from records where b % 9 = 0
  union all select record, section, 'huge_array', 'error', least(b, 300)::varchar from records where b > 256)"""
_TASKS = [p[0] for p in examples.POLICIES]


@query(with_sql(*_ALL_STATES, _POLICIES, _EXAMPLES, _CHECKED, _EXAMPLE_RECORDS) + "select * from broken")
def example_violations(spark, sf_dir):
    return validation.violations(example_records(spark, sf_dir), validation.example_rules(_TASKS))


@query(with_sql(*_ALL_STATES, _POLICIES, _EXAMPLES, _CHECKED, _EXAMPLE_RECORDS) + ", " + _VERDICT.format(required="['example']"))
def example_verdict(spark, sf_dir):
    return validation.verdicts(example_records(spark, sf_dir), validation.example_rules(_TASKS), ["example"])
