"""Validators: rules as data over JSON records, all evaluated in one scan into rows (record, rule, value).

A record is a section's name and its JSON text, kept as a VARIANT, so a record may lack fields, hold others, or be no object at all. A
rule names the sections that it looks at, a kind of check, a field as a path, and the check's arguments. ``violations`` compiles a
validator's rules to one array of conditions and explodes what fails; nothing is joined or shuffled, and records that break no rule make
no row. What concerns a whole pack (sections that are missing, numbers of records) is counted from pre-aggregated rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """``sections``: where it holds, '*' for all. Kinds of check, with their arguments:

    parsed (none): the text is a JSON object. present: the field is there, also as null. listed, object: there, and an array or an object.
    range (least, most): if there and not null, a number within both. ordered (other): if both are there, two numbers and the other one is not
    smaller. before (other): two numbers, and the other one is larger. one_of (values): there, and one of them. least_if (other, its value, least): where
    the other field has that value, a number not below. most_if: the same, not above. shorter (most): if an array, of at most so many elements.
    absent: not there.
    """

    name: str
    sections: tuple[str, ...]
    kind: str
    field: str = ""
    args: tuple = ()
    severity: str = "error"


ALL = ("*",)
#: What a feature pack, pitch and harmony records, and examples have to hold.
_TIMES = Rule("time_range", ALL, "ordered", "start_seconds", ("end_seconds",))
_TRUST = ("label_status", "evidence_refs", "confidence_reason", "verification_status", "review_required")
FEATURE_RULES = [
    Rule("parse_error", ALL, "parsed"),
    Rule("confidence_range", ALL, "range", "confidence", (0.0, 1.0), "warning"),
    _TIMES,
    *[Rule(f"missing_{f}", ("tag",), "present", f, severity="warning") for f in ("confidence", "evidence", "rhythm_concepts", "philosophy_sources", "detection_targets")],
    *[Rule(f"missing_{f}", ("ai_record",), "present", f) for f in ("record_id", "performance_id", "granularity", "start_seconds", "end_seconds", "limitations")],
    *[Rule(f"missing_{f}", ("ai_record", "tag"), "present", f, severity="warning") for f in _TRUST],
    Rule("motif_refs_no_list", ("ai_record",), "listed_if_there", "motif_group_refs"),
    Rule("harmony_refs_no_list", ("ai_record",), "listed_if_there", "harmony_pattern_index_refs"),
]
GRANULARITIES = ["performance", "segment", "window", "rhythm_region", "chord_region"]
EVIDENCE_TYPES = ("pitch_bend", "non_12tet_audio_estimate", "repeated_detuned_pitch", "external_analyzer_required", "unavailable")
PITCH_SECTIONS = ["pitch_observations", "interval_analysis", "melody_contour", "harmony_sonority", "chord_movement", "counterpoint", "tuning_system"]
PITCH_RULES = [
    Rule("parse_error", ALL, "parsed"),
    _TIMES,
    Rule("no_interval_histogram", ("interval_analysis",), "object", "interval_class_histogram"),
    Rule("missing_confidence", ("harmony_sonority",), "present", "confidence"),
    Rule("no_limitations", ("harmony_sonority", "chord_movement"), "listed", "limitations"),
    Rule("hard_label_unsure", ("harmony_sonority",), "least_if", "confidence", ("hard_label", "true", 0.8)),
    Rule("no_evidence", ("chord_movement",), "object", "evidence"),
    Rule("no_availability", ("tuning_system",), "present", "microtonal_analysis_available"),
    Rule("evidence_type", ("tuning_system",), "one_of", "microtonal_evidence_type", EVIDENCE_TYPES),
    *[Rule("hard_key_unsure", ("key_hypothesis",), "least_if", "confidence", ("label", label, 0.8)) for label in ("major", "minor", "ionian", "dorian", "c_major")],
    Rule("unavailable_but_sure", ("payload",), "most_if", "microtonal_confidence", ("microtonal_analysis_available", "false", 0.5)),
]
SPLITS, LONGEST = ("train", "validation", "review", "exclude"), 256
_SECONDS = ("context_start_seconds", "context_end_seconds", "target_start_seconds", "target_end_seconds", "start_seconds", "end_seconds")


def example_rules(tasks: list[str]) -> list[Rule]:
    return [
        Rule("parse_error", ALL, "parsed"),
        Rule("task_type", ALL, "one_of", "task_type", tuple(tasks)),
        Rule("split", ALL, "one_of", "split_recommendation", SPLITS),
        *[Rule(f"missing_{f}", ALL, "present", f) for f in _SECONDS],
        Rule("context_range", ALL, "before", "context_start_seconds", ("context_end_seconds",)),
        Rule("target_range", ALL, "before", "target_start_seconds", ("target_end_seconds",)),
        Rule("no_quality", ALL, "object", "quality_score"),
        Rule("bad_score", ALL, "range", "quality_score.final_score", (0.0, float("inf"))),
        Rule("poor_train", ALL, "least_if", "quality_score.final_score", ("split_recommendation", "train", 0.72)),
        Rule("poor_validation", ALL, "least_if", "quality_score.final_score", ("split_recommendation", "validation", 0.6)),
        *[Rule(f"no_{f}", ALL, "listed", f) for f in ("split_reason_codes", "failed_policy_checks", "missing_refs")],
        Rule("no_breakdown", ALL, "object", "quality_component_breakdown"),
        *[Rule(f"missing_{f}", ALL, "present", f) for f in ("target_midi_ref", "full_midi_ref")],
        Rule("no_conditioning", ALL, "object", "conditioning"),
        Rule("style_as_truth", ALL, "absent", "conditioning.style_tags_ground_truth"),
        Rule("huge_array", ALL, "shorter", "target_representation", (LONGEST,)),
    ]


def _at(path: str, kind: str) -> Column:
    return F.try_variant_get("_v", f"$.{path}", kind)


def _is(path: str, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(_at(path, "variant")), F.lit(kind)), F.lit(False))


def _broken(rule: Rule) -> Column:
    """Whether a record, parsed as ``_v``, breaks the rule."""
    there, value = _at(rule.field, "variant").isNotNull(), _at(rule.field, "string")
    number = _at(rule.field, "double")
    a = rule.args
    # A field that is there as null counts as zero for a bound, as one that lacks does.
    bounded = F.when(value.isNull(), F.lit(0.0)).otherwise(number)
    of = {
        "present": lambda: ~there,
        "absent": lambda: there,
        "listed": lambda: ~_is(rule.field, "ARRAY"),
        "listed_if_there": lambda: there & ~_is(rule.field, "ARRAY"),
        "object": lambda: ~_is(rule.field, "OBJECT"),
        "range": lambda: value.isNotNull() & (number.isNull() | ~number.between(*a)),
        "ordered": lambda: value.isNotNull() & _at(a[0], "string").isNotNull() & (number.isNull() | _at(a[0], "double").isNull() | (_at(a[0], "double") < number)),
        "before": lambda: ~F.coalesce(number < _at(a[0], "double"), F.lit(False)),
        "one_of": lambda: ~F.coalesce(value.isin(*a), F.lit(False)),
        "least_if": lambda: (_at(a[0], "string") == a[1]) & (bounded.isNull() | (bounded < a[2])),
        "most_if": lambda: (_at(a[0], "string") == a[1]) & (bounded.isNull() | (bounded > a[2])),
        "shorter": lambda: F.size(_at(rule.field, "array<variant>")) > a[0],
    }
    holds = F.lit(True) if "*" in rule.sections else F.col("section").isin(*rule.sections)
    if rule.kind == "parsed":
        return holds & ~_object()
    return holds & _object() & F.coalesce(of[rule.kind](), F.lit(False))


def _object() -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")), F.lit(False))


def violations(records: DataFrame, rules: list[Rule]) -> DataFrame:
    """records(record, section, payload) -> (record, section, rule, severity, value): one row for each rule that a record breaks.

    ``value`` is the field's text, null where it lacks; for ``parse_error`` and ``shorter`` the length. A null payload is no object. A record
    that is no object breaks no other rule. Repeated records each count. Columns of other names aren't read.
    """
    parsed = records.select("record", "section", "payload", F.try_parse_json("payload").alias("_v"))
    size = lambda r: F.size(_at(r.field, "array<variant>")).cast("string")
    text = lambda r: F.length("payload").cast("string") if r.kind == "parsed" else size(r) if r.kind == "shorter" else _at(r.field, "string")
    each = [F.when(_broken(r), F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), text(r).alias("value"))) for r in rules]
    return parsed.select("record", "section", F.explode(F.array_compact(F.array(*each))).alias("x")).select("record", "section", "x.*")


def verdicts(records: DataFrame, rules: list[Rule], required: list[str], expected: int | None = None) -> DataFrame:
    """What a validator says of a pack: (section, rule, severity, n), with missing sections, a wrong number of records, and 'status'.

    One scan: each record is a row 'checked' of its section beside the rows of its violations, pre-aggregated before the shuffle.
    """
    broken = violations(records, rules)
    none = F.lit(None).cast("string")
    seen = records.select("section", F.lit("checked").alias("rule"), F.lit("info").alias("severity"))
    counted = seen.unionByName(broken.select("section", "rule", "severity")).groupBy("section", "rule", "severity").agg(F.count("*").alias("n"))
    spark = records.sparkSession
    # What is required is a short list; what is there is one row a section and rule.
    wanted = spark.createDataFrame([(s,) for s in required], "section string")
    lacking = wanted.join(counted.where("rule = 'checked'"), "section", "left_anti").select("section", F.lit("missing_section").alias("rule"), F.lit("error").alias("severity"), F.lit(0).cast("long").alias("n"))
    out = counted.unionByName(lacking)
    if expected is not None:
        number = counted.where("rule = 'checked'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).where(F.col("n") != expected)
        out = out.unionByName(number.select(none.alias("section"), F.lit("count_mismatch").alias("rule"), F.lit("error").alias("severity"), "n"))
    failed = out.agg(F.coalesce(F.bool_or(F.col("severity") != "info"), F.lit(False)).alias("f"), F.coalesce(F.sum(F.when(F.col("severity") != "info", F.greatest("n", F.lit(1)))), F.lit(0)).alias("n"))
    status = failed.select(none.alias("section"), F.lit("status").alias("rule"), F.when(F.col("f"), "failed").otherwise("success").alias("severity"), "n")
    return out.unionByName(status)
