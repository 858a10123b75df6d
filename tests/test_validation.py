"""Each rule of each validator on literal JSON, odd payloads, and what a pack as a whole is told."""

import json

from ostinato.operators import validation
from ostinato.operators.validation import EVIDENCE_TYPES, FEATURE_RULES, PITCH_RULES, example_rules, verdicts, violations


def found(spark, rules, *records):
    rows = [(str(i), section, x if x is None or isinstance(x, str) else json.dumps(x)) for i, (section, x) in enumerate(records)]
    return sorted((r["record"], r["rule"], r["value"]) for r in violations(spark.createDataFrame(rows, "record string, section string, payload string"), rules).collect())


AI = {"record_id": "r", "performance_id": "p", "granularity": "window", "start_seconds": 0, "end_seconds": 4.5, "limitations": [], "label_status": "x", "evidence_refs": [], "confidence_reason": "", "verification_status": None, "review_required": False, "confidence": 0.5}


def test_feature_rules(spark):
    lacking = {k: v for k, v in AI.items() if k not in ("limitations", "label_status")}
    got = found(spark, FEATURE_RULES, ("ai_record", AI), ("ai_record", {**AI, "confidence": 1.5}), ("rhythm", {"confidence": "high"}), ("rhythm", {"confidence": None}), ("ai_record", lacking), ("ai_record", {**AI, "end_seconds": -1}), ("ai_record", {**AI, "end_seconds": "later"}),
                ("ai_record", {**AI, "motif_group_refs": "m", "harmony_pattern_index_refs": []}), ("rhythm", {"start_seconds": 3}))
    assert got == [("1", "confidence_range", "1.5"), ("2", "confidence_range", "high"), ("4", "missing_label_status", None), ("4", "missing_limitations", None), ("5", "time_range", "0"), ("6", "time_range", "0"), ("7", "motif_refs_no_list", "m")]


def test_payloads_that_are_no_objects(spark):
    got = found(spark, FEATURE_RULES, ("rhythm", "{"), ("rhythm", None), ("rhythm", ""), ("rhythm", "[1]"), ("rhythm", "3"), ("rhythm", "null"), ("rhythm", "{}"), ("rhythm", '{"note": "a \\"confidence\\": 7 in a text", "x": {"confidence": 9}}'), (None, "{}"))
    assert [(r, n) for r, n, _ in got] == [(str(i), "parse_error") for i in range(6)]


def test_pitch_rules(spark):
    sound = {"confidence": 0.9, "limitations": [], "hard_label": True}
    got = found(
        spark, PITCH_RULES, ("harmony_sonority", sound), ("harmony_sonority", {**sound, "confidence": 0.5}), ("harmony_sonority", {"limitations": "none", "hard_label": True}), ("interval_analysis", {"interval_class_histogram": {}}), ("interval_analysis", {"interval_class_histogram": [1]}),
        ("chord_movement", {"evidence": {"a": 1}, "limitations": ["x"]}), ("chord_movement", {}), *[("tuning_system", {"microtonal_analysis_available": False, "microtonal_evidence_type": t}) for t in EVIDENCE_TYPES], ("tuning_system", {"microtonal_evidence_type": "guess"}),
        ("key_hypothesis", {"label": "dorian", "confidence": 0.7}), ("key_hypothesis", {"label": "centre_C", "confidence": 0.1}), ("payload", {"microtonal_analysis_available": False, "microtonal_confidence": 0.6}), ("payload", {"microtonal_analysis_available": True, "microtonal_confidence": 0.6}),
    )
    assert [(r, n) for r, n, _ in got] == sorted([
        ("1", "hard_label_unsure"), ("2", "hard_label_unsure"), ("2", "missing_confidence"), ("2", "no_limitations"), ("4", "no_interval_histogram"), ("6", "no_evidence"), ("6", "no_limitations"),
        ("12", "evidence_type"), ("12", "no_availability"), ("13", "hard_key_unsure"), ("15", "unavailable_but_sure"),
    ])


EXAMPLE = {
    "task_type": "continuation", "split_recommendation": "train", "context_start_seconds": 0, "context_end_seconds": 1, "target_start_seconds": 1, "target_end_seconds": 2, "start_seconds": 0, "end_seconds": 2, "quality_score": {"final_score": 0.8},
    "split_reason_codes": [], "failed_policy_checks": [], "missing_refs": [], "quality_component_breakdown": {}, "target_midi_ref": "t", "full_midi_ref": "f", "conditioning": {}, "target_representation": [0] * 256,
}


def test_example_rules(spark):
    rules = example_rules(["continuation", "call_response"])
    wrong = [{"task_type": "song"}, {"split_recommendation": "test"}, {"context_end_seconds": 0}, {"quality_score": {"final_score": 0.7}}, {"quality_score": {"final_score": 0.59}, "split_recommendation": "validation"}, {"quality_score": None}, {"conditioning": {"style_tags_ground_truth": None}}, {"target_representation": [0] * 257}, {"missing_refs": {}}]
    lacking = {k: v for k, v in EXAMPLE.items() if k != "target_midi_ref"}
    got = found(spark, rules, ("example", EXAMPLE), *[("example", {**EXAMPLE, **w}) for w in wrong], ("example", lacking))
    assert sorted((r, n) for r, n, _ in got) == sorted([("1", "task_type"), ("2", "split"), ("3", "context_range"), ("4", "poor_train"), ("5", "poor_validation"), ("6", "no_quality"), ("6", "poor_train"), ("7", "style_as_truth"), ("8", "huge_array"), ("9", "no_missing_refs"), ("10", "missing_target_midi_ref")])


def test_verdicts_of_a_pack(spark):
    rows = [("a", "rhythm", '{"confidence": 2}'), ("b", "rhythm", "{}"), ("c", "harmony", "{")]
    table = spark.createDataFrame(rows, "record string, section string, payload string")
    got = {(r["section"], r["rule"]): (r["severity"], r["n"]) for r in verdicts(table, FEATURE_RULES, ["rhythm", "tag"], expected=4).collect()}
    assert got == {("rhythm", "checked"): ("info", 2), ("harmony", "checked"): ("info", 1), ("rhythm", "confidence_range"): ("warning", 1), ("harmony", "parse_error"): ("error", 1), ("tag", "missing_section"): ("error", 0), (None, "count_mismatch"): ("error", 3), (None, "status"): ("failed", 6)}
    good = verdicts(table.where("record = 'b'"), FEATURE_RULES, ["rhythm"], expected=1).collect()
    assert {(r["rule"], r["severity"], r["n"]) for r in good} == {("checked", "info", 1), ("status", "success", 0)}
    assert {(r["rule"], r["severity"]) for r in verdicts(table.limit(0), FEATURE_RULES, [], expected=0).collect()} == {("status", "success")}


def test_one_scan_without_shuffle(spark):
    plan = violations(spark.range(9).selectExpr("id as record", "'x' as section", "'{}' as payload"), FEATURE_RULES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 and "Exchange" not in plan and len({r.kind for rules in (FEATURE_RULES, PITCH_RULES, example_rules(["a"])) for r in rules}) > 10
    assert validation.GRANULARITIES[0] == "performance"
