"""Example kinds on literal regions, one condition at a time, and the checks of their policies."""

import pytest

from ostinato.operators import examples

SCHEMA = "perf string, kind string, idx int, lo double, hi double, notes long, density double, content_state string, activity double, harmony_refs int, melody_refs int"


def region(idx, notes=20, density=1.0, state="melodic_lead", kind="window", activity=0.0, harmony=0, melody=0, width=60.0):
    return ("a", kind, idx, idx * width, idx * width + width, notes, density, state, activity, harmony, melody)


def made(spark, rows, long_form=True, **kw):
    found = examples.candidates(spark.createDataFrame(rows, SCHEMA), long_form, **kw).collect()
    return {(r["task"], r["kind"], r["idx"]): r for r in found}


def test_kinds_of_windows(spark):
    got = made(spark, [region(0), region(1, 40, 1.6), region(2, 10, 1.5, activity=2.0), region(3, 3)])
    assert {k for k, _, _ in got} == {"continuation", "phrase_continuation", "melody_continuation", "call_response", "buildup_to_release", "infill_missing_region"}
    assert got["continuation", "window", 0]["note"] == "compatible_states" and got["continuation", "window", 0]["context_lo"] == 0
    assert got["continuation", "window", 1]["note"] == "two_window_context" and got["continuation", "window", 1]["context_lo"] == 0
    assert got["phrase_continuation", "window", 1]["context_lo"] == 0 and got["phrase_continuation", "window", 1]["target_idx"] == 2
    assert ("call_response", "window", 1) not in got and got["call_response", "window", 0]["motif"] == pytest.approx(0.58 + 0.2 * 0.3)
    release = got["buildup_to_release", "window", 0]
    assert (release["context_lo"], release["context_hi"], release["target_idx"]) == (0, 120, 2) and release["motif"] == pytest.approx(0.58 + 0.2 * 0.7)
    infill = got["infill_missing_region", "window", 0]
    assert (infill["context_lo"], infill["context_hi"], infill["target_lo"], infill["target_hi"]) == (0, 180, 60, 120)


def test_short_form_has_one_window_of_context(spark):
    got = made(spark, [region(0), region(1, 40, 1.6), region(2, 10)], long_form=False)
    assert {r["note"] for k, r in got.items() if k[0] == "continuation"} == {"compatible_states"} and got["continuation", "window", 1]["motif"] == 0.48
    assert not any(k[0] == "phrase_continuation" for k in got)


def test_states_and_silence(spark):
    got = made(spark, [region(0, state="rhythm_dominant"), region(1, state="silence_or_noise", notes=0), region(2, state="percussive_only", harmony=1), region(3, state="harmonic_dominant")])
    assert not any(k[0] == "continuation" for k in got)
    assert ("groove_continuation", "window", 1) in got and ("harmony_continuation", "window", 2) in got
    assert got["harmony_continuation", "window", 1]["note"] == "harmony_evidence" and got["harmony_continuation", "window", 2]["note"] == "target_state"


def test_segments_and_missing_regions(spark):
    rows = [region(i, kind="segment", width=24.0) for i in (0, 1, 3)] + [region(0, kind="bin", width=4.0), region(1, kind="bin", width=4.0)]
    got = made(spark, rows)
    assert set(got) == {("phrase_continuation", "segment", 0), ("section_transition", "segment", 0)}
    section = got["section_transition", "segment", 0]
    assert (section["context_lo"], section["context_hi"], section["target_lo"], section["target_hi"]) == (12, 24, 24, 36)
    assert made(spark, [region(0)]) == {} and examples.candidates(spark.createDataFrame([], SCHEMA), True).collect() == []


def test_policies(spark):
    row = lambda task, state, notes=5, seconds=10.0, harmony=0, melody=0: ("a", task, state, notes, 0.0, seconds, harmony, melody)
    rows = [
        row("continuation", "melodic_lead"), row("continuation", "percussive_only"), row("continuation", "melodic_lead", 1, 2.0), row("harmony_continuation", "unknown", harmony=1), row("harmony_continuation", "unknown"),
        row("melody_continuation", "percussive_only", melody=1), row("melody_continuation", "unknown", melody=1), row("call_response", "percussive_only", harmony=1), row("infill_missing_region", "percussive_only", 0), row("infill_missing_region", "silence_or_noise", seconds=61.0), row("no_such_task", "melodic_lead"),
    ]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, perf string, task string, target_state string, target_notes int, target_lo double, target_hi double, harmony_refs int, melody_refs int")
    got = [(r["allowed"], r["failed"], r["blocked"]) for r in examples.checked(table).orderBy("i").collect()]
    assert got == [
        (True, "", False), (False, "task_policy_failed", False), (True, "duration_out_of_range,target_too_sparse", False), (True, "", False), (False, "task_policy_failed", False),
        (True, "", False), (False, "task_policy_failed", False), (True, "", False), (True, "target_too_sparse", True), (False, "task_policy_failed,duration_out_of_range", False), (False, "task_policy_failed", False),
    ]


def test_motifs_go_from_their_first_window_to_the_second(spark):
    regions = spark.createDataFrame([region(i) for i in (0, 1, 2, 4)], SCHEMA)
    places = spark.createDataFrame([("a", "x..x", i, n) for i, n in ((4, 1), (1, 2), (2, 5))] + [("a", "xx", 0, 9), ("a", "x.x", 3, 2), ("a", "x.x", 4, 1), ("a", "b", 0, 1), ("a", "b", 1, 1)], "perf string, motif string, idx int, n long")
    got = {r["note"]: (r["idx"], r["target_idx"], r["motif"]) for r in examples.motif_candidates(places, regions).collect()}
    assert got == {"motif=x..x": (1, 2, 0.95), "motif=b": (0, 1, round(0.25 + 2 / 6, 6))}
    assert len(examples.motif_candidates(places, regions, most=1).collect()) == 1
