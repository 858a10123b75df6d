"""Merged states against states counted from the events of each region, and one scan below all granularities."""

import random
from collections import Counter

import pytest

from ostinato.operators import evidence
from ostinato.plans import granularities

NOTES = "perf string, seq long, t double, note int, vel int"


def plain_region(events, lo, hi, tile):
    events = sorted(events, key=lambda e: (e[2], e[1]))
    gaps = [b[2] - a[2] for a, b in zip(events, events[1:])]
    steps = [b[3] - a[3] for a, b in zip(events, events[1:]) if a[3] is not None and b[3] is not None]
    vel = [e[4] for e in events]
    return {
        "n": len(events), "vel_sum": sum(vel), "vel_squares": sum(v * v for v in vel), "tiles": len({int(e[2] // tile) for e in events}), "close": sum(g <= 0.08 for g in gaps),
        "positive": sum(g > 0 for g in gaps), "moves": sum(1 <= abs(s) <= 4 for s in steps), "steps": len(steps), "h": [sum(e[3] is not None and e[3] % 12 == i for e in events) for i in range(12)],
    }


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_merged_states(spark, monkeypatch, block):
    """Seams over empty bins, events at one time, on edges, at the end and outside, without a note; a performance with most events."""
    monkeypatch.setattr(evidence, "BLOCK", block)
    rng = random.Random(block)
    rows = [(p, i, rng.choice([rng.uniform(0, 60), float(rng.randint(0, 60)), rng.randint(0, 120) / 2, 10 + rng.random() / 20]), rng.choice([None, *range(50, 62)]), rng.randint(1, 127)) for p, n in (("a", 300), ("b", 12), ("c", 1)) for i, _ in enumerate(range(n))]
    rows += [("a", 1000, -1.0, 60, 9), ("a", 1001, 61.0, 60, 9), ("a", 1002, None, 60, 9), ("d", 1, 60.0, 60, 9)]
    kinds = [("performance", 60.0), ("segment", 12.0), ("bin", 4.0)]
    states = evidence.bin_states(spark.createDataFrame(rows, NOTES).repartition(3), 4.0, 60.0)
    got = {(r["perf"], r["kind"], r["idx"]): r.asDict() for r in evidence.rolled(states, kinds, 4.0, 60.0).collect()}
    expected = {}
    for kind, w in kinds:
        for r in rows:
            if r[2] is not None and 0 <= r[2] <= 60:
                expected.setdefault((r[0], kind, min(int(r[2] // w), int(-(-60 // w)) - 1)), []).append(r)
    assert set(got) == set(expected)
    for key, events in expected.items():
        w = dict(kinds)[key[1]]
        # The event at the very end counts in the last tile.
        events = [e[:2] + (min(e[2], 59.999999),) + e[3:] if e[2] == 60 and not any(59.9 < o[2] < 60 for o in events) else e for e in events]
        plain = plain_region(events, key[2] * w, key[2] * w + w, 1.0)
        if all(e[2] < 60 for e in events) or len({e[2] for e in events if e[2] >= 59}) <= 1:
            assert {k: got[key][k] for k in plain} == plain, key
        assert got[key]["lo"] == key[2] * w and got[key]["n"] == len(events)


def test_changes_count_triads_of_neighbouring_bins(spark):
    major, minor = (60, 64, 67), (62, 65, 69)
    plays = [(0, major), (4, major), (8, minor), (16, major), (24, minor)]
    rows = [("a", i * 10 + j, t + 0.5 + j / 10, n, 64) for i, (t, triad) in enumerate(plays) for j, n in enumerate(triad)]
    states = evidence.bin_states(spark.createDataFrame(rows, NOTES), 4.0, 48.0)
    got = {(r["kind"], r["idx"]): r["changes"] for r in evidence.rolled(states, [("performance", 48.0), ("segment", 24.0)], 4.0, 48.0).collect()}
    assert got == {("performance", 0): 3, ("segment", 0): 2, ("segment", 1): 0}
    with pytest.raises(ValueError):
        evidence.rolled(states, [("odd", 6.0)], 4.0, 48.0)


def test_all_kinds_from_one_scan(spark, sf_dir):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        routes = granularities.content_routes_all(spark, sf_dir)
        plan = routes._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("FileScan") == 1 and plan.count("Exchange ") <= 4 and "Join" not in plan
    assert {k for k, in Counter(routes.select("kind").distinct().collect())} == {"performance", "segment", "window", "bin"}
