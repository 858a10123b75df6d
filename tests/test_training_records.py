"""Whole training records against a sequential version on random rows."""

import random

from ostinato.operators import training_records

REGIONS = "perf string, record_id string, window_id string, granularity string, lo double, hi double, notes long, density double, confidence double"
HARMONIES = "perf string, window_id string, granularity string, seq long, key string, mode string, score double"
SLICES = "perf string, seq long, lo double, hi double, sonority string"
METERS = "perf string, seq long, lo double, hi double, subdivision string, grid_confidence double, pulse_stability double, candidates string, ambiguity double"
SECTIONS = "perf string, seq long, lo double, hi double, section string"
TAGS = "seq string, perf string, window_id string, granularity string, lo double, hi double, tag string, sure double"


def overlap(a, b):
    return max(0.0, min(a[1], b[1]) - max(a[0], b[0]))


def sequential(regions, harmonies, slices, meters, sections, tags):
    out = {}
    for perf, record, window, kind, lo, hi, notes, density, confidence in regions:
        kind = kind or "window"
        timed = lo is not None and hi is not None
        near = sorted((h for h in harmonies if h[0] == perf and h[1] == window), key=lambda h: h[3])
        own = next((h for h in near if (h[2] or "window") == kind), near[0] if near else None)
        mine = sorted((s for s in slices if s[0] == perf), key=lambda s: s[1])
        sound = next((s for s in mine if timed and s[3] >= lo and s[2] <= hi), mine[0] if mine else None)

        def longest(rows):
            rows = sorted((x for x in rows if x[0] == perf), key=lambda x: x[1])
            return max(rows, key=lambda x: overlap((lo, hi), (x[2], x[3])) if timed else 0.0) if rows else None

        meter, section = longest(meters), longest(sections)
        found = sorted((-(t[7] or 0.0), t[0], t[6]) for t in tags if t[1] == perf and t[2] == window and (t[3] or "") == kind and (not timed or None in t[4:6] or (t[5] >= lo and t[4] <= hi)))[:5]
        out[record] = (
            kind, own and own[4], own and own[6], sound and sound[4], meter and meter[4], meter and meter[8], section and section[4], ",".join(t[2] for t in found),
            "needs_review" if any(-t[0] < 0.45 for t in found) else "feature_ready", "heuristic_estimate" if kind in ("performance", "segment", "window") else "weak_label", round(min(confidence or 0.0, (own and own[6]) or 0.0), 6),
        )
    return out


def test_records_are_those_of_a_loop(spark):
    rng = random.Random(11)
    perf, window, kind = (lambda: rng.choice("pqr")), (lambda: rng.choice([None, "1", "2", "3"])), (lambda: rng.choice([None, "bin", "window", "segment"]))
    at = lambda: float(rng.randrange(0, 90))
    sure = lambda: rng.choice([None, 0.1, 0.4, 0.45, 0.8])

    def span():
        lo = at()
        return lo, lo + rng.choice([0.0, 3.0, 20.0, 60.0])

    regions = [(perf(), f"r{i}", window(), kind(), *span(), i, 0.5, sure()) for i in range(120)] + [("p", "no_times", None, "bin", None, None, None, None, None), ("s", "alone", "1", "bin", 0.0, 4.0, 1, 1.0, 0.9)]
    harmonies = [(perf(), window(), kind(), i, rng.choice("CDE"), "major", sure()) for i in range(60)]
    slices = [(p, i, 5.0 * i, 5.0 * i + rng.choice([2.0, 5.0]), f"s{i}") for p in "pqr" for i in range(1, 15)]
    meters = [(p, i, 30.0 * i, 30.0 * i + 30.0, f"m{i}", 0.5, 0.5, "4/4", 0.1 * i) for p in "pq" for i in range(4)]
    sections = [(p, i, 24.0 * i, 24.0 * i + 24.0, f"x{i}") for p in "pqr" for i in range(5)]
    tags = [(f"t{i:03d}", perf(), window(), kind(), *(span() if i % 5 else (None, 3.0)), rng.choice("abcd"), sure()) for i in range(200)]
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((regions, REGIONS), (harmonies, HARMONIES), (slices, SLICES), (meters, METERS), (sections, SECTIONS), (tags, TAGS))]
    rows = training_records.built(*frames, 30.0).collect()
    got = {r["record_id"]: (r["granularity"], r["key"], r["harmony_score"], r["sonority"], r["subdivision"], r["meter_ambiguity"], r["section"], r["top_tags"], r["label"], r["label_status"], r["confidence"]) for r in rows}
    assert len(rows) == len(regions) and got == sequential(regions, harmonies, slices, meters, sections, tags)
    bare = training_records.built(frames[0], *[f.limit(0) for f in frames[1:]], 30.0).collect()
    assert len(bare) == len(regions) and {(r["key"], r["sonority"], r["subdivision"], r["section"], r["top_tags"], r["confidence"]) for r in bare} == {(None, None, None, None, "", 0.0)}
    assert training_records.built(frames[0].limit(0), *frames[1:], 30.0).collect() == []
