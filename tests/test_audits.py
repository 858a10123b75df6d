"""Asset types, audits, readiness, tags by window and pattern lists on rows written out by hand or made by seed."""

import random

from ostinato.operators import audits, keyed_tags, pattern_index

FACTS = "id int, seconds double, segments int, windows int, records int, density double, poly double, chord double, vocal double, speech double, ambient double, percussive double, loop boolean"
#: seconds, segments, windows, records, density, poly, chord, vocal, speech, ambient, percussive, loop -> type, sureness, alternates
ASSETS = [
    ((None,) * 12, ("one_shot_synth", 0.62, ["unknown"])),
    ((60.0, 1, 1, 1, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, False), ("unknown", 0.2, [])),
    ((120.0, 9, 2, 1, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, False), ("full_song", 0.72, ["unknown"])),
    ((180.0, 3, 3, 1, 2.0, 0.2, 0.7, 0.0, 0.0, 0.0, 0.0, False), ("performance_recording", 0.8, ["full_song", "full_song", "unknown"])),
    ((180.0, 2, 3, 1, 2.0, 0.2, 0.7, 0.0, 0.0, 0.0, 0.0, False), ("full_song", 0.72, ["full_song", "unknown"])),
    ((90.0, 2, 1, 1, 2.0, 0.0, 0.0, 0.6, 0.34, 0.0, 0.0, False), ("rap_song", 0.64, ["unknown"])),
    ((90.0, 2, 1, 1, 2.0, 0.0, 0.0, 0.6, 0.55, 0.0, 0.0, False), ("speech_heavy", 0.68, ["unknown"])),
    ((90.0, 2, 1, 1, 0.9, 0.0, 0.0, 0.0, 0.55, 0.55, 0.0, False), ("ambient_texture", 0.7, ["speech_heavy", "unknown"])),
    ((30.0, 1, 1, 1, 2.0, 0.0, 0.3, 0.0, 0.0, 0.0, 0.55, True), ("drum_loop", 0.66, ["melodic_loop", "unknown"])),
    ((30.0, 1, 1, 1, 2.0, 0.0, 0.3, 0.0, 0.0, 0.0, 0.55, False), ("one_shot_drum", 0.66, ["unknown"])),
    ((89.0, 1, 1, 1, 2.0, 0.15, 0.65, 0.0, 0.0, 0.0, 0.0, True), ("chord_loop", 0.67, ["unknown"])),
    ((90.0, 1, 1, 1, 2.0, 0.15, 0.65, 0.0, 0.0, 0.0, 0.0, True), ("full_song", 0.67, ["unknown"])),
    ((5.0, 1, 0, 0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.45, False), ("one_shot_drum", 0.74, ["unknown"])),
    ((5.0, 1, 0, 0, 0.5, 0.0, 0.0, 0.45, 0.0, 0.0, 0.44, False), ("vocal_sample", 0.7, ["unknown"])),
    ((59.0, 1, 0, 0, 1.0, 0.0, 0.49, 0.0, 0.0, 0.0, 0.0, True), ("melodic_loop", 0.6, ["unknown"])),
]


def test_asset_types(spark):
    rows = [(i, *facts) for i, (facts, _) in enumerate(ASSETS)]
    told = audits.asset_types(spark.createDataFrame(rows, FACTS))
    got = {r["id"]: r for r in told.collect()}
    assert {i: (r["asset_type"], r["asset_confidence"], r["alternates"]) for i, r in got.items()} == {i: want for i, (_, want) in enumerate(ASSETS)}
    assert (got[7]["should_transcribe"], got[7]["should_segment"], got[7]["should_stitch"]) == (False, True, True)
    assert (got[12]["should_transcribe"], got[12]["should_segment"], got[12]["should_stitch"]) == (True, False, False)
    assert [got[i]["most_windows"] for i in (0, 12, 1, 5)] == [1, 1, 2, 4]
    assert got[0]["limitations"] == [audits.NO_RECORDS, audits.NO_WINDOWS] and got[1]["limitations"] == []
    assert audits.asset_types(told.limit(0).select(*[c.split()[0] for c in FACTS.split(", ")])).collect() == []


RECORDS = "performance string, label_status string, verified boolean, suppressed int, recommendation string, family string, false_suppression boolean, harmonic_suppressed boolean"


def audited(spark, rows, meters=(), gates=()):
    found = audits.training_audit(spark.createDataFrame(rows, RECORDS), spark.createDataFrame(list(meters), "performance string, confidence double, ambiguity double"), spark.createDataFrame(list(gates), "performance string, quality_status string, split string"))
    return {r["performance"]: r.asDict() for r in found.collect()}


def test_training_audit(spark):
    rows = [
        ("a", "weak_label", False, 2, "upgrade_candidate", "rhythm", False, True),
        ("a", "weak_label", None, None, "suppress_candidate", "harmony", None, True),
        ("a", None, True, 1, "downgrade_candidate", None, False, None),
        ("a", "weak_label", False, 0, "needs_human_review", "rhythm", False, True),
        ("a", "derived_observation", False, 0, None, None, False, False),
        ("b", "derived_observation", False, 0, "keep_weak", "rhythm", False, True),
    ]
    got = audited(spark, rows * 2, [("a", 0.65, 0.45)], [("a", "accepted", "train")])
    a, b = got["a"], got["b"]
    assert a["records"] == 10 and a["label_statuses"] == "derived_observation=2,unknown=2,weak_label=6" and a["missing"] is None
    assert (a["suppressed_labels"], a["false_suppressions"], a["harmonic_suppressed"], a["calibration"]) == (6, 0, 6, "monitor")
    assert (a["upgrades"], a["upgrades_by_family"], a["downgrades"], a["downgrades_by_family"], a["to_review"]) == (2, "rhythm=2", 4, "harmony=2,unknown=2", 2)
    assert (a["meter_use"], a["inclusion"], a["recommended_split"]) == ("safe_for_observation_fields", "accepted", "train")
    assert (b["missing"], b["calibration"], b["upgrades_by_family"], b["meter_confidence"], b["meter_ambiguity"]) == ("human verification labels", "healthy", "", 0.0, 1.0)
    assert (b["meter_use"], b["inclusion"], b["recommended_split"]) == ("weak_or_review_only", "review_required", "review")
    assert audited(spark, []) == {}


def test_calibration_edges(spark):
    flags = lambda p, false, harmonic: [(p, "x", False, 0, None, None, i < false, i < harmonic) for i in range(60)]
    rows = flags("a", 0, 3) + flags("b", 0, 4) + flags("c", 19, 49) + flags("d", 20, 0) + flags("e", 0, 50) + flags("f", 1, 0)
    assert {p: r["calibration"] for p, r in audited(spark, rows).items()} == {"a": "healthy", "b": "monitor", "c": "monitor", "d": "needs_recalibration", "e": "needs_recalibration", "f": "monitor"}


def test_ingestion_readiness(spark):
    names = ["new_leaks", "debt", "unauthorized", "planned", "queued", "scored", "examples", "feedback", "evaluated", "reviews"]
    rows = [("all", 0, 0, 0, 1, 1, 1, 1, 1, 1, 101), ("debt", 0, 3, 0, 1, 1, 1, 1, 1, 1, 100), ("unseen", 0, None, 0, 1, 1, 1, 1, 1, 1, 1), ("unmeasured", 0, 0, 0, 1, 1, 1, 1, 1, 0, 1), ("leak", 1, 0, 0, 1, 1, 1, 1, 1, 1, 1), (None, *[None] * 10)]
    signs = spark.createDataFrame(rows, "corpus string, " + ", ".join(f"{n} int" for n in names))
    got = {r["corpus"]: r for r in audits.ingestion_readiness(signs, "corpus").collect()}
    ready = {k: (r["ready_for_batch"], r["ready_for_training"], r["ready_at_large"]) for k, r in got.items()}
    assert ready == {"all": (True,) * 3, "debt": (True, True, False), "unseen": (True, True, False), "unmeasured": (True, False, False), "leak": (False,) * 3, None: (True, False, False)}
    assert got["all"]["top_blockers"] == "none" and got["debt"]["top_blockers"] == audits.DEBT
    assert got["leak"]["top_blockers"] == f"{audits.BLOCKERS[0][1]}; {audits.DEBT}"
    assert got[None]["blockers"] == 6 and got[None]["top_blockers"].endswith(audits.DEBT)
    assert [(got[k]["review_burden"], got[k]["review_hours"]) for k in ("all", "debt", None)] == [("blocked", 8.08), ("partial", 8.0), ("partial", 0.0)]


def sequential_tags(records, tags, k):
    out = []
    for name, window, kind, lo, hi in records:
        mine = []
        for seq, w, g, tlo, thi, tag, sure in tags:
            timed = None not in (lo, hi, tlo, thi)
            if w == window and (g or "") == (kind or "") and not (timed and (thi < lo or tlo > hi)):
                mine.append((-(sure or 0.0), seq, tag))
        out += [(name, nth, tag, -s) for nth, (s, _, tag) in enumerate(sorted(mine)[:k], 1)]
    return sorted(out)


def test_tags_by_window(spark):
    rng = random.Random(5)
    span = lambda: (lambda lo: (lo if rng.random() < 0.8 else None, lo + rng.choice([0, 1, 7, 40]) if rng.random() < 0.8 else None))(float(rng.randrange(0, 60)))
    key = lambda: (rng.choice([None, "-", "w", "1", "w1"]), rng.choice([None, "", "window", "bin"]))
    records = [(f"r{i}", *key(), *span()) for i in range(150)]
    tags = [(i, *key(), *span(), rng.choice("abc"), rng.choice([None, 0.1, 0.5, 0.5, 0.9])) for i in range(400)]
    r = lambda rows: spark.createDataFrame(rows, "record string, window_id string, granularity string, lo double, hi double")
    t = lambda rows: spark.createDataFrame(rows, "seq long, window_id string, granularity string, lo double, hi double, tag string, sure double")
    for k in (1, 5):
        assert sorted(map(tuple, keyed_tags.top_tags(r(records), t(tags), 10.0, k).collect())) == sequential_tags(records, tags, k)
    assert keyed_tags.top_tags(r([]), t(tags), 10.0).collect() == [] == keyed_tags.top_tags(r(records), t([]), 10.0).collect()


def test_pattern_lists(spark):
    schema = "perf string, pattern string, repeats long, regions long, family string, match string, strength string, confidence double, ambiguity double"
    many = [("p", "x" + format(i, "05b").replace("0", ".").replace("1", "x"), 4, 2, "clave", None, "ambiguous", 0.5, 1.0) for i in range(32)]
    few = [("q", "x.x", 3, 1, "a", "a", "strong", 0.6, 0.0), ("q", "xxx", 9, 7, "b", "b", "moderate", 0.9, 0.2), ("q", "xx.", 2, 2, "c", "c", "weak", 0.3, 0.0), ("q", ".xx", 8, 7, "d", "d", "weak", 0.3, 0.0), ("q", "x..", 4, 4, "e", None, None, None, None)]
    groups = spark.createDataFrame(many + few, schema)
    accents = spark.createDataFrame([("q", "A.A", 2, 1), ("q", "AA.", 2, 1), ("q", "A..", 1, 1)] + [("p", f"A{i:03d}", i, 1) for i in range(2, 20)], "perf string, pattern string, repeats long, regions long")
    lists = {}
    for r in pattern_index.lists(groups, accents).orderBy("perf", "list", "rank").collect():
        lists.setdefault((r["perf"], r["list"]), []).append(r["pattern"])
    by_text = sorted(m[1] for m in many)
    assert lists["p", "top_groups"] == by_text[:10] and ("p", "families") not in lists
    assert lists["p", "dense_bursts"] == by_text[:10] and lists["p", "sparse_calls"] == [x for x in by_text if "." in x][:10]
    assert ("p", "unknown") not in lists  # 4 + 2 is too little information
    assert lists["p", "accents"] == [f"A{i:03d}" for i in range(19, 7, -1)]
    assert lists["q", "top_groups"] == ["xxx", ".xx", "x..", "x.x", "xx."] and lists["q", "families"] == ["x.x", "xxx"]
    assert lists["q", "unknown"] == ["x.."] and lists["q", "accents"] == ["A.A", "AA."]
    assert lists["q", "dense_bursts"] == ["xxx", ".xx", "x.."] and lists["q", "sparse_calls"] == [".xx", "x..", "x.x"]
    q = {r["perf"]: r for r in pattern_index.diagnostics(groups).collect()}["q"]
    assert (q["groups"], q["all_onset_groups"], q["ambiguous_groups"], q["weak_high_frequency_groups"], q["taggable_repeats"]) == (5, 1, 1, 1, 12)
    assert pattern_index.lists(groups.limit(0), accents.limit(0)).collect() == []


def test_accents_of_regions_and_their_parts(spark):
    grid = spark.createDataFrame([("p", 0, "A.A.A.A."), ("p", 1, "A.A.A.A."), ("p", 2, "........"), ("p", 3, None), ("p", 4, "")], "perf string, idx int, accents string")
    got = {r["pattern"]: (r["repeats"], r["regions"]) for r in pattern_index.accent_counts(grid).collect()}
    texts, expected = ["A.A.A.A.", "A.A.A.A.", "........"], {}
    for i, text in enumerate(texts):
        counts = {text: 1}
        for size in range(3, 13):
            parts = [text[at : at + size] for at in range(len(text) - size + 1)]
            for p in set(parts):
                if parts.count(p) >= 2 and p.count("A") >= 2:
                    counts[p] = counts.get(p, 0) + parts.count(p)
        for p, n in counts.items():
            expected.setdefault(p, []).append((n, i))
    assert got == {p: (sum(n for n, _ in found), len({i for _, i in found})) for p, found in expected.items()}
