"""Suspicions of routing on rows written out by hand."""

from ostinato.operators import routing

SCHEMA = "perf string, route_id string, kind_order int, idx int, content_state string, harmony double, chord double, classes int, density double, poly double"
ROWS = [
    ("p", "a", 3, 0, "unknown", 0.58, 0.0, 0, 1.0, 0.0),
    ("p", "b", 3, 1, "unknown", 0.57, 0.57, 4, 2.0, None),
    ("p", "c", 3, 2, "percussive_only", 0.1, 0.62, 0, 3.0, 0.5),
    ("p", "d", 2, 9, None, None, None, 5, None, None),
    ("p", "e", 3, 3, "harmonic_dominant", 0.9, 0.9, 7, 4.0, 1.0),
    ("p", "f", 3, 4, "strange", 0.7, 0.1, 0, 1.0, 0.0),
    ("q", "g", 0, 0, "vocal_dominant", 0.61, 0.62, 0, 1.0, 0.0),
]


def test_suspects(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    got = {}
    for r in routing.suspects(rows).orderBy("perf", "suspicion", "rank").collect():
        got.setdefault((r["perf"], r["suspicion"]), []).append(r["route_id"])
    assert got == {("p", "harmonic_not_classified"): ["f", "a", "c", "d"], ("p", "false_suppression"): ["c", "f"], ("q", "harmonic_not_classified"): ["g"], ("q", "false_suppression"): ["g"]}
    many = spark.range(250).selectExpr("'p' as perf", "cast(id as string) as route_id", "0 as kind_order", "cast(id as int) as idx", "'unknown' as content_state", "id / 250D * 0.4 + 0.6 as harmony", "0D as chord", "0 as classes")
    listed = [r["route_id"] for r in routing.suspects(many).where("suspicion = 'harmonic_not_classified'").orderBy("rank").collect()]
    assert listed == [str(i) for i in range(249, 149, -1)]
    assert routing.suspects(rows.limit(0)).collect() == []


def test_suppressed_labels_and_means(spark):
    rows = spark.createDataFrame(ROWS * 2, SCHEMA)
    got = {(r["perf"], r["content_state"], r["label"]): r["n"] for r in routing.suppressed_by_state(rows).collect()}
    assert got == {("p", "unknown", "chord_movement"): 4, ("p", None, "chord_movement"): 2, ("p", "strange", "chord_movement"): 2, ("q", "vocal_dominant", "chord_movement"): 2, ("p", "harmonic_dominant", "transient"): 2} | {("p", "percussive_only", x): 2 for x in ("chord_movement", "harmony", "melody")}
    unknown = {(r["perf"], r["content_state"]): r for r in routing.state_metrics(rows).collect()}["p", "unknown"]
    assert (unknown["n"], unknown["mean_density"], unknown["mean_classes"], unknown["mean_chord"], unknown["mean_poly"]) == (4, 1.5, 2.0, 0.285, 0.0)
