"""Rhythm families: motifs matched against a short table of known patterns by onsets (under rotations), accents and interval ratios.

Onsets and accents are bits of one long, so likeness of two patterns is two bit counts. Patterns have at most 64 steps, as token
grids do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.functions.scalars import clamp01, round6

#: Pattern, family, onset patterns, interval ratios, accents, whether rotations count.
PATTERNS = [
    ("tresillo_3_3_2", "tresillo_3_3_2", ["x..x..x.", "x..x..x..", "x..x..x..."], [[1.5, 1.5, 1.0], [3.0, 3.0, 2.0]], "X..x..x.", True),
    ("habanera", "habanera", ["x..xx.x."], [[1.5, 0.5, 1.0, 1.0]], "X..xX.x.", False),
    ("cinquillo", "cinquillo", ["x.x.x..x.", "x.x.x..x.."], [[1.0, 1.0, 1.0, 2.0, 1.0]], "X.x.x..x.", True),
    ("son_clave_3_2", "clave", ["x..x...x..x.x..."], [[3.0, 3.0, 4.0, 2.0, 4.0]], "X..x...X..x.x...", False),
    ("son_clave_2_3", "clave", ["x.x...x..x...x.."], [[2.0, 4.0, 3.0, 3.0, 4.0]], "X.x...x..X...x..", False),
    ("rumba_clave_3_2", "clave", ["x..x...x.x...x.."], [[3.0, 3.0, 2.0, 4.0, 4.0]], "X..x...x.X...x..", False),
    ("rumba_clave_2_3", "clave", ["x...x..x...x.x.."], [[4.0, 3.0, 4.0, 2.0, 3.0]], "X...x..x...X.x..", False),
    ("backbeat_2_4", "backbeat", ["x...x...x...x...", ".x..x...x...x..."], [[1.0, 1.0, 1.0, 1.0]], ".x..X...x...X...", True),
    ("four_on_the_floor", "four_on_the_floor", ["x...x...x...x..."], [[1.0, 1.0, 1.0, 1.0]], "X...X...X...X...", True),
    ("waltz_3_4", "waltz_3_4", ["x..x..x.."], [[1.0, 1.0, 1.0]], "X..x..x..", True),
    ("march_duple", "march_duple", ["x.x.x.x."], [[1.0, 1.0, 1.0, 1.0]], "X.x.X.x.", True),
    ("swing_shuffle", "shuffle", ["x..x..x..x.."], [[2.0, 1.0, 2.0, 1.0], [0.667, 0.333, 0.667, 0.333]], "X..x..X..x..", True),
    ("twelve_eight_gospel", "twelve_eight_gospel", ["x..x..x..x..", "x..x.x..x..x"], [[3.0, 3.0, 3.0, 3.0], [2.0, 1.0, 3.0, 2.0, 1.0, 3.0]], "X..x..X..x..", True),
    ("gospel_clap_backbeat", "gospel_clap_backbeat", [".x..x...x...x...", ".x..x..x.x..x..."], [[1.0, 1.0, 1.0, 1.0]], ".x..X...x...X...", True),
    ("boom_bap_backbeat", "boom_bap_backbeat", ["x...x...x...x...", "x...x..x.x..x..."], [[1.0, 1.0, 1.0, 1.0]], "X...x...X...x...", False),
    ("trap_hihat_subdivision", "trap_subdivision", ["x.x.x.x.x.x.x.x.", "x.xxx.x.xxx.x.x."], [[0.5, 0.5, 0.5, 0.5], [1.0, 0.5, 0.5, 1.0]], "x.X.x.X.x.X.x.X.", True),
    ("dembow_like", "dembow_like", ["x..x...x..x.x...", "x..x..x.x..x..."], [[3.0, 4.0, 3.0, 2.0, 4.0]], "X..x...x..X.x...", True),
    ("bossa_like", "bossa_like", ["x..x.x...x.x...."], [[3.0, 2.0, 4.0, 2.0, 5.0]], "X..x.x...x.X....", True),
    ("samba_like", "samba_like", ["x.x..x.x..x.x..", "x..x.x.x..x.x.."], [[1.0, 2.0, 1.0, 2.0, 1.0]], "X.x..x.X..x.x..", True),
    ("amen_break_like", "amen_break_like", ["x..x.x..x.x.x..", "x.x.x...x.x.x..."], [[2.0, 2.0, 1.0, 1.0, 2.0]], "X..x.X..x.x.X..", False),
    ("generic_vamp_cycle", "generic_vamp_cycle", ["x...x...x...x...", "x..x..x..x.."], [[1.0, 1.0, 1.0, 1.0]], "X...x...X...x...", True),
    ("sparse_call_response", "sparse_call_response", ["x......x......", "x....x...."], [[2.0, 2.0], [3.0, 3.0]], "X......x......", True),
]
#: Least, strong and moderate confidence, least specificity, most ambiguity, and evidence needed beside onsets.
THRESHOLDS = {
    "tresillo_3_3_2": (0.55, 0.86, 0.66, 0.42, 0.55, ""),
    "clave": (0.58, 0.88, 0.70, 0.45, 0.5, ""),
    "cinquillo": (0.55, 0.86, 0.68, 0.4, 0.58, ""),
    "shuffle": (0.50, 0.84, 0.66, 0.38, 0.55, "ratio"),
    "twelve_eight_gospel": (0.50, 0.84, 0.66, 0.38, 0.55, "ratio"),
    "sparse_call_response": (0.52, 0.82, 0.62, 0.34, 0.6, ""),
    "backbeat": (0.52, 0.84, 0.64, 0.34, 0.6, "accent"),
}
OTHERS = (0.45, 0.82, 0.60, 0.30, 0.75, "")
MARGIN = 0.03
#: Added before rounding: weights of two places times likenesses of six often end in a half, which should go up in spite of binary error.
HALF_UP = 1e-9


def bits(text: str, mark: str) -> int:
    return sum(1 << i for i, c in enumerate(text) if c == mark)


def known_patterns() -> list[tuple]:
    """(nth, pattern_id, family, targets, ratios, accents, least, strong, moderate, specific, unsure, needs): a fixed short table."""
    rows = []
    for nth, (name, family, tokens, ratios, accents, rotates) in enumerate(PATTERNS):
        turned = {bits(t[i:] + t[:i], "x") for t in tokens for i in range(len(t) if rotates else 1)}
        rows.append((nth, name, family, sorted(turned), ratios, bits(accents, "X"), *THRESHOLDS.get(family, OTHERS)))
    return rows


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(known_patterns(), "nth int, pattern_id string, family string, targets array<bigint>, known_ratios array<array<double>>, known_accents bigint, least double, strong double, moderate double, specific double, unsure double, needs string")


def mask(text: Column, mark: str) -> Column:
    """The places of a mark in a text of at most 64 steps as bits, the first step lowest."""
    places = F.regexp_replace(F.regexp_replace(text, f"[^{mark}]", "0"), mark, "1")
    return F.coalesce(F.conv(F.reverse(places), 2, -10).cast("long"), F.lit(0).cast("long"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.bit_count(a.bitwiseOR(b))
    return F.when(union > 0, F.bit_count(a.bitwiseAND(b)) / union).otherwise(0.0)


def ratio_likeness(own: Column, known: Column) -> Column:
    """1 less the mean relative error over the shorter length, each error at most 1; nothing to compare gives 0."""
    width = F.least(F.size(own), F.size(known))
    pairs = F.arrays_zip(F.slice(own, 1, width).alias("a"), F.slice(known, 1, width).alias("b"))
    error = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.least(F.lit(1.0), F.abs(p["a"] - p["b"]) / F.greatest(F.lit(0.001), F.abs(p["b"]))))
    return F.when(width > 0, round6(F.greatest(F.lit(0.0), 1 - error / width))).otherwise(0.0)


def information(pattern: Column, repeats: Column) -> Column:
    n = F.length(pattern)
    rests = F.length(F.replace(pattern, F.lit("x"), F.lit("")))
    part = lambda x: F.least(F.lit(1.0), x)
    score = 0.25 * part(n / 12.0) + 0.35 * part(changes(pattern) / F.greatest(n - 1, F.lit(1))) + 0.2 * part(rests / F.greatest(n, F.lit(1))) + 0.2 * part(repeats / 8.0)
    return F.when(n > 0, round6(score)).otherwise(0.0)


def changes(pattern: Column) -> Column:
    n = F.length(pattern)
    return F.when(n < 2, 0).otherwise(F.size(F.filter(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: F.substr(pattern, i, F.lit(1)) != F.substr(pattern, i - 1, F.lit(1)))))


def _some(array: Column, test) -> Column:
    return F.coalesce(F.exists(array, test), F.lit(False))


def _reasons(family: Column) -> list[Column]:
    """What speaks against a match, each a condition: of the pattern itself, then of the family."""
    p, r = F.col("pattern"), F.col("ratios")
    onsets, rests, runs = F.col("onsets"), F.col("rests"), F.col("runs")
    some, triplets = F.length(p) > 0, p.contains("..x..x") | p.contains("x..x..x") | _some(r, lambda v: v.between(0.62, 0.70) | v.between(1.9, 2.1))
    near = _some(F.arrays_zip(F.slice(r, 1, 3).alias("v"), F.slice(F.array(F.lit(1.5), F.lit(1.5), F.lit(1.0)), 1, F.size(F.slice(r, 1, 3))).alias("t")), lambda z: F.abs(z["v"] - z["t"]) < 0.2)
    return [
        ~some,
        some & (onsets <= 1),
        some & (rests == 0),
        some & (runs <= 1),
        (family == "tresillo_3_3_2") & (onsets < 3),
        (family == "tresillo_3_3_2") & (rests < 2),
        (family == "tresillo_3_3_2") & ~(p.contains("x..x..x") | near),
        (family == "clave") & (onsets < 5),
        (family == "clave") & (F.length(p) < 12),
        family.isin("shuffle", "twelve_eight_gospel") & ~triplets,
        (family == "sparse_call_response") & (rests < onsets),
        (family == "sparse_call_response") & (F.col("repeats") < 2),
        (family == "backbeat") & (F.col("own_accents") == 0),
        F.col("all_onsets"),
        F.col("info") < 0.25,
    ]


def family_matches(motifs: DataFrame, k: int = 3) -> DataFrame:
    """motifs(motif_id, pattern, accents, ratios, repeats) -> the k best known patterns of each.

    ``pattern`` is of x and dots, ``accents`` marks accented steps with X, ``ratios`` are intervals between onsets. The first row of
    a motif also has how ambiguous the match is, its strength, and ``match``: the family, null where another is as near. Every
    motif meets the fixed short table, which is broadcast, so rows grow with the motifs only. A null pattern is an empty one.
    """
    own = motifs.withColumns({"pattern": F.coalesce("pattern", F.lit("")), "ratios": F.coalesce("ratios", F.array().cast("array<double>"))})
    own = own.withColumns({"own_onsets": mask(F.col("pattern"), "x"), "own_accents": mask(F.coalesce("accents", F.lit("")), "X"), "info": information(F.col("pattern"), F.col("repeats")), "runs": changes(F.col("pattern"))})
    own = own.withColumns({"onsets": F.bit_count("own_onsets"), "rests": F.length("pattern") - F.bit_count("own_onsets")})
    own = own.withColumn("all_onsets", (F.length("pattern") > 0) & (F.col("rests") == 0))
    met = own.join(F.broadcast(lexicon(motifs.sparkSession)), F.lit(True))
    token = F.array_max(F.transform("targets", lambda t: jaccard(F.col("own_onsets"), t)))
    ratio = F.array_max(F.transform("known_ratios", lambda k: ratio_likeness(F.col("ratios"), k)))
    met = met.withColumns({"token": round6(token), "accent": round6(jaccard(F.col("own_accents"), F.col("known_accents"))), "ratio": F.coalesce(ratio, F.lit(0.0))})
    met = met.withColumn("against", sum(c.cast("int") for c in _reasons(F.col("family"))))
    lacks = lambda name: F.col(name) <= 0.2
    lacking = lacks("token").cast("int") + ((F.col("needs") == "accent") & lacks("accent")).cast("int") + ((F.col("needs") == "ratio") & lacks("ratio")).cast("int")
    raw = 0.6 * F.col("token") + 0.22 * F.col("accent") + 0.18 * F.col("ratio")
    for holds, factor in ((F.col("all_onsets"), 0.45), (F.col("info") < 0.25, 0.65), (F.col("repeats") <= 1, 0.85)):
        raw = F.when(holds, raw * factor).otherwise(raw)
    raw = raw * F.greatest(F.lit(0.1), 1 - F.least(F.lit(0.5), 0.07 * F.col("against")))
    raw = F.when(lacking >= 2, raw * 0.7 * 0.7).when(lacking == 1, raw * 0.7).otherwise(raw)
    specific = F.least(F.lit(1.0), 0.6 * F.col("token") + 0.25 * F.col("ratio") + 0.15 * F.col("info"))
    met = met.withColumns({"confidence": round6(raw + HALF_UP), "specificity": round6(specific + HALF_UP), "reasons": F.col("against") + lacking})
    each = F.struct((-F.col("confidence")).alias("order"), "nth", "pattern_id", "family", "token", "accent", "ratio", "confidence", "specificity", "reasons", "all_onsets", "least", "strong", "moderate", "specific", "unsure")
    ranked = met.groupBy("motif_id").agg(F.array_sort(F.collect_list(each)).alias("m"))  # as many as known patterns
    gap = F.col("m")[0]["confidence"] - F.col("m")[1]["confidence"]
    ranked = ranked.select("motif_id", gap.alias("gap"), F.posexplode(F.slice("m", 1, k)).alias("at", "x")).select("motif_id", "gap", "at", "x.*")
    c, s, amb = F.col("confidence"), F.col("specificity"), clamp01(1 - F.col("gap") / 0.12)
    tied = (c >= 0.6) & (F.col("gap") < MARGIN)
    base = (
        F.when(amb >= F.col("unsure"), "ambiguous")
        .when((c < F.col("least")) | F.col("all_onsets"), "weak")
        .when(c < F.col("moderate"), F.when((amb <= F.least(F.lit(0.6), F.col("unsure"))) & (s >= F.col("specific")) & (F.col("reasons") <= 2), "moderate").otherwise("weak"))
        .when((c >= F.col("strong")) & (s >= F.greatest(F.lit(0.45), F.col("specific"))) & (amb <= 0.3) & (F.col("reasons") <= 1), "strong")
        .otherwise("moderate")
    )
    strength = F.when(amb > F.col("unsure"), "ambiguous").when((c < F.col("least")) | (s < F.col("specific")), "weak").when(tied, "ambiguous").otherwise(base)
    first = lambda x: F.when(F.col("at") == 0, x)
    return ranked.select(
        "motif_id", (F.col("at") + 1).alias("rank"), "pattern_id", "family", "token", "accent", "ratio", "confidence", "specificity", "reasons",
        first(round6(amb)).alias("ambiguity"), first(strength).alias("strength"), first(F.when(~tied, F.col("family"))).alias("match"),
    )
