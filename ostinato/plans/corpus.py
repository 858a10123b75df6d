"""Queries on texts, pages, labels, vectors and conversations: policies, audits and reference matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ostinato.operators import lexicon, policies, rhythm
from ostinato.plans.rhythm import _GRAMS, _GRID, BINNED, PULSES, grids
from ostinato.sources.music import table, with_sql

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: What the leak scan looks for; both engines read these patterns alike.
MARKERS = {"email": r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]+", "home_path": r"/home/[a-z]+", "windows_path": r"C:\\Users", "phone": r"\+?[0-9]{3}[- ][0-9]{3}[- ][0-9]{4}", "url": r"https?://"}


@query("select doc_id, source, marker, n::int as n, case when doc_id % 10 = 0 then 'new_or_changed_public_leak' when source in ('src0', 'src1') then 'enforced_public_leak' else 'pre_existing_historical_path_debt' end as kind from (" + " union all ".join(f"select doc_id, source, '{k}' as marker, len(regexp_extract_all(text, '{p}')) as n from documents" for k, p in MARKERS.items()) + ") where n > 0")
def privacy_scan(spark, sf_dir):
    found = policies.marker_counts(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), MARKERS)
    return found.withColumn("kind", policies.leak_kind(F.col("doc_id") % 10 == 0, F.col("source").isin("src0", "src1")))


@query(r"select page_id, regexp_replace(url, '^(https?)://[^/]+', '\1://REDACTED') as redacted, len(regexp_extract_all(html, 'href=\"/'))::int as local_links, sha256(url) as url_sha256 from pages")
def path_redaction(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.regexp_replace("url", "^(https?)://[^/]+", "$1://REDACTED").alias("redacted"), F.regexp_count("html", F.lit('href="/')).alias("local_links"), F.sha2("url", 256).alias("url_sha256"))


def _asset_case(column: int) -> str:
    length = {"short": "p_size / 10.0 <= 2.0 and ", "long": "p_size / 10.0 > 2.0 and ", "": ""}
    rungs = []
    for rule in policies.ASSET_RULES:
        words = " or ".join(f"contains(hint, '{w}')" for w in rule[3])
        rungs.append(f"when {length[rule[2]]}({words}) then " + (f"'{rule[0]}'" if column == 0 else f"{rule[1]}::double"))
    return "case " + " ".join(rungs) + (" else 'unknown' end" if column == 0 else " else 0.25::double end")


_HINTS = "['kick', 'bass line', 'chord', 'vocal', 'synth', 'amen break', 'drum loop', 'shaker loop', 'riser', 'impact', 'drone', 'ambient pad', 'foley', 'melody', 'blob']"


@query(f"with p as (select p_partkey, p_size, lower({_HINTS}[(p_partkey % 15 + 1)::int] || '/' || p_name) as hint from part) select p_partkey, {_asset_case(0)} as asset_type, {_asset_case(1)} as confidence, case when asset_type in ('synth_one_shot', 'bass_one_shot', 'chord_stab', 'vocal_chop') then 'eligible' when asset_type in ('drum_break', 'drum_loop', 'percussion_loop') then 'ineligible' else 'review_required' end as seed from p")
def asset_classification(spark, sf_dir):
    """Parts as samples: a tenth of the size is the length in seconds, and a word for the kind leads the path."""
    hints = F.array(*[F.lit(h) for h in _HINTS.strip("[]").replace("'", "").split(", ")])
    path = F.concat(F.get(hints, (F.col("p_partkey") % 15).cast("int")), F.lit("/"), F.col("p_name"))
    name, sure = policies.asset_class(path, F.col("p_size") / 10.0)
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("asset_type"), sure.alias("confidence"))
    return rows.withColumn("seed", policies.seed_eligibility(F.col("asset_type")))


_POLICY_ROWS = """r as (select doc_id, case when doc_id % 17 = 0 then 'splice_pack' else source end as source_type, case when doc_id % 5 = 0 then 'user_owned_training_candidate' when doc_id % 13 = 0 then 'unknown' else 'standard' end as source_policy,
  case doc_id % 4 when 0 then 'approved_for_training' when 1 then 'unknown' when 2 then 'review' else 'Trusted_for_training' end as auth, coalesce(quality, 1) = 0 as review, coalesce(quality, 0) = 1 as reviewed, doc_id % 3 as k from documents left join labels using (doc_id))"""


def policy_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    n = F.col("doc_id")
    joined = docs.join(labels, "doc_id", "left")
    return joined.select(
        "doc_id",
        F.when(n % 17 == 0, "splice_pack").otherwise(F.col("source")).alias("source_type"),
        F.when(n % 5 == 0, "user_owned_training_candidate").when(n % 13 == 0, "unknown").otherwise("standard").alias("source_policy"),
        F.when(n % 4 == 0, "approved_for_training").when(n % 4 == 1, "unknown").when(n % 4 == 2, "review").otherwise("Trusted_for_training").alias("authorization_status"),
        (F.coalesce("quality", F.lit(1)) == 0).alias("requires_human_review"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("human_reviewed"),
        F.when(n % 3 == 0, "ranker_feedback").otherwise("note").alias("feedback_type"),
    )


@query("with " + _POLICY_ROWS + """ select doc_id, case when contains(lower(source_type), 'splice') or contains(lower(source_policy), 'splice') then 'block' when lower(auth) in ('', 'unknown', 'undeclared') or source_policy in ('unknown_blocked', 'unknown') then 'block' when review then 'allow_review_only'
  when source_policy = 'user_owned_training_candidate' or lower(auth) in ('trusted_for_training', 'approved_for_training', 'authorized_for_training') then 'allow_train' else 'allow_review_only' end as status from r""")
def training_route_policy(spark, sf_dir):
    return policies.training_route(policy_rows(spark, sf_dir)).select("doc_id", "status")


@query("with " + _POLICY_ROWS + """, s as (select *, case doc_id % 6 when 0 then 'generated_midi' when 1 then 'demucs_stem' when 2 then 'basic_pitch' when 3 then 'splice' else 'user' end as st from r)
select doc_id, case when st = 'splice' then false when lower(auth) in ('', 'unknown', 'undeclared', 'copyrighted', 'restricted') then false when st = 'demucs_stem' then false when st = 'basic_pitch' then false when k = 0 then true when st = 'generated_midi' then reviewed else false end as trainable,
  case when st = 'splice' then 'excluded' when lower(auth) in ('', 'unknown', 'undeclared', 'copyrighted', 'restricted') then 'excluded' when st = 'demucs_stem' then 'weak_evidence' when st = 'basic_pitch' then 'witness_not_truth' when k = 0 then 'feedback_allowed' when st = 'generated_midi' then 'human_review_required' else 'validated_corpus_required' end as semantics from s""")
def feedback_policy(spark, sf_dir):
    kinds = F.array(*[F.lit(x) for x in ("generated_midi", "demucs_stem", "basic_pitch", "splice", "user", "user")])
    rows = policy_rows(spark, sf_dir).withColumn("source_type", F.get(kinds, (F.col("doc_id") % 6).cast("int")))
    return policies.feedback_trainable(rows).select("doc_id", "trainable", "semantics")


@query("select vec_id, len(embedding)::int as dimension, round(list_avg(embedding::double[]), 6) as mean, round(list_min(embedding)::double, 6) as least, round(list_max(embedding)::double, 6) as most from embeddings")
def embedding_summary(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    mean = F.aggregate(e, F.lit(0.0), lambda a, x: a + x) / F.size(e)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(e).alias("dimension"), F.round(mean, 6).alias("mean"), F.round(F.array_min(e), 6).alias("least"), F.round(F.array_max(e), 6).alias("most"))


@query("""select conv_id, turn, length(text)::int as call_chars, length(answer)::int as response_chars from (select *, lead(text) over w as answer, lead(role) over w as next_role from conversations window w as (partition by conv_id order by turn)) where role = 'user' and next_role = 'assistant'""")
def conversation_call_response(spark, sf_dir):
    """Each user turn with the answer that follows it: turns are numbered, so a join on the next number finds it."""
    turns = table(spark, sf_dir, "conversations")
    calls = turns.where("role = 'user'").select("conv_id", "turn", F.length("text").alias("call_chars"))
    answers = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").alias("response_chars"))
    return calls.join(answers, ["conv_id", "turn"])


@query("select doc_id, quality, toxic, case when toxic = 1 then 'review' when quality = 1 then 'high' else 'low' end as bucket from labels order by doc_id limit 40")
def review_queue(spark, sf_dir):
    """The first 40 labelled rows: a queue of that length."""
    bucket = F.when(F.col("toxic") == 1, "review").when(F.col("quality") == 1, "high").otherwise("low")
    return table(spark, sf_dir, "labels").orderBy("doc_id").limit(40).select("doc_id", "quality", "toxic", bucket.alias("bucket"))


@query("select doc_id, case when toxic = 1 then 'exclude' when quality = 0 then 'review' when ('0x' || substr(md5(doc_id::varchar), 1, 4))::int % 5 = 0 then 'validation' else 'train' end as split from labels")
def corpus_split(spark, sf_dir):
    """One in five good rows validates, by a hash of the id."""
    fifth = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 4), 16, 10).cast("int") % 5 == 0
    split = F.when(F.col("toxic") == 1, "exclude").when(F.col("quality") == 0, "review").when(fifth, "validation").otherwise("train")
    return table(spark, sf_dir, "labels").select("doc_id", split.alias("split"))


@query("with d as (select distinct unnest(string_split(text, ' ')) as w from documents), b as (select item_id, list_distinct(string_split(text, ' ')) as ws from benchmark), e as (select item_id, len(ws) as n, unnest(ws) as w from b) select item_id, any_value(n)::int as words, count(d.w) as known from e left join d on d.w = e.w group by item_id")
def reference_overlap(spark, sf_dir):
    """How many of a benchmark item's distinct words the corpus has."""
    known = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("w")).distinct().withColumn("k", F.lit(1))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.split("text", " ")).alias("ws"))
    words = items.select("item_id", F.size("ws").alias("words"), F.explode("ws").alias("w"))
    return words.join(known, "w", "left").groupBy("item_id", "words").agg(F.count("k").alias("known"))


@query("select coalesce(l.source, r.source) as source, coalesce(documents, 0) as documents, coalesce(toxic, 0) as toxic from (select source, count(*) as documents from documents where lang = 'en' group by source) l full join (select source, count(*) as toxic from documents join labels using (doc_id) where toxic = 1 group by source) r on l.source = r.source")
def source_label_audit(spark, sf_dir):
    """Keys of either side, joined outwards."""
    docs = table(spark, sf_dir, "documents")
    english = docs.where("lang = 'en'").groupBy("source").agg(F.count("*").alias("documents"))
    toxic = docs.select("doc_id", "source").join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id").groupBy("source").agg(F.count("*").alias("toxic"))
    return english.join(toxic, "source", "full_outer").select("source", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


_LEXICON = "cells as (select * from (values " + ", ".join(f"({n}, '{p}', '{f}', {t}::bigint[], {r}::double[][], {a}::bigint, " + ", ".join(f"{x}::double" for x in limits) + f", '{needs}')" for n, p, f, t, r, a, *limits, needs in lexicon.known_patterns()) + """) as t(nth, pattern_id, family, targets, known_ratios, known_accents, least_, strong_, moderate_, specific_, unsure_, needs))"""
_MATCH = """own as (
  select *, length(pattern) as n, len(places) as onsets, length(pattern) - len(places) as rests, len(list_filter(range(2, greatest(length(pattern), 1) + 1), lambda i: pattern[i] <> pattern[i - 1])) as runs,
         coalesce(list_sum(list_transform(places, lambda i: 1::bigint << (i - 1)::bigint)), 0)::bigint as own_onsets,
         coalesce(list_sum(list_transform(list_filter(range(1, length(accents) + 1), lambda i: accents[i] = 'X'), lambda i: 1::bigint << (i - 1)::bigint)), 0)::bigint as own_accents
  from (select *, list_filter(range(1, length(pattern) + 1), lambda i: pattern[i] = 'x') as places from motifs)),
told as (select *, n > 0 and rests = 0 as all_onsets, case when n > 0 then round(0.25::double * least(1, n / 12.0::double) + 0.35::double * least(1, runs / greatest(n - 1, 1)::double) + 0.2::double * least(1, rests / n::double) + 0.2::double * least(1, repeats / 8.0::double), 6) else 0 end as info,
  pattern like '%..x..x%' or pattern like '%x..x..x%' or len(list_filter(ratios, lambda v: v between 0.62::double and 0.70::double or v between 1.9::double and 2.1::double)) > 0 as triplets,
  pattern like '%x..x..x%' or coalesce(abs(ratios[1] - 1.5) < 0.2::double, false) or coalesce(abs(ratios[2] - 1.5) < 0.2::double, false) or coalesce(abs(ratios[3] - 1) < 0.2::double, false) as skeleton from own),
sim as (
  select m.*, c.*, round(list_max(list_transform(targets, lambda t: case when bit_count(own_onsets | t) > 0 then bit_count(own_onsets & t) / bit_count(own_onsets | t)::double else 0 end)), 6) as token,
    round(case when bit_count(own_accents | known_accents) > 0 then bit_count(own_accents & known_accents) / bit_count(own_accents | known_accents)::double else 0 end, 6) as accent,
    case when len(ratios) = 0 then 0 else list_max(list_transform(known_ratios, lambda k: round(greatest(0, 1 - list_sum(list_transform(range(1, least(len(k), len(ratios)) + 1), lambda i: least(1, abs(ratios[i] - k[i]) / greatest(0.001::double, abs(k[i]))))) / least(len(k), len(ratios))), 6))) end as ratio
  from told m cross join cells c),
weighed as (
  select *, (n = 0)::int + (n > 0 and onsets <= 1)::int + (n > 0 and rests = 0)::int + (n > 0 and runs <= 1)::int + all_onsets::int + (info < 0.25::double)::int
    + case family when 'tresillo_3_3_2' then (onsets < 3)::int + (rests < 2)::int + (not skeleton)::int when 'clave' then (onsets < 5)::int + (n < 12)::int when 'shuffle' then (not triplets)::int when 'twelve_eight_gospel' then (not triplets)::int
      when 'sparse_call_response' then (rests < onsets)::int + (repeats < 2)::int when 'backbeat' then (own_accents = 0)::int else 0 end as against,
    (token <= 0.2::double)::int + (needs = 'accent' and accent <= 0.2::double)::int + (needs = 'ratio' and ratio <= 0.2::double)::int as lacking from sim),
conf as (
  select *, against + lacking as reasons, round((0.6::double * token + 0.22::double * accent + 0.18::double * ratio) * case when all_onsets then 0.45::double else 1 end * case when info < 0.25::double then 0.65::double else 1 end * case when repeats <= 1 then 0.85::double else 1 end
    * greatest(0.1::double, 1 - least(0.5::double, 0.07::double * against)) * case when lacking >= 1 then 0.7::double else 1 end * case when lacking >= 2 then 0.7::double else 1 end + 1e-9::double, 6) as confidence,
    round(least(1, 0.6::double * token + 0.25::double * ratio + 0.15::double * info) + 1e-9::double, 6) as specificity from weighed),
ranks as (select *, row_number() over w as rank, confidence - lead(confidence) over w as gap from conf window w as (partition by motif_id order by confidence desc, nth)),
judged as (select *, greatest(0, least(1, 1 - gap / 0.12::double)) as amb, confidence >= 0.6::double and gap < 0.03::double as tied from ranks where rank <= 3),
matched as (select motif_id, rank::int as rank, pattern_id, family, token, accent, ratio, confidence, specificity, reasons::int as reasons, case when rank = 1 then round(amb, 6) end as ambiguity,
  case when rank > 1 then null when amb > unsure_ then 'ambiguous' when confidence < least_ or specificity < specific_ then 'weak' when tied or amb >= unsure_ then 'ambiguous' when all_onsets then 'weak'
    when confidence < moderate_ then case when amb <= least(0.6::double, unsure_) and reasons <= 2 then 'moderate' else 'weak' end
    when confidence >= strong_ and specificity >= 0.45::double and amb <= 0.3::double and reasons <= 1 then 'strong' else 'moderate' end as strength,
  case when rank = 1 and not tied then family end as match from judged)"""
_MOTIFS = """firsts as (select perf, gram, count(*) as repeats, count(distinct idx) as regions, replace(arg_min(marks, (idx, place)), 'A', 'X') as accents from grams group by perf, gram having count(*) >= 2),
motifs as (select gram || '@' || perf as motif_id, perf, gram as pattern, accents, repeats, list_transform(range(2, len(p) + 1), lambda i: (p[i] - p[i - 1]) / 2.0::double) as ratios
  from (select *, list_filter(range(1, length(gram) + 1), lambda i: gram[i] = 'x') as p from firsts))"""
_MOTIF_CTES = [*BINNED, PULSES, _GRID, _GRAMS, _MOTIFS, _LEXICON, _MATCH]


def motif_rows(spark, sf_dir):
    """Motifs of 3 to 12 steps that a performance repeats, with the accents of their first place and their onsets' ratios."""
    grams = rhythm.motif_ngrams(grids(spark, sf_dir))
    grouped = grams.groupBy("perf", "gram").agg(F.count("*").alias("repeats"), F.min_by("marks", F.struct("idx", "place")).alias("marks")).where("repeats >= 2")
    return grouped.select("perf", F.concat("gram", F.lit("@"), "perf").alias("motif_id"), F.col("gram").alias("pattern"), F.translate("marks", "A", "X").alias("accents"), "repeats", rhythm.onset_ratios(F.col("gram")).alias("ratios"))


@query(with_sql(*_MOTIF_CTES) + "select * from matched")
def rhythm_family_match(spark, sf_dir):
    return lexicon.family_matches(motif_rows(spark, sf_dir))


@query(with_sql(*_MOTIF_CTES) + "select perf, coalesce(match, 'none') as family, count(*) as motifs, count(case when strength = 'strong' then 1 end) as strong, count(case when strength = 'moderate' then 1 end) as moderate, count(case when strength = 'weak' then 1 end) as weak, count(case when strength = 'ambiguous' then 1 end) as ambiguous, sum(repeats)::bigint as repeats from matched join motifs using (motif_id) where rank = 1 group by perf, coalesce(match, 'none')")
def family_strengths(spark, sf_dir):
    """How many motifs of a performance match each family, by strength."""
    motifs = motif_rows(spark, sf_dir)
    best = lexicon.family_matches(motifs, k=1).join(motifs.select("motif_id", "perf", "repeats"), "motif_id")
    of = lambda name: F.count_if(F.col("strength") == name).alias(name)
    return best.groupBy("perf", F.coalesce("match", F.lit("none")).alias("family")).agg(F.count("*").alias("motifs"), of("strong"), of("moderate"), of("weak"), of("ambiguous"), F.sum("repeats").alias("repeats"))


#: Patterns that belong to no family, as controls: onsets only, a single onset, one run.
CONTROLS = [("onsets_only", "xxxxxxxx"), ("one_onset", "x......."), ("late_onset", ".......x"), ("one_run", "xxxx...."), ("no_onset", "........"), ("empty", "")]


def fixture_rows() -> list[tuple]:
    """(motif_id, expected, pattern, accents, ratios, repeats): every known pattern with its own accents and ratios, and the controls."""
    known = [(f"{name}#{i}", family, t, accents, ratios[0], 4) for name, family, tokens, ratios, accents, _ in lexicon.PATTERNS for i, t in enumerate(tokens)]
    return known + [(name, "none", p, "", [], 1) for name, p in CONTROLS]


_FIXTURES = "motifs as (select * from (values " + ", ".join(f"('{m}', '{e}', '{p}', '{a}', {r}::double[], {n}::bigint)" for m, e, p, a, r, n in fixture_rows()) + ") as t(motif_id, expected, pattern, accents, ratios, repeats))"


def judged_fixtures(spark) -> DataFrame:
    """Each fixture with what was found: a family counts as predicted unless its match is weak or ambiguous."""
    motifs = spark.createDataFrame(fixture_rows(), "motif_id string, expected string, pattern string, accents string, ratios array<double>, repeats bigint")
    found = lexicon.family_matches(motifs)
    sure = (F.col("rank") == 1) & F.col("strength").isin("strong", "moderate")
    judged = found.groupBy("motif_id").agg(F.coalesce(F.max(F.when(sure, F.col("match"))), F.lit("none")).alias("predicted"), F.collect_set("family").alias("top3"))
    return motifs.select("motif_id", "expected").join(judged, "motif_id")


_JUDGED = "found as (select motif_id, coalesce(max(case when rank = 1 and strength in ('strong', 'moderate') then match end), 'none') as predicted, list(family) as top3 from matched group by motif_id), fixtures as (select m.motif_id, m.expected, predicted, top3 from motifs m join found using (motif_id))"


@query("with " + ",\n".join([_LEXICON, _FIXTURES, _MATCH, _JUDGED]) + " select expected, predicted, count(*) as n from fixtures group by all")
def lexicon_confusion(spark, sf_dir):
    """Known patterns and controls against the families found for them."""
    return judged_fixtures(spark).groupBy("expected", "predicted").agg(F.count("*").alias("n"))


@query("with " + ",\n".join([_LEXICON, _FIXTURES, _MATCH, _JUDGED]) + """ select count(*) as fixtures, count(case when expected <> 'none' and predicted = expected then 1 end) as hits, count(case when expected <> 'none' and list_contains(top3, expected) then 1 end) as top3_hits,
  count(case when predicted <> 'none' and predicted <> expected then 1 end) as false_positives, count(case when expected <> 'none' and predicted <> expected then 1 end) as false_negatives, count(case when expected = 'none' and predicted = 'none' then 1 end) as true_negatives from fixtures""")
def lexicon_evaluation(spark, sf_dir):
    """Hits, top-three hits, false positives and negatives over the fixtures."""
    known, hit, told = F.col("expected") != "none", F.col("predicted") == F.col("expected"), F.col("predicted") != "none"
    return judged_fixtures(spark).agg(
        F.count("*").alias("fixtures"),
        F.count_if(known & hit).alias("hits"),
        F.count_if(known & F.array_contains("top3", F.col("expected"))).alias("top3_hits"),
        F.count_if(told & ~hit).alias("false_positives"),
        F.count_if(known & ~hit).alias("false_negatives"),
        F.count_if(~known & ~told).alias("true_negatives"),
    )


@query("select role, section, (i * 7 + section * 3) % 5 as candidate, (section * 5 - 7) as transpose, round(180 * (0.618034::double ^ section), 6) as start from (values ('bass', 0), ('drums', 1), ('keys', 2), ('lead', 3)) as r(role, i), (select unnest(range(0, 5))::int as section)")
def arrangement_grid(spark, sf_dir):
    """Roles by sections: five sections by the golden ratio, with candidates in turn."""
    roles = spark.createDataFrame([("bass", 0), ("drums", 1), ("keys", 2), ("lead", 3)], "role string, i int")
    grid = roles.withColumn("section", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return grid.select("role", "section", ((F.col("i") * 7 + F.col("section") * 3) % 5).alias("candidate"), (F.col("section") * 5 - 7).alias("transpose"), F.round(F.lit(180) * F.pow(F.lit(0.618034), F.col("section")), 6).alias("start"))


@query("select c.c_nationkey, count(distinct c.c_custkey) as customers, count(o.o_orderkey) as orders, round(sum(o.o_totalprice), 2) as total, count(case when o.o_orderkey is null then 1 end) as without from customer c left join orders o on o.o_custkey = c.c_custkey group by c.c_nationkey")
def corpus_yield_rollup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    joined = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.groupBy("c_nationkey").agg(F.count_distinct("c_custkey").alias("customers"), F.count("o_orderkey").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count_if(F.col("o_orderkey").isNull()).alias("without"))


@query("select l_linestatus, l_returnflag, grouping(l_linestatus)::int * 2 + grouping(l_returnflag)::int as level, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem group by cube (l_linestatus, l_returnflag)")
def shipment_cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_linestatus", "l_returnflag").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
