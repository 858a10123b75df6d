"""Queries around generation. Projects, sessions, prompts and batches are made of orders, customers, parts and suppliers; such stand-ins are inputs only."""

from __future__ import annotations

from pyspark.sql import functions as F

from ostinato.operators import generation
from ostinato.operators import records as record_operators
from ostinato.plans.records import _PAIR_CTES, pair_rows
from ostinato.sources.music import table, with_sql

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(with_sql(*_PAIR_CTES) + """select task, (row_number() over w)::int as rank, split, final_score, perf || '-' || idx as example_id from split_pairs where split in ('train', 'validation')
window w as (partition by task order by (split = 'validation')::int, final_score desc, perf || '-' || idx) qualify row_number() over w <= 4""")
def example_retrieval(spark, sf_dir):
    """The four best pairs of each task for a generator."""
    pairs = record_operators.pair_quality(pair_rows(spark, sf_dir)).select("task", "split", "final_score", F.concat_ws("-", "perf", "context_idx").alias("example_id"))
    return generation.retrieved(pairs, ["task"], 4, ["train", "validation"]).select("task", "rank", "split", "final_score", "example_id")


@query("""with c as (select o_custkey as request, o_orderkey as candidate, count(l_orderkey) as notes from orders left join lineitem on l_orderkey = o_orderkey group by 1, 2)
select request, candidate, least(1, notes / 16.0::double)::double as score, row_number() over (partition by request order by least(1, notes / 16.0::double) desc, candidate) = 1 as chosen from c""")
def symbolic_candidates(spark, sf_dir):
    """A customer's orders as candidates, their line items as notes."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("notes"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("request"), F.col("o_orderkey").alias("candidate"))
    return generation.candidate_scores(orders.join(items, F.col("candidate") == F.col("l_orderkey"), "left"), "request", "candidate", "notes")


@query("""with n as (select p_partkey as prompt, 48 + coalesce(list_sum(list_transform(string_split(p_name, ''), lambda c: ord(c))), 0)::int % 24 as base, 60 + p_size * 2 as tempo, unnest([(0, 0, 82), (480, 3, 80), (960, 7, 86), (1440, 10, 84)]) as x from part)
select prompt, base + x[2] as pitch, x[3] as velocity, round(x[1] / 480.0::double * (60.0::double / tempo), 6) as start, round(greatest(x[1] / 480.0::double * (60.0::double / tempo) + 0.05::double, (x[1] + 480) / 480.0::double * (60.0::double / tempo)), 6) as finish from n""")
def stand_in_notes(spark, sf_dir):
    """Part names as prompts: the notes that stand in for a model, in seconds."""
    parts = table(spark, sf_dir, "part")
    notes = generation.stand_in_notes(parts, "p_partkey", "p_name").join(parts.select("p_partkey", (60 + F.col("p_size") * 2).alias("tempo")), "p_partkey")
    return generation.note_seconds(notes).select(F.col("p_partkey").alias("prompt"), "pitch", "velocity", F.round("start", 6).alias("start"), F.round("end", 6).alias("finish"))


_ROLES = ["drums", "bass", "chords", "lead", "texture_bed", "transition_fx", "voice"]


@query("""with r as (select l_orderkey as project, ['drums', 'bass', 'chords', 'lead', 'texture_bed', 'transition_fx', 'voice'][(l_linenumber + l_suppkey) % 7 + 1] as role from lineitem),
g as (select project, count(*) as tracks, count(case when role in ('bass', 'drums') then 1 end) as low, count(case when role in ('chords', 'texture_bed', 'voice') then 1 end) as mid, count(case when role in ('lead', 'transition_fx') then 1 end) as high, list(distinct role) as roles from r group by project)
select project, tracks, low, mid, high, array_to_string(list_filter(['bass', 'chords', 'drums', 'lead', 'texture_bed', 'transition_fx'], lambda x: not list_contains(roles, x)), ',') as missing,
  concat_ws(',', case when list_has_all(roles, ['lead', 'chords']) then 'lead/chords' end, case when list_has_all(roles, ['texture_bed', 'transition_fx']) then 'texture_bed/transition_fx' end) as masking_risks from g""")
def sound_palettes(spark, sf_dir):
    """Orders as projects, line items as their tracks."""
    role = F.element_at(F.array(*[F.lit(r) for r in _ROLES]), ((F.col("l_linenumber") + F.col("l_suppkey")) % 7 + 1).cast("int"))
    return generation.palettes(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("project"), role.alias("role")), "project", "role")


@query("""with s as (select c_custkey as row_id, case when c_custkey % 9 > 0 then c_name end as session_id, c_nationkey % 7 as rating, case c_mktsegment when 'BUILDING' then 'splice_production_only' when 'MACHINERY' then 'unheard_of' else 'user_owned_training_candidate' end as policy, c_acctbal > 0 as allowed from customer),
e as (select row_id, unnest([case when session_id is null then 'missing:session_id' end, case when policy = 'unheard_of' then 'invalid_source_policy_inherited' end, case when not rating between 1 and 5 then 'human_rating must be 1-5' end, case when policy = 'splice_production_only' and allowed then 'training_allowed must be false for restricted source policy' end]) as error from s)
select error, count(*) as n, min(row_id) as first_row from e where error is not null group by error""")
def session_row_checks(spark, sf_dir):
    """Customers as rows of session results: what is wrong, how often, and where first."""
    policy = F.when(F.col("c_mktsegment") == "BUILDING", "splice_production_only").when(F.col("c_mktsegment") == "MACHINERY", "unheard_of").otherwise("user_owned_training_candidate")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), F.when(F.col("c_custkey") % 9 > 0, F.col("c_name")).alias("session_id"), (F.col("c_nationkey") % 7).alias("human_rating"), policy.alias("source_policy_inherited"), (F.col("c_acctbal") > 0).alias("training_allowed"))
    errors = generation.session_errors(rows, ["session_id"], [*generation.RESTRICTED, "user_owned_training_candidate"])
    return rows.select("row_id", F.explode(errors).alias("error")).groupBy("error").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))


@query("""with i as (select s_nationkey as batch, count(case when s_acctbal > 0 then 1 end) as runnable, count(case when not s_acctbal > 0 then 1 end) as skipped from supplier group by 1),
b as (select n_nationkey as batch, concat_ws(',', case when n_nationkey % 5 = 0 then 'invalid manifest' end, case when n_nationkey % 3 = 0 and n_regionkey < 2 then 'transcription requested but not allowed' end, case when n_nationkey % 4 = 1 and n_regionkey > 2 then 'modal requested but not allowed' end) as errors from nation)
select b.batch, case when errors <> '' then 'blocked_invalid_manifest' when b.batch % 2 = 0 then 'execution_blocked_not_integrated' else 'dry_run_success' end as status, coalesce(runnable, 0) as runnable, coalesce(skipped, 0) as skipped, errors from b left join i using (batch)""")
def batch_dry_runs(spark, sf_dir):
    """Nations as batches, suppliers as their items."""
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    batches = table(spark, sf_dir, "nation").select(k.alias("batch"), (k % 5 > 0).alias("valid"), (k % 2 == 0).alias("execute"), (k % 3 == 0).alias("transcription_requested"), (r >= 2).alias("allow_transcription"), (k % 4 == 1).alias("modal_requested"), (r <= 2).alias("allow_modal"))
    items = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("batch"), (F.col("s_acctbal") > 0).alias("authorized"))
    return generation.dry_runs(batches, items, "batch")


@query("""with c as (select c_nationkey as site, count(case when c_mktsegment = 'BUILDING' then 1 end) as symbolic, count(case when c_acctbal < -900 then 1 end) as exports, count(case when c_acctbal > 9900 then 1 end) as sessions, count(case when c_custkey % 40 = 0 then 1 end) as textures,
  count(case when c_custkey % 30 = 0 then 1 end) as seeds, count(case when c_custkey % 50 = 0 then 1 end) as arrangements, count(case when c_custkey % 60 = 0 then 1 end) as handoffs from customer group by 1)
select site, x[1] as subsystem, x[2] as state from (select site, unnest([('symbolic_generator', case when symbolic > 0 then 'conditioning_ready' else 'not_ready' end), ('symbolic_ranker', case when symbolic > 0 and exports > 0 then 'ranker_training_ready' else 'not_ready' end),
  ('texture_embedding', case when textures > 0 then 'conditioning_ready' else 'not_ready' end), ('seed_selector', case when seeds = 0 then 'blocked' when sessions > 0 then 'ranker_training_ready' else 'conditioning_ready' end),
  ('arrangement', case when arrangements > 0 then 'conditioning_ready' else 'not_ready' end), ('controller', case when handoffs > 0 then 'conditioning_ready' else 'not_ready' end)]) as x from c)""")
def subsystem_readiness(spark, sf_dir):
    """Nations as sites, their customers as the files that are counted."""
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("site")).agg(F.count_if(F.col("c_mktsegment") == "BUILDING").alias("symbolic"), F.count_if(balance < -900).alias("exports"), F.count_if(balance > 9900).alias("sessions"), *[F.count_if(key % m == 0).alias(c) for c, m in (("textures", 40), ("seeds", 30), ("arrangements", 50), ("handoffs", 60))])
    return generation.readiness(counts, "site")
