"""Queries on content at four granularities, and on the example pairs that are made of them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.operators import evidence, examples, records, rhythm
from ostinato.plans.harmony import _CHORDS
from ostinato.plans.records import _SCORES
from ostinato.plans.rhythm import _GRAMS, _GRID, BINNED, PULSES, gaps_sql, grids
from ostinato.sources import music
from ostinato.sources.music import NOTES_SQL, with_sql

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Granularities in the order in which their routes are listed.
KINDS = [("performance", music.DURATION), ("segment", music.SEGMENT), ("window", music.WINDOW), ("bin", music.BIN)]


def merged_regions(spark, sf_dir) -> DataFrame:
    states = evidence.bin_states(music.notes(spark, sf_dir), music.BIN, music.DURATION)
    return evidence.rolled(states, KINDS, music.BIN, music.DURATION)


def content_regions(spark, sf_dir) -> DataFrame:
    """Content states of the regions of all kinds, with their evidence and scores."""
    return records.content_states(records.content_scores(evidence.evidence(merged_regions(spark, sf_dir))))


_KINDS = "kinds as (select * from (values " + ", ".join(f"('{k}', {i}, {w}::double)" for i, (k, w) in enumerate(KINDS)) + ") as t(kind, kind_order, wide))"
_REGIONS = f"""placed as (
  select perf, kind, kind_order, wide, least(floor(t / wide), ceil({music.DURATION} / wide) - 1)::int as idx, seq, t, note, vel from notes cross join kinds where t between 0 and {music.DURATION}),
located as (select *, idx * wide as lo, least({music.DURATION}::double, (idx + 1) * wide) as hi from placed)"""
_EVIDENCE = f"""stepped as (select *, lead(note) over (partition by perf, kind, idx order by t, seq) - note as step from gaps),
ev as (
  select perf, kind, kind_order, idx, lo, hi, count(*) as n, count(case when gap <= 0.08 then 1 end) as near, count(case when gap > 0 then 1 end) as positive,
         count(distinct least(floor(t), {int(music.DURATION) - 1})) as tiles, count(case when abs(step) between 1 and 4 then 1 end)::double as moves, count(step) as steps,
         avg(vel) as vel_mean, stddev_pop(vel) as vel_std from stepped group by all),
changed as (
  select c.perf, k.kind, floor(c.idx * {music.BIN} / k.wide)::int as idx, c.n,
         lag(c.root || c.quality) over (partition by c.perf, k.kind, floor(c.idx * {music.BIN} / k.wide) order by c.idx) <> c.root || c.quality as change
  from chords c cross join kinds k where c.kind = 'bin'),
changes as (select perf, kind, idx, count(case when change then 1 end)::double as activity, max(n) >= 16 as motif from changed group by all),
evidence as (
  select e.perf, e.kind, e.kind_order, e.idx, e.lo, e.hi, e.n as notes, e.n / (e.hi - e.lo) as density, case when e.n > 1 then near::double / (e.n - 1) else 0 end as poly,
         (ceil(e.hi - e.lo) - tiles) / ceil(e.hi - e.lo) as silence, c.confidence as chord, len(c.active) as classes, activity, case when steps > 0 then moves / steps else 0 end as movement, motif,
         round(case when positive = 0 then least(0.35, case when e.n < 8 then least(0.45, least(0.9, 0.35 + least(0.6, e.n / 120.0::double))) else least(0.9, 0.35 + least(0.6, e.n / 120.0::double)) end)
                    when e.n < 8 then least(0.45, least(0.9, 0.35 + least(0.6, e.n / 120.0::double))) else least(0.9, 0.35 + least(0.6, e.n / 120.0::double)) end, 6) as confidence, vel_mean, vel_std
  from ev e join chords c using (perf, kind, idx) join changes using (perf, kind, idx))"""
_ALL_STATES = [NOTES_SQL, _KINDS, _REGIONS, gaps_sql(), _CHORDS, _EVIDENCE, _SCORES]


@query(with_sql(*_ALL_STATES) + """select perf || ':' || kind || ':' || kind || '_' || format('{:04d}', idx) as route_id, perf, kind, kind_order, idx, lo, hi, notes,
  round(density, 6) as density, round(poly, 6) as poly, round(silence, 6) as silence, chord, classes, activity, round(movement, 6) as movement, round(vel_mean, 6) as vel_mean, round(vel_std, 6) as vel_std,
  content_state, state_confidence, round(greatest(0, least(1, ranked[1] - ranked[2])), 6) as margin from states""")
def content_routes_all(spark, sf_dir):
    """A route for each performance, segment, window and bin with events, from one scan of the events."""
    rounded = [F.round(c, 6).alias(c) for c in ("density", "poly", "silence", "movement", "vel_mean", "vel_std")]
    name = F.concat_ws(":", "perf", "kind", F.format_string("%s_%04d", "kind", "idx"))
    return content_regions(spark, sf_dir).select(name.alias("route_id"), "perf", "kind", "kind_order", "idx", "lo", "hi", "notes", *rounded, "chord", "classes", "activity", "content_state", "state_confidence", "margin")


@query(with_sql(*_ALL_STATES) + "select kind, content_state, count(*) as n, round(count(*) / (sum(count(*)) over (partition by kind))::double, 6) as share, min(lo) as first_lo from states group by kind, content_state")
def content_state_counts(spark, sf_dir):
    """How many regions of each kind are in each state; the shares come from a second sum over a few rows."""
    counted = content_regions(spark, sf_dir).groupBy("kind", "content_state").agg(F.count("*").alias("n"), F.min("lo").alias("first_lo"))
    total = counted.groupBy("kind").agg(F.sum("n").alias("whole"))
    return counted.join(total, "kind").select("kind", "content_state", "n", F.round(F.col("n") / F.col("whole"), 6).alias("share"), "first_lo")


def example_regions(spark, sf_dir) -> DataFrame:
    """Windows and segments with what examples look at: a chord of two classes or more is a harmony record, a step of melody a melody record."""
    refs = {"harmony_refs": ((F.col("classes") >= 2) & (F.col("chord") > 0)).cast("int"), "melody_refs": (F.col("movement") > 0).cast("int")}
    return content_regions(spark, sf_dir).where("kind in ('window', 'segment')").withColumns(refs)


_POLICIES = "policies as (select * from (values " + ", ".join(f"('{t}', '{s}', {a}::double, {b}::double, {n})" for t, s, a, b, n in examples.POLICIES) + ") as t(task, states, least_seconds, most_seconds, least_notes))"
_COMPATIBLE = """({a} = {b} or ({a} in ('harmonic_dominant', 'polyphonic_full_mix') and {b} in ('harmonic_dominant', 'polyphonic_full_mix', 'melodic_lead')) or ({a} in ('rhythm_dominant', 'percussive_only') and {b} in ('rhythm_dominant', 'percussive_only', 'polyphonic_full_mix'))
  or ({a} in ('melodic_lead', 'vocal_dominant', 'rap_vocal_dominant') and {b} in ('melodic_lead', 'vocal_dominant', 'rap_vocal_dominant', 'polyphonic_full_mix')))"""
_SOUND = "(" + ", ".join(f"'{s}'" for s in records.SOUNDING) + ")"
_EXAMPLES = f"""r as (select perf, kind, idx, lo, hi, notes, density, content_state, activity, (classes >= 2 and chord > 0)::int as harmony_refs, (movement > 0)::int as melody_refs from states where kind in ('window', 'segment')),
w as (
  select a.perf, a.kind, a.idx, a.lo, a.hi, a.notes, a.density, a.content_state as state, p.lo as p_lo, p.density as p_density, p.content_state as p_state,
    b.idx as b_idx, b.lo as b_lo, b.hi as b_hi, b.notes as b_notes, b.density as b_density, b.content_state as b_state, b.harmony_refs as b_harmony, b.melody_refs as b_melody,
    c.idx as c_idx, c.lo as c_lo, c.hi as c_hi, c.notes as c_notes, c.activity as c_activity, c.content_state as c_state, c.harmony_refs as c_harmony, c.melody_refs as c_melody
  from r a left join r p on p.perf = a.perf and p.kind = a.kind and p.idx = a.idx - 1 left join r b on b.perf = a.perf and b.kind = a.kind and b.idx = a.idx + 1 left join r c on c.perf = a.perf and c.kind = a.kind and c.idx = a.idx + 2),
to_b as (select *, b_idx as t_idx, b_lo as t_lo, b_hi as t_hi, b_notes as t_notes, b_state as t_state, b_harmony as t_harmony, b_melody as t_melody from w where b_idx is not null),
to_c as (select *, c_idx as t_idx, c_lo as t_lo, c_hi as t_hi, c_notes as t_notes, c_state as t_state, c_harmony as t_harmony, c_melody as t_melody from w where b_idx is not null and c_idx is not null),
made as (
  select to_b.* exclude (lo, hi), 'continuation' as task, case when p_lo is not null and {_COMPATIBLE.format(a="p_state", b="state")} then p_lo else lo end as context_lo, hi as context_hi, 0.54::double as motif,
    case when p_lo is not null and {_COMPATIBLE.format(a="p_state", b="state")} then 'two_window_context' else 'compatible_states' end as note from to_b where kind = 'window' and b_state <> 'silence_or_noise' and {_COMPATIBLE.format(a="state", b="b_state")}
  union all select * exclude (lo, hi), 'phrase_continuation', lo, hi, 0.46, 'segments' from to_b where kind = 'segment'
  union all select * exclude (lo, hi), 'phrase_continuation', p_lo, hi, 0.52, 'density_boundary' from to_b where kind = 'window' and p_lo is not null and (abs(b_density - density) > 0.35::double or abs(density - p_density) > 0.35::double)
  union all select * exclude (lo, hi), 'groove_continuation', lo, hi, 0.56, 'target_state' from to_b where kind = 'window' and b_state in ('rhythm_dominant', 'percussive_only', 'polyphonic_full_mix')
  union all select * exclude (lo, hi), 'harmony_continuation', lo, hi, 0.6, case when b_harmony > 0 then 'harmony_evidence' else 'target_state' end from to_b where kind = 'window' and (b_state in ('harmonic_dominant', 'polyphonic_full_mix') or b_harmony > 0)
  union all select * exclude (lo, hi), 'melody_continuation', lo, hi, 0.58, 'target_state' from to_b where kind = 'window' and b_state in ('melodic_lead', 'vocal_dominant', 'polyphonic_full_mix', 'rap_vocal_dominant')
  union all select * exclude (lo, hi), 'call_response', lo, hi, round(0.58::double + 0.2::double * least(1, abs(b_density - density) / 2), 6), 'density_response' from to_b where kind = 'window' and notes >= 4 and b_notes >= 4 and greatest(notes, b_notes) / least(notes, b_notes)::double <= 3.5
  union all select * exclude (lo, hi) replace (least(b_hi, b_lo + least(12, b_hi - b_lo)) as t_hi), 'section_transition', greatest(lo, hi - least(12, hi - lo)), hi, 0.5, 'sections' from to_b where kind = 'segment'
  union all select * exclude (lo, hi), 'buildup_to_release', lo, b_hi, round(least(1, 0.58::double + 0.2::double * least(1, 0.2::double + c_activity / 4)), 6), 'density_ramp' from to_c where kind = 'window' and b_notes > notes and c_notes < b_notes
  union all select * exclude (lo, hi), 'infill_missing_region', lo, c_hi, 0.52, 'context_on_both_sides' from (select * replace (b_idx as t_idx, b_lo as t_lo, b_hi as t_hi, b_notes as t_notes, b_state as t_state, b_harmony as t_harmony, b_melody as t_melody) from to_c) where kind = 'window' and notes >= 2 and b_notes >= 2 and c_notes >= 2)"""
_CHECKED = f"""judged as (
  select m.*, coalesce(list_contains(string_split(p.states, ','), t_state), false) or (m.task = 'harmony_continuation' and t_harmony > 0) or (m.task = 'melody_continuation' and t_melody > 0 and t_state in {_SOUND})
    or (m.task = 'call_response' and (t_melody > 0 or t_harmony > 0) and t_state in {_SOUND}) as allowed, t_hi - t_lo between least_seconds and most_seconds as fits, t_notes >= least_notes as enough
  from made m left join policies p on p.task = m.task)"""
_EXAMPLE_COLUMNS = """perf, kind, idx, task, context_lo, context_hi, t_idx as target_idx, t_lo as target_lo, t_hi as target_hi, state as context_state, t_state as target_state, notes as context_notes, t_notes as target_notes, motif::double as motif, note, allowed,
  array_to_string(list_filter([case when not allowed then 'task_policy_failed' end, case when not fits then 'duration_out_of_range' end, case when not enough then 'target_too_sparse' end], lambda x: x is not null), ',') as failed, t_notes = 0 as blocked"""


def example_columns(checked: DataFrame) -> DataFrame:
    return checked.select("perf", "kind", "idx", "task", "context_lo", "context_hi", "target_idx", "target_lo", "target_hi", "context_state", "target_state", F.col("own_notes").alias("context_notes"), "target_notes", "motif", "note", "allowed", "failed", "blocked")


@query(with_sql(*_ALL_STATES, _POLICIES, _EXAMPLES, _CHECKED) + f"select {_EXAMPLE_COLUMNS} from judged")
def generation_examples(spark, sf_dir):
    """Examples of nine tasks from windows and segments with their neighbours, and what the tasks' policies say of them."""
    return example_columns(examples.checked(examples.candidates(example_regions(spark, sf_dir), long_form=music.DURATION >= 600)))


@query(with_sql(*_ALL_STATES, _POLICIES, _EXAMPLES, _CHECKED) + """select p.task, count(j.task) as n, count(case when allowed and fits and enough then 1 end) as usable, count(case when not allowed then 1 end) as not_allowed, count(case when not fits then 1 end) as out_of_range, count(distinct perf) as performances
  from policies p left join judged j on j.task = p.task group by p.task""")
def example_task_coverage(spark, sf_dir):
    """Examples by task, tasks without any among them, and which checks they fail."""
    made = generation_examples(spark, sf_dir)
    every = spark.createDataFrame([(p[0],) for p in examples.POLICIES], "task string")
    has = lambda check: F.contains(F.col("failed"), F.lit(check))
    counted = made.groupBy("task").agg(F.count("*").alias("n"), F.count_if(F.col("failed") == "").alias("usable"), F.count_if(has("task_policy_failed")).alias("not_allowed"), F.count_if(has("duration_out_of_range")).alias("out_of_range"), F.count_distinct("perf").alias("performances"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.join(counted, "task", "left").select("task", *[zero(c) for c in ("n", "usable", "not_allowed", "out_of_range", "performances")])


def _renamed(ctes: list[str], names: list[str], prefix: str) -> list[str]:
    """SQL with some of its tables under other names, beside others of the same names."""
    return [re.sub(r"\b(" + "|".join(names) + r")\b", prefix + r"\1", c) for c in ctes]


@query(with_sql(*_ALL_STATES, *_renamed([*BINNED[1:], PULSES, _GRID, _GRAMS], ["located", "gaps", "pulses", "placed"], "b_"), _POLICIES) + f""", places as (select perf, gram, floor(idx * {music.BIN} / {music.WINDOW})::int as idx, count(*) as n from grams where size = 8 group by all),
r as (select perf, idx, lo, hi, notes, content_state, (classes >= 2 and chord > 0)::int as harmony_refs, (movement > 0)::int as melody_refs from states where kind = 'window'),
known as (select p.*, row_number() over (partition by p.perf, gram order by p.idx) as nth, sum(n) over (partition by p.perf, gram) as repeats from places p join r using (perf, idx)),
firsts as (select perf, gram, repeats, min(idx) as idx, max(idx) as t_idx from known where nth <= 2 group by all having count(*) = 2),
limited as (select * from firsts qualify row_number() over (partition by perf order by repeats desc, gram) <= 64),
made as (select l.perf, 'window' as kind, l.idx, a.content_state as state, a.notes, 'motif_transformation' as task, a.lo as context_lo, a.hi as context_hi, l.t_idx, b.lo as t_lo, b.hi as t_hi, b.content_state as t_state, b.notes as t_notes,
  b.harmony_refs as t_harmony, b.melody_refs as t_melody, round(least(0.95, 0.25 + repeats / 6.0::double), 6) as motif, 'motif=' || gram as note from limited l join r a on a.perf = l.perf and a.idx = l.idx join r b on b.perf = l.perf and b.idx = l.t_idx),
{_CHECKED} select {_EXAMPLE_COLUMNS} from judged""")
def motif_examples(spark, sf_dir):
    """Examples from a motif's first window to its second; motifs are the eight-step patterns of the bins."""
    grams = rhythm.motif_ngrams(grids(spark, sf_dir), shortest=8, longest=8)
    window = F.floor(F.col("idx") * music.BIN / music.WINDOW).cast("int")
    places = grams.groupBy("perf", F.col("gram").alias("motif"), window.alias("idx")).agg(F.count("*").alias("n"))
    return example_columns(examples.checked(examples.motif_candidates(places, example_regions(spark, sf_dir))))
