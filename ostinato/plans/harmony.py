"""Queries on harmony and pitch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ostinato.operators import harmony
from ostinato.plans.rhythm import BINNED, WINDOWED, in_bins, in_windows
from ostinato.sources.music import with_sql

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_NAMES = "['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B']"
_COUNTS = "counts as (select perf, kind, idx, note % 12 as pc, count(*) as n from located group by perf, kind, idx, note % 12)"
_CHORDS = f"""hist as (
  select perf, kind, idx, lo, hi, [{", ".join(f"count(case when note % 12 = {i} then 1 end)" for i in range(12))}] as h, min(note) as low, count(*) as n from located group by perf, kind, idx, lo, hi),
tried as (
  select h.*, r.root, k.nth, k.quality, h.h[r.root + 1] + h.h[(r.root + k.a) % 12 + 1] + h.h[(r.root + k.b) % 12 + 1] as score
  from hist h cross join (select unnest(range(0, 12)) as root) r cross join (values (0, 'major', 4, 7), (1, 'minor', 3, 7), (2, 'suspended_or_open', 5, 7)) as k(nth, quality, a, b)),
chords as (
  select perf, kind, idx, lo, hi, quality, root::int as root, round(score / n::double, 6) as confidence, low % 12 as bass, list_filter(range(0, 12), lambda i: h[i + 1] > 0) as active, n
  from tried qualify row_number() over (partition by perf, kind, idx order by score desc, root, nth) = 1)"""


def timeline(spark, sf_dir):
    return harmony.chords(in_bins(spark, sf_dir))


@query(with_sql(*WINDOWED[:-1], _COUNTS) + "select perf, kind, idx, pc::int as pc, n from counts")
def pitch_class_histogram(spark, sf_dir):
    return harmony.pitch_counts(in_windows(spark, sf_dir))


@query(with_sql(*WINDOWED[:-1], _COUNTS) + f""", f as (select e.*, coalesce(c.n, 0) as n from (select *, unnest(range(0, 12)) as pc from (select distinct perf, kind, idx from counts)) e left join counts c on c.perf = e.perf and c.kind = e.kind and c.idx = e.idx and c.pc = e.pc),
r as (select *, row_number() over (partition by perf, kind, idx order by n desc, pc) as rank, round(n / (sum(n) over (partition by perf, kind, idx))::double, 6) as score from f)
select perf, kind, idx, rank::int as rank, {_NAMES}[(pc + 1)::int] as key, score from r where rank <= 3""")
def key_candidates_top3(spark, sf_dir):
    return harmony.key_candidates(harmony.pitch_counts(in_windows(spark, sf_dir)))


@query(with_sql(*BINNED[:-1], _CHORDS) + "select perf, idx, quality, root, confidence, bass::int as bass, array_to_string(active, ' ') as active from chords")
def chord_timeline(spark, sf_dir):
    return timeline(spark, sf_dir).select("perf", "idx", "quality", "root", "confidence", "bass", F.array_join(F.col("active").cast("array<string>"), " ").alias("active"))


@query(with_sql(*BINNED[:-1], _CHORDS) + """, m as (select *, idx // 15 as part, ((lead(root) over (partition by perf, idx // 15 order by idx) - root) % 12 + 12) % 12 as step from chords)
select perf, part, count(*) as chords, count(case when step <> 0 then 1 end) as changes, round(count(case when step = 0 then 1 end) / greatest(1, count(step))::double, 6) as repeated,
  round(count(case when step in (1, 11) then 1 end) / greatest(1, count(step))::double, 6) as chromatic, round(count(case when step in (1, 2, 10, 11) then 1 end) / greatest(1, count(step))::double, 6) as stepwise,
  round(count(case when step in (5, 7) then 1 end) / greatest(1, count(step))::double, 6) as circle, coalesce(string_agg(step::varchar, ' ' order by idx), '') as intervals from m group by perf, part""")
def root_motion_scores(spark, sf_dir):
    return harmony.root_motion(timeline(spark, sf_dir), F.floor(F.col("idx") / 15).cast("int"))


@query(with_sql(*BINNED[:-1], _CHORDS) + """, b as (select perf, idx // 15 as part, bass, count(*) as n from chords group by perf, idx // 15, bass),
r as (select *, round(n / (sum(n) over (partition by perf, part))::double, 6) as dominance, row_number() over (partition by perf, part order by n desc, bass) as rank from b)
select perf, part, bass::int as bass, dominance from r where rank = 1 and dominance >= 0.2""")
def pedal_tones(spark, sf_dir):
    return harmony.pedal_tones(timeline(spark, sf_dir), F.floor(F.col("idx") / 15).cast("int"), least=0.2)


@query(with_sql(*BINNED[:-1], _CHORDS) + f""", g as (select perf, idx, [root, lead(root, 1) over w, lead(root, 2) over w] as g from chords window w as (partition by perf order by idx)),
c as (select perf, array_to_string(list_transform(g, lambda r: {_NAMES}[r + 1]), '-') as roots, count(*) as n, min(idx) as first from g where list_count(g) = 3 group by perf, roots having count(*) >= 2)
select perf, (row_number() over (partition by perf order by n desc, first))::int as rank, roots, n from c qualify rank <= 12""")
def harmony_motion_index(spark, sf_dir):
    return harmony.motion_index(timeline(spark, sf_dir), size=3)


@query(with_sql(*WINDOWED[:-1]) + """, m as (select *, lead(note) over w - note as step, row_number() over w as nth from located window w as (partition by perf, kind, idx order by t, seq))
select perf, kind, idx, count(*) as n, min(note) as lowest, max(note) as highest, round(avg(note), 6) as mean_note,
  round(count(case when abs(step) between 1 and 2 then 1 end) / greatest(1, count(step))::double, 6) as step_share, round(count(case when abs(step) > 2 then 1 end) / greatest(1, count(step))::double, 6) as leap_share,
  round(count(case when abs(step) % 12 in (5, 7) then 1 end) / greatest(1, count(step))::double, 6) as fourth_fifth_share, round(count(case when abs(step) % 12 = 6 then 1 end) / greatest(1, count(step))::double, 6) as tritone_share,
  round(count(case when abs(step) = 1 then 1 end) / greatest(1, count(step))::double, 6) as chromatic_share,
  coalesce(string_agg(case when step > 0 then 'U' when step < 0 then 'D' else 'S' end, '' order by nth) filter (step is not null and nth <= 64), '') as contour from m group by perf, kind, idx""")
def pitch_slice_stats(spark, sf_dir):
    return harmony.pitch_slices(in_windows(spark, sf_dir))


_HAS = "list_bool_or(list_transform(active, lambda r: list_contains(active, (r + {}) % 12) and list_contains(active, (r + {}) % 12)))"


@query(with_sql(*BINNED[:-1], _CHORDS) + f"""select perf, kind, idx, case when len(active) <= 1 then 'single_pitch_or_drone_candidate'
  when len(active) >= 5 and list_min(list_transform(range(1, len(active)), lambda i: active[i + 1] - active[i])) <= 2 then 'cluster_sonority_candidate'
  when {_HAS.format(4, 7)} or {_HAS.format(3, 7)} then 'triadic_sonority_candidate' when {_HAS.format(5, 10)} then 'quartal_sonority_candidate'
  when len(active) >= 6 then 'extended_or_color_sonority_candidate' else 'ambiguous_or_nonfunctional_sonority_candidate' end as sonority,
  len(active)::int as classes, array_to_string(list_transform(active, lambda r: {_NAMES}[(r + 1)::int]), ' ') as active from chords""")
def sonority_type(spark, sf_dir):
    return harmony.sonorities(timeline(spark, sf_dir))


_SLICES = f"""moved as (select *, row_number() over w as nth, lead(note) over w - note as step, lead(note, 2) over w - note as upper, lead(note, 3) over w - lead(note) over w as lower, round(lead(t) over w - t, 4) as gap from located window w as (partition by perf, kind, idx order by t, seq)),
facts as (select perf, kind, idx, lo, hi, count(*) as n, greatest(1, count(step)) as steps, min(note) as lowest, max(note) as highest, count(case when note < 48 then 1 end) as low, count(case when note >= 48 and note < 72 then 1 end) as mid, count(case when note >= 72 then 1 end) as high,
  [{", ".join(f"count(case when note % 12 = {i} then 1 end)" for i in range(12))}] as pcs, avg(vel) as vel, count(case when abs(step) <= 2 then 1 end) as small, count(case when abs(step) % 12 in (5, 7) then 1 end) as fifths, count(case when abs(step) % 12 = 6 then 1 end) as tritones,
  count(case when abs(step) = 1 then 1 end) as semitones, count(case when step <> 0 and least(abs(step) % 12, 12 - abs(step) % 12) <= 2 then 1 end) as seconds, count(case when nth <= 64 and step > 0 then 1 end) as ups, count(case when nth <= 64 and step < 0 then 1 end) as downs,
  count(case when nth <= 64 and step = 0 then 1 end) as statics, arg_max(note % 12, nth) as last, count(case when step % 12 = 0 then 1 end) as common_tones, coalesce(sum(abs(step)), 0)::double as motion, count(case when (step % 12 + 12) % 12 in (1, 2, 10, 11) then 1 end) as stepwise,
  count(case when nth % 2 = 1 and lower is not null then 1 end) as pairs, count(case when nth % 2 = 1 and upper * lower < 0 then 1 end) as against, count(case when gap > 0 then 1 end) as n_ioi, count(distinct case when gap > 0 then gap end) as iois, count(distinct note) as notes
  from moved group by perf, kind, idx, lo, hi),
judged as (select *, case when n < 8 then least(0.45::double, least(0.95::double, 0.25::double + n / 120.0::double)) else least(0.95::double, 0.25::double + n / 120.0::double) end as c, list_position(pcs, list_max(pcs)) - 1 as center_at, list_max(pcs) / n::double as share,
  case when n >= 6 and pairs > 0 then against / pairs::double else 0 end as contrary_, list_filter(range(0, 12), lambda i: pcs[i + 1] > 0) as active from facts),
slices as (select perf, kind, idx, round(c, 6) as confidence, lowest, highest, low, mid, high, array_to_string(pcs, ' ') as pitch_classes, {_NAMES}[(center_at + 1)::int] as center, round(share, 6) as center_share, round(vel, 6) as mean_velocity,
  round(small / steps::double, 6) as small_share, round(fifths / steps::double, 6) as fourth_fifth_share, round(tritones / steps::double, 6) as tritone_share, round(semitones / steps::double, 6) as chromatic_share, round(seconds / steps::double, 6) as cluster_share,
  ups, downs, statics, case when ups > downs then 'ascending_tendency_candidate' else 'descending_or_balanced_candidate' end as contour_shape, round(abs(ups - downs) / greatest(1, ups + downs + statics)::double, 6) as contour_score,
  last = center_at as arrival, case when last = center_at then round(least(0.92::double, 0.45::double + share), 6) end as arrival_confidence,
  case when len(active) <= 1 then 'single_pitch_or_drone_candidate' when len(active) >= 5 and list_min(list_transform(range(1, len(active)), lambda i: active[i + 1] - active[i])) <= 2 then 'cluster_sonority_candidate'
    when {_HAS.format(4, 7)} or {_HAS.format(3, 7)} then 'triadic_sonority_candidate' when {_HAS.format(5, 10)} then 'quartal_sonority_candidate' when len(active) >= 6 then 'extended_or_color_sonority_candidate' else 'ambiguous_or_nonfunctional_sonority_candidate' end as sonority,
  highest - lowest as voicing_span, {_NAMES}[(center_at + 1)::int] || '_centered_candidate' as chord_label, round(least(0.78::double, c * 0.85::double), 6) as chord_confidence, case when seconds >= 3 then 'cluster_color_candidate' else 'non_cluster_candidate' end as color, notes >= 5 as extended,
  common_tones, round(motion / steps, 6) as mean_motion, round(stepwise / steps::double, 6) as stepwise_share, case when last = center_at then round(least(0.7::double, c * 0.8::double), 6) end as cadence_confidence,
  greatest(1, least(6, round_even(n / greatest(1, hi - lo) * 0.6::double, 0)::int)) as voices, round(contrary_, 6) as contrary, round(greatest(0, 1 - contrary_), 6) as parallel, case when n_ioi >= 3 then round(least(0.65::double, 0.25::double + n_ioi / 30.0::double), 6) end as response_confidence,
  round(least(1, iois / 6.0::double), 6) as rhythm_independence, round(least(1, notes / 12.0::double), 6) as pitch_independence, round(least(c, 0.72::double), 6) as tuning_confidence from judged)"""


@query(with_sql(*WINDOWED[:-1], _SLICES) + "select * from slices")
def pitch_harmony_records(spark, sf_dir):
    """The seven kinds of pitch and harmony records of each window, side by side."""
    return harmony.pitch_harmony(in_windows(spark, sf_dir))


@query(with_sql(*BINNED[:-1], _SLICES) + """, k as (select perf, sonority, count(*) as n from slices group by perf, sonority),
f as (select perf, string_agg(sonority || ':' || n, ' ' order by n desc, sonority) as families from k group by perf),
w as (select perf, round(sum(round(confidence * 1e9::double)::bigint)::double / count(*) / 1e9::double, 6) as confidence, count(*) as regions, round(count(case when cluster_share > 0.2 then 1 end) / count(*)::double, 6) as cluster_regions, count(case when arrival then 1 end) as arrivals from slices group by perf)
select w.*, least(0.8::double, confidence) as tonal_center, round(greatest(0.2::double, 1 - confidence), 6) as no_clear_center, families from w join f using (perf)""")
def pitch_harmony_macro(spark, sf_dir):
    """What the records of a performance's bins say of the whole."""
    return harmony.pitch_harmony_macro(harmony.pitch_harmony(in_bins(spark, sf_dir)))


def _motion(spark, sf_dir):
    return harmony.root_motion(timeline(spark, sf_dir), F.floor(F.col("idx") / 15).cast("int"))


@query(f"""with m as ({ORACLES['root_motion_scores']})
select perf, 'vamp' as listing, (row_number() over (partition by perf order by part))::int as rank, part, changes, repeated from m where repeated >= 0.5 qualify rank <= 20
union all select perf, 'static', (row_number() over (partition by perf order by changes, part))::int as rank, part, changes, repeated from m qualify rank <= 10
union all select perf, 'active', (row_number() over (partition by perf order by changes desc, part))::int as rank, part, changes, repeated from m qualify rank <= 10""")
def harmony_regions(spark, sf_dir):
    """Vamps, and the parts of a performance whose harmony moves least and most."""
    return harmony.motion_regions(_motion(spark, sf_dir))


@query(f"""with m as ({ORACLES['root_motion_scores']}), k as (select perf, array_to_string(string_split(intervals, ' ')[1:4], '-') as sequence, count(*) as n, min(part) as first from m where intervals <> '' group by 1, 2 having count(*) >= 2)
select perf, (row_number() over (partition by perf order by n desc, first, sequence))::int as rank, sequence, n from k qualify rank <= 12""")
def repeated_root_sequences(spark, sf_dir):
    return harmony.root_sequences(_motion(spark, sf_dir))


@query(f"""with m as ({ORACLES['root_motion_scores']}), s as (select perf, part, unnest(string_split(intervals, ' '))::int as step, unnest(range(1, len(string_split(intervals, ' ')) + 1)) as place from m where intervals <> ''),
c as (select perf, step, count(*) as n, min((part, place)) as first from s group by perf, step)
select perf, (row_number() over (partition by perf order by n desc, first))::int as rank, step, n from c qualify rank <= 5""")
def root_intervals_top5(spark, sf_dir):
    return harmony.common_intervals(_motion(spark, sf_dir))


@query(with_sql(*BINNED[:-1], _CHORDS) + """, f as (select perf, idx, lo, hi, root, quality, (idx - 1 is not distinct from lag(idx) over w and root is not distinct from lag(root) over w and quality is not distinct from lag(quality) over w) as goes_on from chords window w as (partition by perf order by idx)),
r as (select *, sum(case when goes_on then 0 else 1 end) over (partition by perf order by idx) as run from f)
select perf, run::bigint as run, min(idx)::int as first, max(idx)::int as last, count(*) as bins, root, quality, min(lo) as lo, max(hi) as hi from r group by perf, run, root, quality""")
def chord_runs(spark, sf_dir):
    """Stretches of consecutive bins with one chord."""
    return harmony.chord_runs(timeline(spark, sf_dir))
