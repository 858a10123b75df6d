"""Queries on whole training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.functions.scalars import pitch_class_name
from ostinato.operators import harmony, records, rhythm, training_records
from ostinato.plans import harmony as harmony_plans
from ostinato.plans import records as record_plans
from ostinato.plans import rhythm as rhythm_plans
from ostinato.plans.granularities import _ALL_STATES, content_regions
from ostinato.plans.rhythm import in_windows
from ostinato.sources import music, scratch
from ostinato.sources.music import with_sql

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _named(kind: Column, width: Column) -> Column:
    """The window that a bin or window names; each fourth names none, a planted gap."""
    window = F.floor(F.col("idx") * width / music.WINDOW)
    return F.when(kind.isin("window", "bin") & (F.col("idx") % 4 != 3), F.concat_ws(":", F.col("perf"), window))


def _timed(rows: DataFrame, width: float) -> DataFrame:
    return rows.withColumns({"seq": F.col("idx"), "lo": (F.col("idx") * width).cast("double"), "hi": F.least(F.lit(music.DURATION), (F.col("idx") + 1) * width)})


def record_parts(spark, sf_dir) -> tuple[DataFrame, ...]:
    """Regions of all granularities, chords of bins and keys of windows, sounds of bins, meters of windows, sections, tags of windows.

    What several joins read is written once.
    """
    regions = content_regions(spark, sf_dir).select("perf", F.concat_ws(":", "perf", "kind", "idx").alias("record_id"), _named(F.col("kind"), F.when(F.col("kind") == "bin", music.BIN).otherwise(music.WINDOW)).alias("window_id"), F.col("kind").alias("granularity"), "lo", "hi", "notes", "density", "confidence")
    bins = scratch.written(harmony_plans.timeline(spark, sf_dir), "chords")
    windows = in_windows(spark, sf_dir)
    of = lambda rows, kind, width, order: rows.select("perf", _named(F.lit(kind), F.lit(width)).alias("window_id"), F.lit(kind).alias("granularity"), (F.lit(order) + F.col("idx")).alias("seq"), "key", "mode", "score")
    chords = bins.select("perf", "idx", pitch_class_name(F.col("root")).alias("key"), F.col("quality").alias("mode"), F.col("confidence").alias("score"))
    keys = harmony.key_candidates(harmony.pitch_counts(windows), k=1).withColumn("mode", F.lit(None).cast("string"))
    harmonies = of(keys, "window", music.WINDOW, 0).unionByName(of(chords, "bin", music.BIN, 100_000))
    gaps = scratch.written(rhythm.with_gaps(windows), "gaps")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "meter"))), lambda x: x["meter"]), ",")
    hypotheses = rhythm.meter_hypotheses(gaps).where("rank <= 3").groupBy("perf", "idx").agg(listed.alias("candidates"), F.max(F.when(F.col("rank") == 1, F.col("ambiguity"))).alias("ambiguity"))
    meters = rhythm.subdivisions(gaps).select("perf", "idx", "subdivision", "grid_confidence").join(rhythm.pulse_stability(gaps).select("perf", "idx", "pulse_stability"), ["perf", "idx"]).join(hypotheses, ["perf", "idx"], "left")
    tags = records.tagged(rhythm.rhythm_vector(windows)).select("perf", "idx", F.concat_ws(":", "perf", "idx", "tag").alias("tag_id"), _named(F.lit("window"), F.lit(music.WINDOW)).alias("window_id"), F.lit("window").alias("granularity"), "tag", F.col("tag_confidence").alias("sure"))
    tags = _timed(tags, music.WINDOW).drop("seq", "idx").withColumnRenamed("tag_id", "seq")
    sounds = _timed(harmony.sonorities(bins).select("perf", "idx", "sonority"), music.BIN)
    sections = _timed(rhythm_plans.macro_section(spark, sf_dir).select("perf", "idx", "section"), music.SEGMENT)
    return tuple(scratch.written(d, "part") for d in (regions, harmonies, sounds, _timed(meters, music.WINDOW), sections, tags))


_W = f"{music.WINDOW}::double"
_FULL = [
    f"""r as (select perf || ':' || kind || ':' || idx as record_id, perf, case when kind in ('window', 'bin') and idx % 4 <> 3 then perf || ':' || floor(lo / {_W})::int end as window_id, kind, lo, hi, notes, density, confidence from states)""",
    f"""h as (select perf, case when idx % 4 <> 3 then perf || ':' || idx end as window_id, 'window' as kind, idx as seq, key, null as mode, score from ({harmony_plans.ORACLES["key_candidates_top3"]}) where rank = 1
  union all select perf, case when idx % 4 <> 3 then perf || ':' || floor(idx * {music.BIN} / {_W})::int end, 'bin', 100000 + idx, {harmony_plans._NAMES}[(root + 1)::int], quality, confidence from ({harmony_plans.ORACLES["chord_timeline"]}))""",
    "rh as (select r.record_id, h.key, h.mode, h.score from r left join h on h.perf = r.perf and h.window_id is not distinct from r.window_id qualify row_number() over (partition by r.record_id order by (h.kind = r.kind)::int desc nulls last, h.seq) = 1)",
    f"""so as (select perf, idx, idx * {music.BIN} as lo, least({music.DURATION}, (idx + 1) * {music.BIN}) as hi, sonority from ({harmony_plans.ORACLES["sonority_type"]}))""",
    "rs as (select record_id, sonority from r left join so on so.perf = r.perf qualify row_number() over (partition by record_id order by (so.hi >= r.lo and so.lo <= r.hi)::int desc, so.idx) = 1)",
    f"""me as (select s.perf, s.idx, s.idx * {_W} as lo, (s.idx + 1) * {_W} as hi, subdivision, grid_confidence, pulse_stability, m.meters, m.ambiguity from ({rhythm_plans.ORACLES["subdivision_type"]}) s join ({rhythm_plans.ORACLES["pulse_stability"]}) p on p.perf = s.perf and p.idx = s.idx
  left join (select perf, idx, string_agg(meter, ',' order by rank) as meters, max(case when rank = 1 then ambiguity end) as ambiguity from ({rhythm_plans.ORACLES["meter_hypotheses"]}) where rank <= 3 group by perf, idx) m on m.perf = s.perf and m.idx = s.idx)""",
    "rm as (select record_id, subdivision, grid_confidence, pulse_stability, meters, ambiguity from r left join me on me.perf = r.perf qualify row_number() over (partition by record_id order by greatest(0, least(me.hi, r.hi) - greatest(me.lo, r.lo)) desc, me.idx) = 1)",
    f"""se as (select perf, idx, idx * {music.SEGMENT} as lo, least({music.DURATION}, (idx + 1) * {music.SEGMENT}) as hi, section from ({rhythm_plans.ORACLES["macro_section"]}))""",
    "rx as (select record_id, section from r left join se on se.perf = r.perf qualify row_number() over (partition by record_id order by greatest(0, least(se.hi, r.hi) - greatest(se.lo, r.lo)) desc, se.idx) = 1)",
    f"""tg as (select perf, perf || ':' || idx || ':' || tag as seq, case when idx % 4 <> 3 then perf || ':' || idx end as window_id, idx * {_W} as lo, (idx + 1) * {_W} as hi, tag, tag_confidence as sure from ({record_plans.ORACLES["tags"]}))""",
    "rt as (select record_id, string_agg(tag, ',' order by nth) as top_tags, min(sure) as least_sure from (select record_id, tag, sure, row_number() over (partition by record_id order by sure desc, seq) as nth from r join tg on tg.perf = r.perf and r.kind = 'window' and tg.window_id is not distinct from r.window_id and tg.hi >= r.lo and tg.lo <= r.hi) where nth <= 5 group by record_id)",
    """full_records as (select r.record_id, r.perf, r.window_id, r.kind as granularity, r.lo, r.hi, r.hi - r.lo as duration, r.notes, round(r.density, 6) as density, key, mode, score as harmony_score, sonority, subdivision, grid_confidence, pulse_stability, meters, ambiguity as meter_ambiguity, section,
  coalesce(top_tags, '') as top_tags, case when least_sure < 0.45::double then 'needs_review' else 'feature_ready' end as label, case when r.kind = 'bin' then 'weak_label' else 'heuristic_estimate' end as label_status, round(least(r.confidence, coalesce(score, 0)), 6) as confidence
  from r join rh using (record_id) join rs using (record_id) join rm using (record_id) join rx using (record_id) left join rt using (record_id))""",
]


@query(with_sql(*_ALL_STATES, *_FULL) + "select * from full_records")
def ai_records_full(spark, sf_dir):
    """Training records of all granularities with their harmony, sound, meter, section and tags."""
    return training_records.built(*record_parts(spark, sf_dir), music.WINDOW)


@query(with_sql(*_ALL_STATES, *_FULL) + "select granularity, label, label_status, count(*) as n, count(key) as with_harmony, count(meters) as with_meters, count(case when confidence < 0.35 then 1 end) as unsure from full_records group by all")
def ai_record_label_counts(spark, sf_dir):
    """Whole records by granularity and label, and how many miss harmony or meters."""
    return ai_records_full(spark, sf_dir).groupBy("granularity", "label", "label_status").agg(F.count("*").alias("n"), F.count("key").alias("with_harmony"), F.count("meters").alias("with_meters"), F.count_if(F.col("confidence") < 0.35).alias("unsure"))
