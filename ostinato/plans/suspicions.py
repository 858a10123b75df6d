"""Queries on what routing of all four granularities may have got wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.operators import routing
from ostinato.plans.granularities import _ALL_STATES, content_regions
from ostinato.plans.records import _POLICY
from ostinato.sources.music import with_sql

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def routes(spark, sf_dir) -> DataFrame:
    return content_regions(spark, sf_dir).select("perf", F.concat_ws(":", "perf", "kind", "idx").alias("route_id"), "kind_order", "idx", "content_state", F.round("harmony", 6).alias("harmony"), "chord", "classes", "density", "poly")


@query(with_sql(*_ALL_STATES, _POLICY) + "select perf, content_state, label, count(*) as n from (select s.perf, s.content_state, unnest(string_split(suppressed, ',')) as label from states s join policy p on p.content_state = s.content_state where suppressed <> '') group by all")
def suppressed_labels_by_state(spark, sf_dir):
    return routing.suppressed_by_state(routes(spark, sf_dir))


_MEAN = "round(sum(round({0} * 1e9::double)::bigint)::double / count({0}) / 1e9::double, 6)"


@query(with_sql(*_ALL_STATES) + f"select perf, content_state, count(*) as n, {_MEAN.format('density')} as mean_density, {_MEAN.format('classes')} as mean_classes, {_MEAN.format('chord')} as mean_chord, {_MEAN.format('poly')} as mean_poly from states group by perf, content_state")
def state_metrics(spark, sf_dir):
    return routing.state_metrics(routes(spark, sf_dir))


@query(with_sql(*_ALL_STATES, _POLICY) + """, r as (select s.perf, s.perf || ':' || kind || ':' || idx as route_id, kind_order, idx, s.content_state, round(harmony, 6) as harmony, chord, classes, list_contains(string_split(suppressed, ','), 'chord_movement') as held from states s join policy p on p.content_state = s.content_state),
f as (select *, 'harmonic_not_classified' as suspicion, row_number() over (partition by perf order by harmony desc, chord desc, classes desc, kind_order, idx) as rank from r where (harmony >= 0.58::double or chord >= 0.58::double or classes >= 5) and content_state not in ('harmonic_dominant', 'polyphonic_full_mix', 'melodic_lead')
  union all select *, 'false_suppression', row_number() over (partition by perf order by kind_order, idx) from r where held and (harmony >= 0.62::double or chord >= 0.62::double))
select perf, suspicion, rank::int as rank, route_id, content_state, harmony, chord, classes from f where rank <= 100""")
def routing_suspects(spark, sf_dir):
    """Routes of each performance whose evidence speaks against their state or against what it rules out."""
    return routing.suspects(routes(spark, sf_dir))
