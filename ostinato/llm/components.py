"""Connected components of a graph whose edges are rows: alternating large-star and small-star rounds.

Only numbers of rows come to the driver. Each round is written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.llm.common import cut, drop_cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node tells its larger neighbours the least node that it knows."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node tells itself and its smaller neighbours the least of them. All edges run from u down to v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return (
        edges.join(least, "u")
        .where("v <> m")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .distinct()
    )


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(u, v) of any ordered type -> (node, root): the least node of its component, for every node with an edge.

    Nulls and loops are dropped; repeated edges count once; no edges give an empty table. A star of any size costs one row for
    each of its edges and round, since the minimum over a node's neighbours is pre-aggregated and Spark splits skewed joins.
    """
    now = cut(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    state = None
    for _ in range(max_rounds):
        # Counts and hash sums tell whether a round has changed any edge.
        new_state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if new_state == state or new_state["n"] == 0:
            break
        state = new_state
        after = cut(_small_star(_large_star(now)), "edges")
        drop_cut(now)
        now = after
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
