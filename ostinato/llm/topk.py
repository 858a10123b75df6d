"""Exact top-k inner products by pivot-table elimination.

Each vector's distances to the pivots are computed once and kept beside it: the pivot table. By the triangle inequality the largest
difference of two vectors' distances to a pivot bounds their own distance from below, and so their inner product from above.
Queries meet candidates in blocks; in a block a query evaluates candidates in the order of their bounds and stops when no bound
reaches its k-th best score. Products are of whole numbers, in doubles only where those are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ostinato.llm.common import cut, map_arrow, require

SCALE, TOP, PIVOTS = 1024, 10, 32
QUERY_BLOCK, BLOCK, CHUNK = 2_048, 8_192, 256


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): v is floor(scale * x) of each component. Vectors that are null or hold nulls, NaN or infinities are left out."""
    require(vectors, id_col, vector_col)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    given = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    return given.where(F.col("x").isNotNull() & F.forall("x", finite)).select("vec_id", F.transform("x", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def pivot_table(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(vec_id, v) with dim and to_pivots, the distances to the pivots of the same dimension; pivots: a bounded number of vectors."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes).tolist():
            own = batch.filter(pa.array(sizes == dim))
            x, p = _matrix(own.column(1), dim).astype(np.float64), pivots.get(dim, np.empty((0, dim)))
            distances = np.sqrt(np.maximum(((x[:, None, :] - p[None, :, :]) ** 2).sum(axis=2), 0)) if len(p) else np.empty((len(x), 0))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(len(x), dim, np.int32)), pa.array(list(distances), pa.list_(pa.float64()))], ["vec_id", "v", "dim", "to_pivots"])

    id_type = vectors.schema["vec_id"].dataType.simpleString()
    return map_arrow(vectors.select("vec_id", "v"), run, f"vec_id {id_type}, v array<long>, dim int, to_pivots array<double>")


def best_of_block(own: np.ndarray, q: np.ndarray, q_to: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, x_to: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the query, ids, scores) of each query's k best candidates in one block: exact, ties to the smaller id.

    own, rows: numbers of the queries' and of the candidates' rows; a query's own row is no candidate.
    """
    q_norm, x_norm = np.sqrt((q.astype(np.float64) ** 2).sum(1)), np.sqrt((x.astype(np.float64) ** 2).sum(1))
    small = q_norm.max(initial=0) * x_norm.max(initial=0) < 2**52
    qs, xs = (q.astype(np.float64), x.astype(np.float64)) if small else (q.astype(object), x.astype(object))
    for i in range(len(q)):
        bound = q_norm[i] * x_norm
        if q_to.shape[1]:
            apart = np.abs(x_to - q_to[i]).max(axis=1)
            bound = np.minimum(bound, (q_norm[i] ** 2 + x_norm**2 - apart**2) / 2)
        bound = bound + 1e-6 * (1 + q_norm[i] ** 2 + x_norm**2)  # rounding never lowers a bound
        bound[rows == own[i]] = -np.inf
        order = np.argsort(-bound, kind="stable")
        order = order[: np.count_nonzero(bound > -np.inf)]
        best_ids, best = np.empty(0, ids.dtype), np.empty(0, np.int64)
        for at in range(0, len(order), CHUNK):
            part = order[at : at + CHUNK]
            if len(best) == k and bound[part[0]] < best[-1]:
                break
            scores = (xs[part] @ qs[i]).astype(np.int64)
            best_ids, best = np.r_[best_ids, ids[part]], np.r_[best, scores]
            first = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[first], best[first]
        yield i, best_ids, best


def top_k(vectors: DataFrame, is_query, k: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, n_pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``is_query`` (a condition on vec_id) the k best others by inner product.

    Ties go to the smaller id; fewer others give fewer rows. Vectors of different lengths don't meet. Every row but the query's own is a
    candidate, also one with the query's id; each row of a repeated id asks for itself. Null ids take no part. Unusable vectors (see
    whole_vectors) take no part. An empty table gives no rows. Extra columns are not read. Scores over 63 bits are an error.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, id_col, vector_col, scale).where("vec_id is not null")
    # Pivots: the vectors with the least id hashes, a fixed number, come to the driver.
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).collect()
    pivots: dict[int, list] = {}
    for r in picked:
        pivots.setdefault(len(r["v"]), []).append(r["v"])
    known = pivot_table(rows, {d: np.array(v, np.float64).reshape(-1, d) for d, v in pivots.items()})
    known = cut(known.withColumn("row", F.monotonically_increasing_id()), "pivots")
    asked = known.where(is_query).withColumn("asker", F.col("row"))
    blocks, query_blocks = max(1, -(-known.count() // BLOCK)), max(1, -(-asked.count() // QUERY_BLOCK))
    # Which block a row is in changes nothing in the result.
    left = asked.withColumn("qb", F.pmod(F.xxhash64("row"), F.lit(query_blocks))).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = known.withColumn("cb", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).withColumn("qb", F.col("qb").cast("long"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if a.num_rows and b.num_rows:
            dim = a.column("dim")[0].as_py()
            own, askers = a.column("vec_id").to_numpy(), a.column("row").to_numpy()
            rows, ids = b.column("row").to_numpy(), b.column("vec_id").to_numpy()
            parts = [_matrix(t.column(c), d) for t in (a, b) for c, d in (("v", dim), ("to_pivots", len(pivots.get(dim, []))))]
            for i, found, scores in best_of_block(askers, parts[0], parts[1], rows, ids, parts[2], parts[3], k):
                out.append((askers[i], own[i], found, scores))
        n = [len(x[2]) for x in out]
        return pa.table({
            "asker": pa.array(np.repeat(np.array([x[0] for x in out], np.int64), n)),
            "query_id": pa.array(np.repeat(np.array([x[1] for x in out], np.int64), n)),
            "vec_id": pa.array(np.concatenate([x[2] for x in out]) if out else np.empty(0, np.int64), pa.int64()),
            "score": pa.array(np.concatenate([x[3] for x in out]) if out else np.empty(0, np.int64), pa.int64()),
        })

    keys = ["qb", "cb", "dim"]
    met = left.select("vec_id", "v", "to_pivots", "row", *keys).groupBy(*keys).cogroup(right.select("vec_id", "v", "to_pivots", "row", *keys).groupBy(*keys))
    found = met.applyInArrow(run, "asker long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("asker", "query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
