"""Near-duplicate vectors by a subspace pigeonhole join.

Two unit vectors with cosine c lie 2 - 2c apart (squared). A seeded rotation spreads that over all directions, and the rotated vectors are
split into blocks of BLOCK_DIMS dimensions. Each block has the share of the squared distance that its dimensions are of all; two vectors
within the whole are within the share of at least one block, or the shares would sum to more. So each block is range-joined under its own
share: its space is cut into boxes by a tree of medians, a vector has its home in one box and visits those that its ball touches, and
meets the homes there. Candidates of any block are verified by their cosine in double precision; none of the links is lost.

Equal vectors are one class with a count and never meet in pairs. A box with many vectors is dealt out in parts. Links don't become rows: a
task returns, per vector, how many it found and one edge to the root of its local component. A pair counts in the first block whose
share holds it, so the tasks' numbers add up.

The fit is bounded: SAMPLE vectors, those of least hash, place the medians; any medians give the same result. Random vectors without
near copies are the worst case: their boxes touch most balls once there are many of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.llm.common import cut, drop_cut, map_arrow, require
from ostinato.llm.components import connected_components

BLOCK_DIMS, SAMPLE, BOX, STRIP, MOST_BOXES = 8, 4_096, 12_288, 128, 1_024
#: Rounding never excludes a candidate.
SLACK = 1e-9


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random rotation, the same for a dimension whenever it is asked for."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def block_edges(dim: int, width: int = BLOCK_DIMS) -> list[int]:
    """Where the blocks begin and end: equal parts of about ``width`` dimensions."""
    return np.linspace(0, dim, max(1, dim // width) + 1).round().astype(int).tolist()


def rotated(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in rotated axes; scaled first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (scaled / np.sqrt((scaled**2).sum(1, keepdims=True))) @ rotation(vectors.shape[1])


def median_tree(points: np.ndarray, boxes: int):
    """Nested (axis, place, left, right) of a sample of one block, halved along its widest axis into about ``boxes`` leaves: None."""
    if boxes < 2 or len(points) < 2 or (points == points[0]).all():
        return None
    axis = int(np.argmax(np.ptp(points, axis=0)))
    place = float(np.median(points[:, axis]))
    low = points[:, axis] <= place
    if low.all():
        low = points[:, axis] < place
        place = float(points[low, axis].max())
    return axis, place, median_tree(points[low], boxes // 2), median_tree(points[~low], boxes - boxes // 2)


def boxes_touched(tree, points: np.ndarray, squared: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, box, home) of the box that each point lies in, and of the boxes after it that come within the distance of it.

    A pair in two boxes meets once, in the later of them.
    """
    found: list[tuple] = []

    def visit(node, rows: np.ndarray, away: np.ndarray, first: int) -> int:
        if node is None:
            found.append((rows, np.full(len(rows), first), (away == 0).all(1)))
            return first + 1
        axis, place, left, right = node
        side = points[rows, axis] - place
        # Distances to a box add up over the axes; a deeper cut along an axis is farther away.
        other = np.where(side <= 0, -side, 0)
        off = away.copy()
        off[:, axis] = np.maximum(off[:, axis], other)
        near = (off**2).sum(1) <= squared + SLACK
        # What lies on a cut has its home to the left, so it is a visitor on the right at whatever small distance.
        off[(side <= 0), axis] = np.maximum(off[side <= 0, axis], 1e-300)
        stay = (side <= 0) | ~(away == 0).all(1)
        back = away.copy()
        back[:, axis] = np.maximum(back[:, axis], np.where(side > 0, side, 0))
        inside = (back**2).sum(1) <= squared + SLACK
        n = visit(left, rows[stay & inside], back[stay & inside], first)
        return visit(right, rows[near], off[near], n)

    visit(tree, np.arange(len(points)), np.zeros(points.shape), 0)
    return tuple(np.concatenate(x) for x in zip(*found))


def usable(vector_col: str) -> Column:
    """Whether a vector isn't null or empty, has only finite components and one that isn't zero; never null."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector_col, finite) & F.exists(vector_col, lambda x: x != 0), F.lit(False))


def _rows(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(np.float64)


def _route(classes: DataFrame, trees: dict[int, list], distance: float, parts: dict | None) -> DataFrame:
    """classes(class, copies, v) -> (dim, block, box, home), with ``parts`` also (left, right) and the class itself, once for each meeting."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes).tolist():
            own = batch.filter(pa.array(sizes == dim))
            turned, ids = rotated(_rows(own.column(2), dim)), own.column(0).to_numpy()
            edges = block_edges(dim)
            for b, (start, end) in enumerate(zip(edges, edges[1:])):
                row, box, home = boxes_touched(trees[dim][b], turned[:, start:end], distance * (end - start) / dim)
                keys = [np.full(len(row), dim), np.full(len(row), b), box]
                names = ["dim", "block", "box"]
                if parts is None:
                    yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int32()) for k in keys), pa.array(home)], [*names, "home"])
                    continue
                # The members of a box are dealt into parts: homes stand on the right, homes and visitors ask on the left.
                n_left, n_right = (np.array([parts[dim, b, x][k] for x in box.tolist()], np.int64) for k in (0, 1))
                mixed = (ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                left, right = (mixed % n_left.astype(np.uint64)).astype(np.int64), (mixed % n_right.astype(np.uint64)).astype(np.int64)
                for asks, who in ((True, np.arange(len(row))), (False, np.flatnonzero(home))):
                    times = (n_right if asks else n_left)[who]
                    at = np.repeat(who, times)
                    nth = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                    l, r = (left[at], nth) if asks else (nth, right[at])
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(k[at], pa.int32()) for k in keys), pa.array(l, pa.int32()), pa.array(r, pa.int32()), pa.array(np.full(len(at), asks)), pa.array(home[at]), *(own.column(c).take(pa.array(row[at])) for c in range(3))],
                        [*names, "left", "right", "asks", "home", "class", "copies", "v"],
                    )

    v = classes.schema["v"].dataType.simpleString()
    schema = "dim int, block int, box int, " + ("home boolean" if parts is None else f"left int, right int, asks boolean, home boolean, class long, copies long, v {v}")
    return map_arrow(classes.select("class", "copies", "v"), run, schema)


class _Union:
    """Components of some thousand nodes, joined by whole arrays of edges; labels only fall."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            a, b = self.label[u], self.label[v]
            apart = a != b
            if not apart.any():
                return
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                down = self.label[self.label]
                if (down == self.label).all():
                    break
                self.label = down


def links_in_box(asking: dict, members: dict, block: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, links, root) of the classes that link here; asking, members: arrays ``id``, ``copies``, ``v``, and ``home`` of the askers.

    A home asks only members with larger ids, a visitor all; a pair that an earlier block finds too isn't counted here.
    """
    dim = members["v"].shape[1]
    edges, whole = block_edges(dim), 2 - 2 * least
    shares = [whole * (e - s) / dim for s, e in zip(edges, edges[1:])]
    ids = np.unique(np.r_[asking["id"], members["id"]])
    at_a, at_m = np.searchsorted(ids, asking["id"]), np.searchsorted(ids, members["id"])
    turned_a, turned_m = rotated(asking["v"]), rotated(members["v"])
    own = slice(edges[block], edges[block + 1])
    coarse_m = turned_m[:, own].astype(np.float32)
    square_m = (coarse_m**2).sum(1)
    unit_a, unit_m = (x / np.abs(x).max(axis=1, keepdims=True) for x in (asking["v"], members["v"]))
    norm_a, norm_m = np.sqrt((unit_a**2).sum(1)), np.sqrt((unit_m**2).sum(1))
    links, union = np.zeros(len(ids), np.int64), _Union(len(ids))
    for start in range(0, len(asking["id"]), STRIP):
        rows = slice(start, start + STRIP)
        coarse = turned_a[rows, own].astype(np.float32)
        close = ((coarse**2).sum(1)[:, None] + square_m - 2 * (coarse @ coarse_m.T)) <= shares[block] + 1e-5
        i, j = np.nonzero(close)
        keep = np.where(asking["home"][start + i], asking["id"][start + i] < members["id"][j], True)
        i, j = i[keep] + start, j[keep]
        for at in range(0, len(i), 1 << 16):  # bounds the rows that are gathered at once
            p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            linked = np.einsum("ij,ij->i", unit_a[p], unit_m[q]) / (norm_a[p] * norm_m[q]) >= least
            p, q = p[linked], q[linked]
            apart = (turned_a[p] - turned_m[q]) ** 2
            within = np.stack([apart[:, s:e].sum(1) <= share for s, e, share in zip(edges, edges[1:], shares)], axis=1) if len(p) else np.zeros((0, len(shares)), bool)
            # A link whose rounding leaves it within no share at all counts in its relatively closest block.
            none = ~within.any(1)
            if none.any():
                ratio = np.stack([apart[none, s:e].sum(1) / share for s, e, share in zip(edges, edges[1:], shares)], axis=1)
                within[np.flatnonzero(none), ratio.argmin(1)] = True
            mine = within.argmax(1) == block
            p, q = p[mine], q[mine]
            np.add.at(links, at_a[p], members["copies"][q])
            np.add.at(links, at_m[q], asking["copies"][p])
            union.join(at_a[p], at_m[q])
    found = links > 0
    return ids[found], links[found], ids[union.label[found]]


def near_vectors(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", box: int = BOX) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    n_links counts the other rows with a cosine of ``least`` or more, copies among them; component_id is the least vec_id that links reach. A
    vector that is null, empty, zero or holds null or non-finite components links with nothing. Vectors of different lengths don't
    link. Repeated rows, and different rows of one id, are vectors each. A null id gives no name: its component has the least other id, or
    null. kept: vec_id is component_id (for a null id: its component has no id). An empty table gives no rows. Extra columns are not read.
    """
    require(vectors, id_col, vector_col)
    if not 0 < least < 1:
        raise ValueError("least must lie between 0 and 1")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
    good = rows.where(usable("v"))
    classes = good.groupBy("v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id")).withColumn("class", F.monotonically_increasing_id())
    classes = cut(classes, "classes")
    distance = 2 - 2 * least

    sample = classes.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).toArrow().column("v").to_pylist()
    per_dim = {r["dim"]: r["count"] for r in classes.groupBy(F.size("v").alias("dim")).count().collect()}
    trees: dict[int, list] = {}
    for dim, n in per_dim.items():
        points = rotated(np.array([v for v in sample if len(v) == dim] or [[1.0] * dim], np.float64))
        edges = block_edges(dim)
        trees[dim] = [median_tree(points[:, s:e], min(MOST_BOXES, -(-n // box))) for s, e in zip(edges, edges[1:])]
    # How many homes and members a box has: at most MOST_BOXES numbers a block.
    counts = _route(classes, trees, distance, None).groupBy("dim", "block", "box").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("long")).alias("homes")).collect()
    parts = {(r["dim"], r["block"], r["box"]): (max(1, -(-r["n"] // (2 * box))), max(1, -(-r["homes"] // (2 * box)))) for r in counts}

    def run(group: pa.Table) -> pa.Table:
        dim, block = group.column("dim")[0].as_py(), group.column("block")[0].as_py()
        asks = group.column("asks").to_numpy(zero_copy_only=False)
        sides = []
        for t in (group.filter(pa.array(asks)), group.filter(pa.array(~asks))):
            sides.append({"id": t.column("class").to_numpy(), "copies": t.column("copies").to_numpy(), "home": t.column("home").to_numpy(zero_copy_only=False), "v": _rows(t.column("v"), dim)})
        found = links_in_box(*sides, block, least) if len(sides[0]["id"]) and len(sides[1]["id"]) else (np.empty(0, np.int64),) * 3
        return pa.table(dict(zip(("class", "links", "root"), (pa.array(x, pa.int64()) for x in found))))

    met = _route(classes, trees, distance, parts).groupBy("dim", "block", "box", "left", "right").applyInArrow(run, "class long, links long, root long")
    met = cut(met, "links")
    components = connected_components(met.select(F.col("class").alias("u"), F.col("root").alias("v")))
    numbered = (
        classes.join(met.groupBy("class").agg(F.sum("links").alias("links")), "class", "left")
        .join(components, F.col("class") == F.col("node"), "left")
        .select("v", "copies", "least_id", F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.coalesce("root", "class").alias("root"))
    )
    numbered = cut(numbered, "numbered")
    named = numbered.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_vector = numbered.join(named, "root").select(F.col("v").alias("class_v"), (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = good.join(by_vector, F.col("v") == F.col("class_v"), "left").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable("v")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    drop_cut(met)
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
