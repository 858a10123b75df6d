"""Best-fit packing of documents' tokens into sequences: best-fit in each window, then a tree of best-fit rounds over what is left.

Windows are equal shares of the pieces, dealt out whatever their source. A window packs its pieces by decreasing length, each into
the fullest bin that has room. Underfull bins go up a tree as items, FAN_IN groups to one, and are packed again, whole bin by whole bin.

No bin that could still be merged stays behind. Two bins can only become one if one of them is at most half full, and after a
best-fit round at most one bin of a group is (a second one would have fitted into it). So where FAN_IN groups meet there are at most
FAN_IN bins to move, and these come up by name. All other underfull bins stay in the table, at every level, and come up as a
histogram: how many there are of each fill. That is all that best fit asks of them, and it is at most ``capacity`` numbers however many
bins there are. The fills that it picks are then looked up, the first of their bins by number, and get their new fill.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ostinato.llm.common import as_texts, cut, map_arrow, require, small_batches
from ostinato.llm.tokens import encoder

CAPACITY, END = 2048, 0
WINDOW = 40_000
FAN_IN = 8


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, its offset there, fill of each bin): longest items first, each into the fullest bin with room."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    with_room, fill = 0, []  # bit r is set if some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = with_room >> n
        if fits and n:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                with_room &= ~(1 << r)
        else:
            b, r = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        r -= n
        if r:
            room[r].append(b)
            with_room |= 1 << r
    return bins, offsets, np.array(fill, np.int64)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian 32 bits each) of every text's ids and the end id."""
    require(docs, id_col, text_col)
    small_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own, at, starts, data = encoder(tokenizer), [], [], []
        for i, known in enumerate(own.ids_of(as_texts(batch.column(1)))):
            ids = np.append(np.frombuffer(known, own.kind), END).astype("<u4").tobytes()
            for start in range(0, len(ids), 4 * capacity):
                at.append(i)
                starts.append(start // 4)
                data.append(ids[start : start + 4 * capacity])
        starts = np.array(starts, np.int64)
        columns = [batch.column(0).take(pa.array(at)), pa.array((starts // capacity).astype(np.int32)), pa.array(starts), pa.array([len(x) // 4 for x in data], pa.int64()), pa.array([zlib.crc32(x) for x in data], pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(data, pa.binary())] if with_ids else columns, [*names, "ids"] if with_ids else names)

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, schema + ", ids binary" * with_ids)


def _packed_windows(items: DataFrame, windows: int, capacity: int) -> DataFrame:
    """The items with bin, offset and the bin's fill; a bin's number starts with its window's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if not rows:
            return
        whole, window = pa.Table.from_batches(rows), TaskContext.get().partitionId()
        bins, offsets, fill = best_fit(whole.column("length").to_numpy(), capacity)
        for name, values in (("window", np.full(len(bins), window, np.int64)), ("bin", (window << 32) + bins), ("offset", offsets), ("fill", fill[bins])):
            whole = whole.append_column(name, pa.array(values))
        yield from whole.to_batches(max_chunksize=10_000)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema)
    return items.repartition(windows).mapInArrow(run, f"{schema}, window long, bin long, offset long, fill long")


def merge_by_histogram(movers: list[tuple[int, int]], others: dict[int, int], capacity: int) -> list[tuple]:
    """movers: (bin, fill) of bins that may move; others: how many other bins have each fill -> (bin, into, shift, of_fill, nth, fill) of each move.

    Movers go by decreasing fill, each into the fullest bin with room. ``into`` is a mover, or null for the ``nth`` bin (from 0) of the others
    that have ``of_fill``; ``shift`` is where the moved bin starts, and ``fill`` what the bin that takes it holds in the end.
    """
    left = np.zeros(capacity + 1, np.int64)
    for f, n in others.items():
        left[f] = n
    fills = sum(1 << f for f, n in others.items() if n)  # bit f is set if some other bin of that fill is untouched
    taken: dict[int, int] = {}
    named: list[list] = []  # bins that are known by name: (fill now, mover or null, first fill, nth)
    moves = []
    for bin_, x in sorted(movers, key=lambda m: (-m[1], m[0])):
        below = fills & ((1 << (capacity - x + 1)) - 1)
        free = below.bit_length() - 1 if below else -1
        known = max((b for b in named if b[0] + x <= capacity), key=lambda b: b[0], default=None)
        if known is not None and known[0] >= free:
            target = known
        elif free >= 0:
            target = [free, None, free, taken.get(free, 0)]
            taken[free] = target[3] + 1
            if taken[free] == left[free]:
                fills &= ~(1 << free)
            named.append(target)
        else:
            named.append([x, bin_, x, 0])
            continue
        moves.append((bin_, target, target[0]))
        target[0] += x
    return [(bin_, t[1], at, t[2] if t[1] is None else 0, t[3], t[0]) for bin_, t, at in moves]


def _merge_round(bins: DataFrame, capacity: int) -> DataFrame:
    """bins(grp, bin, fill), all that are underfull -> (bin, into, shift, fill): the moves of a best-fit round, and the fill of what takes them."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        moves = merge_by_histogram([(r["bin"], r["fill"]) for r in rows if r["bin"] is not None], {r["fill"]: r["n"] for r in rows if r["bin"] is None}, capacity)
        grp = group.column("grp")[0].as_py()
        columns = list(zip(*moves)) or [()] * 6
        names = ("bin", "into", "shift", "of_fill", "nth", "fill")
        return pa.table({"grp": pa.array([grp] * len(moves), pa.int64()), **{c: pa.array(x, pa.int64()) for c, x in zip(names, columns)}})

    small = f"2 * fill <= {capacity}"
    others = bins.where(f"not ({small})")
    counted = others.groupBy("grp", "fill").agg(F.count("*").alias("n")).select("grp", F.lit(None).cast("long").alias("bin"), "fill", "n")
    moves = bins.where(small).select("grp", "bin", "fill", F.lit(1).cast("long").alias("n")).unionByName(counted).groupBy("grp").applyInArrow(run, "grp long, bin long, into long, shift long, of_fill long, nth long, fill long")
    moves = cut(moves, "moved")
    # A group has at most FAN_IN movers, so that many bins of a fill at most are asked for.
    ranked = others.withColumn("nth", F.row_number().over(_by(["grp", "fill"], "bin")).cast("long") - 1).where(f"nth < {FAN_IN}")
    named = ranked.select("grp", F.col("fill").alias("of_fill"), "nth", F.col("bin").alias("named"))
    return moves.join(named, ["grp", "of_fill", "nth"], "left").select("bin", F.coalesce("into", "named").alias("into"), "shift", "fill")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (ids, if asked for), sequence_id and offset.

    Null and empty texts are the end id alone. Only documents longer than a sequence are cut, also very long ones, into full pieces and
    a rest. Pieces of equal length are packed in the order in which they come. Repeated rows are packed each. Null ids are kept. An empty
    table gives no rows. Other columns are not read. ``window``: pieces that one task packs.
    """
    items = cut(pieces(docs, tokenizer, capacity, id_col, text_col, with_ids), "pieces")
    windows = max(1, -(-items.count() // window))
    packed = cut(_packed_windows(items, windows, capacity), "packed")
    moves = None
    underfull = packed.where(f"offset = 0 and fill < {capacity}").select(F.col("window").alias("grp"), "bin", "fill")
    groups = windows
    while groups > 1:
        groups = -(-groups // FAN_IN)
        underfull = underfull.withColumn("grp", F.floor(F.col("grp") / FAN_IN))
        step = cut(_merge_round(underfull, capacity), "merged")
        then = step.select(F.col("bin").alias("then_bin"), F.col("into").alias("then_into"), F.col("shift").alias("then_shift"))
        own = step.select("bin", "into", "shift")
        if moves is not None:
            moved = moves.join(then, moves["into"] == then["then_bin"], "left")
            own = own.unionByName(moved.select("bin", F.coalesce("then_into", "into").alias("into"), (F.col("shift") + F.coalesce("then_shift", F.lit(0))).alias("shift")))
        moves = cut(own, "moves")
        if groups > 1:
            # Bins that moved are gone; those that took some have their new fill.
            grown = step.groupBy(F.col("into").alias("taker")).agg(F.max("fill").alias("grown"))
            left = underfull.join(step.select(F.col("bin").alias("gone")), F.col("bin") == F.col("gone"), "left_anti").join(grown, F.col("bin") == F.col("taker"), "left")
            underfull = cut(left.select("grp", "bin", F.coalesce("grown", "fill").alias("fill")).where(f"fill < {capacity}"), "underfull")
    if moves is None:
        out = packed.withColumn("sequence_id", F.col("bin"))
    else:
        out = packed.join(moves, "bin", "left").withColumn("sequence_id", F.coalesce("into", "bin")).withColumn("offset", F.col("offset") + F.coalesce("shift", F.lit(0)))
    return out.select(*items.columns, "sequence_id", "offset")


def _by(group: list[str], *order: str):
    return Window.partitionBy(*group).orderBy(*order)


def sequences(packed: DataFrame) -> DataFrame:
    """Pieces with ids -> one row per sequence: its ids as an array, and where in it each document's piece starts.

    A group holds at most one sequence's tokens, so it is bounded by the capacity.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("offset")
        ids = np.frombuffer(b"".join(group.column("ids").to_pylist()), "<u4").astype(np.int32)
        starts = group.column("offset").to_pylist()
        return pa.table({"sequence_id": group.column("sequence_id").slice(0, 1), "ids": pa.array([ids.tolist()], pa.list_(pa.int32())), "starts": pa.array([starts], pa.list_(pa.int64()))})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(run, "sequence_id long, ids array<int>, starts array<long>")
