"""Spelling variants: words that differ by one inserted, deleted or replaced code point, by two-dimensional range reporting.

Words stand in two orders: forward, and by their reversed spelling, each within its length. A word x that replaces the code point i of w has
w[:i] before it and w[i+1:] behind it: in forward order x lies in the interval of a prefix, in reverse order in that of a suffix. The
words in both are the points of a rectangle, which a wavelet tree over the permutation between the orders reports. Insertions are the same
with the next length and the suffix w[i:]; a deletion is an insertion seen from the other word.

The orders are cut into blocks of about BLOCK words. Each word picks a split m: positions from m on are asked in the forward blocks that hold
its prefix w[:m], the others in the reverse blocks that hold its suffix w[m:]. Among some splits it takes that with the fewest blocks, so words
that share long beginnings are told apart by their ends, and no group of words has to be in one task.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.llm.common import cut, drop_cut, map_arrow, require
from ostinato.llm.wavelet import WaveletTree

#: Fixed values of the format: what a run is, and which code points lower-casing changes.
LETTER = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = 1 << 15
SPLITS = 16
#: Bounds the rectangles that are asked at once.
AT_ONCE = 1 << 18


def lower_ascii(run: Column) -> Column:
    """A run with A-Z in lower case and all else as it is; Spark's lower() does the same unless there are other capitals."""
    return F.when(run.rlike("[À-Þ]"), F.translate(run, UPPER, LOWER)).otherwise(F.lower(run))


def with_slips(doc_id: Column, run: Column, one_in: int) -> Column:
    """The run, or without one code point where ``one_in`` divides the CRC-32 of ``<doc_id>:<run>`` (a null id has no digits)."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, least_n: int = 3, slip_one_in: int = 97) -> DataFrame:
    """(word, n): the distinct words of all texts with at least ``least_chars`` code points and ``least_n`` occurrences."""
    require(docs, id_col, text_col)
    # A run never grows, so shorter ones aren't looked at; a match starts where its run does and is the whole of it.
    long_run = F.lit(f"{LETTER}{{{least_chars},}}")
    runs = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(text_col, long_run, F.lit(0))).alias("run"))
    words = runs.withColumn("run", lower_ascii(F.col("run"))).select(with_slips(F.col("doc_id"), F.col("run"), slip_one_in).alias("word"))
    return words.where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def block_starts(words: DataFrame, key: Column, blocks: int) -> list[tuple[int, str]]:
    """The least (length, key) of each of about ``blocks`` ranges: one entry per BLOCK words, whatever their number."""
    keyed = words.select(F.length("word").alias("len"), key.alias("key"))
    ranged = keyed.repartitionByRange(blocks, "len", "key").groupBy(F.spark_partition_id()).agg(F.min(F.struct("len", "key")).alias("s"))
    return sorted((r["s"]["len"], r["s"]["key"]) for r in ranged.collect())


def spanned(starts: list[tuple[int, str]], length: int, part: str) -> tuple[int, int]:
    """The first and the last block that may hold keys of this length that begin with ``part``."""
    return max(0, bisect_left(starts, (length, part)) - 1), max(0, bisect_right(starts, (length, part), key=lambda s: (s[0], s[1][: len(part)])) - 1)


def _splits(length: int) -> list[int]:
    """The middle first, then up to SPLITS others, spread over the word."""
    step = max(1, length // SPLITS)
    return [length // 2, *(m for m in range(1, length, step) if m != length // 2)]


def route(words: DataFrame, forward: list[tuple[int, str]], reverse: list[tuple[int, str]]) -> DataFrame:
    """words(word, n) -> (side, block, role, m, word, n): each word as a member of its two blocks, and as a query of those it asks."""
    sides = (forward, reverse)

    def asked(w: str, back: str, m: int) -> list[tuple[int, int, int]]:
        found = [(side, *spanned(starts, n, part)) for side, starts, part in ((0, forward, w[:m]), (1, reverse, back[: len(w) - m])) for n in (len(w), len(w) + 1)]
        return [(side, b) for side in (0, 1) for b in sorted({b for s, first, last in found if s == side for b in range(first, last + 1)})]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for i, w in enumerate(batch.column(0).to_pylist()):
            back, best, split = w[::-1], None, 0
            for m in _splits(len(w)):
                wanted = asked(w, back, m)
                if best is None or len(wanted) < len(best):
                    best, split = wanted, m
                if len(best) <= 4:  # two lengths on two sides: seldom fewer
                    break
            out += [(side, max(0, bisect_right(starts, (len(w), key)) - 1), 0, split, i) for side, (starts, key) in enumerate(zip(sides, (w, back)))]
            out += [(side, b, 1, split, i) for side, b in best]
        columns = [pa.array(x, pa.int32()) for x in zip(*out)]
        yield pa.RecordBatch.from_arrays([*columns[:4], *(batch.column(c).take(columns[4]) for c in (0, 1))], ["side", "block", "role", "m", "word", "n"])

    return map_arrow(words.select("word", "n"), run, "side int, block int, role int, m int, word string, n long")


def _points(words: list[str], length: int) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), length)


class _Order:
    """Members of one length and the queries against them, sorted together: intervals of members by common beginnings."""

    def __init__(self, members: list[str], queries: list[str], depth: int):
        both = members + queries
        order = np.array(sorted(range(len(both)), key=both.__getitem__), np.int64)
        points = _points([both[i][:depth] for i in order], depth)
        same = points[1:] == points[:-1]
        # How many leading code points each row shares with the one before it.
        self.common = np.r_[-1, np.where(same.all(1), depth, np.argmin(same, 1)) if len(same) and depth else np.zeros(len(same), np.int64)]
        self.before = np.r_[0, np.cumsum(order < len(members))]
        place = np.empty(len(both), np.int64)
        place[order] = np.arange(len(both))
        self.members, self.places = order[order < len(members)], place[len(members) :]
        after = np.r_[self.common[1:], -1]
        #: An upper bound of the beginning that a query shares with any member.
        self.most = np.maximum(self.common, after)[self.places]

    def interval(self, depth: int, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranks of the members that share ``depth`` code points with each query."""
        starts = np.flatnonzero(self.common < depth)
        ends = np.r_[starts[1:], len(self.common)]
        group = np.searchsorted(starts, self.places[queries], "right") - 1
        return self.before[starts[group]], self.before[ends[group]]


def near_in_block(side: int, members: list[str], queries: list[str], splits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, member): members that replace one code point of a query or insert one, at the positions that the query asks on this side."""
    by_length, asking = {}, {}
    for table, words in ((by_length, members), (asking, queries)):
        for i, w in enumerate(words):
            table.setdefault(len(w), []).append(i)
    for length, q in asking.items():
        for more in (0, 1):
            d = by_length.get(length + more)
            if d:
                yield from _near_of_length([members[i] for i in d], np.array(d), [queries[i] for i in q], np.array(q), splits, side, length, more)


def _near_of_length(words: list[str], members: np.ndarray, asking: list[str], queries: np.ndarray, splits: np.ndarray, side: int, length: int, more: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    forward = _Order(words, asking, length)
    reverse = _Order([w[::-1] for w in words], [w[::-1] for w in asking], length)
    rank = np.empty(len(words), np.int64)
    rank[reverse.members] = np.arange(len(words))
    tree = WaveletTree(rank[forward.members])
    m = splits[queries]
    tail = length - 1 + more  # prefix and suffix have this many code points together
    first, last = np.maximum(np.where(side == 0, m, 0), tail - reverse.most), np.minimum(np.where(side == 0, tail, np.minimum(m - 1, tail)), forward.most)
    waiting: list[tuple] = []
    size = 0
    for i in range(max(0, int(first.min())), int(last.max()) + 1):
        at = np.flatnonzero((first <= i) & (i <= last))
        if not len(at):
            continue
        fl, fr = forward.interval(i, at)
        rl, rr = reverse.interval(tail - i, at)
        some = (fl < fr) & (rl < rr)
        waiting.append((at[some], np.full(some.sum(), i), fl[some], fr[some], rl[some], rr[some]))
        size += some.sum()
        if size >= AT_ONCE:
            yield _reported(tree, waiting, reverse, words, members, asking, queries, more)
            waiting, size = [], 0
    if size:
        yield _reported(tree, waiting, reverse, words, members, asking, queries, more)


def _reported(tree: WaveletTree, waiting: list[tuple], reverse: _Order, words: list[str], members: np.ndarray, asking: list[str], queries: np.ndarray, more: int) -> tuple[np.ndarray, np.ndarray]:
    at, position, fl, fr, rl, rr = (np.concatenate(x) for x in zip(*waiting))
    box, value = tree.report(fl, fr, rl, rr)
    found, who, where = reverse.members[value], at[box], position[box]
    if more:
        # Beside an equal code point an insertion has several positions; the first of them counts.
        keep = [i == 0 or words[x][i] != words[x][i - 1] for x, i in zip(found.tolist(), where.tolist())]
    else:
        keep = [words[x][i] != asking[w][i] for x, w, i in zip(found.tolist(), who.tolist(), where.tolist())]
    keep = np.array(keep, bool)
    return queries[who[keep]], members[found[keep]]


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """words(word, n), each word once -> (word, n, near, near_n): all pairs at one edit, in both directions."""
    blocks = max(1, -(-words.count() // block))
    forward, reverse = block_starts(words, F.col("word"), blocks), block_starts(words, F.reverse("word"), blocks)
    routed = route(words, forward, reverse)

    def run(group: pa.Table) -> pa.Table:
        role = group.column("role").to_numpy()
        sets = [group.filter(pa.array(role == r)) for r in (0, 1)]
        names = [s.column("word").to_pylist() for s in sets]
        counts = [s.column("n").to_numpy() for s in sets]
        side, splits = group.column("side")[0].as_py(), sets[1].column("m").to_numpy()
        pairs = list(near_in_block(side, names[0], names[1], splits)) or [(np.empty(0, np.int64),) * 2]
        q, d = (np.concatenate(x) for x in zip(*pairs))
        asked, found = sets[1].column("word").take(pa.array(q)), sets[0].column("word").take(pa.array(d))
        swapped = np.array([len(names[0][j]) > len(names[1][i]) for i, j in zip(q.tolist(), d.tolist())], bool)
        # An insertion is a deletion for the longer word; replacements are found from both sides.
        back = pa.array(np.flatnonzero(swapped))
        return pa.table({
            "word": pa.chunked_array([*asked.chunks, *found.take(back).chunks], pa.string()),
            "n": pa.array(np.r_[counts[1][q], counts[0][d][swapped]], pa.int64()),
            "near": pa.chunked_array([*found.chunks, *asked.take(back).chunks], pa.string()),
            "near_n": pa.array(np.r_[counts[0][d], counts[1][q][swapped]], pa.int64()),
        })

    return routed.groupBy("side", "block").applyInArrow(run, "word string, n long, near string, near_n long")


def spelling_forms(words: DataFrame, ratio: int = 2, block: int = BLOCK) -> DataFrame:
    """words(word, n), each word once -> word, n, n_near, form, form_n, root.

    A word's form is its near word of largest n (ties: smallest by code points) if that n is at least ``ratio`` times its own, else null. The
    root is the end of the chain of forms, the word itself if it has none. Near words are counted once. Words of any length are compared
    whole. An empty table gives no rows. ``ratio`` must be over 1, so that chains end.
    """
    require(words, "word", "n")
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    words = cut(words.select("word", "n"), "words")
    best = near_words(words, block).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    good = -F.col("best.less") >= ratio * F.col("n")
    formed = joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n"))
    formed = cut(formed, "forms")
    drop_cut(words)
    # A form occurs at least twice as often, so chains are short; each round doubles the steps that are taken.
    roots = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        roots = cut(roots, "roots")
        further = roots.alias("a").join(roots.alias("b"), F.col("a.root") == F.col("b.word"), "left")
        if further.where("b.word is not null").isEmpty():
            break
        roots = further.select("a.word", F.coalesce("b.root", "a.root").alias("root"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, least_n: int = 3, slip_one_in: int = 97, ratio: int = 2, block: int = BLOCK) -> DataFrame:
    """The words of all texts with their forms: see :func:`vocabulary` and :func:`spelling_forms`.

    Null and empty texts have no words. Null ids draw their slips as empty ones. Repeated rows count each. An empty table gives no rows. A
    text may be one run of any length. Columns other than the two named are not read.
    """
    return spelling_forms(vocabulary(docs, id_col, text_col, least_chars, least_n, slip_one_in), ratio, block)
