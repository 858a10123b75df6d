"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

Terms are a text's words and the beginnings of its words, lower-cased; no term is left out. A term's weight in a text is TF-IDF in
its divergence form, 2 (tf ln(tf / e) - (tf - e)) with e the count that the term's share of all documents' terms makes one expect
(0 if tf is no larger), times a factor for how differently toxic and clean rows use the term: the root of its log-likelihood ratio
and a small floor. The index holds every example with its whole vector, in blocks with the largest weight of each block. A text visits
blocks by their upper bound and stops when no block can better its k-th best cosine, so its neighbours are exact. A vote weighs its
cosine to the fourth power times the labelled rows that its example stands for; the prior weighs a little. The examples' own votes,
each without itself, correct the share where they are many enough to tell.

Fitting looks at ``max_labelled`` labelled rows and indexes ``max_examples`` of them, chosen by hash; these bounds are parameters. The
counts of terms are taken over all documents, and all documents are scored. A term that no example has counts in a text's length as
one of this text alone; this scales all its cosines alike and changes no order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.llm.common import as_texts, cut, map_arrow, require, small_batches

BLOCK, NEIGHBOURS, THRESHOLD = 256, 15, 0.3
#: Texts that are searched in one go, so that short ones share the cost of a step.
TOGETHER = 8
MAX_LABELLED, MAX_EXAMPLES = 20_000, 1_024
PREFIXES = (4, 5, 6, 7)
POWER, PRIOR_VOTES, FLOOR = 4, 0.02, 0.05
#: Rows of the rarer label at which the examples' own votes correct a vote share half way.
TRUSTED_ROWS = 100
_WORDS = re.compile(r"[^\W\d_]+").findall
#: Texts whose terms are hashed in one go.
HASHED = 16
#: A polynomial's base modulo 2**64, and what sets a beginning's hash apart from that of a word.
_BASE, _BEGINNING = 0x9E3779B97F4A7C15, np.uint64(0xD1B54A32D192ED03)
_KEPT_POWERS = 1 << 20


def text_counts(text: str) -> dict[str, int]:
    """How often each term of a text occurs in it. A word's terms are itself, and as ``beginning~`` its beginnings."""
    words = Counter(_WORDS(text.lower()))
    counts = dict(words)
    for word, n in words.items():
        for size in PREFIXES:
            if len(word) <= size:
                break
            term = word[:size] + "~"
            counts[term] = counts.get(term, 0) + n
    return counts


@cache
def _letters() -> np.ndarray:
    """For each code point, whether it can be in a word."""
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in "".join(_WORDS("".join(map(chr, range(0x110000)))))]] = True
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse."""
    return tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


@cache
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_KEPT_POWERS)


def _words_and_beginnings(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words of lower-case texts and then of the words' beginnings of each size: (hashes, where each text's begin)."""
    codes = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    powers, inverse = _kept_powers() if len(codes) <= _KEPT_POWERS else _powers(len(codes))
    letter = _letters()[codes]
    edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    sums = np.empty(len(codes) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(codes * inverse[: len(codes)], out=sums[1:])
    begins = np.cumsum([1, *[len(t) + 1 for t in texts]])
    yield (sums[ends] - sums[starts]) * powers[starts], np.searchsorted(starts, begins)
    for size in PREFIXES:
        starts, ends = (x[ends - starts > size] for x in (starts, ends))
        yield (sums[starts + size] - sums[starts]) * powers[starts] ^ _BEGINNING, np.searchsorted(starts, begins)


def term_hashes(texts: list[str]) -> list[np.ndarray]:
    """64-bit hashes of each text's terms, repeats included, in no particular order."""
    parts = list(_words_and_beginnings([t.lower() for t in texts]))
    return [np.concatenate([h[at[i] : at[i + 1]] for h, at in parts]) for i in range(len(texts))]


class TermCounter:
    """Counts terms by their hashes, without a string for each. Two of all terms share a hash by a chance of one in 2**64."""

    def __init__(self, terms: list[str]):
        hashes = next(_words_and_beginnings([t.rstrip("~") for t in terms]))[0] ^ np.where([t.endswith("~") for t in terms], _BEGINNING, np.uint64(0))
        self.numbers = np.argsort(hashes)
        self.hashes = hashes[self.numbers]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two terms of the index have the same hash")

    def counts(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(term numbers, -1 for those that aren't in the index; counts), in an order that the hashes give. Sorts ``hashes``."""
        hashes.sort()
        first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)])
        keys, tf = hashes[first], np.diff(np.r_[first, len(hashes)])
        if not len(self.hashes):
            return np.full(len(keys), -1), tf
        at = np.minimum(np.searchsorted(self.hashes, keys), len(self.hashes) - 1)
        return np.where(self.hashes[at] == keys, self.numbers[at], -1), tf

    def arrays(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(term numbers, counts) of each text."""
        for start in range(0, len(texts), HASHED):
            for hashes in term_hashes(texts[start : start + HASHED]):
                number, tf = self.counts(hashes)
                yield number, tf.astype(np.float64)


def divergence(tf: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Twice the log-likelihood by which a count tells against its expectation, where it is larger; else 0."""
    return np.where(tf > expected, 2 * (tf * np.log(tf / np.maximum(expected, 1e-300)) - (tf - expected)), 0.0)


def likelihood_ratio(toxic: np.ndarray, clean: np.ndarray, all_toxic: int, all_clean: int) -> np.ndarray:
    """For each term, how surely toxic and clean rows differ in having it (the G statistic); 0 without rows of both labels."""
    if not all_toxic or not all_clean:
        return np.zeros(len(toxic))

    def log(k, n, p):
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    both = (toxic + clean) / (all_toxic + all_clean)
    apart = log(toxic, all_toxic, toxic / all_toxic) + log(clean, all_clean, clean / all_clean)
    return np.maximum(2 * (apart - log(toxic, all_toxic, both) - log(clean, all_clean, both)), 0)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges in turn; no range is empty."""
    steps = np.ones(int(sizes.sum()), np.int64)
    if len(starts):
        steps[0] = starts[0]
        steps[np.cumsum(sizes)[:-1]] = starts[1:] - starts[:-1] - sizes[:-1] + 1
    return np.cumsum(steps, out=steps)


class Postings:
    """Examples by term. An entry is a term's part in one block: its block, its largest weight, and where its postings start."""

    def __init__(self, at: np.ndarray, term: np.ndarray, weight: np.ndarray, examples: int, terms: int):
        some = weight > 0
        at, term, weight = at[some], term[some], weight[some]
        order = np.lexsort((at, term))
        at, term, weight = at[order], term[order], weight[order]
        self.examples, self.at, self.weight = examples, at, weight
        self.term_starts = np.searchsorted(term, np.arange(terms + 1))
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (at[1:] // BLOCK != at[:-1] // BLOCK)][: len(term)])
        self.entry_starts = np.searchsorted(term[first], np.arange(terms + 1))
        self.entry_block = at[first] // BLOCK
        self.entry_max = np.maximum.reduceat(weight, first) if len(first) else np.empty(0)
        self.starts = np.r_[first, len(term)]

    def of_term(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.term_starts[term], self.term_starts[term + 1]
        return self.at[a:b], self.weight[a:b]

    def nearest(self, terms: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a cosine over 0, ties to the smaller number; exact."""
        return self.nearest_of([(terms, values)], k)[0]

    def nearest_of(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """:meth:`nearest` of a few texts at once, each (terms, values).

        Each text visits the block with its best bound first; then all blocks whose bound reaches the k-th best cosine of that one.
        """
        terms, values = (np.concatenate([t[i] for t in texts]) for i in (0, 1))
        text = np.repeat(np.arange(len(texts)), [len(t) for t, _ in texts])
        sizes = self.entry_starts[terms + 1] - self.entry_starts[terms]
        entries, value, text = _ranges(self.entry_starts[terms][sizes > 0], sizes[sizes > 0]), np.repeat(values, sizes), np.repeat(text, sizes)
        blocks = max(1, -(-self.examples // BLOCK))
        cell = text * blocks + self.entry_block[entries]
        bounds = np.bincount(cell, value * self.entry_max[entries], len(texts) * blocks).reshape(-1, blocks)
        starts, sizes = self.starts[entries], self.starts[entries + 1] - self.starts[entries]
        text = text * self.examples

        def visit(cells: np.ndarray) -> np.ndarray:
            some = np.flatnonzero(cells.ravel()[cell])
            n = sizes[some]
            places = _ranges(starts[some], n)
            return np.bincount(np.repeat(text[some], n) + self.at[places], np.repeat(value[some], n) * self.weight[places], len(texts) * self.examples).reshape(len(texts), -1)

        def kth(found: np.ndarray) -> np.ndarray:
            least = np.partition(found, -k, axis=1)[:, -k] if self.examples > k else np.zeros(len(found))
            return np.maximum(least, 1e-300)

        first = np.arange(blocks) == bounds.argmax(axis=1)[:, None]
        found = visit(first)
        rest = ~first & (bounds > 0) & (bounds >= kth(found)[:, None] - 1e-9)
        if rest.any():
            found += visit(rest)
        out = []
        for row, least in zip(found, kth(found)):
            here = np.flatnonzero((row >= least - 1e-8) & (row > 0))  # those that can't be among the k best aren't sorted
            best = here[np.lexsort((here, -row[here].round(9)))[:k]]
            out.append((best, row[best]))
        return out


@dataclass
class Index:
    """The examples' postings over all of their terms, and what weighs a text's terms."""

    terms: list[str]
    share: np.ndarray
    factor: np.ndarray
    corpus_terms: int
    labels: np.ndarray
    stands_for: np.ndarray
    ids: list
    postings: Postings
    prior: float
    curve: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def weights(self, number: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(terms of the index, weights) of a vector of length one; terms outside the index (number -1) count in the length."""
        length, known = tf.sum(), number >= 0
        terms, own, other = number[known], tf[known], tf[~known]
        values = divergence(own, length * self.share[terms]) * self.factor[terms]
        rest = divergence(other, length * other / self.corpus_terms) * FLOOR**0.5
        norm = np.sqrt((values**2).sum() + (rest**2).sum())
        some = values > 0
        return terms[some], values[some] / (norm or 1.0)

    def votes(self, texts: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None, k: int = NEIGHBOURS) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """(share of toxic votes, nearest examples, cosines) of texts, each (term numbers, counts); ``without``: examples that have no vote."""
        out = []
        for start in range(0, len(texts), TOGETHER):
            part = [self.weights(*t) for t in texts[start : start + TOGETHER]]
            for i, (at, near) in enumerate(self.postings.nearest_of(part, k + (without is not None))):
                if without is not None:
                    near, at = near[at != without[start + i]][:k], at[at != without[start + i]][:k]
                weight = near**POWER * self.stands_for[at]
                out.append((float((weight @ self.labels[at] + self.prior * PRIOR_VOTES) / (weight.sum() + PRIOR_VOTES)), at, near))
        return out

    def scores(self, texts: list[str], counter: TermCounter | None = None) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """(score, nearest examples, cosines) of each text; ``counter``: of this index's terms."""
        votes = self.votes(list((counter or TermCounter(self.terms)).arrays(texts)))
        return [(float(np.clip(np.interp(raw, *self.curve), 0, 1)), at, near) for raw, at, near in votes]


def rising(raw: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of a rising curve from vote shares to probabilities, by pool adjacent violators; equal shares are one pool.

    The curve is drawn to the share itself by as much as the rarer label has few rows: half way at TRUSTED_ROWS of them.
    """
    order = np.lexsort((-labels, raw))
    pools: list[list[float]] = []  # weight of label 1, weight, first and last share
    for x, y, w in zip(raw[order].tolist(), labels[order].tolist(), weights[order].tolist()):
        pools.append([y * w, w, x, x])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            y2, n2, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + y2, pools[-1][1] + n2, pools[-1][2], last]
    rarer = min(weights @ labels, weights @ (1 - labels))
    trust = rarer / (rarer + TRUSTED_ROWS)
    points = [(x, trust * y / n + (1 - trust) * x) for y, n, first, last in pools for x in (first, last)]
    xs, ys = zip((0.0, 0.0), *points, (1.0, 1.0))
    return np.array(xs), np.array(ys)


def _hash_order(*columns: str):
    return F.xxhash64(*columns)


def corpus_counts(docs: DataFrame, terms: list[str], text_col: str) -> tuple[np.ndarray, int]:
    """How often each term occurs in all documents, and how many terms there are in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, found, n = TermCounter(terms), np.zeros(len(terms), np.int64), 0
        for batch in batches:
            texts = as_texts(batch.column(0))
            hashes = np.concatenate([h for start in range(0, len(texts), HASHED) for h in term_hashes(texts[start : start + HASHED])] or [np.empty(0, np.uint64)])
            n += len(hashes)
            number, times = counter.counts(hashes)
            found[number[number >= 0]] += times[number >= 0]
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1], pa.int32()), pa.array(np.r_[found[some], n], pa.int64())], ["term", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return _by_term(counted.toArrow(), "n", len(terms))  # a row for each term of the index


def _by_term(got: pa.Table, column: str, size: int) -> tuple[np.ndarray, int]:
    """(values by term number, the value of number -1)."""
    term, n, out = got["term"].to_numpy(), got[column].to_numpy(), np.zeros(size)
    out[term[term >= 0]] = n[term >= 0]
    return out, int(n[term < 0].sum())


def label_counts(labelled: DataFrame, terms: list[str]) -> tuple[np.ndarray, np.ndarray, int, int]:
    """In how many toxic and clean rows each term occurs, and how many rows of each there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, found, rows = TermCounter(terms), np.zeros((2, len(terms)), np.int64), [0, 0]
        for batch in batches:
            for (number, _), label in zip(counter.arrays(as_texts(batch.column(1))), batch.column(0).to_pylist()):
                found[label, number[number >= 0]] += 1
                rows[label] += 1
        some = np.flatnonzero(found.any(axis=0))
        columns = [np.r_[some, -1], np.r_[found[1, some], rows[1]], np.r_[found[0, some], rows[0]]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], ["term", "toxic", "clean"])

    counted = labelled.select("toxic", "text").mapInArrow(run, "term int, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    got = counted.toArrow()
    (toxic, all_toxic), (clean, all_clean) = (_by_term(got, c, len(terms)) for c in ("toxic", "clean"))
    return toxic, clean, all_toxic, all_clean


@dataclass
class Examples:
    """The chosen labelled rows: ids, labels, the rows that each stands for, and their terms as (example, term, count)."""

    ids: list
    labels: np.ndarray
    stands_for: np.ndarray
    terms: list[str]
    at: np.ndarray
    term: np.ndarray
    tf: np.ndarray


def chosen_examples(labelled: DataFrame, max_examples: int) -> Examples:
    """Examples by id hash, half of them toxic where there are enough; their terms are counted on executors."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts = [text_counts(t) for t in as_texts(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))], ["doc_id", "toxic", "terms", "counts"])

    id_type = labelled.schema["doc_id"].dataType.simpleString()
    tables, each = [], []
    for label in (1, 0):
        own = labelled.where(F.col("toxic") == label)
        chosen = cut(own.orderBy(_hash_order("doc_id"), "doc_id", F.xxhash64("text")).limit(max_examples // 2), "examples")
        tables.append(map_arrow(chosen.select("doc_id", "toxic", "text"), run, f"doc_id {id_type}, toxic int, terms array<string>, counts array<int>").toArrow())
        each += [own.count() / max(1, tables[-1].num_rows)] * tables[-1].num_rows
    got = pa.concat_tables(tables).combine_chunks()
    lists = got["terms"].combine_chunks()
    words = lists.flatten().dictionary_encode()
    names = words.dictionary.to_pylist()
    order = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    at = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    term = rank[words.indices.to_numpy(zero_copy_only=False)] if len(at) else np.empty(0, np.int64)
    tf = got["counts"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return Examples(got["doc_id"].to_pylist(), got["toxic"].to_numpy().astype(np.float64), np.array(each, np.float64), [names[i] for i in order], at, term, tf)


def build_index(examples: Examples, counts: np.ndarray, corpus_terms: int, ratio: np.ndarray, prior: float) -> Index:
    """counts: of each of the examples' terms over all documents; ratio: its likelihood ratio between the labels."""
    n, terms = len(examples.ids), len(examples.terms)
    share, factor = np.maximum(counts, 1) / max(corpus_terms, 1), np.sqrt(FLOOR + ratio)
    length = np.bincount(examples.at, examples.tf, n)
    weight = divergence(examples.tf, length[examples.at] * share[examples.term]) * factor[examples.term]
    norm = np.sqrt(np.bincount(examples.at, weight**2, n))
    weight = weight / np.where(norm > 0, norm, 1)[examples.at]
    # Examples with the same heaviest term lie together, so that a block's bounds are low for texts without it.
    heaviest = np.full(n, -1)
    heavy = np.lexsort((examples.term, weight))
    heaviest[examples.at[heavy]] = examples.term[heavy]
    order = np.array(sorted(range(n), key=lambda i: (heaviest[i], examples.labels[i], str(examples.ids[i]))), np.int64)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    index = Index(
        examples.terms, share, factor, max(corpus_terms, 1), examples.labels[order], examples.stands_for[order],
        [examples.ids[i] for i in order], Postings(place[examples.at], examples.term, weight, n, terms), prior,
    )
    if n:
        starts = np.searchsorted(examples.at, np.arange(n + 1))
        of = lambda i: slice(starts[i], starts[i + 1])
        raw = np.array([v[0] for v in index.votes([(examples.term[of(i)], examples.tf[of(i)]) for i in range(n)], without=place.tolist())])
        index.curve = rising(raw, examples.labels, examples.stands_for)
    return index


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED, max_examples: int = MAX_EXAMPLES) -> Index:
    """An index of labelled examples. ``labels``: id_col and label_col (0 or 1; rows with nulls or other values teach nothing).

    A document with several labels counts as toxic if one of them says so; repeated documents are examples each. Of labelled rows, those
    with the least id hashes are used. Null and empty texts have no terms. Empty documents or labels, or no toxic label, give an index
    whose every score is the prior, the toxic share of labelled rows, 0 without any. Very long texts are read whole. Columns other than
    those named are not read.
    """
    require(docs, id_col, text_col)
    require(labels, id_col, label_col)
    small_batches(docs.sparkSession)
    taught = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    chosen = cut(taught.orderBy(_hash_order("_id"), "_id").limit(max_labelled), "labels")
    # At most max_labelled ids and labels are broadcast.
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    labelled = cut(texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["_id"]).select("doc_id", "toxic", "text"), "labelled")
    examples = chosen_examples(labelled, max_examples)
    counts, corpus_terms = corpus_counts(docs, examples.terms, text_col)
    toxic, clean, all_toxic, all_clean = label_counts(labelled, examples.terms)
    prior = all_toxic / max(1, all_toxic + all_clean)
    return build_index(examples, counts, corpus_terms, likelihood_ratio(toxic, clean, all_toxic, all_clean), prior)


def score_column(index: Index):
    """A function of a text column that gives score and evidence (the nearest examples' ids, labels and cosines)."""
    shared = index

    @F.pandas_udf("score double, evidence array<struct<example: string, toxic: int, cosine: double>>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = TermCounter(shared.terms)
        for texts in batches:
            out = shared.scores([t or "" for t in texts], counter)
            evidence = [[{"example": str(shared.ids[a]), "toxic": int(shared.labels[a]), "cosine": float(c)} for a, c in zip(at[:3].tolist(), near[:3].tolist())] for _, at, near in out]
            yield pd.DataFrame({"score": [s for s, _, _ in out], "evidence": evidence})

    return scored


def score(docs: DataFrame, index: Index, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score, predicted and evidence (columns of these names, and of ``_scored``, are replaced).

    A score depends on the text alone: equal texts have equal scores, whatever else the rows say, and repeated rows are scored each.
    Null and empty texts, and texts that share no term with an example, score about the prior and have no evidence. Very long texts
    are read whole. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("score", "predicted", "evidence", "_scored")]
    scored = docs.select(*kept, score_column(index)(F.coalesce(F.col(text_col), F.lit(""))).alias("_scored"))
    return scored.select(*kept, F.col("_scored.score").alias("score"), (F.col("_scored.score") >= threshold).cast("int").alias("predicted"), F.col("_scored.evidence").alias("evidence"))
