"""Substring dedup: every word covered by a window of ``length`` words that also starts somewhere else goes.

Seed and extend. Winnowing picks, for each window, its anchor: the run of ``gram`` words with the least hash in the window (the
first of equals). Equal windows have the same anchor at the same place, so only occurrences of the same anchor can match, and an
anchor's occurrence can be extended both ways only as far as the windows that share it reach: that text is its span. Occurrences meet
by joining on the anchor. Spans that are equal as a whole match in full, to both sides, and are counted, never paired. Where an anchor has
different spans, one representative of each kind is extended: aligned by the anchor, two spans share a window exactly if their words
agree that far to the left and to the right, so the windows around the anchor are compared by hash and counted with the span's number of
occurrences, instead of pair by pair, which would be all pairs of a frequent anchor's spans. The maximal repeat is the union of the
windows that match; what is kept of it is one bit per window, for each span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.llm.common import as_bytes, cut, map_arrow, require, small_batches
from ostinato.llm.hashing import BASE, ODD, mixed, run_hashes

LENGTH, GRAM = 35, 6
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` grams, the place of the least one, the first of equals; by doubling, in whole arrays."""
    places = np.arange(len(grams))
    n = 1
    while n < width:
        step = min(n, width - n)
        a, b = places[: len(places) - step], places[step:]
        places = np.where(grams[b] < grams[a], b, a)
        n += step
    return places


def anchor_runs(h: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor of a text: its gram hash, the first of its windows, and how many windows it has (all consecutive)."""
    grams = run_hashes(h, gram)
    places = window_anchors(grams, length - gram + 1)
    first = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
    return grams[places[first]], first, np.diff(np.r_[first, len(places)])


def span_hashes(h: np.ndarray, anchors: np.ndarray, first: np.ndarray, count: np.ndarray, length: int, gram: int) -> np.ndarray:
    """A hash of each span: its words, its number of windows, and where in it the anchor lies (by the windows' own hashes)."""
    windows = run_hashes(h, length)
    # The first and the last window of a span, with its width, are all its words: fewer than ``length`` windows overlap.
    return mixed(windows[first] * BASE + windows[first + count - 1] * ODD + count.astype(np.uint64))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, dtype=np.uint64).view(np.int64))


def anchor_table(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """docs(doc_id, text_hash, text) -> (anchor, span, doc_id, text_hash, first, windows): one row per anchor occurrence."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parts, rows = [], []
        for i, text in enumerate(as_bytes(batch.column(2))):
            words = text.split()
            if len(words) >= length:
                h = word_hashes(words)
                anchors, first, count = anchor_runs(h, length, gram)
                parts.append((anchors, span_hashes(h, anchors, first, count, length, gram), first, count))
                rows.append(np.full(len(first), i))
        if parts:
            anchors, spans, first, count = (np.concatenate(x) for x in zip(*parts))
            at = pa.array(np.concatenate(rows))
            ids = [batch.column(c).take(at) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [_signed(anchors), _signed(spans), *ids, pa.array(first.astype(np.int32)), pa.array(count.astype(np.int8))],
                ["anchor", "span", "doc_id", "text_hash", "first", "windows"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs, run, f"anchor long, span long, doc_id {id_type}, text_hash long, first int, windows tinyint")


def _per_document(docs: DataFrame, marks: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Each document once with all of its marks as one array, in whatever order; joined by id and text hash."""
    packed = marks.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct(*columns)).alias("marks"))
    keys = docs["doc_id"].eqNullSafe(packed["doc_id"]) & (docs["text_hash"] == packed["text_hash"])
    return docs.join(packed, keys, how).select(*[docs[c] for c in docs.columns], "marks")


def window_counts(docs: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """Representatives of spans -> (anchor, span, place, window hash, n): one row per window; place: its number in the span."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for text, marks in zip(as_bytes(batch.column(0)), batch.column(1)):
            windows = run_hashes(word_hashes(text.split()), length)
            m = {k: marks.values.field(k).to_numpy(zero_copy_only=False) for k in ("anchor", "span", "first", "windows", "n")}
            count = m["windows"].astype(np.int64)
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(m["first"], count) + place
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(m["anchor"], count)), pa.array(np.repeat(m["span"], count)), pa.array(place.astype(np.int8)), _signed(windows[at]), pa.array(np.repeat(m["n"], count))],
                ["anchor", "span", "place", "window", "n"],
            )

    joined = _per_document(docs, spans, ["anchor", "span", "first", "windows", "n"], "inner")
    return map_arrow(joined.select("text", "marks"), run, "anchor long, span long, place tinyint, window long, n long")


def repeated_spans(docs: DataFrame, occurrences: DataFrame, length: int) -> DataFrame:
    """(anchor, span, bits): spans with repeated windows; bit i is set if the span's window i also starts elsewhere."""
    where = F.struct("doc_id", "text_hash", "first", "windows")
    spans = occurrences.groupBy("anchor", "span").agg(F.count("*").alias("n"), F.min(where).alias("at"))
    totals = spans.groupBy("anchor").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    several = cut(spans.join(totals.where("total > 1"), "anchor").select("anchor", "span", "n", "kinds", "at.*"), "spans")
    whole = several.where("kinds = 1").select("anchor", "span", F.lit(-1).cast("long").alias("bits"))
    mixed = several.where("kinds > 1").select("anchor", "span", "n", "doc_id", "text_hash", "first", "windows")
    # A window is told by its anchor and its hash, 128 bits.
    windows = cut(window_counts(docs, mixed, length), "windows")
    found = windows.groupBy("anchor", "window").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", "window")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").cast("int"))
    some = windows.join(found, ["anchor", "window"]).groupBy("anchor", "span").agg(F.bit_or(one).alias("bits"))
    return whole.unionByName(some)


def covered(n_words: int, first: np.ndarray, windows: np.ndarray, bits: np.ndarray, length: int) -> np.ndarray:
    """Which words lie in a marked window."""
    edge = np.zeros(n_words + 1, np.int64)
    for place in range(int(windows.max(initial=0))):
        at = first[(windows > place) & ((bits >> place) & 1 == 1)] + place
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _marked(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """docs(doc_id, text, ...) with marks: for each anchor with repeated windows, its first window, their number and bits."""
    if not 1 <= gram <= length or length - gram + 1 > 63:
        raise ValueError("the anchors' length must be between length - 62 and length")
    keyed = docs.withColumn("text_hash", F.xxhash64("text"))
    bare = keyed.select("doc_id", "text_hash", "text")
    occurrences = cut(anchor_table(bare, length, gram), "anchors")
    spans = cut(repeated_spans(bare, occurrences, length), "repeated")
    marks = occurrences.join(spans, ["anchor", "span"]).select("doc_id", "text_hash", "first", "windows", "bits")
    return _per_document(keyed, marks, ["first", "windows", "bits"], "left").drop("text_hash")


def _gone(text: bytes, words: int, marks: pa.Scalar, length: int) -> np.ndarray:
    if marks.values is None:
        return np.zeros(words, bool)
    first, windows, bits = (marks.values.field(k).to_numpy(zero_copy_only=False) for k in ("first", "windows", "bits"))
    return covered(words, first, windows, bits, length)


def removed_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the words kept, joined by a space).

    Null and empty texts have no words. Texts shorter than a window lose nothing; very long ones are read whole. Repeated rows are copies
    of each other, so all of their windows repeat. Null ids are ids like any other. An empty table gives no rows; other columns are not read.
    """
    require(docs, id_col, text_col)
    small_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n_words, n_removed, shas = [], [], []
        for text, marks in zip(as_bytes(batch.column(1)), batch.column(2)):
            words = text.split()
            gone = _gone(text, len(words), marks, length)
            kept = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    marked = _marked(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), length, gram)
    id_type = docs.schema[id_col].dataType.simpleString()
    return map_arrow(marked.select("doc_id", "text", "marks"), run, f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeated passages cut out of the text; what is left keeps its own white space.

    Documents of which nothing is left stay, with an empty text, so that no document is lost here; all other columns stay.
    Nulls stay null.
    """
    require(docs, id_col, text_col)
    small_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = []
        for text, marks in zip(batch.column(0).cast(pa.large_binary()).to_pylist(), batch.column(1)):
            if text and marks.values is not None:
                places = [m.span() for m in _WORD.finditer(text)]
                gone = _gone(text, len(places), marks, length)
                if gone.any():
                    # A kept word goes with the white space before it, unless the word before it is gone: then a space.
                    out = [text[(places[i - 1][1] if i and not gone[i - 1] else places[i][0]) : places[i][1]] if not gone[i] else b"" for i in range(len(places))]
                    runs = [b" " + x if x and i and gone[i - 1] else x for i, x in enumerate(out)]
                    text = b"".join(runs).lstrip()
            texts.append(text)
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(texts, pa.large_binary()).cast(pa.string())], [*batch.schema.names[2:], "_kept"])

    renamed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(*docs.columns).alias("row"))
    marked = _marked(renamed, length, gram)
    others = [c for c in docs.columns if c != text_col]
    flat = marked.select("text", "marks", *[F.col("row")[c].alias(f"c{i}") for i, c in enumerate(others)])
    schema = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(others))
    done = map_arrow(flat, run, f"{schema}, _kept string" if schema else "_kept string")
    names = {c: f"c{i}" for i, c in enumerate(others)} | {text_col: "_kept"}
    return done.select(*[F.col(names[c]).alias(c) for c in docs.columns])
