"""SimHash near-duplicates by multi-index hashing.

A fingerprint has two segments of 32 bits. Fingerprints that differ in at most three bits differ in at most one bit of one
segment, so the Hamming ball of radius one of each segment (33 probes) meets the other's segment in a table; full distances
decide. Equal fingerprints are one entry, and links hold between entries, so copies are never expanded into pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.llm.common import as_bytes, cut, map_arrow, require, small_batches
from ostinato.llm.components import connected_components

RADIUS = 3
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BITS = np.arange(64, dtype=np.uint64)


def shingles(text: bytes, size: int) -> list[bytes]:
    """Overlapping runs of ``size`` words, repeats included; fewer words give the whole sequence, none gives nothing."""
    words = text.translate(_LOWER).split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    if size == 3:
        return list(map(b"%b %b %b".__mod__, zip(words, words[1:], words[2:])))
    return [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """64 bits; a bit is set if over half of the shingles' XXH64 hashes have it; no words: zero."""
    grams = shingles(text, size)
    if not grams:
        return 0
    hashes = np.fromiter(map(functools.partial(xxhash.xxh64_intdigest, seed=seed), grams), np.uint64, len(grams))
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # bounds the unpacked bits of a long text
        part = np.ascontiguousarray(hashes[at : at + (1 << 14)].astype("<u8")).view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * set_in > len(hashes)).astype(np.uint64) << _BITS).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fp): ``fp`` is the fingerprint's bits as a signed long. Null texts are empty texts: fingerprint zero."""
    require(docs, id_col, text_col)
    small_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values = np.array([fingerprint(x, size, seed) for x in as_bytes(batch.column(2))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values)], ["doc_id", "text_hash", "fp"])

    id_type = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return map_arrow(own, run, f"doc_id {id_type}, text_hash long, fp long")


def _segments():
    """The two segments of ``fp`` as (segment, value)."""
    low, high = F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32)
    return low, high


def near_links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> links (u, v), u < v, of those at Hamming distance 1 to 3; each pair once."""
    low, high = _segments()
    entry = lambda segment, value: F.struct(F.lit(segment).alias("segment"), value.alias("value"))
    table = fps.select(F.col("fp").alias("v"), F.explode(F.array(entry(0, low), entry(1, high))).alias("e")).select("v", "e.*")
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(32)])
    ball = lambda segment, value: F.transform(masks, lambda m: entry(segment, value.bitwiseXOR(m)))
    probes = fps.select(F.col("fp").alias("u"), F.explode(F.concat(ball(0, low), ball(1, high))).alias("e")).select("u", "e.*")
    differs = F.col("u").bitwiseXOR(F.col("v"))
    found = (F.col("u") < F.col("v")) & (F.bit_count(differs) <= RADIUS)
    # A pair that the low segments find already isn't found again by the high ones.
    found &= (F.col("p.segment") == 0) | (F.bit_count(differs.bitwiseAND(0xFFFFFFFF)) > 1)
    same = (F.col("p.segment") == F.col("t.segment")) & (F.col("p.value") == F.col("t.value"))
    return probes.alias("p").join(table.alias("t"), same & found).select("u", "v")


def _rooted(docs: DataFrame, id_col: str, text_col: str, size: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The documents' fingerprints, and (fp, least, root) for each distinct one; least: its smallest doc_id."""
    own = cut(fingerprints(docs, id_col, text_col, size, seed), "fingerprints")
    classes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = connected_components(near_links(classes.select("fp")))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left")
    return own, cut(rooted.select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id reachable over links, itself included).

    Null and empty texts have fingerprint zero and link like any other. Repeated rows each keep their row. A null doc_id counts
    as no id: its row is kept, and it gives its component no name unless no member has an id (then null). An empty table gives
    no rows. Very long texts are read whole. Columns other than the two named are not read.
    """
    own, rooted = _rooted(docs, id_col, text_col, size, seed)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(named, "root").select("fp", "component_id")
    return own.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id (a null id is the largest).

    Of repeated ids in a component, the one with the least text hash stays; of rows with the same id and text, any one.
    Columns, also extra ones, and types stay. An empty table stays empty.
    """
    own, rooted = _rooted(docs, id_col, text_col, size, seed)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    leaders = own.join(rooted.select("fp", "root"), "fp").groupBy("root").agg(F.min(order).alias("r"))
    leaders = cut(leaders.select(F.col("r.doc_id").alias("_id"), F.col("r.text_hash").alias("_hash")), "leaders")
    hashed = F.xxhash64(docs[text_col])
    kept = docs.join(leaders, docs[id_col].eqNullSafe(leaders["_id"]) & (hashed == leaders["_hash"]), "left_semi")
    repeated = own.groupBy("doc_id", "text_hash").count().where("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates([id_col, text_col])
