"""Document fingerprints of closed syncmers.

A k-mer of code points is chosen if the least of the hashes of its inner s-mers is that of its first or its last one. Whether it is
chosen depends on the k-mer alone, so equal passages have equal anchors wherever they stand. A document's fingerprint is the
bottom of its anchors' hashes; likeness estimates the share of anchors in common (Jaccard).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.llm.common import as_texts, map_arrow, require, small_batches
from ostinato.llm.hashing import BASE, ODD, mixed, run_hashes, sliding_min

K, S, BOTTOM = 24, 8, 128


def inner_hashes(text: str, s: int = S) -> np.ndarray:
    """The hash of each run of ``s`` code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return run_hashes(mixed(points * ODD + BASE), s)


def chosen_kmers(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the closed syncmers of a text; a short text may have none."""
    if len(text) < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    inner = inner_hashes(text, s)
    least = sliding_min(inner, k - s + 1)
    n = len(least)
    places = np.flatnonzero((inner[:n] == least) | (inner[k - s :] == least))
    whole = inner[places]
    for at in [*range(s, k - s, s), k - s]:
        whole = mixed(whole * BASE + inner[places + at])
    return places, whole


def or_itself(text: str, places: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text without closed syncmers, if not empty, has itself as its only anchor, at place 0."""
    if len(places) or not text:
        return places, hashes
    return np.zeros(1, np.int64), np.array([xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))], np.uint64)


def closed_syncmers(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of a text's anchors."""
    return or_itself(text, *chosen_kmers(text, k, s))


def sketch(hashes: np.ndarray, bottom: int = BOTTOM) -> np.ndarray:
    """The least distinct hashes, by their high 32 bits, in order."""
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))[:bottom]


def likeness(a: np.ndarray, b: np.ndarray, bottom: int = BOTTOM) -> float:
    """Estimated Jaccard likeness of what two sketches stand for; two empty texts: 1."""
    ends = [x[-1] for x in (a, b) if len(x) >= bottom]
    if ends:
        a, b = a[a <= min(ends)], b[b <= min(ends)]
    common = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - common
    return common / union if union else 1.0


def true_likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two texts' distinct anchors; two empty texts: 1."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - common
    return common / union if union else 1.0


def as_string(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def from_string(value: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(value), ">u4").astype(np.uint32)


def syncmer_anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S) -> DataFrame:
    """(doc_id, place, hash) of every anchor of every text, for positional matching: join on hash.

    Empty and null texts have none; very long texts have all of theirs. Of equally least inner hashes any at an edge counts. Repeated rows
    have their anchors each, and null ids stay. An empty table gives no rows; other columns are not read.
    """
    require(docs, id_col, text_col)
    small_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, text in enumerate(as_texts(batch.column(1))):
            places, hashes = closed_syncmers(text, k, s)
            if len(places):
                ids = batch.column(0).take(pa.array(np.full(len(places), i)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(places.astype(np.int32)), pa.array(hashes.view(np.int64))], ["doc_id", "place", "hash"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {id_type}, place int, hash long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every text; null texts are empty, and an empty text's fingerprint is empty."""
    require(docs, id_col, text_col)
    small_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = as_texts(batch.column(1))
        prints = [as_string(sketch(closed_syncmers(x)[1])) for x in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(prints, pa.string())], ["doc_id", "n_chars", "fingerprint"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {id_type}, n_chars long, fingerprint string")


def beside_next(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) dealt into ranges of doc_id, each in descending order in one task and ended by a copy of the next range's
    first row (``extra``), so that every row's successor follows it. After the last comes the first. One shuffle of the texts.

    The ranges' bounds and first ids come to the driver: their number is some times that of shuffle partitions.
    """
    spark = docs.sparkSession
    ranges = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    splits = [-float("inf"), *sorted(set(map(float, cuts)) or {0.0}), float("inf")]
    named = docs.withColumn("_id", F.col("doc_id").cast("double"))
    # Null ids come last: their range is below all others.
    dealt = Bucketizer(splits=splits, inputCol="_id", outputCol="_bucket", handleInvalid="keep").transform(named)
    dealt = dealt.withColumn("bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("_bucket").cast("int") + 1)).drop("_id", "_bucket")
    heads = sorted(dealt.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect(), reverse=True, key=lambda r: r["bucket"])
    if not heads:
        return docs.select("doc_id", "text", F.lit(0).alias("bucket"), F.lit(False).alias("extra"))
    # The head of a range also goes to the range above; that of the highest one goes to the lowest.
    to = [-1] * (len(splits) + 1)
    first = [None] * len(to)
    for above, own in zip([heads[-1], *heads], heads):
        to[own["bucket"]], first[own["bucket"]] = above["bucket"], own["head"]
    array = lambda values, kind: F.array(*[F.lit(v).cast(kind) for v in values])
    of = lambda values, kind: F.get(array(values, kind), F.col("bucket"))
    is_head = F.col("doc_id").eqNullSafe(of(first, docs.schema["doc_id"].dataType))
    place = lambda bucket, extra: F.struct(bucket.cast("int").alias("bucket"), F.lit(extra).alias("extra"))
    own = place(F.col("bucket"), False)
    places = F.when(is_head, F.array(own, place(of(to, "int"), True))).otherwise(F.array(own))
    spread = dealt.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.*")
    order = ["bucket", "extra", F.desc_nulls_last("doc_id"), "text"]
    return spread.repartition("bucket").sortWithinPartitions(*order)


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit, whose last third is the next text's beginning (descending ids, in a circle).

    One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_anchors. The
    fingerprints are sketches; near_edited and near_next compare all n_anchors distinct anchors of the text. Null texts are empty; the order is by descending id, null ids last, equal ids by text. A lone document follows itself. Repeated rows each give
    a row. An empty table gives none. Other columns are not read.
    """
    require(docs, id_col, text_col)
    small_batches(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_anchors"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []
        for batch in batches:
            for doc_id, text, bucket, extra in zip(batch.column(0).to_pylist(), as_texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if extra and held is None:
                    continue  # rows with the same id as the next range's first
                places, hashes = chosen_kmers(text)
                anchors = np.unique(or_itself(text, places, hashes)[1])
                if held is not None and held[0] == bucket:
                    rows.append(_row(held, text, anchors))
                held = None if extra else (bucket, doc_id, text, places, hashes, anchors)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []

    kind = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("n_chars", pa.int64()), *((n, pa.string()) for n in names[2:5]), *((n, pa.float64()) for n in names[5:7]), ("n_anchors", pa.int64())])
    source = beside_next(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    return source.select("doc_id", "text", "bucket", "extra").mapInArrow(run, f"doc_id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_anchors long")


def edited_text(text: str, following: str) -> str:
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def edited_hashes(text: str, edited: str, places: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The anchors of the edited text, of which those that lie whole in what is left of the text are known already."""
    stays = len(text) - len(text) // 3
    if stays < K:
        return closed_syncmers(edited)[1]
    old = places <= stays - K
    new_places, new = chosen_kmers(edited[stays - K + 1 :])
    return or_itself(edited, np.r_[places[old], new_places + stays - K + 1], np.r_[hashes[old], new])[1]


def _row(held: tuple, following: str, next_anchors: np.ndarray) -> dict:
    _, doc_id, text, places, hashes, own = held
    edited = edited_text(text, following)
    edited_anchors = own if edited == text else np.unique(edited_hashes(text, edited, places, hashes))
    return {
        "doc_id": doc_id,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": as_string(sketch(own)),
        "edited_fingerprint": as_string(sketch(edited_anchors)),
        "near_edited": true_likeness(own, edited_anchors),
        "near_next": true_likeness(own, next_anchors),
        "n_anchors": len(own),
    }
