"""Token ids as flat unsigned files with 64-bit document offsets, read back by memory map.

A folder holds, for each part: ``part-N.ids`` (little-endian ids, 16 bits if the vocabulary fits, else 32), ``part-N.offsets``
(64-bit starts of its documents in the part, and the end) and ``part-N.docs`` (64-bit document ids, then one byte each that is 1
for a null id). Parts follow each other in ascending document order. ``manifest.json`` has the width and, for each part, its
numbers of documents and ids and its base: the ids of all parts before it, a prefix sum over parts.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.llm.common import as_texts, require, scratch_path, small_batches
from ostinato.llm.tokens import encoder

END = 0


def _put(folder: str, name: str, chunks) -> None:
    """Writes a file whole: under a name of this attempt first, so that lost or repeated tasks leave no half of one."""
    files, root = fs.FileSystem.from_uri(folder)
    context = TaskContext.get()
    own = f"{root}/.{name}.{context.taskAttemptId() if context else 'driver'}"
    with files.open_output_stream(own) as out:
        for chunk in chunks:
            out.write(chunk)
    try:
        files.move(own, f"{root}/{name}")
    except OSError:
        # Another attempt of the same task was first; its content is the same.
        if files.get_file_info(f"{root}/{name}").type != fs.FileType.File:
            raise
        files.delete_file(own)


def _read(folder: str, name: str, kind: str) -> np.ndarray:
    """The file as an array: by memory map where it is local, else by one read of this part."""
    files, root = fs.FileSystem.from_uri(folder)
    path = f"{root}/{name}"
    if files.get_file_info(path).size == 0:
        return np.empty(0, kind)
    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with files.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encodes every text, appends id 0, and writes the files into ``folder`` (a URI that all executors reach) -> the manifest.

    Documents lie in ascending order of id, nulls first, equal ids by text; each row is written, repeats too. Null texts are
    empty: the end id alone. An empty table gives a manifest without parts. Ids must be whole numbers. Other columns are not read.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    small_batches(spark)
    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        end, size = np.array([END], own.kind).tobytes(), own.kind.itemsize
        name, ids, nulls, offsets = f"part-{TaskContext.get().partitionId():06d}", [], [], [0]

        def encoded() -> Iterator[bytes]:
            for batch in batches:
                ids.extend(batch.column(0).fill_null(0).to_pylist())
                nulls.append(np.asarray(batch.column(0).is_null(), dtype=np.uint8))
                for data in own.ids_of(as_texts(batch.column(1))):
                    data += end
                    offsets.append(offsets[-1] + len(data) // size)
                    yield data

        _put(folder, f"{name}.ids", encoded())
        if ids:
            _put(folder, f"{name}.offsets", [np.array(offsets, "<i8").tobytes()])
            _put(folder, f"{name}.docs", [np.array(ids, "<i8").tobytes(), *(x.tobytes() for x in nulls)])
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(ids)], pa.int64()), pa.array([offsets[-1]], pa.int64()), pa.array([size], pa.int32())], ["name", "documents", "ids", "width"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    in_order = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    # One row per file comes to the driver: their number is that of partitions, not of documents.
    parts = sorted(in_order.mapInArrow(run, "name string, documents long, ids long, width int").collect())
    bases = accumulate((p["ids"] for p in parts), initial=0)
    manifest = {"width": parts[0]["width"] if parts else 2, "parts": [{"name": p["name"], "documents": p["documents"], "ids": p["ids"], "base": b} for p, b in zip(parts, bases)]}
    _put(folder, "manifest.json", [json.dumps(manifest).encode()])
    return manifest


def read_manifest(folder: str) -> dict:
    files, root = fs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def open_part(folder: str, manifest: dict, part: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, document ids, null flags) of one part."""
    n, name = part["documents"], part["name"]
    docs = _read(folder, f"{name}.docs", "u1")
    ids = _read(folder, f"{name}.ids", f"<u{manifest['width']}")
    return ids, _read(folder, f"{name}.offsets", "<i8"), docs[: 8 * n].view("<i8"), docs[8 * n :]


def document_ids(folder: str, manifest: dict, position: int) -> np.ndarray:
    """The ids of the document at ``position`` in the whole order: two look-ups and a slice of a memory map."""
    counts = np.cumsum([0, *(p["documents"] for p in manifest["parts"])])
    at = int(np.searchsorted(counts, position, "right")) - 1
    ids, offsets, _, _ = open_part(folder, manifest, manifest["parts"][at])
    i = position - counts[at]
    return ids[offsets[i] : offsets[i + 1]]


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all before it), n_tokens, ids_crc32 of its ids as 32 bits each."""
    manifest = read_manifest(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                part = manifest["parts"][at]
                ids, offsets, docs, nulls = open_part(folder, manifest, part)
                for i in range(0, len(docs), 10_000):
                    ends = np.array(offsets[i : i + 10_001])
                    crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                    who = pa.array(np.array(docs[i : i + 10_000]), mask=np.array(nulls[i : i + 10_000]) == 1)
                    yield pa.RecordBatch.from_arrays([who, pa.array(ends[:-1] + part["base"]), pa.array(np.diff(ends)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    count = len(manifest["parts"])
    return spark.range(0, count, 1, max(1, count)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Writes ``docs`` and reads the files back."""
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, folder, tokenizer)
    return read_tokens(docs.sparkSession, folder)
