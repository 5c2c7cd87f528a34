"""Token ids in flat binary files with 64-bit document offsets, memory-mapped for reading.

Format. A folder holds, for each partition p of the documents in ascending doc_id order,
`p.ids` (little-endian unsigned ids of every document, one after another), `p.offsets`
(documents + 1 little-endian int64 positions in `p.ids`, counted in ids) and `p.docs` (int64
document ids). `index.json` has the type of an id (uint16 where the vocabulary fits, else
uint32) and the partitions with their documents, ids and bases: the base of a partition is the
prefix sum of the ids before it, so base + offset is a place in the whole corpus.

A file is written under the name of its task attempt and renamed when complete, so a repeated
or speculative task leaves the same files. Defined cases: null text is an empty document (only
its end id); an empty table gives an index without partitions; rows with equal doc_id are
documents of their own, ordered by text; a null doc_id comes first and is written as the
smallest int64; further columns are ignored. A document of any length goes to one file.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.shared import mounted_path, new_folder, slices
from panelspark.llm.word_tokens import worker_encoder

NO_ID = np.iinfo(np.int64).min


def _store(folder: str, name: str, attempt: int, parts: dict[str, np.ndarray]) -> None:
    for kind, values in parts.items():
        with open(path := f"{folder}/.{name}.{kind}.{attempt}", "wb") as out:
            values.tofile(out)
        os.replace(path, f"{folder}/{name}.{kind}")


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int,
                      folder: str | None = None) -> str:
    """Encode documents(doc_id, text) and write the folder; returns its URI.

    Documents are dealt by ranges of doc_id (ranges from a sample of the keys; adaptive
    execution merges neighbouring small ones) and sorted inside a partition.
    """
    spark = docs.sparkSession
    uri = folder or new_folder(spark, "tokens")
    root = mounted_path(uri)
    os.makedirs(root, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encoder = TaskContext.get(), worker_encoder(vocabulary)
        width = np.dtype("<u2" if encoder.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        name, attempt = f"{task.partitionId():06d}", task.taskAttemptId()
        sizes, ids_of = [], []
        with open(path := f"{root}/.{name}.ids.{attempt}", "wb") as out:
            for batch in slices(batches):
                ids, per_text = encoder.encode(batch.column("text"), end_id)
                ids.astype(width).tofile(out)
                sizes.append(per_text)
                ids_of.append(batch.column("doc_id").fill_null(NO_ID).to_numpy())
        if not sizes:
            os.remove(path)
            return
        os.replace(path, f"{root}/{name}.ids")
        lengths = np.concatenate(sizes)
        _store(root, name, attempt, {
            "offsets": np.concatenate([[0], np.cumsum(lengths)]).astype("<i8"),
            "docs": np.concatenate(ids_of).astype("<i8")})
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([task.partitionId()], pa.int32()), "documents": [len(lengths)],
            "ids": [int(lengths.sum())], "width": pa.array([width.itemsize], pa.int32())})

    dealt = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
             .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    rows = sorted(map(tuple, dealt.mapInArrow(
        write, "part int, documents long, ids long, width int").collect()))  # a row per file
    bases = np.cumsum([0] + [r[2] for r in rows]).tolist()
    index = {"id_bytes": rows[0][3] if rows else 2, "partitions": [
        {"part": p, "documents": d, "ids": n, "base": b}
        for (p, d, n, _), b in zip(rows, bases, strict=False)]}
    with open(f"{root}/index.json", "w") as out:
        json.dump(index, out)
    return uri


def open_partition(root: str, part: int, id_bytes: int
                   ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Memory maps of one partition: ids, offsets, document ids."""
    name = f"{root}/{part:06d}"
    offsets = np.memmap(f"{name}.offsets", "<i8", "r")
    docs = np.memmap(f"{name}.docs", "<i8", "r")
    ids = np.memmap(f"{name}.ids", f"<u{id_bytes}", "r") if offsets[-1] else np.zeros(0, "<u2")
    return ids, offsets, docs


def read_token_files(spark: SparkSession, uri: str, with_ids: bool = True) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 and its ids.

    ids_crc32 is the CRC-32 of the ids as little-endian uint32. A partition is read by one task
    through memory maps, in blocks of documents.
    """
    root = mounted_path(uri)
    with open(f"{root}/index.json") as f:
        index = json.load(f)
    id_bytes = index["id_bytes"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base in zip(batch.column("part").to_pylist(),
                                  batch.column("base").to_pylist(), strict=True):
                ids, offsets, docs = open_partition(root, part, id_bytes)
                for at in range(0, len(docs), 512):
                    edge = np.asarray(offsets[at:at + 513])
                    block = [np.asarray(ids[a:b]).astype("<u4")
                             for a, b in zip(edge[:-1], edge[1:], strict=True)]
                    doc = np.asarray(docs[at:at + 512])
                    out = {"doc_id": pa.array(doc, mask=doc == NO_ID),
                           "start": pa.array(base + edge[:-1]),
                           "n_tokens": pa.array(np.diff(edge)),
                           "ids_crc32": pa.array([zlib.crc32(x) for x in block], pa.int64())}
                    if with_ids:
                        out["ids"] = pa.array([x.view("<i4") for x in block],
                                              pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict(out)

    parts = spark.createDataFrame([(p["part"], p["base"]) for p in index["partitions"]],
                                  "part int, base long")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return parts.repartition(max(1, len(index["partitions"]))).mapInArrow(
        read, schema + ", ids array<int>" * with_ids)
