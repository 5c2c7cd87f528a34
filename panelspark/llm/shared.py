"""Helpers of this package: shared folders, stored tables, words and 64-bit mixing.

Words are maximal runs of `[^\\x20\\x09-\\x0D]` everywhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from panelspark.session import use_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
SLICE_BYTES = 8 << 20


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder URI below the shared folder that spark.checkpoint.dir names."""
    base = use_checkpoint_dir(spark)
    if base is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written once as Parquet in the shared folder and read again."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until the table has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mounted_path(uri: str) -> str:
    """The file-system path of a folder that every node mounts; memory maps need one."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{uri}: memory-mapped files need a shared folder that is mounted "
                         "on every node, given as a path or a file: URI")
    return unquote(parts.path)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds about `most` bytes of the text column."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(
            zero_copy_only=False)
        ends, start = np.cumsum(size), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (two multiply and xor-shift rounds), applied to uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def string_hash(values: pa.Array) -> np.ndarray:
    """Fixed 64-bit hashes of distinct strings, the same in every process."""
    from pandas.util import hash_array

    return hash_array(np.array(values.to_pylist(), dtype=object), categorize=False)


def batch_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of a text column: index of each word in the distinct words, these, words per text.

    Null texts have no words.
    """
    texts = pc.fill_null(texts, "")
    spaced = texts
    for gap in "\t\n\x0b\x0c\r":
        spaced = pc.replace_substring(spaced, gap, " ")
    lists = pc.split_pattern(spaced, " ")
    flat = lists.values
    full = pc.not_equal(pc.binary_length(flat), 0)
    doc = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    counts = np.bincount(doc[full.to_numpy(zero_copy_only=False)], minlength=len(texts))
    coded = flat.filter(full).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, counts
