"""Stupid-backoff scores of documents under n-gram counts of the whole corpus.

The score of a word after its context is count(context word) / count(context) where that n-gram
occurs, else BACKOFF times the score after the context without its first word, down to the
share of the word among all words. Counts leave out the document's own occurrences, so a text
is judged by what the rest of the corpus says. A document's score is the mean of the natural
logarithms over its words. Corpus and scored documents are the same table here; the counts come
from all of it.

The relations, in packed rows so that a row costs some bytes and not some dozen:

* blocks(block, documents, words): some megabytes of documents, their words coded by the
  block's distinct words; written once.
* requests(part, block, hashes, counts): the distinct n-grams of a block, exploded by the high
  bits of their 64-bit hash into parts, each with its count in the block.
* counts(part): a part is summed over all blocks (the n-gram count table, partitioned by hash),
  joined to the requests of its blocks by hash, and answered block by block.
* The answers meet their block again, and the scores of its documents are summed.

A frequent n-gram has one row in each block, not one per document, so no part grows with it.

Defined cases: null and empty texts and those without words have n_words 0 and a null score;
words that no other document has get the share 1 / (corpus words + 1); rows with equal doc_id
are documents of their own (a copy is another document and counts); an empty table gives no
rows; further columns are ignored; a very long text is a block of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.shared import batch_words, mix, slices, stored, string_hash

ORDER = 2
BACKOFF = 0.4
PART_WORDS = 1 << 21
BLOCK_BYTES = 8 << 20


def pack_ints(values: np.ndarray) -> bytes:
    """Non-negative integers as planes of bytes, lowest first, as many as the largest needs.

    Planes let the shuffle's compressor see that high bytes repeat.
    """
    values = values.astype("<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack_ints(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :data[0]] = planes.T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def unpack_counts(data: bytes) -> np.ndarray:
    return unpack_ints(data).astype(np.int64)


def squeezed(data: bytes) -> bytes:
    """Zstandard bytes after their length: frequent words have small codes, which compress."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd").compress(data, asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(
        data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def blocks(docs: DataFrame) -> DataFrame:
    """block, doc_ids, lengths, hashes and codes of documents(doc_id, text).

    lengths are words per document, hashes those of the block's distinct words from the most to
    the least frequent, codes each word's place among them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=BLOCK_BYTES):
            index, distinct, lengths = batch_words(batch.column("text"))
            often = np.argsort(-np.bincount(index, minlength=len(distinct)), kind="stable")
            place = np.empty(len(often), np.int64)
            place[often] = np.arange(len(often))
            hashes = string_hash(distinct)[often] if len(often) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_pydict({
                "block": [uuid.uuid4().bytes],
                "doc_ids": pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                "lengths": pa.array([lengths.tolist()], pa.list_(pa.int64())),
                "hashes": [pack_ints(hashes)],
                "codes": [squeezed(pack_ints(place[index] if len(index) else index))]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "block binary, doc_ids array<long>, lengths array<long>, hashes binary, "
             "codes binary")


def grams(hashes: np.ndarray, codes: np.ndarray, lengths: np.ndarray, order: int
          ) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to order: (position of the last word, hash) of each n-gram inside a document."""
    word = hashes[codes] if len(codes) else np.zeros(0, np.uint64)
    begin = np.repeat(np.cumsum(lengths) - lengths, lengths)
    at, run = np.arange(len(word)), mix(word + np.uint64(1))
    out = [(at, run)]
    for n in range(2, order + 1):
        # run[i] is the hash of the n - 1 words that end at i; the n-gram adds the word after it.
        at = at[at - (n - 1) >= begin[at]]
        longer = np.zeros(len(word), np.uint64)
        longer[at] = mix(run[at - 1] * np.uint64(31) + word[at] + np.uint64(n))
        run = longer
        out.append((at, run[at]))
    return out


def _block(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (unpack_ints(row["hashes"]), unpack_counts(unsqueezed(row["codes"])),
            np.array(row["lengths"], np.int64))


def _parts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Edges of the parts (the top bits) in sorted hashes."""
    if not bits:
        return np.array([0, len(keys)])
    edge = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, edge), [len(keys)]])


def requests(table: DataFrame, order: int, bits: int) -> DataFrame:
    """part, block, hashes (sorted) and counts of the distinct n-grams of each block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = grams(*_block(row), order)
                keys, n = np.unique(np.concatenate([g for _, g in found]), return_counts=True)
                edge = _parts(keys, bits)
                for p in np.flatnonzero(np.diff(edge)).tolist():
                    span = slice(edge[p], edge[p + 1])
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array([p], pa.int32()), "block": [row["block"]],
                        "hashes": [pack_ints(keys[span])],
                        "counts": [pack_ints(n[span])]})

    return table.select("block", "lengths", "hashes", "codes").mapInArrow(
        run, "part int, block binary, hashes binary, counts binary")


def answers(asked: DataFrame) -> DataFrame:
    """part, block and corpus counts in the order of the request's hashes."""
    def run(group: pa.Table) -> pa.Table:
        keys = [unpack_ints(x) for x in group.column("hashes").to_pylist()]
        counts = [unpack_counts(x) for x in group.column("counts").to_pylist()]
        known, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])[:-1]
        return pa.table({"part": group.column("part"), "block": group.column("block"),
                         "counts": pa.array([pack_ints(total[x]) for x in np.split(at, ends)],
                                            pa.binary())})

    return asked.groupBy("part").applyInArrow(run, "part int, block binary, counts binary")


def own_counts(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each entry, how often its key occurs in its document."""
    order = np.argsort(mix(key ^ mix(doc.astype(np.uint64) + np.uint64(1))))
    mixed = mix(key ^ mix(doc.astype(np.uint64) + np.uint64(1)))[order]
    change = np.concatenate([[True], mixed[1:] != mixed[:-1]])
    run = np.cumsum(change) - 1
    out = np.empty(len(key), np.int64)
    out[order] = np.bincount(run)[run]
    return out


def block_scores(row: dict, order: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of logarithms and words of the documents of a block with its answers."""
    hashes, codes, lengths = _block(row)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    found = grams(hashes, codes, lengths, order)
    keys = np.unique(np.concatenate([g for _, g in found]))
    answer = sorted(row["answers"], key=lambda a: a["part"])
    total = np.concatenate([unpack_counts(a["counts"]) for a in answer]) if answer else np.zeros(
        0, np.int64)
    rest = words - lengths[doc]  # words of the other documents
    left = []  # counts without the document's own, by position of the last word
    for at, key in found:
        c = np.zeros(len(doc), np.int64)
        c[at] = total[np.searchsorted(keys, key)] - own_counts(doc[at], key)
        left.append(c)
    log = np.where(left[0] > 0, np.log(np.maximum(left[0], 1) / np.maximum(rest, 1)),
                   -np.log(rest + 1.0))
    for n in range(2, order + 1):
        # The context of the n-gram that ends at i is the (n - 1)-gram that ends at i - 1.
        context = np.concatenate([[0], left[n - 2][:-1]])
        at = found[n - 1][0]
        seen = np.zeros(len(doc), bool)
        seen[at] = left[n - 1][at] > 0
        has_context = np.zeros(len(doc), bool)
        has_context[at] = True
        log = np.where(seen, np.log(np.maximum(left[n - 1], 1) / np.maximum(context, 1)),
                       np.where(has_context, np.log(BACKOFF) + log, log))
    return np.bincount(doc, weights=log, minlength=len(lengths)), lengths


def scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, log_score (mean per word) and perplexity of documents(doc_id, text)."""
    table = stored(blocks(docs), "lm-blocks")
    words = table.select(F.sum(F.aggregate(
        "lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = max(4, (words * order // PART_WORDS).bit_length())
    asked = requests(table, order, bits)
    answered = answers(asked).groupBy("block").agg(
        F.collect_list(F.struct("part", "counts")).alias("answers"))  # one row per part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                row["answers"] = row["answers"] or []
                total, n = block_scores(row, order, words)
                mean = np.divide(total, n, out=np.full(len(n), np.nan), where=n > 0)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["doc_ids"], pa.int64()), "n_words": pa.array(n),
                    "log_score": pa.array(mean, mask=n == 0),
                    "perplexity": pa.array(np.exp(-mean), mask=n == 0)})

    return table.join(answered, "block", "left").mapInArrow(
        run, "doc_id long, n_words long, log_score double, perplexity double")
