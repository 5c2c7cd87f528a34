"""Audit of how filters act on each other, over every order in which they may run.

A document is reduced to a mask: one bit per filter that it fails and one per flag of its label.
A wide packed counter is one big integer of many 64-bit fields, a field for every (order, step,
measure); each mask has such an integer with the outcome of one document in every field. Masks
are counted per part before the shuffle, so at most 2^7 rows a part remain; a part's integer is
the sum of count times the mask's integer. A field holds a count of documents, which is below
2^63, and no field is ever above the number of documents, so no sum carries into its neighbour.
The integer is unpacked into one row for every order and step.

Filter E (an equal text under a smaller id) needs the whole table: equal texts are counted by
(text, part, mask, id) before they meet, so a text that fills a third of the table arrives as a
few counted rows.

Defined cases: a null text is empty; a null part is the part with the empty name; a row without
an id has no smaller one and is none (it neither fails E nor makes others fail); rows of equal id
and text do not fail E against each other; a document is good or toxic if any label row of its id
says so; an empty table gives no rows; further columns are ignored. Words are maximal runs of
`[^\\x20\\x09-\\x0D]`, case-sensitive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.shared import batch_words, slices, stored

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT, MAX_UPPER = 50, 3  # per cent
MARKS = b"#$%&*|"
GOOD, TOXIC = 1 << len(FILTERS), 2 << len(FILTERS)
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
FIELD = 8  # bytes
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def text_masks(texts: pa.Array) -> np.ndarray:
    """Bits of the filters A to D that each text fails."""
    texts = pc.fill_null(texts, "")
    n_texts = len(texts)
    word, distinct, n_words = batch_words(texts)
    text_of = np.repeat(np.arange(n_texts), n_words)
    pairs = np.unique(text_of * max(len(distinct), 1) + word)
    n_distinct = np.bincount(pairs // max(len(distinct), 1), minlength=n_texts)
    blob = pa.array(texts, pa.large_binary()) if pa.types.is_large_string(
        texts.type) else texts.cast(pa.binary())
    size = pc.binary_length(blob).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(blob.to_pylist()), np.uint8)
    edge = np.concatenate([[0], np.cumsum(size)])

    def count(of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of)])
        return total[edge[1:]] - total[edge[:-1]]

    upper = count((data >= ord("A")) & (data <= ord("Z")))
    points = count((data & 0xC0) != 0x80)
    marks = count(np.isin(data, np.frombuffer(MARKS, np.uint8)))
    fails = (n_words < MIN_WORDS, 100 * n_distinct < MIN_DISTINCT * n_words,
             100 * upper > MAX_UPPER * points, marks > 0)
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def masked(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text and mask of the filters A to D of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = pc.fill_null(batch.column("text"), "")
            digest = [hashlib.sha256(t.encode()).digest() for t in texts.to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "part": pc.fill_null(batch.column("part"), ""),
                "digest": pa.array(digest, pa.binary()),
                "mask": pa.array(text_masks(texts), pa.int32())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("lang").cast("string").alias("part"), "text").mapInArrow(
        run, "doc_id long, part string, digest binary, mask int")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n): documents of each part by the filters they fail and their flags."""
    flags = labels.where("doc_id is not null").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(
        (F.when(F.max((F.col("quality") == 1).cast("int")) == 1, GOOD).otherwise(0)
         + F.when(F.max((F.col("toxic") == 1).cast("int")) == 1, TOXIC).otherwise(0))
        .alias("flags")).where("flags > 0")
    rows = stored(masked(docs), "masks")
    # Only ids that are there meet the labels: rows without one would all go to one task.
    named = rows.where("doc_id is not null").join(flags, "doc_id", "left").select(
        "doc_id", "part", "digest",
        (F.col("mask") + F.coalesce("flags", F.lit(0))).alias("mask"))
    same = named.groupBy("digest", "part", "mask", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    texts = same.groupBy("digest", "part", "mask").agg(
        F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    smallest = texts.groupBy("digest").agg(F.min("first.doc_id").alias("smallest"))
    firsts = F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    both = texts.join(smallest, "digest").select("part", F.explode(F.array(
        F.struct(F.col("mask"), firsts.alias("n")),
        F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"),
                 (F.col("n") - firsts).alias("n")))).alias("row")).select("part", "row.*")
    unnamed = rows.where("doc_id is null").select("part", "mask", F.lit(1).cast("long").alias("n"))
    return both.union(unnamed).groupBy("part", "mask").agg(F.sum("n").alias("n"))


def outcomes(mask: int) -> np.ndarray:
    """(orders, steps, measures): what happens to one document of this mask."""
    fails = [bool(mask >> i & 1) for i in range(len(FILTERS))]
    out = np.zeros((len(ORDERS), len(FILTERS), len(MEASURES)), np.uint64)
    for o, order in enumerate(ORDERS):
        gone = False
        for s, letter in enumerate(order):
            failing = fails[FILTERS.index(letter)]
            here = failing and not gone
            redundant = failing and gone
            gone = gone or failing
            out[o, s] = (not gone, here, redundant, failing and sum(fails) == 1,
                         here and bool(mask & GOOD), here and bool(mask & TOXIC))
    return out


def packed(mask: int) -> int:
    """The wide counter of one document: its outcomes in 64-bit fields, the first one lowest."""
    return int.from_bytes(outcomes(mask).astype("<u8").tobytes(), "little")


def unpacked(counter: int) -> np.ndarray:
    """(orders, steps, measures) of the fields of a wide counter."""
    shape = (len(ORDERS), len(FILTERS), len(MEASURES))
    size = int(np.prod(shape)) * FIELD
    return np.frombuffer(counter.to_bytes(size, "little"), "<u8").reshape(shape).astype(np.int64)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step with the counts of MEASURES and shapley.

    shapley is the number of documents that the step's filter removes, summed over all orders.
    """
    def run(rows: pa.Table) -> pa.Table:
        total = sum(n * packed(m) for m, n in zip(rows.column("mask").to_pylist(),
                                                  rows.column("n").to_pylist(), strict=True))
        found = unpacked(total)
        letters = np.array([[FILTERS.index(x) for x in order] for order in ORDERS])
        removed = found[:, :, MEASURES.index("removed")]
        shapley = np.bincount(letters.ravel(), weights=removed.ravel(),
                              minlength=len(FILTERS)).astype(np.int64)
        steps = len(FILTERS)
        return pa.table({
            "part": pa.array([rows.column("part")[0].as_py()] * len(ORDERS) * steps),
            "filter_order": pa.array(np.repeat(ORDERS, steps).tolist()),
            "step": pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(ORDERS))),
            **{m: pa.array(found[:, :, i].ravel()) for i, m in enumerate(MEASURES)},
            "shapley": pa.array(shapley[letters].ravel())})

    return mask_counts(docs, labels).groupBy("part").applyInArrow(
        run, "part string, filter_order string, step int, "
        + ", ".join(f"{m} long" for m in (*MEASURES, "shapley")))
