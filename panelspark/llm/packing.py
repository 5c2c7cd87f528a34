"""Best-fit packing of token sequences by exact-complement hashing.

The plan is made on the histogram of piece lengths, which has at most `capacity` entries
whatever the corpus holds. The longest length left opens a sequence. Its gap is looked up among
the sums of one, two and three available lengths; a hit fills it exactly. Where no sum hits, the
longest length that fits goes in (best fit) and the smaller gap is looked up again. The same
sequence is then made as often as the availability counts allow.
Pieces then take their places by their rank among the pieces of equal length, so Spark does
the assignment without moving the ids.

Defined cases: a null text is an empty document of one id (its end id); an empty table gives no
rows; equal rows are pieces of their own; further columns are ignored by `pieces` and kept by
`pack`. Only documents longer than the capacity are cut.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.shared import slices, stored
from panelspark.llm.word_tokens import worker_encoder

Parts = tuple[int, ...]


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 4096,
           with_ids: bool = True) -> DataFrame:
    """Token pieces of documents(doc_id, text): doc_id, piece, start, length, ids_crc32, ids.

    A document is its ids and the end id, cut into pieces of `capacity` ids, the last one
    shorter. ids are little-endian uint32 bytes, left out without `with_ids`.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary)
        for batch in slices(batches):
            ids, lengths = encoder.encode(batch.column("text"), end_id)
            n = -(-lengths // capacity)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            size = np.minimum(capacity, lengths[row] - piece * capacity)
            edge = np.concatenate([[0], np.cumsum(size)])
            raw = memoryview(ids.astype("<u4")).cast("B")
            spans = [raw[4 * a:4 * b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
            out = {"doc_id": batch.column("doc_id").take(pa.array(row)),
                   "piece": pa.array(piece, pa.int32()), "start": pa.array(piece * capacity),
                   "length": pa.array(size),
                   "ids_crc32": pa.array([zlib.crc32(x) for x in spans], pa.int64())}
            if with_ids:
                out["ids"] = pa.array([x.tobytes() for x in spans], pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long"
        + ", ids binary" * with_ids)


class SumIndex:
    """Available lengths by their sums of one, two or three.

    Counts only fall, so the pointer of a sum to its largest live part only moves down and dead
    combinations are passed once. `held` counts the parts that the sequence being planned has.
    """

    def __init__(self, counts: np.ndarray):
        self.count = counts.astype(np.int64)
        self.pair_at, self.triple_at = np.arange(len(counts)), np.arange(len(counts))

    def enough(self, held: Counter, *parts: int) -> bool:
        return all(self.count[p] >= held[p] + parts.count(p) for p in parts)

    def single(self, gap: int, held: Counter) -> Parts | None:
        return (gap,) if self.enough(held, gap) else None

    def pair(self, gap: int, held: Counter, *also: int) -> Parts | None:
        a = np.arange(min(self.pair_at[gap], gap - 1), (gap - 1) // 2, -1)
        live = a[(self.count[a] > 0) & (self.count[gap - a] > (2 * a == gap))]
        self.pair_at[gap] = live[0] if len(live) else 0
        return next(((x, gap - x) for x in live.tolist()
                     if self.enough(held, x, gap - x, *also)), None)

    def triple(self, gap: int, held: Counter) -> Parts | None:
        a = np.arange(min(self.triple_at[gap], gap - 2), (gap - 1) // 3, -1)
        dead = True
        for x in a[self.count[a] > 0].tolist():
            rest = self.pair(gap - x, held, x)
            if rest:
                return (x, *rest)
            # Without any pair for the rest, the part is dead for this sum for good.
            dead = dead and not self.pair_at[gap - x]
            if dead:
                self.triple_at[gap] = x - 1
        return None

    def best_fit(self, gap: int, held: Counter) -> Parts | None:
        live = np.flatnonzero(self.count[:gap + 1])[::-1].tolist()
        return next(((x,) for x in live if self.enough(held, x)), None)

    def take(self, held: Counter) -> int:
        times = min(int(self.count[p]) // n for p, n in held.items())
        for p, n in held.items():
            self.count[p] -= times * n
        return times


def packing_plan(counts: dict[int, int], capacity: int) -> list[tuple[Parts, int]]:
    """Sequences as (lengths in order, how many of them), using every piece once.

    One sequence is planned at a time and repeated as often as the counts allow, which uses up
    at least one length; so the plan has some thousand entries for capacity 4096, however many
    pieces there are.
    """
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        histogram[length] = n
    index, plan = SumIndex(histogram), []
    for opener in range(capacity, 0, -1):
        while index.count[opener]:
            held, order, gap = Counter([opener]), [opener], capacity - opener
            while gap:
                more = (index.single(gap, held) or index.pair(gap, held)
                        or index.triple(gap, held) or index.best_fit(gap, held))
                if not more:
                    break
                held.update(more)
                order += more
                gap -= sum(more)
            plan.append((tuple(order), index.take(held)))
    return plan


def ranked(df: DataFrame, key: str, rows: int, *order: str) -> DataFrame:
    """`df` of `rows` rows with pack_rank: the number of earlier rows with the same key.

    Rows are dealt by a hash of `order` into about sqrt(rows) buckets, counted, and numbered
    inside a (key, bucket); so a key with most of the rows is numbered by many tasks.
    """
    buckets = math.isqrt(rows) + 1
    salted = df.withColumn("pack_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = salted.groupBy(key, "pack_bucket").agg(F.count(F.lit(1)).alias("pack_n"))
    before = Window.partitionBy(key).orderBy("pack_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    base = counts.select(key, "pack_bucket",
                         F.coalesce(F.sum("pack_n").over(before), F.lit(0)).alias("pack_base"))
    inside = Window.partitionBy(key, "pack_bucket").orderBy(*order)
    return (salted.withColumn("pack_rank", F.row_number().over(inside) - 1)
            .join(base, [key, "pack_bucket"])
            .withColumn("pack_rank", F.col("pack_rank") + F.col("pack_base"))
            .drop("pack_bucket", "pack_base"))


def pack(table: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add sequence_id and offset to pieces(doc_id, piece, length, ...), 1 <= length <= capacity.

    `table` is read twice: give a stored one where it is dear to compute.
    """
    counts = {int(r[0]): int(r[1]) for r in
              table.groupBy("length").count().collect()}  # at most `capacity` rows
    keys, first, step, offset, at, used = [], [], [], [], 0, dict.fromkeys(counts, 0)
    for lengths, times in packing_plan(counts, capacity):
        place = 0
        for length in lengths:
            keys.append((length, used[length]))
            first.append(at - used[length])
            offset.append(place)
            used[length] += times
            place += length
        at += times
    order = sorted(range(len(keys)), key=keys.__getitem__)
    lengths = np.array([keys[i][0] for i in order], np.int64)
    starts = np.array([keys[i][1] for i in order], np.int64)
    first, offset = np.array(first, np.int64)[order], np.array(offset, np.int64)[order]
    span = np.searchsorted(lengths, np.arange(capacity + 2))

    def place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("pack_rank").to_numpy()
            entry = np.empty(len(rank), np.int64)
            for n in np.unique(length):
                lo, hi = span[n], span[n + 1]
                rows = length == n
                entry[rows] = lo + np.searchsorted(starts[lo:hi], rank[rows], "right") - 1
            columns = [batch.column(i) for i, f in enumerate(batch.schema)
                       if f.name != "pack_rank"]
            names = [f.name for f in batch.schema if f.name != "pack_rank"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(first[entry] + rank), pa.array(offset[entry])],
                names=[*names, "sequence_id", "offset"])

    numbered = ranked(table, "length", sum(counts.values()), "doc_id", "piece")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
    return numbered.select(*table.columns, "pack_rank").mapInArrow(
        place_rows, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_ids, ids (uint32 bytes) in offset order.

    A sequence holds at most `capacity` pieces, so gathering one is bounded.
    """
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_ids"),
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")).select(
        "sequence_id", "n_ids",
        F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int,
                   capacity: int = 4096) -> DataFrame:
    """Pieces of the documents with their sequence and offset; the pieces are stored once."""
    return pack(stored(pieces(docs, vocabulary, end_id, capacity, with_ids=False), "pieces"),
                capacity)
