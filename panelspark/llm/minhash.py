"""Near duplicates by dart MinHash over weighted word shingles.

A text is a weighted set: its runs of five words, weighted by how often they occur. The weight
axis of an element is cut into unit regions, one per occurrence. Into the strip (unit region) x
(rank axis) darts fall as a Poisson process that a hash of the element and the region seeds: so
the same element throws the same darts in every text that has it at that weight. A text of
total weight n keeps darts of rank below t / n, with t = k (ln k + 2), about t darts whatever its
length; each dart hashes to one of k coordinates, and a coordinate keeps its earliest dart. Two
texts agree in a coordinate with probability equal to their weighted Jaccard similarity. A text
that leaves a coordinate empty throws again with twice the ranks.

Coordinates are banded. Texts that share a band are compared by a sketch of one bit per
coordinate (a pair at the threshold differs in more than `MAX_BITS` of 192 bits with probability
below 1e-7), and what passes is verified by exact weighted Jaccard of the whole texts. A band of
rows 6 and 32 bands misses a pair at similarity 0.8 with probability 6e-5, at 0.85 with 3e-7.

Large groups make no pairs of all members: equal texts count as one; first every text meets one
member of its bucket, drawn per band; then only texts of a bucket that are still in different
groups are compared, those outside its largest group with the rest. Where that would be more than
HOT_PAIRS pairs in a bucket, they meet in blocks instead of pairs: the texts outside meet all
texts of the largest group and each other, a block by a block as a product of 0-1 matrices, and
a block gives one link for each text and group.

Defined cases: a text with fewer than five words is one shingle of all its words; texts without
words are duplicates only of equal texts; a null text is in a class of its own, named by its row;
texts are told apart by 64 bits of their SHA-256, so repeated rows, and one doc_id with several
texts, are rows of the texts they hold; a class is named by the smallest doc_id of its rows, null
where none has one; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.components import components
from panelspark.llm.shared import batch_words, mix, slices, stored, string_hash

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 6
K = BANDS * ROWS
MAX_BITS = 43
HOT_PAIRS = 1000
BLOCK = 128
DARTS = K * (math.log(K) + 2)
SIGNED_BYTES = 2 << 20  # of texts whose shingles a task holds at once
HELD_DARTS = 1 << 18  # darts gathered before the earliest of them are kept
U, MASK = np.uint64, (1 << 64) - 1


def cells(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Unit regions of the texts' weighted shingles: text index and 64-bit hash of each.

    The c-th occurrence of a shingle in a text is region c of its weight axis.
    """
    index, distinct, n = batch_words(texts)
    hashes = string_hash(distinct)[index] if len(index) else np.zeros(0, np.uint64)
    stop = np.repeat(np.cumsum(n), n)
    start = np.repeat(np.cumsum(n) - n, n)
    at = np.arange(len(index))
    at = at[(at + words <= stop) | (at == start)]
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    run = np.full(len(at), U(0x9E3779B97F4A7C15))
    for k in range(words):
        run = mix(run * U(31) + np.where(at + k < stop[at], padded[at + k], U(0)))
    text = np.repeat(np.arange(len(n)), n)[at]
    key = mix(run ^ mix(text.astype(np.uint64) + U(1)))
    order = np.argsort(key)
    key, run, text = key[order], run[order], text[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])[:len(key)]
    begin = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0)) if len(key) else key
    occurrence = (np.arange(len(key)) - begin).astype(np.uint64)
    return text, mix(run + occurrence * U(0x9E3779B97F4A7C15))


def throw(text: np.ndarray, cell: np.ndarray, n_texts: int) -> np.ndarray:
    """(n_texts, K) earliest darts; rows of texts without cells are zero."""
    weight = np.bincount(text, minlength=n_texts)
    out = np.zeros((n_texts, K), np.uint64)
    limit = np.divide(DARTS, weight, out=np.zeros(n_texts), where=weight > 0)
    todo = weight > 0
    while todo.any():
        own = todo[text]
        t, c = text[own], cell[own]
        rank, step = np.zeros(len(c)), 0
        best = np.full(n_texts * K, np.inf)
        flat = np.zeros(n_texts * K, np.uint64)
        found, held = [], 0
        while len(c):
            step += 1
            g = mix(c + U(step * 0xD6E8FEB86659FD93 & MASK))
            rank = rank - np.log(((g >> U(11)).astype(np.float64) + 1) * 2.0**-53)
            near = rank < limit[t]
            t, c, rank = t[near], c[near], rank[near]
            dart = mix(g[near] ^ U(0xA0761D6478BD642F))
            found.append((t * K + ((dart >> U(32)) * U(K) >> U(32)).astype(np.int64), rank, dart))
            held += len(c)
            if held >= HELD_DARTS or not len(c):
                key, ranks, darts = map(np.concatenate, zip(*found, strict=True))
                np.minimum.at(best, key, ranks)
                won = ranks == best[key]
                flat[key[won]] = darts[won]
                found, held = [], 0
        full = todo & np.isfinite(best.reshape(n_texts, K)).all(axis=1)
        out[full] = flat.reshape(n_texts, K)[full]
        todo &= ~full
        limit = limit * 2
    return out


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """(texts, BANDS) hashes of the rows of each band, the band's number included."""
    rows = signature.reshape(-1, BANDS, ROWS)
    out = np.broadcast_to(mix(np.arange(1, BANDS + 1)), rows.shape[:2])
    for k in range(ROWS):
        out = mix(out * U(31) + rows[:, :, k])
    return out.view(np.int64)


def sketches(signature: np.ndarray) -> np.ndarray:
    """(texts, K / 64) words of one bit per coordinate."""
    bits = (mix(signature) & U(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64).reshape(len(signature), K // 64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (SHA-256), weight, bands and sketch words of documents(doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SIGNED_BYTES):
            coded = batch.column("text").dictionary_encode()
            texts = coded.dictionary
            text, cell = cells(texts)
            signature = throw(text, cell, len(texts))
            weight = np.bincount(text, minlength=len(texts))
            none = pa.array(weight == 0)
            bands = pa.array(list(band_hashes(signature)), pa.list_(pa.int64()))
            sketch = sketches(signature)
            key = pa.array([hashlib.sha256(t.encode()).digest() for t in texts.to_pylist()],
                           pa.binary())
            own = pa.table({
                "text_key": key, "weight": pa.array(weight),
                "bands": pa.compute.if_else(none, pa.scalar(None, bands.type), bands),
                **{f"s{i}": pa.array(np.ascontiguousarray(sketch[:, i]))
                   for i in range(K // 64)}}).take(coded.indices)
            own = own.add_column(0, "doc_id", batch.column("doc_id"))
            yield from own.combine_chunks().to_batches()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, text_key binary, weight long, bands array<long>, "
        + ", ".join(f"s{i} long" for i in range(K // 64)))


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs(a, b) whose whole texts have weighted Jaccard similarity >= threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_a", SIGNED_BYTES):
            both = pa.concat_arrays([batch.column("text_a"), batch.column("text_b")])
            coded = both.dictionary_encode()
            text, cell = cells(coded.dictionary)
            order = np.lexsort((cell, text))
            cell = cell[order]
            edge = np.concatenate([[0], np.cumsum(
                np.bincount(text, minlength=len(coded.dictionary)))])
            index = coded.indices.to_numpy().reshape(2, -1)
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(index.T):
                u, v = cell[edge[x]:edge[x + 1]], cell[edge[y]:edge[y + 1]]
                common = len(np.intersect1d(u, v, assume_unique=True))
                keep[i] = common >= threshold * (len(u) + len(v) - common) - 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select(
        "a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _close(x: str, y: str) -> F.Column:
    """Sketches and weights of two rows still allow a similarity of THRESHOLD."""
    bits = sum((F.bit_count(F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}")))
                for i in range(K // 64)), F.lit(0))
    low, high = F.least(f"{x}.weight", f"{y}.weight"), F.greatest(f"{x}.weight", f"{y}.weight")
    return (bits <= MAX_BITS) & (low >= THRESHOLD * high)


def _ordered(x: str, y: str) -> list[F.Column]:
    return [F.least(f"{x}.id", f"{y}.id").alias("a"), F.greatest(f"{x}.id", f"{y}.id").alias("b")]


def links(signed: DataFrame, docs: DataFrame) -> DataFrame:
    """Verified links (a, b) that connect near-duplicate texts; `signed` has one row per text.

    Enough links to give each class: pairs inside a class may be left out.
    """
    in_band = signed.where("bands is not null").select(
        "id", F.explode("bands").alias("bucket"))
    shared = in_band.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("members"),
        F.min(F.xxhash64("id", "bucket")).alias("drawn")).where("members > 1")
    sketch = signed.select("id", "weight", *[f"s{i}" for i in range(K // 64)])
    multi = stored(in_band.join(shared, "bucket").join(sketch, "id"), "buckets")
    # One row per text, map-side first; ids grow with the corpus: one join strategy at all sizes.
    one_each = with_text_id(docs.where("text is not null").select("text")).dropDuplicates(["id"])
    texts = stored(one_each.join(multi.select("id").distinct().hint("merge"), "id", "left_semi")
                   .select("id", "text"), "texts")

    centre = multi.where(F.xxhash64("id", "bucket") == F.col("drawn"))
    star = (multi.alias("x").join(centre.alias("y"), "bucket")
            .where((F.col("x.id") != F.col("y.id")) & _close("x", "y"))
            .select(*_ordered("x", "y")).distinct())
    first = stored(verified(star, texts), "links")

    grouped = multi.join(components(first), F.col("id") == F.col("node"), "left").select(
        multi["*"], F.coalesce("component", "id").alias("group"))
    sizes = grouped.groupBy("bucket", "group").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"),
        F.max(F.struct("n", "group")).alias("top")).where("groups > 1").select(
        "bucket", F.col("top.group").alias("main"),
        (F.col("n") * (F.col("n") - F.col("top.n")) > HOT_PAIRS).alias("hot"))
    mixed = stored(grouped.join(main, "bucket"), "mixed")
    few = mixed.where("not hot")
    apart = (few.where("`group` <> main").alias("x").join(few.alias("y"), "bucket")
             .where((F.col("x.group") != F.col("y.group"))
                    & ((F.col("y.group") == F.col("y.main")) | (F.col("x.id") < F.col("y.id")))
                    & _close("x", "y"))
             .select(*_ordered("x", "y")).distinct())
    outside = mixed.where("hot and `group` <> main").select(
        F.col("main").alias("family"), "id", "group").distinct()
    return first.union(verified(apart, texts)).union(
        block_links(outside, grouped.select("id", "group").distinct(), texts))


def block_links(outside: DataFrame, members: DataFrame, texts: DataFrame,
                threshold: float = THRESHOLD) -> DataFrame:
    """Links (a, b) of outside(family, id, group) with its family and with each other.

    A family is the group of members(id, group) that it names. Each text of a family's outside
    meets all others in blocks of BLOCK by BLOCK texts; rows grow with the number of texts times
    that of blocks, and a link for each text and group of a block comes out.
    """
    inside = members.join(outside.select(F.col("family").alias("group")).distinct(), "group",
                          "left_semi").select(F.col("group").alias("family"), "id", "group")
    all_of = inside.union(outside)
    counts = all_of.groupBy("family").agg(F.count(F.lit(1)).alias("n")).join(
        outside.groupBy("family").agg(F.count(F.lit(1)).alias("k")), "family")

    def dealt(rows: DataFrame, own: str, n: str, other: str, m: str, side: int) -> DataFrame:
        blocks = [F.greatest(F.lit(1), F.ceil(F.col(x) / BLOCK)).cast("int") for x in (n, m)]
        return rows.join(counts, "family").select(
            "family", "id", "group", F.lit(side).alias("side"),
            F.pmod(F.xxhash64("id"), blocks[0]).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), blocks[1] - 1)).alias(other)).select(
            "family", "xb", "yb", "side", "id", "group")

    def run(block: pa.Table) -> pa.Table:
        coded = block.column("text").combine_chunks().dictionary_encode()
        text, cell = cells(coded.dictionary)
        order = np.argsort(text, kind="stable")
        edge = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(coded.dictionary)))])
        cell, which = cell[order], coded.indices.to_numpy()
        side, ids = block.column("side").to_numpy(), block.column("id").to_numpy()
        group = block.column("group").to_numpy()
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        own = [[cell[edge[which[r]]:edge[which[r] + 1]] for r in rows] for rows in (x, y)]
        flat = [np.concatenate(c) if c else np.zeros(0, np.uint64) for c in own]
        shared = np.intersect1d(*flat)
        common = np.zeros((len(x), len(y)), np.float32)
        held = []
        for c, f in zip(own, flat, strict=True):
            row = np.repeat(np.arange(len(c)), [len(v) for v in c])
            at = np.searchsorted(shared, f)
            both = (at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == f) if len(
                shared) else np.zeros(len(f), bool)
            held.append((row[both], at[both]))
        for start in range(0, len(shared), 4096):
            width = min(4096, len(shared) - start)
            sides = []
            for (row, at), c in zip(held, own, strict=True):
                now = (at >= start) & (at < start + width)
                m = np.zeros((len(c), width), np.float32)
                m[row[now], at[now] - start] = 1
                sides.append(m)
            common += sides[0] @ sides[1].T
        size = [np.array([len(v) for v in c], np.float32) for c in own]
        union = size[0][:, None] + size[1][None, :] - common
        near = (common >= threshold * union - 1e-4) & (group[x][:, None] != group[y][None, :])
        i, j = np.nonzero(near)
        a, b = np.minimum(ids[x[i]], ids[y[j]]), np.maximum(ids[x[i]], ids[y[j]])
        once = np.unique(np.stack([ids[x[i]], group[y[j]]], axis=1), axis=0, return_index=True)[
            1] if len(i) else i
        return pa.table({"a": a[once], "b": b[once]})

    met = dealt(outside, "xb", "k", "yb", "n", 0).union(dealt(all_of, "yb", "n", "xb", "k", 1))
    return met.join(texts, "id").groupBy("family", "xb", "yb").applyInArrow(
        run, "a long, b long")


def text_id(text: str = "text") -> F.Column:
    """64 bits that name a text, from its SHA-256; null for a null text."""
    digest = F.sha2(F.encode(F.col(text), "UTF-8"), 256)
    return F.when(F.col(text).isNotNull(), F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))


def with_text_id(docs: DataFrame) -> DataFrame:
    return docs.withColumn("id", text_id())


def text_classes(docs: DataFrame) -> DataFrame:
    """Per text of documents(doc_id, text): id, first, copies, component, class_id, leads.

    first is its smallest doc_id, copies its number of rows; of each component one text leads,
    the one that holds the smallest doc_id.
    """
    docs = docs.select("doc_id", "text")
    signs = stored(signatures(docs), "signatures").where("text_key is not null").withColumn(
        "id", F.conv(F.substring(F.lower(F.hex("text_key")), 1, 15), 16, 10).cast("long"))
    equal = signs.groupBy("id").agg(
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    signed = stored(signs.drop("doc_id", "text_key").dropDuplicates(["id"]), "signed")
    parts = components(stored(links(signed, docs), "all-links"))
    named = equal.join(parts, F.col("id") == F.col("node"), "left").select(
        "id", "first", "copies", F.coalesce("component", "id").alias("component"))
    # Texts without any doc_id come last; equal doc_ids go by the text's id.
    order = F.struct(F.col("first").isNull(), "first", "id")
    best = named.groupBy("component").agg(F.min(order).alias("best"))
    return named.join(best, "component").select(
        "id", "first", "copies", "component", F.col("best.first").alias("class_id"),
        (F.col("id") == F.col("best.id")).alias("leads"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of documents(doc_id, text): doc_id, class_id, copies, kept.

    class_id is the smallest doc_id of the near-duplicate class, copies the number of rows with
    the same text, kept is true for the rows that hold the class's leading text under that id.
    """
    rows = with_text_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop(
        "text")
    found = text_classes(docs).select("id", "class_id", "copies", "leads")
    return rows.join(found, "id", "left").select(
        "doc_id", F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
        .alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"),
        F.when(F.col("id").isNull(), True).otherwise(
            F.col("leads") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))
