"""Packing, token files, byte-level BPE and shards against brute force."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from panelspark.llm import byte_bpe, packing, queries, sharding, token_files

VOCABULARY = P.path("word_bpe_49k.json")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_packing(rows, texts, tokenizer, end_id, capacity):
    want = Counter()
    for doc, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        for k in range(0, len(ids), capacity):
            part = ids[k:k + capacity]
            want[doc, k // capacity, k, len(part), crc(part)] += 1
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), math.ceil(sum(r.length for r in rows) / capacity)


def test_packing_query(spark, sf, tokenizer):
    rows = queries.op1_packing(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    used, least = check_packing(rows, docs, tokenizer, 1, 4096)
    assert used <= least + 1


def test_packing_odd_texts(spark, odd_docs, no_docs, tokenizer):
    packed = packing.pack_documents(odd_docs, VOCABULARY, 1, 64)
    used, least = check_packing(packed.collect(), odd_docs.select("doc_id", "text").collect(),
                                tokenizer, 1, 64)
    assert used == least
    assert packing.pack_documents(no_docs, VOCABULARY, 1).count() == 0


def test_sequences_hold_the_ids(spark, odd_docs, tokenizer):
    parts = packing.pieces(odd_docs, VOCABULARY, 1, 64).cache()
    got = packing.sequences(packing.pack(parts, 64)).collect()
    assert all(len(r.ids) == 4 * r.n_ids <= 256 for r in got)
    want = Counter()
    for r in odd_docs.collect():
        want.update(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1])
    assert want == sum((Counter(np.frombuffer(r.ids, "<u4").tolist()) for r in got), Counter())


@pytest.mark.parametrize("counts", [
    {4096: 5}, {1000: 1000}, {3000: 7, 1096: 7}, {4000: 3, 48: 6}, {4000: 2, 32: 6},
    {1: 10_000_000_000, 4095: 9_000_000_000}, {1365: 3, 1366: 1, 2000: 2, 96: 1}, {}])
def test_plan_uses_each_piece_once(counts):
    plan = packing.packing_plan(counts, 4096)
    used = Counter()
    for lengths, times in plan:
        assert times > 0 and sum(lengths) <= 4096
        for x in lengths:
            used[x] += times
    assert used == Counter(counts)


@pytest.mark.parametrize("counts, best", [
    ({1000: 1000}, 250), ({3000: 7, 1096: 7}, 7), ({4000: 3, 48: 6}, 3), ({4000: 2, 32: 6}, 2),
    ({2048: 5}, 3), ({2000: 1, 1000: 1, 600: 1, 496: 1}, 1)])
def test_plan_finds_exact_fillings(counts, best):
    assert sum(n for _, n in packing.packing_plan(counts, 4096)) == best


def test_plan_on_many_lengths():
    rng = np.random.default_rng(3)
    sizes = np.minimum(4096, rng.lognormal(6, 1, 50_000).astype(int) + 1)
    counts = Counter(sizes.tolist())
    used = sum(n for _, n in packing.packing_plan(counts, 4096))
    assert used <= math.ceil(sizes.sum() / 4096) * 1.001 + 1


def check_files(rows, texts, tokenizer, end_id):
    at = 0
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for r, (doc, text) in zip(sorted(rows, key=lambda r: r.start), order, strict=True):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(ids), crc(ids))
        at += len(ids)


def test_token_files_query(spark, sf, tokenizer):
    rows = queries.op8_token_files(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    check_files(rows, docs, tokenizer, 2)


def test_token_files_odd_texts(spark, odd_docs, no_docs, tokenizer):
    uri = token_files.write_token_files(odd_docs, VOCABULARY, 2)
    rows = token_files.read_token_files(spark, uri).collect()
    check_files(rows, odd_docs.select("doc_id", "text").collect(), tokenizer, 2)
    assert all(crc(r.ids) == r.ids_crc32 for r in rows)
    uri = token_files.write_token_files(no_docs, VOCABULARY, 2)
    assert token_files.read_token_files(spark, uri).count() == 0
    with open(token_files.mounted_path(uri) + "/index.json") as f:
        assert json.load(f)["partitions"] == []


@pytest.fixture(scope="module")
def encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check_round_trip(rows, texts, encoding):
    want = Counter()
    for doc, text in texts:
        ids = encoding.encode_ordinary(text or "")
        want[doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert want == Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows)


def test_byte_bpe_query(spark, sf, encoding):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    check_round_trip(queries.op5_byte_bpe(spark, sf).collect(), docs, encoding)


def test_byte_bpe_odd_texts(spark, odd_docs, no_docs, encoding):
    texts = odd_docs.select("doc_id", "text").collect()
    check_round_trip(byte_bpe.round_trip(odd_docs, RANKS, P.PATTERN).collect(), texts, encoding)
    assert byte_bpe.encode(no_docs, RANKS, P.PATTERN).count() == 0
    ids = byte_bpe.encode(odd_docs, RANKS, P.PATTERN)
    back = byte_bpe.decode(ids, RANKS, P.PATTERN).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((d, t or "") for d, t in texts)


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 20])
def test_tree_joins_are_exact(leaf, encoding):
    coder = byte_bpe.TreeEncoder(RANKS, P.PATTERN, leaf)
    rng = np.random.default_rng(leaf)
    alphabet = np.array(list("ab lst'' \n\n.,!19é日\t \x1c"))
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 120))) for _ in range(300)]
    texts += [" " * 50, "'" * 30 + "ll", "ab" * 40, "it's  \n  'll " * 10]
    for text in texts:
        ids = coder.encode(text)
        assert ids == encoding.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def check_shards(rows, n_shards):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(n_shards))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    # Every shard's share of a source is within one row of the source's share of the whole.
    source, both = Counter(r.source for r in rows), Counter((r.source, r.shard) for r in rows)
    for (s, shard), n in both.items():
        assert abs(n - source[s] * sizes[shard] / len(rows)) < 4


def test_shards_query(spark, sf):
    rows = queries.op4_shards(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in docs)
    check_shards(rows, 40)


def test_mixture_with_many_small_sources(spark):
    rows = [(i, "large") for i in range(10000)] + [(10000 + i, f"s{i}") for i in range(10000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    by = Counter((r.shard, r.source == "large") for r in sharding.shards(docs, 40).collect())
    # 250 expected; the small sources' places are a sample, five standard deviations are 56.
    assert all(abs(by[s, True] - 250) <= 60 and by[s, True] + by[s, False] == 500
               for s in range(40))


def test_shards_odd_texts(spark, odd_docs, no_docs, tmp_path):
    placed = sharding.shards(odd_docs, 4)
    assert placed.columns == [*odd_docs.columns, "fraction", "shard", "slot"]
    check_shards(placed.collect(), 4)
    check_shards(sharding.shards(odd_docs.limit(2), 4).collect(), 4)
    assert sharding.shards(no_docs, 4).count() == 0
    one = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    sharding.write_shards(one, sharding.shards(one.select("doc_id", "source"), 4),
                          f"{tmp_path}/shards")
    assert spark.read.parquet(f"{tmp_path}/shards").count() == one.count()
