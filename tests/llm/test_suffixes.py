"""Loser-tree merges and the removal of repeated strings against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelspark.llm import suffix_dedup
from panelspark.llm.suffix_runs import LoserTree, common_prefix, opened, run_pieces

SHORT = st.text("ab", max_size=9).map(str.encode)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(SHORT, max_size=25), min_size=1, max_size=6), st.sets(SHORT, max_size=3))
def test_runs_merge_in_order_with_their_prefixes(runs, bounds):
    import numpy as np

    parts: dict = {}
    for n, run in enumerate(runs):
        ids = {"id": np.arange(len(run), dtype=np.int64) * 10 + n}
        for part, piece in run_pieces(run, ids, sorted(bounds)):
            parts.setdefault(part, []).append(opened(piece))
    out, ids = [], []
    for part in sorted(parts):
        last = b""
        for r, i, s, shared in LoserTree([p[:3] for p in parts[part]]):
            assert shared == common_prefix(last, s)
            out.append(s)
            ids.append(parts[part][r][4]["id"][i])
            last = s
        ids += [x for p in parts[part] for x in p[5].get("id", [])]
    assert out == sorted(out)
    assert Counter(out) == Counter(s for run in runs for s in set(run))
    assert sorted(ids) == sorted(i * 10 + n for n, run in enumerate(runs) for i in range(len(run)))


def test_a_run_is_front_coded_without_a_call_per_string(monkeypatch):
    import numpy as np

    def refuse(*_):
        raise AssertionError("prefix of two strings by itself")

    rng = random.Random(9)
    keys = [bytes(rng.choices(b"\0ab", k=rng.randint(0, 30))) for _ in range(2000)]
    want, last = [], b""
    for s in sorted(set(keys)):
        want.append(common_prefix(last, s))
        last = s
    monkeypatch.setattr("panelspark.llm.suffix_runs.common_prefix", refuse)
    (_, piece), = run_pieces(keys, {"id": np.arange(2000)}, [])
    assert opened(piece)[0].tolist() == want


def test_texts_of_a_slice_are_hashed_at_once(monkeypatch):
    import pyarrow as pa

    rng, calls = random.Random(10), []
    base = prose(rng, 200)
    hashed = suffix_dedup.Parsed.hashed
    monkeypatch.setattr(suffix_dedup.Parsed, "hashed",
                        lambda self, *at: calls.append(1) or hashed(self, *at))
    for n in (10, 60):
        calls.append(0)
        list(suffix_dedup.open_windows(pa.RecordBatch.from_pydict({
            "d": pa.array(range(n), pa.int64()), "th": pa.array([0] * n, pa.int32()),
            "text": [base[i:] for i in range(n)],
            "marks": pa.array([[1 << 3 * suffix_dedup.MARK_BITS]] * n, pa.list_(pa.int64()))})))
    assert sum(calls) <= 2 * 4  # not a multiple of the texts


def test_known_prefixes_are_not_compared():
    import numpy as np

    base = b"x" * 300
    runs = [[base + bytes([i, r]) for i in range(100)] for r in range(4)]
    pieces = [opened(p) for r in runs for _, p in run_pieces(r, {"id": np.arange(100)}, [])]
    tree = LoserTree([p[:3] for p in pieces])
    assert sum(1 for _ in tree) == 400
    assert tree.compared < 1200


def brute(texts: list[str | None], length: int) -> list[tuple]:
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        covered = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                covered[i:i + length] = [True] * length
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        spans = sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered))
        out.append((len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("abcdefghijklmnoé", k=rng.randint(1, 9)))
                    for _ in range(n))


def check(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in zip(ids, texts, strict=True)],
                               "doc_id long, text string, d string, th int")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans,
                  r.kept_sha256) for r in suffix_dedup.cleaned(df).drop("kept").collect())
    want = sorted((i if i is not None else -1, *row) for i, row in zip(
        ids, brute(texts, suffix_dedup.LENGTH), strict=True))
    assert got == want


def test_copies_edits_and_passages(spark):
    rng = random.Random(5)
    base, passage, other = prose(rng, 400), prose(rng, 120), prose(rng, 75)[:400]
    texts = [base, base, base[:900] + "CHANGED" + base[900:], base[1:], base[300:]]
    for k in range(40):
        words = prose(rng, 150).split()
        at = rng.randint(0, 150)
        texts.append(" ".join([*words[:at], passage, *words[at:]]))
        cut = rng.randint(0, len(base) - 10)
        texts.append(base[:cut] + rng.choice("xyz") + base[cut + rng.randint(0, 5):])
        texts.append(prose(rng, 20) + base[cut:cut + 399 + k % 3] + prose(rng, 20))
    texts += [other, "Q" + other + "Q", other[:399], other[:399] + "R", passage + passage]
    check(spark, texts)


def test_planted_passages_are_cut_and_clean_texts_left_alone(spark):
    rng = random.Random(11)
    passages = [prose(rng, 100) for _ in range(4)]  # over 400 bytes
    short = [prose(rng, 100).encode()[:380].decode(errors="ignore") for _ in range(2)]
    texts = []
    for k in range(36):
        words = [prose(rng, 80), prose(rng, 80)]
        texts.append(" ".join([words[0], [*passages, *short, ""][k % 7], words[1]]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.cleaned(df).collect()}
    for k, text in enumerate(texts):
        size = len(text.encode())
        if k % 7 < 4:
            planted = len(passages[k % 7].encode())
            assert planted <= got[k].n_removed <= planted + 8 and got[k].n_spans == 1
        else:
            assert (got[k].n_removed, got[k].n_spans, bytes(got[k].kept)) == (0, 0, text.encode())
        assert got[k].n_bytes == size


def test_odd_texts(spark):
    rng = random.Random(6)
    long = prose(rng, 6000)
    texts = ["a" * 5000, "b" * 400, "word " * 3000, None, "", "x", "é" * 300, "é" * 200 + "é" * 250,
             "ab" * 210, "c" * 399, long, long, "same " * 90, "same " * 90, "same " * 90, long[7:900]]
    check(spark, texts, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 12, None, None])


def test_equal_rows_repeat_each_other(spark):
    text = prose(random.Random(7), 100)
    check(spark, [text, text, text + "!", "z" + text], [1, 1, 1, None])


def test_no_rows(spark, no_docs):
    assert suffix_dedup.cleaned(no_docs).collect() == []


@pytest.mark.parametrize("parts", ["1", "64"])
def test_parts_do_not_matter(spark, parts, monkeypatch):
    rng = random.Random(8)
    base = prose(rng, 300)
    texts = [base[i:] + prose(rng, 30) for i in range(0, 900, 30)] + [
        prose(rng, 30) + base for _ in range(20)]
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", 50_000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        check(spark, texts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
