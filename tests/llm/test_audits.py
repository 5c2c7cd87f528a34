"""Merkle manifest and filter audit against plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from panelspark.llm import filter_audit, merkle

DOC = "doc_id long, text string, lang string, source string, n_chars long, tree string"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row) -> str:
    out = ""
    for name in merkle.FIELDS:
        v = row[name]
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(out)


def climb(hashes: list[str]) -> tuple[str, list[list[tuple[list, list]]]]:
    """Root, and for each leaf the siblings before and after it, level by level."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for i, p in enumerate(paths):
            lo = at[i] // 8 * 8
            p.append((level[lo:at[i]], level[at[i] + 1:lo + 8]))
            at[i] //= 8
        level = [h(*level[i:i + 8]) for i in range(0, len(level), 8)]
    return level[0], paths


def plain_manifest(rows) -> list[tuple]:
    trees: dict = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for n in names:
        trees[n].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    done = [climb([leaf(r) for r in trees[n]]) for n in names]
    root, tops = climb([d[0] for d in done])
    out = []
    for (sub, paths), top, n in zip(done, tops, names, strict=True):
        for r, p in zip(trees[n], paths, strict=True):
            row = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"]:
                row["text"] = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"])
            x, proof = leaf(row), []
            for before, after in p + top:
                x = h(*before, x, *after)
                proof += before + after
            out.append((r["doc_id"], leaf(r), sub, root, h(*proof), x, x == root))
    return sorted(out, key=repr)


def manifest_rows(df) -> list[tuple]:
    return sorted([tuple(r) for r in merkle.third_tampered(df).collect()], key=repr)


def test_manifest_equals_plain_trees(spark):
    rows = [(i, f"Text {i} É", ["de", "en", None, "zz"][min(i % 7, 3)], None if i % 4 else "s", i,
             "clash") for i in range(150)]
    rows += [(5, "again", "en", "s", 1, ""), (5, "again", "en", "s", 1, ""), (None, "A", "en", "s", 0, ""),
             (900, None, "lone", None, None, ""), (901, "x" * 200000 + "Q", "en", "s", 2, ""),
             (902, "", "", "", 0, "")]
    df = spark.createDataFrame(rows, DOC)
    assert manifest_rows(df) == plain_manifest([r.asDict() for r in df.collect()])


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65])
def test_manifest_of_run_sizes(spark, n):
    df = spark.createDataFrame([(i, f"T{i}", "en", "s", 1, "") for i in range(n)], DOC)
    got = manifest_rows(df)
    assert got == plain_manifest([r.asDict() for r in df.collect()])
    assert any(not r[6] for r in got) or n < 8


def test_manifest_of_nothing(spark):
    assert manifest_rows(spark.createDataFrame([], DOC)) == []


def test_binary_tree_uses_xor(spark):
    nodes = spark.createDataFrame([("", i, 5, h(str(i))) for i in range(5)],
                                  "tree string, place long, size long, digest string")
    got = {(r.run, r.slot): (r.before, r.after) for r in merkle.with_siblings(nodes, 2).collect()}
    assert got[(0, 0)] == ("", h("1")) and got[(0, 1)] == (h("0"), "") and got[(2, 0)] == ("", "")


def plain_audit(docs, labels) -> list[tuple]:
    smallest: dict = {}
    for d in docs:
        t = d["text"] or ""
        if d["doc_id"] is not None:
            smallest[t] = min(smallest.get(t, d["doc_id"]), d["doc_id"])
    parts: dict = {}
    for d in docs:
        t = d["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": d["doc_id"] is not None and d["doc_id"] > smallest[t]}
        own = [x for x in labels if x[0] is not None and x[0] == d["doc_id"]]
        parts.setdefault(d["lang"] or "", []).append(
            (fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = []
    for part, rows in parts.items():
        shapley, lines = dict.fromkeys("ABCDE", 0), []
        for order in map("".join, permutations("ABCDE")):
            for s, letter in enumerate(order):
                counts = [0] * 6
                for fails, good, toxic in rows:
                    gone = any(fails[x] for x in order[:s])
                    here = fails[letter] and not gone
                    shapley[letter] += here
                    for i, v in enumerate((not gone and not here, here, fails[letter] and gone,
                                           fails[letter] and sum(fails.values()) == 1,
                                           here and good, here and toxic)):
                        counts[i] += v
                lines.append((part, order, s + 1, *counts, letter))
        out += [(*line[:-1], shapley[line[-1]]) for line in lines]
    return sorted(out)


def test_audit_equals_plain_counts(spark):
    words = [" ".join(f"w{j}" for j in range(250)), "same " * 250, "A B C d", "one # two",
             None, "", "\x1c É Ünï 日本 A", "w " * 30000]
    rows = [(i, words[i % len(words)], ["de", None, "", "en"][i % 4], "src", 0, "x")
            for i in range(60)] + [(7, words[7], "en", "s", 0, ""), (None, words[0], "en", "s", 0, ""),
                                   (None, "solo", None, "s", 0, ""), (7, words[7], "en", "s", 0, "")]
    labels = [(i, i % 2, (i % 3) // 2) for i in range(40)] + [(4, 1, 1), (None, 1, 1), (6, None, None),
                                                             (1000, 1, 1)]
    docs = spark.createDataFrame(rows, DOC.replace("tree", "mask"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in filter_audit.audit(docs, marks).collect())
    assert got == plain_audit([r.asDict() for r in docs.collect()], labels)


def test_audit_without_rows(spark):
    docs = spark.createDataFrame([], DOC)
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, marks).collect() == []
    one = spark.createDataFrame([(1, "x", "en", "s", 1, "t")], DOC)
    assert filter_audit.audit(one, marks).where(F.col("kept") > 0).count() == 24 * (1 + 2 + 3 + 4)


def test_wide_counters_do_not_overflow():
    n = (1 << 63) - 1
    total = n * filter_audit.packed(0b0101)
    assert (filter_audit.unpacked(total) == filter_audit.outcomes(0b0101).astype("int64") * n).all()
