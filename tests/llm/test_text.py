"""Quality rules, pseudonyms, near duplicates and the pipeline against brute force."""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelspark.llm import minhash, pii, quality, queries
from panelspark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(covered))


def check_quality(rows, docs):
    want = Counter((r.doc_id, *measures(r.text)) for r in docs)
    assert want == Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines,
                            r.n_repeat_words) for r in rows)
    for r in rows:
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and r.host_kept)


def test_quality_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = queries.op7_quality(spark, sf).collect()
    check_quality(rows, docs)
    assert all(r.host_kept for r in rows)


def test_quality_odd_texts(spark, odd_docs, no_docs):
    more = odd_docs.union(spark.createDataFrame(
        [(90, "a b c d e f g h " * 6, None, "x"), (91, "l1 x\nl1 x\n\nl1 x", "src0", "x"),
         (92, "w " + "a b c d e f g h i " * 2 + "z a b c d e f g h", "s", "x")], odd_docs.schema))
    rows = quality.measured(more, "doc_id", "source").cache()
    check_quality(quality.judged(rows, rows).collect(), more.collect())
    none = quality.measured(no_docs, "doc_id", "source")
    assert quality.judged(none, none).count() == 0


def test_bad_hosts_are_shrunk_and_rejected(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    rows = [(i, good, f"h{i % 30}") for i in range(3000)]
    rows += [(9000 + i, bad if i < 90 else good, "bad") for i in range(100)]
    rows += [(9500, bad, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    m = quality.measured(docs, "doc_id", "source").cache()
    rates = {r.q_host: r for r in quality.host_rates(m).collect()}
    assert not rates["bad"].host_kept and rates["h0"].host_kept
    assert rates["one"].rate_base < 1  # one document says less than a hundred
    kept = quality.judged(m, m).where("kept").select("source").distinct().collect()
    assert {r.source for r in kept} == {f"h{i}" for i in range(30)} | (
        {"one"} & {r.source for r in kept})


def luhn(d):
    d = [int(c) for c in d][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


CASES = [
    ("pay 4337166598464399 now", r"pay (\d{16}) now", luhn),
    ("pay 4337-1665-9846-4399.", r"pay (\d{4}-\d{4}-\d{4}-\d{4})\.",
     lambda s: luhn(s.replace("-", ""))),
    ("+1 (857) 555-9245, x", r"(\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}), x", bool),
    ("(157) 055-9245", r"(\([01]\d\d\) [01]\d\d-\d{4})", bool),
    ("ip 53.100.186.248.", r"ip (.*)\.", ipaddress.ip_address),
    ("mail gckna.63@mail5.example.com!", r"mail ([a-z]{5}\.\d\d@mail5\.example\.com)!", bool),
    ("Ab.C9@x.org", r"([A-Z][a-z]\.[A-Z]\d@x\.org)", bool),
    ("on 2019-02-28", r"on (\d{4}-\d\d-\d\d)", bool),
    ("on 12/31/1999", r"on (\d\d/\d\d/\d{4})", bool),
    ("123-45-6789", r"(\d{3}-\d{2}-\d{4})", bool),
    ("DE89 3704 0044 0532 0130 00", r"(DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d)", bool),
    ("GB82WEST12345698765432", r"(GB\d\dWEST\d{14})", bool),
]
LEFT = ["4337166598464398", "256.1.1.1", "1.2.3.4.5", "2019-02-30", "666-12-3456", "@", None, "",
        "Version 2.0 of 1999", "DE88 3704 0044 0532 0130 00", "a" * 30_000, "1 " * 20_000]


def test_pseudonyms_keep_the_format(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)],
                                 "doc_id int, text string")
    for r in pii.pseudonymised(docs, "k").collect():
        text, pattern, valid = CASES[r.doc_id]
        m = re.fullmatch(pattern, r.text)
        assert m and r.text != text and valid(m[1]), (text, r.text)
    left = spark.createDataFrame([(i, t, "x") for i, t in enumerate(LEFT)],
                                 "doc_id int, text string, pii_n string")
    assert {r.doc_id: r.text for r in pii.pseudonymised(left, "k").collect()} == dict(
        enumerate(LEFT))
    assert pii.pseudonymised(left.limit(0), "k").count() == 0


# Text, values in it, what has to stay as it is.
RUNS = [
    ("4111111111111111 123", ["4111111111111111"], " 123"),
    ("4111 1111 1111 1111 12/27", ["4111 1111 1111 1111"], " 12/27"),
    ("4111111111111111 555-123-4567", ["4111111111111111", "555-123-4567"], ""),
    ("no 12 4111111111111111", ["4111111111111111"], "no 12 "),
    ("4111111111111111 4111111111111111 7", ["4111111111111111"], " 7"),
    ("1234 555-123-4567", ["555-123-4567"], "1234 "),
    ("BE68539007547034 EUR", ["BE68539007547034"], " EUR"),
    ("BE68 5390 0754 7034 PAID", ["BE68 5390 0754 7034"], " PAID"),
    ("XX12 4111 1111 1111 1111", ["4111 1111 1111 1111"], "XX12 "),
    ("IT12 3456 7890 1234 5678 9012 555-123-4567", ["555-123-4567"], "IT12 3456 "),
    ("4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", ["4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1"], ""),
    ("4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", ["4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1"], ""),
    ("\ue000 4111111111111111 \ue001 anna.berg@x.org", ["4111111111111111", "anna.berg@x.org"], "\ue001"),
]


def test_valid_numbers_beside_others_are_replaced(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(RUNS)],
                                 "doc_id int, text string")
    for r in pii.pseudonymised(docs, "k", found="n").collect():
        text, values, stays = RUNS[r.doc_id]
        shape = [re.sub(r"\d", "9", x) for x in (text, r.text)]
        assert not any(v in r.text for v in values) and stays in r.text, (text, r.text)
        assert "@" in text or shape[0] == shape[1], (text, r.text)
        assert r.n == sum(text.count(v) for v in values), (text, r.n)


# Text and form of its pseudonym: values of the corpus' languages.
FORMS = [
    ("+49 30 1234567", r"\+49 [1-9]\d \d{7}"), ("+33 1 23 45 67 89", r"\+33 [1-9]( \d\d){4}"),
    ("+44 20 7946 0958", r"\+44 [2-9]\d \d{4} \d{4}"), ("0171 2345678", r"0[01]\d\d \d{7}"),
    ("030/1234567", r"0[1-9]\d/\d{7}"), ("01 23 45 67 89", r"0[1-9]( \d\d){4}"),
    ("0049 30 1234567", r"0049 [1-9]\d \d{7}"), ("+49 (0)30 1234567", r"\+49 \(0\)[1-9]\d \d{7}"),
    ("+1 857 555 9245", r"\+1 [2-9]\d\d [2-9]\d\d \d{4}"),
    ("de89 3704 0044 0532 0130 00", r"de\d\d \d{4} \d{4} \d{4} \d{4} \d\d"),
    ("2024/03/12", r"\d{4}/\d\d/\d\d"), ("3.4.2021", r"\d{1,2}\.\d{1,2}\.\d{4}"),
    ("12-03-2024", r"\d\d-\d\d-\d{4}"), ("31/12/1999", r"\d\d/\d\d/\d{4}"),
    ("7/4/1776 7/4/1976", r"7/4/1776 \d{1,2}/\d{1,2}/\d{4}"),
    ("2001:db8:85a3:0:0:8a2e:370:7334", "([0-9a-f]{1,4}:){7}[0-9a-f]{4}"),
    ("FE80::1A:2b", "[0-9A-F]{4}::[0-9A-F]{2}:[0-9A-F]{2}"),
    ("m\u00fcller@web.de", "[a-z][\u00e0-\u00ff][a-z]{4}@web\\.de"),
    ("\u00c9va.\u010dern\u00fd@x.org", "[\u00c0-\u00de][a-z]{2}\\.[\u0100-\u010f][a-z]{3}[\u00e0-\u00ff]@x\\.org"),
    ("\u0438\u0432\u0430\u043d@x.org", "[\u0430-\u043f]{4}@x\\.org"),
]
PLAIN = ["12:34:56", "std::vector a::b", "+1.23456789", "::", "1:2:3:4:5:6:7", "2024/13/12",
         "31.2.2021", "0171", "1 +2 3", "at 10 000 000", "00123456789", "no 0171 23", "1:::2::3",
         "de88 3704 0044 0532 0130 00", "\u8054\u7cfb 12.5.3"]


def test_pseudonyms_of_other_countries_forms(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FORMS)],
                                 "doc_id int, text string")
    got = {r.doc_id: r for r in pii.pseudonymised(docs, "k", found="n").collect()}
    for i, (text, form) in enumerate(FORMS):
        assert re.fullmatch(form, got[i].text) and got[i].text != text, (text, got[i].text)
        assert got[i].n == 1, text
    number = [re.sub(r"\D", "", got[i].text.replace("(0)", "")) for i in range(len(FORMS))]
    assert number[0] == number[7] == number[6][2:] and number[0][2:] == number[4][1:]
    assert number[1][2:] == number[5][1:]                       # national and international
    plain = spark.createDataFrame(list(enumerate(PLAIN)), "doc_id int, text string")
    assert {r.doc_id: r.text for r in pii.pseudonymised(plain, "k").collect()} == dict(
        enumerate(PLAIN))


def feistel(left, right, a, b, tweak, key):
    """The permutation once more in plain Python."""
    for i in range(pii.ROUNDS):
        other = left if i % 2 else right
        h = int(hashlib.sha256(f"{key}|{tweak}|{i}|{other}".encode()).hexdigest()[:15], 16)
        left, right = (left, (right + h % b) % b) if i % 2 else ((left + h % a) % a, right)
    return left, right


def test_number_forms_equal_a_second_implementation(spark):
    """Dialled numbers, dates and IPv6 addresses value by value, and no two become one."""
    rng = random.Random(5)
    want = {}
    for _ in range(150):
        n = str(rng.randint(1, 9)) + "".join(rng.choices("0123456789", k=rng.choice([6, 7, 8])))
        half = len(n) // 2
        unit = 10 ** (half - 1)
        left, right = feistel(int(n[:half]) - unit, int(n[half:]), 9 * unit,
                              10 ** (len(n) - half), f"dialled{len(n)}", "k")
        new = f"{left + unit}{right:0{len(n) - half}d}"
        want[f"+49 {n[:2]} {n[2:]}"] = f"+49 {new[:2]} {new[2:]}"
        day = datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(73441))
        left, right = feistel(*divmod((day - datetime.date(1900, 1, 1)).days, 271), 271, 271,
                              "date", "k")
        moved = datetime.date(1900, 1, 1) + datetime.timedelta(left * 271 + right)
        want[f"{day.day}.{day.month}.{day.year}"] = (
            f"{moved:%d.%m.%Y}" if day.day > 9 and day.month > 9
            else f"{moved.day}.{moved.month}.{moved.year}")
        words = [f"{rng.randrange(65536):04x}" for _ in range(8)]
        parts = []
        for k in (0, 1):
            text = "".join(words[4 * k:4 * k + 4])
            left, right = feistel(int(text[:8], 16), int(text[8:], 16), 16 ** 8, 16 ** 8,
                                  f"ipv6-{k}-16", "k")
            parts.append(f"{left:08x}{right:08x}")
        new = "".join(parts)
        want[":".join(words)] = ":".join(new[i:i + 4] for i in range(0, 32, 4))
    texts = list(want)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {texts[r.doc_id]: r.text for r in pii.pseudonymised(docs, "k").collect()}
    assert got == want and len(set(got.values())) == len(got)


def test_pseudonyms_are_permutations(spark):
    """All 20 * 10 * 26 values of a small format have different pseudonyms, the same anywhere."""
    rows = [(f"{a}{b}{c}@x.org",) for a in "abcdefghij" for b in range(10) for c in "klmnopqrst"]
    docs = spark.createDataFrame(rows + [(f"see {r[0]}, {r[0]}",) for r in rows[:50]],
                                 "text string")
    got = [r.text for r in pii.pseudonymised(docs, "k").collect()]
    assert len(set(got[:len(rows)])) == len(rows)
    assert got[len(rows):] == [f"see {x}, {x}" for x in got[:50]]
    days = spark.sql("select date_format(date_add(date'1900-01-01', cast(id as int)), "
                     "'yyyy-MM-dd') as text from range(73441)")
    new = pii.pseudonymised(days, "k")
    assert new.distinct().count() == 73441
    assert new.join(days, "text").count() == 73441


def test_pseudonym_query_leaves_no_value(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op2_pseudonyms(spark, sf).collect()
    find = re.compile(r"[\w.]+@[\w.]+\w|\+1 \(\d{3}\) \d{3}-\d{4}|\b4\d{15}\b|\b\d+\.\d+\.\d+\.\d+\b")
    hits, linked = 0, {}
    for r in rows:
        before, after = find.findall(docs[r.doc_id]), find.findall(r.text)
        hits += len(before)
        assert not set(before) & set(after) and (before or r.text == docs[r.doc_id])
        assert find.sub("", r.text).count(" ") == find.sub("", docs[r.doc_id]).count(" ")
        for x in before:
            assert x not in r.text
        if len(before) == len(after):
            for x, y in zip(before, after, strict=True):
                assert linked.setdefault(x, y) == y
    assert len(rows) == len(docs) and hits > 10


def shingles(text):
    words = WORD.findall(text)
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else None


def classes(docs):
    """Smallest doc_id of each near-duplicate class by comparing all texts that share a shingle."""
    root = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def link(x, y):
        x, y = sorted((find(x), find(y)))
        root[y] = x

    by_text, holders = {}, defaultdict(list)
    for doc, text in sorted((d, t) for d, t in docs if t is not None):
        root.setdefault(doc, doc)
        if text in by_text:
            link(by_text[text][0], doc)
            continue
        by_text[text] = (doc, shingles(text))
        near = set()
        for s in by_text[text][1] or ():
            near.update(holders[s])
            holders[s].append(text)
        for other in near:
            a, b = by_text[text][1], by_text[other][1]
            common = sum((a & b).values())
            if common >= 0.8 * (a.total() + b.total() - common) - 1e-9:
                link(doc, by_text[other][0])
    return {d: find(d) if t is not None else d for d, t in docs}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_near_duplicate_query(spark, folder):
    path = f"/root/testdata/{folder}"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    rows = queries.op6_near_duplicates(spark, path).collect()
    assert {r.doc_id: r.class_id for r in rows} == classes(docs)
    assert all(r.kept == (r.doc_id == r.class_id) for r in rows)


@pytest.mark.parametrize("hot_pairs", [3, 10**9])
def test_near_duplicates_of_one_family(spark, monkeypatch, hot_pairs):
    """Many variants of one text: links between any two count, met in blocks or in pairs."""
    import numpy as np

    monkeypatch.setattr(minhash, "HOT_PAIRS", hot_pairs)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 120)]
    docs = [(0, " ".join(base)), (1, " ".join(base))]
    for i in range(2, 300):
        words = list(base)
        for k in rng.choice(120, rng.integers(1, 7), replace=False):
            words[k] = f"x{rng.integers(0, 10**6)}"
        docs.append((i, " ".join(words)))
    rows = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in rows.collect()} == classes(docs)


def test_near_duplicates_odd_texts(spark, odd_docs, no_docs):
    rows = minhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    got = {r.doc_id: r.class_id for r in rows}
    assert got[19] == got[20] == got[21] == 19 and got[1] == 1 and got[None] is None
    assert got[0] == 0 and got[2] == 2  # no words: only equal texts are alike
    assert minhash.near_duplicates(no_docs).count() == 0


def test_darts_estimate_weighted_similarity():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 400)]
    other = words[:300] + [f"v{i}" for i in range(100)]
    texts = [" ".join(words), " ".join(other), " ".join(words * 2)]
    text, cell = minhash.cells(pa.array(texts))
    sign = minhash.throw(text, cell, 3)
    want = [shingles(t) for t in texts]
    for i, j in ((0, 1), (0, 2)):
        common = sum((want[i] & want[j]).values())
        exact = common / (want[i].total() + want[j].total() - common)
        assert abs((sign[i] == sign[j]).mean() - exact) < 0.12
    assert (minhash.throw(text[text == 0], cell[text == 0], 1)[0] == sign[0]).all()


def test_darts_are_held_in_bounded_groups(monkeypatch):
    """Signatures don't depend on the group's size, and a group bounds what many texts take."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    texts = pa.array([" ".join(f"w{i}" for i in rng.integers(0, 10**6, n))
                      for n in rng.integers(20, 200, 1500)])
    text, cell = minhash.cells(texts)
    tracemalloc.start()
    try:
        sign = minhash.throw(text, cell, len(texts))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # Some 1400 darts of 24 bytes a text are 50 MB, twice that where all are gathered.
    assert peak < 50e6
    for most in (1, 1 << 40):
        monkeypatch.setattr(minhash, "HELD_DARTS", most)
        few = text < 40
        assert (minhash.throw(text[few], cell[few], 40) == sign[:40]).all()


def test_signatures_do_not_depend_on_slices(spark, monkeypatch):
    """Small slices give the rows of large ones, repeated texts across slices included."""
    docs = spark.createDataFrame(
        [(i, " ".join(f"w{(i % 30) * 7 + k}" for k in range(40))) for i in range(90)]
        + [(90, None), (91, "")], "doc_id long, text string").coalesce(1)
    assert minhash.SIGNED_BYTES <= 2 << 20
    want = sorted(map(str, minhash.signatures(docs).collect()))
    monkeypatch.setattr(minhash, "SIGNED_BYTES", 500)
    assert sorted(map(str, minhash.signatures(docs).collect())) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (200, 200)]
    got = {r.node: r.component for r in components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, sf, odd_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {d for d, t in texts.items()
            if (m := measures(t))[0] >= 20 and 100 * m[4] <= 30 * m[0]}
    stage = dict(corpus_pipeline.STAGES)
    one = stage["quality rules"](spark, docs, sf)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == good
    two = stage["near duplicates"](spark, one, sf)
    named = classes([(d, texts[d]) for d in good])
    assert two.columns == docs.columns
    assert sorted(r.doc_id for r in two.collect()) == sorted(set(named.values()))
    three = stage["pseudonyms"](spark, two, sf)
    assert three.columns == docs.columns and three.count() == two.count()
    assert three.where(F.length("text") != F.col("n_chars")).count() == 0
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(named.values())


def test_pipeline_decides_by_row(spark, sf):
    a, b, c = (" ".join(f"{x}{j}" for j in range(60)) for x in "abc")
    near = a.replace("a59", "z")
    rows = [(3, a), (7, a), (7, b), (7, b), (None, b), (None, c), (None, c), (9, near), (3, c + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = dict(corpus_pipeline.STAGES)["near duplicates"](spark, docs, sf)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted(
        [(3, a), (7, b), (3, c + " x")])


def test_repeated_rows_make_no_pairs(spark):
    text = " ".join(f"w{j}" for j in range(60))
    rows = [(1, text)] * 500 + [(2, text + " x")] * 300 + [(5, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.class_id, r.copies, r.kept)
                  for r in minhash.near_duplicates(docs).collect())
    assert got == {(1, 1, 501, True): 500, (2, 1, 300, False): 300, (5, 1, 501, False): 1}


def test_pipeline_stages_on_odd_tables(spark, sf, odd_docs, no_docs):
    long = spark.createDataFrame(
        [(50 + i, " ".join(f"w{i}x{j}" for j in range(40)), "good", "x") for i in range(30)],
        odd_docs.schema)
    for docs in (odd_docs.union(long), no_docs):
        docs = docs.withColumn("n_chars", F.length("text")).withColumnRenamed("rank", "q_words")
        for name, function in corpus_pipeline.STAGES:
            out = function(spark, docs, sf)
            if name != "packing":
                assert out.columns == docs.columns
            if name == "quality rules":
                assert {r.doc_id for r in out.collect()} == {
                    r.doc_id for r in docs.where("source = 'good'").collect()}
            elif name == "near duplicates":
                assert out.count() == len({(r.doc_id, r.text) for r in docs.collect()}) - (
                    2 if docs.count() else 0)
            else:
                assert out.count() >= docs.count()
