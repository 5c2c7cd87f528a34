"""Document quality by host: rules per document, failure rates per host, verdicts joined back.

Every document is measured over its whole text with native expressions. Each rule's failures
are counted per host (the `source` column); a host's rate is shrunk towards the mean of all
hosts by a beta prior whose two parameters are fitted to the hosts' rates by moments, so a host
with few documents is judged mostly by what hosts are like. A host whose shrunk rate of any rule
is above MAX_RATE is rejected with all its documents.

Defined cases: a null or empty text has no words and fails `base`; a null host is a host of its
own; repeated rows count each time; an empty table gives no rows; further columns are ignored
by `measured` and kept by `judged`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.shared import GAP, stored

MAX_RATE = 0.5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 8


def _once(df: DataFrame, name: str, value: F.Column) -> DataFrame:
    """Add a column worked out once per row: a generator keeps later uses from copying it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _pairs(column: str, step: int) -> F.Column:
    """Hash of each entry with the one `step` later; one entry fewer for each step."""
    late = F.slice(column, step + 1, F.greatest(F.size(column) - step, F.lit(0)))
    early = F.slice(column, 1, F.greatest(F.size(column) - step, F.lit(0)))
    return F.zip_with(early, late, lambda a, b: F.xxhash64(a, b))


def _covered(windows: str) -> F.Column:
    """Words in windows whose hash occurs twice or more.

    Positions are sorted by hash, those with an equal neighbour are sorted by place, and each
    adds the words up to the next such position, WINDOW at most.
    """
    at = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(rows: F.Column) -> F.Column:
        last = F.size(rows) - 1

        def same(k: F.Column, j: F.Column) -> F.Column:
            return F.get(rows, k)["h"] == F.get(rows, j)["h"]

        return F.sort_array(F.transform(
            F.filter(rows, lambda r, k: (same(k, k - 1) & (k > 0)) | (same(k, k + 1) & (k < last))),
            lambda r: r["i"]))

    def total(place: F.Column) -> F.Column:
        steps = F.transform(place, lambda p, k: F.least(
            F.lit(WINDOW), F.coalesce(F.get(place, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    held = F.transform(F.array(at), repeated)
    return F.get(F.transform(held, total), F.lit(0))


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and MEASURES of documents(text), by native expressions."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*keep, text.alias("q_text"))
    rows = _once(rows, "q_words", F.array_remove(F.split("q_text", GAP), ""))
    lines = F.filter(F.split("q_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = _once(rows, "q_lines", lines)
    rows = rows.select(
        *keep, F.size("q_words").cast("long").alias("n_words"),
        (F.length("q_text") - F.length(F.regexp_replace("q_text", "[^\\x20\\x09-\\x0D]+", "")))
        .cast("long").alias("word_chars"),
        F.length(F.regexp_replace("q_text", "[^#*$%&|<>]+", "")).cast("long")
        .alias("n_symbols"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long")
        .alias("n_dup_lines"),
        F.transform("q_words", lambda w: F.xxhash64(w)).alias("q_1"))
    for step, name in ((1, "q_2"), (2, "q_4"), (4, "q_8")):
        rows = _once(rows, name, _pairs("q_1" if step == 1 else f"q_{step}", step)).drop(
            "q_1" if step == 1 else f"q_{step}")
    return rows.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(
        F.size("q_8") == F.size(F.array_distinct("q_8")), F.lit(0))
        .otherwise(_covered("q_8")).cast("long").alias("n_repeat_words"))


def base_failed() -> F.Column:
    return (F.col("n_words") < 20) | (
        100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rules() -> dict[str, F.Column]:
    """Failures of a document by rule; only those of whole hosts reject beyond `base`."""
    chars, words = F.col("word_chars"), F.greatest("n_words", F.lit(1))
    return {
        "base": base_failed(),
        "symbols": 10 * F.col("n_symbols") > chars,
        "lines": 5 * F.col("n_dup_lines") > words,
        "word_length": (chars < 2 * words) | (chars > 15 * words),
    }


def host_rates(rows: DataFrame, host: str = "source") -> DataFrame:
    """Per host: documents, shrunk failure rate of each rule and host_kept.

    rate = (failures + alpha) / (documents + alpha + beta), where alpha and beta match the mean m
    and the variance v of the hosts' raw rates: alpha + beta = m (1 - m) / v - 1, bounded to
    1 to 1e6 (hosts that differ not at all, or by more than a beta can). `rows` is read twice.
    """
    names = list(rules())
    counts = rows.groupBy(F.col(host).alias("q_host")).agg(
        F.count(F.lit(1)).alias("documents"),
        *[F.sum(rule.cast("long")).alias(f"failed_{n}") for n, rule in rules().items()])
    share = {n: F.col(f"failed_{n}") / F.col("documents") for n in names}
    prior = counts.agg(*[F.avg(share[n]).alias(f"m_{n}") for n in names],
                       *[F.var_pop(share[n]).alias(f"v_{n}") for n in names]).first()
    known = counts
    for n in names:
        m, v = prior[f"m_{n}"] or 0.0, prior[f"v_{n}"] or 0.0
        strength = min(1e6, max(1.0, m * (1 - m) / v - 1)) if v > 0 else 1e6
        known = known.withColumn(f"rate_{n}", (F.col(f"failed_{n}") + m * strength)
                                 / (F.col("documents") + strength))
    worst = F.greatest(*[F.col(f"rate_{n}") for n in names])
    return known.select("q_host", "documents", *[f"rate_{n}" for n in names],
                        (worst <= MAX_RATE).alias("host_kept"))


def judged(rows: DataFrame, counted: DataFrame, host: str = "source") -> DataFrame:
    """`rows` of `measured` with base_failed, host_kept and kept.

    The hosts are judged on `counted`, the same rows or the columns of them that rules need;
    their verdicts are stored, so Spark knows the table's size when it plans the join.
    """
    verdicts = stored(host_rates(counted, host).select("q_host", "host_kept"), "hosts")
    return (rows.join(verdicts, F.col(host).eqNullSafe(F.col("q_host")))
            .withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & F.col("host_kept")).drop("q_host"))
