"""URL verdicts: host and path rules first, boosted trees on lexical features for the rest.

A rule names a host and the start of a path; it fits that host and its subdomains and the
longest fitting rule (host, then path) decides. URLs that a rule decides are the labelled ones:
gradient-boosted trees learn allow and block from their lexical features (length, depth, digit
ratio, entropy, parameter counts, statistics of the host suffix) and judge every other URL. A
suffix is the last two labels of the host; its statistics are the labelled URLs that have it and
their block rate, shrunk towards the rate of all by SUFFIX_PRIOR URLs. The other features hold no
names, so the trees learn form and not the list.

The trees are fit on at most TRAIN_ROWS distinct labelled URLs, those of the smallest hashes of
(seed, url), each weighted by its rows: a bounded, repeatable sample that no repeated URL fills.
Everything else, the suffix statistics too, runs over all rows with native expressions.

Defined cases: a null URL or one without `://` has empty host and path and is judged by the
trees; if the labelled URLs hold one class or none, every other URL gets the class that is
there, or `allow`; ties and repeated rows get equal verdicts; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.shared import stored

Rule = tuple[str, str, str]  # verdict, host, start of the path

RULES: tuple[Rule, ...] = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"))
TRAIN_ROWS = 20_000
SUFFIX_PRIOR = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "n_params", "n_fragment",
            "n_hyphens", "n_labels", "longest_label", "path_digits", "suffix_length",
            "extension", "trailing_slash", "secure", "suffix_count", "suffix_rate")


def with_parts(pages: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, url, host (A-Z lowered) and path; both empty without `://`."""
    rest = F.when(F.contains("url", F.lit("://")),
                  F.substr("url", F.locate("://", "url") + 3, F.length("url")))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.select(*keep, "url", F.coalesce(host, F.lit("")).alias("host"),
                        F.coalesce(path, F.lit("")).alias("path"))


def rule_of(rules: Sequence[Rule] = RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule of a row with host and path, or null.

    A rule is written host + path, `net/` for the host net and the path start /.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1]), len(r[2]))):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith(
            "path", F.lit(path))
        out = F.when(fits, F.struct(F.lit(host + path).alias("rule"),
                                    F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Bits per character, of the characters in [a-z0-9/.-] and of all others together."""
    n = F.greatest(F.length(text), F.lit(1))
    known = "abcdefghijklmnopqrstuvwxyz0123456789/.-"
    counts = [F.length(text) - F.length(F.replace(text, F.lit(c))) for c in known]
    rest = F.length(text)
    for c in counts:
        rest = rest - c
    total = F.lit(0.0)
    for c in [*counts, rest]:
        total = total - F.when(c > 0, c / n * F.log2(c / n)).otherwise(0.0)
    return total


def with_features(rows: DataFrame, suffixes: Suffixes) -> DataFrame:
    """Features of rows with url, host and path as double columns."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    n = F.greatest(F.length(url), F.lit(1))
    without = F.length(F.regexp_replace(url, "[0-9]", ""))
    label = F.substring_index(host, ".", 1)
    query = F.when(F.contains(url, F.lit("?")), F.substring_index(url, "?", -1)).otherwise("")

    def times(text: Column, mark: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(mark)))

    values = {
        "length": F.length(url), "host_length": F.length(host), "depth": times(path, "/"),
        "digit_ratio": (F.length(url) - without) / n, "entropy": entropy(F.lower(url)),
        "n_params": times(query, "="), "n_fragment": times(url, "#"),
        "n_hyphens": times(url, "-"), "n_labels": times(host, ".") + 1,
        "longest_label": F.length(label),
        "path_digits": F.length(path) - F.length(F.regexp_replace(path, "[0-9]", "")),
        "suffix_length": F.length(F.substring_index(host, ".", -1)),
        "extension": path.rlike(r"\.[a-z]{2,5}$").cast("int"),
        "trailing_slash": F.endswith(path, F.lit("/")).cast("int"),
        "secure": F.startswith(url, F.lit("https")).cast("int"),
    }
    known = rows.withColumns({f"f_{k}": v.cast("double") for k, v in values.items()})
    return known.join(suffixes.rates, F.substring_index("host", ".", -2) == F.col("f_suffix"),
                      "left").withColumns({
        "f_suffix_count": F.log1p(F.coalesce("f_labelled", F.lit(0.0))),
        "f_suffix_rate": F.coalesce("f_rate", F.lit(suffixes.prior))}).drop(
        "f_suffix", "f_labelled", "f_rate")


@dataclass(frozen=True)
class Suffixes:
    """Block rates of host suffixes among all labelled rows, one row for each."""

    rates: DataFrame
    prior: float


@dataclass(frozen=True)
class UrlModel:
    """Trees, or the only verdict that the labels hold."""

    suffixes: Suffixes
    trees: GBTClassificationModel | None
    only: str | None = None

    def judge(self, rows: DataFrame) -> DataFrame:
        """`rows` with block_score (null without trees) and own, the verdict by the model."""
        if self.trees is None:
            return rows.withColumns({"block_score": F.lit(None).cast("double"),
                                     "own": F.lit(self.only)})
        scored = self.trees.transform(assembler().transform(
            with_features(rows, self.suffixes))).withColumn(
            "block_score", vector_to_array("probability")[1])
        return scored.withColumn(
            "own", F.when(F.col("block_score") > 0.5, "block").otherwise("allow"))


def assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features")


def train(labelled: DataFrame, most: int = TRAIN_ROWS, rounds: int = 20, depth: int = 4,
          seed: int = 7) -> UrlModel:
    """The model of rows(url, host, path, verdict).

    Suffix counts and rates come from all rows; the trees from the `most` distinct URLs of
    smallest hash, weighted by their rows. Both are stored.
    """
    rows = labelled.withColumn("label", (F.col("verdict") == "block").cast("double"))
    counts = stored(rows.groupBy(F.substring_index("host", ".", -2).alias("f_suffix")).agg(
        F.count(F.lit(1)).cast("double").alias("f_labelled"),
        F.sum("label").alias("f_blocked")), "url-suffixes")
    total = counts.agg(F.sum("f_labelled").alias("n"), F.sum("f_blocked").alias("blocked")).first()
    prior = total["blocked"] / total["n"] if total["n"] else 0.0
    rates = counts.select("f_suffix", "f_labelled", (
        (F.col("f_blocked") + SUFFIX_PRIOR * prior) / (F.col("f_labelled") + SUFFIX_PRIOR))
        .alias("f_rate"))
    suffixes = Suffixes(rates, prior)
    if prior in (0.0, 1.0):
        return UrlModel(suffixes, None, "block" if prior else "allow")
    sample = stored(rows.groupBy("url", "host", "path", "label").agg(
        F.count(F.lit(1)).cast("double").alias("weight"))
        .withColumn("f_hash", F.xxhash64(F.lit(seed), "url"))
        .orderBy("f_hash", "url").limit(most).drop("f_hash"), "urls")
    data = assembler().transform(with_features(sample, suffixes)).select(
        "features", "label", "weight")
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed, weightCol="weight")
    return UrlModel(suffixes, trees.fit(data))


def judged(pages: DataFrame, rules: Sequence[Rule] = RULES,
           model: UrlModel | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score of pages(page_id, url).

    Without a model, one is trained on the pages that the rules decide.
    """
    rows = with_parts(pages, "page_id").withColumn("hit", rule_of(rules)).select(
        "*", "hit.rule", "hit.verdict").drop("hit")
    if model is None:
        model = train(rows.where("rule is not null"))
    return model.judge(rows).select("page_id", "host", "path", "rule",
                                    F.coalesce("verdict", "own").alias("verdict"), "block_score")
