"""The corpus pipeline: quality rules, near duplicates, pseudonyms, packing.

A stage takes (spark, docs, sf_dir), works on all rows it is given and returns the columns of
`documents` (further columns stay), the last one the packed pieces. Each result is written as
Parquet and read again as the next stage's docs.

Defined cases: rows with a null or empty text fail the quality rules; the near-duplicate stage
decides by row, that is by doc_id and text, so of repeated rows one stays, unlike texts of one
doc_id are documents of their own, and rows with a null doc_id are judged by their text like all
others; rows with a null text pass it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import minhash, packing, pii, quality
from panelspark.llm.queries import PSEUDONYM_KEY, WORDS, table
from panelspark.llm.shared import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and whose host is kept."""
    whole = docs.select(F.struct("*").alias("row"), "source", "text")
    return quality.judged(quality.measured(whole, "row", "source"),
                          quality.measured(docs, "source")).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class, one with its leading text and smallest doc_id."""
    leaders = minhash.text_classes(docs).where("leads").select(
        F.struct(F.col("class_id").alias("doc_id"), "id").alias("near_key"))
    keyed = docs.where("text is not null").withColumn(
        "near_key", F.struct(F.col("doc_id").cast("long").alias("doc_id"),
                             minhash.text_id().alias("id")))
    # Leaders grow with the corpus: one join strategy at every size, whose dealing of the rows
    # also serves the removal of repeated ones.
    rest = keyed.join(leaders.hint("merge"), "near_key", "left_semi")
    return rest.dropDuplicates(["near_key"]).select(*docs.columns).union(
        docs.where("text is null"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values replaced; n_chars follows the text."""
    out = pii.pseudonymised(docs, PSEUDONYM_KEY)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence of at most 4096 ids and their offset in it."""
    return packing.pack_documents(docs, public_tokenizers.path(WORDS), end_id=1, capacity=4096)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("pseudonyms", pseudonyms),
    ("packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs


ORACLE_SQL = None
