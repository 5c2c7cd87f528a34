"""One query per operator over the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import (
    byte_bpe,
    embeddings,
    filter_audit,
    lm_score,
    merkle,
    minhash,
    packing,
    pii,
    quality,
    sharding,
    suffix_dedup,
    token_files,
    url_filter,
)
from panelspark.llm.oracles import ORACLE_SQL  # noqa: F401
from panelspark.llm.shared import stored
from panelspark.session import ship_package

WORDS = "word_bpe_49k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"
PSEUDONYM_KEY = "key of the test tables"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in sequences of at most 4096 ids of the word vocabulary, id 1 at the end."""
    return packing.pack_documents(table(spark, sf_dir, "documents"),
                                  public_tokenizers.path(WORDS), end_id=1, capacity=4096)


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with personal numbers, dates and addresses replaced by keyed pseudonyms."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymised(docs, PSEUDONYM_KEY, found="n_found")


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every vector at cosine 0.95 and its component."""
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 40 shards of the same mixture of sources; law: equal row counts."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16)
        .cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"))
    return sharding.shards(docs, 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "source", "fraction")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded by the multilingual byte-level ranks."""
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS),
                               public_tokenizers.PATTERN)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document: five words, weighted similarity 0.8."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, own failure and verdict of every document with that of its host."""
    rows = stored(quality.measured(table(spark, sf_dir, "documents"), "doc_id", "source"),
                  "measures")
    return quality.judged(rows, rows).select(
        "doc_id", *quality.MEASURES, "base_failed", "kept", "source", "host_kept")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written to flat files and read back; id 2 ends a document."""
    uri = token_files.write_token_files(table(spark, sf_dir, "documents"),
                                        public_tokenizers.path(WORDS), end_id=2)
    return token_files.read_token_files(spark, uri, with_ids=False)


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean log score of every document under the counts of all others."""
    return lm_score.scores(table(spark, sf_dir, "documents")).withColumns(
        {c: F.round(c, 6) for c in ("log_score", "perplexity")})


def op9_lm_scores_order3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under counts of up to three words; the SQL of `op9_lm_scores` is of order 2."""
    return lm_score.scores(table(spark, sf_dir, "documents"), 3).withColumns(
        {c: F.round(c, 6) for c in ("log_score", "perplexity")})


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL: the rules, else the trees trained on what the rules decide."""
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the bytes of 400-byte strings that start twice or more in the table."""
    return suffix_dedup.cleaned(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document; proofs of a third are folded on changed texts."""
    return merkle.third_tampered(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of the five filters, step by step, for each language."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_pseudonyms, op3_near_vectors, op4_shards, op5_byte_bpe,
    op6_near_duplicates, op7_quality, op8_token_files, op9_lm_scores,
    op9_lm_scores_order3, op10_url_filter, op11_suffix_dedup,
    op12_merkle_manifest, op13_filter_audit)}
