"""Merkle manifest of a table: a tree per part, a tree of the parts' roots, proofs per row.

A row's leaf is the SHA-256 of its fields. In a part, rows ascend by id; every `ARITY`
consecutive nodes form a run, whose node a level up is the hash of theirs, until one remains, the
part's subroot. Subroots, ordered by part, form the last tree.

A level is a table of nodes (tree, run, slot, digest). Siblings come from self-joins by shifted
slots: for every shift the sibling's slot is (slot + shift) mod ARITY, for two slots the XOR with
one. Siblings lie in the same run, so all joins of a level share one dealing of the nodes by
(tree, run) and shuffle nothing else; a run has at most ARITY nodes. The rows of slot zero then
hold the whole run and emit its parent. Proofs go down the tree: a node's path is its own
siblings and its parent's path, so only paths of parents are stored and meet the rows in one join.

Places in a part come from a range partitioning by (part, id, leaf): a row's place is its
number in its own partition plus the counts of earlier ones, so a part with most of the rows is
spread over many tasks.

Defined cases: a null field is `-`; the null part comes first; rows of equal id ascend by leaf
(equal rows have equal leaves, either may come first); a null id comes first and is never
tampered with; a part of one row has its leaf as subroot, a table of one part its subroot as
root; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.shared import stored

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_of(fields: list[Column]) -> Column:
    """Hex SHA-256 of all fields, each `-` or its byte count, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t),
                                        F.lit("-")) for t in texts]), 256)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows(tree, ...) with place, their number from 0 within tree by `order`, and size, the rows
    of tree; stored."""
    ranged = stored(
        rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
        .withColumn("id", F.monotonically_increasing_id()), "merkle-ranged")
    # The identifier holds the partition above 33 bits and the row's number in it below.
    ranged = ranged.withColumn("piece", F.shiftright("id", 33))
    counts = ranged.groupBy("tree", "piece").agg(
        F.min("id").alias("start"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("tree")
    earlier = whole.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("tree", "piece", "start", F.sum("n").over(whole).alias("size"),
                          F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return stored(ranged.join(bases, ["tree", "piece"]).withColumn(
        "place", F.col("id") - F.col("start") + F.col("base")).drop(
        "id", "piece", "start", "base"), "merkle-placed")


def with_siblings(nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    """nodes(tree, place, digest, ...) with run, slot, before, after: the run's other digests.

    Nodes have unique places, gapless from 0, in a tree.
    """
    dealt = nodes.withColumns({
        "run": F.expr(f"place div {arity}"), "slot": F.expr(f"cast(place % {arity} as int)"),
    }).repartition("tree", "run")
    out = dealt
    for shift in range(1, arity):
        if arity == 2:
            sibling = F.col("slot").bitwiseXOR(F.lit(1))
        else:
            sibling = F.pmod(F.col("slot") + shift, F.lit(arity))
        other = dealt.select(F.col("tree").alias("o_tree"), F.col("run").alias("o_run"),
                             F.col("slot").alias("o_slot"), F.col("digest").alias(f"sib{shift}"))
        # The difference keeps the slot out of the join's keys, which the dealing covers.
        out = out.join(other, (F.col("tree") == F.col("o_tree")) & (F.col("run") == F.col("o_run"))
                       & ((F.col("o_slot") - sibling) == 0), "left").drop(
            "o_tree", "o_run", "o_slot")

    def side(wanted: Callable[[int], Column]) -> Column:
        # Shift s of slot t is slot t + s, or t + s - arity: rising slots are rising shifts.
        return F.concat(*[F.when(wanted(s), F.coalesce(f"sib{s}", F.lit(""))).otherwise("")
                          for s in range(1, arity)])

    return out.withColumns({"before": side(lambda s: F.col("slot") + s >= arity),
                            "after": side(lambda s: F.col("slot") + s < arity)}).drop(
        *[f"sib{s}" for s in range(1, arity)])


def parents(level: DataFrame) -> DataFrame:
    """Nodes a level up: the rows of slot zero hash their own digest and all that follow."""
    return level.where("slot = 0").select(
        "tree", F.col("run").alias("place"), "size",
        F.sha2(F.concat("digest", "after"), 256).alias("digest"))


def climbed(leaves: DataFrame, arity: int = ARITY) -> tuple[list[DataFrame], DataFrame]:
    """(levels, roots) of leaves(tree, place, size, digest).

    levels holds the nodes of each level that have a level above; roots is (tree, digest, level).
    """
    largest = leaves.agg(F.max("size")).first()[0] or 0
    levels, roots = [], None
    nodes, n = leaves.select("tree", "place", "size", "digest"), 1
    while True:
        done = nodes.where(F.expr(f"size <= {n}")).select(
            "tree", "digest", F.lit(len(levels)).alias("level"))
        roots = done if roots is None else roots.union(done)
        if largest <= n:
            return levels, roots
        levels.append(nodes.where(F.col("size") > n))
        nodes, n = stored(parents(with_siblings(levels[-1], arity)), "merkle-level"), n * arity


def with_paths(levels: list[DataFrame], tops: DataFrame, leaves: DataFrame,
               arity: int = ARITY) -> DataFrame:
    """leaves(tree, place, size, digest, ...) with subroot and path, the siblings from the leaf up.

    tops(tree, level, subroot, path) has the path above the root of each tree.
    """
    def started(level: int) -> DataFrame:
        return tops.where(F.col("level") == level).select(
            "tree", F.lit(0).cast("long").alias("run"), "subroot", F.col("path").alias("upper"))

    upper = started(len(levels))
    for k in reversed(range(1, len(levels))):
        own = with_siblings(levels[k], arity).join(upper, ["tree", "run"]).select(
            "tree", F.col("place").alias("run"), "subroot", _grown().alias("upper"))
        upper = stored(own, "merkle-paths").union(started(k))
    below = with_siblings(leaves.where("size > 1"), arity).join(upper, ["tree", "run"]).withColumn(
        "path", _grown())
    alone = leaves.where("size <= 1").join(started(0), "tree").withColumn("path", F.col("upper"))
    columns = [*leaves.columns, "subroot", "path"]
    return below.select(*columns).union(alone.select(*columns))


def _grown() -> Column:
    return F.concat(F.array(F.struct("before", "after")), "upper")


def manifest(docs: DataFrame, tampered: Column, change: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row.

    `tampered` tells the rows whose text `change` replaces before their proof is folded.
    """
    own = leaf_of([F.col(f) for f in FIELDS])
    other = leaf_of([F.when(tampered, change).otherwise(F.col("text")) if f == "text"
                     else F.col(f) for f in FIELDS])
    rows = docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
        .alias("tree"), own.alias("leaf"), F.when(tampered, other).alias("changed"))
    leaves = placed(rows, ["doc_id", "leaf"]).withColumn("digest", F.col("leaf"))
    levels, subroots = climbed(leaves)
    tops = placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest",
                                  "level"), ["name"])
    top_levels, roots = climbed(tops)
    root = roots.first()  # one row, none of an empty table
    start = roots.select("tree", "level", F.col("digest").alias("subroot"),
                         F.array().cast("array<struct<before:string,after:string>>").alias("path"))
    # The path above the subroots is the last part of every proof.
    top = with_paths(top_levels, start, tops).select(
        F.col("name").alias("tree"), "level", F.col("digest").alias("subroot"), "path")
    whole = with_paths(levels, stored(top, "merkle-tops"), leaves).withColumn(
        "root", F.lit(root["digest"] if root else None).cast("string"))
    folded = F.aggregate("path", F.coalesce("changed", "leaf"),
                         lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))
    proof = F.sha2(F.array_join(F.transform(
        "path", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    return whole.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"),
                        folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def third_tampered(docs: DataFrame) -> DataFrame:
    """The manifest of documents where ids whose CRC 32 is a multiple of three are lower-cased."""
    third = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0,
                       F.lit(False))
    return manifest(docs, third, F.translate("text", UPPER, LOWER))
