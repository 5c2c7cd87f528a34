"""Order statistics that stay whole when one group holds most of the rows.

A window over a group would sort that group in one task. Here the distinct (group, value) cells
are dealt into ranges of the whole order (group first, then value) and written once; a range
holds its share of all cells, so a window over (group, range) is small whichever group is large,
and the totals of the lower ranges of a group, at most one for each range, are added. Several
columns and groupings go through one such pass (`rank_cube`). There is one way for all sizes, and
results are exact: the ranges only deal out work. A pass writes its cells below the checkpoint
folder, so what uses them often reads files instead of planning the same work again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import stored

Order = Sequence[tuple[str, str]]  # (column, 'asc' | 'desc')


# Rows of one task after a dealing; its sorts and sums then stay below some hundred MB.
ROWS_A_TASK = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows by keys in as many partitions as ``rows`` (a count from the footers) call for.

    Tasks keep their size when the input grows, whatever the session's number of partitions.
    """
    return df.repartition(_tasks(df, rows), *keys)


def _tasks(df: DataFrame, rows: int) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in ``order``.

    The rank-1 filter becomes a per-partition limit before the shuffle, so copies of
    one key are reduced where they are read.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("__rn", F.row_number().over(w))
            .where(F.col("__rn") == 1).drop("__rn"))


def keep_one_dealt(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                   place: Sequence[str], rows: int) -> DataFrame:
    """:func:`keep_one` of some ``rows`` in tasks of a bounded size, whatever the session's
    number of partitions.

    The copies of a key are dealt over all tasks by ``place``, columns that tell them apart, and
    reduced there first; so a key may hold any share of the rows.
    """
    tasks = _tasks(df, rows)
    share = F.pmod(F.xxhash64(*place), F.lit(tasks))
    few = keep_one(df.withColumn("__share", share).repartition(tasks, *keys, "__share"),
                   [*keys, "__share"], order).drop("__share")
    return keep_one(few.repartition(tasks, *keys), keys, order)


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
          rank_name: str | None = None) -> DataFrame:
    """First ``n`` rows per key; ``n`` is a constant, so each task keeps ``n`` per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n)
    if rank_name is None:
        return out.drop("__rn")
    return out.withColumnRenamed("__rn", rank_name)


def _same(keys: Sequence[str]) -> Column:
    """Join condition ``key <=> __key`` (null keys form a group of their own)."""
    return reduce(lambda a, b: a & b,
                  [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.lit(True))


def _sorted_by(order: Order) -> list[Column]:
    return [F.col(c).desc() if how == "desc" else F.col(c).asc() for c, how in order]


def running_before(
    cells: DataFrame,
    keys: Sequence[str],
    order: str | Order,
    sums: Mapping[str, str],
) -> DataFrame:
    """Per row: the sum of each measure over the rows of its group that come earlier in ``order``.

    ``cells`` holds one row per (keys, order columns). ``sums`` maps a measure to a prefix; the
    result gains ``{prefix}_before`` and ``{prefix}_total``.
    """
    by = _sorted_by([(order, "asc")] if isinstance(order, str) else order)
    # Keys in one struct, in which nulls are equal: joins then need no second shuffle.
    group = F.struct(*keys) if keys else F.lit(0)
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = stored(cells.withColumn("__group", group)
                    .repartitionByRange(n, "__group", *by)
                    .withColumn("__range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("__group", "__range").orderBy(*by).rowsBetween(
        Window.unboundedPreceding, -1)
    local = tagged.withColumns({
        f"{p}_before": F.coalesce(F.sum(m).over(inside), F.lit(0).cast("bigint"))
        for m, p in sums.items()})
    totals = tagged.groupBy("__group", "__range").agg(
        *[F.sum(m).alias(f"__{p}") for m, p in sums.items()])
    spec = Window.partitionBy("__group").orderBy("__range")  # at most a row for each range
    lower = spec.rowsBetween(Window.unboundedPreceding, -1)
    whole = spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "__group", "__range",
        *[F.coalesce(F.sum(f"__{p}").over(lower), F.lit(0).cast("bigint")).alias(f"__{p}_low")
          for p in sums.values()],
        *[F.sum(f"__{p}").over(whole).alias(f"{p}_total") for p in sums.values()])
    return local.join(offsets, ["__group", "__range"]).select(
        *cells.columns,
        *[(F.col(f"{p}_before") + F.col(f"__{p}_low")).alias(f"{p}_before")
          for p in sums.values()],
        *[f"{p}_total" for p in sums.values()])


def value_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per (keys, value): ``n_eq``, ``n_before`` (rows below), ``n_total``.

    Equal values are counted before the shuffle, so a value that fills a third of a
    group is one row here. Rows with a null value are left out.
    """
    cells = (df.where(F.col(value).isNotNull()).groupBy(*keys, value)
             .agg(F.count(F.lit(1)).alias("n_eq")))
    return running_before(cells, keys, value, {"n_eq": "n"})


def rank_cube(df: DataFrame, specs: Mapping[str, tuple[Sequence[str], Order]]) -> DataFrame:
    """Every row with ``{prefix}_eq``, ``{prefix}_before`` and ``{prefix}_total`` of each spec.

    A spec is (keys, order): rows are placed within the group of its keys by numeric columns,
    ties going on to the next one. ``_eq`` counts the rows with the same place, ``_before`` those
    ahead, ``_total`` the rows of the group that have all order columns; a row that lacks one has
    null in all three. All specs are ranked in one pass over one unpivoted relation. The rows are
    read twice, so what they derive from is worked out once and written.
    """
    df = stored(df, "rows")
    types = dict(df.dtypes)
    whole = {"tinyint", "smallint", "int", "bigint"}
    width = max(len(order) for _, order in specs.values())

    def key(keys: Sequence[str]) -> Column:
        return F.array(*[F.col(k).cast("string") for k in keys]).cast("array<string>")

    def marks(order: Order) -> list[Column]:
        """Two numbers for a column, of which one ascending order serves all specs.

        A double, negated for a descending column, and of whole numbers all digits besides.
        """
        out = []
        for c, how in order:
            value, digits = F.col(c).cast("double") + F.lit(0.0), F.lit(0).cast("bigint")
            if types[c] in whole:
                digits = F.col(c).cast("bigint")
            out += [-value, F.bitwise_not(digits)] if how == "desc" else [value, digits]
        return out + [F.lit(0.0), F.lit(0).cast("bigint")] * (width - len(order))

    names = [f"__o{i}" for i in range(2 * width)]
    arms = F.array(*[
        F.struct(F.lit(i).alias("__spec"), key(keys).alias("__keys"),
                 *[c.alias(n) for n, c in zip(names, marks(order), strict=True)])
        for i, (keys, order) in enumerate(specs.values())])
    long = df.select(F.explode(arms).alias("a")).select("a.*")
    for n in names:
        long = long.where(F.col(n).isNotNull())
    cells = long.groupBy("__spec", "__keys", *names).agg(F.count(F.lit(1)).alias("__eq"))
    ranked = stored(running_before(cells, ["__spec", "__keys"], [(n, "asc") for n in names],
                                   {"__eq": "__n"}), "ranks")
    out = df
    for i, (prefix, (keys, order)) in enumerate(specs.items()):
        side = ranked.where(F.col("__spec") == i).select(
            F.struct("__keys", *names).alias("__cell"), F.col("__eq").alias(f"{prefix}_eq"),
            F.col("__n_before").alias(f"{prefix}_before"),
            F.col("__n_total").alias(f"{prefix}_total"))
        own = F.struct(key(keys).alias("__keys"),
                       *[c.alias(n) for n, c in zip(names, marks(order), strict=True)])
        # The right side is unique per cell; adaptive execution splits a large left partition
        # without copying more than that one row.
        out = out.withColumn("__cell", own).join(side, "__cell", "left").drop("__cell")
    return out


def average_rank(descending: bool = False) -> Column:
    """Average rank from the columns of :func:`value_ranks`."""
    below = (F.col("n_total") - F.col("n_before") - F.col("n_eq")) if descending \
        else F.col("n_before")
    return below + (F.col("n_eq") + 1) / 2.0


def with_value_ranks(df: DataFrame, keys: Sequence[str], value: str, prefix: str) -> DataFrame:
    """Every row with ``{prefix}_eq``, ``{prefix}_before`` and ``{prefix}_total``.

    ``{prefix}_total`` counts the rows of the group with a value. A row without a value has
    null in all three.
    """
    return rank_cube(df, {prefix: (keys, [(value, "asc")])})


def row_positions(df: DataFrame, keys: Sequence[str], order: Order, name: str) -> DataFrame:
    """Zero-based position of every row in its group.

    ``order`` lists numeric columns without nulls and ends in one that is unique within the group.
    """
    return (rank_cube(df, {"__place": (keys, order)})
            .withColumnRenamed("__place_before", name).drop("__place_eq", "__place_total"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    levels: Sequence[float], name: str = "quantiles") -> DataFrame:
    """Linear-interpolated quantiles per group as one array column.

    The values are ranked, and only the order statistics next to each level leave the
    ranked cells: two per level. No group is held in memory.
    """
    keys = list(keys)
    ranked = value_ranks(df, keys, value)
    inside = lambda k: (k >= F.col("n_before")) & (k < F.col("n_before") + F.col("n_eq"))
    at = [F.lit(float(q)) * (F.col("n_total") - 1) for q in levels]
    # Two comparisons a level for every cell, floor(h) or ceil(h) being inside; code with all four
    # bounds is too long to be compiled. Only cells that hold a wanted place get an array.
    first, end = (c.cast("double") for c in (F.col("n_before"), F.col("n_before") + F.col("n_eq")))
    held = [(h > first - 1.0) & (h < end) for h in at]
    wanted = F.array_compact(F.array(*[
        F.when(held[i], F.struct(F.lit(i).alias("i"), h.alias("h"))) for i, h in enumerate(at)]))
    picked = (
        ranked.where(reduce(lambda a, b: a | b, held, F.lit(False)))
        .select(*keys, F.col(value).cast("double").alias("__v"), "n_before", "n_eq",
                F.explode(wanted).alias("__w"))
    )
    low, high = F.floor(F.col("__w.h")), F.ceil(F.col("__w.h"))
    ends = picked.groupBy(*keys, F.col("__w.i").alias("__i"), F.col("__w.h").alias("__h")).agg(
        F.max(F.when(inside(low), F.col("__v"))).alias("__lo"),
        F.max(F.when(inside(high), F.col("__v"))).alias("__hi"))
    at = F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (F.col("__h") - F.floor("__h"))
    # At most len(levels) entries per group.
    return (ends.groupBy(*keys)
            .agg(F.sort_array(F.collect_list(F.struct("__i", at.alias("v")))).alias("__q"))
            .select(*keys, F.transform("__q", lambda s: s["v"]).alias(name)))


def order_code_pairs(df: DataFrame, keys: Sequence[str], first: str,
                     second: str) -> DataFrame:
    """Per group: ``n`` rows and ``concordant`` unordered pairs, without forming pairs.

    Two rows agree when both columns order them the same way, strictly. Each row gets an
    order code for ``first``; two different codes part at exactly one binary digit, the
    row with digit 0 being the lower one. So for every digit, rows that share the higher
    digits are summed in the order of ``second``: each digit-1 row meets the count of
    digit-0 rows strictly below it. Work is rows times digits of the group size.
    """
    keys = list(keys)
    cells = (df.where(F.col(first).isNotNull() & F.col(second).isNotNull())
             .groupBy(*keys, first, second).agg(F.count(F.lit(1)).alias("__n")))
    codes = (cells.groupBy(*keys, first).agg(F.sum("__n").alias("__m")))
    codes = running_before(codes, keys, first, {"__m": "__c"})
    coded = cells.join(
        codes.select(*keys, first, F.col("__c_before").alias("__code"),
                     F.col("__c_total").alias("__size")), [*keys, first])
    digits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("__size").cast("double"))).cast("int"))
    spread = coded.withColumn("__d", F.explode(F.sequence(F.lit(0), digits)))
    digit = lambda by: F.call_function("shiftright", F.col("__code"), by)
    levels = (
        spread.withColumn("__node", digit(F.col("__d") + 1))
        .withColumn("__bit", F.pmod(digit(F.col("__d")), F.lit(2)))
        .groupBy(*keys, "__d", "__node", second)
        .agg(F.sum(F.when(F.col("__bit") == 0, F.col("__n")).otherwise(0)).alias("__lo"),
             F.sum(F.when(F.col("__bit") == 1, F.col("__n")).otherwise(0)).alias("__hi"))
    )
    summed = running_before(levels, [*keys, "__d", "__node"], second, {"__lo": "__below"})
    pairs = summed.groupBy(*keys).agg(
        F.sum(F.col("__hi") * F.col("__below_before")).alias("concordant"))
    sizes = cells.groupBy(*keys).agg(F.sum("__n").alias("n"))
    return sizes.join(pairs, keys, "left").withColumn(
        "concordant", F.coalesce("concordant", F.lit(0).cast("bigint"))) if keys else \
        sizes.withColumn("concordant", F.coalesce(pairs.select("concordant").scalar(),
                                                  F.lit(0).cast("bigint")))
