"""Registration of queries with their SQL statement."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.plans.bindings import Roles
from panelspark.plans.roles_sql import with_roles
from panelspark.session import ship_package


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Roles], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return self.build(Roles(spark, sf_dir))


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of the roles under its own name."""
    def add(build: Callable[[Roles], DataFrame]) -> Callable[[Roles], DataFrame]:
        name = build.__name__
        QUERIES[name] = Query(name, build, None if sql is None else with_roles(sql))
        return build

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Doubles to 6 decimals, so that sums in another order compare equal; NaN is null."""
    return df.withColumns({n: F.round(F.nullif(F.col(n), F.lit(float("nan"))), 6)
                           for n in names})


def rounded_vector(df: DataFrame, name: str, *keep: str,
                   labels: Sequence[str] | None = None) -> DataFrame:
    """A vector column as one column per entry, rounded."""
    labels = labels or [f"{name}_{i}" for i in range(9)]
    return df.select(*keep, *[F.round(F.get(name, F.lit(i)), 6).alias(n)
                              for i, n in enumerate(labels)])
