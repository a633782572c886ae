"""Orders by rank tables, heads of orders, and choices of one row per key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_of(column: Column | str, ranks: Mapping[str, int], other: int | None = None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    out = F.lit(len(ranks) if other is None else other)
    for value, rank in ranks.items():
        out = F.when(c == value, rank).otherwise(out)
    return out


def top(df: DataFrame, order: Sequence[Column], k: int, skip: int = 0) -> DataFrame:
    """A page of the order; the order should be total, so that pages do not overlap."""
    return df.orderBy(*order).offset(skip).limit(k)


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark cuts each partition to k rows per key before it shuffles."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("nth", nth).where(F.col("nth") <= k)


def one_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    return top_per(df, keys, order, 1).drop("nth")


def least_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """As one_per for an ascending order, but as an aggregate with map-side combine: a hot key is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(pick.alias("own")).select(*keys, "own.*")
