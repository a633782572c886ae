"""Filters as data: conjunctions of optional predicates, facets, vetoes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name -> value -> predicate
Predicates = Mapping[str, Callable[[object], Column]]


def search(columns: Sequence[str]) -> Callable[[object], Column]:
    """Case-insensitive substring search over the concatenated columns."""
    return lambda v: F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(str(v).lower()))


def equals(column: str) -> Callable[[object], Column]:
    return lambda v: F.col(column) == F.lit(v)


def one_of(column: str) -> Callable[[object], Column]:
    return lambda v: F.col(column).isin(*v)


def member(array: str, scalar: str | None = None) -> Callable[[object], Column]:
    """In the array; an absent array falls back to the scalar column."""
    own = F.coalesce(F.col(array), F.array(F.col(scalar))) if scalar else F.col(array)
    return lambda v: F.array_contains(own, F.lit(v))


def at_least(column: str) -> Callable[[object], Column]:
    return lambda v: F.col(column) >= F.lit(v)


def at_most(column: str) -> Callable[[object], Column]:
    return lambda v: F.col(column) <= F.lit(v)


def newer_than(column: str, now: str) -> Callable[[object], Column]:
    """At most so many days before now; epoch milliseconds, so that part days count."""
    millis = lambda c: F.unix_millis(c.cast("timestamp"))
    return lambda days: millis(F.lit(now)) - millis(F.col(column)) <= F.lit(int(days) * 86_400_000)


def conjunction(predicates: Predicates, values: Mapping[str, object], ignore: Iterable[str] = ()) -> Column:
    """Those predicates that have a value, are not ignored, and whose value is neither None nor empty."""
    active = [predicates[k](v) for k, v in values.items() if k not in set(ignore) and v not in (None, "", [], ())]
    return reduce(lambda a, b: a & b, active, F.lit(True))


def matching(df: DataFrame, predicates: Predicates, values: Mapping[str, object], ignore: Iterable[str] = ()) -> DataFrame:
    return df.where(conjunction(predicates, values, ignore))


def facets(df: DataFrame, predicates: Predicates, values: Mapping[str, object], columns: Mapping[str, str]) -> DataFrame:
    """(facet, value, n): for each facet its values under all filters but its own, in one scan.

    Rows are expanded to the facets whose other filters they pass before they are counted.
    """
    options = [
        F.when(conjunction(predicates, values, [name]) & F.col(column).isNotNull(), F.struct(F.lit(name).alias("facet"), F.col(column).cast("string").alias("value")))
        for name, column in columns.items()
    ]
    each = df.select(F.explode(F.array_compact(F.array(*options))).alias("f")).select("f.*")
    return each.groupBy("facet", "value").agg(F.count("*").alias("n"))


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, null where none does."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def split_by_reason(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Kept rows, and rejected rows with their reason."""
    marked = df.withColumn("reason", first_reason(rules))
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())
