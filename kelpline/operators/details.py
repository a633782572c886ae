"""Small operators on runs, regions and keys: statuses, failure codes, vetoes, fallbacks, fixed orders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def only_one(text: Column, regions: Mapping[str, str]) -> Column:
    """The one region whose pattern a text matches; null if it matches none or several."""
    found = F.array_compact(F.array(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in regions.items()]))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def contradicts(detail: Column, listed: Column) -> Column:
    """Both are known and differ."""
    return F.coalesce(detail != listed, F.lit(False))


def backfill(new: Column, *older: tuple[Column, Column]) -> Column:
    """The newer column, else the first older one whose condition holds."""
    return F.coalesce(new, *[F.when(condition, value) for condition, value in older])


def run_status(enabled: Column, requests: Column, failures: Column, rows: Column) -> Column:
    """disabled, error (nothing but failures), partial, empty or ok."""
    return (
        F.when(~enabled, "disabled").when((failures > 0) & (failures >= requests), "error").when(failures > 0, "partial")
        .when(rows == 0, "empty").otherwise("ok")
    )


def failure_code(status: Column, message: Column) -> Column:
    """A failure as one of few codes, from the response status and else from the message."""
    return (
        F.when(status == 429, "rate_limited").when(status.between(500, 599), "server_error").when(status == 403, "forbidden")
        .when(status.between(400, 499), "client_error").when(message.rlike("(?i)timed? ?out|abort"), "timeout")
        .when(message.rlike("(?i)certificate|tls|ssl"), "tls").when(message.rlike("(?i)enotfound|eai_again|dns"), "dns")
        .when(message.rlike("(?i)reset|refused|network"), "network").when(message.rlike("(?i)parse|syntax|unexpected"), "bad_content").otherwise("unknown")
    )


def is_transient(code: Column) -> Column:
    """Whether another try may help."""
    return code.isin("rate_limited", "server_error", "timeout", "network", "dns")


def content_key(fingerprint: Column, *parts: Column) -> Column:
    """The stored fingerprint, else the parts that are known."""
    return F.coalesce(F.nullif(fingerprint, F.lit("")), F.concat_ws("|", *parts))


def in_fixed_order(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """The distinct values of a column that a fixed order names, with their place in it."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return df.select(column).distinct().withColumn("place", place.cast("int")).where("place > 0")


def due(last: Column, now: Column, hours: int) -> Column:
    """Whether a refresh is due: never done, or longer ago than that."""
    return F.coalesce(last + F.make_dt_interval(F.lit(0), F.lit(hours)) < now, F.lit(True))


def with_rows(df: DataFrame, spark: SparkSession, rows: Sequence[Mapping[str, str]]) -> DataFrame:
    """df and a few literal rows; columns that these lack are null."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    literal = spark.createDataFrame([tuple(r.get(k) for k in names) for r in rows], ", ".join(f"`{k}` string" for k in names))
    return df.unionByName(literal, allowMissingColumns=True)


def first_match_in(values: Column, pattern: str) -> Column:
    """The first element of an array that matches."""
    return F.get(F.filter(values, lambda x: x.rlike(pattern)), F.lit(0))
