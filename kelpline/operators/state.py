"""User state as long tables: three-way merges, workflow ranks, quarantine of bad rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def three_way_merge(latest: DataFrame, before: DataFrame, after: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """latest with the changes from before to after: what after adds or changes is set, what it drops is
    deleted, and what it leaves alone stays as it is in latest."""
    b, a = before.withColumnRenamed(value, "b_value"), after.withColumnRenamed(value, "a_value")
    b, a = b.withColumn("b_here", F.lit(True)), a.withColumn("a_here", F.lit(True))
    delta = b.join(a, list(keys), "full")
    same = F.col("b_here").eqNullSafe(F.col("a_here")) & F.col("b_value").eqNullSafe(F.col("a_value"))
    delta = delta.where(~same).select(*keys, "a_value", F.col("a_here").isNotNull().alias("set"))
    t = latest.withColumn("l_here", F.lit(True)).join(delta, list(keys), "full")
    t = t.where(F.coalesce("set", F.lit(True)) & (F.col("l_here").isNotNull() | F.coalesce("set", F.lit(False))))
    return t.select(*keys, F.when(F.col("set"), F.col("a_value")).otherwise(F.col(value)).alias(value))


def rank_merge(states: DataFrame, keys: Sequence[str], state: str, ranks: Mapping[str, int]) -> DataFrame:
    """Of several states of a key the one of the highest rank; unknown states rank lowest."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[F.col(state)], F.lit(-1))
    return states.groupBy(*keys).agg(F.max_by(F.col(state), F.struct(rank, F.col(state))).alias(state))


def rename_keys(states: DataFrame, key: str, aliases: DataFrame) -> DataFrame:
    """Keys that are an alias become the new key.  aliases (alias, new_key), one row per alias."""
    t = states.join(aliases, F.col(key) == F.col("alias"), "left")
    return t.withColumn(key, F.coalesce("new_key", key)).drop("alias", "new_key")


def violations(df: DataFrame, row_id: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """(row_id, rule) for each rule that a row breaks, in one pass; a null verdict breaks nothing."""
    bad = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]))
    return df.select(row_id, F.explode(bad).alias("rule"))


def quarantine(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad ones with the reasons."""
    bad = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]))
    t = df.withColumn("reasons", bad)
    return t.where(F.size("reasons") == 0).drop("reasons"), t.where(F.size("reasons") > 0)


def merge_storage(latest: DataFrame, before: DataFrame, after: DataFrame, ranks: Mapping[str, int], mode: str = "edit") -> DataFrame:
    """Rows (area, item, value) of all of a user's areas, merged three ways.

    In import mode an item of area states that both sides have keeps the value of the higher rank.  Last, what has lost
    its ground goes: new marks of items that are reviewed, and reasons of items that are not hidden.
    """
    t = three_way_merge(latest, before, after, ["area", "item"])
    if mode == "import":
        mine = latest.where("area = 'states'").join(after.select("area", "item"), ["area", "item"], "left_semi")
        both = rank_merge(t.where("area = 'states'").unionByName(mine), ["area", "item"], "value", ranks)
        t = t.where("area <> 'states'").unionByName(both.select("area", "item", "value"))
    of = lambda area: t.where(F.col("area") == area).select("item")
    stale_new = of("new").join(of("reviewed"), "item", "left_semi").withColumn("area", F.lit("new"))
    stale_reason = of("hidden_reasons").join(of("hidden"), "item", "left_anti").withColumn("area", F.lit("hidden_reasons"))
    return t.join(stale_new.union(stale_reason), ["area", "item"], "left_anti")


def accepted_backup(rows: DataFrame, rules: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(rows, report): a backup is taken whole or not at all; report (rule, n) of what is wrong with it."""
    bad = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]))
    report = rows.select(F.explode(bad).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
    return rows if report.isEmpty() else rows.limit(0), report


def duplicate_keys(df: DataFrame, key: str, rule: str = "unique") -> DataFrame:
    """(key, rule) for keys that more than one row has, in the form of `violations`."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit(rule).alias("rule"))


def summary_mismatches(df: DataFrame, summary: DataFrame, by: str, measures: Mapping[str, Column]) -> DataFrame:
    """(by, measure, stated, found) where a stated summary (by, measure columns) is not what its rows add up to; a group that one
    side lacks counts as 0 there."""
    found = df.groupBy(by).agg(*[c.cast("double").alias(f"_{n}") for n, c in measures.items()])
    t = summary.select(by, *[F.col(n).cast("double").alias(n) for n in measures]).join(found, by, "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rows = F.array(*[F.when(zero(n) != zero(f"_{n}"), F.struct(F.lit(n).alias("measure"), zero(n).alias("stated"), zero(f"_{n}").alias("found"))) for n in measures])
    return t.select(by, F.explode(F.array_compact(rows)).alias("m")).select(by, "m.*")
