"""Joins of listings: with defaults, by prioritised keys, against sets, by longest alias."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_default(df: DataFrame, dim: DataFrame, on: str, defaults: Mapping[str, object]) -> DataFrame:
    """Left join with a dimension; absent rows and null fields take the defaults."""
    names = [c for c in dim.columns if c != on]
    out = df.join(dim, on, "left")
    for name in names:
        if name in defaults:
            out = out.withColumn(name, F.coalesce(F.col(name), F.lit(defaults[name])))
    return out


def keyed(df: DataFrame, row_id: str, keys: Sequence[Column]) -> DataFrame:
    """(row_id, key, priority): each row once for each non-empty key in its arrays of keys."""
    tagged = [F.transform(F.coalesce(k, F.array().cast("array<string>")), _tag(i)) for i, k in enumerate(keys)]
    each = df.select(F.col(row_id), F.explode(F.concat(*tagged)).alias("k"))
    return each.select(row_id, "k.key", "k.priority").where("key is not null and key <> ''")


def _tag(priority: int):
    return lambda x: F.struct(x.alias("key"), F.lit(priority).alias("priority"))


def prioritised(left: DataFrame, left_id: str, left_keys: Sequence[Column], right: DataFrame, right_id: str, right_keys: Sequence[Column], last_writer: bool = False) -> DataFrame:
    """(left_id, right_id, priority): for each left row the one right row it matches.

    Keys are tried in order of the left row's priority.  A key that several right rows have belongs to the
    one that has it with the better priority, and among those to the first by id (or the last,
    with last_writer).  Keys are exploded and joined by equality: an OR of keys would be a nested loop.
    """
    owner = keyed(right, right_id, right_keys)
    rank = F.struct("priority", F.col(right_id))
    own = F.max_by(F.struct(right_id), F.struct(-F.col("priority"), F.col(right_id))) if last_writer else F.min_by(F.struct(right_id), rank)
    owner = owner.groupBy("key").agg(own.alias("own")).select("key", f"own.{right_id}")
    found = keyed(left, left_id, left_keys).join(owner, "key")
    best = F.min(F.struct("priority", F.col(right_id)))
    return found.groupBy(left_id).agg(best.alias("b")).select(left_id, f"b.{right_id}", "b.priority")


def anti_any(df: DataFrame, row_id: str, keys: Sequence[Column], seen: DataFrame) -> DataFrame:
    """Rows none of whose keys is in seen (key); rows without keys stay."""
    hit = keyed(df, row_id, keys).join(seen.select("key").distinct(), "key", "left_semi").select(row_id).distinct()
    return df.join(hit, row_id, "left_anti")


def longest_alias(texts: DataFrame, row_id: str, text: str, aliases: DataFrame, name: str) -> DataFrame:
    """texts (row_id unique) with `name` of the longest alias that occurs as whole words; null if several names tie.

    aliases (alias, name), of any number of words.  Only the distinct words of a text are exploded, and they meet aliases by
    their first word; what is left is looked for in the text whole, so that neither side is multiplied by the other.
    """
    spaced = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    low = aliases.select(spaced(F.col("alias")).alias("_alias"), F.col(name).alias("_name")).where("_alias <> ''").distinct()
    low = low.withColumn("_word", F.split_part("_alias", F.lit(" "), F.lit(1)))
    words = texts.select(row_id, F.explode(F.array_distinct(F.split(spaced(F.col(text)), " "))).alias("_word"))
    met = words.join(low, "_word").groupBy(row_id).agg(F.collect_set(F.struct(F.length("_alias").alias("n"), "_alias", "_name")).alias("_met"))
    t = texts.join(met, row_id, "left").withColumn("_text", F.when(F.col("_met").isNotNull(), F.concat(F.lit(" "), spaced(F.col(text)), F.lit(" "))))
    t = t.withColumn("_hit", F.filter("_met", lambda m: F.contains(F.col("_text"), F.concat(F.lit(" "), m["_alias"], F.lit(" ")))))
    longest = F.array_max(F.transform("_hit", lambda m: m["n"]))
    names = F.array_distinct(F.transform(F.filter("_hit", lambda m: m["n"] == longest), lambda m: m["_name"]))
    return t.withColumn(name, F.when(F.size(names) == 1, F.get(names, F.lit(0)))).drop("_met", "_text", "_hit")


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of changes replace those of base with the same key, and new ones are added."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def prefix_join(df: DataFrame, row_id: str, on: str, prefixes: DataFrame, prefix: str, separator: str) -> DataFrame:
    """Left join where df's key equals the prefix or starts with it and the separator.

    The part before each separator is a candidate, so this is an equi-join; the longest prefix wins.
    """
    parts = F.split(F.col(on), F.lit(separator if separator.isalnum() else "\\Q" + separator + "\\E"))
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))
    each = df.select(row_id, F.explode(heads).alias(prefix)).join(prefixes, prefix)
    rest = [c for c in prefixes.columns if c != prefix]
    best = each.groupBy(row_id).agg(F.max_by(F.struct(prefix, *rest), F.length(prefix)).alias("b")).select(row_id, "b.*")
    return df.join(best, row_id, "left")
