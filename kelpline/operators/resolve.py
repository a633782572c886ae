"""Entity resolution: blocking, compatible clusters, survivors, merges."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.operators.ranking import top_per


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written to the cluster's shared folder and read back, to cut the lineage of an iteration."""
    spark = df.sparkSession
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_kelpline_dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster must name its shared folder in spark.checkpoint.dir")
        root = spark.sparkContext._kelpline_dir = tempfile.mkdtemp(prefix="kelpline-")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def blocking_pairs(df: DataFrame, row_id: str, block: Sequence[Column], condition: Callable[[str, str], Column]) -> DataFrame:
    """(a, b) with a < b: pairs of a block that meet the condition on the aliases "l" and "r".

    A null block key pairs with nothing, and blocks of one row are left out before the join.  The join is by equality,
    whose skewed keys adaptive execution splits; where only numbers are wanted, near_pair_counts needs no pairs.
    """
    keyed = df.withColumn("_block", F.xxhash64(*block)).where(~_any_null(block))
    ok = keyed.groupBy("_block").agg(F.count("*").alias("_n")).where("_n > 1").select("_block")
    full = keyed.join(ok, "_block")
    a, b = full.alias("l"), full.alias("r")
    on = (F.col("l._block") == F.col("r._block")) & (F.col(f"l.{row_id}") < F.col(f"r.{row_id}")) & condition("l", "r")
    return a.join(b, on).select(F.col(f"l.{row_id}").alias("a"), F.col(f"r.{row_id}").alias("b"))


def near_pair_counts(df: DataFrame, block: Sequence[str], value: str) -> DataFrame:
    """(block..., pairs): how many pairs of a block's rows differ by less than 1 in a double; blocks of none are left out.

    Equal values are counted first and meet as counts, in unit ranges with the range itself and the
    next: a value that a third of all rows share is one row.  Nulls pair with nothing.
    """
    counts = df.where(~_any_null([F.col(c) for c in [*block, value]]) & (F.col(value) - F.col(value) < 1)).groupBy(*block, value).agg(F.count("*").alias("n"))
    counts = staged(counts.withColumn("unit", F.floor(value)), "counts")
    same = counts.select(*block, F.expr("n * (n - 1) div 2").alias("pairs"))
    l, r = counts.alias("l"), counts.withColumn("unit", F.explode(F.array("unit", F.col("unit") - 1))).alias("r")
    on = F.col("l.unit") == F.col("r.unit")
    for c in block:
        on = on & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    near = (F.col(f"l.{value}") < F.col(f"r.{value}")) & (F.abs(F.col(f"l.{value}") - F.col(f"r.{value}")) < 1)
    met = l.join(r, on & near).select(*[F.col(f"l.{c}") for c in block], (F.col("l.n") * F.col("r.n")).alias("pairs"))
    return same.union(met).groupBy(*block).agg(F.sum("pairs").alias("pairs")).where("pairs > 0")


def _any_null(columns: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c.isNull()
    return out


def unstaged(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Rows of a block among which heads are found at once, at first and at most.
FIRST_ROWS, MOST_ROWS = 64, 2048


def _heads(keys: int):
    """Of a block's first rows, numbered from 1, those that no head before is compatible with."""

    def run(key: tuple, rows: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        before: dict[int, list[int]] = {}
        for a, b in zip(edges["a"], edges["b"], strict=True):
            before.setdefault(b, []).append(a)
        heads: set[int] = set()
        for n in sorted(rows["nth"]):
            if heads.isdisjoint(before.get(n, ())):
                heads.add(n)
        return pd.DataFrame([(*key, n) for n in sorted(heads)], columns=[*rows.columns[:keys], "nth"])

    return run


def greedy_clusters(df: DataFrame, row_id: str, block: Sequence[str], order: Sequence[str], compatible: Callable[[str, str], Column], most: int = MOST_ROWS) -> DataFrame:
    """(row_id, cluster): in the order, a row joins the first cluster of its block whose first row it is
    compatible with, else it opens one.  cluster is the first row's id; compatible is a condition on the aliases "h" and "r".

    The predicate need not be transitive, so components would merge too much.  In rounds: of each block's first undecided rows, at most
    `most`, all pairs are compared by an equi-join, and only compatible ones reach the block's task, which tells which of these rows are heads.  The heads
    then take all undecided rows that are compatible with them, by another equi-join.  First a block's first row alone is a head, so that a
    block of one large cluster is settled by a comparison a row; the number grows where most rows are heads.  So a block of 10,000
    clusters takes nine rounds.  Blocks whose key is null in a column are none: their rows are clusters of their own.
    """
    rest = staged(df.where(~_any_null([F.col(c) for c in block])), "undecided")
    alone = df.where(_any_null([F.col(c) for c in block])).select(row_id, F.col(row_id).alias("cluster"))
    out, size = None, 1
    kinds = dict(rest.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in block), "nth int"])
    same_block = lambda a, b: [F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in block]
    while not rest.isEmpty():
        first = top_per(rest, block, [F.col(c) for c in [*order, row_id]], size)
        first = staged(first, "first-rows")
        heads = first
        if size > 1:
            earlier = F.coalesce(compatible("h", "r"), F.lit(False)) & (F.col("h.nth") < F.col("r.nth"))
            edges = first.alias("h").join(first.alias("r"), [*same_block("h", "r"), earlier]).select(*[F.col(f"h.{c}").alias(c) for c in block], F.col("h.nth").alias("a"), F.col("r.nth").alias("b"))
            told = first.select(*block, "nth").groupBy(*block).cogroup(edges.groupBy(*block)).applyInPandas(_heads(len(block)), schema)
            heads = staged(first.join(told, [*block, "nth"], "left_semi"), "heads")
        met = rest.alias("r").join(heads.alias("h"), same_block("h", "r"))
        same = F.coalesce(compatible("h", "r"), F.lit(False)) | (F.col(f"h.{row_id}") == F.col(f"r.{row_id}"))
        taken = staged(met.where(same).groupBy(F.col(f"r.{row_id}").alias(row_id)).agg(F.min_by(f"h.{row_id}", "h.nth").alias("cluster")), "taken")
        out = taken if out is None else out.union(taken)
        if size < most:
            # More rows at once only where most of those at hand were heads, so that few compatible pairs are met.
            n = first.count()
            size = min(most, FIRST_ROWS if size == 1 else 4 * size) if size == 1 or 2 * heads.count() > n else size
        before, rest = rest, staged(rest.join(taken.select(row_id), row_id, "left_anti"), "undecided")
        unstaged(before)
    return alone if out is None else out.union(alone)


def survivors(df: DataFrame, cluster: str, order: Sequence[Column], unions: Sequence[str] = (), counts: Sequence[str] = (), any_of: Sequence[str] = ()) -> DataFrame:
    """One row per cluster: the first by the order, with arrays united, counts added, flags or-ed.

    All are aggregates with map-side combine.
    """
    special = {*unions, *counts, *any_of, cluster}
    rest = [c for c in df.columns if c not in special]
    own = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("own")
    aggs = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(u)))).alias(u) for u in unions]
    aggs += [F.sum(c).alias(c) for c in counts] + [F.bool_or(c).alias(c) for c in any_of]
    return df.groupBy(cluster).agg(own, *aggs).select(cluster, "own.*", *unions, *counts, *any_of)


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """edges (a, b) -> (node, component): the least node that is reachable; least labels spread until none changes."""
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = staged(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component")).withColumnRenamed("a", "node"), "labels")
    for _ in range(rounds):
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("heard"))
        # The label's own label is taken as well, so that long chains shorten by half.
        own = labels.withColumnRenamed("node", "l_node").withColumnRenamed("component", "l_component")
        new = labels.join(heard, labels.node == heard.a).select("node", F.least("component", "heard").alias("component"), F.col("component").alias("was"))
        new = new.join(own, new.component == own.l_node, "left").select("node", F.least("component", F.coalesce("l_component", "component")).alias("component"), "was")
        new = staged(new, "labels")
        labels = new.select("node", "component")
        if new.where("component <> was").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def first_wins_any_key(df: DataFrame, row_id: str, keys: Sequence[str]) -> DataFrame:
    """Rows that a sequential pass keeps: a row falls if an earlier kept row has one of its keys (each
    key with its own name space); ids give the order.

    In rounds: undecided rows that are the least of all their keys are kept, then undecided rows that
    have a key of a kept one fall, until none is left.  A hot key is an aggregate with map-side combine,
    no one's group; dropDuplicates by one key after another gives other results.
    """
    tagged = [F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}="), F.col(k).cast("string"))) for k in keys]
    now = staged(df.select(row_id, F.explode(F.array_compact(F.array(*tagged))).alias("key")), "undecided")
    lost = None
    while not now.isEmpty():
        heads = now.groupBy("key").agg(F.min(row_id).alias("head"))
        led = heads.groupBy(F.col("head").alias(row_id)).agg(F.count("*").alias("led"))
        own = now.distinct().groupBy(row_id).agg(F.count("*").alias("n"))
        kept = staged(own.join(led, row_id).where("n = led").select(row_id), "kept")
        taken = staged(now.join(kept, row_id, "left_semi").select("key").distinct(), "taken")
        fallen = staged(now.join(kept, row_id, "left_anti").join(taken, "key", "left_semi").select(row_id).distinct(), "fallen")
        lost = fallen if lost is None else lost.union(fallen)
        now = staged(now.join(kept, row_id, "left_anti").join(fallen, row_id, "left_anti"), "undecided")
    return df if lost is None else df.join(lost, row_id, "left_anti")


def until_stable(df: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int = 20) -> DataFrame:
    """The step again and again until the number of rows stays; each round is staged."""
    now, n = df, df.count()
    for _ in range(rounds):
        now = staged(step(now), "stable")
        if (m := now.count()) == n:
            return now
        n = m
    raise RuntimeError(f"row count did not settle in {rounds} rounds")
