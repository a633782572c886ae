"""Mixing sources to target weights by Pareto order sampling.

Sources share a budget of words by weight, none more than `most` times its size.  Within a
source a document's expected copies rise with the logarithm of its length, up to `most`.
Whole expected copies are certain; for the fraction p that is left, documents are ranked by
the random odds u/(1-u) over the inclusion odds p/(1-p) (Rosén 1997), and the head of that
order which comes nearest to the source's remaining words gets one copy more.

Only built-in functions run here.  Everything but the last cut is solved on small sums: per
source, per (source, length class), and per (source, 1/256 and 1/65536 of the order).  No
source is sorted whole, so that one with a third of all rows is no hot key.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.llm.common import WORD, packed, prepare, stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
_FINE, _COARSE = 65536, 256


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def measured(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """docs (mix_id, source, text, ...): adds mix_size (words), mix_class (bits of the size; 0 for no words),
    mix_u, uniform in (0, 1) by the id and the text, and mix_row, a hash of the whole row (of maps, which have no hash, by their JSON)."""
    prepare(docs.sparkSession)
    text = F.md5(F.coalesce(F.col("text"), F.lit("")))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("mix_id").cast("string"), F.lit("null")), text))
    row = [F.to_json(name) if re.search("map<|variant", kind) else F.col(name) for name, kind in docs.dtypes]
    return (
        docs.withColumn("mix_row", F.xxhash64(*row))
        .withColumn("mix_size", words())
        .withColumn("mix_class", F.when(F.col("mix_size") > 0, F.length(F.bin("mix_size"))).otherwise(0))
        .withColumn("mix_u", (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52))
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) -> with target: the budget by weight, capped, the excess reshared.

    This is water-filling: in the order of cap over weight, a source is capped if the level
    that the sources from it on would get reaches its cap.  The table has a row for each source.
    """
    base = 1
    for w in weights:
        base *= w
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.expr(f"cap * {base} div weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = (
        t.withColumn("budget", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(below), F.lit(0))) / F.sum("weight").over(onward))
        .withColumn("pos", F.row_number().over(order))
        .withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
    )
    level = F.min(F.when(F.col("open"), F.struct("pos", "level"))).over(whole)["level"]
    return t.select(
        "source", "source_size",
        F.when(F.col("open"), level * F.col("weight")).otherwise(F.col("cap").cast("double")).alias("target"),
    )


def class_rates(classes: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """(source, mix_class, words) and targets -> with certain copies, chance of one more, and the
    words of a source that its certain copies leave (rest)."""
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    t = classes.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    order = Window.partitionBy("source").orderBy(F.col("mix_class").desc())
    own = Window.partitionBy("source")
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rate = (F.col("target") - F.coalesce(F.sum("words").over(above), F.lit(0)) * most) / F.sum(F.col("words") * F.col("mix_class")).over(onward)
    t = t.withColumn("rate", F.when(F.col("words") > 0, rate)).withColumn("open", F.col("rate") * F.col("mix_class") < most)
    first = F.max(F.when(F.col("open"), F.struct("mix_class", "rate"))).over(own)["rate"]
    expected = F.when(F.col("words") == 0, 0.0).otherwise(F.coalesce(F.least(F.lit(float(most)), first * F.col("mix_class")), F.lit(float(most))))
    t = t.withColumn("expected", expected).withColumn("certain", F.floor("expected"))
    return t.withColumn("chance", F.col("expected") - F.col("certain")).withColumn(
        "rest", F.col("target") - F.sum(F.col("certain") * F.col("words")).over(own)
    ).drop("rate", "open", "expected", "words")


def _odds() -> Column:
    u, p = F.col("mix_u"), F.col("chance")
    return F.when((p > 0) & (F.col("mix_size") > 0), (u / (1 - u)) / (p / (1 - p)))


def _place() -> Column:
    """Where in the order a document stands, as one of _FINE slots; the order within a slot is by odds."""
    return F.floor(F.col("odds") / (F.col("odds") + 1) * _FINE).cast("long")


def _key() -> Column:
    """The order; rows that are equal in it are alike in every column."""
    return F.struct(F.col("odds"), F.col("mix_id").isNull().alias("none"), F.col("mix_id").alias("id"), F.col("mix_size").alias("size"), F.col("mix_row").alias("row"))


def _first_over(sums: DataFrame, slot: str) -> DataFrame:
    """(source, slot, words, base, rest) -> for each source the first slot that takes it over the rest, and the words before."""
    run = Window.partitionBy("source").orderBy(slot)
    t = sums.withColumn("through", F.col("base") + F.sum("words").over(run))
    return (
        t.where(F.col("through") > F.col("rest"))
        .groupBy("source")
        .agg(F.min(F.struct(F.col(slot).alias("slot"), (F.col("through") - F.col("words")).alias("base"))).alias("cut"))
        .select(F.col("source").alias("c_source"), F.col("cut.slot").alias("c_slot"), F.col("cut.base").alias("base"))
    )


def mix_plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sized (mix_id, source, mix_size, mix_class, mix_u, mix_row), staged -> a row for each (source, length class)
    with source_size, target, certain, chance and where the source's order is cut: its slot, its key, how many rows
    have that key (tied) and how many of these are taken (some)."""
    classes = stage(sized.groupBy("source", "mix_class").agg(F.sum("mix_size").alias("words")), "mix-classes")
    sizes = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = stage(source_targets(sizes, weights, share, most), "mix-targets")
    rates = stage(class_rates(classes, targets, most), "mix-rates")
    ranked = _with(sized, rates).withColumn("odds", _odds()).where("odds is not null").withColumn("place", _place())
    fine = stage(ranked.groupBy("source", "place", "rest").agg(F.sum("mix_size").alias("words")), "mix-places")
    step = F.expr(f"place div {_FINE // _COARSE}")
    coarse = fine.groupBy("source", step.alias("step"), "rest").agg(F.sum("words").alias("words")).withColumn("base", F.lit(0))
    at_step = stage(_first_over(coarse, "step"), "mix-steps")
    within = fine.withColumn("step", step).join(at_step, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("step") == F.col("c_slot")))
    at_place = stage(_first_over(within.drop("c_source", "c_slot"), "place"), "mix-cuts")
    last = ranked.join(at_place, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("place") == F.col("c_slot")))
    # Rows that are alike are one row here with their number.
    last = last.groupBy("source", "base", "rest", _key().alias("key")).agg(F.count("*").alias("tied"))
    size = F.col("key.size")
    run = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("before", F.col("base") + F.sum(size * F.col("tied")).over(run) - size * F.col("tied"))
    last = last.withColumn("some", F.least(F.col("tied"), F.floor((F.col("rest") - F.col("before")) / size + 0.5)).cast("long")).where("some > 0")
    keys = last.groupBy("source").agg(F.max(F.struct("key", "tied", "some")).alias("c"))
    cuts = at_place.join(keys, F.col("c_source").eqNullSafe(F.col("source")), "left").select("c_source", "c_slot", F.col("c.key").alias("cut_key"), "c.tied", "c.some")
    return stage(rates.join(cuts, F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source"), "mix-plan")


def _with(sized: DataFrame, plan: DataFrame) -> DataFrame:
    p = plan.withColumnRenamed("source", "p_source").withColumnRenamed("mix_class", "p_class")
    return sized.join(p, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("mix_class") == F.col("p_class"))).drop("p_source", "p_class")


def with_copies(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds copies (int) and the plan's source_size and target to rows that `measured` made.

    Of rows that are alike at the cut some may be taken and some not: such a group becomes one row, which is
    repeated, so that no group is ranked.
    """
    t = _with(sized, plan).withColumn("odds", _odds()).withColumn("place", _place())
    at_cut = F.col("place") == F.col("c_slot")
    more = F.col("odds").isNotNull() & (F.col("c_slot").isNull() | (F.col("place") < F.col("c_slot")) | (at_cut & (_key() <= F.col("cut_key"))))
    copies = lambda more: (F.col("certain") + F.coalesce(more, F.lit(False)).cast("int")).cast("int")
    if plan.where("some < tied").isEmpty():
        return t.withColumn("copies", copies(more))
    parted = F.coalesce(at_cut & (_key() == F.col("cut_key")) & (F.col("some") < F.col("tied")), F.lit(False))
    kept = [c for c in t.columns if c not in ("source", "mix_row")]
    alike = t.where(parted).groupBy("source", "mix_row").agg(*[F.first(c).alias(c) for c in kept])
    alike = alike.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("tied").cast("int")))).withColumn("copies", copies(F.col("nth") <= F.col("some")))
    return t.where(~parted).withColumn("copies", copies(more)).unionByName(alike.drop("nth"))


def mix_report(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """docs (id_col, source, text) -> doc_id, size, source_size, target, taken, copies.

    Null and empty texts have size 0 and take nothing; a null source is a source, the last one.  Ids may be
    null or repeat: rows are ranked by id and text, and of rows that are alike in both as many are taken as
    the target leaves room for.  Equal odds are ordered by id, null last, and size.  Texts are read whole, however
    long.  An empty table gives an empty result; other columns are not read and may have any name.
    """
    sized = measured(docs.select(F.col(id_col).alias("mix_id"), "source", "text")).drop("text")
    sized = stage(sized, "mix-sizes")
    out = with_copies(sized, mix_plan(sized, **how))
    return out.select(
        F.col("mix_id").alias("doc_id"), F.col("mix_size").alias("size"), "source_size", "target",
        (F.col("mix_size") * F.col("copies")).alias("taken"), "copies",
    )


def mix(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """docs -> the mix: each row as many times as its copies, with the same columns, whatever their names.

    The texts are scanned twice and not shuffled: the plan is small and says for each row how
    many copies it gets.  Odd rows are as in `mix_report`.
    """
    sized = measured(packed(docs, mix_id=F.col(id_col), source=F.col("source"), text=F.col("text"))).drop("text")
    plan = mix_plan(stage(sized.drop("own"), "mix-sizes"), **how)
    out = with_copies(sized, plan).where("copies > 0")
    return out.select("own", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("own.*")
