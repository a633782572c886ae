"""Quality of sources over their runs, guards against sudden losses, pulses of a market."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions.values import epoch_ms, half_up

RUNS_KEPT = 24


def rate(part: Column, whole: Column) -> Column:
    """A share with three places, 0 where the whole is 0."""
    return F.when(whole > 0, half_up(part.cast("double") / whole.cast("double"), 3)).otherwise(0.0)


def attributed(df: DataFrame, source: str, sources: str | None = None) -> DataFrame:
    """A row for each source that a row names, its own and those merged into it."""
    own = F.array(F.col(source))
    every = F.array_distinct(F.concat(own, F.coalesce(F.col(sources), F.array().cast("array<string>")))) if sources else own
    return df.withColumn("attributed", F.explode(every))


def last_runs(runs: DataFrame, source: str, order: Sequence[Column], n: int = RUNS_KEPT) -> DataFrame:
    """The last n runs of each source with back = 1 for the newest.

    The order is given newest first; a source's runs are cut per partition before the shuffle.
    """
    nth = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    return runs.withColumn("back", nth).where(F.col("back") <= n)


def reliability(runs: DataFrame, source: str, ok: str, noise: str | None = None, least_runs: int = 4, success: float = 0.75, noisy: float = 0.8, noisy_runs: int = 3) -> DataFrame:
    """From last_runs: per source runs, successes, success_rate, streak (failed runs at the end), tier.

    degraded: two failures at the end; weak: success under the threshold over enough runs, or enough
    noisy runs among the last four successful ones; strong otherwise, mixed with fewer than enough runs.
    """
    good = F.col(ok)
    newest = F.slice(F.array_sort(F.collect_list(F.when(good, F.struct("back", noise)))), 1, 4) if noise else None
    stats = runs.groupBy(source).agg(
        F.count("*").alias("runs"),
        F.count_if(good).alias("successes"),
        F.coalesce(F.min(F.when(good, F.col("back"))) - 1, F.count("*")).cast("long").alias("streak"),
        (F.size(F.filter(newest, lambda r: r[noise] >= noisy)) if noise else F.lit(0)).alias("noisy"),
    )
    s = rate(F.col("successes"), F.col("runs"))
    tier = (
        F.when(F.col("streak") >= 2, "degraded")
        .when(((F.col("runs") >= least_runs) & (s < success)) | (F.col("noisy") >= noisy_runs), "weak")
        .when(F.col("runs") < least_runs, "mixed")
        .otherwise("strong")
    )
    return stats.withColumn("success_rate", s).withColumn("tier", tier)


def collapse_guard(baseline: DataFrame, current: DataFrame, key: str, source: str, floor: int = 3, per_source: int = 2, least: int = 5, share: float = 0.5) -> DataFrame:
    """(scope, baseline, current, lost, blocked): overall as scope "*" and for each source.

    Blocked: enough rows before, now fewer than max(floor, half of them), and some row lost that
    nothing explains.  baseline (key, source, explained boolean); current (key).
    """
    both = baseline.join(current.select(key).distinct().withColumn("here", F.lit(True)), key, "left")
    here = F.coalesce(F.col("here"), F.lit(False))
    counts = [F.count("*").alias("baseline"), F.count_if(here).alias("current")]
    whole = both.agg(*counts, F.count_if(~here & ~F.col("explained")).alias("lost")).select(F.lit("*").alias("scope"), "*", F.lit(floor).alias("floor"))
    each = both.groupBy(F.col(source).alias("scope")).agg(*counts, F.count_if(~here).alias("lost")).withColumn("floor", F.lit(per_source))
    need = F.greatest(F.col("floor"), F.ceil(F.col("baseline") * share))
    blocked = (F.col("baseline") >= least) & (F.col("current") < need) & (F.col("lost") >= 1)
    return whole.unionByName(each).withColumn("blocked", blocked).drop("floor")


def require_unblocked(guard: DataFrame) -> None:
    """Raises on the driver, before anything is committed."""
    bad = [r.scope for r in guard.where("blocked").select("scope").limit(20).collect()]
    if bad:
        raise RuntimeError(f"the new feed lost too much: {', '.join(map(str, bad))}")


def two_windows(at: Column, now: Column, days: int = 7) -> tuple[Column, Column]:
    """Conditions: within the last days before now; within as many days before those."""
    age = epoch_ms(now) - epoch_ms(at)
    span = days * 86_400_000
    return (age >= 0) & (age < span), (age >= span) & (age < 2 * span)


def most_frequent(df: DataFrame, column: str, not_in: Sequence[str] = ()) -> DataFrame:
    """The mode and its count; of equal counts the least value."""
    t = df.where(F.col(column).isNotNull() & ~F.col(column).isin(*not_in)) if not_in else df.where(F.col(column).isNotNull())
    return t.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(1)


def concentration(df: DataFrame, source: str, least: int = 10, share: float = 0.4) -> DataFrame:
    """Sources with their share of all rows, and whether it is too large of a large enough total."""
    counts = df.groupBy(source).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(source, "n", rate(F.col("n"), total).alias("share"), ((total >= least) & (F.col("n") >= total * share)).alias("concentrated"))
