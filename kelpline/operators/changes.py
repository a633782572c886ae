"""What time and later knowledge do to rows that are kept: aging evidence, rebased histories, reviews, caches, user state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions.values import freshness
from kelpline.operators.lifecycle import DAY, days_between
from kelpline.operators.metrics import last_runs, rate
from kelpline.operators.rules import first_match


def refresh_evidence(df: DataFrame, now: Column, limit: int = 24) -> DataFrame:
    """df (checked_at, max_age, freshness, history array of (at, event, from_status, to_status)): freshness as of now, and an
    event where it has changed since; the history keeps its last `limit`."""
    fresh = freshness(days_between(now, F.col("checked_at")), F.col("max_age"))
    t = df.withColumn("was", F.col("freshness")).withColumn("freshness", fresh)
    event = F.struct(now.cast("timestamp").alias("at"), F.lit("evidence_freshness_changed").alias("event"), F.col("was").alias("from_status"), F.col("freshness").alias("to_status"))
    grown = F.when(F.col("was").eqNullSafe(F.col("freshness")), F.col("history")).otherwise(F.array_append("history", event))
    return t.withColumn("history", F.slice(grown, F.greatest(F.size(grown) - limit + 1, F.lit(1)), F.lit(limit))).drop("was")


def rebase_history(history: Column, source: Column, version: Column, current: int, weak: Sequence[str], volatile: Mapping[str, Sequence[str]], limit: int = 24) -> Column:
    """history array of (event, fields array): for rows whose prints are of an older version, content changes of weak fields
    alone become unverified ones, and an event says that the prints were made anew.  volatile: fields that are weak for a source too."""

    def one(e: Column) -> Column:
        allowed = first_match([(source == name, F.array(*[F.lit(x) for x in (*weak, *fields)])) for name, fields in volatile.items()], F.array(*[F.lit(x) for x in weak]))
        only = (F.size(e["fields"]) > 0) & F.forall(e["fields"], lambda f: F.array_contains(allowed, f))
        return F.when((e["event"] == "content_changed") & only, F.struct(F.lit("legacy_content_change_unverified").alias("event"), e["fields"].alias("fields"))).otherwise(e)

    note = F.struct(F.lit("source_fingerprint_rebased").alias("event"), F.array().cast("array<string>").alias("fields"))
    grown = F.array_append(F.transform(history, one), note)
    grown = F.slice(grown, F.greatest(F.size(grown) - limit + 1, F.lit(1)), F.lit(limit))
    return F.when(F.coalesce(version, F.lit(0)) >= current, history).otherwise(grown)


def review_states(jobs: DataFrame, reviewed: DataFrame, key: str = "id") -> DataFrame:
    """(key, state, print): a reviewed row whose content is another now is invalidated and counts as new; one without a
    stored print takes the present one; one that the feed lacks keeps what is stored.  jobs and reviewed (key, print)."""
    r = reviewed.select(key, F.col("print").alias("stored"), F.lit(True).alias("had"))
    t = r.join(jobs.select(key, F.col("print").alias("now")), key, "left")
    changed = F.col("now").isNotNull() & F.col("stored").isNotNull() & (F.col("now") != F.col("stored"))
    return t.select(key, F.when(changed, "invalidated").when(F.col("now").isNull(), "absent").otherwise("kept").alias("state"), F.when(~changed, F.coalesce("now", "stored")).alias("print"))


def geocode_work(addresses: DataFrame, cache: DataFrame, now: Column, retry_days: int = 30) -> DataFrame:
    """Distinct addresses (address, wanted) that the cache (address, lat, lon, failed, checked_at) lacks: never looked up,
    without coordinates, or failed so long ago that another try is due."""
    t = addresses.where(F.col("wanted") & (F.coalesce("address", F.lit("")) != "")).select("address").distinct()
    t = t.join(cache.withColumn("cached", F.lit(True)), "address", "left")
    old = F.coalesce(F.unix_millis(now.cast("timestamp")) - F.unix_millis(F.col("checked_at").cast("timestamp")) > retry_days * DAY, F.lit(True))
    open_ = F.when(F.col("cached").isNull(), True).when(F.coalesce("failed", F.lit(False)), old).otherwise(F.col("lat").isNull() | F.col("lon").isNull())
    return t.where(open_).select("address")


def with_coordinates(df: DataFrame, cache: DataFrame, address: str = "address") -> DataFrame:
    """df with the cache's coordinates where its address has any; they beat coordinates of a coarser precision."""
    c = cache.where(~F.coalesce("failed", F.lit(False)) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    c = c.select(F.col("address").alias("_address"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    t = df.join(c, F.col(address) == F.col("_address"), "left")
    hit = F.col("_lat").isNotNull()
    return t.withColumns({
        "lat": F.coalesce("_lat", "lat"), "lon": F.coalesce("_lon", "lon"), "precision": F.when(hit, "address").otherwise(F.col("precision")),
    }).drop("_address", "_lat", "_lon")


def batch_update(states: DataFrame, ids: DataFrame, value: str, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """states (key, value) with the value set for all ids, and what undoes it: (key, value) as they were, null for absent ones."""
    ids = ids.select(key).distinct()
    changed = ids.withColumn("value", F.lit(value))
    return states.join(ids, key, "left_anti").unionByName(changed), ids.join(states, key, "left").select(key, "value")


def undo(states: DataFrame, before: DataFrame, key: str = "id") -> DataFrame:
    """states as they were before the batch; rows that it made go."""
    return states.join(before.select(key), key, "left_anti").unionByName(before.where("value is not null"))


def convert_state(rows: DataFrame, known: DataFrame, allowed: Mapping[str, str], key: str = "id") -> DataFrame:
    """rows (key, value) of another program's state: known keys whose value the table of allowed ones translates."""
    names = F.create_map(*[F.lit(x) for kv in allowed.items() for x in kv])
    t = rows.join(known.select(key).distinct(), key, "left_semi")
    return t.withColumn("value", names[F.col("value")]).where("value is not null")


def historical_feed(current: DataFrame, previous: DataFrame, tombstones: DataFrame, now: Column, key: str = "id", days: int = 60, most: int = 2000) -> DataFrame:
    """current, and of previous (key, last_seen, deadline, ...) the rows that it lacks: seen within the days (1 to 365), not
    withdrawn by a tombstone, with no deadline that has passed, the newest `most` of them.  The cap is the feature: a feed's length."""
    span = min(365, max(1, days)) * DAY
    kept = previous.join(current.select(key), key, "left_anti").join(tombstones.select(key).distinct(), key, "left_anti")
    age = F.unix_millis(now.cast("timestamp")) - F.unix_millis(F.col("last_seen").cast("timestamp"))
    kept = kept.where((age <= span) & ~F.coalesce(F.col("deadline") < now.cast("date"), F.lit(False)))
    kept = kept.orderBy(F.desc("last_seen"), key).limit(most)
    return current.withColumn("seen", F.lit(True)).unionByName(kept.withColumn("seen", F.lit(False)), allowMissingColumns=True)


def rotating_window(df: DataFrame, by: str, order: Sequence[Column], size: int, run: int) -> DataFrame:
    """Of each group the `size` rows that this run's turn brings: the window moves on by its size each run and wraps around."""
    w = Window.partitionBy(by)
    t = df.withColumn("_nth", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    start = (F.lit(run) * size) % F.col("_n")
    return t.where((F.col("_nth") - start + F.col("_n")) % F.col("_n") < size).drop("_nth", "_n")


def source_tiers(runs: DataFrame, source: str, official: str, order: Sequence[Column]) -> DataFrame:
    """runs (source, official, ok, matched, noise) -> per source over its last runs: runs, success_rate, streak, tier, state.

    tier: an official source is strong, or degraded after two failures at the end; others are weak with success under
    0.75 over four runs or more, or if three of the last four good runs of three matches or more were noisy (0.8), else mixed.
    state: degraded after two failures at the end, unstable with success under 0.75 over four runs or more, else reliable
    for an official source and observed for others.
    """
    t = last_runs(runs, source, order)
    good = F.col("ok")
    rated = F.when(good & (F.coalesce("matched", F.lit(0)) >= 3), F.struct("back", (F.col("noise") / F.col("matched")).alias("share")))
    newest = F.slice(F.array_sort(F.collect_list(rated)), 1, 4)
    stats = t.groupBy(source).agg(
        F.bool_or(official).alias("official"), F.count("*").alias("runs"), F.count_if(good).alias("good"),
        F.coalesce(F.min(F.when(good, F.col("back"))) - 1, F.count("*")).cast("long").alias("streak"), F.size(F.filter(newest, lambda r: r["share"] >= 0.8)).alias("noisy"),
    )
    poor = (F.col("runs") >= 4) & (F.col("good") < F.col("runs") * 0.75)
    tier = F.when(F.col("official"), F.when(F.col("streak") >= 2, "degraded").otherwise("strong")).when(poor | (F.col("noisy") >= 3), "weak").otherwise("mixed")
    state = F.when(F.col("streak") >= 2, "degraded").when(poor, "unstable").when(F.col("official"), "reliable").otherwise("observed")
    return stats.select(source, "runs", rate(F.col("good"), F.col("runs")).alias("success_rate"), "streak", tier.alias("tier"), state.alias("state"))


def recommendation_guard(baseline: DataFrame, current: DataFrame, key: str = "id", source: str = "source", floor: int = 3, per_source: int = 2, least: int = 5, share: float = 0.5) -> DataFrame:
    """(scope, baseline, current, lost, blocked) overall ("*") and per source.

    baseline (key, source): rows recommended before.  current (key, recommended, explained): a row that is gone, or is here
    but no longer recommended, is lost.  An explanation excuses it overall, but not for its source.
    """
    c = current.groupBy(key).agg(F.bool_or("recommended").alias("here"), F.bool_or("explained").alias("explained"))
    t = baseline.join(c, key, "left").select(source, F.coalesce("here", F.lit(False)).alias("here"), F.coalesce("explained", F.lit(False)).alias("explained"))
    counts = [F.count("*").alias("baseline"), F.count_if("here").alias("current")]
    whole = t.agg(*counts, F.count_if(~F.col("here") & ~F.col("explained")).alias("lost")).select(F.lit("*").alias("scope"), "*", F.lit(floor).alias("floor"))
    each = t.groupBy(F.col(source).alias("scope")).agg(*counts, F.count_if(~F.col("here")).alias("lost")).withColumn("floor", F.lit(per_source))
    need = F.greatest(F.col("floor"), F.ceil(F.col("baseline") * share))
    return whole.unionByName(each).withColumn("blocked", (F.col("baseline") >= least) & (F.col("current") < need) & (F.col("lost") >= 1)).drop("floor")


def apply_feed(feed: DataFrame, manual: DataFrame, states: DataFrame, aliases: DataFrame, reviewed: DataFrame, known: DataFrame, ranks: Mapping[str, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A new feed meets the user's state: (rows, states, ids that are new).

    rows: feed (id, print), manual ones in their place; states (id, value) under their new ids, the highest rank of each; new: neither
    known nor reviewed, or reviewed with other content.
    """
    from kelpline.operators.joins import upsert
    from kelpline.operators.state import rank_merge, rename_keys

    rows = upsert(feed, manual, "id")
    moved = rank_merge(rename_keys(states, "id", aliases), ["id"], "value", ranks)
    checked = review_states(rows, reviewed)
    fresh = rows.select("id").join(known.select("id"), "id", "left_anti").join(reviewed.select("id"), "id", "left_anti")
    return rows, moved, fresh.union(checked.where("state = 'invalidated'").select("id")).distinct()
