"""Snapshots against the ones before: events, bounded histories, missing rows for a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.functions.values import epoch_ms

DAY = 86_400_000
EVENT = "struct<at:timestamp,event:string,from_status:string,to_status:string>"


def append_limited(history: Column, event: Column, limit: int = 24) -> Column:
    """The history with the event, unless it is null or equals the last one, cut to the last `limit`."""
    past = F.coalesce(history, F.array().cast(f"array<{EVENT}>"))
    same = (F.size(past) > 0) & F.element_at(past, -1).eqNullSafe(event)
    grown = F.when(event.isNull() | F.coalesce(same, F.lit(False)), past).otherwise(F.concat(past, F.array(event)))
    return F.slice(grown, F.greatest(F.size(grown) - limit + 1, F.lit(1)), F.lit(limit))


def field_prints(columns: Sequence[str]) -> Column:
    """field -> head of a digest of its value; a null differs from the empty text."""
    entries = [x for c in columns for x in (F.lit(c), F.substring(F.sha2(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")), 256), 1, 16))]
    return F.create_map(*entries)


def content_print(columns: Sequence[str]) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in columns]), 256)


def changed_fields(now: Column, before: Column, columns: Sequence[str]) -> Column:
    """Names of the fields whose prints differ, in the order given."""
    return F.filter(F.array(*[F.lit(c) for c in columns]), lambda c: ~now[c].eqNullSafe(before[c]))


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days of 24 hours."""
    return F.floor((epoch_ms(later) - epoch_ms(earlier)) / DAY)


def event_of(now: Column, checkpoint_days: int = 7) -> Column:
    """One event for a row from the columns prev_status, status, prev_print, print and last_event_at.

    first_seen; of reappeared, source_recovered and source_failed at most one, which keeps a mere
    status change out; content_changed; status_changed; verified_unchanged after a week of silence.
    """
    was, is_ = F.col("prev_status"), F.col("status")
    return (
        F.when(was.isNull(), "first_seen")
        .when((was == "archived_missing") & (is_ != "archived_missing"), "reappeared")
        .when((was == "source_error") & (is_ != "source_error"), "source_recovered")
        .when((was != "source_error") & (is_ == "source_error"), "source_failed")
        .when(F.col("prev_print") != F.col("print"), "content_changed")
        .when(was != is_, "status_changed")
        .when(F.col("last_event_at").isNull() | (days_between(now, F.col("last_event_at")) >= checkpoint_days), "verified_unchanged")
    )


def reconcile(current: DataFrame, previous: DataFrame, key: str, now: Column, limit: int = 24) -> DataFrame:
    """current (key, status, print, ...) with previous (key, status, print, first_seen_at, history) ->
    current with event, first_seen_at, last_seen_at and the grown history."""
    p = previous.select(
        F.col(key).alias("p_key"), F.col("status").alias("prev_status"), F.col("print").alias("prev_print"), F.col("first_seen_at").alias("p_first"), F.col("history").alias("p_history")
    )
    t = current.join(p, F.col(key) == F.col("p_key"), "left").withColumn("last_event_at", F.try_element_at("p_history", F.lit(-1))["at"])
    t = t.withColumn("event", event_of(now))
    entry = F.when(
        F.col("event").isNotNull(),
        F.struct(now.cast("timestamp").alias("at"), F.col("event").alias("event"), F.col("prev_status").alias("from_status"), F.col("status").alias("to_status")).cast(EVENT),
    )
    return (
        t.withColumn("first_seen_at", F.coalesce("p_first", now.cast("timestamp")))
        .withColumn("last_seen_at", now.cast("timestamp"))
        .withColumn("history", append_limited(F.col("p_history"), entry, limit))
        .drop("p_key", "p_first", "p_history", "prev_status", "prev_print", "last_event_at")
    )


def carry_missing(current: DataFrame, previous: DataFrame, key: str, now: Column, days: int = 14, closed: Sequence[str] = ("expired",)) -> DataFrame:
    """Rows of previous that current lacks: archived_missing, with a score of 0, for `days` days since they went missing, then
    gone; closed ones are never carried.  previous (key, status, missing_since)."""
    gone = previous.join(current.select(key).distinct(), key, "left_anti").where(~F.col("status").isin(*closed))
    since = F.coalesce(F.col("missing_since").cast("timestamp"), now.cast("timestamp"))
    event = F.when(F.col("missing_since").isNull(), "disappeared")
    gone = gone.withColumn("event", event).withColumn("missing_since", since).withColumn("status", F.lit("archived_missing"))
    if "score" in gone.columns:
        gone = gone.withColumn("score", F.lit(0).cast(gone.schema["score"].dataType))
    return gone.where(epoch_ms(now) - epoch_ms(F.col("missing_since")) <= days * DAY)


def three_states(previous: DataFrame, current: DataFrame, key: str, source: str, healthy: DataFrame) -> DataFrame:
    """Every key with its state: seen now, not_seen by a source that worked, unverified if the source failed.

    A row that was not_seen stays so while its source fails.  healthy (source, ok); previous (key, source, state).
    """
    p = previous.select(key, F.col(source).alias("p_source"), F.col("state").alias("was"))
    c = current.select(key, F.col(source).alias("c_source"))
    t = c.join(p, key, "full").withColumn(source, F.coalesce("c_source", "p_source"))
    t = t.join(healthy.select(source, "ok"), source, "left")
    state = F.when(F.col("c_source").isNotNull(), "seen").when(F.coalesce("ok", F.lit(False)) | (F.col("was") == "not_seen"), "not_seen").otherwise("unverified")
    return t.select(key, source, state.alias("state"))


def carry_aliases(current: DataFrame, previous: DataFrame, key: str, aliases: str) -> DataFrame:
    """current with the aliases of those previous rows that share its key or an alias, sorted, without its key."""
    none = F.array().cast("array<string>")
    ids = lambda d: d.select(F.col(key).alias("row"), F.explode(F.array_distinct(F.concat(F.array(F.col(key)), F.coalesce(F.col(aliases), none)))).alias("alias"))
    mine, theirs = ids(current), ids(previous)
    pairs = mine.join(theirs.withColumnRenamed("row", "prev"), "alias").select("row", "prev").distinct()
    grown = pairs.join(theirs.withColumnRenamed("row", "prev"), "prev").select("row", "alias").union(mine).where("alias <> row")
    sets = grown.groupBy("row").agg(F.array_sort(F.collect_set("alias")).alias("grown"))
    t = current.join(sets, F.col(key) == F.col("row"), "left").withColumn(aliases, F.coalesce("grown", none))
    return t.drop("row", "grown")


def feed_health(updated: Column, now: Column, stale_hours: int = 24, future_minutes: int = 5) -> Column:
    """invalid, future, stale or fresh."""
    age = epoch_ms(now) - epoch_ms(updated)
    return F.when(age.isNull(), "invalid").when(age < -future_minutes * 60_000, "future").when(age > stale_hours * 3_600_000, "stale").otherwise("fresh")


def events_of(now: Column, checkpoint_days: int = 7) -> Column:
    """All events of a row, in order, from prev_status, status, prev_scope, scope, prev_print, print, prev_freshness, freshness,
    prev_evidence, evidence and last_event_at: what `event_of` says of status and content, and changes of scope and evidence.

    A first sighting is one event alone; verified_unchanged comes only where nothing else does.
    """
    changed = lambda a, b: F.col(a).isNotNull() & ~F.col(a).eqNullSafe(F.col(b))
    was, is_ = F.col("prev_status"), F.col("status")
    back = (was == "archived_missing") & (is_ != "archived_missing")
    healed, broke = (was == "source_error") & (is_ != "source_error"), (was != "source_error") & (is_ == "source_error")
    exclusive = F.when(back, "reappeared").when(healed, "source_recovered").when(broke, "source_failed")
    found = F.array_compact(F.array(
        F.when(changed("prev_scope", "scope"), F.lit("scope_changed")), exclusive, F.when(changed("prev_print", "print"), F.lit("content_changed")),
        F.when(changed("prev_freshness", "freshness"), F.lit("evidence_freshness_changed")), F.when(changed("prev_evidence", "evidence"), F.lit("evidence_state_changed")),
        F.when(exclusive.isNull() & (was != is_), F.lit("status_changed")),
    ))
    quiet = F.col("last_event_at").isNull() | (days_between(now, F.col("last_event_at")) >= checkpoint_days)
    none = F.array().cast("array<string>")
    return F.when(was.isNull(), F.array(F.lit("first_seen"))).when(F.size(found) > 0, found).when(quiet, F.array(F.lit("verified_unchanged"))).otherwise(none)
