"""Queries that run as streams over all that is there, against the same result in batch SQL.

In append mode a window comes out when the watermark has passed its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.operators.resolve import staged
from kelpline.sources import sinks
from kelpline.sources.tables import table
from kelpline.streaming import history as hi
from kelpline.streaming import lifecycle as lc


def _rows(spark: SparkSession, sf: str, batches: int = 1) -> DataFrame:
    table(spark, sf, "events")
    e = lc.event_stream(spark, sf, batches)
    status = F.when(F.col("event_type") == "error", "source_error").when(F.col("event_type") == "purchase", "sold").otherwise("open")
    return e.select(
        F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("kind"), F.floor("value").alias("value"), F.col("user_id").alias("key"), status.alias("status")
    )


def events_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    out = lc.drained(lc.windowed(_rows(spark, sf), "1 day"), "tumbling")
    return out.select(F.unix_seconds("start").alias("start"), "kind", "n", "total")


def events_sliding(spark: SparkSession, sf: str) -> DataFrame:
    out = lc.drained(lc.windowed(_rows(spark, sf), "2 days", "1 day"), "sliding")
    return out.select(F.unix_seconds("start").alias("start"), "kind", "n", "total")


def events_sessions(spark: SparkSession, sf: str) -> DataFrame:
    out = lc.drained(lc.sessions(_rows(spark, sf), "12 hours"), "sessions")
    return out.select("key", F.unix_micros("start").alias("start"), "n")


def lifecycle_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Lifecycle events of users over three micro-batches in the order of time; a silence of two days counts."""
    rows = _rows(spark, sf, 3).withWatermark("at", "30 days")
    out = lc.drained(lc.transitions(rows.select("key", "at", "status"), 2, lc.groups_for(table(spark, sf, "events"), "user_id")), "lifecycle")
    return out.select("key", F.unix_micros("at").alias("at"), "event", "from_status", "to_status")


def history_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Users' last ten events: a batch snapshot of the first half of the time seeds the state, the rest comes in three micro-batches,
    and the histories are read back from the state."""
    at, status = F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") == "error", "source_error").when(F.col("event_type") == "purchase", "sold").otherwise("open")
    events = table(spark, sf, "events").select(F.col("user_id").alias("key"), at, status.alias("status"))
    ends = events.agg(F.min(F.unix_micros("at")).alias("a"), F.max(F.unix_micros("at")).alias("b")).first()
    late = F.unix_micros("at") > (ends.a + ends.b) // 2
    before = staged(hi.snapshot_of(events.where(~late), 2, 10), "history-snapshot")
    stream = _rows(spark, sf, 3).select("key", "at", "status").where(late)
    kept = hi.histories_in(spark, hi.run_to_state(hi.histories(stream, before, 2, 10, ttl_days=365, groups=lc.groups_for(events, "key")), "history"))
    each = kept.select("key", F.posexplode("history").alias("pos", "e"))
    return each.select("key", "pos", F.unix_micros("e.at").alias("at"), "e.event", "e.from_status", "e.to_status")


def stream_upserts(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's last event, kept by a versioned sink over three micro-batches that are all delivered twice."""
    rows = _rows(spark, sf, 3).select("key", "at", "kind", "value")
    root = staged(spark.createDataFrame([("upserts",)], "name string"), "stream-upserts").inputFiles()[0].rsplit("/", 1)[0]
    for attempt in range(2):  # a checkpoint that is lost delivers all batches again
        sinks.upsert_stream(rows, f"{root}-out", "key", ["at", "kind"], f"{root}-checkpoint-{attempt}").awaitTermination()
    out = sinks.read_current(spark, f"{root}-out")
    return out.select("key", F.unix_micros("at").alias("at"), "kind", "value")


QUERIES = {f.__name__: f for f in (stream_upserts, events_tumbling, events_sliding, events_sessions, lifecycle_stream, history_stream)}

_LAST = "(SELECT max(ts) - INTERVAL 1 DAY FROM events)"
SQL = {
    "events_tumbling": f"""
        SELECT epoch_ms(date_trunc('day', ts)) // 1000 AS start, event_type AS kind, count(*) AS n, sum(floor(value)::BIGINT)::BIGINT AS total
        FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {_LAST} GROUP BY 1, 2""",
    "events_sliding": f"""
        WITH w AS (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s, * FROM events)
        SELECT epoch_ms(s) // 1000 AS start, event_type AS kind, count(*) AS n, sum(floor(value)::BIGINT)::BIGINT AS total
        FROM w WHERE s + INTERVAL 2 DAY <= {_LAST} GROUP BY 1, 2""",
    "events_sessions": f"""
        WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id AS key, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 12 HOUR <= {_LAST}""",
    "lifecycle_stream": """
        WITH e AS (SELECT user_id AS key, ts, CASE event_type WHEN 'error' THEN 'source_error' WHEN 'purchase' THEN 'sold' ELSE 'open' END AS status FROM events),
        l AS (SELECT *, lag(status) OVER w AS was, lag(ts) OVER w AS seen FROM e WINDOW w AS (PARTITION BY key ORDER BY ts, status))
        SELECT key, epoch_us(ts) AS at, CASE WHEN was IS NULL THEN 'first_seen' WHEN ts - seen > INTERVAL 2 DAY THEN 'reappeared' WHEN status = 'source_error' THEN 'source_failed'
               WHEN was = 'source_error' THEN 'source_recovered' ELSE 'status_changed' END AS event, was AS from_status, status AS to_status
        FROM l WHERE was IS NULL OR ts - seen > INTERVAL 2 DAY OR was <> status""",
    "history_stream": """
        WITH e AS (SELECT user_id AS key, ts, CASE event_type WHEN 'error' THEN 'source_error' WHEN 'purchase' THEN 'sold' ELSE 'open' END AS status FROM events),
        l AS (SELECT *, lag(status) OVER w AS was, lag(ts) OVER w AS seen FROM e WINDOW w AS (PARTITION BY key ORDER BY ts, status)),
        h AS (SELECT key, ts, CASE WHEN was IS NULL THEN 'first_seen' WHEN ts - seen > INTERVAL 2 DAY THEN 'reappeared' WHEN status = 'source_error' THEN 'source_failed'
               WHEN was = 'source_error' THEN 'source_recovered' ELSE 'status_changed' END AS event, was, status FROM l WHERE was IS NULL OR ts - seen > INTERVAL 2 DAY OR was <> status),
        n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC) AS back, count(*) OVER (PARTITION BY key) AS n FROM h)
        SELECT key, (least(n, 10) - back)::INT AS pos, epoch_us(ts) AS at, event, was AS from_status, status AS to_status FROM n WHERE back <= 10""",
    "stream_upserts": """
        SELECT key, epoch_us(ts) AS at, kind, value FROM (
            SELECT user_id AS key, ts, event_type AS kind, floor(value)::BIGINT AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC, floor(value) DESC) AS r FROM events) WHERE r = 1""",
}
