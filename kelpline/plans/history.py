"""Queries of the metric, lifecycle and state families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions.values import epoch_ms
from kelpline.operators import lifecycle as lc
from kelpline.operators import metrics as mt
from kelpline.operators import state as st
from kelpline.operators.joins import upsert
from kelpline.sources.tables import table

SPLIT = "2024-01-20 00:00:00"
NOW = "2024-01-31 00:00:00"


def _time(text: str):
    return F.lit(text).cast("timestamp")


def source_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Each source with its documents, those also under the source that the labels tie them to, and rates."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    other = F.when(F.col("doc_id") % 5 == 0, F.array(F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string"))))
    t = mt.attributed(docs.withColumn("others", other), "source", "others")
    n = F.count("*")
    return t.groupBy("attributed").agg(
        n.alias("n"), F.count_if(F.col("quality") == 0).alias("low_quality"), F.least(F.count("quality"), F.lit(15)).alias("judged"),
        mt.rate(F.count_if(F.col("quality") == 0), F.count("quality")).alias("low_rate"), mt.rate(F.count_if(F.col("n_chars") < 500), n).alias("short_rate"),
    )


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", (F.col("event_type") != "error").alias("ok"), (F.col("value") / 100).alias("noise"))
    return mt.last_runs(e, "user_id", [F.desc("ts"), F.desc("event_id")])


def quality_tier_window(spark: SparkSession, sf: str) -> DataFrame:
    out = mt.reliability(_runs(spark, sf), "user_id", "ok", "noise")
    return out.select("user_id", "runs", "successes", "streak", F.col("noisy").cast("long").alias("noisy"), "success_rate", "tier")


def failure_streak_islands(spark: SparkSession, sf: str) -> DataFrame:
    """The longest row of failures of each user, of runs in time order."""
    return spark.sql("""
        SELECT user_id, max(n) AS longest, count(*) AS streaks FROM (
            SELECT user_id, good, count(*) AS n FROM (
                SELECT user_id, event_type, count_if(event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS good FROM {e})
            WHERE event_type = 'error' GROUP BY user_id, good)
        GROUP BY user_id""", e=table(spark, sf, "events"))


def collapse_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Users of the first half of the month and buyers of high value in the second, by their main type of event: which types lost too many."""
    e, half = table(spark, sf, "events"), F.lit("2024-01-16").cast("timestamp_ntz")
    before, after = e.where(F.col("ts") < half), e.where((F.col("ts") >= half) & (F.col("event_type") == "purchase") & (F.col("value") > 90))
    base = before.groupBy("user_id").agg(F.min("event_type").alias("source"), F.bool_or(F.col("event_type") == "error").alias("explained"))
    return mt.collapse_guard(base, after.select("user_id"), "user_id", "source")


def concentration_share(spark: SparkSession, sf: str) -> DataFrame:
    return mt.concentration(table(spark, sf, "documents"), "lang")


def rejection_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of failed events as one ordered text for each day."""
    e = table(spark, sf, "events").where("event_type = 'error'").withColumn("code", F.concat(F.lit("E"), (F.get_json_object("props", "$.k").cast("int") % 5).cast("string")))
    n = e.groupBy(F.to_date("ts").alias("day"), "code").agg(F.count("*").alias("n"))
    return n.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "code", F.col("n").cast("string")))), ",").alias("codes"))


def top_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return mt.most_frequent(table(spark, sf, "documents"), "source", ["src0"])


def _snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Users before and after the split: status by their last event, print by how many events of each kind they had."""
    e = table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    old, new = e.where(F.col("t") < _time(SPLIT)), e.where((F.col("t") >= _time(SPLIT)) & (F.col("user_id") % 11 != 0))

    def snap(d: DataFrame) -> DataFrame:
        last = F.max_by("event_type", F.struct("t", "event_id"))
        out = d.groupBy("user_id").agg(last.alias("last"), F.count_if(F.col("event_type") == "purchase").alias("bought"), F.max("t").alias("at"))
        return out.withColumn("status", F.when(F.col("last") == "error", "source_error").otherwise("open")).withColumn("print", F.concat(F.lit("p"), (F.col("bought") % 4).cast("string")))

    entry = F.array(F.struct(F.col("at"), F.lit("first_seen").alias("event"), F.lit(None).cast("string").alias("from_status"), F.col("status").alias("to_status")))
    previous = snap(old.where(F.col("user_id") % 13 != 0)).withColumn("first_seen_at", F.col("at")).withColumn("history", entry.cast(f"array<{lc.EVENT}>"))
    return previous, snap(new).select("user_id", "status", "print")


def reconcile_events(spark: SparkSession, sf: str) -> DataFrame:
    previous, current = _snapshots(spark, sf)
    out = lc.reconcile(current, previous, "user_id", _time(NOW))
    return out.select("user_id", "event", F.size("history").cast("long").alias("entries"), F.floor(epoch_ms(F.col("first_seen_at")) / 1000).alias("first_seen"))


def carry_missing_ttl(spark: SparkSession, sf: str) -> DataFrame:
    """Users of the old snapshot who are gone: some just now, some a while ago, by number."""
    previous, current = _snapshots(spark, sf)
    since = F.when(F.col("user_id") % 2 == 0, _time(NOW) - F.make_dt_interval((F.col("user_id") % 30).cast("int")))
    out = lc.carry_missing(current, previous.withColumn("missing_since", since), "user_id", _time(NOW))
    return out.select("user_id", "status", "event", F.unix_seconds("missing_since").alias("since"))


def history_tail_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """The last 24 events of each user with what they say of the time they span."""
    t = mt.last_runs(table(spark, sf, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 24)
    return t.groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("least_id"), F.max_by("event_type", -F.col("back")).alias("newest"))


def field_change_detect(spark: SparkSession, sf: str) -> DataFrame:
    """Which fields differ between an order and the customer's one before it."""
    cols = ["o_orderstatus", "o_orderpriority"]
    t = table(spark, sf, "orders").withColumn("prints", lc.field_prints(cols))
    out = spark.sql("SELECT o_orderkey, prints, lag(prints) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS was FROM {t}", t=t).where("was is not null")
    return out.select("o_orderkey", F.array_join(lc.changed_fields(F.col("prints"), F.col("was"), cols), ",").alias("changed"))


def three_state_history(spark: SparkSession, sf: str) -> DataFrame:
    previous, current = _snapshots(spark, sf)
    source = F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string"))
    p = previous.withColumn("source", source).withColumn("state", F.when(F.col("user_id") % 3 == 0, "not_seen").otherwise("seen"))
    healthy = spark.createDataFrame([("s0", True), ("s1", False), ("s2", True)], "source string, ok boolean")
    return lc.three_states(p, current.withColumn("source", source), "user_id", "source", healthy)


def new_ids(spark: SparkSession, sf: str) -> DataFrame:
    previous, current = _snapshots(spark, sf)
    return current.join(previous, "user_id", "left_anti").select("user_id", "status")


def alias_rename_merge(spark: SparkSession, sf: str) -> DataFrame:
    """States of users under old numbers, renamed and merged by rank."""
    ranks = {"view": 0, "click": 1, "signup": 2, "purchase": 3}
    aliases = spark.range(0, 150).select(F.col("id").alias("alias"), (F.col("id") % 40).alias("new_key")).where("alias >= 100")
    states = st.rename_keys(table(spark, sf, "events").select("user_id", "event_type"), "user_id", aliases)
    return st.rank_merge(states, ["user_id"], "event_type", ranks)


def workflow_rank_merge(spark: SparkSession, sf: str) -> DataFrame:
    return st.rank_merge(table(spark, sf, "orders").select("o_custkey", "o_orderstatus"), ["o_custkey"], "o_orderstatus", {"O": 0, "P": 1, "F": 2})


def three_way_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Balances in three versions: one side changed some and dropped some, the other added others meanwhile."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("value"))
    before = c.where("k % 2 = 0")
    after = before.where("k % 10 <> 0").withColumn("value", F.when(F.col("k") % 3 == 0, F.col("value") + 1).otherwise(F.col("value"))).union(c.where("k % 20 = 1"))
    latest = before.where("k % 4 <> 2").union(c.where("k % 20 = 3"))
    return st.three_way_merge(latest, before, after, ["k"])


def quarantine_bad_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with a balance below zero or an unknown segment, with the reasons."""
    _, bad = st.quarantine(table(spark, sf, "customer"), [("in_debt", F.col("c_acctbal") < 0), ("segment", ~F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "FURNITURE"))])
    return bad.select("c_custkey", F.array_join("reasons", "+").alias("reasons"))


def manual_override(spark: SparkSession, sf: str) -> DataFrame:
    """Feed rows overridden by hand-made ones of the same key, plus tracked rows that are gone from both."""
    feed = table(spark, sf, "part").select("p_partkey", "p_name").where("p_partkey % 4 <> 0")
    manual = table(spark, sf, "part").where("p_partkey % 50 = 0").select("p_partkey", F.upper("p_name").alias("p_name"))
    tracked = table(spark, sf, "part").where("p_partkey % 6 = 0").select("p_partkey", F.concat(F.lit("archived "), "p_name").alias("p_name"))
    return upsert(tracked, upsert(feed, manual, "p_partkey"), "p_partkey")


def feed_health(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("at"))
    return e.select("user_id", lc.feed_health(F.col("at"), _time("2024-01-30 20:00:00"), 6).alias("health"))


QUERIES = {f.__name__: f for f in (
    source_metrics, quality_tier_window, failure_streak_islands, collapse_guard, concentration_share, rejection_histogram, top_frequency,
    reconcile_events, carry_missing_ttl, history_tail_bounded, field_change_detect, three_state_history, new_ids, alias_rename_merge,
    workflow_rank_merge, three_way_merge, quarantine_bad_rows, manual_override, feed_health,
)}

_RATE = "CASE WHEN {1} > 0 THEN floor(({0})::DOUBLE / ({1})::DOUBLE * 1000 + 0.5) / 1000 ELSE 0 END"
_SNAP = """
    o AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS last, count(*) FILTER (event_type = 'purchase') AS bought, max(ts) AS t0
          FROM events WHERE ts < TIMESTAMP '2024-01-20' AND user_id % 13 <> 0 GROUP BY 1),
    n AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS last, count(*) FILTER (event_type = 'purchase') AS bought
          FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND user_id % 11 <> 0 GROUP BY 1),
    p AS (SELECT user_id, CASE WHEN last = 'error' THEN 'source_error' ELSE 'open' END AS status, bought % 4 AS print, t0 FROM o),
    c AS (SELECT user_id, CASE WHEN last = 'error' THEN 'source_error' ELSE 'open' END AS status, bought % 4 AS print FROM n)"""

SQL = {
    "source_metrics": f"""
        WITH t AS (SELECT unnest(CASE WHEN doc_id % 5 = 0 THEN list_distinct([source, 'src' || (doc_id % 20)]) ELSE [source] END) AS attributed, * FROM documents LEFT JOIN labels USING (doc_id))
        SELECT attributed, count(*) AS n, count(*) FILTER (quality = 0) AS low_quality, least(count(quality), 15) AS judged,
               {_RATE.format("count(*) FILTER (quality = 0)", "count(quality)")} AS low_rate, {_RATE.format("count(*) FILTER (n_chars < 500)", "count(*)")} AS short_rate
        FROM t GROUP BY 1""",
    "quality_tier_window": f"""
        WITH r AS (SELECT *, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events),
        k AS (SELECT * FROM r WHERE back <= 24),
        g AS (SELECT user_id, count(*) FILTER (value / 100 >= 0.8) AS noisy FROM
                (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY back) AS nth FROM k WHERE ok) WHERE nth <= 4 GROUP BY 1),
        s AS (SELECT user_id, count(*) AS runs, count(*) FILTER (ok) AS successes, coalesce(min(back) FILTER (ok) - 1, count(*)) AS streak FROM k GROUP BY 1),
        v AS (SELECT s.*, coalesce(noisy, 0) AS noisy, {_RATE.format("successes", "runs")} AS success_rate FROM s LEFT JOIN g USING (user_id))
        SELECT user_id, runs, successes, streak, noisy, success_rate, CASE WHEN streak >= 2 THEN 'degraded' WHEN runs >= 4 AND success_rate < 0.75 OR noisy >= 3 THEN 'weak'
               WHEN runs < 4 THEN 'mixed' ELSE 'strong' END AS tier FROM v""",
    "failure_streak_islands": """
        WITH g AS (SELECT user_id, event_type, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS good FROM events)
        SELECT user_id, max(n) AS longest, count(*) AS streaks FROM (SELECT user_id, good, count(*) AS n FROM g WHERE event_type = 'error' GROUP BY 1, 2) GROUP BY 1""",
    "collapse_guard": """
        WITH b AS (SELECT user_id, min(event_type) AS source, bool_or(event_type = 'error') AS explained FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1),
        j AS (SELECT b.*, a.user_id IS NOT NULL AS here FROM b LEFT JOIN (SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND event_type = 'purchase' AND value > 90) a USING (user_id)),
        s AS (SELECT '*' AS scope, count(*) AS baseline, count(*) FILTER (here) AS current, count(*) FILTER (NOT here AND NOT explained) AS lost, 3 AS f FROM j
              UNION ALL SELECT source, count(*), count(*) FILTER (here), count(*) FILTER (NOT here), 2 FROM j GROUP BY 1)
        SELECT scope, baseline, current, lost, baseline >= 5 AND current < greatest(f, ceil(baseline * 0.5)) AND lost >= 1 AS blocked FROM s""",
    "concentration_share": f"""
        WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT *, sum(n) OVER () AS total FROM n)
        SELECT lang, n, {_RATE.format("n", "total")} AS share, total >= 10 AND n >= total * 0.4 AS concentrated FROM t""",
    "rejection_histogram": """
        WITH n AS (SELECT ts::DATE AS day, 'E' || ((props->>'$.k')::INT % 5) AS code, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2)
        SELECT strftime(day, '%Y-%m-%d') AS day, string_agg(code || '=' || n, ',' ORDER BY code || '=' || n) AS codes FROM n GROUP BY 1""",
    "top_frequency": "SELECT source, count(*) AS n FROM documents WHERE source <> 'src0' GROUP BY 1 ORDER BY n DESC, source LIMIT 1",
    "reconcile_events": f"""
        WITH {_SNAP}, e AS (SELECT c.user_id, p.t0, CASE WHEN p.user_id IS NULL THEN 'first_seen' WHEN p.status = 'source_error' AND c.status <> 'source_error' THEN 'source_recovered'
            WHEN p.status <> 'source_error' AND c.status = 'source_error' THEN 'source_failed' WHEN p.print <> c.print THEN 'content_changed' WHEN p.status <> c.status THEN 'status_changed'
            WHEN epoch_ms(TIMESTAMP '2024-01-31') - epoch_ms(p.t0) >= 7 * 86400000 THEN 'verified_unchanged' END AS event FROM c LEFT JOIN p USING (user_id))
        SELECT user_id, event, (CASE WHEN t0 IS NULL THEN 0 ELSE 1 END + CASE WHEN event IS NULL THEN 0 ELSE 1 END)::BIGINT AS entries,
               epoch_ms(coalesce(t0, TIMESTAMP '2024-01-31')) // 1000 AS first_seen FROM e""",
    "carry_missing_ttl": f"""
        WITH {_SNAP}, g AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN user_id % 30 END AS d FROM p WHERE user_id NOT IN (SELECT user_id FROM c))
        SELECT user_id, 'archived_missing' AS status, CASE WHEN d IS NULL THEN 'disappeared' END AS event, epoch_ms(TIMESTAMP '2024-01-31') // 1000 - coalesce(d, 0) * 86400 AS since
        FROM g WHERE coalesce(d, 0) <= 14""",
    "history_tail_bounded": """
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events)
        SELECT user_id, count(*) AS n, min(event_id) AS least_id, min_by(event_type, back) AS newest FROM r WHERE back <= 24 GROUP BY 1""",
    "field_change_detect": """
        WITH l AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p, lag(o_orderkey) OVER w AS k, lag(o_orderstatus) OVER w AS ls, lag(o_orderpriority) OVER w AS lp
                   FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
        SELECT o_orderkey, concat_ws(',', CASE WHEN s IS DISTINCT FROM ls THEN 'o_orderstatus' END, CASE WHEN p IS DISTINCT FROM lp THEN 'o_orderpriority' END) AS changed FROM l WHERE k IS NOT NULL""",
    "three_state_history": f"""
        WITH {_SNAP} SELECT coalesce(c.user_id, p.user_id) AS user_id, 's' || (coalesce(c.user_id, p.user_id) % 4) AS source,
            CASE WHEN c.user_id IS NOT NULL THEN 'seen' WHEN p.user_id % 4 IN (0, 2) OR p.user_id % 3 = 0 THEN 'not_seen' ELSE 'unverified' END AS state
        FROM c FULL JOIN p ON c.user_id = p.user_id""",
    "new_ids": f"WITH {_SNAP} SELECT user_id, status FROM c WHERE user_id NOT IN (SELECT user_id FROM p)",
    "alias_rename_merge": """
        WITH s AS (SELECT CASE WHEN user_id BETWEEN 100 AND 149 THEN user_id % 40 ELSE user_id END AS user_id, event_type,
                          CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE -1 END AS r FROM events)
        SELECT user_id, max_by(event_type, r) AS event_type FROM s GROUP BY 1""",
    "workflow_rank_merge": """
        SELECT o_custkey, max_by(o_orderstatus, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE -1 END) AS o_orderstatus FROM orders GROUP BY 1""",
    "three_way_merge": """
        WITH b AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0),
        a AS (SELECT k, CASE WHEN k % 3 = 0 THEN v + 1 ELSE v END AS v FROM b WHERE k % 10 <> 0 UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 20 = 1),
        l AS (SELECT * FROM b WHERE k % 4 <> 2 UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 20 = 3),
        d AS (SELECT coalesce(a.k, b.k) AS k, a.v, a.k IS NOT NULL AS s FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v)
        SELECT coalesce(d.k, l.k) AS k, CASE WHEN s THEN d.v ELSE l.v END AS value FROM l FULL JOIN d ON l.k = d.k WHERE coalesce(s, true) AND (l.k IS NOT NULL OR s)""",
    "quarantine_bad_rows": """
        SELECT * FROM (SELECT c_custkey, concat_ws('+', CASE WHEN c_acctbal < 0 THEN 'in_debt' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN 'segment' END) AS reasons FROM customer)
        WHERE reasons <> ''""",
    "manual_override": """
        SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN upper(p_name) WHEN p_partkey % 4 <> 0 THEN p_name ELSE 'archived ' || p_name END AS p_name
        FROM part WHERE p_partkey % 50 = 0 OR p_partkey % 4 <> 0 OR p_partkey % 6 = 0""",
    "feed_health": """
        WITH e AS (SELECT user_id, epoch_ms(TIMESTAMP '2024-01-30 20:00:00') - epoch_ms(max(ts)) AS age FROM events GROUP BY 1)
        SELECT user_id, CASE WHEN age IS NULL THEN 'invalid' WHEN age < -300000 THEN 'future' WHEN age > 21600000 THEN 'stale' ELSE 'fresh' END AS health FROM e""",
}
