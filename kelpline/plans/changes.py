"""Queries on what time and later knowledge change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions import text as tx
from kelpline.operators import changes as ch
from kelpline.operators import details as dt
from kelpline.operators import lifecycle as lc
from kelpline.operators import state as st
from kelpline.sources.tables import table

NOW = "2001-01-01 00:00:00"


def aging_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as evidence of their day: fresh, aging or expired a while later, and events where that changed."""
    k = F.col("o_orderkey")
    was = F.element_at(F.array(F.lit("fresh"), F.lit("aging"), F.lit("expired"), F.lit("unknown")), (k % 4 + 1).cast("int"))
    empty = F.array().cast("array<struct<at:timestamp,event:string,from_status:string,to_status:string>>")
    t = table(spark, sf, "orders").select(F.when(k % 10 != 0, F.col("o_orderdate")).alias("checked_at"), ((k % 3 + 1) * 400).alias("max_age"), was.alias("freshness"), empty.alias("history"))
    t = ch.refresh_evidence(t, F.lit(NOW))
    return t.groupBy("freshness", F.size("history").alias("events"), F.get("history", F.lit(0))["from_status"].alias("was")).agg(F.count("*").alias("n"))


def rebased_histories(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with a history of three changes, some under an older version of prints."""
    k = F.col("p_partkey")
    event = lambda name, *fields: F.struct(F.lit(name).alias("event"), F.array(*fields).cast("array<string>").alias("fields"))
    second = F.when(k % 3 == 0, F.lit("salary")).when(k % 3 == 1, F.lit("description")).otherwise(F.lit("title"))
    history = F.array(event("first_seen"), event("content_changed", F.lit("salary")), event("content_changed", F.lit("salary"), second))
    out = ch.rebase_history(history, F.concat(F.lit("s"), (k % 2).cast("string")), F.when(k % 5 != 0, k % 4), 3, ["salary"], {"s1": ["description"]}, limit=3)
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(out, lambda e: F.concat_ws(":", e["event"], F.array_join(e["fields"], "+"))), ",").alias("history"))


def reviewed_again(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers reviewed under their balance against customers' balances of the same numbers."""
    c = table(spark, sf, "customer").select((F.col("c_custkey") * 2).alias("id"), F.floor(F.col("c_acctbal") / 5000).cast("string").alias("print"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 7 != 0, F.floor(F.col("s_acctbal") / 5000).cast("string")).alias("print"))
    return ch.review_states(c, s)


def _cache(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("a"), (k * 3).cast("string")).alias("address"), F.when(k % 4 != 0, F.col("s_acctbal")).alias("lat"), F.when(k % 5 != 0, k.cast("double")).alias("lon"), (k % 6 == 0).alias("failed"),
        F.when(k % 12 == 0, F.lit("2000-11-01 00:00:00")).when(k % 18 == 6, F.lit("2000-12-20 00:00:00")).alias("checked_at"),
    )


def geocode_worklist(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 11 != 0, F.concat(F.lit("a"), F.expr("c_custkey div 2").cast("string"))).alias("address"), (F.col("c_nationkey") != 3).alias("wanted"))
    return ch.geocode_work(c, _cache(spark, sf), F.lit(NOW))


def cached_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("a"), F.col("c_custkey").cast("string")).alias("address"), F.when(F.col("c_custkey") % 2 == 0, 1.5).alias("lat"), F.lit(2.5).alias("lon"), F.lit("city").alias("precision"))
    return ch.with_coordinates(c, _cache(spark, sf)).select("c_custkey", "lat", "lon", "precision")


def batch_and_undo(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of two nations are hidden at once, and the batch of one of them is taken back."""
    c = table(spark, sf, "customer")
    states = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("value"))
    hidden, _ = ch.batch_update(states, c.where("c_nationkey = 1").select(F.col("c_custkey").alias("id")), "hidden")
    twice, before = ch.batch_update(hidden, c.where("c_nationkey = 2").select(F.col("c_custkey").alias("id")), "hidden")
    return ch.undo(twice, before).groupBy("value").agg(F.count("*").alias("n"), F.sum("id").alias("ids")).unionByName(twice.groupBy(F.concat(F.lit("before undo: "), "value").alias("value")).agg(F.count("*").alias("n"), F.sum("id").alias("ids")))


def converted_state(spark: SparkSession, sf: str) -> DataFrame:
    """Orders' states of another program: known customers, translated values."""
    o = table(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("id"), F.col("o_orderstatus").alias("value"))
    return ch.convert_state(o, table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), {"O": "planned", "F": "applied"}).groupBy("id", "value").agg(F.count("*").alias("n"))


def kept_history(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of one status as the feed, the others as history: retention, tombstones, deadlines and the feed's length."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("last_seen"), F.when(F.col("o_orderkey") % 3 == 0, F.date_add(F.to_date("o_orderdate"), 30)).alias("deadline"), "o_orderstatus", "o_orderpriority")
    rows = o.drop("o_orderstatus", "o_orderpriority")
    out = ch.historical_feed(rows.join(o.where("o_orderstatus = 'O'").select("id"), "id", "left_semi"), rows, o.where("o_orderpriority = '5-LOW'").select("id"), F.lit(NOW), days=200, most=150)
    return out.select("id", "seen")


def rotating_details(spark: SparkSession, sf: str) -> DataFrame:
    """The eight suppliers of each nation whose turn the third run is."""
    return ch.rotating_window(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", [F.col("s_suppkey")], 3, 2)


def source_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Users as sources, their days as runs: tier and state of each."""
    e = table(spark, sf, "events")
    day = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("bad"), F.count("*").alias("matched"), F.count_if(F.col("value") < 60).alias("noise"))
    runs = day.select("user_id", "day", (F.col("user_id") % 3 == 0).alias("official"), (F.col("bad") * 3 <= F.col("matched")).alias("ok"), "matched", "noise")
    return ch.source_tiers(runs, "user_id", "official", [F.desc("day")])


def guarded_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    """Customers recommended before against those now: gone, or here and no longer recommended."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("source"), "c_acctbal")
    now = c.where((F.col("id") % 5 != 0) | (F.col("n") > 12)).select("id", ((F.col("c_acctbal") > 5000) | (F.col("n") == 4)).alias("recommended"), (F.col("n") == 7).alias("explained"))
    return ch.recommendation_guard(c.where("c_acctbal > 0").select("id", "source"), now)


def applied_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as a feed with suppliers as manual rows: rows, moved states and new ids, counted."""
    c, s, o = table(spark, sf, "customer"), table(spark, sf, "supplier"), table(spark, sf, "orders")
    feed, manual = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("print")), s.select((F.col("s_suppkey") * 31).alias("id"), F.lit("manual").alias("print"))
    old = lambda key: -1 - F.col(key)  # noqa: E731  a former key, which no customer has, however many there are
    states = o.select(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).otherwise(old("o_custkey")).alias("id"), F.col("o_orderstatus").alias("value"))
    aliases = c.select("c_custkey").union(o.select("o_custkey")).distinct().select(old("c_custkey").alias("alias"), F.col("c_custkey").alias("new_key"))
    reviewed = c.where("c_nationkey < 4").select(F.col("c_custkey").alias("id"), F.lit("BUILDING").alias("print"))
    rows, moved, new = ch.apply_feed(feed, manual, states, aliases, reviewed, c.where("c_nationkey > 10").select(F.col("c_custkey").alias("id")), {"O": 0, "P": 1, "F": 2})
    count = lambda df, name, extra: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.sum(extra).alias("total"))
    return count(rows, "rows", F.when(F.col("print") == "manual", 1).otherwise(0)).union(count(moved, "states", F.when(F.col("value") == "F", 1).otherwise(0))).union(count(new, "new", F.col("id")))


def safe_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """Pages' addresses over https without what tracks; addresses that are not public are none."""
    k = F.col("page_id")
    raw = F.when(k % 7 == 0, F.concat(F.lit("https://user@site.example.com/"), k.cast("string"))).when(k % 7 == 1, F.concat(F.lit("https://10.0.0.1/"), k.cast("string"))).when(k % 7 == 2, F.concat(F.lit("http://site.example.com/"), k.cast("string")))
    tail = F.when(k % 2 == 0, "?a=1&utm_source=x&ref=keep&mc_cid=3&ref_src=tw#top").otherwise("?gclid=2&mc_eid=9")
    url = F.coalesce(raw, F.concat(F.lit("https://site.example.com/"), k.cast("string"), tail))
    return table(spark, sf, "pages").select("page_id", tx.safe_public_url(url).alias("url"))


def refusal_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Failures by their message: certificates, names that do not resolve, refusals."""
    k = F.col("event_id")
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    message = pick("certificate has expired", "getaddrinfo ENOTFOUND host", "unable to verify TLS chain", "connection refused", "EAI_AGAIN", None)
    status = pick(None, None, 401, None, 403)
    code = dt.failure_code(status, message)
    return table(spark, sf, "events").groupBy(code.alias("code"), dt.is_transient(code).alias("transient")).agg(F.count("*").alias("n"))


def merged_storage(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' areas of state, changed in two places at once, by an import: ranks decide and orphans go."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer")
    rank = F.element_at(F.array(F.lit(""), F.lit("planned"), F.lit("applied")), (k % 3 + 1).cast("int"))
    row = lambda when, area, value: c.where(when).select(F.lit(area).alias("area"), k.alias("item"), value.alias("value"))
    one = F.lit("1")
    before = row(k % 2 == 0, "states", F.lit("")).union(row(k % 5 == 0, "new", one)).union(row(k % 4 == 0, "hidden", one)).union(row(k % 8 == 0, "hidden_reasons", one))
    latest = row(k % 2 == 0, "states", rank).union(row(k % 5 == 0, "new", one)).union(row(k % 7 == 0, "reviewed", one)).union(row(k % 4 == 0, "hidden", one)).union(row(k % 8 == 0, "hidden_reasons", one))
    after = row(k % 6 != 1, "states", F.lit("planned")).union(row(k % 10 == 0, "new", one)).union(row(k % 12 == 0, "hidden", one)).union(row(k % 8 == 0, "hidden_reasons", one))
    out = st.merge_storage(latest, before, after, {"": 0, "planned": 1, "applied": 2}, "import")
    return out.groupBy("area", "value").agg(F.count("*").alias("n"), F.sum("item").alias("items"))


def all_events(spark: SparkSession, sf: str) -> DataFrame:
    """Orders in two snapshots in which every input varies: all their events."""
    k = F.col("o_orderkey")
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (n % len(xs) + 1).cast("int"))
    t = table(spark, sf, "orders").select(
        pick((None, "open", "source_error", "archived_missing", "open"), k).alias("prev_status"), pick(("open", "source_error", "closed"), F.expr("o_orderkey div 5")).alias("status"), pick((None, "a"), k).alias("prev_scope"),
        pick(("a", "b"), F.expr("o_orderkey div 3")).alias("scope"), pick(("p", None, "q"), F.expr("o_orderkey div 2")).alias("prev_print"), F.lit("p").alias("print"), pick(("fresh", "aging"), F.expr("o_orderkey div 7")).alias("prev_freshness"),
        F.lit("fresh").alias("freshness"), F.lit("x").alias("prev_evidence"), pick(("x", "x", "y"), F.expr("o_orderkey div 11")).alias("evidence"), F.when(k % 9 != 0, F.col("o_orderdate")).alias("last_event_at"),
    )
    return t.groupBy(F.array_join(lc.events_of(F.lit("2001-01-01 00:00:00")), ",").alias("events")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    merged_storage, all_events, aging_evidence, rebased_histories, reviewed_again, geocode_worklist, cached_coordinates, batch_and_undo, converted_state, kept_history, rotating_details, source_tiers,
    guarded_recommendations, applied_feed, safe_addresses, refusal_codes,
)}

_CACHE = """cache AS (SELECT 'a' || s_suppkey * 3 AS address, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS lat, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey::DOUBLE END AS lon, s_suppkey % 6 = 0 AS failed,
    CASE WHEN s_suppkey % 12 = 0 THEN TIMESTAMP '2000-11-01' WHEN s_suppkey % 18 = 6 THEN TIMESTAMP '2000-12-20' END AS checked_at FROM supplier)"""
SQL = {
    "merged_storage": """
        WITH c AS (SELECT c_custkey AS k, (c_custkey % 3) AS r FROM customer),
        s AS (SELECT k, CASE WHEN k % 2 = 0 AND k % 6 = 1 THEN NULL WHEN k % 2 = 0 THEN greatest(r, 1) WHEN k % 6 <> 1 THEN 1 END AS v FROM c),
        m AS (SELECT 'states' AS area, ['', 'planned', 'applied'][v + 1] AS value, k FROM s WHERE v IS NOT NULL
              UNION ALL SELECT 'new', '1', k FROM c WHERE k % 10 = 0 AND k % 7 <> 0 UNION ALL SELECT 'reviewed', '1', k FROM c WHERE k % 7 = 0
              UNION ALL SELECT 'hidden', '1', k FROM c WHERE k % 12 = 0 UNION ALL SELECT 'hidden_reasons', '1', k FROM c WHERE k % 8 = 0 AND k % 12 = 0)
        SELECT area, value, count(*) AS n, sum(k)::BIGINT AS items FROM m GROUP BY 1, 2""",
    "all_events": """
        WITH o AS (SELECT o_orderkey % 5 AS w, (o_orderkey // 5) % 3 AS s, o_orderkey % 2 = 1 AND (o_orderkey // 3) % 2 = 1 AS scope, (o_orderkey // 2) % 3 = 2 AS content, (o_orderkey // 7) % 2 = 1 AS fresh, (o_orderkey // 11) % 3 = 2 AS ev,
            o_orderkey % 9 = 0 OR floor((epoch_ms(TIMESTAMP '2001-01-01') - epoch_ms(o_orderdate)) / 86400000) >= 7 AS quiet FROM orders),
        x AS (SELECT *, CASE WHEN w = 3 THEN 'reappeared' WHEN w = 2 AND s <> 1 THEN 'source_recovered' WHEN w <> 2 AND s = 1 THEN 'source_failed' END AS e FROM o),
        f AS (SELECT w, quiet, concat_ws(',', CASE WHEN scope THEN 'scope_changed' END, e, CASE WHEN content THEN 'content_changed' END, CASE WHEN fresh THEN 'evidence_freshness_changed' END, CASE WHEN ev THEN 'evidence_state_changed' END,
            CASE WHEN e IS NULL AND w <> 2 AND s <> 0 THEN 'status_changed' END) AS l FROM x)
        SELECT CASE WHEN w = 0 THEN 'first_seen' WHEN l <> '' THEN l WHEN quiet THEN 'verified_unchanged' ELSE '' END AS events, count(*) AS n FROM f GROUP BY 1""",
    "aging_evidence": f"""
        WITH o AS (SELECT ['fresh', 'aging', 'expired', 'unknown'][o_orderkey % 4 + 1] AS was, (o_orderkey % 3 + 1) * 400 AS m,
            CASE WHEN o_orderkey % 10 <> 0 THEN floor((epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(o_orderdate)) / 86400000) END AS age FROM orders),
        f AS (SELECT was, CASE WHEN age IS NULL THEN 'unknown' WHEN age * 4 <= m * 3 THEN 'fresh' WHEN age <= m THEN 'aging' ELSE 'expired' END AS freshness FROM o)
        SELECT freshness, (was <> freshness)::INT AS events, CASE WHEN was <> freshness THEN was END AS was, count(*) AS n FROM f GROUP BY 1, 2, 3""",
    "rebased_histories": """
        WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'salary' WHEN 1 THEN 'description' ELSE 'title' END AS f, coalesce(CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 4 END, 0) >= 3 AS same FROM part)
        SELECT p_partkey, CASE WHEN same THEN 'first_seen:,content_changed:salary,content_changed:salary+' || f ELSE
            'legacy_content_change_unverified:salary,' || CASE WHEN f = 'salary' OR (f = 'description' AND p_partkey % 2 = 1) THEN 'legacy_content_change_unverified' ELSE 'content_changed' END
            || ':salary+' || f || ',source_fingerprint_rebased:' END AS history FROM p""",
    "reviewed_again": """
        WITH t AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 <> 0 THEN floor(s_acctbal / 5000)::BIGINT::VARCHAR END AS stored, floor(c_acctbal / 5000)::BIGINT::VARCHAR AS now
                   FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey * 2)
        SELECT id, CASE WHEN now <> stored THEN 'invalidated' WHEN now IS NULL THEN 'absent' ELSE 'kept' END AS state, CASE WHEN now <> stored THEN NULL ELSE coalesce(now, stored) END AS print FROM t""",
    "geocode_worklist": f"""
        WITH {_CACHE}, a AS (SELECT DISTINCT 'a' || c_custkey // 2 AS address FROM customer WHERE c_custkey % 11 <> 0 AND c_nationkey <> 3)
        SELECT address FROM a LEFT JOIN (SELECT *, true AS cached FROM cache) USING (address) WHERE CASE WHEN cached IS NULL THEN true
            WHEN failed THEN coalesce(TIMESTAMP '{NOW}' - checked_at > INTERVAL 30 DAY, true) ELSE lat IS NULL OR lon IS NULL END""",
    "cached_coordinates": f"""
        WITH {_CACHE}, g AS (SELECT * FROM cache WHERE NOT failed AND lat IS NOT NULL AND lon IS NOT NULL)
        SELECT c_custkey, coalesce(g.lat, CASE WHEN c_custkey % 2 = 0 THEN 1.5::DOUBLE END) AS lat, coalesce(g.lon, 2.5::DOUBLE) AS lon, CASE WHEN g.lat IS NULL THEN 'city' ELSE 'address' END AS precision
        FROM customer LEFT JOIN g ON address = 'a' || c_custkey""",
    "batch_and_undo": """
        WITH s AS (SELECT c_custkey AS id, c_nationkey AS n, CASE WHEN c_nationkey = 1 THEN 'hidden' ELSE c_mktsegment END AS value FROM customer WHERE c_acctbal > 0 OR c_nationkey = 1),
        t AS (SELECT c_custkey AS id, CASE WHEN c_nationkey IN (1, 2) THEN 'hidden' ELSE c_mktsegment END AS value FROM customer WHERE c_acctbal > 0 OR c_nationkey IN (1, 2))
        SELECT value, count(*) AS n, sum(id)::BIGINT AS ids FROM s GROUP BY 1 UNION ALL SELECT 'before undo: ' || value, count(*), sum(id)::BIGINT FROM t GROUP BY 1""",
    "converted_state": """
        SELECT o_custkey * 2 AS id, CASE o_orderstatus WHEN 'O' THEN 'planned' ELSE 'applied' END AS value, count(*) AS n FROM orders
        WHERE o_orderstatus IN ('O', 'F') AND o_custkey * 2 IN (SELECT c_custkey FROM customer) GROUP BY 1, 2""",
    "kept_history": f"""
        WITH h AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'O' AND o_orderpriority <> '5-LOW' AND TIMESTAMP '{NOW}' - o_orderdate <= INTERVAL 200 DAY
            AND NOT (o_orderkey % 3 = 0 AND o_orderdate::DATE + 30 < DATE '2001-01-01') ORDER BY o_orderdate DESC, o_orderkey LIMIT 150)
        SELECT o_orderkey AS id, true AS seen FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT id, false FROM h""",
    "rotating_details": """
        WITH s AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS k, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
        SELECT s_suppkey, s_nationkey FROM s WHERE (k - 6 % n + n) % n < 3""",
    "source_tiers": """
        WITH d AS (SELECT user_id, ts::DATE AS day, count(*) FILTER (event_type = 'error') AS bad, count(*) AS m, count(*) FILTER (value < 60) AS noise FROM events GROUP BY 1, 2),
        r AS (SELECT *, bad * 3 <= m AS ok, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS back FROM d), l AS (SELECT * FROM r WHERE back <= 24),
        q AS (SELECT user_id, noise / m AS share, row_number() OVER (PARTITION BY user_id ORDER BY back) AS k FROM l WHERE ok AND m >= 3),
        y AS (SELECT user_id, count(*) FILTER (share >= 0.8) AS noisy FROM q WHERE k <= 4 GROUP BY 1),
        s AS (SELECT user_id, count(*) AS runs, count(*) FILTER (ok) AS good, coalesce(min(back) FILTER (ok) - 1, count(*)) AS streak FROM l GROUP BY 1),
        t AS (SELECT *, coalesce(noisy, 0) AS z, runs >= 4 AND good < runs * 0.75 AS poor, user_id % 3 = 0 AS o FROM s LEFT JOIN y USING (user_id))
        SELECT user_id, runs, floor(good::DOUBLE / runs * 1000 + 0.5) / 1000 AS success_rate, streak,
            CASE WHEN o THEN CASE WHEN streak >= 2 THEN 'degraded' ELSE 'strong' END WHEN poor OR z >= 3 THEN 'weak' ELSE 'mixed' END AS tier,
            CASE WHEN streak >= 2 THEN 'degraded' WHEN poor THEN 'unstable' WHEN o THEN 'reliable' ELSE 'observed' END AS state FROM t""",
    "guarded_recommendations": """
        WITH b AS (SELECT c_custkey AS id, c_nationkey AS n, (c_custkey % 5 <> 0 OR c_nationkey > 12) AS present, c_acctbal > 5000 OR c_nationkey = 4 AS good FROM customer WHERE c_acctbal > 0),
        t AS (SELECT 'n' || n AS source, present AND good AS here, present AND n = 7 AS explained FROM b),
        g AS (SELECT '*' AS scope, count(*) AS baseline, count(*) FILTER (here) AS current, count(*) FILTER (NOT here AND NOT explained) AS lost, 3 AS f FROM t
              UNION ALL SELECT source, count(*), count(*) FILTER (here), count(*) FILTER (NOT here), 2 FROM t GROUP BY 1)
        SELECT scope, baseline, current, lost, baseline >= 5 AND current < greatest(f, ceil(baseline * 0.5)) AND lost >= 1 AS blocked FROM g""",
    "applied_feed": """
        WITH r AS (SELECT c_custkey AS id, c_mktsegment AS print FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey * 31 FROM supplier) UNION ALL SELECT s_suppkey * 31, 'manual' FROM supplier),
        m AS (SELECT o_custkey AS id, max(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END) AS v FROM orders GROUP BY 1),
        v AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey < 4),
        n AS (SELECT id FROM r WHERE id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey > 10) AND id NOT IN (SELECT id FROM v) UNION SELECT id FROM r JOIN v USING (id) WHERE print <> 'BUILDING')
        SELECT 'rows' AS part, count(*) AS n, sum((print = 'manual')::INT)::BIGINT AS total FROM r UNION ALL SELECT 'states', count(*), sum((v = 2)::INT)::BIGINT FROM m
        UNION ALL SELECT 'new', count(*), sum(id)::BIGINT FROM n""",
    "safe_addresses": """
        SELECT page_id, CASE WHEN page_id % 7 > 2 THEN 'https://site.example.com/' || page_id || CASE WHEN page_id % 2 = 0 THEN '?a=1&ref=keep' ELSE '' END END AS url FROM pages""",
    "refusal_codes": """
        WITH e AS (SELECT [NULL, NULL, 401, NULL, 403][event_id % 5 + 1] AS s, ['tls', 'dns', 'tls', 'network', 'dns', 'unknown'][event_id % 6 + 1] AS m FROM events),
        c AS (SELECT CASE WHEN s = 401 THEN 'client_error' WHEN s = 403 THEN 'forbidden' ELSE m END AS code FROM e)
        SELECT code, code IN ('dns', 'network') AS transient, count(*) AS n FROM c GROUP BY 1, 2""",
}
