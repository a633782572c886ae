"""Queries of the filter, facet, order and pulse families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions.values import closes_at, half_up
from kelpline.operators import filters as fl
from kelpline.operators import metrics as mt
from kelpline.operators import ranking as rk
from kelpline.operators.rules import first_match
from kelpline.sources.tables import table

NOW = "2001-07-01 00:00:00"
PRIORITIES = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3, "5-LOW": 4}

ORDER_FILTERS: fl.Predicates = {
    "search": fl.search(["o_orderpriority", "o_orderstatus"]),
    "status": fl.equals("o_orderstatus"),
    "priorities": fl.one_of("o_orderpriority"),
    "least_price": fl.at_least("o_totalprice"),
    "most_price": fl.at_most("o_totalprice"),
    "max_age_days": fl.newer_than("o_orderdate", NOW),
}


def _orders_named(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation")
    customers = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return table(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))


def market_pulse(spark: SparkSession, sf: str) -> DataFrame:
    """For each segment the orders of the last 90 days and of the 90 before, the change, the share of
    high-priority ones and the most frequent nation."""
    t = _orders_named(spark, sf).where(fl.conjunction(ORDER_FILTERS, {"least_price": 1000.0, "status": None}))
    recent, prior = mt.two_windows(F.col("o_orderdate"), F.lit(NOW), 90)
    nation = t.where(recent).groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("n"))
    mode = nation.groupBy("c_mktsegment").agg(F.min_by("n_name", F.struct(-F.col("n"), "n_name")).alias("top_nation"))
    urgent = F.count_if(recent & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    counts = t.groupBy("c_mktsegment").agg(F.count_if(recent).alias("recent"), F.count_if(prior).alias("prior"), urgent.alias("urgent"))
    return counts.join(mode, "c_mktsegment", "left").select(
        "c_mktsegment", "recent", "prior", (F.col("recent") - F.col("prior")).alias("delta"), mt.rate(F.col("urgent"), F.col("recent")).alias("urgent_share"), "top_nation"
    )


def filter_conjunction(spark: SparkSession, sf: str) -> DataFrame:
    values = {"search": "HIGH", "status": "O", "priorities": [], "least_price": 50_000.0, "most_price": 200_000.0, "max_age_days": 1500}
    return fl.matching(table(spark, sf, "orders"), ORDER_FILTERS, values).select("o_orderkey", "o_custkey", "o_totalprice")


FACET_VALUES = {"status": "F", "priorities": ["1-URGENT", "5-LOW"], "least_price": 20_000.0}


def facet_ignore_self(spark: SparkSession, sf: str) -> DataFrame:
    return fl.facets(table(spark, sf, "orders"), ORDER_FILTERS, FACET_VALUES, {"status": "o_orderstatus", "priorities": "o_orderpriority"})


def facet_exploded(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct option values when a row names several: words of part types."""
    each = table(spark, sf, "part").select(F.explode(F.array_distinct(F.split("p_type", " "))).alias("value"))
    return each.where("value <> ''").groupBy("value").agg(F.count("*").alias("n"))


def keep_in_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose deadline (30 days after the order) has not passed at its day's end, or that are urgent."""
    t = table(spark, sf, "orders").withColumn("deadline", F.date_add(F.to_date("o_orderdate"), 30))
    still = F.unix_seconds(closes_at(F.col("deadline"))) >= F.unix_seconds(F.lit(NOW).cast("timestamp"))
    return t.where(still | ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") != "F"))).select("o_orderkey", F.col("deadline").cast("string").alias("deadline"))


def reject_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """The first reason that speaks against a document, and how often each does."""
    docs = table(spark, sf, "documents")
    rules = [
        ("too_short", F.length("text") < 100),
        ("table_like", F.length("text") - F.length(F.replace("text", F.lit("|"), F.lit(""))) > 10),
        ("shouting", F.col("text").rlike("[A-Z]{5,}!!")),
        ("not_english", F.col("lang") != "en"),
    ]
    reason = F.coalesce(fl.first_reason(rules), F.lit("kept"))
    return docs.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def sort_rank_chain_topk(spark: SparkSession, sf: str) -> DataFrame:
    """A page of the orders by status rank, priority rank, price and key."""
    t = table(spark, sf, "orders").withColumn("rank", rk.rank_of("o_orderpriority", PRIORITIES))
    order = [rk.rank_of("o_orderstatus", {"O": 0, "P": 1, "F": 2}), F.col("rank"), F.desc("o_totalprice"), F.col("o_orderkey")]
    return rk.top(t, order, 60, skip=60).select("o_orderkey", "o_orderstatus", "rank", "o_totalprice")


def per_group_topk(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents")
    return rk.top_per(t, ["source"], [F.desc("n_chars"), F.col("doc_id")], 5).select("source", "doc_id", "n_chars", F.col("nth").cast("long").alias("nth"))


def nulls_last_deadline(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by label, those without one last, then by length: the first 100."""
    t = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return t.orderBy(F.col("quality").asc_nulls_last(), F.desc("n_chars"), "doc_id").limit(100).select("doc_id", "quality", "n_chars")


def distance_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Bands of the days that orders have waited: 30, 90 and 365 days, and missing priorities as a band of their own."""
    age = F.floor((F.unix_millis(F.lit(NOW).cast("timestamp")) - F.unix_millis(F.col("o_orderdate").cast("timestamp"))) / 86_400_000)
    band = first_match([(age < 0, "future"), (age <= 30, "month"), (age <= 90, "quarter"), (age <= 365, "year")], "older")
    return table(spark, sf, "orders").groupBy(band.alias("band")).agg(F.count("*").alias("n"), half_up(F.avg(age), 3).alias("mean_age"))


QUERIES = {f.__name__: f for f in (
    market_pulse, filter_conjunction, facet_ignore_self, facet_exploded, keep_in_feed, reject_reasons, sort_rank_chain_topk,
    per_group_topk, nulls_last_deadline, distance_bands,
)}

_AGE = "floor((epoch_ms(TIMESTAMP '2001-07-01 00:00:00') - epoch_ms(o_orderdate)) / 86400000.0)::BIGINT"
_MS = "(epoch_ms(TIMESTAMP '2001-07-01 00:00:00') - epoch_ms(o_orderdate))"

SQL = {
    "market_pulse": f"""
        WITH t AS (SELECT *, {_MS} AS age FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
                   WHERE o_totalprice >= 1000.0),
        c AS (SELECT c_mktsegment, count(*) FILTER (age >= 0 AND age < 7776000000) AS recent,
                     count(*) FILTER (age >= 7776000000 AND age < 15552000000) AS prior,
                     count(*) FILTER (age >= 0 AND age < 7776000000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')) AS urgent
              FROM t GROUP BY 1),
        m AS (SELECT c_mktsegment, n_name AS top_nation FROM
                (SELECT c_mktsegment, n_name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY count(*) DESC, n_name) AS r
                 FROM t WHERE age >= 0 AND age < 7776000000 GROUP BY 1, 2) WHERE r = 1)
        SELECT c_mktsegment, recent, prior, recent - prior AS delta,
               CASE WHEN recent > 0 THEN floor(urgent::DOUBLE / recent::DOUBLE * 1000 + 0.5) / 1000 ELSE 0 END AS urgent_share, top_nation
        FROM c LEFT JOIN m USING (c_mktsegment)""",
    "filter_conjunction": f"""
        SELECT o_orderkey, o_custkey, o_totalprice FROM orders
        WHERE contains(lower(concat_ws(' ', o_orderpriority, o_orderstatus)), 'high') AND o_orderstatus = 'O'
          AND o_totalprice >= 50000.0 AND o_totalprice <= 200000.0 AND {_MS} <= 1500 * 86400000::BIGINT""",
    "facet_ignore_self": """
        SELECT 'status' AS facet, o_orderstatus AS value, count(*) AS n FROM orders
        WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_totalprice >= 20000.0 GROUP BY 2
        UNION ALL
        SELECT 'priorities', o_orderpriority, count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 20000.0 GROUP BY 2""",
    "facet_exploded": """
        SELECT value, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(p_type, ' '))) AS value FROM part) WHERE value <> '' GROUP BY 1""",
    "keep_in_feed": """
        SELECT o_orderkey, strftime(o_orderdate::DATE + 30, '%Y-%m-%d') AS deadline FROM orders
        WHERE (o_orderdate::DATE + 31)::TIMESTAMP - INTERVAL 1 SECOND >= TIMESTAMP '2001-07-01 00:00:00'
           OR (o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F')""",
    "reject_reasons": """
        SELECT CASE WHEN length(text) < 100 THEN 'too_short' WHEN length(text) - length(replace(text, '|', '')) > 10 THEN 'table_like'
                    WHEN regexp_matches(text, '[A-Z]{5,}!!') THEN 'shouting' WHEN lang <> 'en' THEN 'not_english' ELSE 'kept' END AS reason,
               count(*) AS n, sum(n_chars)::BIGINT AS chars
        FROM documents GROUP BY 1""",
    "sort_rank_chain_topk": """
        SELECT o_orderkey, o_orderstatus, rank, o_totalprice FROM (
            SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 WHEN '5-LOW' THEN 4 ELSE 5 END AS rank
            FROM orders)
        ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 3 END, rank, o_totalprice DESC, o_orderkey LIMIT 60 OFFSET 60""",
    "per_group_topk": """
        SELECT source, doc_id, n_chars, nth FROM
            (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS nth FROM documents) WHERE nth <= 5""",
    "nulls_last_deadline": """
        SELECT doc_id, quality, n_chars FROM documents LEFT JOIN labels USING (doc_id)
        ORDER BY quality ASC NULLS LAST, n_chars DESC, doc_id LIMIT 100""",
    "distance_bands": f"""
        SELECT CASE WHEN {_AGE} < 0 THEN 'future' WHEN {_AGE} <= 30 THEN 'month' WHEN {_AGE} <= 90 THEN 'quarter' WHEN {_AGE} <= 365 THEN 'year' ELSE 'older' END AS band,
               count(*) AS n, floor(avg({_AGE}) * 1000 + 0.5) / 1000 AS mean_age
        FROM orders GROUP BY 1""",
}
