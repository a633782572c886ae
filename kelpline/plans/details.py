"""Queries on runs, regions, keys and fixed orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.operators import details as dt
from kelpline.sources.tables import table

REGIONS = {"english": r"(^|[^a-z])(the|and)([^a-z]|$)", "german": r"(^|[^a-z])(und|der)([^a-z]|$)", "french": r"(^|[^a-z])(les|une)([^a-z]|$)", "spanish": r"(^|[^a-z])(los|el)([^a-z]|$)"}
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "9-UNSEEN", "5-LOW")


def region_veto(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by the one language region their text shows, and whether the stated one contradicts it."""
    shown = dt.only_one(F.col("text"), REGIONS)
    stated = F.create_map(*[F.lit(x) for x in ("en", "english", "de", "german", "fr", "french", "es", "spanish")])[F.col("lang")]
    t = table(spark, sf, "documents").select(shown.alias("shown"), dt.contradicts(shown, stated).alias("contradicts"))
    return t.groupBy("shown", "contradicts").agg(F.count("*").alias("n"))


def backfilled_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """A newer column of customers filled from older ones."""
    new = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment"))
    filled = dt.backfill(new, (F.col("c_acctbal") < 0, F.lit("in debt")), (F.col("c_nationkey") < 10, F.concat(F.lit("nation "), F.col("c_nationkey").cast("string"))))
    return table(spark, sf, "customer").groupBy(filled.alias("evidence")).agg(F.count("*").alias("n"))


def run_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's day as a collection run: requests, failures, and the status they give."""
    e = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("failures"), F.count_if(F.col("event_type") == "purchase").alias("found")
    )
    status = dt.run_status(F.col("user_id") % 10 != 0, F.col("requests"), F.col("failures"), F.col("found"))
    return e.groupBy(status.alias("status")).agg(F.count("*").alias("runs"), F.sum(F.col("requests") - F.col("failures")).alias("succeeded"))


def failure_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Error events as failures of a request: a bounded code, and whether another try may help."""
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(k < 40, F.element_at(F.array(*[F.lit(x) for x in (429, 500, 403, 404)]), (k % 4 + 1).cast("int")))
    message = F.element_at(F.array(*[F.lit(x) for x in ("Request timed out", "connection reset", "Unexpected token <", "what?")]), (k % 4 + 1).cast("int"))
    code = dt.failure_code(status, message)
    t = table(spark, sf, "events").where("event_type = 'error'").select(code.alias("code"), dt.is_transient(code).alias("transient"))
    return t.groupBy("code", "transient").agg(F.count("*").alias("n"))


def content_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Parts by a stored fingerprint or else by the fields that are known."""
    stored = F.when(F.col("p_partkey") % 4 == 0, F.sha2("p_name", 256)).when(F.col("p_partkey") % 4 == 1, F.lit(""))
    key = dt.content_key(stored, F.col("p_name"), F.when(F.col("p_size") > 20, F.col("p_type")), F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", key.alias("content_key"))


def fixed_order(spark: SparkSession, sf: str) -> DataFrame:
    """The priorities in use, in an order that is fixed."""
    return dt.in_fixed_order(table(spark, sf, "orders"), "o_orderpriority", PRIORITIES)


def refresh_due(spark: SparkSession, sf: str) -> DataFrame:
    """Customers whose last order is longer ago than half a year of hours, or who have none."""
    last = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").cast("timestamp_ntz").alias("last"))
    t = table(spark, sf, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    return t.where(dt.due(F.col("last"), F.expr("TIMESTAMP_NTZ '2001-07-01 00:00:00'"), 4380)).select("c_custkey", F.date_format("last", "yyyy-MM-dd").alias("last_day"))


def manual_links(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers' statuses with rows for links that are kept by hand."""
    own = table(spark, sf, "supplier").select(F.col("s_name").alias("source"), F.when(F.col("s_acctbal") < 0, "error").otherwise("ok").alias("status"), F.col("s_acctbal").alias("balance"))
    return dt.with_rows(own, spark, [{"source": "board one", "status": "manual"}, {"source": "board two", "status": "manual"}])


def first_class_named(spark: SparkSession, sf: str) -> DataFrame:
    """The first word of each part's description that names a metal or an economy class."""
    words = F.split(F.concat_ws(" ", "p_name", F.lower("p_type"), F.lower("p_brand")), " ")
    return table(spark, sf, "part").groupBy(dt.first_match_in(words, "^(eco|stan|bra|pro|lar)").alias("word")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (region_veto, backfilled_evidence, run_statuses, failure_codes, content_keys, fixed_order, refresh_due, manual_links, first_class_named)}

SQL = {
    "region_veto": r"""
        WITH hits AS (
            SELECT lang, list_filter([
                CASE WHEN regexp_matches(text, '(^|[^a-z])(the|and)([^a-z]|$)') THEN 'english' END, CASE WHEN regexp_matches(text, '(^|[^a-z])(und|der)([^a-z]|$)') THEN 'german' END,
                CASE WHEN regexp_matches(text, '(^|[^a-z])(les|une)([^a-z]|$)') THEN 'french' END, CASE WHEN regexp_matches(text, '(^|[^a-z])(los|el)([^a-z]|$)') THEN 'spanish' END
            ], lambda x: x IS NOT NULL) AS found FROM documents
        ), one AS (
            SELECT CASE WHEN len(found) = 1 THEN found[1] END AS shown,
                   CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' WHEN 'es' THEN 'spanish' END AS stated FROM hits
        )
        SELECT shown, coalesce(shown <> stated, false) AS contradicts, count(*) AS n FROM one GROUP BY ALL
    """,
    "backfilled_evidence": """
        SELECT coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, CASE WHEN c_acctbal < 0 THEN 'in debt' END,
                        CASE WHEN c_nationkey < 10 THEN 'nation ' || c_nationkey END) AS evidence, count(*) AS n
        FROM customer GROUP BY 1
    """,
    "run_statuses": """
        WITH runs AS (
            SELECT user_id, ts::DATE AS day, count(*) AS requests, count(*) FILTER (event_type = 'error') AS failures,
                   count(*) FILTER (event_type = 'purchase') AS found
            FROM events GROUP BY 1, 2
        )
        SELECT CASE WHEN user_id % 10 = 0 THEN 'disabled' WHEN failures > 0 AND failures >= requests THEN 'error' WHEN failures > 0 THEN 'partial'
                    WHEN found = 0 THEN 'empty' ELSE 'ok' END AS status, count(*) AS runs, sum(requests - failures)::BIGINT AS succeeded
        FROM runs GROUP BY 1
    """,
    "failure_codes": """
        WITH e AS (
            SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_type = 'error'
        ), r AS (
            SELECT CASE WHEN k < 40 THEN [429, 500, 403, 404][k % 4 + 1] END AS status, ['timeout', 'network', 'bad_content', 'unknown'][k % 4 + 1] AS said FROM e
        ), c AS (
            SELECT CASE status WHEN 429 THEN 'rate_limited' WHEN 500 THEN 'server_error' WHEN 403 THEN 'forbidden' WHEN 404 THEN 'client_error' ELSE coalesce(said, 'unknown') END AS code FROM r
        )
        SELECT code, code IN ('rate_limited', 'server_error', 'timeout', 'network') AS transient, count(*) AS n FROM c GROUP BY 1, 2
    """,
    "content_keys": """
        SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN sha256(p_name)
                               ELSE concat_ws('|', p_name, CASE WHEN p_size > 20 THEN p_type END, p_brand) END AS content_key
        FROM part
    """,
    "fixed_order": """
        SELECT DISTINCT o_orderpriority, list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '9-UNSEEN', '5-LOW'], o_orderpriority)::INT AS place
        FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '9-UNSEEN', '5-LOW')
    """,
    "refresh_due": """
        SELECT c_custkey, strftime(last, '%Y-%m-%d') AS last_day
        FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) ON c_custkey = o_custkey
        WHERE coalesce(last + INTERVAL 4380 HOUR < TIMESTAMP '2001-07-01', true)
    """,
    "manual_links": """
        SELECT s_name AS source, CASE WHEN s_acctbal < 0 THEN 'error' ELSE 'ok' END AS status, s_acctbal AS balance FROM supplier
        UNION ALL VALUES ('board one', 'manual', NULL::DOUBLE), ('board two', 'manual', NULL::DOUBLE)
    """,
    "first_class_named": """
        SELECT list_filter(string_split(concat_ws(' ', p_name, lower(p_type), lower(p_brand)), ' '), lambda x: regexp_matches(x, '^(eco|stan|bra|pro|lar)'))[1] AS word, count(*) AS n
        FROM part GROUP BY 1
    """,
}
