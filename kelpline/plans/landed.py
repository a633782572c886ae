"""Queries on landed payloads, which are made of table rows and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.sources import landed as ld
from kelpline.sources.tables import table


def json_board_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as boards by brand, in three wrappings, with one broken payload; read back as postings."""
    p = table(spark, sf, "part")
    row = F.struct(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("company"),
        F.col("p_type").alias("location"), F.array(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("tags"),
    )
    boards = p.groupBy("p_brand", (F.col("p_partkey") % 20).alias("page")).agg(F.to_json(F.collect_list(row)).alias("rows"))
    way = F.col("page") % 3
    payload = F.when(way == 0, F.concat(F.lit('{"jobs":'), "rows", F.lit("}"))).when(way == 1, F.concat(F.lit('{"data":'), "rows", F.lit(',"links":{"next":null}}'))).otherwise(F.concat(F.lit('[{"legal":"note"},'), F.substr("rows", F.lit(2))))
    landed = boards.select(F.col("p_brand").alias("source"), payload.alias("payload")).union(spark.createDataFrame([("broken", '{"jobs":[{"id"')], "source string, payload string"))
    return ld.json_board(landed).select("source", "id", "title", "location", F.array_join("tags", ",").alias("tags"))


def xml_block_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as XML lists by nation, read back."""
    c = table(spark, sf, "customer")
    one = F.concat(F.lit("<wanted><id>"), F.col("c_custkey").cast("string"), F.lit("</id><name><![CDATA["), "c_name", F.lit("]]></name><kind>"), "c_mktsegment", F.lit(" &amp; more</kind></wanted>"))
    landed = c.groupBy(F.col("c_nationkey").alias("source")).agg(F.concat(F.lit("<root>\n"), F.array_join(F.collect_list(one), "\n"), F.lit("</root>")).alias("payload"))
    return ld.xml_rows(landed, "payload", "wanted", {"id": "id", "name": "name", "kind": "kind"}).select("source", "id", "name", "kind")


def html_list_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The paragraphs of pages as rows with their position and what they link to."""
    rows = ld.html_rows(table(spark, sf, "pages").select("page_id", F.col("html").alias("payload")), "payload", r"(?is)<p\b[^>]*>.*?</p>", {"id": [r"(?is)<p\b[^>]*>(.*?)</p>"]})
    return rows.groupBy("page_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("id")).cast("long").alias("chars"))


def json_ld_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as JSON-LD in pages, at the root, in an array and in a graph, read back."""
    s = table(spark, sf, "supplier")
    o = F.concat(F.lit('{"@type":"JobPosting","identifier":'), F.col("s_suppkey").cast("string"), F.lit(',"hiringOrganization":{"name":"'), "s_name", F.lit('"}}'))
    way = F.col("s_suppkey") % 4
    body = F.when(way == 0, o).when(way == 1, F.concat(F.lit("["), o, F.lit(',{"@type":"Place"}]'))).when(way == 2, F.concat(F.lit('{"@graph":[{"@type":"Thing"},'), o, F.lit("]}"))).otherwise(F.lit('{"@type":"JobPosting",'))
    page = F.concat(F.lit('<html><script type="application/ld+json">'), body, F.lit("</script></html>"))
    found = ld.json_ld(s.select(F.lit("s").alias("source"), page.alias("payload")), "payload", "JobPosting", {"id": "$.identifier", "name": "$.hiringOrganization.name"})
    return found.select(F.col("id").cast("long").alias("id"), "name")


def email_alert_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as alert mails by customer, with links that recur; the first of each id."""
    o = table(spark, sf, "orders")
    line = F.concat(F.lit("["), "o_orderpriority", F.lit("](https://jobs.example.com/view/"), (F.col("o_orderkey") % 500 + 10000).cast("string"), F.lit("?x=1)\n  "), "o_orderstatus", F.lit(" · remote\n"))
    mails = o.groupBy(F.col("o_custkey").alias("mail")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("payload"))
    out = ld.alert_mail(mails)
    return out.select("mail", F.col("id").cast("long").alias("id"), "title", "url", "label")


QUERIES = {f.__name__: f for f in (json_board_scan, xml_block_scan, html_list_scan, json_ld_scan, email_alert_scan)}

SQL = {
    "json_board_scan": """
        SELECT p_brand AS source, 'p' || p_partkey AS id, p_name AS title, p_type AS location, split_part(p_type, ' ', 1) AS tags FROM part""",
    "xml_block_scan": "SELECT c_nationkey AS source, c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment || ' & more' AS kind FROM customer",
    "html_list_scan": r"""
        WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p>', 1)) AS t FROM pages),
        c AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM b),
        d AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '[\s\x{00A0}\x{FEFF}]+', ' ', 'g')) AS t FROM c)
        SELECT page_id, count(*) AS paragraphs, sum(length(t))::BIGINT AS chars FROM (SELECT DISTINCT page_id, t FROM d WHERE t <> '') GROUP BY 1""",
    "json_ld_scan": "SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 4 <> 3",
    "email_alert_scan": """
        SELECT mail, id, title, url, label FROM (SELECT o_custkey AS mail, o_orderkey % 500 + 10000 AS id, o_orderpriority AS title,
            'https://jobs.example.com/view/' || (o_orderkey % 500 + 10000) || '?x=1' AS url, o_orderstatus || ' · remote' AS label,
            row_number() OVER (PARTITION BY o_custkey, o_orderkey % 500 ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1""",
}
