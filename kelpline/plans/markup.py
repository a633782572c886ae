"""Queries on tables of pages: order lines and customers as HTML, with nested tables and tags that are left open, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.sources import markup
from kelpline.sources.tables import spread, table


def _end(tag: str, closed):
    return F.when(closed, F.lit(f"</{tag}>")).otherwise(F.lit(""))


def order_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page for each order: its lines as rows, the price over two columns, the flags in a table within a cell; odd orders close no cell."""
    closed = F.col("l_orderkey") % 2 == 0
    td = lambda c, attributes="": F.concat(F.lit(f"<td{attributes}>"), c, _end("td", closed))
    inner = F.concat(F.lit("<TABLE><tr><th>flag"), _end("th", closed), td(F.col("l_returnflag")), F.lit("<tr><td>status"), td(F.col("l_linestatus")), F.lit("</table>"))
    line = F.concat(
        F.lit('<tr class="line">'), td(F.concat(F.lit("<a href='/part/"), F.col("l_partkey").cast("string"), F.lit("'>"), F.col("l_linenumber").cast("string"), F.lit("</a>"))), td(F.to_date("l_shipdate").cast("string"), ' colspan="2"'),
        td(F.concat(F.lit("see "), inner, F.lit(" &amp; more"))), td(F.col("l_quantity").cast("int").cast("string")), F.when(closed, F.lit("</tr>\n")).otherwise(F.lit("\n")),
    )
    lines = spread(table(spark, sf, "lineitem"), "l_orderkey").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", line.alias("h")))), lambda x: x["h"]), "").alias("body"))
    head = "<html><script>if (a<b) document.write('<table><tr><td>no')</script><p>Lines</p></table><table border=1><tr><th>No.<th colspan=2>Ship date</th><th>Flags<th>Quantity"
    return lines.select("l_orderkey", F.concat(F.lit(head), "body", F.lit("</table><!-- <table><tr><td>gone --> the end")).alias("html"))


def html_table_cells(spark: SparkSession, sf: str) -> DataFrame:
    return markup.table_cells(order_pages(spark, sf), "l_orderkey", "html")


def html_listed_rows(spark: SparkSession, sf: str) -> DataFrame:
    fields = {"line": ["no"], "shipped": ["Ship date"], "quantity": ["quantity", "amount"]}
    return markup.listed_rows(order_pages(spark, sf), "l_orderkey", "html", fields).select("l_orderkey", "row", "line", "shipped", "quantity", "link")


def html_labelled_values(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as detail pages: labels beside values, in two orders, some values missing, a label without a value."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    row = lambda label, value: F.concat(F.lit(f"<tr><th>{label}: <td>"), value)
    name, phone = row("Name", F.col("c_name")), F.when(k % 3 > 0, row("Tel", F.concat(F.lit("<b>"), k.cast("string"), F.lit("</b>")))).otherwise(F.lit("<tr><th>Tel<td>"))
    segment = F.concat(F.lit("<tr><td>segment</td><td>Name</td></tr><tr><td><table><tr><td>Segment<td>"), F.col("c_mktsegment"), F.lit("</table>"))
    page = F.concat(F.lit("<table>"), F.when(k % 2 == 0, F.concat(name, phone, segment)).otherwise(F.concat(segment, phone, name)), F.lit("<tr><td>Name<td>again</table>"))
    cells = markup.table_cells(c.select("c_custkey", page.alias("html")), "c_custkey", "html")
    return markup.labelled_values(cells, "c_custkey", {"name": ["name"], "phone": ["tel", "phone"], "segment": ["Segment"], "fax": ["fax"]})


def page_headings(spark: SparkSession, sf: str) -> DataFrame:
    """The pages, their paragraphs set as the cells of a table that nothing closes: what is read is what they show."""
    t = table(spark, sf, "pages").select("page_id", F.concat(F.lit("<table>"), F.regexp_replace("html", r"(?i)<(p|h1)\b[^>]*>", "<tr><td>")).alias("html"))
    return markup.table_cells(t, "page_id", "html").groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


QUERIES = {f.__name__: f for f in (html_table_cells, html_listed_rows, html_labelled_values, page_headings)}

_LINES = """l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k, l_quantity::INT AS q FROM lineitem)"""
SQL = {
    "html_table_cells": f"""
        WITH {_LINES}, o AS (SELECT DISTINCT l_orderkey FROM lineitem),
        c AS (
            SELECT l_orderkey, 1 AS "table", NULL::INT AS parent, 1 AS "row", col, true AS head, text, NULL AS link FROM o, (VALUES (1, 'No.'), (2, 'Ship date'), (4, 'Flags'), (5, 'Quantity')) AS v(col, text)
            UNION ALL SELECT l_orderkey, 1, NULL, k + 1, 1, false, l_linenumber::VARCHAR, '/part/' || l_partkey FROM l
            UNION ALL SELECT l_orderkey, 1, NULL, k + 1, 2, false, l_shipdate::DATE::VARCHAR, NULL FROM l
            UNION ALL SELECT l_orderkey, 1, NULL, k + 1, 4, false, 'see & more', NULL FROM l
            UNION ALL SELECT l_orderkey, 1, NULL, k + 1, 5, false, q::VARCHAR, NULL FROM l
            UNION ALL SELECT l_orderkey, k + 1, 1, 1, 1, true, 'flag', NULL FROM l
            UNION ALL SELECT l_orderkey, k + 1, 1, 1, 2, false, l_returnflag, NULL FROM l
            UNION ALL SELECT l_orderkey, k + 1, 1, 2, 1, false, 'status', NULL FROM l
            UNION ALL SELECT l_orderkey, k + 1, 1, 2, 2, false, l_linestatus, NULL FROM l
        ) SELECT l_orderkey, "table"::INT AS "table", parent, "row"::INT AS "row", col, head, text, link FROM c""",
    "html_listed_rows": f"""
        WITH {_LINES} SELECT l_orderkey, (k + 1)::INT AS "row", l_linenumber::VARCHAR AS line, l_shipdate::DATE::VARCHAR AS shipped, q::VARCHAR AS quantity, '/part/' || l_partkey AS link FROM l""",
    "html_labelled_values": """
        SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 3 > 0 THEN c_custkey::VARCHAR END AS phone, c_mktsegment AS segment, NULL::VARCHAR AS fax FROM customer""",
}
