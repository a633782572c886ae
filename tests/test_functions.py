from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kelpline.functions import text as tx
from kelpline.functions import values as vl
from kelpline.operators import evidence
from kelpline.sources import landed, markup


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Pay USD 80-100k per year", ("USD", 80000.0, 100000.0, "year", "parsed")),
        ("$25 - $35 / hour", ("USD", 25.0, 35.0, "hour", "parsed")),
        ("€1,250.50 per month", ("EUR", 1250.5, 1250.5, "month", "parsed")),
        ("£90k to 80k", ("GBP", 90000.0, 80000.0, None, "suspicious")),
        ("good pay", (None, None, None, None, "none")),
        ("", (None, None, None, None, "none")),
    ],
)
def test_money_range(spark, raw, want):
    assert tuple(one(spark, raw, vl.money_range("x"))) == want


@pytest.mark.parametrize(("raw", "want"), [("35k", 35000.0), ("35,3k", 35300.0), ("1.5m", 1500000.0), ("1,250", 1250.0), ("x", None), (None, None)])
def test_parse_amount(spark, raw, want):
    assert one(spark, raw, vl.parse_amount("x")) == want


def test_html_to_text(spark):
    page = "<p>A&nbsp;&amp;lt; <b>b</b></p><script>x<1</script><!-- c --><style>p{}</style> d"
    assert one(spark, page, tx.html_to_text("x")) == "A &lt; b d"
    assert one(spark, "&eacute;&#233;&#xE9;", tx.html_unescape("x")) == "ééé"
    assert one(spark, "a &lt;b&gt;bold&lt;/b&gt; if x &lt; y &gt; z &amp;#65; &eacute;", tx.html_to_text("x")) == "a bold if x < y > z &#65; é"
    assert one(spark, "<title>Caf&#233;: Cr&eacute;ateur &amp;amp; co</title>", landed.tag(F.col("x"), "title")) == "Café: Créateur &amp; co"


def test_repairs(spark):
    assert one(spark, "é".encode().decode("latin-1"), tx.repair_mojibake("x")) == "é"
    assert one(spark, "né", tx.repair_mojibake("x")) == "né"
    assert one(spark, "ＡＢ①", tx.nfkc("x")) == "AB1"
    raw = spark.createDataFrame([(bytearray("한글".encode("euc-kr")),)], "x binary")
    assert raw.select(tx.decode_euc_kr("x").alias("y")).first().y == "한글"


def test_urls(spark):
    assert one(spark, "HTTPS://Example.com/Jobs/?utm_source=x&id=7#top", tx.url_canonical("x", ["id"])) == "https://example.com/jobs?id=7"
    assert one(spark, " Not A Url ", tx.url_canonical("x")) == "not a url"
    assert one(spark, "https://a.example.com/x?utm_source=q&b=1#f", tx.safe_public_url("x")) == "https://a.example.com/x?b=1"
    for bad in ("http://a.example.com", "https://127.0.0.1/x", "https://user:pw@a.example.com/", "https://localhost/x", None):
        assert one(spark, bad, tx.safe_public_url("x")) is None


def test_phrases_and_clauses(spark):
    assert one(spark, "Senior Data  Engineer", tx.has_phrase("x", "data engineer")) is True
    assert one(spark, "metadata engineer", tx.has_phrase("x", "data engineer")) is False
    veto = "(not required|preferred)"
    assert one(spark, "Degree required. German preferred", tx.clause_requires("x", "german", veto)) is False
    assert one(spark, "German required; degree preferred", tx.clause_requires("x", "german", veto)) is True


def test_times(spark):
    assert str(one(spark, "3.7.2026", vl.date_from("x"))) == "2026-07-03"
    assert one(spark, "31.31.2026", vl.date_from("x")) is None
    assert one(spark, "1700000000", vl.epoch_time("x")) == one(spark, "1700000000000", vl.epoch_time("x"))
    end = one(spark, "2026-07-03", F.date_format(vl.closes_at(F.col("x").cast("date"), "Asia/Seoul"), "yyyy-MM-dd HH:mm:ss"))
    assert end == "2026-07-03 14:59:59"
    km = one(spark, "", vl.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    assert abs(km - 111.195) < 0.001
    assert [one(spark, str(a), vl.freshness(F.col("x").cast("int"), 40)) for a in (30, 31, 40, 41)] == ["fresh", "aging", "aging", "expired"]


def test_names_with_contexts(spark):
    names = {"German": "de", "High German": "de", "Greek": "el", "Sign language": "sl"}
    got = one(spark, "Greek; we need HIGH german, not germanic, or sign\n language", evidence.named_mentions("x", names, 6, 4))
    assert [tuple(m) for m in got] == [("el", "greek", "", "; we"), ("de", "high german", " need ", ", no"), ("sl", "sign language", "c, or ", "")]
    assert one(spark, None, evidence.named_mentions("x", names)) == [] and one(spark, "german " * 3, F.size(evidence.named_mentions("x", names))) == 3
    pattern = evidence.trie_pattern([f"name {k}" for k in range(60)])
    assert one(spark, "name 5, name 59, name 600", F.regexp_extract_all("x", F.lit(pattern), F.lit(0))) == ["name 5", "name 59"]


def test_pages_without_tables_and_broken_ones(spark):
    pages = [(1, None), (2, ""), (3, "<p>no table</p></table><td>outside"), (4, "<table><td>a<td>b<tr><td>c"), (5, "<table><tr><td>x<table><tr><td>y</td>z</table>w</td>v</tr></table>u")]
    cells = markup.table_cells(spark.createDataFrame(pages, "id int, html string"), "id", "html")
    got = sorted((r.id, r.table, r.parent or 0, r.row, r.col, r.text) for r in cells.collect())
    assert got == [(4, 1, 0, 0, 1, "a"), (4, 1, 0, 0, 2, "b"), (4, 1, 0, 1, 1, "c"), (5, 1, 0, 1, 1, "x w"), (5, 2, 1, 1, 1, "y")]


def test_pages_are_taken_apart_in_place(spark):
    pages = spark.createDataFrame([(1, "<table><tr><th>No<th colspan=2>Name<tr><td>7<td><a href='/n'>A</a>")], "id int, html string")
    listed = markup.listed_rows(pages, "id", "html", {"no": ["no"], "name": ["name"], "other": ["x"]})
    assert [tuple(r) for r in listed.collect()] == [(1, 1, 2, "7", "A", None, "/n")]
    for frame in (markup.table_cells(pages, "id", "html"), listed):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not any(step in plan for step in ("Exchange", "Sort", "Window", "Join", "Aggregate"))


def test_marks_nesting_and_spans_of_pages(spark):
    deep = "<table><tr><td>" * 300 + "x" + "</table>y" * 300
    pages = [(1, deep), (2, "<table><tr><td title='<tr>'>\ufdd0a<td>\ufdd1a\ufdd1<td <b"), (3, "<table>no<td colspan=0>a<td colspan='3'>b</td>c<td>d</table></table><table><th>e"), (4, "<table><tr></tr><tr><td>a<table></table><tr><td>b")]
    cells = markup.table_cells(spark.createDataFrame(pages, "id int, html string"), "id", "html")
    got = {}
    for r in cells.orderBy("id", "table", "row", "col").collect():
        got.setdefault(r.id, []).append((r.table, r.parent, r.row, r.col, r["head"], r.text))
    assert got[1] == [(k, k - 1 or None, 1, 1, False, "x" if k == 300 else "y") for k in range(1, 301)]
    assert got[2] == [(1, None, 1, 1, False, "'>\ufdd0a"), (1, None, 1, 2, False, "\ufdd1a\ufdd1")]
    assert got[3] == [(1, None, 0, 1, False, "a"), (1, None, 0, 2, False, "b"), (1, None, 0, 5, False, "d"), (2, None, 0, 1, True, "e")]
    assert got[4] == [(1, None, 2, 1, False, "a"), (1, None, 3, 1, False, "b")]
