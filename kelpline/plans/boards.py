"""Queries on boards of several makes: their payloads are made of table rows and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.sources import boards as bd
from kelpline.sources.tables import table

NOW = "2000-12-20 00:00:00"


def _pick(values: tuple, n) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def _json(df: DataFrame, by, row, shape: str = "{}") -> DataFrame:
    head, tail = shape.split("{}")
    rows = F.to_json(F.transform(F.array_sort(F.collect_list(row)), lambda r: r.dropFields("o")))
    return df.groupBy(by.alias("source")).agg(F.concat(F.lit(head), rows, F.lit(tail)).alias("payload"))


PLACES = ("Seoul, Korea", "Anywhere", "Berlin", None)


def lever_boards(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as boards with nested categories and lists, kept by where they are open and by each board's own rule."""
    k = F.col("p_partkey")
    row = F.struct(
        k.alias("o"), k.cast("string").alias("id"), F.col("p_name").alias("text"), F.concat(F.lit("https://b.example/"), k.cast("string")).alias("hostedUrl"),
        F.struct(F.col("p_type").alias("team"), _pick(PLACES, k).alias("location"), F.lit("full").alias("commitment"), F.when(k % 3 == 0, F.array(F.lit("Berlin"), F.lit("Oslo"))).alias("allLocations")).alias("categories"),
        F.array(F.struct(F.lit("Needs").alias("text"), F.concat(F.lit("<li>"), "p_brand", F.lit("</li><li>caf&eacute; &#38; more</li>")).alias("content"))).alias("lists"), F.when(k % 2 == 0, "plain").alias("descriptionPlain"),
        F.when(k % 7 == 0, "KR").alias("country"),
    )
    out = bd.lever_board(_json(table(spark, sf, "part"), F.col("p_brand"), row), keep=F.col("team") != "ECONOMY")
    return out.select("source", "id", "title", "location", "details", "open_to")


def ashby_boards(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    row = F.struct(k.alias("o"), k.cast("string").alias("id"), F.col("p_name").alias("title"), (k % 5 != 0).alias("isListed"), (k % 4 == 0).alias("isRemote"), _pick(("Berlin", "Seoul", None), k).alias("location"),
                   F.when(k % 7 == 0, F.array(F.struct(F.lit("Busan, Korea").alias("location")))).alias("secondaryLocations"), F.lit("https://b.example").alias("jobUrl"))
    return bd.ashby_board(_json(table(spark, sf, "part"), F.col("p_brand"), row, '{"jobs":{}}'), "seoul|korea").select("source", "id", "location")


def greenhouse_boards(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    row = F.struct(k.alias("o"), k.alias("id"), F.col("p_name").alias("title"), F.concat(F.lit("&lt;p&gt;About "), "p_brand", F.lit(" &amp;amp; you&lt;/p&gt;")).alias("content"), F.lit("u").alias("absolute_url"),
                   F.struct(F.col("p_type").alias("name")).alias("location"), F.when(k % 3 != 0, F.array(F.struct(F.lit("Kind").alias("name"), F.lit("old").alias("value")), F.struct(F.lit("Kind").alias("name"), F.col("p_type").alias("value")))).alias("metadata"))
    out = bd.greenhouse_board(_json(table(spark, sf, "part"), F.col("p_brand"), row, '{"jobs":{}}'))
    return out.select("id", "location", "text", F.try_element_at("metadata", F.lit("Kind")).alias("kind"))


COUNTRIES, TAGS = ("South Korea", "France", "Spain"), ("Worldwide", "Remote job", "Office")


def taxonomy_boards(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as posts whose terms come in groups of groups."""
    k = F.col("s_suppkey")
    term = lambda kind, name: F.struct(F.lit(kind).alias("taxonomy"), name.alias("name"))
    groups = F.array(F.array(term("country", _pick(COUNTRIES, k)), term("language", F.lit("Korean"))), F.when(k % 2 == 0, F.array(term("country", F.lit(" France")))).otherwise(F.array(term("job_tag", _pick(TAGS, F.expr("s_suppkey div 3"))))))
    text = F.when(k % 5 == 0, "<p>Work from home</p>").otherwise("<p>At the office</p>")
    row = F.struct(k.alias("o"), k.alias("id"), F.lit("l").alias("link"), F.struct(F.col("s_name").alias("rendered")).alias("title"), F.struct(text.alias("rendered")).alias("content"), F.struct(groups.alias("wp:term")).alias("_embedded"))
    t = bd.taxonomy_posts(_json(table(spark, sf, "supplier"), F.col("s_nationkey"), row), ["country", "language", "job_tag"])
    return t.select("id", "title", "text", F.array_join("country", "|").alias("countries"), F.array_join("job_tag", "|").alias("tags"), bd.post_place(F.col("country"), F.col("job_tag"), F.col("text")).alias("place"))


def embedded_boards(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as rows deep in a page's data, at three depths, beside arrays of other things and a broken page."""
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.to_json(F.collect_list(F.struct(k.alias("recruitNo"), F.col("c_name").alias("title")))).alias("rows"))
    way = F.col("c_nationkey") % 3
    body = F.when(way == 0, F.concat(F.lit('{"props":{"pageProps":{"list":'), "rows", F.lit(',"menu":[{"title":"x"}]}}}'))).when(way == 1, F.concat(F.lit('{"a":[[{"b":{"c":'), "rows", F.lit("}}],3]}"))).otherwise(F.concat(F.lit('{"z":'), "rows"))
    landed = rows.select(F.col("c_nationkey").alias("source"), F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), body, F.lit("</script></html>")).alias("payload"))
    return bd.embedded_rows(landed, ["recruitNo", "title"], {"id": "$.recruitNo", "title": "$.title"}).select("source", F.col("id").cast("long").alias("id"), "title")


def query_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of all priorities as slices of one query: the first of each address, with counters of each slice."""
    o = table(spark, sf, "orders").select(F.concat(F.lit("u"), (F.col("o_orderkey") % 900).cast("string")).alias("url"), F.col("o_orderkey").alias("pos"), F.col("o_orderdate").alias("expires"), F.when(F.col("o_orderkey") % 4 != 0, "here").alias("place"), "o_orderpriority")
    slices = [(p, o.where(F.col("o_orderpriority") == p).drop("o_orderpriority")) for p in ("2-HIGH", "1-URGENT", "5-LOW", "4-NOT SPECIFIED", "3-MEDIUM")]
    kept, counters = bd.union_slices(slices, "url", F.lit("1998-01-01 00:00:00"))
    own = kept.groupBy("slice").agg(F.sum("pos").alias("rows"))
    return counters.join(own, "slice", "left")


def paged_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as pages of lists by supplier: up to the first short page, the last row of each key."""
    t = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_orderkey") % 9).alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), (F.col("l_partkey") % 40).alias("key"), F.col("l_quantity").alias("quantity"))
    t = t.groupBy("source", "page", "pos", "key").agg(F.sum("quantity").alias("quantity"))
    return bd.paged_rows(t, "source", "key", 60).select("source", "key", "page", "pos", "quantity")


REGIONS = ("전북>전주시 덕진구", "전북>완주군", "전북>군산시", "전북>전주시 | 전북>완주군")


def dated_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers' nations as feeds, some stale or of another kind, with deadlines that name a weekday and no year."""
    k = F.col("s_suppkey")
    posted = F.date_format(F.expr("timestamp'2000-12-10 03:00:00' + make_dt_interval(int(s_suppkey % 9))"), "EEE, dd MMM yyyy HH:mm:ss")
    days = F.date_add(F.lit("2000-12-22").cast("date"), (k % 30).cast("int"))
    weekday = F.substr(F.lit(bd.WEEKDAYS), F.dayofweek(F.date_add(days, F.when(k % 4 == 0, 1).otherwise(0))), F.lit(1))
    label = F.when(k % 6 == 0, "상시").when(k % 6 == 1, "미정").otherwise(F.concat(F.month(days).cast("string"), F.lit("/"), F.day(days).cast("string"), F.lit("("), weekday, F.lit(")")))
    item = F.concat(
        F.lit("<item><title>[x] "), "s_name", F.when(k % 13 == 0, " 재택").otherwise(""), F.lit("</title><link>https://job.incruit.com/jobdb_info/jobpost.asp?job="), (k % 50).cast("string"), F.lit("</link><author>Co "), k.cast("string"),
        F.lit("</author><pubDate>"), posted, F.lit(" +0000</pubDate><description><![CDATA[▨ 지역 : "), _pick(REGIONS, F.expr("s_suppkey div 2")), F.lit("<br>▨ 마감일 : "), label, F.lit("<br>]]></description></item>"),
    )
    n = F.col("s_nationkey")
    items = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", item.alias("x")))), lambda r: r["x"]), "\n").alias("items"))
    built = F.when(n % 7 == 0, "Fri, 01 Dec 2000 00:00:00 +0000").otherwise("Tue, 19 Dec 2000 03:00:00 +0000")
    title = F.when(n % 11 == 3, "other").otherwise("[인크루트] 채용정보 - 전북")
    payload = F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>'), title, F.lit("</title><lastBuildDate>"), built, F.lit("</lastBuildDate>"), "items", F.lit("</channel></rss>"))
    return bd.regional_feed(items.select(n.alias("source"), payload.alias("payload")), F.lit(NOW), most=3).select("source", "id", "title", "place", "deadline_type", F.date_format("deadline", "yyyy-MM-dd").alias("deadline"))


def detail_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as detail pages in three layers of which some are empty: evidence, and typed rejections."""
    k = F.col("p_partkey")
    layer = lambda when, name: F.when(when, F.struct(F.concat(F.lit(name), F.col("p_name")).alias("title"), F.col("p_type").alias("address"))).alias(name)
    t = table(spark, sf, "part").select("p_partkey", "p_brand", layer(k % 3 == 0, "json"), layer(k % 4 == 0, "html"), layer(k % 5 != 1, "hint"), F.when(k % 8 != 0, k).otherwise(k + 1).alias("page_id"))
    checks = [("posting_id_mismatch", F.col("page_id") != F.col("p_partkey")), ("workplace_mismatch", (F.col("posting.address") == "PROMO") & (F.col("p_brand") == "Brand#2"))]
    rows, rejected = bd.detail_rows(t, [("json_ld", "json"), ("legacy_html", "html"), ("list_hint", "hint")], checks)
    kept = rows.groupBy(F.col("evidence").alias("what")).agg(F.count("*").alias("n"), F.sum(F.length("posting.title")).cast("long").alias("size"))
    return kept.unionByName(rejected.groupBy(F.col("reject").alias("what")).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("size")))


def search_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Events as search results of one candidate: of each field the last that is not empty."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", F.when(F.col("event_id") % 3 == 0, F.get_json_object("props", "$.k")).otherwise("").alias("k"), F.when(F.col("event_type") == "purchase", F.col("value").cast("string")).alias("pay"))
    return bd.merged_candidates(e, "user_id", ["ts", "event_id"], ["event_type", "k", "pay"])


def listed_with_details(spark: SparkSession, sf: str) -> DataFrame:
    """Customers listed, some with details, others filled from a previous snapshot of the same area."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("area"), F.col("c_mktsegment").alias("title"), F.col("c_acctbal").alias("pay"))
    previous = c.where("id % 2 = 0").select("id", F.when(F.col("id") % 10 == 0, F.col("area") + 1).otherwise(F.col("area")).alias("area"), F.concat(F.lit("a"), "title").alias("address"), F.col("pay") + 1)
    previous = previous.toDF("id", "area", "address", "pay")
    listed = c.withColumn("pay", F.when(F.col("id") % 4 == 0, F.col("pay")))
    return bd.with_list_fallback(c.where("id % 3 = 0").withColumn("address", F.lit("d")), listed, previous).select("id", "area", "title", "pay", "address", "evidence")


def curated_board(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as hand-made rows, each with some flaw or none: ids of the good ones, and why others are not."""
    k = F.col("o_orderkey")
    t = table(spark, sf, "orders").select(
        F.when(k % 17 == 0, "http://x.example").otherwise(F.concat(F.lit("https://x.example/"), k.cast("string"))).alias("url"), F.when(k % 19 != 0, "t").otherwise(" ").alias("title"), F.lit("c").alias("company"),
        F.lit("s").alias("summary"), _pick(("a", "b", "z"), k).alias("source"), _pick(("remote", "onsite", "hybrid", None), F.expr("o_orderkey div 3")).alias("workplace"), F.col("o_orderdate").alias("reviewed_at"),
        _pick(("listed", "unconfirmed", "closed"), F.expr("o_orderkey div 5")).alias("opening"), F.when(k % 2 == 0, F.date_add(F.to_date("o_orderdate"), 20)).alias("deadline"), (k % 23 == 0).alias("withdrawn"),
    )
    good, bad = bd.curated_rows(t, F.lit(NOW), ["a", "b"], days=400)
    return good.select(F.col("id").alias("what"), F.lit(1).cast("long").alias("n")).unionByName(bad.groupBy(F.col("reject").alias("what")).agg(F.count("*").alias("n")))


def tour_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as entries of calendars: those not over, with their price and audience."""
    k = F.col("p_partkey")
    day = F.date_format(F.date_add(F.lit("2000-12-01").cast("date"), (k % 40).cast("int")), "yyyy-MM-dd")
    li = F.concat(F.lit('<li class="swiper-slide pcal_item" data-start="2000-11-01" data-end="'), F.when(k % 9 == 0, "").otherwise(day), F.lit('"><a href="/t/'), (k % 700).cast("string"), F.lit('"></a><strong class="pcal_tit">'), "p_name", F.lit('</strong><span class="pcal_place">'), "p_brand", F.lit("</span></li>"))
    landed = table(spark, sf, "part").groupBy(F.col("p_brand").alias("source")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", li.alias("x")))), lambda r: r["x"]), "\n").alias("payload"))
    t = bd.tour_list(landed, F.lit(NOW))
    n = F.split_part("href", F.lit("/"), F.lit(3)).cast("int")
    text = F.concat(_pick(("참가비 5,000원 ", "", "입장료 3천원 "), n), _pick(("어린이", "성인", "어린이와 성인", "가족", "누구나", ""), n))
    return t.select("source", "href", "title", F.date_format("end_date", "yyyy-MM-dd").alias("end_date"), bd.tour_price(_pick(("무료", "", None, "10"), n), n % 11 == 0, text).alias("price"), bd.tour_audience(text).alias("audience"))


#: price, free mark, stated status, title, text; then price status, audience, whether adults can join.
TOURS = (
    ("무료 (재료비 5,000원)", None, None, "숲 산책", "참여 대상: 누구나", "unknown", "anyone", True), ("유료", None, None, "도자기", "대상 성인 20명", "paid", "adults", True), ("무료", None, None, "어린이 놀이터", "", "free", "children", False),
    ("1만 원", None, "paid", "가족 캠프", None, "paid", "families", True), ("1만 원", None, "free", "초등 교실", "교육 대상: 초등 3학년 이상", "unknown", "school_age_and_over", False), ("", True, None, "강연", "대상: 청소년 문의 성인", "free", "students", False),
    ("", True, "paid", "강연", "안내 없음", "unknown", "not_stated", True), ("가격 변동", None, "paid", "음악회", "참가 대상 : 기관 신청", "unknown", "groups", False), ("₩3,000", None, None, "유아 동반 체험", "", "paid", "with_children", False),
    (None, None, None, "축제", "모집 대상: 관광객", "unknown", "anyone", True), ("없음", None, "paid", "걷기", "일시: 5월", "paid", "not_stated", True), ("무료입장", None, None, "전시", "대상 제한 없음", "unknown", "anyone", True),
)


def tour_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as entries of a calendar: what they cost, whom they are for, whether adults can join."""
    k = F.col("c_custkey")
    price, mark, stated, title, text = (_pick(tuple(t[n] for t in TOURS), k) for n in range(5))
    kind = bd.audience_class(title, text)
    return table(spark, sf, "customer").select("c_custkey", bd.price_status(price.cast("string"), mark.cast("boolean"), stated.cast("string")).alias("price"), kind.alias("audience"), bd.adults_can_join(kind, title).alias("adults"))


QUERIES = {f.__name__: f for f in (
    lever_boards, ashby_boards, greenhouse_boards, taxonomy_boards, embedded_boards, query_slices, paged_lists, dated_feed, detail_chain, search_merge, listed_with_details, curated_board, tour_calendar, tour_decisions,
)}

SQL = {
    "lever_boards": """
        WITH p AS (SELECT *, ['Seoul, Korea', 'Anywhere', 'Berlin', NULL][p_partkey % 4 + 1] AS l FROM part WHERE p_type <> 'ECONOMY'),
        q AS (SELECT *, list_filter(list_concat([l], CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN l = 'Berlin' THEN ['Oslo'] ELSE ['Berlin', 'Oslo'] END ELSE [] END), lambda x: x IS NOT NULL) AS places FROM p),
        r AS (SELECT *, CASE WHEN l = 'Seoul, Korea' OR p_partkey % 7 = 0 THEN 'korea' WHEN l = 'Anywhere' THEN 'worldwide' WHEN len(places) = 0 THEN 'unknown' ELSE 'elsewhere' END AS open_to FROM q)
        SELECT p_brand AS source, p_partkey::VARCHAR AS id, p_name AS title, array_to_string(places, ' / ') AS location,
            CASE WHEN p_partkey % 2 = 0 THEN 'plain' || chr(10) ELSE '' END || 'Needs: ' || p_brand || ' café & more' AS details, open_to FROM r WHERE open_to <> 'elsewhere'""",
    "ashby_boards": """
        WITH p AS (SELECT *, ['Berlin', 'Seoul', NULL][p_partkey % 3 + 1] AS l, p_partkey % 7 = 0 AS s FROM part WHERE p_partkey % 5 <> 0)
        SELECT p_brand AS source, p_partkey::VARCHAR AS id, CASE WHEN l = 'Seoul' THEN CASE WHEN s THEN 'Seoul + 1' ELSE 'Seoul' END WHEN s THEN 'Busan, Korea' || CASE WHEN l IS NOT NULL THEN ' + 1' ELSE '' END ELSE 'Remote' END AS location
        FROM p WHERE l = 'Seoul' OR s OR p_partkey % 4 = 0""",
    "greenhouse_boards": "SELECT p_partkey AS id, p_type AS location, 'About ' || p_brand || ' & you' AS text, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS kind FROM part",
    "taxonomy_boards": """
        WITH s AS (SELECT s_suppkey AS id, s_name AS title, CASE WHEN s_suppkey % 5 = 0 THEN 'Work from home' ELSE 'At the office' END AS text, ['South Korea', 'France', 'Spain'][s_suppkey % 3 + 1] AS c,
            CASE WHEN s_suppkey % 2 = 1 THEN ['Worldwide', 'Remote job', 'Office'][(s_suppkey // 3) % 3 + 1] END AS t, s_suppkey % 2 = 0 AS two FROM supplier)
        SELECT id, title, text, c || CASE WHEN two THEN '|France' ELSE '' END AS countries, coalesce(t, '') AS tags, CASE WHEN t = 'Worldwide' THEN 'Worldwide' WHEN c = 'South Korea' AND two THEN 'South Korea + 1'
            WHEN c = 'South Korea' THEN 'South Korea' ELSE c || CASE WHEN two THEN ' / France' ELSE '' END END AS place FROM s""",
    "embedded_boards": "SELECT c_nationkey AS source, c_custkey AS id, c_name AS title FROM customer WHERE c_nationkey % 3 <> 2",
    "query_slices": """
        WITH o AS (SELECT 'u' || o_orderkey % 900 AS url, o_orderkey AS pos, o_orderdate < TIMESTAMP '1998-01-01' AS expired, o_orderkey % 4 <> 0 AS placed, o_orderpriority AS slice,
            list_position(['2-HIGH', '1-URGENT', '5-LOW', '4-NOT SPECIFIED', '3-MEDIUM'], o_orderpriority) AS s FROM orders),
        k AS (SELECT slice, pos FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY s, pos) AS r FROM o WHERE NOT expired AND placed) WHERE r = 1)
        SELECT slice, count(*) AS read, count(*) FILTER (expired) AS expired, (SELECT count(*) FROM k WHERE k.slice = o.slice) AS kept, (SELECT sum(pos)::BIGINT FROM k WHERE k.slice = o.slice) AS rows FROM o GROUP BY slice""",
    "paged_lists": """
        WITH t AS (SELECT l_suppkey AS source, l_orderkey % 9 AS page, l_orderkey * 10 + l_linenumber AS pos, l_partkey % 40 AS key, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2, 3, 4),
        n AS (SELECT source, page, count(*) AS n FROM t GROUP BY 1, 2), s AS (SELECT source, min(page) AS stop FROM n WHERE n < 60 GROUP BY 1),
        r AS (SELECT t.*, row_number() OVER (PARTITION BY source, key ORDER BY page DESC, pos DESC) AS r FROM t LEFT JOIN s USING (source) WHERE stop IS NULL OR page <= stop)
        SELECT source, key, page, pos, quantity FROM r WHERE r = 1""",
    "dated_feed": """
        WITH s AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r, DATE '2000-12-22' + (s_suppkey % 30)::INT AS d, (s_suppkey // 2) % 4 AS g FROM supplier),
        t AS (SELECT *, CASE WHEN s_suppkey % 6 = 0 THEN 'rolling' WHEN s_suppkey % 6 = 1 OR s_suppkey % 4 = 0 THEN 'unknown' ELSE 'fixed' END AS kind FROM s
              WHERE r <= 3 AND g < 2 AND s_suppkey % 13 <> 0 AND s_nationkey % 7 <> 0 AND s_nationkey % 11 <> 3)
        SELECT s_nationkey AS source, (s_suppkey % 50)::VARCHAR AS id, s_name AS title, CASE g WHEN 0 THEN '전주시 덕진구' ELSE '완주군' END AS place, kind AS deadline_type, CASE WHEN kind = 'fixed' THEN strftime(d, '%Y-%m-%d') END AS deadline
        FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 50 ORDER BY s_suppkey) AS q FROM t) WHERE q = 1""",
    "detail_chain": """
        WITH p AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 'json_ld' WHEN p_partkey % 4 = 0 THEN 'legacy_html' WHEN p_partkey % 5 <> 1 THEN 'list_hint' END AS e FROM part),
        q AS (SELECT *, CASE WHEN e IS NULL THEN 'detail_structure' WHEN p_partkey % 8 = 0 THEN 'posting_id_mismatch' WHEN p_type = 'PROMO' AND p_brand = 'Brand#2' THEN 'workplace_mismatch' END AS reject FROM p)
        SELECT coalesce(reject, e) AS what, count(*) AS n, sum(CASE WHEN reject IS NULL THEN 4 + length(p_name) ELSE 0 END)::BIGINT AS size FROM q GROUP BY 1""",
    "search_merge": """
        SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(props->>'$.k', (ts, event_id)) FILTER (event_id % 3 = 0 AND props->>'$.k' <> '') AS k,
            arg_max(value::VARCHAR, (ts, event_id)) FILTER (event_type = 'purchase' AND value IS NOT NULL) AS pay FROM events GROUP BY 1""",
    "listed_with_details": """
        SELECT c_custkey AS id, c_nationkey AS area, c_mktsegment AS title, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 4 = 0 THEN c_acctbal ELSE c_acctbal + 1 END AS pay,
            CASE WHEN c_custkey % 3 = 0 THEN 'd' ELSE 'a' || c_mktsegment END AS address, CASE WHEN c_custkey % 3 = 0 THEN 'detail' ELSE 'list_cached_detail' END AS evidence
        FROM customer WHERE c_custkey % 3 = 0 OR (c_custkey % 2 = 0 AND c_custkey % 10 <> 0)""",
    "curated_board": f"""
        WITH o AS (SELECT o_orderkey AS k, o_orderdate AS d, epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(o_orderdate) AS age FROM orders),
        r AS (SELECT k, CASE WHEN k % 23 = 0 THEN 'withdrawn' WHEN k % 3 = 2 THEN 'source' WHEN k % 17 = 0 THEN 'url' WHEN k % 19 = 0 THEN 'fields' WHEN (k // 3) % 4 = 3 THEN 'workplace'
            WHEN age < -300000 OR age > 400 * 86400000::BIGINT THEN 'review' WHEN (k // 5) % 3 = 2 THEN 'opening' WHEN k % 2 = 0 AND d::DATE + 20 < DATE '2000-12-20' THEN 'deadline' END AS reject FROM o)
        SELECT coalesce(reject, 'curated:' || sha256('https://x.example/' || k)[1:20]) AS what, count(*) AS n FROM r GROUP BY 1""",
    "tour_calendar": """
        WITH p AS (SELECT *, p_partkey % 700 AS n, row_number() OVER (PARTITION BY p_brand, p_partkey % 700 ORDER BY p_partkey) AS r, CASE WHEN p_partkey % 9 <> 0 THEN DATE '2000-12-01' + (p_partkey % 40)::INT END AS e FROM part),
        t AS (SELECT *, n % 3 <> 1 AS paid, n % 11 = 0 OR n % 4 = 0 AS free FROM p WHERE r = 1 AND e >= DATE '2000-12-20')
        SELECT p_brand AS source, '/t/' || n AS href, p_name AS title, strftime(e, '%Y-%m-%d') AS end_date, CASE WHEN paid AND free THEN 'unknown' WHEN paid THEN 'paid' WHEN free THEN 'free' WHEN n % 4 = 3 THEN 'paid' ELSE 'unknown' END AS price,
            ['child', 'adult', 'unknown', 'family', 'anyone', 'unknown'][n % 6 + 1] AS audience FROM t""",
    "tour_decisions": "SELECT c_custkey, " + ", ".join(
        f"([{', '.join(repr(t[n]) if isinstance(t[n], str) else str(t[n]).lower() for t in TOURS)}])[c_custkey % {len(TOURS)} + 1] AS {name}" for n, name in ((5, "price"), (6, "audience"), (7, "adults"))
    ) + " FROM customer",
}
