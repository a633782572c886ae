"""Queries on gates and labels of listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.operators import gates as gt
from kelpline.operators import state as st
from kelpline.sources.tables import table


def _pick(values: tuple, n) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def _sql_pick(values: tuple, n: str) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][({n}) % {len(values)} + 1]"


ELIGIBILITY, STATUS, FIT, BASIS, NEEDS = ("korea", "worldwide", "unknown", "restricted", None), ("open", "stale", "current_feed", None), ("pass", "fail", "check", None), ("public_institution", "text", None), ("clear", "hard_check", None)


def _postings(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey", (k % 101).cast("int").alias("score"), _pick(ELIGIBILITY, k).alias("eligibility"), _pick(STATUS, F.expr("o_orderkey div 5")).alias("status"),
        _pick(FIT, F.expr("o_orderkey div 7")).alias("fit"), _pick(BASIS, F.expr("o_orderkey div 3")).alias("role_basis"), _pick(NEEDS, F.expr("o_orderkey div 11")).alias("requirements"),
        F.when(k % 13 != 0, k % 3 != 0).alias("role_evidence"), F.when(k % 2 == 0, F.array(F.lit("word"))).otherwise(F.array().cast("array<string>")).alias("keywords"),
        _pick(("other", "support", ""), F.expr("o_orderkey div 2")).alias("category"), F.when(k % 17 != 0, k % 19 != 0).alias("eligible"),
    )


_POSTINGS = f"""p AS (SELECT o_orderkey, o_orderkey % 101 AS score, {_sql_pick(ELIGIBILITY, "o_orderkey")} AS eligibility, {_sql_pick(STATUS, "o_orderkey // 5")} AS status,
    {_sql_pick(FIT, "o_orderkey // 7")} AS fit, {_sql_pick(BASIS, "o_orderkey // 3")} AS role_basis, {_sql_pick(NEEDS, "o_orderkey // 11")} AS requirements,
    CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 3 <> 0 END AS role_evidence, o_orderkey % 2 = 0 AS word, {_sql_pick(("other", "support", ""), "o_orderkey // 2")} AS category,
    CASE WHEN o_orderkey % 17 <> 0 THEN o_orderkey % 19 <> 0 END AS eligible FROM orders)"""


def recommendation_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as postings in which every input varies: recommended under three policies."""
    t = _postings(spark, sf)
    return t.groupBy(*[gt.recommended(v).alias(f"policy_{v}") for v in (2, 3, 5)]).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("ids"))


def source_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Postings with the metrics of their source, which some sources lack, and the reasons of the gate."""
    k = F.col("o_orderkey")
    t = _postings(spark, sf).drop("eligible").withColumns({"source": F.concat(F.lit("s"), (k % 7).cast("string")), "official": k % 4 == 0, "list_state": _pick(("public_rss", "detail", None), F.expr("o_orderkey div 29"))})
    metrics = spark.createDataFrame([("s0", "weak", "observed", 0.7), ("s1", "mixed", "degraded", 0.4), ("s2", "strong", "reliable", 1.0), ("s3", "mixed", "unstable", 0.6)], "source string, tier string, state string, success_rate double")
    return gt.with_source_metrics(t, metrics).groupBy("source_gate", "role_gate", "tier", "state", "eligible").agg(F.count("*").alias("n"))


def review_candidates(spark: SparkSession, sf: str) -> DataFrame:
    t = _postings(spark, sf)
    k = F.col("o_orderkey")
    t = t.withColumns({"collected": _pick(("seen", "older", None), k), "manual": F.when(k % 4 != 0, k % 5 == 0), "language_fit": _pick(("match", "mismatch", None), F.expr("o_orderkey div 6"))})
    return t.where(gt.review_candidate()).select("o_orderkey")


def course_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as courses: how many each level and mode takes; hybrid counts for both."""
    t = table(spark, sf, "part").select(_pick(("beginner", "elementary", "intermediate", "advanced", "all levels", "beginner to advanced", "for teachers"), F.col("p_partkey")).alias("level"), _pick(("online", "offline", "hybrid"), F.expr("p_partkey div 7")).alias("mode"))
    asked = [(lv, m) for lv in ("", "beginner", "elementary", "advanced", "teachers") for m in ("", "online", "offline", "hybrid")]
    hits = F.array(*[F.when(gt.level_matches(F.col("level"), lv) & gt.mode_matches(F.col("mode"), m), F.struct(F.lit(lv).alias("asked_level"), F.lit(m).alias("asked_mode"))) for lv, m in asked])
    return t.select(F.explode(F.array_compact(hits)).alias("h")).select("h.*").groupBy("asked_level", "asked_mode").agg(F.count("*").alias("n"))


def unconfigured_source(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without those of a source, as their own or merged into them."""
    merged = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("src1"), F.lit("src9"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("src9")))
    return gt.without_source(table(spark, sf, "documents").withColumn("sources", merged), "src1").groupBy("source").agg(F.count("*").alias("n"))


DOMAINS = {"example.com": "Example", "example.org": "Other"}


def host_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Pages by the source that their host names, with stated sources and addresses that are none."""
    url = F.when(F.col("page_id") % 11 == 0, "not an address").when(F.col("page_id") % 7 == 0, "https://www.elsewhere.net/x").otherwise(F.col("url"))
    stated = F.when(F.col("page_id") % 2 == 0, "").when(F.col("page_id") % 3 == 0, "Stated")
    return table(spark, sf, "pages").groupBy(gt.host_source(url, stated, DOMAINS).alias("source")).agg(F.count("*").alias("n"))


def stable_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    """Prints of texts whose footer changes on each visit, for one source of two."""
    source = _pick(("Board A", "Board B"), F.col("p_partkey"))
    text = F.concat(F.col("p_name"), F.lit("  good\n Please mention the word "), F.col("p_brand"))
    out = gt.stable_description(source, text, {"Board A": r"(?is)\s*Please mention the word\b.*$"})
    return table(spark, sf, "part").select("p_partkey", F.sha2(out, 256).alias("print"))


def location_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of places of work: road, lot, administrative names, remote."""
    n = F.col("s_suppkey").cast("string")
    raw = _pick(("road", "lot", "none"), F.col("s_suppkey"))
    address = F.when(raw == "road", F.concat(F.lit("54999 전주시 (빌딩) 팔달로 "), n, F.lit("-2 3층"))).when(raw == "lot", F.concat(F.lit("완주군 봉동읍 "), n))
    place = F.when(F.col("s_suppkey") % 4 == 0, "Remote").when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("Jeonju - "), n)).otherwise("전주시")
    key = gt.domestic_key([F.when(F.col("s_nationkey") > 5, "전북"), F.lit("")], gt.address_key(address), place, F.col("s_suppkey") % 5 != 0)
    return table(spark, sf, "supplier").select("s_suppkey", key.alias("place"), gt.short_city(F.when(F.col("s_suppkey") % 2 == 0, "전주시").otherwise("시")).alias("city"), gt.location_text(F.lit("전북"), F.lit(""), place).alias("where"))


PERIODS, TRUST, QUALIFIERS, BASES = ("hour", "month", "project", None), ("parsed", "regional_only", "basis_only", None), ("maximum", "approximate", None), ("per_task_equivalent", None, "hourly")


def pay_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Parts' prices as pays of all sorts: notes and the six ways to ask."""
    k = F.col("p_partkey")
    low = F.when(k % 3 != 0, F.col("p_retailprice"))
    s = gt.pay_summary(
        F.when(k % 5 != 0, F.col("p_name")), low, low, _pick(PERIODS, k), _pick(TRUST, F.expr("p_partkey div 4")), _pick(QUALIFIERS, F.expr("p_partkey div 2")), _pick(BASES, F.expr("p_partkey div 8")),
        k % 6 == 0, k % 7 == 0,
    )
    t = table(spark, sf, "part").select("p_partkey", s.alias("s"))
    asked = [gt.pay_matches(F.col("s"), w).alias(f"as_{w}") for w in ("amount", "hour", "salary", "piece", "basis_only", "undisclosed")]
    return t.select("p_partkey", F.col("s.value").alias("value"), F.col("s.note").alias("note"), F.col("s.limited").alias("limited"), *asked)


def collection_report(spark: SparkSession, sf: str) -> DataFrame:
    """Users as sources in markets: what failed, what came back, what was preserved."""
    e = table(spark, sf, "events")
    n = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("bad"), F.count("*").alias("n"))
    runs = n.select(_pick(("domestic", "remote"), F.col("user_id")).alias("market"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"),
                    F.when(F.col("bad") * 4 > F.col("n"), "error").when(F.col("bad") * 5 > F.col("n"), "partial").otherwise("ok").alias("status"),
                    _pick(("ok", "error", "partial"), F.col("user_id")).alias("was"), F.when(F.col("user_id") % 4 != 0, F.col("bad")).alias("preserved"))
    return gt.collection_health(runs)


def market_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as sources with gaps, of which some are configured after all."""
    n = table(spark, sf, "nation").select(F.col("n_name").alias("source"), F.lit("not_configured").alias("status"), F.when(F.col("n_regionkey") < 3, F.array(F.lit("domestic"))).otherwise(F.array(F.lit("remote"), F.lit("domestic"))).alias("markets"))
    return gt.collection_gaps(n, ["NATION_1", "NATION_3"], "remote").select("source", "status")


def search_collapse(spark: SparkSession, sf: str) -> DataFrame:
    """Customers that ordered in a state, by nation, against those found in another: counts, overlap and collapse."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("source"), F.col("o_custkey").alias("id"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    previous = o.select("source", "id", F.when(F.col("o_orderstatus") == "P", "expired").when(F.col("o_orderstatus") == "O", "open").alias("status"))
    found = o.where((F.col("o_totalprice") > 485000) | (F.col("source") < 5)).select("source", "id")
    t = gt.collapse_states(previous, found)
    tried = F.col("discovered")
    return t.select("source", "reference", "discovered", "overlap", "ratio", "overlap_ratio", "suspected", gt.detail_collapse(tried, F.col("overlap") - 30).alias("details"), gt.continuity_failed(tried, F.lit(20)).alias("continuity"))


def relative_days(spark: SparkSession, sf: str) -> DataFrame:
    day = F.when(F.col("o_orderkey") % 9 != 0, F.to_date("o_orderdate"))
    return table(spark, sf, "orders").groupBy(gt.relative_day(day, F.lit("2000-06-15").cast("date")).alias("label")).agg(F.count("*").alias("n"))


def collated_order(spark: SparkSession, sf: str) -> DataFrame:
    """Names in an order that knows no case: their place, by a collation."""
    from pyspark.sql import Window

    name = F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name"))
    t = table(spark, sf, "nation").select(F.concat(name, F.lit(" "), F.col("n_regionkey").cast("string")).alias("name"))  # few rows: one window
    return t.select("name", F.row_number().over(Window.orderBy(F.collate("name", "UNICODE_CI"))).alias("place"))


def feed_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Postings against the rules of a feed: one key a row, known values, fields that imply others, bounds, forms, bounded arrays."""
    k = F.col("o_orderkey")
    t = _postings(spark, sf).withColumns({
        "id": F.when(k % 50 == 0, k - 1).otherwise(k), "url": F.when(k % 31 == 0, "ftp://x").otherwise(F.concat(F.lit("https://x.example/"), k.cast("string"))), "rate": F.when(k % 37 == 0, 1.2).otherwise((k % 100) / 100),
        "sources": F.when(k % 41 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"))), "tags": F.sequence(F.lit(1), (k % 14 + 1).cast("int")), "low": (k % 70).cast("double"), "high": F.when(k % 3 != 0, (k % 90).cast("double")),
        "deadline_type": _pick(("fixed", "rolling", "unknown", "soon"), F.expr("o_orderkey div 4")), "deadline": F.when(k % 5 != 0, F.lit("2000-01-01").cast("date")),
        "mode": _pick(("remote", "onsite"), k), "remote": k % 4 == 0, "print": F.when(k % 43 == 0, "zz").otherwise(F.sha2(k.cast("string"), 256)), "first": k % 60, "last": k % 61,
    })
    rules = [
        ("eligibility", ~F.coalesce(F.col("eligibility").isin("korea", "worldwide", "unknown", "restricted"), F.lit(False))), ("status", F.col("status").isNotNull() & ~F.col("status").isin("open", "stale", "current_feed")),
        ("score", ~F.col("score").between(0, 100)), ("url", ~F.col("url").rlike(r"^https://[^/\s]+\.[^/\s]+(/|$)")), ("rate", ~F.col("rate").between(0, 1)), ("sources", F.size("sources") == 0), ("tags", F.size("tags") > 12),
        ("range", F.col("high") < F.col("low")), ("deadline_type", ~F.col("deadline_type").isin("fixed", "rolling", "unknown")), ("fixed_needs_date", (F.col("deadline_type") == "fixed") & F.col("deadline").isNull()),
        ("date_needs_fixed", (F.col("deadline_type") != "fixed") & F.col("deadline").isNotNull()), ("remote_mode", F.col("remote") & (F.col("mode") != "remote")), ("print", ~F.col("print").rlike("^[0-9a-f]{64}$")),
        ("restricted_score", (F.col("eligibility") == "restricted") & (F.col("score") > 19)), ("hard_eligible", (F.col("requirements") == "hard_check") & F.col("eligible")), ("seen_order", F.col("first") > F.col("last")),
        ("evidence_words", F.col("role_evidence") & (F.size("keywords") == 0) & (F.col("category") == "other")), ("stale_recommended", (F.col("status") == "stale") & gt.recommended(3)),
    ]
    broken = st.violations(t, "id", rules).unionByName(st.duplicate_keys(t, "id"))
    return broken.groupBy("rule").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def stated_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries of orders by customer that are stated wrongly, are missing, or have no rows, against what the rows add up to."""
    o = table(spark, sf, "orders")
    n = o.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    k = F.col("o_custkey")
    stated = n.where(k % 17 != 0).select(k, (F.col("orders") + F.when(k % 11 == 0, 1).otherwise(0)).alias("orders"), F.when(k % 13 != 0, F.col("open")).alias("open"))
    stated = stated.union(spark.createDataFrame([(-1, 2, 0)], "k long, orders long, open long"))
    return st.summary_mismatches(o, stated, "o_custkey", {"orders": F.count("*"), "open": F.count_if(F.col("o_orderstatus") == "O")})


QUERIES = {f.__name__: f for f in (
    feed_invariants, stated_summaries, recommendation_gate, source_gate, review_candidates, course_levels, unconfigured_source, host_sources, stable_descriptions, location_keys, pay_summaries,
    collection_report, market_gaps, search_collapse, relative_days, collated_order,
)}

_FIT = "CASE WHEN role_basis = 'public_institution' THEN coalesce(role_evidence, true) AND (word OR category NOT IN ('', 'other')) ELSE coalesce(role_evidence, {}) END"
_OK = f"coalesce(eligible, true) AND {_FIT} AND score >= 20 AND coalesce(eligibility IN ('korea', 'worldwide'), false) AND coalesce(requirements, 'clear') <> 'hard_check' AND coalesce(status, '') <> 'stale'"
_RULES = {
    "eligibility": "eligibility IS NULL", "status": "false", "score": "score > 100", "url": "k % 31 = 0", "rate": "k % 37 = 0", "sources": "k % 41 = 0", "tags": "k % 14 + 1 > 12", "range": "k % 3 <> 0 AND k % 90 < k % 70",
    "deadline_type": "d = 3", "fixed_needs_date": "d = 0 AND k % 5 = 0", "date_needs_fixed": "d <> 0 AND k % 5 <> 0", "remote_mode": "k % 4 = 0 AND k % 2 <> 0", "print": "k % 43 = 0",
    "restricted_score": "eligibility = 'restricted' AND score > 19", "hard_eligible": "requirements = 'hard_check' AND eligible", "seen_order": "k % 60 > k % 61", "evidence_words": "role_evidence AND NOT word AND category = 'other'",
    "stale_recommended": "false",
}
SQL = {
    "feed_invariants": f"""
        WITH {_POSTINGS}, q AS (SELECT *, o_orderkey AS k, (o_orderkey // 4) % 4 AS d, CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS id FROM p),
        r AS ({" UNION ALL ".join(f"SELECT '{n}' AS rule, id FROM q WHERE {c}" for n, c in _RULES.items())} UNION ALL SELECT 'unique', id FROM q GROUP BY id HAVING count(*) > 1)
        SELECT rule, count(*) AS n, sum(id)::BIGINT AS ids FROM r GROUP BY 1""",
    "stated_summaries": """
        WITH n AS (SELECT o_custkey, count(*) AS orders, count(*) FILTER (o_orderstatus = 'O') AS open FROM orders GROUP BY 1),
        s AS (SELECT o_custkey, CASE WHEN o_custkey % 17 = 0 THEN 0 ELSE orders + (o_custkey % 11 = 0)::INT END AS so, orders, CASE WHEN o_custkey % 17 = 0 OR o_custkey % 13 = 0 THEN 0 ELSE open END AS sp, open FROM n
              UNION ALL SELECT -1, 2, 0, 0, 0)
        SELECT o_custkey, 'orders' AS measure, so::DOUBLE AS stated, orders::DOUBLE AS found FROM s WHERE so <> orders UNION ALL SELECT o_custkey, 'open', sp::DOUBLE, open::DOUBLE FROM s WHERE sp <> open""",
    "recommendation_gate": f"""
        WITH {_POSTINGS} SELECT {_OK.format("true")} AS policy_2, {_OK.format("false")} AS policy_3, {_OK.format("false")} AND coalesce(fit, 'check') <> 'fail' AS policy_5,
            count(*) AS n, sum(o_orderkey)::BIGINT AS ids FROM p GROUP BY 1, 2, 3""",
    "source_gate": f"""
        WITH {_POSTINGS}, m(source, t, s) AS (VALUES ('s0', 'weak', 'observed'), ('s1', 'mixed', 'degraded'), ('s2', 'strong', 'reliable'), ('s3', 'mixed', 'unstable')),
        j AS (SELECT *, coalesce(t, CASE WHEN o_orderkey % 4 = 0 THEN 'strong' ELSE 'mixed' END) AS tier, coalesce(s, CASE WHEN o_orderkey % 4 = 0 THEN 'reliable' ELSE 'observed' END) AS state
              FROM p LEFT JOIN m ON source = 's' || o_orderkey % 7),
        g AS (SELECT tier, state, requirements, CASE WHEN (o_orderkey // 29) % 3 = 0 THEN 'list_only' WHEN state IN ('degraded', 'unstable') THEN 'source_fails' WHEN tier = 'weak' THEN 'source_noisy' ELSE '' END AS source_gate,
              CASE WHEN coalesce(role_evidence, false) THEN '' ELSE 'no_role_evidence' END AS role_gate FROM j)
        SELECT source_gate, role_gate, tier, state, source_gate = '' AND role_gate = '' AND coalesce(requirements, '') <> 'hard_check' AS eligible, count(*) AS n FROM g GROUP BY 1, 2, 3, 4, 5""",
    "review_candidates": f"""
        WITH {_POSTINGS} SELECT o_orderkey FROM p WHERE o_orderkey % 3 = 0 AND NOT (o_orderkey % 4 <> 0 AND o_orderkey % 5 = 0) AND coalesce(eligibility, '') <> 'restricted'
            AND (o_orderkey // 6) % 3 <> 1 AND coalesce(fit, '') <> 'fail' AND coalesce(status, '') <> 'stale'""",
    "course_levels": f"""
        WITH c AS (SELECT {_sql_pick(("beginner", "elementary", "intermediate", "advanced", "all levels", "beginner to advanced", "for teachers"), "p_partkey")} AS level, {_sql_pick(("online", "offline", "hybrid"), "p_partkey // 7")} AS mode FROM part),
        a AS (SELECT * FROM (VALUES (''), ('beginner'), ('elementary'), ('advanced'), ('teachers')) l(asked_level), (VALUES (''), ('online'), ('offline'), ('hybrid')) m(asked_mode))
        SELECT asked_level, asked_mode, count(*) AS n FROM c, a WHERE (asked_mode = '' OR mode = asked_mode OR mode = 'hybrid') AND CASE asked_level WHEN '' THEN true
            WHEN 'beginner' THEN level IN ('beginner', 'all levels', 'beginner to advanced') WHEN 'elementary' THEN level IN ('beginner', 'elementary', 'all levels', 'beginner to advanced')
            WHEN 'advanced' THEN level IN ('advanced', 'all levels') ELSE contains(level, asked_level) END GROUP BY 1, 2""",
    "unconfigured_source": "SELECT source, count(*) AS n FROM documents WHERE source <> 'src1' AND doc_id % 3 <> 0 GROUP BY 1",
    "host_sources": r"""
        WITH h AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 7 = 0 THEN 'www.elsewhere.net' ELSE lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) END AS host FROM pages)
        SELECT CASE WHEN host = 'example.com' OR ends_with(host, '.example.com') THEN 'Example' WHEN host = 'example.org' OR ends_with(host, '.example.org') THEN 'Other'
            WHEN page_id % 2 <> 0 AND page_id % 3 = 0 THEN 'Stated' ELSE coalesce(regexp_replace(host, '^www\.', ''), 'Manual') END AS source, count(*) AS n FROM h GROUP BY 1""",
    "stable_descriptions": "SELECT p_partkey, sha256(p_name || ' good' || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' Please mention the word ' || p_brand END) AS print FROM part",
    "location_keys": """
        WITH s AS (SELECT *, CASE s_suppkey % 3 WHEN 0 THEN '팔달로' || s_suppkey || '-2' WHEN 1 THEN '봉동읍' || s_suppkey ELSE '' END AS a,
            CASE s_suppkey % 4 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Jeonju - ' || s_suppkey ELSE '전주시' END AS p FROM supplier)
        SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN '' WHEN s_nationkey > 5 OR a <> '' THEN concat_ws('|', CASE WHEN s_nationkey > 5 THEN '전북' END, nullif(a, ''))
            WHEN s_suppkey % 4 = 0 THEN 'remote' WHEN s_suppkey % 4 = 1 THEN 'jeonju ' || s_suppkey ELSE '전주시' END AS place,
            CASE WHEN s_suppkey % 2 = 0 THEN '전주' ELSE '시' END AS city, '전북 ' || p AS where FROM s""",
    "pay_summaries": f"""
        WITH p AS (SELECT *, p_partkey % 3 <> 0 AS has, p_partkey % 5 = 0 AS unknown, coalesce({_sql_pick(PERIODS, "p_partkey")}, '') AS period, coalesce({_sql_pick(TRUST, "p_partkey // 4")}, 'none') AS trust,
                {_sql_pick(QUALIFIERS, "p_partkey // 2")} AS q, coalesce({_sql_pick(BASES, "p_partkey // 8")}, '') AS basis FROM part)
        SELECT p_partkey, CASE WHEN unknown THEN 'undisclosed' ELSE p_name END AS value, concat_ws('; ',
            CASE WHEN trust = 'regional_only' THEN 'one region only' WHEN trust = 'basis_only' THEN 'basis only' WHEN q = 'maximum' THEN 'upper limit' WHEN q = 'approximate' THEN 'approximate' END,
            CASE WHEN p_partkey % 6 = 0 THEN 'text and board differ' WHEN p_partkey % 7 = 0 THEN 'board amount unverified' END,
            CASE WHEN basis = 'per_task_equivalent' THEN 'per task, as an hour' END, CASE WHEN unknown THEN 'check the original' END) AS note,
            NOT unknown AND (NOT has OR trust = 'regional_only' OR p_partkey % 6 = 0 OR p_partkey % 7 = 0) AS limited,
            has AS as_amount, has AND period = 'hour' AS as_hour, has AND period IN ('day', 'week', 'month', 'year') AS as_salary, period IN ('project', 'episode', 'set') OR basis = 'per_task_equivalent' AS as_piece,
            trust = 'basis_only' AS as_basis_only, NOT has AS as_undisclosed FROM p""",
    "collection_report": """
        WITH n AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS bad, count(*) AS n FROM events GROUP BY 1),
        r AS (SELECT ['domestic', 'remote'][user_id % 2 + 1] AS market, 'u' || user_id AS source, CASE WHEN bad * 4 > n THEN 'error' WHEN bad * 5 > n THEN 'partial' ELSE 'ok' END AS status,
              ['ok', 'error', 'partial'][user_id % 3 + 1] AS was, CASE WHEN user_id % 4 <> 0 THEN bad ELSE 0 END AS preserved FROM n)
        SELECT market, coalesce(string_agg(source, ',' ORDER BY source) FILTER (status = 'error'), '') AS failed, coalesce(string_agg(source, ',' ORDER BY source) FILTER (status = 'partial'), '') AS partial,
            coalesce(string_agg(source, ',' ORDER BY source) FILTER (status = 'ok' AND was <> 'ok'), '') AS recovered, sum(preserved)::BIGINT AS preserved FROM r GROUP BY 1""",
    "market_gaps": "SELECT n_name AS source, 'not_configured' AS status FROM nation WHERE n_regionkey >= 3 AND n_name NOT IN ('NATION_1', 'NATION_3')",
    "search_collapse": """
        WITH o AS (SELECT c_nationkey AS source, o_custkey AS id, o_orderstatus AS s, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey),
        b AS (SELECT source, count(*) AS reference FROM o WHERE s <> 'P' GROUP BY 1), f AS (SELECT DISTINCT source, id FROM o WHERE o_totalprice > 485000 OR source < 5),
        d AS (SELECT source, count(*) AS discovered FROM f GROUP BY 1), v AS (SELECT f.source, count(*) AS overlap FROM f JOIN (SELECT DISTINCT source, id FROM o WHERE s <> 'P') USING (source, id) GROUP BY 1),
        t AS (SELECT source, coalesce(reference, 0) AS reference, coalesce(discovered, 0) AS discovered, coalesce(overlap, 0) AS overlap FROM b FULL JOIN d USING (source) LEFT JOIN v USING (source))
        SELECT *, discovered / nullif(reference, 0) AS ratio, overlap / nullif(reference, 0) AS overlap_ratio, reference >= 10 AND discovered > 0 AND discovered < ceil(reference * 0.5) AS suspected,
            discovered >= 10 AND discovered - (overlap - 30) >= 5 AND overlap - 30 < discovered * 0.5 AS details, discovered > 0 AND 20 >= greatest(3, ceil(discovered * 0.5)) AS continuity FROM t""",
    "relative_days": """
        WITH d AS (SELECT CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate::DATE END AS d FROM orders), n AS (SELECT d, DATE '2000-06-15' - d AS n FROM d)
        SELECT CASE WHEN d IS NULL THEN 'unknown' WHEN n < 0 THEN 'in ' || -n || ' days' WHEN n = 0 THEN 'today' WHEN n = 1 THEN 'yesterday' WHEN n <= 7 THEN n || ' days ago'
            ELSE strftime(d, '%Y-%m-%d') END AS label, count(*) AS n FROM n GROUP BY 1""",
    "collated_order": """
        WITH t AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END || ' ' || n_regionkey AS name FROM nation)
        SELECT name, row_number() OVER (ORDER BY lower(name)) AS place FROM t""",
}
