"""Queries of the scalar and classification families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions import text as tx
from kelpline.functions import values as vl
from kelpline.operators import rules as ru
from kelpline.operators import state as st
from kelpline.sources.tables import table


def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    body = tx.html_to_text("html")
    return table(spark, sf, "pages").select("page_id", F.length(body).cast("long").alias("n"), F.md5(body).alias("digest"))


def url_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", tx.url_canonical("url", keep=["id", "p"]).alias("address"), F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host"))


def whitespace_canonical(spark: SparkSession, sf: str) -> DataFrame:
    t = tx.collapse("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.length(t).cast("long").alias("n"), F.md5(t).alias("digest"))


def snippet_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.snippet("text", 60).alias("snippet"))


def hash_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id", tx.stable_id("page:", tx.url_canonical("url")).alias("id"), tx.stable_id("p-", F.lower("url"), F.col("page_id"), length=20, bits=256).alias("wide_id")
    )


def haversine_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by distance band of synthetic places of their nation and a supplier's: 500, 2000 and 8000 km."""
    place = lambda key: ((key * 37 % 120 - 60).cast("double"), (key * 53 % 300 - 150).cast("double"))
    (a, b), (c, d) = place(F.col("c_nationkey")), place(F.col("c_custkey") % 25)
    km = vl.haversine_km(a, b, c, d)
    t = table(spark, sf, "customer").select(vl.band(km, [500, 2000, 8000]).alias("band"), F.round(km).cast("long").alias("km"))
    return t.groupBy("band").agg(F.count("*").alias("n"), F.sum("km").alias("km"))


def date_multi_format(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates written in five ways, and one that is none, read back."""
    d = F.to_date("o_orderdate")
    way = F.col("o_orderkey") % 6
    raw = F.when(way == 0, F.date_format(d, "yyyy-MM-dd")).when(way == 1, F.date_format(d, "yyyy/M/d")).when(way == 2, F.date_format(d, "yyyy.M.d"))
    raw = raw.when(way == 3, F.date_format(d, "d.M.yyyy")).when(way == 4, F.date_format(d, "yyyyMMdd")).otherwise(F.lit("soon"))
    t = table(spark, sf, "orders").select(vl.date_from(raw).alias("day"))
    return t.groupBy(F.coalesce(F.date_format("day", "yyyy-MM"), F.lit("none")).alias("month")).agg(F.count("*").alias("n"))


def json_prop_extract(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"))


def phrase_counts(spark: SparkSession, sf: str) -> DataFrame:
    phrases = ["license", "creative commons", "of the", "idiot", "token", "für"]
    docs = table(spark, sf, "documents")
    counts = [F.count_if(tx.has_phrase("text", p)).alias(f"n{k}") for k, p in enumerate(phrases)]
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("phrase"), F.col(f"n{k}").alias("n")) for k, p in enumerate(phrases)]))
    return docs.agg(*counts).select(pairs.alias("p")).select("p.*")


MARKERS = [r"\bder\b|\bdie\b|\bdas\b", r"\bund\b", r"\bist\b|\bein\b|\beine\b", r"\bnicht\b|\bauf\b", r"\bf.r\b|\bmit\b", r"\bvon\b|\bzu\b"]


def language_marker_vote(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with four of six families of German function words, by their language."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " "), F.lit(" "))
    votes = tx.marker_votes(words, [m.replace(r"\b", " ") for m in MARKERS])
    german = (votes >= 4) & (F.length("text") >= 180)
    return table(spark, sf, "documents").groupBy("lang").agg(F.count_if(german).alias("german"), F.sum(votes).alias("votes"))


def negated_clause_veto(spark: SparkSession, sf: str) -> DataFrame:
    """Documents some sentence part of which has "the" without "of" in it."""
    hit = tx.clause_requires("text", "(^| )the( |$)", "(^| )of( |$)")
    return table(spark, sf, "documents").groupBy("source").agg(F.count_if(hit).alias("n"), F.count("*").alias("docs"))


def first_match_classify(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_chars")
    rules = [(F.contains(F.lower("text"), F.lit("license")), "licensed"), (F.contains("text", F.lit("@")), "contact"), (n < 200, "stub"), ((n > 5000) & (F.col("lang") == "en"), "long_read")]
    return table(spark, sf, "documents").groupBy(ru.first_match(rules, "plain").alias("category"), "lang").agg(F.count("*").alias("n"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "orders")
    weights = [
        (F.col("o_orderpriority") == "1-URGENT", 40), (F.col("o_orderpriority") == "2-HIGH", 25), (F.col("o_orderstatus") == "O", 30),
        (F.col("o_totalprice") > 100_000, 20), (F.col("o_totalprice") > 250_000, 25), (F.col("o_orderstatus") == "F", -35),
    ]
    return t.withColumn("score", ru.score(weights)).withColumn("capped", ru.score(weights, caps=[(F.col("o_orderpriority") == "5-LOW", 19), (F.col("o_custkey") % 7 == 0, 49)]))


def additive_score_clamp(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).groupBy("score").agg(F.count("*").alias("n"))


def cap_by_rule(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).groupBy("capped").agg(F.count("*").alias("n"), F.sum("score").alias("uncapped"))


def requirement_lattice(spark: SparkSession, sf: str) -> DataFrame:
    """pass, check or fail of documents from their labels, with the reasons."""
    t = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    fit = ru.lattice([(F.col("toxic") == 1, F.col("toxic").isNull()), (F.col("quality") == 0, F.col("quality").isNull()), (F.col("n_chars") < 50, F.lit(False))])
    why = F.array_join(ru.reasons([("toxic", F.col("toxic") == 1), ("poor", F.col("quality") == 0), ("short", F.col("n_chars") < 50)]), "+")
    return t.groupBy(fit.alias("fit"), why.alias("why")).agg(F.count("*").alias("n"))


def family_or_mixed(spark: SparkSession, sf: str) -> DataFrame:
    kinds = [("steel", F.contains("p_type", F.lit("STEEL"))), ("promo", F.contains("p_type", F.lit("PROMO"))), ("small", F.col("p_size") <= 10)]
    return table(spark, sf, "part").groupBy(F.coalesce(ru.exactly_one(kinds), F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))


def signal_freshness_reduce(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's best freshness among their purchases, of which one counts for 12 days, and what is to be looked at next."""
    e = table(spark, sf, "events").where("event_type = 'purchase'")
    age = F.floor((vl.epoch_ms(F.lit("2024-01-31 00:00:00")) - vl.epoch_ms(F.col("ts"))) / 86_400_000)
    t = e.withColumn("state", vl.freshness(age, 12)).groupBy("user_id").agg(F.collect_set("state").alias("states"), F.max(12 - age).alias("left"))
    best = ru.strongest(F.col("states"), ["fresh", "aging", "expired"], "unknown")
    return t.select("user_id", best.alias("state"), "left")


def amounts_read_back(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts written in thousands and millions, read back."""
    a = F.col("o_totalprice")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.floor(a / 1000).cast("string"), F.lit("k"))).when(F.col("o_orderkey") % 3 == 1, F.format_number(F.floor(a), 0)).otherwise(F.lit("n/a"))
    return table(spark, sf, "orders").select("o_orderkey", vl.parse_amount(raw).alias("amount"))


def invariant_report(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows break each rule of the lines' invariants."""
    rules = [
        ("ship_before_epoch", F.col("l_shipdate") < F.lit("1995-02-01").cast("timestamp_ntz")),
        ("discount_range", ~F.col("l_discount").between(0.0, 0.09)),
        ("quantity_range", ~F.col("l_quantity").between(1, 49)),
        ("open_but_returned", (F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "R")),
        ("price_sign", F.col("l_extendedprice") <= 0),
    ]
    t = table(spark, sf, "lineitem").withColumn("row", F.col("l_orderkey"))
    return st.violations(t, "row", rules).groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("row").alias("orders"))


def summary_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that are not unique, and how often they occur."""
    n = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return n.where("n > 1").groupBy("n").agg(F.count("*").alias("keys"))


QUERIES = {f.__name__: f for f in (
    html_to_text, url_canonical, whitespace_canonical, snippet_truncate, hash_ids, haversine_bands, date_multi_format, json_prop_extract, phrase_counts,
    language_marker_vote, negated_clause_veto, first_match_classify, additive_score_clamp, cap_by_rule, requirement_lattice, family_or_mixed,
    signal_freshness_reduce, amounts_read_back, invariant_report, summary_consistency,
)}

_S = r"[\s\x{00A0}\x{FEFF}]+"
_ADDRESS = r"lower(regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '/+$', ''))"
_SCORE = """greatest(0, least(100, CASE WHEN o_orderpriority = '1-URGENT' THEN 40 ELSE 0 END + CASE WHEN o_orderpriority = '2-HIGH' THEN 25 ELSE 0 END
    + CASE WHEN o_orderstatus = 'O' THEN 30 ELSE 0 END + CASE WHEN o_totalprice > 100000 THEN 20 ELSE 0 END
    + CASE WHEN o_totalprice > 250000 THEN 25 ELSE 0 END - CASE WHEN o_orderstatus = 'F' THEN 35 ELSE 0 END))"""

SQL = {
    "html_to_text": rf"""
        WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<svg\b[^>]*>.*?</svg\s*>|<iframe\b[^>]*>.*?</iframe\s*>|<noscript\b[^>]*>.*?</noscript\s*>', ' ', 'g') AS t FROM pages),
        b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM a),
        c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&') AS t FROM b),
        d AS (SELECT page_id, trim(regexp_replace(t, '{_S}', ' ', 'g')) AS t FROM c)
        SELECT page_id, length(t) AS n, md5(t) AS digest FROM d""",
    "url_canonical": rf"""
        SELECT page_id, {_ADDRESS} || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS address, host FROM (
            SELECT *, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host,
                list_filter([CASE WHEN i <> '' THEN 'id=' || i END, CASE WHEN p <> '' THEN 'p=' || p END], lambda x: x IS NOT NULL) AS q FROM (
                SELECT *, regexp_extract(url, '[?&]id=([^&#]*)', 1) AS i, regexp_extract(url, '[?&]p=([^&#]*)', 1) AS p FROM pages))""",
    "whitespace_canonical": rf"""
        WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '{_S}', ' ', 'g')) AS t FROM conversations) SELECT conv_id, turn, length(t) AS n, md5(t) AS digest FROM t""",
    "snippet_truncate": rf"""
        WITH t AS (SELECT doc_id, trim(regexp_replace(text, '{_S}', ' ', 'g')) AS t FROM documents)
        SELECT doc_id, CASE WHEN length(t) > 60 THEN rtrim(substr(t, 1, 59)) || '…' ELSE t END AS snippet FROM t""",
    "hash_ids": rf"""
        SELECT page_id, 'page:' || substr(sha1({_ADDRESS}), 1, 16) AS id, 'p-' || substr(sha256(lower(url) || '|' || page_id), 1, 20) AS wide_id FROM pages""",
    "haversine_bands": """
        WITH p AS (SELECT (c_nationkey * 37 % 120 - 60)::DOUBLE AS a, (c_nationkey * 53 % 300 - 150)::DOUBLE AS b,
                          (c_custkey % 25 * 37 % 120 - 60)::DOUBLE AS c, (c_custkey % 25 * 53 % 300 - 150)::DOUBLE AS d FROM customer),
        k AS (SELECT 12742.0 * asin(sqrt(least(1.0, pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2)))) AS km FROM p)
        SELECT CASE WHEN km <= 500 THEN 0 WHEN km <= 2000 THEN 1 WHEN km <= 8000 THEN 2 ELSE 3 END AS band, count(*) AS n, sum(round(km)::BIGINT)::BIGINT AS km FROM k GROUP BY 1""",
    "date_multi_format": """
        SELECT CASE WHEN o_orderkey % 6 = 5 THEN 'none' ELSE strftime(o_orderdate, '%Y-%m') END AS month, count(*) AS n FROM orders GROUP BY 1""",
    "json_prop_extract": """
        SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, max(k) AS most FROM (SELECT event_type, (props->>'$.k')::INT AS k FROM events) GROUP BY 1""",
    "phrase_counts": r"""
        SELECT phrase, count(*) FILTER (CASE WHEN phrase = 'für' THEN contains(lower(text), phrase)
                 ELSE regexp_matches(lower(text), '(^|[^a-z0-9])' || replace(phrase, ' ', '\s+') || '([^a-z0-9]|$)') END) AS n
        FROM documents, (VALUES ('license'), ('creative commons'), ('of the'), ('idiot'), ('token'), ('für')) p(phrase) GROUP BY 1""",
    "language_marker_vote": r"""
        WITH w AS (SELECT lang, text, ' ' || regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g') || ' ' AS t FROM documents),
        v AS (SELECT lang, text, regexp_matches(t, ' der | die | das ')::INT + regexp_matches(t, ' und ')::INT + regexp_matches(t, ' ist | ein | eine ')::INT
              + regexp_matches(t, ' nicht | auf ')::INT + regexp_matches(t, ' f.r | mit ')::INT + regexp_matches(t, ' von | zu ')::INT AS votes FROM w)
        SELECT lang, count(*) FILTER (votes >= 4 AND length(text) >= 180) AS german, sum(votes)::BIGINT AS votes FROM v GROUP BY 1""",
    "negated_clause_veto": r"""
        WITH c AS (SELECT doc_id, trim(unnest(regexp_split_to_array(lower(text), '[.,;:!?\n]+'))) AS c FROM documents),
        h AS (SELECT DISTINCT doc_id FROM c WHERE regexp_matches(c, '(^| )the( |$)') AND NOT regexp_matches(c, '(^| )of( |$)'))
        SELECT source, count(h.doc_id) AS n, count(*) AS docs FROM documents LEFT JOIN h USING (doc_id) GROUP BY 1""",
    "first_match_classify": """
        SELECT CASE WHEN contains(lower(text), 'license') THEN 'licensed' WHEN contains(text, '@') THEN 'contact' WHEN n_chars < 200 THEN 'stub'
                    WHEN n_chars > 5000 AND lang = 'en' THEN 'long_read' ELSE 'plain' END AS category, lang, count(*) AS n FROM documents GROUP BY 1, 2""",
    "additive_score_clamp": f"SELECT {_SCORE} AS score, count(*) AS n FROM orders GROUP BY 1",
    "cap_by_rule": f"""
        SELECT least(s, CASE WHEN o_orderpriority = '5-LOW' THEN 19 ELSE 100 END, CASE WHEN o_custkey % 7 = 0 THEN 49 ELSE 100 END) AS capped,
               count(*) AS n, sum(s)::BIGINT AS uncapped FROM (SELECT *, {_SCORE} AS s FROM orders) GROUP BY 1""",
    "requirement_lattice": """
        SELECT CASE WHEN toxic = 1 OR quality = 0 OR n_chars < 50 THEN 'fail' WHEN toxic IS NULL OR quality IS NULL THEN 'check' ELSE 'pass' END AS fit,
               concat_ws('+', CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 0 THEN 'poor' END, CASE WHEN n_chars < 50 THEN 'short' END) AS why, count(*) AS n
        FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2""",
    "family_or_mixed": """
        WITH k AS (SELECT contains(p_type, 'STEEL') AS a, contains(p_type, 'PROMO') AS b, p_size <= 10 AS c FROM part)
        SELECT CASE WHEN a::INT + b::INT + c::INT > 1 THEN 'mixed' WHEN a THEN 'steel' WHEN b THEN 'promo' WHEN c THEN 'small' ELSE 'none' END AS kind, count(*) AS n FROM k GROUP BY 1""",
    "signal_freshness_reduce": """
        WITH a AS (SELECT user_id, floor((epoch_ms(TIMESTAMP '2024-01-31') - epoch_ms(ts)) / 86400000.0)::BIGINT AS age FROM events WHERE event_type = 'purchase')
        SELECT user_id, CASE WHEN bool_or(age * 4 <= 36) THEN 'fresh' WHEN bool_or(age <= 12) THEN 'aging' ELSE 'expired' END AS state, max(12 - age) AS "left" FROM a GROUP BY 1""",
    "amounts_read_back": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice / 1000) * 1000 WHEN o_orderkey % 3 = 1 THEN floor(o_totalprice) END AS amount FROM orders""",
    "invariant_report": """
        SELECT rule, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM (
            SELECT l_orderkey, unnest(list_filter([CASE WHEN l_shipdate < TIMESTAMP '1995-02-01' THEN 'ship_before_epoch' END, CASE WHEN NOT l_discount BETWEEN 0.0 AND 0.09 THEN 'discount_range' END,
                CASE WHEN NOT l_quantity BETWEEN 1 AND 49 THEN 'quantity_range' END, CASE WHEN l_linestatus = 'O' AND l_returnflag = 'R' THEN 'open_but_returned' END,
                CASE WHEN l_extendedprice <= 0 THEN 'price_sign' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem) GROUP BY 1""",
    "summary_consistency": """
        SELECT n, count(*) AS keys FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) WHERE n > 1 GROUP BY 1""",
}
