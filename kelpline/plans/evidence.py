"""Queries on slots, requirements, conflicts, badges, adapters and fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.operators import evidence as ev
from kelpline.operators import normalise as nm
from kelpline.operators.joins import upsert
from kelpline.sources.tables import spread, table


def slot_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Licence names and tokens that documents state after a label."""
    t = table(spark, sf, "documents").select("doc_id", ev.slot("text", "[Ll]icensed under(?: the)?").alias("licence"), ev.slot("text", "token", [" [A-Z]"], 40).alias("token"))
    return t.where("licence is not null or token is not null")


def list_items(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of types and brands written as a list with a remark in parentheses."""
    raw = F.concat(F.col("p_type"), F.lit(", "), F.col("p_brand"), F.lit(" (new; used), "), F.col("p_type"))
    t = table(spark, sf, "part").select("p_partkey", ev.items(raw).alias("parts"))
    return t.select("p_partkey", F.size("parts").alias("n"), F.array_join("parts", "|").alias("parts"))


def requirement_context(spark: SparkSession, sf: str) -> DataFrame:
    """How documents speak of a word, by what stands around it."""
    r = ev.requirement("text", "that", " of ", " the ")
    return table(spark, sf, "documents").groupBy(r.alias("requirement")).agg(F.count("*").alias("n"))


def provenance_conflict(spark: SparkSession, sf: str) -> DataFrame:
    """The language that a marker word gives against the one that is stated, trusted for some sources."""
    low = F.concat(F.lit(" "), F.lower("text"))
    text = F.when(low.contains(" und "), "de").when(low.contains(" the "), "en").when(low.contains(" les "), "fr")
    s = ev.prefer_verified(text, F.when(F.col("doc_id") % 9 != 0, F.col("lang")), F.col("source").isin("src0", "src1"))
    t = table(spark, sf, "documents").select(s.alias("s")).select("s.*")
    return t.groupBy("value", "basis", "conflict").agg(F.count("*").alias("n"))


LABELS = {"purchase": "bought", "signup": "joined", "error": "failed"}


def recent_badges(spark: SparkSession, sf: str) -> DataFrame:
    """Badges of the last two days from each user's events."""
    e = table(spark, sf, "events")
    h = e.groupBy("user_id").agg(F.collect_list(F.struct(F.col("ts").cast("timestamp").alias("at"), "event_id", F.col("event_type").alias("event"))).alias("history"))
    badges = ev.recent_badges(F.col("history"), F.lit("2024-01-30 00:00:00"), LABELS, 2)
    return h.select("user_id", F.array_join(badges, ",").alias("badges"))


def status_labels(spark: SparkSession, sf: str) -> DataFrame:
    label = ev.label_of("o_orderstatus", {"O": "open", "F": "filled"}, "pending")
    return table(spark, sf, "orders").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def schema_adapter(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and suppliers under one schema, with constants for what one side lacks."""
    c = ev.adapt(table(spark, sf, "customer"), {"c_custkey": "id", "c_name": "name", "c_acctbal": "balance", "c_mktsegment": "segment"}, {"kind": "customer"})
    s = ev.adapt(table(spark, sf, "supplier"), {"s_suppkey": "id", "s_name": "name", "s_acctbal": "balance"}, {"kind": "supplier", "segment": "none"})
    return c.unionByName(s)


def failure_penalty(spark: SparkSession, sf: str) -> DataFrame:
    """Scores after two failures in a row of every fifth customer's source."""
    t = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 60).cast("int").alias("score"), F.lit("open").alias("status"))
    failed = F.col("c_custkey") % 5 == 0
    return ev.preserved_failure(ev.preserved_failure(t, failed), failed)


def failed_run_fallback(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_name", (F.col("p_size") > 40).alias("curated"))
    return ev.with_fallback(p.where("p_partkey % 3 = 0"), p.where("p_partkey % 2 = 0"), "p_partkey", False, "curated")


def review_events(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews of orders by customer: the newest against the one before it."""
    t = spark.sql("SELECT o_custkey, o_orderdate AS reviewed, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous, o_orderstatus FROM {o}", o=table(spark, sf, "orders"))
    event = ev.review_event(F.col("reviewed"), F.col("previous"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open"))
    return t.groupBy(F.coalesce(event, F.lit("nothing")).alias("event")).agg(F.count("*").alias("n"))


def filter_migration(spark: SparkSession, sf: str) -> DataFrame:
    """Stored filters that equal an old default become the new one."""
    stored = F.create_map(F.lit("region"), F.concat(F.lit("r"), (F.col("c_nationkey") % 3).cast("string")), F.lit("sort"), F.when(F.col("c_custkey") % 2 == 0, "new").otherwise("old"))
    moved = ev.migrate(stored, [({"region": "r0", "sort": "new"}, {"region": "all", "sort": "score"}), ({"region": "r1", "sort": "old"}, {"region": "r1", "sort": "new"})])
    t = table(spark, sf, "customer").select(moved["region"].alias("region"), moved["sort"].alias("sort"))
    return t.groupBy("region", "sort").agg(F.count("*").alias("n"))


def conversation_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation's turns in order as one digest, with the roles' counts; long ones are cut by nothing."""
    c = table(spark, sf, "conversations")
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">")
    return c.groupBy("conv_id").agg(ordered.alias("roles"), F.count_if(F.col("role") == "user").alias("asked"), F.sum(F.length("text")).cast("long").alias("chars"))


def feed_order(spark: SparkSession, sf: str) -> DataFrame:
    """Hand-made rows over collected ones, then the page of the best by score and date."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("day"))
    manual = o.where("o_orderkey % 1000 = 0").withColumn("o_totalprice", F.lit(999999.0))
    return upsert(o, manual, "o_orderkey").orderBy(F.desc("o_totalprice"), F.desc("day"), "o_orderkey").limit(60)


PROFILE = nm.Profile(
    categories=[("licensed", ["license", "creative commons"]), ("secret", ["token"]), ("french", ["les", "une"])],
    open_to=[("wide", ["of the", "for the"]), ("some", ["that"])],
    closed_to=["idiot", "moron"],
    requirements=[nm.Requirement("of_the", "(^| )of( |$)", "(^| )the( |$)", cap=60), nm.Requirement("worthless", "worthless", hard=True, cap=30)],
    weights=[("category", 40), ("eligible", 35), ("official", 15), ("remote", 20)],
    official=["src1", "src2"],
)


def listing_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as postings through the whole projection: what comes out by category, eligibility and requirement."""
    raw = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), "source", F.lit("Posting").alias("title"), F.lit("Acme, Inc.").alias("company"), F.lit(None).cast("string").alias("location"),
        (F.col("doc_id") % 2 == 0).alias("remote"), F.lit(None).cast("string").alias("salary"), F.concat(F.lit("https://e.example.com/j?id="), F.col("doc_id").cast("string")).alias("url"),
        F.lit("2026-01-20").alias("posted"), F.col("text").alias("description"),
    )
    out = nm.normalise(raw, PROFILE, F.lit("2026-01-31"))
    return out.groupBy("category", "eligibility", "requirement_status", "status").agg(F.count("*").alias("n"), F.sum("score").alias("score"), F.countDistinct("listing_id").alias("ids"))


TITLES = (("Clerk (remote)", "clerk"), ("  Senior   Cook [2026]", "senior cook"), ("Ops &amp; Data", "ops data"))
COMPANIES = (("Acme, Inc.", "acme"), ("Überblick GmbH", "überblick"), (None, None))
LOCATIONS = (("Seoul", "onsite", "asia"), ("Berlin, hybrid", "hybrid", "europe"), ("Berlin or Seoul", "onsite", "mixed"), (None, "unknown", None))
PAYS = (("$80-100k per year", "USD", 80000.0, 100000.0, "year", "parsed"), ("€20 / hour", "EUR", 20.0, 20.0, "hour", "parsed"), ("£9,000 to £8,000", "GBP", 9000.0, 8000.0, None, "suspicious"), ("good", None, None, None, None, "none"))
POSTED = (("2026-01-20", "2026-01-20"), ("20.1.2026", "2026-01-20"), ("2025/11/5", "2025-11-05"), ("soon", None))


def projection_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as raw postings in which every input varies: keys, place, pay, dates and status of the projection."""
    k = F.col("p_partkey")
    pick = lambda rows, n: F.element_at(F.array(*[F.lit(r[0]) for r in rows]), (n % len(rows) + 1).cast("int"))
    raw = spread(table(spark, sf, "part"), "p_partkey").select(
        k.cast("string").alias("id"), F.concat(F.lit("src"), (k % 3).cast("string")).alias("source"), pick(TITLES, k).alias("title"), pick(COMPANIES, F.expr("p_partkey div 3")).alias("company"), pick(LOCATIONS, F.expr("p_partkey div 9")).alias("location"),
        (k % 5 == 0).alias("remote"), pick(PAYS, F.expr("p_partkey div 36")).alias("salary"), F.concat(F.lit("HTTPS://E.example.com/J/?x=1&id="), k.cast("string"), F.lit("#top")).alias("url"), pick(POSTED, F.expr("p_partkey div 4")).alias("posted"), F.col("p_name").alias("description"),
    )
    profile = nm.Profile(categories=[("kitchen", ["cook"]), ("office", ["clerk"])], official=["src1"], regions={"asia": ["seoul"], "europe": ["berlin"]}, legal_forms=["inc", "gmbh"])
    out = nm.normalise(raw, profile, F.lit("2026-01-31"))
    return out.select(
        "id", "company_key", "title_key", "url_key", "workplace", "region", "category", F.col("pay.currency").alias("currency"), F.col("pay.low").alias("low"), F.col("pay.high").alias("high"), F.col("pay.period").alias("period"),
        F.col("pay.confidence").alias("confidence"), F.date_format("posted_at", "yyyy-MM-dd").alias("posted_at"), "age_days", "status",
    )


def address_slots(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("Main Street "), (F.col("c_custkey") % 90).cast("string"), F.when(F.col("c_custkey") % 2 == 0, ", 12345 ").otherwise(", "), F.when(F.col("c_custkey") % 5 == 0, "77").otherwise("Old Town"))
    return table(spark, sf, "customer").select(nm.address_parts(raw).alias("a")).groupBy("a.street", "a.postcode", "a.city").agg(F.count("*").alias("n"), F.countDistinct("a.number").alias("numbers"))


def label_translation(spark: SparkSession, sf: str) -> DataFrame:
    t = nm.translate(F.concat("event_type", F.lit(" "), (F.col("user_id") % 3).cast("string")), {"click 0": "Klick keiner"}, [(r"view (\d)", "Ansicht $1"), (r"(\w+) 2", "zwei $1")])
    return table(spark, sf, "events").groupBy(t.alias("label")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    slot_extraction, list_items, requirement_context, provenance_conflict, recent_badges, status_labels, schema_adapter, failure_penalty,
    failed_run_fallback, review_events, filter_migration, conversation_digest, feed_order, listing_projection, projection_inputs, address_slots, label_translation,
)}

def _list(rows, at: int, n: str, cast: str = "") -> str:
    values = ", ".join("NULL" if r[at] is None else repr(r[at]) if isinstance(r[at], float) else f"'{r[at]}'" for r in rows)
    return f"([{values}]{cast})[({n}) % {len(rows)} + 1]"


SQL = {
    "projection_inputs": f"""
        WITH p AS (SELECT p_partkey AS k, {_list(TITLES, 1, "p_partkey")} AS title_key, {_list(COMPANIES, 1, "p_partkey // 3")} AS company_key, {_list(LOCATIONS, 1, "p_partkey // 9")} AS w, {_list(LOCATIONS, 2, "p_partkey // 9")} AS region,
            {_list(PAYS, 1, "p_partkey // 36")} AS currency, {_list(PAYS, 2, "p_partkey // 36", "::DOUBLE[]")} AS low, {_list(PAYS, 3, "p_partkey // 36", "::DOUBLE[]")} AS high, {_list(PAYS, 4, "p_partkey // 36")} AS period,
            {_list(PAYS, 5, "p_partkey // 36")} AS confidence, {_list(POSTED, 1, "p_partkey // 4")}::DATE AS posted_at, p_name FROM part)
        SELECT k::VARCHAR AS id, company_key, title_key, 'https://e.example.com/j?id=' || k AS url_key, CASE WHEN k % 5 = 0 THEN 'remote' ELSE w END AS workplace, region,
            CASE k % 3 WHEN 1 THEN 'kitchen' WHEN 0 THEN 'office' ELSE 'other' END AS category, currency, low, high, period, confidence, strftime(posted_at, '%Y-%m-%d') AS posted_at, (DATE '2026-01-31' - posted_at)::INT AS age_days,
            CASE WHEN DATE '2026-01-31' - posted_at > 45 THEN 'stale' WHEN k % 3 = 1 THEN 'official_listed' ELSE 'current_feed' END AS status FROM p""",
    "slot_extraction": r"""
        WITH t AS (SELECT doc_id, nullif(trim(regexp_replace(regexp_extract(text, '(?s)(?:[Ll]icensed under(?: the)?)\s*[:=]?\s*(.*?)(?:\n|$)', 1), '[\s\x{00A0}\x{FEFF}]+', ' ', 'g')), '') AS licence,
            nullif(rtrim(substr(trim(regexp_replace(regexp_extract(text, '(?s)(?:token)\s*[:=]?\s*(.*?)(?:\n| [A-Z]|$)', 1), '[\s\x{00A0}\x{FEFF}]+', ' ', 'g')), 1, 40)), '') AS token FROM documents)
        SELECT * FROM t WHERE licence IS NOT NULL OR token IS NOT NULL""",
    "list_items": "SELECT p_partkey, 2 AS n, p_type || '|' || p_brand || ' (new; used)' AS parts FROM part",
    "requirement_context": r"""
        WITH p AS (SELECT doc_id, lower(text) AS t, string_split(lower(text), 'that') AS p FROM documents),
        m AS (SELECT doc_id, t, k, list_sum(list_transform(p[1:k], lambda x: length(x)))::BIGINT + 4 * (k - 1) + 1 AS pos FROM (SELECT *, unnest(range(1, len(p))) AS k FROM p)),
        g AS (SELECT doc_id, list(substr(t, greatest(pos - 40, 1), 64 + least(pos - 1, 40))) AS c FROM m GROUP BY 1),
        f AS (SELECT coalesce(c, []) AS c FROM documents LEFT JOIN g USING (doc_id)),
        v AS (SELECT len(c) AS n, len(list_filter(c, lambda x: contains(x, ' of ') AND NOT contains(x, ' the '))) AS must, len(list_filter(c, lambda x: contains(x, ' the '))) AS may FROM f)
        SELECT CASE WHEN n = 0 THEN 'none' WHEN must > 0 THEN 'required' WHEN may > 0 THEN 'optional' ELSE 'mentioned' END AS requirement, count(*) AS n FROM v GROUP BY 1""",
    "provenance_conflict": """
        WITH t AS (SELECT CASE WHEN contains(' ' || lower(text), ' und ') THEN 'de' WHEN contains(' ' || lower(text), ' the ') THEN 'en' WHEN contains(' ' || lower(text), ' les ') THEN 'fr' END AS t,
                          CASE WHEN doc_id % 9 <> 0 THEN lang END AS m, source IN ('src0', 'src1') AS v FROM documents),
        b AS (SELECT *, CASE WHEN v AND m IS NOT NULL THEN 'metadata' WHEN t IS NOT NULL THEN 'text' WHEN m IS NOT NULL THEN 'metadata_unverified' ELSE 'none' END AS basis FROM t)
        SELECT CASE WHEN basis IN ('metadata', 'metadata_unverified') THEN m ELSE t END AS value, basis, coalesce(t IS NOT NULL AND m IS NOT NULL AND t <> m, false) AS conflict, count(*) AS n FROM b GROUP BY 1, 2, 3""",
    "recent_badges": """
        WITH e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'bought' WHEN 'signup' THEN 'joined' WHEN 'error' THEN 'failed' END AS b FROM events),
        l AS (SELECT user_id, b, max((ts, event_id)) AS newest FROM e WHERE b IS NOT NULL AND ts >= TIMESTAMP '2024-01-28' GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY newest DESC) AS k FROM l),
        s AS (SELECT user_id, string_agg(b, ',' ORDER BY k) AS badges FROM r WHERE k <= 3 GROUP BY 1)
        SELECT user_id, coalesce(badges, '') AS badges FROM (SELECT DISTINCT user_id FROM e) LEFT JOIN s USING (user_id)""",
    "status_labels": "SELECT CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'pending' END AS label, count(*) AS n FROM orders GROUP BY 1",
    "schema_adapter": """
        SELECT * FROM (SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS kind FROM customer
        UNION ALL SELECT s_suppkey, s_name, s_acctbal, 'none', 'supplier' FROM supplier)""",
    "failure_penalty": """
        SELECT c_custkey, (CASE WHEN c_custkey % 5 = 0 THEN greatest(0, c_custkey % 60 - 20) ELSE c_custkey % 60 END)::INT AS score,
               CASE WHEN c_custkey % 5 = 0 THEN 'source_error' ELSE 'open' END AS status FROM customer""",
    "failed_run_fallback": """
        SELECT p_partkey, p_name, p_size > 40 AS curated, CASE WHEN p_partkey % 3 = 0 THEN 'current' ELSE 'source_error' END AS verification
        FROM part WHERE p_partkey % 3 = 0 OR (p_partkey % 2 = 0 AND p_size <= 40)""",
    "review_events": """
        WITH t AS (SELECT o_orderdate AS r, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p, o_orderstatus AS s FROM orders)
        SELECT CASE WHEN p IS NULL THEN 'first_seen' WHEN r > p THEN CASE WHEN s = 'F' THEN 'status_changed' ELSE 'review_confirmed' END ELSE 'nothing' END AS event, count(*) AS n FROM t GROUP BY 1""",
    "filter_migration": """
        WITH t AS (SELECT 'r' || (c_nationkey % 3) AS region, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS sort FROM customer)
        SELECT CASE WHEN region = 'r0' AND sort = 'new' THEN 'all' ELSE region END AS region,
               CASE WHEN region = 'r0' AND sort = 'new' THEN 'score' WHEN region = 'r1' AND sort = 'old' THEN 'new' ELSE sort END AS sort, count(*) AS n FROM t GROUP BY 1, 2""",
    "conversation_digest": """
        SELECT conv_id, string_agg(role, '>' ORDER BY turn, role) AS roles, count(*) FILTER (role = 'user') AS asked, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1""",
    "feed_order": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 0 THEN 999999.0::DOUBLE ELSE o_totalprice END AS o_totalprice, epoch_ms(o_orderdate) // 1000 AS day
        FROM orders ORDER BY 2 DESC, 3 DESC, 1 LIMIT 60""",
    "listing_projection": r"""
        WITH c AS (SELECT *, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(text, '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[\s\x{00A0}\x{FEFF}]+', ' ', 'g')) AS d FROM documents),
        w AS (SELECT *, lower('Posting ' || chr(10) || ' ' || d) AS t FROM c),
        p AS (SELECT *, CASE WHEN regexp_matches(t, '(^|[^a-z0-9])(license|creative\s+commons)([^a-z0-9]|$)') THEN 'licensed' WHEN regexp_matches(t, '(^|[^a-z0-9])token([^a-z0-9]|$)') THEN 'secret'
                    WHEN regexp_matches(t, '(^|[^a-z0-9])(les|une)([^a-z0-9]|$)') THEN 'french' ELSE 'other' END AS category,
               CASE WHEN regexp_matches(t, '(^|[^a-z0-9])(idiot|moron)([^a-z0-9]|$)') THEN 'restricted' WHEN regexp_matches(t, '(^|[^a-z0-9])(of\s+the|for\s+the)([^a-z0-9]|$)') THEN 'wide'
                    WHEN regexp_matches(t, '(^|[^a-z0-9])that([^a-z0-9]|$)') THEN 'some' ELSE 'unknown' END AS eligibility,
               len(list_filter(regexp_split_to_array(t, '[.,;:!?\n]+'), lambda x: regexp_matches(trim(x), '(^| )of( |$)') AND NOT regexp_matches(trim(x), '(^| )the( |$)'))) > 0 AS n1, contains(t, 'worthless') AS n2 FROM w),
        s AS (SELECT *, CASE WHEN n2 THEN 'hard_check' WHEN n1 THEN 'routine_check' ELSE 'clear' END AS requirement_status, CASE WHEN source IN ('src1', 'src2') THEN 'official_listed' ELSE 'current_feed' END AS status,
               least(100, CASE WHEN category <> 'other' THEN 40 ELSE 0 END + CASE WHEN eligibility IN ('wide', 'some') THEN 35 ELSE 0 END + CASE WHEN source IN ('src1', 'src2') THEN 15 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 20 ELSE 0 END,
                     CASE WHEN n1 THEN 60 ELSE 100 END, CASE WHEN n2 THEN 30 ELSE 100 END, CASE WHEN eligibility = 'restricted' THEN 19 ELSE 100 END) AS score FROM p)
        SELECT category, eligibility, requirement_status, status, count(*) AS n, sum(score)::BIGINT AS score, count(*) AS ids FROM s GROUP BY 1, 2, 3, 4""",
    "address_slots": """
        SELECT CASE WHEN c_custkey % 5 <> 0 THEN 'Main Street' END AS street, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 2 = 0 THEN '12345' END AS postcode,
               CASE WHEN c_custkey % 5 <> 0 THEN 'Old Town' END AS city, count(*) AS n, count(DISTINCT CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 90 END) AS numbers FROM customer GROUP BY 1, 2, 3""",
    "label_translation": r"""
        WITH t AS (SELECT event_type || ' ' || (user_id % 3) AS t FROM events)
        SELECT CASE WHEN t = 'click 0' THEN 'Klick keiner' WHEN t LIKE 'view _' THEN 'Ansicht ' || right(t, 1) WHEN t LIKE '% 2' THEN 'zwei ' || split_part(t, ' ', 1) ELSE t END AS label, count(*) AS n FROM t GROUP BY 1""",
}
