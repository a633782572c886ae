"""Queries on decisions: every input varies, and what comes out is told by SQL from the same picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.operators import decisions as dc
from kelpline.operators import evidence as ev
from kelpline.sources.tables import spread, table


def _pick(values: tuple, n) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


#: Names that the cases below use: a job gives its own table.
PLACES = {
    "canada": "CA", "france": "FR", "germany": "DE", "japan": "JP", "korea": "KR", "seoul": "KR", "south korea": "KR", "uk": "GB", "united kingdom": "GB", "us": "US", "usa": "US",
    "anywhere in the world": dc.ANY_PLACE, "globally": dc.ANY_PLACE, "work from anywhere": dc.ANY_PLACE, "worldwide": dc.ANY_PLACE,
}
#: location, text, country, and the decision: code and basis.
CASES = (
    ("Remote", "", "", "unknown", "remote_unspecified"), ("Anywhere in France", "", "", "restricted", "restriction_text"), ("Worldwide", "", "", "worldwide", "restriction_text"), ("Seoul", "", "KR", "korea", "restriction_text"),
    ("Seoul", "Candidates must reside in Germany.", "KR", "restricted", "restriction_text"), ("Remote", "Candidates must be based in Germany and not in Korea.", "KR", "restricted", "restriction_text"),
    ("Remote", "Applicants must reside in the USA, Korea excluded.", "KR", "restricted", "restriction_text"), ("Remote", "Location: Worldwide except South Korea.", "", "restricted", "restriction_text"),
    ("Remote", "Location: Worldwide (US only).", "", "restricted", "restriction_text"), ("Remote", "Location: Worldwide / US only.", "", "restricted", "restriction_text"), ("Remote", "Location: Worldwide except US.", "", "worldwide", "restriction_text"),
    ("Remote", "Location: Worldwide excluding Canada.", "", "worldwide", "restriction_text"), ("Remote", "Location: Worldwide except US and Korea.", "", "restricted", "restriction_text"), ("Remote", "Location: US only.", "", "restricted", "restriction_text"),
    ("Remote", "Location: Korea. Location: US only.", "", "unknown", "restriction_text"), ("Remote (US only)", "", "KR", "restricted", "restriction_text"), ("Worldwide (US only)", "", "KR", "restricted", "restriction_text"),
    ("Seoul", "Location: South Korea. Candidates must reside in Germany.", "KR", "restricted", "restriction_text"), ("Remote", "Location: South Korea (Work from Home).", "", "korea", "restriction_text"),
    ("Remote", "Candidates must reside in the US or Korea.", "", "korea", "restriction_text"), ("Remote", "Candidates must reside in the US and Korea.", "", "unknown", "restriction_text"), ("Remote", "Candidates must reside in the U.S. and Korea.", "", "unknown", "restriction_text"),
    ("Remote", "Candidates must reside in Germany and Korea.", "", "unknown", "restriction_text"), ("Remote", "Location: Remote", "", "unknown", "remote_unspecified"), ("Remote", "Candidates must reside in Germany.", "", "restricted", "restriction_text"),
    ("Hong Kong", "", "", "restricted", "location"), ("Sweden", "", "", "restricted", "location"), ("Greater Orlando", "", "", "restricted", "location"),
    ("Remote", "Applicants should be resident within Japan.", "", "restricted", "restriction_text"), ("Within Lapland", "A nice job.", "", "restricted", "location"), ("Remote", "Employees live in Korea.", "KR", "korea", "country_code"),
    ("Remote. Salary: 20 USD, US team", "", "", "restricted", "location"), ("Remote", "Location: Remote. You should live in the U.K.; we are in Seoul.", "", "restricted", "restriction_text"), (None, None, None, "unknown", "remote_unspecified"),
)


def eligibility_decisions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    e = dc.eligibility(*[_pick(tuple(c[n] for c in CASES), k) for n in range(3)], F.lit(True), PLACES, "KR")
    return table(spark, sf, "orders").select("o_orderkey", e["code"].alias("code"), e["basis"].alias("basis"))


def nation_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' nations as places, where NATION_7 is home: the names are those of the nation table."""
    names = [r.n_name for r in table(spark, sf, "nation").select("n_name").distinct().orderBy("n_name").collect()]
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k, name = F.col("c_custkey"), F.col("n_name")
    said = F.concat(_pick(("Candidates must reside in ", "Location: ", "Location: worldwide except ", "We are in "), k), name, _pick((".", " only.", " or Nation_7.", " and Nation_7."), F.expr("c_custkey div 4")))
    e = dc.eligibility(_pick(("Remote", "Lima"), F.expr("c_custkey div 16")), said, F.lit(None).cast("string"), F.col("c_custkey") % 5 != 0, {**{n.lower(): n for n in names}, "worldwide": dc.ANY_PLACE}, "NATION_7", "home")
    return c.select("c_custkey", e["code"].alias("code"), e["basis"].alias("basis"))


KIND, LISTED = ("official_ats", "board", "manual", "official_government", "board"), ("manual_original_review", "public_rss", "public_detail", None, "deadline_recheck")
TEXTS = (
    "Fine.", "Applications are closed.", "Apply by: 2000-05-01", "Apply by 2001-05-01", "This is not an immediate opening.", "Applications close: May 3, 2000.", "Application deadline June 20", "Apply by june 3 or so", "Apply by Jan 9 1999",
    "Apply by tomorrow",
)


def listing_states(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    deadline = F.when(k % 7 == 0, F.lit("2000-06-14")).when(k % 7 == 1, F.lit("2000-06-15")).cast("date")
    s = dc.listing_state(
        _pick(KIND, F.expr("o_orderkey div 5")), _pick(LISTED, F.expr("o_orderkey div 25")), _pick(("Clerk", "Talent pool", "Cook"), F.expr("o_orderkey div 100")), _pick(TEXTS, k), deadline, F.to_date("o_orderdate"), F.lit("2000-06-15"),
        needs_deadline=k % 11 == 0, more_pools=[("project_pool", k % 13 == 0)],
    )
    return spread(table(spark, sf, "orders"), "o_orderkey").groupBy(s["code"].alias("code"), s["basis"].alias("basis"), s["verification"].alias("verification"), s["stale"].alias("stale")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("ids"))


def market_scopes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    t = table(spark, sf, "supplier").select(
        F.array_join(dc.market_scopes(_pick(("KR", "US", None), k), _pick(("Seoul", "Oslo"), F.expr("s_suppkey div 3")), _pick(("remote", "onsite"), F.expr("s_suppkey div 6")), _pick(("korea", "restricted", "unknown"), F.expr("s_suppkey div 2")), "KR", ("korea", "seoul")), ",").alias("scopes"),
        dc.workplace_group(_pick(("remote", "onsite", "hybrid"), k), _pick(("Jeonju", "Seoul", "remote team", None), F.expr("s_suppkey div 3")), {"jeonbuk": "jeonju|wanju", "seoul": "seoul"}).alias("place"),
    )
    return t.groupBy("scopes", "place").agg(F.count("*").alias("n"))


def profile_fits(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    fit = dc.profile_fit(
        [("abroad", k % 7 == 0), ("night", k % 11 == 0)], [("role", k % 2 == 0), ("pay", k % 3 == 0), ("place", k % 5 == 0), ("date", F.when(k % 4 != 0, k % 13 == 0)), ("more", k % 6 == 0)],
        [(k % 3 == 1, 20), (k % 5 == 1, 12), (F.col("c_acctbal") > 0, 10), (F.col("c_nationkey") < 9, 60)],
    )
    return table(spark, sf, "customer").select("c_custkey", fit["status"].alias("status"), fit["score"].alias("score"), F.array_join(fit["gaps"], ",").alias("gaps"))


def administrative_places(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as cities of regions: those with one region get it, and the point of the finest name that has one."""
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("city"), F.when(F.col("c_custkey") % 10 == 0, "given").alias("province"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("city"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("province"), "n_nationkey", "n_regionkey")
    parents = n.select("city", "province").union(n.where("n_nationkey % 4 = 0").select("city", F.lit("r9")))
    points = n.where("n_nationkey % 3 = 0").select(F.lit(1).alias("level"), F.col("city").alias("name"), F.col("n_nationkey").cast("double").alias("lat"), F.lit(1.0).alias("lon"))
    points = points.union(n.where("n_regionkey < 3").select(F.lit(2), "province", F.col("n_regionkey").cast("double"), F.lit(2.0)).distinct())
    return dc.administrative_place(c, "c_custkey", "city", parents, points)


def language_fits(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as texts that name languages, required, welcome or in passing."""
    k = F.col("p_partkey")
    gap = F.repeat(F.lit("and so on "), F.lit(20))
    text = F.concat(_pick(("German is required. ", "German is a plus. ", "We are in Berlin. "), k), gap, _pick(("Fluent French required", "Fluent Korean required", "French and Korean lessons", ""), F.expr("p_partkey div 3")))
    f = dc.language_fit(text, {"de": "german", "fr": "french", "ko": "korean"}, ["de", "ko"], "required|fluent", "a plus")
    return spread(table(spark, sf, "part"), "p_partkey").groupBy(F.array_join(f["mentioned"], ",").alias("mentioned"), F.array_join(f["required"], ",").alias("required"), f["fit"].alias("fit")).agg(F.count("*").alias("n"))


#: Languages that the postings below may name.
TONGUES = ("arabic", "bengali", "chinese", "czech", "danish", "dutch", "english", "finnish", "french", "german", "greek", "hebrew", "hindi", "hungarian", "italian", "japanese", "korean", "malay", "polish", "portuguese", "spanish", "thai")
LEVELS = {"english": "unverified", "german": "fluent", "korean": "beginner", "spanish": "native"}
CUE = "required|fluent|native"


def language_assessments(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as postings: a language in the heading, one in the field, two in the text, one of them near the cue; what is asked for, and how it fits."""
    k = F.col("c_custkey")
    tongue = lambda n: _pick(TONGUES, n)
    role = k % 3 == 0
    heading = F.concat(tongue(k), _pick((" clerk", " speaking clerk"), F.expr("c_custkey div 22")))
    gap = F.repeat(F.lit("and so on "), F.lit(20))
    body = F.concat(F.lit("We meet in "), tongue(k + 5), F.lit(". "), gap, F.lit("Fluent "), tongue(k + 9), F.lit(" is asked for; "), gap, F.lit("germanic studies"))
    explicit = F.when(k % 7 == 0, F.initcap(tongue(k + 1)))
    asked = ev.languages_asked(heading, body, explicit, {t: t for t in TONGUES}, CUE, "speaking", role)
    v = ev.language_verdict(asked, LEVELS, role)
    return spread(table(spark, sf, "customer"), "c_custkey").select("c_custkey", F.array_join(asked, ",").alias("asked"), v["status"].alias("status"), F.array_join(v["because"], ",").alias("because"))


def names_in_documents(spark: SparkSession, sf: str) -> DataFrame:
    """How often the documents mention each of the 42 most frequent words of six letters or more, by one scan of each text for all of them."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))
    docs = table(spark, sf, "documents")
    top = docs.select(words.alias("w")).where(F.col("w").rlike("^[a-z]{6,}$")).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(42).collect()
    found = docs.select("doc_id", F.explode(ev.named_mentions("text", {r.w: r.w for r in top} or {"-": "-"}, 20, 20)).alias("m"))
    return found.groupBy("m.code").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


QUERIES = {f.__name__: f for f in (language_assessments, names_in_documents, eligibility_decisions, nation_eligibility, listing_states, market_scopes, profile_fits, administrative_places, language_fits)}


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


_TONGUE = lambda n: f"{_list(TONGUES)}[({n}) % {len(TONGUES)} + 1]"
SQL = {
    "language_assessments": f"""
        WITH c AS (SELECT c_custkey, c_custkey % 3 = 0 AS role, list_sort(list_distinct(list_filter([CASE WHEN c_custkey % 3 = 0 OR (c_custkey // 22) % 2 = 1 THEN {_TONGUE('c_custkey')} END,
            CASE WHEN c_custkey % 7 = 0 THEN {_TONGUE('c_custkey + 1')} END, {_TONGUE('c_custkey + 9')}], lambda x: x IS NOT NULL))) AS asked FROM customer),
        d AS (SELECT *, list_concat(list_filter(asked, lambda x: x NOT IN {tuple(LEVELS)}), list_filter(asked, lambda x: role AND x = 'korean')) AS bad, list_filter(asked, lambda x: x IN ('english', 'korean')) AS unsure FROM c)
        SELECT c_custkey, array_to_string(asked, ',') AS asked, CASE WHEN len(bad) > 0 THEN 'mismatch' WHEN len(unsure) > 0 THEN 'unknown' ELSE 'match' END AS status,
            array_to_string(CASE WHEN len(bad) > 0 THEN bad WHEN len(unsure) > 0 THEN unsure ELSE asked END, ',') AS because FROM d""",
    "names_in_documents": """
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents)
        SELECT w AS code, count(*) AS n, count(DISTINCT doc_id) AS documents FROM t WHERE regexp_full_match(w, '[a-z]{6,}') GROUP BY w ORDER BY n DESC, w LIMIT 42""",
    "eligibility_decisions": f"""
        SELECT o_orderkey, {_list(c[3] for c in CASES)}[o_orderkey % {len(CASES)} + 1] AS code, {_list(c[4] for c in CASES)}[o_orderkey % {len(CASES)} + 1] AS basis FROM orders""",
    "nation_eligibility": """
        WITH c AS (SELECT c_custkey, c_custkey % 4 AS a, (c_custkey // 4) % 4 AS b, (c_custkey // 16) % 2 = 0 AS remote_named, c_custkey % 5 <> 0 AS remote, n_name = 'NATION_7' AS home FROM customer JOIN nation ON c_nationkey = n_nationkey),
        d AS (SELECT *, home OR b > 1 AS has_home, NOT home AS has_abroad FROM c)
        SELECT c_custkey,
            CASE WHEN a = 3 THEN CASE WHEN remote AND remote_named THEN 'unknown' ELSE 'restricted' END
                WHEN a = 2 THEN CASE WHEN has_home THEN 'restricted' WHEN b = 1 AND has_abroad THEN 'restricted' ELSE 'worldwide' END
                WHEN b = 1 AND has_abroad THEN 'restricted' WHEN has_home AND has_abroad AND b = 3 THEN 'unknown' WHEN has_home THEN 'home' ELSE 'restricted' END AS code,
            CASE WHEN a < 3 THEN 'restriction_text' WHEN remote AND remote_named THEN 'remote_unspecified' WHEN remote THEN 'location' WHEN remote_named THEN 'onsite_location' ELSE 'onsite_location' END AS basis FROM d""",
    "listing_states": f"""
        WITH o AS (SELECT o_orderkey, {_list(KIND)}[(o_orderkey // 5) % 5 + 1] AS k, {_list(LISTED)}[(o_orderkey // 25) % 5 + 1] AS l, (o_orderkey // 100) % 3 = 1 AS pool, o_orderkey % 10 AS t, DATE '2000-06-15' - o_orderdate::DATE AS age FROM orders),
        b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 AND (o_orderkey % 7 > 1 OR (o_orderkey % 7 = 1 AND l = 'deadline_recheck')) THEN 'deadline_unknown' WHEN o_orderkey % 7 = 0 THEN 'structured_deadline' WHEN t = 1 THEN 'closed_text'
            WHEN t IN (2, 5, 7, 8) THEN 'deadline' WHEN o_orderkey % 13 = 0 THEN 'project_pool' WHEN t = 4 THEN 'pool_lead' WHEN pool THEN 'pool_title'
            WHEN k = 'manual' AND l = 'manual_original_review' THEN l WHEN k IN ('official_ats', 'official_government') THEN k || '_feed' WHEN k = 'manual' THEN k
            WHEN l = 'public_rss' THEN 'public_rss_list' WHEN l = 'public_detail' THEN 'public_search_and_detail' WHEN age > 45 THEN 'age' ELSE 'board_feed' END AS basis FROM o)
        SELECT CASE WHEN basis IN ('structured_deadline', 'closed_text', 'deadline') THEN 'expired' WHEN contains(basis, 'pool') THEN 'talent_pool' WHEN starts_with(basis, 'manual') THEN 'manual' WHEN basis = 'official_ats_feed' THEN 'verified_open'
            WHEN basis = 'official_government_feed' THEN 'official_listed' WHEN basis IN ('age', 'deadline_unknown') THEN 'stale' ELSE 'current_feed' END AS code, basis,
            CASE WHEN basis IN ('structured_deadline', 'closed_text', 'deadline') THEN 'closed' WHEN contains(basis, 'pool') THEN 'talent_pool' WHEN starts_with(basis, 'manual') THEN 'manual' WHEN basis = 'official_ats_feed' THEN 'direct_open'
            WHEN basis = 'official_government_feed' THEN 'official_listed' WHEN basis = 'deadline_unknown' THEN 'recheck' ELSE 'intermediary' END AS verification,
            basis IN ('structured_deadline', 'closed_text', 'deadline', 'age', 'deadline_unknown') AS stale, count(*) AS n, sum(o_orderkey)::BIGINT AS ids FROM b GROUP BY 1, 2, 3, 4""",
    "market_scopes": """
        WITH s AS (SELECT s_suppkey % 3 = 0 AS kr, (s_suppkey // 3) % 2 = 0 AS seoul, (s_suppkey // 6) % 2 = 0 AS remote, (s_suppkey // 2) % 3 <> 1 AS open_, ['remote', 'onsite', 'hybrid'][s_suppkey % 3 + 1] AS m, (s_suppkey // 3) % 4 AS p FROM supplier)
        SELECT concat_ws(',', CASE WHEN kr OR seoul THEN 'domestic' END, CASE WHEN remote AND NOT kr AND open_ THEN 'overseas_remote' END) AS scopes,
            CASE WHEN m = 'remote' OR (p = 2 AND m <> 'hybrid') THEN 'remote' WHEN p = 0 THEN 'jeonbuk' WHEN p = 1 THEN 'seoul' ELSE 'unknown' END AS place, count(*) AS n FROM s GROUP BY 1, 2""",
    "profile_fits": """
        WITH c AS (SELECT c_custkey AS k, list_filter([CASE WHEN c_custkey % 7 = 0 THEN 'abroad' END, CASE WHEN c_custkey % 11 = 0 THEN 'night' END], lambda x: x IS NOT NULL) AS bad,
            list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'role' END, CASE WHEN c_custkey % 3 = 0 THEN 'pay' END, CASE WHEN c_custkey % 5 = 0 THEN 'place' END, CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 13 = 0 THEN 'date' END,
                CASE WHEN c_custkey % 6 = 0 THEN 'more' END], lambda x: x IS NOT NULL) AS gaps,
            20 + CASE WHEN c_custkey % 3 = 1 THEN 20 ELSE 0 END + CASE WHEN c_custkey % 5 = 1 THEN 12 ELSE 0 END + CASE WHEN c_acctbal > 0 THEN 10 ELSE 0 END + CASE WHEN c_nationkey < 9 THEN 60 ELSE 0 END AS p FROM customer)
        SELECT k AS c_custkey, CASE WHEN len(bad) > 0 THEN 'fail' WHEN len(gaps) > 0 THEN 'check' ELSE 'pass' END AS status, (CASE WHEN len(bad) > 0 THEN 0 ELSE greatest(0, least(100, p - 8 * len(gaps))) END)::INT AS score,
            array_to_string(list_concat(bad, gaps)[1:4], ',') AS gaps FROM c""",
    "administrative_places": """
        WITH c AS (SELECT c_custkey, c_nationkey AS k, n_regionkey AS r, coalesce(CASE WHEN c_custkey % 10 = 0 THEN 'given' END, CASE WHEN k % 4 <> 0 THEN 'r' || r END) AS province FROM customer JOIN nation ON c_nationkey = n_nationkey)
        SELECT c_custkey, 'n' || k AS city, province, CASE WHEN k % 3 = 0 THEN k::DOUBLE WHEN province <> 'given' AND r < 3 THEN r::DOUBLE END AS lat,
            CASE WHEN k % 3 = 0 THEN 1.0::DOUBLE WHEN province <> 'given' AND r < 3 THEN 2.0::DOUBLE END AS lon, CASE WHEN k % 3 = 0 THEN 'city' WHEN province <> 'given' AND r < 3 THEN 'province' END AS precision FROM c""",
    "language_fits": """
        WITH p AS (SELECT p_partkey % 3 AS a, (p_partkey // 3) % 4 AS b FROM part),
        f AS (SELECT concat_ws(',', CASE WHEN a < 2 THEN 'de' END, CASE WHEN b IN (0, 2) THEN 'fr' END, CASE WHEN b IN (1, 2) THEN 'ko' END) AS mentioned, concat_ws(',', CASE WHEN a = 0 THEN 'de' END, CASE WHEN b = 0 THEN 'fr' END, CASE WHEN b = 1 THEN 'ko' END) AS required, a, b FROM p)
        SELECT mentioned, required, CASE WHEN b = 0 THEN 'mismatch' WHEN required <> '' THEN 'match' ELSE 'unknown' END AS fit, count(*) AS n FROM f GROUP BY 1, 2, 3""",
}
