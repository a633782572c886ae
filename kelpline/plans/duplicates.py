"""The query on duplicates of postings, and its SQL: a fold over the rows of each block."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.operators.duplicates import dedupe
from kelpline.sources.tables import table

#: column -> the same expression in Spark and in SQL, over p_partkey (k) and the part's columns.
KINDS, ELIGIBLE, PLACES = ("official_ats", "board", "aggregator", "official_platform", "board"), ("korea", "worldwide", "unknown", "restricted"), ("remote", "berlin", "jeonju")
PICKS = {
    "kind": (KINDS, "k"), "eligibility": (ELIGIBLE, "k // 3"), "place": (PLACES, "k // 2"), "source": (("Arbeitnow", "B", "C"), "k // 5"), "mode": (("remote", "onsite"), "k // 7"),
    "domestic": (("", "", "전북|전주", "전북|완주"), "k // 4"), "province": (("전북", ""), "k // 11"), "district": (("덕진", "완산", ""), "k // 6"), "neighborhood": (("", "인후"), "k // 13"),
    "address": (("팔달로1", "팔달로2", ""), "k // 8"), "category": (("office", "shop", "other", "office"), "k // 9"), "type": (("full", "part"), "k // 3"), "pay": (("KRW:10:10:hour", "KRW:11:11:hour", ""), "k // 10"),
    "deadline": (("2026-02-01", "", "2026-02-02"), "k // 12"), "posted_day": (("2026-01-01", "2026-01-02", ""), "k // 5"), "host": (("www.arbeitnow.com", "arbeitnow.de", "b.example"), "k // 2"),
    "relaxed": (("clerk", "", "cook"), "k // 7"), "status": (("verified_open", "current_feed", "current_feed"), "k // 6"),
}


def deduped_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as postings in which every input of the rules varies: what is left, with its copies and sources."""
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.expr(n.replace("//", "div").replace("k", "p_partkey")) % len(values) + 1).cast("int"))
    k = F.col("p_partkey")
    t = table(spark, sf, "part").select(
        k.alias("pos"), F.concat(F.lit("u"), F.expr("p_partkey div 2").cast("string")).alias("url"), *[pick(v, n).alias(c) for c, (v, n) in PICKS.items()], (k % 3 != 1).alias("remote"), (k % 4 != 1).alias("local"),
        (k % 5 < 2).alias("precise"), F.concat(F.lit("c"), (k % 9).cast("string")).alias("company"), F.when(k % 10 == 9, "").otherwise(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("title"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("role"), F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"))).alias("keywords"), (k % 50).cast("int").alias("score"),
    )
    return dedupe(t).select("pos", "copies", F.array_join("sources", ",").alias("sources"), F.size("urls").alias("urls"), "status")


QUERIES = {"deduped_postings": deduped_postings}

_OFF = "('official_ats', 'official_platform', 'official_government')"


def _known(c: str) -> str:
    return f"(h.{c} = r.{c} AND h.{c} <> '')"


_MIRROR = "({0}.source = 'Arbeitnow' AND {0}.mode = 'remote' AND regexp_matches({0}.host, '(^|\\.)arbeitnow\\.[a-z.]+$'))"
_A = "CASE WHEN {0}.precise THEN {0}.address ELSE '' END"
_WORK = f"""(h.local AND r.local AND {_known('province')} AND {_known('company')} AND {_known('title')} AND {_known('category')} AND h.category <> 'other' AND CASE
    WHEN ({_A.format('h')}) <> '' AND ({_A.format('r')}) <> '' AND ({_A.format('h')}) <> ({_A.format('r')}) THEN {_known('pay')} AND {_known('deadline')} AND ({_known('district')} OR {_known('neighborhood')})
    WHEN h.pay <> '' AND r.pay <> '' AND h.pay <> r.pay AND NOT (h.precise OR r.precise) THEN false
    ELSE {_known('pay')} OR (({_A.format('h')}) <> '' AND ({_A.format('h')}) = ({_A.format('r')})) OR h.precise OR r.precise OR ({_known('deadline')} AND {_known('posted_day')}) END)"""
_SAME = f"""(h.pos = r.pos OR CASE WHEN {_MIRROR.format('h')} AND {_MIRROR.format('r')} THEN true
    WHEN h.remote AND r.remote AND h.source = r.source AND h.kind = 'official_ats' AND r.kind = 'official_ats' AND ((h.eligibility = 'worldwide' AND r.eligibility = 'korea') OR (h.eligibility = 'korea' AND r.eligibility = 'worldwide')) THEN true
    WHEN h.domestic <> '' AND r.domestic <> '' AND h.domestic <> r.domestic THEN {_WORK} WHEN h.url = r.url THEN true WHEN h.domestic <> '' OR r.domestic <> '' THEN h.domestic = r.domestic
    WHEN h.kind IN {_OFF} AND r.kind IN {_OFF} THEN h.eligibility = r.eligibility AND h.place = r.place
    WHEN h.eligibility = r.eligibility AND h.eligibility IN ('korea', 'worldwide') THEN true WHEN h.eligibility = r.eligibility AND h.eligibility <> 'unknown' THEN h.place = r.place
    WHEN h.eligibility = 'unknown' OR r.eligibility = 'unknown' THEN h.place = r.place OR h.place = 'remote' OR r.place = 'remote'
    WHEN h.kind IN {_OFF} OR r.kind IN {_OFF} THEN (h.kind IN {_OFF} AND h.eligibility = 'worldwide') OR (r.kind IN {_OFF} AND r.eligibility = 'worldwide') ELSE false END)"""
_ACROSS = f"""(h.pos = r.pos OR {_known('role')} OR ({_known('relaxed')} AND {_known('deadline')} AND h.type = r.type) OR ({_known('pay')} AND (h.title = r.title OR len(list_intersect(h.keywords, r.keywords)) >= 2)))"""
_COLS = ", ".join(f"[{', '.join(repr(x) for x in v)}][({n.replace('k', 'p_partkey')}) % {len(v)} + 1] AS {c}" for c, (v, n) in PICKS.items())
_RANK = "CASE kind WHEN 'official_ats' THEN 5 WHEN 'official_government' THEN 4 WHEN 'official_platform' THEN 3 WHEN 'board' THEN 2 WHEN 'aggregator' THEN 1 ELSE 0 END DESC, score DESC, coalesce(TRY_CAST(posted_day AS DATE), DATE '1970-01-01') DESC, pos"


def _fold(name: str, rows: str, block: str, order: str, same: str) -> str:
    """CTEs: the heads of each block, and each row's cluster: the first head that it is the same as."""
    return f"""{name}_b AS (SELECT {block} AS block, list([{rows}] ORDER BY {order}) AS x FROM {rows} GROUP BY 1),
        {name}_h AS (SELECT block, list_reduce(x, lambda acc, q: CASE WHEN len(list_filter(acc, lambda h: {same.replace('r.', 'q[1].')})) > 0 THEN acc ELSE list_concat(acc, q) END) AS heads FROM {name}_b),
        {name}_c AS (SELECT r.*, list_filter(heads, lambda h: {same})[1].pos AS cluster FROM {rows} r JOIN {name}_h g ON g.block = r.{block})"""


SQL = {
    "deduped_postings": f"""
        WITH p0 AS (SELECT p_partkey AS pos, 'u' || p_partkey // 2 AS url, {_COLS}, p_partkey % 3 <> 1 AS remote, p_partkey % 4 <> 1 AS local, p_partkey % 5 < 2 AS precise, 'c' || p_partkey % 9 AS company,
                CASE WHEN p_partkey % 10 = 9 THEN '' ELSE split_part(p_name, ' ', 2) END AS title, split_part(p_name, ' ', 1) AS role, CASE WHEN p_partkey % 2 = 0 THEN ['a', 'b'] ELSE ['b'] END AS keywords, p_partkey % 50 AS score FROM part),
        p AS (SELECT *, CASE WHEN title <> '' THEN company || '::' || title ELSE url END AS block1 FROM p0),
        {_fold('one', 'p', 'block1', 'pos', _SAME)},
        m AS (SELECT *, list_sort(list_distinct(list(source) OVER w)) AS sources, list_distinct(list(url) OVER w) AS urls, count(*) OVER w AS copies, bool_or(status = 'verified_open') OVER w AS open,
              row_number() OVER (PARTITION BY cluster ORDER BY {_RANK}) AS nth, min(pos) OVER (PARTITION BY block1) AS block_pos FROM one_c WINDOW w AS (PARTITION BY cluster)),
        n AS (SELECT * REPLACE (CASE WHEN open THEN 'verified_open' ELSE status END AS status), company || '::' || address || '::' || category AS block2, local AND precise AND address <> '' AND category <> 'other' AS keyed FROM m WHERE nth = 1),
        s AS (SELECT * EXCLUDE (cluster, nth), cluster AS first_pos FROM n WHERE keyed),
        {_fold('two', 's', 'block2', 'block_pos, first_pos', _ACROSS)},
        z AS (SELECT *, list_distinct(flatten(list(sources) OVER w)) AS all_sources, list_distinct(flatten(list(urls) OVER w)) AS all_urls, sum(copies) OVER w AS all_copies, bool_or(status = 'verified_open') OVER w AS any_open,
              row_number() OVER (PARTITION BY cluster ORDER BY {_RANK}) AS nth FROM two_c WINDOW w AS (PARTITION BY cluster))
        SELECT pos, all_copies::BIGINT AS copies, array_to_string(list_sort(all_sources), ',') AS sources, len(all_urls)::INT AS urls, CASE WHEN any_open THEN 'verified_open' ELSE status END AS status FROM z WHERE nth = 1
        UNION ALL SELECT pos, copies, array_to_string(sources, ','), len(urls)::INT, status FROM n WHERE NOT keyed""",
}
