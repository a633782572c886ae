"""Queries of the join and entity resolution families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions.text import canonical_name, collapse, url_canonical
from kelpline.operators import joins as jn
from kelpline.operators import ranking as rk
from kelpline.operators import resolve as rs
from kelpline.sources.tables import table


def dim_default_join(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their labels, unlabelled ones with the defaults, counted."""
    t = jn.join_default(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", {"quality": -1, "toxic": -1})
    return t.groupBy("source", "quality", "toxic").agg(F.count("*").alias("n"))


def prioritised_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier's counterpart among customers, whose numbers are tripled: by number, else by nation and the number's end."""
    c, s = table(spark, sf, "customer").select((F.col("c_custkey") * 3).alias("c_custkey"), "c_nationkey"), table(spark, sf, "supplier")
    ending = lambda nation, key: F.concat_ws("/", F.lit("n"), nation.cast("string"), (key % 10).cast("string"))
    left = [F.array(F.concat(F.lit("id"), F.col("s_suppkey").cast("string"))), F.array(ending(F.col("s_nationkey"), F.col("s_suppkey")))]
    right = [F.array(F.concat(F.lit("id"), F.col("c_custkey").cast("string"))), F.array(ending(F.col("c_nationkey"), F.col("c_custkey")))]
    return jn.prioritised(s, "s_suppkey", left, c, "c_custkey", right)


def anti_union_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Customers that neither as themselves nor through their account's nation appear among recent large orders."""
    recent = table(spark, sf, "orders").where("o_orderdate >= TIMESTAMP_NTZ '2001-01-01 00:00:00' AND o_totalprice > 400000")
    seen = recent.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("key"))
    poor = table(spark, sf, "supplier").where("s_acctbal < -900").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("key"))
    keys = [F.array(F.concat(F.lit("c"), F.col("c_custkey").cast("string"))), F.array(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))]
    return jn.anti_any(table(spark, sf, "customer"), "c_custkey", keys, seen.union(poor)).select("c_custkey", "c_nationkey")


def prefix_theta_join(spark: SparkSession, sf: str) -> DataFrame:
    """Part types against type families: a family holds for itself and for what starts with it and a space."""
    parts = table(spark, sf, "part")
    families = parts.select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("family")).distinct().withColumn("note", F.concat(F.lit("family "), "family"))
    return jn.prefix_join(parts.select("p_partkey", "p_type"), "p_partkey", "p_type", families, "family", " ").groupBy("family", "note").agg(F.count("*").alias("n"))


def gazetteer_longest_match(spark: SparkSession, sf: str) -> DataFrame:
    """The longest of the aliases that occur in a document as whole words; ties between names give none."""
    aliases = spark.createDataFrame(
        [("the", "article"), ("of the", "phrase"), ("de la", "phrase"), ("la", "article"), ("der", "article"), ("und", "link"), ("and", "link"), ("for the", "phrase"), ("que", "link")],
        "alias string, name string",
    )
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return jn.longest_alias(docs, "doc_id", "text", aliases, "name").groupBy("lang", "name").agg(F.count("*").alias("n"))


def upsert_override(spark: SparkSession, sf: str) -> DataFrame:
    """Customers, with balances replaced by the change set's and its new rows added."""
    base = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"))
    s = table(spark, sf, "supplier").select((F.col("s_suppkey") * 20).alias("c_custkey"), F.col("s_acctbal").alias("balance"))
    return jn.upsert(base, s, "c_custkey")


def state_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Customers who bought and were not hidden: semi and anti joins with sets of ids."""
    bought = table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    hidden = table(spark, sf, "orders").where("o_orderpriority = '5-LOW' AND o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(bought, "c_custkey", "left_semi").join(hidden, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


def id_set_algebra(spark: SparkSession, sf: str) -> DataFrame:
    """Union, intersection and differences of two sets of customers, counted."""
    o = table(spark, sf, "orders")
    a, b = (o.where(F.col("o_orderstatus") == s).select("o_custkey").distinct() for s in ("O", "P"))
    named = [("union", a.union(b).distinct()), ("both", a.intersect(b)), ("only_first", a.exceptAll(b)), ("only_second", b.exceptAll(a))]
    out = None
    for name, d in named:
        d = d.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.sum("o_custkey").alias("ids"))
        out = d if out is None else out.union(d)
    return out


def exact_dedupe_survivor(spark: SparkSession, sf: str) -> DataFrame:
    """Of documents alike in collapsed lower-cased text the longest, then the first, with their number and sources."""
    t = table(spark, sf, "documents").withColumn("cluster", F.md5(F.lower(collapse("text")))).withColumn("copies", F.lit(1)).withColumn("sources", F.array("source"))
    out = rs.survivors(t.select("cluster", "doc_id", "n_chars", "copies", "sources"), "cluster", [-F.col("n_chars"), F.col("doc_id")], unions=["sources"], counts=["copies"])
    return out.select("doc_id", "n_chars", "copies", F.concat_ws(",", "sources").alias("sources"))


def first_wins_by_position(spark: SparkSession, sf: str) -> DataFrame:
    """The first page of each canonical address."""
    t = table(spark, sf, "pages").withColumn("address", url_canonical("url"))
    return rk.one_per(t, ["address"], [F.col("page_id")]).select("page_id", "address")


def last_wins_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The latest event of each user and type; a hot user is no hot task, the choice is an aggregate."""
    t = table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return rk.least_row(t, ["user_id", "event_type"], [-F.unix_micros(F.col("ts").cast("timestamp")), -F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


def same_id_merge_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Orders' lines merged by order: distinct return flags sorted, quantities added, the line of the highest price first."""
    t = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", F.array("l_returnflag").alias("flags"), F.lit(1).alias("lines"), (F.col("l_discount") > 0.09).alias("rebate")
    )
    order = [-F.col("l_extendedprice"), F.col("l_partkey"), F.col("l_suppkey")]
    out = rs.survivors(t, "l_orderkey", order, unions=["flags"], counts=["lines"], any_of=["rebate"])
    return out.select("l_orderkey", "l_partkey", "lines", F.concat_ws("", "flags").alias("flags"), "rebate")


def blocking_pair_count(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of customers of a nation and segment whose balances differ by less than 1, by nation."""
    return rs.near_pair_counts(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"], "c_acctbal").groupBy("c_nationkey").agg(F.sum("pairs").alias("pairs"))


def greedy_cluster(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of a nation in the order of their numbers: one joins the first cluster whose head's balance is within 1500."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return rs.greedy_clusters(s, "s_suppkey", ["s_nationkey"], ["s_suppkey"], lambda h, r: F.abs(F.col(f"{h}.s_acctbal") - F.col(f"{r}.s_acctbal")) <= 1500)


def first_wins_any_key(spark: SparkSession, sf: str) -> DataFrame:
    """Events kept by a pass that drops those with a user and day, or a value, that a kept one has."""
    e = table(spark, sf, "events")
    keys = e.select("event_id", F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("day"), F.round("value", 0).cast("string").alias("amount"))
    return rs.first_wins_any_key(keys, "event_id", ["day", "amount"]).select("event_id")


def canonical_company(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", canonical_name(F.concat(F.col("c_name"), F.lit(", Inc. (GmbH)")), ["inc", "gmbh", "ltd"]).alias("name"))


QUERIES = {f.__name__: f for f in (
    dim_default_join, prioritised_lookup, anti_union_keys, prefix_theta_join, gazetteer_longest_match, upsert_override, state_sets, id_set_algebra,
    exact_dedupe_survivor, first_wins_by_position, last_wins_upsert, same_id_merge_arrays, blocking_pair_count, greedy_cluster, first_wins_any_key, canonical_company,
)}

SQL = {
    "dim_default_join": """
        SELECT source, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic, count(*) AS n
        FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2, 3""",
    "prioritised_lookup": """
        WITH c AS (SELECT c_custkey * 3 AS c_custkey, c_nationkey FROM customer),
        m AS (SELECT s_suppkey, c_custkey, 0 AS priority FROM supplier JOIN c ON s_suppkey = c_custkey
              UNION ALL
              SELECT s_suppkey, min(c_custkey), 1 FROM supplier JOIN c ON s_nationkey = c_nationkey AND s_suppkey % 10 = c_custkey % 10 GROUP BY 1)
        SELECT s_suppkey, c_custkey, priority FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY priority) AS r FROM m) WHERE r = 1""",
    "anti_union_keys": """
        SELECT c_custkey, c_nationkey FROM customer
        WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' AND o_totalprice > 400000)
          AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < -900)""",
    "prefix_theta_join": """
        WITH f AS (SELECT DISTINCT split_part(p_type, ' ', 1) AS family FROM part)
        SELECT family, 'family ' || family AS note, count(*) AS n FROM part JOIN f ON p_type = family OR starts_with(p_type, family || ' ') GROUP BY 1, 2""",
    "gazetteer_longest_match": r"""
        WITH a(alias, name) AS (VALUES ('the', 'article'), ('of the', 'phrase'), ('de la', 'phrase'), ('la', 'article'), ('der', 'article'), ('und', 'link'), ('and', 'link'), ('for the', 'phrase'), ('que', 'link')),
        d AS (SELECT doc_id, lang, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS t FROM documents),
        h AS (SELECT doc_id, length(alias) AS n, min(name) AS lo, max(name) AS hi FROM d JOIN a ON contains(t, ' ' || alias || ' ') GROUP BY 1, 2),
        b AS (SELECT doc_id, CASE WHEN lo = hi THEN lo END AS name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS r FROM h) WHERE r = 1)
        SELECT lang, name, count(*) AS n FROM documents LEFT JOIN b USING (doc_id) GROUP BY 1, 2""",
    "upsert_override": """
        SELECT c_custkey, c_acctbal AS balance FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey * 20 FROM supplier)
        UNION ALL SELECT s_suppkey * 20, s_acctbal FROM supplier""",
    "state_sets": """
        SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)
          AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'P')""",
    "id_set_algebra": """
        WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
        SELECT 'union' AS part, count(*) AS n, sum(k)::BIGINT AS ids FROM (SELECT k FROM a UNION SELECT k FROM b)
        UNION ALL SELECT 'both', count(*), sum(k)::BIGINT FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
        UNION ALL SELECT 'only_first', count(*), sum(k)::BIGINT FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
        UNION ALL SELECT 'only_second', count(*), sum(k)::BIGINT FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""",
    "exact_dedupe_survivor": r"""
        WITH t AS (SELECT *, lower(trim(regexp_replace(text, '[\s\x{00A0}\x{FEFF}]+', ' ', 'g'))) AS k FROM documents)
        SELECT doc_id, n_chars, copies, sources FROM (
            SELECT doc_id, n_chars, count(*) OVER (PARTITION BY k) AS copies, row_number() OVER (PARTITION BY k ORDER BY n_chars DESC, doc_id) AS r,
                   array_to_string(list_sort(list_distinct(list(source) OVER (PARTITION BY k))), ',') AS sources FROM t) WHERE r = 1""",
    "first_wins_by_position": r"""
        WITH u AS (SELECT page_id, lower(regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '/+$', '')) AS address FROM pages)
        SELECT min(page_id) AS page_id, address FROM u GROUP BY 2""",
    "last_wins_upsert": """
        SELECT user_id, event_type, event_id, value FROM
            (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""",
    "same_id_merge_arrays": """
        SELECT l_orderkey, first(l_partkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) AS l_partkey, count(*) AS lines,
               array_to_string(list_sort(list_distinct(list(l_returnflag))), '') AS flags, bool_or(l_discount > 0.09) AS rebate
        FROM lineitem GROUP BY 1""",
    "blocking_pair_count": """
        SELECT a.c_nationkey, count(*) AS pairs FROM customer a JOIN customer b
            ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey AND abs(a.c_acctbal - b.c_acctbal) < 1
        GROUP BY 1""",
    "canonical_company": r"""
        WITH n AS (SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^\p{L}\p{N}]+', ' ', 'g')) AS name FROM customer)
        SELECT c_custkey, name FROM n""",
    "greedy_cluster": """
        WITH b AS (SELECT s_nationkey, list([{'k': s_suppkey, 'v': s_acctbal}] ORDER BY s_suppkey) AS x FROM supplier GROUP BY 1),
        h AS (SELECT s_nationkey, list_reduce(x, lambda acc, r: CASE WHEN len(list_filter(acc, lambda c: abs(c.v - r[1].v) <= 1500)) > 0 THEN acc ELSE list_concat(acc, r) END) AS heads FROM b)
        SELECT s_suppkey, list_min(list_transform(list_filter(heads, lambda c: abs(c.v - s_acctbal) <= 1500), lambda c: c.k)) AS cluster FROM supplier JOIN h USING (s_nationkey)""",
    "first_wins_any_key": """
        WITH e AS (SELECT event_id, user_id || '/' || ts::DATE AS day, CASE WHEN value IS NOT NULL THEN round(value, 0)::VARCHAR END AS amount FROM events),
        x AS (SELECT list([{'k': event_id, 'd': day, 'a': amount}] ORDER BY event_id) AS x FROM e),
        h AS (SELECT list_reduce(x, lambda acc, r: CASE WHEN len(list_filter(acc, lambda c: c.d = r[1].d OR c.a = r[1].a)) > 0 THEN acc ELSE list_concat(acc, r) END) AS heads FROM x)
        SELECT unnest(list_transform(heads, lambda c: c.k)) AS event_id FROM h""",
}
