"""Operators and queries that once did less than the whole job."""

from __future__ import annotations

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kelpline.functions import money, text, values
from kelpline.operators import decisions
from kelpline.plans import changes, evidence, history, matching
from kelpline.sources import landed, tables

FOLDER = "/root/testdata/sf0.001"


def test_first_wins_any_key_takes_all_events(spark):
    pytest.importorskip("duckdb")
    import duckdb

    rows = duckdb.sql(f"select event_id, user_id || '/' || ts::date, ts::date, value from '{FOLDER}/events.parquet' order by event_id").fetchall()
    amount = {r.event_id: r.a for r in spark.read.parquet(f"{FOLDER}/events.parquet").selectExpr("event_id", "cast(round(value, 0) as string) a").collect()}
    used, want = set(), []
    for i, day, _, _ in rows:
        own = {("day", day), ("amount", amount[i])}
        if not used & own:
            used |= own
            want.append(i)
    assert len(rows) == pq.read_metadata(f"{FOLDER}/events.parquet").num_rows
    assert sorted(r.event_id for r in matching.first_wins_any_key(spark, FOLDER).collect()) == want


def test_a_hot_block_is_counted(spark, tmp_path):
    rows = [(k, f"c{k}", 1, 0.0, "A") for k in range(3000)] + [(5000 + k, "d", 1, 0.25 * k, "A") for k in range(8)] + [(6000, "e", 2, 0.0, "A"), (6001, "e", 1, None, "A")]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    from itertools import combinations

    few = [0.25 * k for k in range(8)]
    want = 3000 * 2999 // 2 + 3000 * sum(v < 1 for v in few) + sum(abs(a - b) < 1 for a, b in combinations(few, 2))
    assert {tuple(r) for r in matching.blocking_pair_count(spark, str(tmp_path)).collect()} == {(1, want)}


def test_all_items_of_a_feed(spark):
    feed = "<rss>" + "".join(f"<item><title>T{k}</title><link>https://e.example.com/{k}</link></item>" for k in range(25)) + "</rss>"
    rows = spark.createDataFrame([("s", feed)], "source string, payload string")
    assert landed.rss_items(rows).count() == 25 and landed.rss_items(rows, most=20).count() == 20


def test_canonical_company_has_all_customers(spark, tmp_path):
    rows = [(k, f"Customer#{k:09d}") for k in (1, 500, 501, 70_000)]
    spark.createDataFrame(rows, "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    want = {(k, f"customer {k:09d}") for k, _ in rows}
    assert {tuple(r) for r in matching.canonical_company(spark, str(tmp_path)).collect()} == want


def test_applied_feed_with_more_customers_than_any_offset(spark, tmp_path):
    customers = [(k, "BUILDING", k % 25) for k in (1, 2, 100_001, 100_002, 200_001)]
    spark.createDataFrame(customers, "c_custkey long, c_mktsegment string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(9,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    orders = [(1, 1, "F"), (2, 1, "O"), (4, 100_001, "O"), (3, 100_001, "P"), (5, 200_001, "O"), (7, 3, "F"), (8, 3, "O")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    assert ("states", 4, 2) in {tuple(r) for r in changes.applied_feed(spark, str(tmp_path)).collect()}


def test_a_place_keeps_its_digits(spark):
    said = [("Location: Sector 0.",), ("Location: Sector 10.",), ("Location:  Sector 7 . Location: Sector 1.",)]
    got = spark.createDataFrame(said, "t string").select(decisions.residence_stated(F.col("t"))["field"].alias("f")).collect()
    assert [r.f for r in got] == ["sector 0", "sector 10", "sector 7 | sector 1"]


def test_first_seen_is_the_second_of_the_nearest_millisecond(spark, tmp_path):
    import duckdb

    rows = [(1, 1, "2024-01-19 23:30:37.999849", "view"), (2, 1, "2024-01-25 10:00:00.2", "view"), (3, 2, "2024-01-18 23:59:59.999499", "error"), (4, 2, "2024-01-26 00:00:00", "view")]
    t = spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string").withColumn("ts", F.to_timestamp_ntz("ts"))
    t.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = {tuple(r) for r in history.reconcile_events(spark, str(tmp_path)).select("user_id", "event", "entries", "first_seen").collect()}
    assert got == set(con.execute(f"select user_id, event, entries, first_seen from ({history.SQL['reconcile_events']})").fetchall()) and len(got) == 2


def test_narrow_tables_are_dealt_over_all_cores(spark, monkeypatch):
    parts = tables.table(spark, FOLDER, "part")
    rows = parts.count()
    dealt = tables.spread(parts, "p_partkey")
    assert parts.rdd.getNumPartitions() == 1 and dealt.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism and dealt.count() == rows
    monkeypatch.setattr(tables, "TASK_ROWS", 3)
    assert tables.spread(parts, "p_partkey").rdd.getNumPartitions() == -(-rows // 3)


def test_words_of_a_posting_are_lowered_and_cut_once(spark):
    plan = evidence.listing_projection(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(concat_ws(") == 1 and plan.count("[.,;:!?") == 1


def test_phrases_and_gaps_are_those_of_the_plain_patterns(spark):
    phrases = ["les", "of the", "c++", "(a) b", "creative  commons", "a", "", " ", "Les", "é", "a.c"]
    texts = ["", "les", "tables les", "tables", "les2", "2les", "_les_", "x of\n the y", "of thee", "roof the", "roof the of \t the", "c++", "cc++ c++x", "c++-", "(a) b", "z(a) b!", "creative\u00a0commons", "Creative commons", "abc a.c", "abc", " ", "a b", "\n", "caf\u00e9", "les\n", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in phrases:
        plain = r"\s+".join(text.re_escape(w) for w in p.lower().split())
        old = F.lower("t").rlike(f"(^|[^a-z0-9]){plain}([^a-z0-9]|$)") if p.isascii() else F.contains(F.lower("t"), F.lit(p))
        assert rows.where(~text.has_phrase("t", p).eqNullSafe(old)).count() == 0, p
    gaps = ["a  b", " a b ", "a \n b", "a\u00a0b", "a \u00a0 b", "\ufeffa", "a\tb\n", "a b", "  ", "\n \n", "a\x0b\x0c\r b"]
    got = spark.createDataFrame([(g,) for g in gaps], "t string").select(text.collapse("t"), F.trim(F.regexp_replace("t", r"[\s\x{00A0}\x{FEFF}]+", " "))).collect()
    assert all(new == old for new, old in got)


def test_each_step_of_reading_pay_is_written_once(spark):
    rows = spark.createDataFrame([("Pay: 75-90k EUR a year \ufdd0",), ("Pay 35,3k to 1.5m\u00a0USD",)], "t string")
    read = rows.select(money.pay(F.lit(""), F.col("t")).alias("p"))
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") < 40 and plan.count("regexp_replace(") < 40
    plan = rows.select(values.parse_amount("t").alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 1 and plan.count("regexp_replace(") == 2
    assert [(r.p.low, r.p.high, r.p.period) for r in read.collect()] == [(75000.0, 90000.0, "year"), (35300.0, 1500000.0, None)]
