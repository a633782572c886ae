from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kelpline.operators import evidence, joins, lifecycle, metrics, resolve, rules, state
from kelpline.sources import landed, sinks

def now():
    return F.lit("2026-01-31 00:00:00").cast("timestamp")


def test_first_wins_any_key_is_sequential(spark):
    df = spark.createDataFrame([(1, "u1", "r1"), (2, "u2", "r1"), (3, "u2", "r3"), (4, None, None)], "id int, url string, role string")
    assert sorted(r.id for r in resolve.first_wins_any_key(df, "id", ["url", "role"]).collect()) == [1, 3, 4]


def test_first_wins_any_key_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(i, f"u{rng.randint(0, 60)}", f"r{rng.randint(0, 60)}") for i in range(150)]
    used, want = set(), []
    for i, u, r in rows:
        if not used & {u, r}:
            used |= {u, r}
            want.append(i)
    df = spark.createDataFrame(rows, "id int, url string, role string")
    assert sorted(r.id for r in resolve.first_wins_any_key(df, "id", ["url", "role"]).collect()) == want


def test_greedy_clusters_compare_with_the_first_only(spark):
    df = spark.createDataFrame([(1, "b", 0), (2, "b", 5), (3, "b", 9), (4, "c", 9)], "id int, block string, x int")
    out = resolve.greedy_clusters(df, "id", ["block"], ["id"], lambda h, r: F.abs(F.col(f"{h}.x") - F.col(f"{r}.x")) <= 5)
    assert {r.id: r.cluster for r in out.collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def greedy_by_loop(rows, ok):
    heads, out = {}, {}
    for i, b, x in sorted(rows):
        own = heads.setdefault(b, [])
        out[i] = next((h for h, y in own if ok(y, x)), i)
        if out[i] == i:
            own.append((i, x))
    return out


@pytest.mark.parametrize("most", [16, 2048])
def test_greedy_clusters_against_a_loop(spark, most):
    """Chains, dense clusters and lone rows; the condition is neither symmetric nor transitive."""
    rng = random.Random(most)
    rows = [(i, rng.choice("abc"), rng.choice([rng.randint(0, 60), i, 1000 + i // 3, 7])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, block string, x int")
    near = lambda h, r: (F.col(f"{r}.x") - F.col(f"{h}.x")).between(-2, 4)
    out = resolve.greedy_clusters(df, "id", ["block"], ["id"], near, most=most)
    assert {r.id: r.cluster for r in out.collect()} == greedy_by_loop(rows, lambda y, x: -2 <= x - y <= 4)


def test_a_block_of_many_clusters_takes_few_rounds(spark, monkeypatch):
    rounds = []
    own = resolve.staged
    monkeypatch.setattr(resolve, "staged", lambda df, name: (rounds.append(name), own(df, name))[1])
    df = spark.range(10_000).select(F.col("id"), F.lit(1).alias("block"))
    out = resolve.greedy_clusters(df, "id", ["block"], ["id"], lambda h, r: F.col(f"{h}.id") == F.col(f"{r}.id") - 5000)
    assert out.where("cluster = id % 5000").count() == 10_000 and rounds.count("taken") < 20


def test_large_blocks_are_paired_by_the_condition(spark):
    df = spark.range(3000).withColumn("k", F.lit(1))
    pairs = resolve.blocking_pairs(df, "id", [F.col("k")], lambda a, b: F.col(f"{b}.id") - F.col(f"{a}.id") == 1)
    assert pairs.count() == 2999


def test_no_bounds_on_aliases_slots_and_contexts(spark):
    df = spark.createDataFrame([(1, "From New York City Hall to it, label: " + "x" * 300 + "\nyou must, must not, must")], "id int, t string")
    names = spark.createDataFrame([("york", "a"), ("new york city hall", "b"), ("New York", "c")], "alias string, name string")
    assert joins.longest_alias(df, "id", "t", names, "name").first().name == "b"
    row = df.select(evidence.slot("t", "label").alias("a"), evidence.slot("t", "label", most=10).alias("b"), evidence.contexts("t", "must", 5, 5).alias("c")).first()
    assert row.a == "x" * 300 and row.b == "x" * 10 and list(row.c) == ["\nyou must, mus", "ust, must not,", "not, must"]


def test_prioritised_lookup_owners(spark):
    left = spark.createDataFrame([(1, ["a"], ["x"]), (2, ["z"], ["x"]), (3, [], None)], "id int, own array<string>, url array<string>")
    right = spark.createDataFrame([(10, ["a"], ["q"]), (11, ["b"], ["x"]), (12, ["c"], ["x"])], "rid int, own array<string>, url array<string>")
    keys = [F.col("own"), F.col("url")]
    assert {(r.id, r.rid) for r in joins.prioritised(left, "id", keys, right, "rid", keys).collect()} == {(1, 10), (2, 11)}
    assert {(r.id, r.rid) for r in joins.prioritised(left, "id", keys, right, "rid", keys, last_writer=True).collect()} == {(1, 10), (2, 12)}


def test_history_is_bounded_and_skips_repeats(spark):
    event = F.struct(now().alias("at"), F.lit("e").alias("event"), F.lit(None).cast("string").alias("from_status"), F.lit("open").alias("to_status")).cast(lifecycle.EVENT)
    other = event.withField("event", F.lit("f"))
    df = spark.range(1).withColumn("h", F.array_repeat(other, 30)).select(
        F.size(lifecycle.append_limited(F.col("h"), event)).alias("a"), F.size(lifecycle.append_limited(F.array(event), event)).alias("b"),
        F.size(lifecycle.append_limited(F.lit(None).cast(f"array<{lifecycle.EVENT}>"), event)).alias("c"), F.size(lifecycle.append_limited(F.array(event), F.lit(None).cast(lifecycle.EVENT))).alias("d"),
    )
    assert tuple(df.first()) == (24, 1, 1, 1)


def test_missing_rows_are_carried_for_a_time(spark):
    day = lambda n: dt.datetime(2026, 1, 31) - dt.timedelta(days=n)
    previous = spark.createDataFrame([("a", "open", None), ("b", "open", day(14)), ("c", "open", day(15)), ("d", "expired", None), ("e", "open", None)], "id string, status string, missing_since timestamp")
    out = lifecycle.carry_missing(spark.createDataFrame([("e",)], "id string"), previous, "id", now())
    assert {(r.id, r.event) for r in out.collect()} == {("a", "disappeared"), ("b", None)}


def test_three_states_part_the_keys(spark):
    previous = spark.createDataFrame([("a", "s", "seen"), ("b", "t", "not_seen"), ("c", "t", "seen"), ("d", "s", "seen")], "id string, source string, state string")
    current = spark.createDataFrame([("a", "s")], "id string, source string")
    out = lifecycle.three_states(previous, current, "id", "source", spark.createDataFrame([("s", True), ("t", False)], "source string, ok boolean"))
    assert {r.id: r.state for r in out.collect()} == {"a": "seen", "b": "not_seen", "c": "unverified", "d": "not_seen"}


def test_aliases_are_carried(spark):
    previous = spark.createDataFrame([("old", ["older"]), ("x", [])], "id string, legacy array<string>")
    current = spark.createDataFrame([("new", ["old"]), ("y", None)], "id string, legacy array<string>")
    assert {r.id: r.legacy for r in lifecycle.carry_aliases(current, previous, "id", "legacy").collect()} == {"new": ["old", "older"], "y": []}


def test_guard_blocks_and_raises(spark):
    base = spark.createDataFrame([(i, "s", False) for i in range(10)], "id int, source string, explained boolean")
    bad = metrics.collapse_guard(base, spark.createDataFrame([(1,), (2,)], "id int"), "id", "source")
    with pytest.raises(RuntimeError, match="lost too much"):
        metrics.require_unblocked(bad)
    metrics.require_unblocked(metrics.collapse_guard(base, base.select("id"), "id", "source"))


def test_three_way_merge_keeps_what_others_did(spark):
    t = lambda rows: spark.createDataFrame(rows, "k string, value string")
    out = state.three_way_merge(t([("a", "1"), ("b", "9"), ("d", "4")]), t([("a", "1"), ("b", "2"), ("c", "3")]), t([("b", "2"), ("c", "5"), ("e", None)]), ["k"])
    assert {(r.k, r.value) for r in out.collect()} == {("b", "9"), ("c", "5"), ("d", "4"), ("e", None)}


def test_rules(spark):
    df = spark.createDataFrame([(5,), (None,)], "x int")
    out = df.select(rules.score([(F.col("x") > 1, 150)], caps=[(F.col("x") > 3, 19)]).alias("s"), rules.exactly_one([("a", F.col("x") > 1), ("b", F.col("x") > 2)]).alias("k"))
    assert [tuple(r) for r in out.collect()] == [(19, "mixed"), (0, None)]


def test_rss_and_statuses(spark):
    feed = "<rss><item><title>Acme: Dev &amp; Ops</title><link>https://e.example.com/1</link></item><item><title>Plain</title></item></rss>"
    rows = spark.createDataFrame([("s", 1, feed), ("s", 2, "junk"), ("t", 3, "")], "source string, payload_id int, payload string")
    items = landed.rss_items(rows)
    assert [(r.company, r.title) for r in items.orderBy("pos").collect()] == [("Acme", "Dev & Ops"), (None, "Plain")]
    assert {r.source: r.status for r in landed.decode_status(rows, items).collect()} == {"s": "partial", "t": "error"}


def test_versions(spark, tmp_path):
    root = str(tmp_path / "feed")
    assert sinks.read_current(spark, root) is None
    ok = spark.createDataFrame([("s", "ok")], "source string, status string")
    assert sinks.commit_if_any(spark.range(3), ok, root, "r1")
    assert not sinks.commit_if_any(spark.range(9), ok.where("status = 'error'"), root, "r2")
    assert sinks.read_current(spark, root).count() == 3
    sinks.write_version(spark.range(5), root, "r3")
    assert sinks.read_current(spark, root).count() == 5


def test_merge_is_idempotent(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 7), (2, 3, 1)], "cluster int, id int, x int").withColumn("n", F.lit(1))
    step = lambda d: resolve.survivors(d, "cluster", [F.col("id")], counts=["n"]).select("cluster", "id", "x", "n")
    assert resolve.until_stable(df, step).count() == 2


def test_curated_rows_are_reason_enough_to_write(spark, tmp_path):
    root = str(tmp_path / "feed")
    failed = spark.createDataFrame([("s", "error")], "source string, status string")
    curated = lambda *rows: spark.createDataFrame(list(rows), "id long, withdrawn boolean")
    sinks.write_version(spark.range(3), root, "r1")
    assert not sinks.commit_if_any(spark.range(3), failed, root, "r2", curated((1, False), (9, True)))
    assert sinks.commit_if_any(spark.range(4), failed, root, "r3", curated((3, False)))
    assert sinks.commit_if_any(spark.range(3), failed, root, "r4", curated((3, True)))
    assert sinks.read_current(spark, root).count() == 3


def test_readers_see_a_version_at_any_time(spark, tmp_path):
    import json
    import threading

    root, bad, done = tmp_path / "feed", [], threading.Event()
    sinks.write_version(spark.range(1), str(root), "r0")

    def read():
        while not done.is_set():
            try:
                json.loads((root / "CURRENT.json").read_text())
            except (OSError, ValueError) as e:
                bad.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(1, 6):
        sinks.write_version(spark.range(k), str(root), f"r{k}")
    done.set()
    reader.join()
    assert not bad and sinks.read_current(spark, str(root)).count() == 5


def test_state_and_caches_can_be_read_back(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None), (3, "c")], "id long, value string")
    sinks.export_state({"states": df}, str(tmp_path / "out"))
    back = sinks.import_state(spark, str(tmp_path / "out"), {"states": "id long, value string", "none": "id long"})
    assert sorted(tuple(r) for r in back["states"].collect()) == [(1, None), (2, "b"), (3, "c")] and back["none"].count() == 0
    sinks.save_cache(spark.createDataFrame([("b", 1), ("a", 2), ("b", 3)], "address string, lat int"), str(tmp_path / "cache"), "address")
    assert [r.value for r in spark.read.text(str(tmp_path / "cache")).collect()] == ['{"address":"a","lat":2}', '{"address":"b","lat":3}']


def test_backups_are_taken_whole_or_not(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, v string")
    rows, report = state.accepted_backup(df, [("no value", F.col("v").isNull())])
    assert rows.count() == 0 and [tuple(r) for r in report.collect()] == [("no value", 1)]
    assert state.accepted_backup(df, [("id", F.col("id") < 0)])[0].count() == 2


def test_functions_of_sql(spark):
    from kelpline.functions.registered import register

    register(spark)
    html = '<script type="application/ld+json">[{"@type":"JobPosting","identifier":7,"title":"t","hiringOrganization":{"name":"c"}},{"@graph":[{"@type":"JobPosting","title":"u"}]}]</script><script type="application/ld+json">{</script>'
    spark.createDataFrame([(html,), (None,)], "html string").createOrReplaceTempView("own_pages")
    rows = spark.sql("SELECT j.* FROM own_pages, LATERAL json_ld_postings(html) j").collect()
    assert [tuple(r) for r in rows] == [("7", "t", "c"), (None, "u", None)]
    assert spark.sql("SELECT nfkc('ﬁ') AS a, html_unescape('&eacute;') AS b").first() == ("fi", "é")


def test_other_helpers(spark):
    from kelpline.operators import filters

    df = spark.createDataFrame([(1, ["a"], "x"), (2, None, "a"), (3, ["b"], "a")], "id int, many array<string>, one string")
    assert sorted(r.id for r in df.where(filters.member("many", "one")("a")).collect()) == [1, 2]
    kept, lost = filters.split_by_reason(df, [("many", F.col("id") > 1), ("last", F.col("id") > 2)])
    assert [r.id for r in kept.collect()] == [1] and {(r.id, r.reason) for r in lost.collect()} == {(2, "many"), (3, "many")}
    out = landed.union_sources([("s", spark.createDataFrame([(0, "p")], "pos int, v string")), ("t", spark.createDataFrame([(0, "q")], "pos int, w string"))])
    assert {(r.source, r.source_ord, r.row_ord, r.v, r.w) for r in out.collect()} == {("s", 0, 0, "p", None), ("t", 1, 0, None, "q")}
    saved = spark.createDataFrame([("u", dt.datetime(2026, 1, 1, 10), 1), ("u", dt.datetime(2026, 1, 1, 11), 2), ("v", dt.datetime(2026, 1, 1, 1), 3)], "request string, saved_at timestamp, body int")
    assert [tuple(r) for r in landed.cached_responses(saved, F.lit("2026-01-01 11:30:00"), 2).select("request", "body").collect()] == [("u", 2)]


def test_batches_of_a_stream_make_one_version_each(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/versions"
    batch = lambda *rows: spark.createDataFrame(rows, "id int, at int, v string")
    rows = lambda: sorted(map(tuple, sinks.read_current(spark, root).collect()))
    commit = lambda df, k: sinks.commit_batch(df, k, root, "id", ["at"])
    assert commit(batch((1, 1, "a"), (1, 2, "b"), (2, 1, "c")), 0) and rows() == [(1, 2, "b"), (2, 1, "c")]
    assert not commit(batch((1, 9, "twice")), 0) and rows() == [(1, 2, "b"), (2, 1, "c")]
    point = sinks._point
    monkeypatch.setattr(sinks, "_point", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        commit(batch((3, 1, "half")), 1)
    assert rows() == [(1, 2, "b"), (2, 1, "c")]
    monkeypatch.setattr(sinks, "_point", point)
    assert commit(batch((3, 1, "d"), (2, 0, "late")), 1) and rows() == [(1, 2, "b"), (2, 1, "c"), (3, 1, "d")]
    assert sorted(p.name for p in (tmp_path / "versions").glob("run_id=*")) == ["run_id=batch-000000000000", "run_id=batch-000000000001"]
