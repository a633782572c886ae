"""Keyed state of streams: groups of keys give what each key by itself would."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kelpline.streaming import history, lifecycle

SCHEMA = "key long, at timestamp, status string"


def day(d: int, hour: float = 0) -> datetime:
    return datetime(2026, 1, d) + timedelta(hours=hour)


def in_batches(spark, folder, batches):
    """A stream whose batches are these lists of rows."""
    for k, rows in enumerate(batches):
        at = F.timestamp_micros((F.unix_micros(F.to_timestamp("at"))).cast("long")).alias("at")
        t = spark.createDataFrame([(key, str(at), status) for key, at, status in rows], "key long, at string, status string").select("key", at, "status")
        t.coalesce(1).write.mode("append").parquet(str(folder))
        for name in os.listdir(folder):
            path = f"{folder}/{name}"
            if name.endswith(".parquet") and os.path.getmtime(path) > 2_000_000:
                os.utime(path, (1_000_000 + k, 1_000_000 + k))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def told(rows):
    return sorted((str(r.key), str(r.at), r.event, str(r.from_status), r.to_status) for r in rows)


@pytest.mark.parametrize("groups", [1, 7])
def test_keys_of_a_group_follow_their_own_rows(spark, tmp_path, groups):
    batches = [
        [(1, day(1), "open"), (2, day(1), "open"), (None, day(1), "open"), (2, day(1, 1), "sold"), (2**60 + 1, day(1), "open"), (2**60, day(1), "source_error")],
        [(1, day(2), "sold"), (2, day(1, 0.5), "open"), (3, day(9), "open"), (2**60, day(2), "open"), (2**60 + 1, day(2), "open")],
        [(1, day(9), "open")],
    ]
    stream = in_batches(spark, tmp_path / "rows", batches).withWatermark("at", "1 day")
    started = []
    query = lifecycle.transitions(stream, 2, groups=groups).writeStream.foreachBatch(lambda t, _: started.extend(t.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = [
        ("1", str(day(1)), "first_seen", "None", "open"), ("1", str(day(2)), "status_changed", "open", "sold"), ("1", str(day(9)), "reappeared", "sold", "open"), ("2", str(day(1)), "first_seen", "None", "open"),
        ("2", str(day(1, 1)), "status_changed", "open", "sold"), ("2", str(day(3, 1)), "disappeared", "sold", "archived_missing"), ("3", str(day(9)), "first_seen", "None", "open"), ("None", str(day(1)), "first_seen", "None", "open"),
        ("None", str(day(3)), "disappeared", "open", "archived_missing"), (str(2**60), str(day(1)), "first_seen", "None", "source_error"), (str(2**60), str(day(2)), "source_recovered", "source_error", "open"),
        (str(2**60), str(day(4)), "disappeared", "open", "archived_missing"), (str(2**60 + 1), str(day(1)), "first_seen", "None", "open"), (str(2**60 + 1), str(day(4)), "disappeared", "open", "archived_missing"),
    ]
    assert told(started) == sorted(want)
    assert all(p.stateOperators[0].numRowsTotal <= groups + 1 for p in query.recentProgress)


@pytest.mark.parametrize("groups", [1, 7])
def test_histories_of_a_group_grow_by_themselves(spark, tmp_path, groups):
    early = [(1, str(day(1)), "open"), (1, str(day(1, 1)), "sold"), (2, str(day(1)), "open"), (None, str(day(1)), "open"), (4, str(day(1)), "sold")]
    table = spark.createDataFrame(early, "key long, at string, status string").withColumn("at", F.to_timestamp("at"))
    batches = [[(1, day(1, 0.5), "source_error"), (2, day(2), "sold"), (None, day(2), "source_error"), (2**60 + 1, day(2), "open")], [(2, day(8), "sold"), (2**60 + 1, day(3), "sold"), (1, day(2), "open"), (1, day(2, 1), "sold")]]
    stream = in_batches(spark, tmp_path / "rows", batches)
    checkpoint = history.run_to_state(history.histories(stream, history.snapshot_of(table, 2, 3), 2, 3, ttl_days=365, groups=groups), "test-history")
    got = {r.key: [(e.at, e.event, e.from_status, e.to_status) for e in r.history] for r in history.histories_in(spark, checkpoint).collect()}
    first = lambda status: (day(1), "first_seen", None, status)
    assert got == {
        1: [(day(1, 1), "status_changed", "open", "sold"), (day(2), "status_changed", "sold", "open"), (day(2, 1), "status_changed", "open", "sold")],
        2: [first("open"), (day(2), "status_changed", "open", "sold"), (day(8), "reappeared", "sold", "sold")], None: [first("open"), (day(2), "source_failed", "open", "source_error")], 4: [first("sold")],
        2**60 + 1: [(day(2), "first_seen", None, "open"), (day(3), "status_changed", "open", "sold")],
    }
    state = spark.read.format("statestore").option("stateVarName", "kept").load(checkpoint)
    assert state.select("key").distinct().count() <= groups + 1
