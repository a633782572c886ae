"""The listing lifecycle and event-time windows as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kelpline.operators.resolve import staged

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
OUT = "key long, at long, event string, from_status string, to_status string"
STATE = "keys array<long>, statuses array<string>, seen array<long>"
FILE_ROWS = 1_000_000  # events in a file of a part, about
GROUP_KEYS = 500  # keys in a group of state, about
DAY = 86_400_000_000


def group_of(key: Column | str, groups: int) -> Column:
    """The group of state that a key is in; no key is in a group of its own, -1."""
    key = F.col(key) if isinstance(key, str) else key
    return F.when(key.isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(groups)).cast("int"))


def groups_for(table: DataFrame, key: str) -> int:
    """How many groups of about GROUP_KEYS keys a table's keys make, some for each core at least."""
    keys = table.agg(F.approx_count_distinct(key)).first()[0]
    return max(4 * table.sparkSession.sparkContext.defaultParallelism, -(-keys // GROUP_KEYS))


def batch_of(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A group's rows of a batch, key, at and status; no key, which is alone in its group, is 0."""
    t = pd.concat(list(frames), ignore_index=True)[["key", "micros", "status"]].rename(columns={"micros": "at"})
    return t.assign(key=t["key"].fillna(0).astype("int64"))


def follow(new: pd.DataFrame, known: pd.DataFrame, silence: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Rows (key, at, status) of many keys, after each key's last row so far -> events, and each key's last row now.

    Times and the silence are in microseconds.  A key's rows are taken in the order of time and status; rows older than its last one are passed over."""
    t = pd.concat([known.assign(new=False), new.assign(new=True)], ignore_index=True)
    t = t.sort_values(["key", "new", "at", "status"], kind="stable", ignore_index=True)
    follows = lambda x: np.append(False, x[1:] == x[:-1])[: len(x)]
    key, at, fresh = t["key"].to_numpy(), t["at"].to_numpy(), t["new"].to_numpy()
    head = np.maximum.accumulate(np.where(follows(key), 0, np.arange(len(t))))
    t = t[~(~fresh[head] & (at < at[head]))]
    key, at, status, fresh = (t[c].to_numpy() for c in ("key", "at", "status", "new"))
    same = follows(key)
    was = np.where(same, np.append(None, status[:-1])[: len(t)], None)
    gap = same & (np.append(0, np.diff(at))[: len(t)] > silence)
    event = np.full(len(t), "status_changed", dtype=object)
    rules = [(pd.isna(was), "first_seen"), (gap, "reappeared"), (status == was, None), (status == "source_error", "source_failed"), (was == "source_error", "source_recovered")]
    for holds, name in reversed(rules):
        event[holds] = name
    found = pd.DataFrame({"key": key, "at": at, "event": event, "from_status": was, "to_status": status})[fresh & ~pd.isna(event)]
    return found, t.loc[np.append(~same[1:], True)[: len(t)], ["key", "at", "status"]]


def transitions(rows: DataFrame, silence_days: int = 14, groups: int = 1024) -> DataFrame:
    """rows (key long, at timestamp, status string) with a watermark on `at` -> lifecycle events.

    State is a key's last status and time.  first_seen; source_failed, source_recovered or
    status_changed; reappeared after more than `silence_days` days, which excludes the others; and
    disappeared, by an event-time timer, when the watermark passes that time.  Rows of a key that come in one batch are taken
    in the order of time; rows older than the state are passed over.

    Keys are dealt into `groups`, whose state and rows Python gets at once: a call for each key costs more than its few rows.
    """
    span = silence_days * DAY

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, statuses, seen = state.get if state.exists else ([], [], [])
        last = pd.DataFrame({"key": np.array(keys, "int64"), "at": np.array(seen, "int64"), "status": np.array(statuses, object)})
        out = []
        if not state.hasTimedOut:
            found, last = follow(batch_of(frames), last, span)
            out.append(found)
        gone = (last["at"] + span) // 1000 < state.getCurrentWatermarkMs()
        if gone.any():
            old, last = last[gone], last[~gone]
            out.append(pd.DataFrame({"key": old["key"], "at": old["at"] + span, "event": "disappeared", "from_status": old["status"], "to_status": "archived_missing"}))
        if len(last):
            state.update((last["key"].tolist(), last["status"].tolist(), last["at"].tolist()))
            state.setTimeoutTimestamp(max((int(last["at"].min()) + span) // 1000, state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        for t in out:
            yield t.assign(key=None) if group[0] == -1 else t

    dealt = rows.where("at is not null").select("at", "key", F.unix_micros("at").alias("micros"), "status", group_of("key", groups).alias("group"))
    found = dealt.groupBy("group").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumn("at", F.timestamp_micros("at"))


def windowed(rows: DataFrame, length: str, slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """rows (at timestamp, kind, value) -> counts and sums by tumbling or sliding window and kind."""
    w = F.window("at", length, slide) if slide else F.window("at", length)
    t = rows.withWatermark("at", delay).groupBy(w.alias("w"), "kind").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return t.select(F.col("w.start").alias("start"), "kind", "n", "total")


def sessions(rows: DataFrame, gap: str, delay: str = "1 day") -> DataFrame:
    """rows (at timestamp, key) -> sessions of a key that a gap ends."""
    t = rows.withWatermark("at", delay).groupBy(F.session_window("at", gap).alias("w"), "key").agg(F.count("*").alias("n"))
    return t.select("key", F.col("w.start").alias("start"), "n")


def event_stream(spark: SparkSession, folder: str, batches: int = 1) -> DataFrame:
    """The events table as a stream: as it is, or in `batches` parts in the order of time, each with more rows than files."""
    if batches == 1:
        return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(folder)
    events = spark.read.parquet(f"{folder}/events.parquet")
    cut = events.select(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [k / batches for k in range(1, batches)]).alias("c")).first().c
    part = F.lit(1)
    for edge in cut:
        part = part + (F.unix_micros(F.col("ts").cast("timestamp")) > edge).cast("int")
    parts = staged(events.withColumn("part", part), "event-parts")
    root = f"{parts.inputFiles()[0].rsplit('/', 1)[0]}-stream"
    # Each part is as many files as the largest needs; the stream takes a part's files in one batch.
    most = parts.groupBy("part").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    files = max(1, -(-most // FILE_ROWS))
    for k in range(1, batches + 1):
        parts.where(F.col("part") == k).drop("part").repartition(files).write.mode("append").parquet(root)
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(root)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs the stream over all that there is now, into a table in the shared folder, and reads that."""
    spark = stream.sparkSession
    root = staged(spark.createDataFrame([(name,)], "name string"), f"stream-{name}").inputFiles()[0].rsplit("/", 1)[0]
    out, checkpoint = f"{root}-out", f"{root}-checkpoint"
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
