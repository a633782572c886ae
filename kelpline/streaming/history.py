"""Bounded histories of keys as keyed state: each key's last events live in a map state, which a snapshot can seed and a batch job can read.

Unlike `lifecycle.transitions`, whose state is a status, the state here is the history itself: what batch reconciliation keeps in
its rows.  A snapshot of that is the initial state of a stream, so that a job moves from batch to stream without a gap; the state
data source reads the histories back.  A key that has had no row for the time to live is forgotten, by the clock of the machine.
Keys are dealt into groups, whose rows of a batch Python gets at once; each key has its own entry in its group's map.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from kelpline.operators.resolve import staged
from kelpline.streaming import lifecycle as lc

EVENT = "at: long, event: string, from_status: string, to_status: string"
KEPT = f"status string, seen long, history array<struct<{EVENT}>>"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class History(StatefulProcessor):
    """State of a key of a group: its last status and time, and its last `limit` events, of which no two neighbours are equal."""

    def __init__(self, silence: int, limit: int, ttl_ms: int | None) -> None:
        self.silence, self.limit, self.ttl_ms = silence, limit, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("kept", "key long", KEPT, self.ttl_ms)

    def _grown(self, past: list[tuple], new: list[tuple]) -> list[tuple]:
        for event in new:
            if not past or past[-1] != event:
                past.append(event)
        return past[-self.limit :]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        t = initialState
        for own, status, seen, history in zip(t["key"].fillna(0).astype("int64").tolist(), t["status"], t["seen"].tolist(), t["history"], strict=True):
            past = [(int(e["at"]), e["event"], e["from_status"], e["to_status"]) for e in history]
            self.kept.updateValue((own,), (status, seen, past[-self.limit :]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = lc.batch_of(rows)
        kept = {own: row for own in new["key"].unique().tolist() if (row := self.kept.getValue((own,)))}
        known = pd.DataFrame({"key": np.array(list(kept), "int64"), "at": np.array([r[1] for r in kept.values()], "int64"), "status": np.array([r[0] for r in kept.values()], object)})
        found, last = lc.follow(new, known, self.silence)
        happened: dict[int, list[tuple]] = {}
        for own, *event in found.itertuples(index=False, name=None):
            happened.setdefault(own, []).append(tuple(event))
        for own, seen, status in last.itertuples(index=False, name=None):
            past = [tuple(e) for e in kept[own][2]] if own in kept else []
            self.kept.updateValue((own,), (status, seen, self._grown(past, happened.get(own, []))))
        yield found.assign(key=None) if key[0] == -1 else found

    def close(self) -> None:
        pass


def histories(rows: DataFrame, snapshot: DataFrame | None = None, silence_days: float = 14, limit: int = 24, ttl_days: float | None = None, groups: int = 1024) -> DataFrame:
    """rows (key long, at timestamp, status string), a stream -> its events; the state holds the histories.

    Rows of a key that come in one batch are taken in the order of time and status, older ones than the state are passed over.  snapshot
    (key, status, seen, history: the events so far): the state before the first batch.  ttl_days: how long a key without rows is kept.
    groups: into how many the keys are dealt.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    ttl = None if ttl_days is None else int(ttl_days * 86_400_000)
    group = lc.group_of("key", groups).alias("group")
    first = None
    if snapshot is not None:
        past = F.transform("history", lambda e: F.struct(F.unix_micros(e["at"]).alias("at"), *[e[c].alias(c) for c in ("event", "from_status", "to_status")]))
        first = snapshot.select(group, "key", "status", F.unix_micros("seen").alias("seen"), past.alias("history")).groupBy("group")
    mode = "none" if ttl is None else "processingTime"
    dealt = rows.where("at is not null").select(group, "key", F.unix_micros("at").alias("micros"), "status")
    found = dealt.groupBy("group").transformWithStateInPandas(History(int(silence_days * lc.DAY), limit, ttl), StructType.fromDDL(lc.OUT), "append", mode, first)
    return found.withColumn("at", F.timestamp_micros("at"))


def snapshot_of(rows: DataFrame, silence_days: float = 14, limit: int = 24) -> DataFrame:
    """rows (key, at, status), a table -> key, status, seen, history: what the stream's state would be after these rows.

    Rows that are equal in key, time and status follow each other like any others."""
    w = Window.partitionBy("key").orderBy("at", "status")
    t = rows.withColumn("was", F.lag("status").over(w)).withColumn("seen", F.lag("at").over(w))
    silent = F.unix_micros("at") - F.unix_micros("seen") > int(silence_days * 86_400_000_000)
    changed = F.col("status") != F.col("was")
    event = (
        F.when(F.col("was").isNull(), "first_seen").when(silent, "reappeared").when(changed & (F.col("status") == "source_error"), "source_failed")
        .when(changed & (F.col("was") == "source_error"), "source_recovered").when(changed, "status_changed")
    )
    happened = F.when(event.isNotNull(), F.struct("at", event.alias("event"), F.col("was").alias("from_status"), F.col("status").alias("to_status")))
    # Of each key only its last events are collected.
    t = t.withColumn("e", happened)
    back = F.sum(F.col("e").isNotNull().cast("int")).over(Window.partitionBy("key").orderBy(F.desc("at"), F.desc("status")))
    kept = t.withColumn("e", F.when(back <= limit, F.col("e")))
    return kept.groupBy("key").agg(F.max_by("status", F.struct("at", "status")).alias("status"), F.max("at").alias("seen"), F.array_sort(F.collect_list("e")).alias("history"))


def run_to_state(stream: DataFrame, name: str) -> str:
    """Runs the stream over all that there is now and returns its checkpoint, in the shared folder, which holds the state.

    A state with a time to live asks for batches without data for ever; none is run here, so that the stream ends."""
    spark = stream.sparkSession
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(idle, None)
    spark.conf.set(idle, "false")
    root = staged(spark.createDataFrame([(name,)], "name string"), f"stream-{name}").inputFiles()[0].rsplit("/", 1)[0]
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}-checkpoint").trigger(availableNow=True).start(f"{root}-out")
    try:
        query.awaitTermination()
    finally:
        spark.conf.unset(idle) if before is None else spark.conf.set(idle, before)
    return f"{root}-checkpoint"


def histories_in(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key, history: the events that the state in a checkpoint holds, in their order."""
    state = spark.read.format("statestore").option("stateVarName", "kept").load(checkpoint)
    lasting = "ttlExpirationMs" in state.schema["user_map_value"].dataType.names  # a time to live stands beside each value
    past = F.col("user_map_value.value.history" if lasting else "user_map_value.history")
    parts = ("event", "from_status", "to_status")
    history = F.transform(past, lambda e: F.struct(F.timestamp_micros(e["at"]).alias("at"), *[e[c].alias(c) for c in parts]))
    return state.select(F.when(F.col("key.group") >= 0, F.col("user_map_key.key")).alias("key"), history.alias("history"))
