"""Versioned tables: a version is written whole, then a pointer is swapped."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_version(df: DataFrame, root: str, run_id: str) -> None:
    """Writes root/run_id=..., checks that all rows can be read, and points root/CURRENT.json at it by one renaming that overwrites.

    A reader sees the old version or the new one; a failed write leaves the old one.
    """
    spark = df.sparkSession
    path = f"{root}/run_id={run_id}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    back, wrote = spark.read.schema(df.schema).parquet(path).count(), seen.get["rows"]
    if back != wrote:
        raise OSError(f"{path} has {back} of {wrote} rows")
    _point(spark, root, run_id)


def _point(spark: SparkSession, root: str, run_id: str) -> None:
    text = json.dumps({"run_id": run_id}).encode()
    fs, fresh = _fs(spark, f"{root}/CURRENT.{run_id}.tmp")
    _, pointer = _fs(spark, f"{root}/CURRENT.json")
    if fs.getUri().getScheme() == "file":  # whose Hadoop classes delete the old file before they rename
        new, old = (Path(p.toUri().getPath()) for p in (fresh, pointer))
        new.write_bytes(text)
        os.replace(new, old)
        return
    out = fs.create(fresh, True)
    out.write(bytearray(text))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(fresh), fs.makeQualified(pointer), how)


def read_current(spark: SparkSession, root: str) -> DataFrame | None:
    """The version that the pointer names, or None."""
    run_id = current_run(spark, root)
    return None if run_id is None else spark.read.parquet(f"{root}/run_id={run_id}")


def current_run(spark: SparkSession, root: str) -> str | None:
    fs, pointer = _fs(spark, f"{root}/CURRENT.json")
    return spark.read.json(f"{root}/CURRENT.json").first().run_id if fs.exists(pointer) else None


def commit_batch(batch: DataFrame, batch_id: int, root: str, key: str, order: list[str]) -> bool:
    """A micro-batch becomes the next version: the current rows, and those of the batch in the place of rows of their key.

    Of a key's rows in a batch, and of a row that is held and one that comes, the last by the order stays, so that late rows change nothing.  A batch that is delivered
    again after its version was pointed at is passed over; one that was killed half-way wrote a folder that nothing points at, and is
    written anew.  So each batch makes one version.  True if it did."""
    spark, run = batch.sparkSession, f"batch-{batch_id:012d}"
    now = current_run(spark, root)
    if now is not None and now >= run:
        return False
    held = read_current(spark, root)
    rows = batch if held is None else held.unionByName(batch.select(*held.columns))
    rest = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order, *rest)).alias("own")).select(key, "own.*")
    write_version(last.select(*rows.columns), root, run)
    return True


def upsert_stream(stream: DataFrame, root: str, key: str, order: list[str], checkpoint: str):
    """Starts a query that commits each micro-batch of the stream as a version of root, over all that there is now."""
    commit = lambda batch, batch_id: commit_batch(batch, batch_id, root, key, order)
    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_lines(df: DataFrame, path: str, order: list[str]) -> None:
    """One JSON line a row in a total order, null fields kept: equal tables give equal text."""
    row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")
    df.orderBy(*order).select(row).write.mode("overwrite").text(path)


def commit_if_any(df: DataFrame, statuses: DataFrame, root: str, run_id: str, curated: DataFrame | None = None, key: str = "id") -> bool:
    """Keep-last-good: nothing is written unless some source succeeded, or the curated rows (key, withdrawn) are others than the
    current version's: a new one, or one withdrawn that it still holds."""
    if statuses.where("status in ('ok', 'partial')").isEmpty():
        if curated is None:
            return False
        current = read_current(df.sparkSession, root)
        kept, gone = curated.where(~F.coalesce("withdrawn", F.lit(False))), curated.where("withdrawn")
        if current is not None and kept.join(current, key, "left_anti").isEmpty() and gone.join(current, key, "left_semi").isEmpty():
            return False
    write_version(df, root, run_id)
    return True


def export_state(tables: Mapping[str, DataFrame], path: str, key: str = "id") -> None:
    """User state as JSON lines in one total order, a folder for each table: what write_lines wrote can be read back."""
    for name, df in tables.items():
        write_lines(df, f"{path}/{name}", [key, *[c for c in df.columns if c != key]])


def import_state(spark: SparkSession, path: str, schemas: Mapping[str, str]) -> dict[str, DataFrame]:
    """The tables of an export; one whose folder lacks is empty."""
    out = {}
    for name, schema in schemas.items():
        fs, folder = _fs(spark, f"{path}/{name}")
        out[name] = spark.read.schema(schema).json(f"{path}/{name}") if fs.exists(folder) else spark.createDataFrame([], schema)
    return out


def save_cache(df: DataFrame, path: str, key: str) -> None:
    """A keyed cache, sorted by its key: of rows of one key the last by every column stays."""
    rest = [c for c in df.columns if c != key]
    write_lines(df.groupBy(key).agg(F.max(F.struct(*rest)).alias("own")).select(key, "own.*"), path, [key])
