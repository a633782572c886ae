"""What the operators share: staging of intermediate tables and scans of whole texts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: space and the ASCII controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of whole texts in one Arrow batch: keeps a worker's memory to a few MB of text.
TEXT_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Settings for tables of whole texts: few rows at a time in Parquet and Arrow batches, whose
    memory long texts would otherwise multiply.  Python workers of this machine can import the package from where the driver did."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(TEXT_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, object]):
    """Session settings for the jobs that run inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one where none is named (local tests)."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = getattr(spark.sparkContext, "_kelpline_dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster must name its shared folder in spark.checkpoint.dir")
        root = tempfile.mkdtemp(prefix="kelpline-")
        spark.sparkContext._kelpline_dir = root
    return root.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back.

    This cuts the lineage, so that a lost executor costs no recomputation of what
    came before, and gives the planner true sizes to choose joins by.
    """
    spark = df.sparkSession
    prepare(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def map_texts(
    docs: DataFrame,
    columns: list[str | Column],
    fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """mapInArrow over (columns..., text as UTF-8 bytes), in batches of few rows."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(as_bytes(b) for b in batches)

    return docs.select(*columns, "text").mapInArrow(run, schema)


def as_bytes(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The last column's texts as UTF-8 bytes, without a copy."""
    texts = batch.column(batch.num_columns - 1)
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], texts.cast(pa.binary())], names=batch.schema.names)


def least_id(id_col: str, row: str | None = None) -> Column:
    """Aggregate: the row with the smallest id, nulls last, ties by row."""
    parts = [F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id")]
    if row:
        parts.append(F.col(row).alias("row"))
    return F.min(F.struct(*parts))


#: A table of fewer bytes, counted in full, may be broadcast; beyond it joins shuffle.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint, if the staged table df takes few bytes; otherwise df as it is."""
    n, width = F.count("*").alias("n"), F.lit(0)
    for name, kind in df.dtypes:
        size = F.octet_length(name) if kind in ("string", "binary") else 8 * F.greatest(F.size(name), F.lit(0)) if kind.startswith("array") else F.lit(0)
        width = width + F.coalesce(size, F.lit(0)) + 16
    got = df.agg(n, F.sum(width.cast("long")).alias("bytes")).first()
    return F.broadcast(df) if (got.bytes or 0) <= BROADCAST_BYTES else df


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """Rows as one struct `own` beside keys, so that joins cannot clash with any column of docs; `own.*` unpacks them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), *[k.alias(name) for name, k in keys.items()])


def bounded_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """About `rows` rows of the staged df at most, picked by a hash of the keys: reruns agree."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(2**32)) < int(rows / n * 2**32))


def bounded_rows(df: DataFrame, rows: int) -> DataFrame:
    """df, each of its rows once, and about twice `rows` of them at most: for rows that a bounded sample of ids brings, as
    an id may have any number of rows."""
    return bounded_sample(stage(df.distinct(), "sample-rows"), 2 * rows, *df.columns)
