"""Exact dedup by content-defined chunk recipes.

A text is cut into chunks where a rolling hash of the last 32 bytes says so; a document
becomes the ordered list of its chunks' identifiers, its recipe.  Only recipes are shuffled
and compared.  Chunk bytes move once, and only those of documents whose recipe another
document shares: each distinct chunk of theirs is sent once by each map task, and an
identifier whose bytes differ somewhere is split, so that equal recipes mean equal texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import SPACE, map_texts, packed, small, stage

MEAN_BITS = 10  # a cut on average every 1024 bytes after the least size
LEAST, MOST = 256, 8192
_GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)


def normalise(text: bytes) -> bytes:
    """Each run of white space becomes one space; bytes.split() knows the same six characters."""
    parts = text.split()
    out = b" ".join(parts)
    if text[:1].isspace():
        out = b" " + out
    if parts and text[-1:].isspace():
        out += b" "
    return out


def cuts(data: np.ndarray) -> np.ndarray:
    """Offsets after which the rolling hash of 32 bytes allows a cut."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8, 16):
        grown = h.copy()
        grown[width:] += h[:-width] << np.uint32(width)
        h = grown
    return np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1


def chunk_ends(size: int, allowed: np.ndarray) -> list[int]:
    ends, start, at = [], 0, 0
    while size - start > LEAST:
        at += int(np.searchsorted(allowed[at:], start + LEAST))
        end = min(int(allowed[at]) if at < len(allowed) else size, start + MOST, size)
        ends.append(end)
        start = end
    if start < size:
        ends.append(size)
    return ends


def chunks(text: bytes) -> list[bytes]:
    ends = chunk_ends(len(text), cuts(np.frombuffer(text, np.uint8)) if len(text) > LEAST else np.empty(0, int))
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _recipes(bits: int):
    mask = (1 << bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, sha, recipe = [], [], []
            for text in batch.column(1).to_pylist():
                text = normalise(text or b"")
                size.append(len(text))
                sha.append(hashlib.sha256(text).digest())
                ids = [xxhash.xxh3_64_intdigest(c) & mask for c in chunks(text)]
                recipe.append([i - (1 << 64) if i >> 63 else i for i in ids])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(sha, pa.binary()), pa.array(recipe, pa.list_(pa.int64()))],
                ["doc_id", "n_bytes", "sha", "recipe"],
            )

    return run


def _chunk_rows(bits: int):
    mask = (1 << bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha, seq, ids, data = [], [], [], []
            for text in batch.column(0).to_pylist():
                text = normalise(text or b"")
                whole = hashlib.sha256(text).digest()
                for k, c in enumerate(chunks(text)):
                    i = xxhash.xxh3_64_intdigest(c) & mask
                    sha.append(whole)
                    seq.append(k)
                    ids.append(i - (1 << 64) if i >> 63 else i)
                    data.append(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sha, pa.binary()), pa.array(seq, pa.int32()), pa.array(ids, pa.int64()), pa.array(data, pa.binary())],
                ["sha", "seq", "chunk", "bytes"],
            )

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", bits: int = 64) -> DataFrame:
    """docs (id_col, text) -> doc_id, keep_id, group_size, kept, text_sha256, n_bytes, n_chunks.

    Texts are equal when they are after each run of white space became one space; null is
    the empty text.  Of equal texts the row of the smallest id stays, a null id coming last;
    of rows that repeat an id with its text one stays.  Texts are read whole, however long: a chunk has a
    greatest size.  An empty table gives an empty result; other columns are not read and may have any name.
    bits: width of a chunk's identifier before it is verified (tests make it small).
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text")
    recipes = stage(
        map_texts(base, ["doc_id"], _recipes(bits), "doc_id long, n_bytes long, sha binary, recipe array<bigint>").withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "recipes",
    )
    shared = stage(recipes.groupBy("n_bytes", "recipe").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "shared")
    suspects = stage(recipes.join(shared, ["n_bytes", "recipe"], "left_semi").select(F.col("doc_id").alias("suspect")).distinct(), "suspects")

    # One row from each task for each distinct chunk of the suspects; an identifier with two contents is split.
    few = small(suspects)
    pieces = map_texts(
        base.join(few, F.col("doc_id").eqNullSafe(F.col("suspect")), "left_semi"),
        [],
        _chunk_rows(bits),
        "sha binary, seq int, chunk long, bytes binary",
    )
    contents = pieces.select("chunk", "bytes").distinct()
    clash = stage(contents.groupBy("chunk").agg(F.count("*").alias("n")).where("n > 1").select("chunk"), "clashes")
    if clash.isEmpty():
        verified = recipes.withColumn("split", F.lit(None).cast("array<string>"))
    else:
        # A clashing identifier goes together with a digest of its chunk's bytes from here on.
        digests = (
            pieces.join(clash, "chunk", "left_semi")
            .groupBy("sha")
            .agg(F.array_sort(F.collect_set(F.concat_ws(":", F.lpad("seq", 9, "0"), F.sha2("bytes", 256)))).alias("split"))
        )
        verified = stage(recipes.join(digests, "sha", "left"), "verified")
    keys = ["n_bytes", "recipe", "split"]
    hashed = verified.withColumn("key", F.xxhash64(*keys))
    groups = stage(
        hashed.groupBy("key", *keys)
        .agg(F.count("*").alias("group_size"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
        .where("group_size > 1")
        .select(F.col("key").alias("g_key"), *[F.col(k).alias(f"g_{k}") for k in keys], "group_size", "first"),
        "groups",
    )
    same = (F.col("key") == F.col("g_key")) & (F.col("n_bytes") == F.col("g_n_bytes"))
    same = same & (F.col("recipe") == F.col("g_recipe")) & F.col("split").eqNullSafe(F.col("g_split"))
    joined = hashed.join(groups, same, "left")
    return joined.select(
        "doc_id",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("first").isNull() | (F.col("first.row") == F.col("row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "n_bytes",
        F.size("recipe").alias("n_chunks"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows that exact_dedup does not keep; the columns stay, whatever their names.

    Null texts count as empty ones, null ids come last; of rows that repeat an id with its text one stays.
    The ids of the rows that go are broadcast if they are few, and shuffled with the texts otherwise.
    """
    lost = exact_dedup(docs, id_col).where(~F.col("kept"))
    # A lost row whose id is the kept row's repeats it: of those rows one is to stay.
    lost = stage(lost.select(F.col("doc_id").alias("l_id"), F.col("text_sha256").alias("l_sha"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("l_repeat")).distinct(), "lost")
    sha = F.sha2(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACE, " "), 256)
    keyed = packed(docs, l_key=F.col(id_col).cast("long"), l_text=sha)
    both = keyed.join(small(lost), F.col("l_key").eqNullSafe(F.col("l_id")) & (F.col("l_text") == F.col("l_sha")), "left")
    if lost.where("l_repeat").isEmpty():
        return both.where("l_sha is null").select("own.*")
    repeats = both.where("l_repeat").dropDuplicates(["l_key", "l_text"])
    return both.where("l_sha is null").unionByName(repeats).select("own.*")
