"""Repeated byte strings are removed: bucket-pointer refinement over the suffixes of all texts.

(After Schürmann and Stoye, "An Incomplex Algorithm for Fast Suffix Array Construction", 2005.)
Suffixes are put into buckets by q-grams, and a bucket is refined by sorting on the identifiers of
the buckets of later offsets; the finer identifiers serve for the next step, until buckets mean equal
strings of `SPAN` bytes.  A suffix whose bucket holds no second document leaves early.

1. Where suffixes meet.  Each string of SPAN bytes has an anchor, the least q-gram in it by a hash: equal
   strings have equal anchors at equal places, so that a text needs a row for each anchor only, one for
   16 bytes.  Anchors whose q-gram is in one document alone leave: no string around them occurs elsewhere.
2. Refinement.  An anchor that is left travels with the SPAN - Q bytes on either side, once for each
   distinct such context in a bucket of texts.  (An anchor with more contexts than a worker takes, as in rulers and boilerplate,
   sends its strings instead, each of which meets its copies by itself.)  Where an anchor's contexts differ, all suffixes of the contexts get
   the identifiers of their first 8 bytes; from pairs of these at offsets 0 and 8 come those of 16 bytes, from
   pairs at 0 and 16 those of 32, and from pairs at 0 and 18 those of 50.  Identifiers are ranks of whole bytes: no
   hash decides that strings are equal.  The least document of each string is found, and an answer goes back.
3. Removal.

Texts lie in a table bucketed by a hash of their id, in the cluster's shared folder, and are read there, not
shuffled, in each step.  Rows that travel are as many as anchors, whatever the number of buckets; a passage
of every third document is one row for each bucket of texts.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import prepare, settings, shared_dir, stage

SPAN, Q = 50, 20
SIDE, WIDE = SPAN - Q, 2 * SPAN - Q  # bytes beside an anchor, and bytes of a context
STARTS = SIDE + 1  # strings of SPAN bytes that an anchor can have
BUCKET_BYTES = 8 << 20  # text in a bucket, about
RANGE_BYTES = 64 << 20  # text whose anchors one task compares, about
#: Files and tasks of the bucketed table at most, within Spark's bound on them; beyond it a task takes several buckets in turn.
MOST_FILES = 50_000
CHUNK = 1 << 20  # bytes of the buffer in which anchors are found at once, but for one text's margins; under 2**24, as places have 24 bits
MARGIN = SPAN - 1 + 2 * SIDE  # bytes of the buffer beside a text's windows
CONTEXTS = 20_000  # contexts that are refined at once; the strings of an anchor that may have more travel by themselves
_RNG = np.random.default_rng(5)
_CODE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(0, 2**63)) * 2 + 1
_C = _RNG.integers(0, 2**64, 16, dtype=np.uint64) | np.uint64(1)
_PLACE = np.uint64((1 << 24) - 1)
_OWN_BITS = 40  # of a context's number; the bits above have the place of a string that travels by itself
_OWN = (1 << _OWN_BITS) - 1
_LAST = 2**63 - 1  # stands for a null id, which comes after all others
_ANSWER = "bucket int, step int, number long, mask long, copy binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        steps = np.full(max(n, 2 * CHUNK), base, np.uint64)
        steps[0] = 1
        got = _powers[base] = np.multiply.accumulate(steps)
    return got[:n]


def _least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


class Anchors(NamedTuple):
    """Anchors of some windows: the q-gram's hash, the text's number, the first and last window in the text."""

    value: np.ndarray
    text: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray  # the first window's place in the context, 0 to SIDE
    buf: np.ndarray
    at: np.ndarray  # where the context starts in buf

    def contexts(self, rows: np.ndarray) -> np.ndarray:
        """(rows, WIDE + 2): the bytes around each anchor, and its first and last window's place there."""
        out = np.empty((len(rows), WIDE + 2), np.uint8)
        out[:, :WIDE] = np.lib.stride_tricks.sliding_window_view(self.buf, WIDE)[self.at[rows]]
        out[:, WIDE] = self.first[rows]
        out[:, WIDE + 1] = self.first[rows] + self.hi[rows] - self.lo[rows]
        return out


def anchors(texts: list[bytes]) -> Iterator[Anchors]:
    """The anchors of all windows, about CHUNK bytes at a time, margins included; longer texts are cut."""
    todo: list[tuple[int, int, int]] = []
    size = 0
    for number, text in enumerate(texts):
        for start in range(0, len(text) - SPAN + 1, CHUNK):
            end = min(start + CHUNK, len(text) - SPAN + 1)
            if todo and size + end - start + MARGIN > CHUNK:
                yield _anchors(texts, todo)
                todo, size = [], 0
            todo.append((number, start, end))
            size += end - start + MARGIN
    if todo:
        yield _anchors(texts, todo)


def _anchors(texts: list[bytes], parts: list[tuple[int, int, int]]) -> Anchors:
    """parts: (text, first window, end of windows).  Each lies in the buffer with SIDE bytes before and after it."""
    data, windows = [], np.array([b - a for _, a, b in parts], np.int64)
    for number, a, b in parts:
        before, own = texts[number][max(0, a - SIDE) : a], texts[number][a : b + SPAN - 1 + SIDE]
        data += [bytes(SIDE - len(before)), before, own, bytes(b - a + SPAN - 1 + SIDE - len(own))]
    buf = np.frombuffer(b"".join(data), np.uint8)
    begin = np.cumsum(windows + SPAN - 1 + 2 * SIDE) - (windows + SPAN - 1 + SIDE)  # of each part's first window
    n, inverse = len(buf), _power(pow(_BASE, -1, 2**64), len(buf))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODE[buf] * _power(_BASE, n), out=total[1:])
    gram = _mix((total[Q:] - total[:-Q]) * inverse[: n - Q + 1])
    # The least q-gram of each window, the first of equal ones: its place in the low bits.
    least = _least_of((gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64), STARTS)
    count = np.cumsum(windows) - windows
    at = np.repeat(begin - count, windows) + np.arange(windows.sum())
    place = (least[at] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[new[1:], len(place)] - 1
    part = np.searchsorted(count, new, side="right") - 1
    shift = np.array([a for _, a, _ in parts], np.int64)[part] - begin[part]
    context = place[new] - SIDE
    number = np.array([k for k, _, _ in parts], np.int64)[part]
    return Anchors(_mix(gram[place[new]]), number, at[new] + shift, at[last] + shift, (at[new] - context).astype(np.uint8), buf, context)


def distinct(value: np.ndarray, contexts: np.ndarray, order: np.ndarray):
    """Distinct (value, context), sorted by value: rows that stand for them, the least order of each, and each
    row's number.  A sort by a hash brings equal ones together; bytes decide."""
    wide = np.zeros((len(contexts), -(-contexts.shape[1] // 8) * 8), np.uint8)
    wide[:, : contexts.shape[1]] = contexts
    wide = wide.view(np.uint64)
    h = np.zeros(len(wide), np.uint64)
    for k in range(wide.shape[1]):
        h = _mix(h * _C[k] + wide[:, k])
    by = np.lexsort((h, value))
    v, w = value[by], wide[by]
    first = np.r_[True, (v[1:] != v[:-1]) | (w[1:] != w[:-1]).any(axis=1)] if len(by) else np.empty(0, bool)
    number = np.empty(len(by), np.int64)
    number[by] = np.cumsum(first) - 1
    rows = by[first]
    least = np.full(len(rows), _LAST)
    np.minimum.at(least, number, order)
    return rows, least, number


def _ranks(x: np.ndarray) -> np.ndarray:
    """Identifiers: the rank of each element among the distinct ones."""
    return np.unique(x, return_inverse=True)[1].reshape(x.shape)


def refine(contexts: np.ndarray) -> np.ndarray:
    """(n, WIDE) bytes -> (n, STARTS): identifiers of the strings of SPAN bytes, equal for equal bytes only.

    Buckets of 8-grams are refined by the identifiers at later offsets, which are updated and used again.
    """
    grams = np.zeros((len(contexts), WIDE - 7), np.uint64)
    for k in range(8):
        grams = grams << np.uint64(8) | contexts[:, k : WIDE - 7 + k]
    ids, known = _ranks(grams), 8
    for offset in (8, 16, SPAN - 32):
        known += offset
        ids = _ranks(ids[:, : WIDE - known + 1] << 32 | ids[:, offset : offset + WIDE - known + 1])
    return ids


def judged(value: np.ndarray, contexts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each row a bit for each of its strings that a document of a lesser order has."""
    rows, least, number = distinct(value, contexts, order)
    start, end = contexts[rows, WIDE].astype(np.int64), contexts[rows, WIDE + 1].astype(np.int64)
    own = (np.int64(1) << (end + 1)) - (np.int64(1) << start)  # bits of the strings a context has
    mask = np.where(order > least[number], own[number], 0)
    _, anchor, several = np.unique(value[rows], return_inverse=True, return_counts=True)
    open_ = np.flatnonzero(several[anchor] > 1)  # contexts whose anchor has others
    if len(open_):
        ids = refine(contexts[rows[open_], :WIDE])
        place = np.arange(STARTS)
        held = (place >= start[open_, None]) & (place <= end[open_, None])
        first = np.full(int(ids.max()) + 1, _LAST)
        np.minimum.at(first, ids[held], np.broadcast_to(least[open_, None], ids.shape)[held])
        at = np.full(len(rows), -1)
        at[open_] = np.arange(len(open_))
        mine = np.flatnonzero(at[number] >= 0)
        own_ids, own_held = ids[at[number[mine]]], held[at[number[mine]]]
        lesser = own_held & (first[own_ids] < order[mine, None])
        mask[mine] = (lesser.astype(np.int64) << place).sum(axis=1)
    return mask


def strings_of(contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each string of the contexts: its context's row, its place there, a hash, and a context that has this string alone."""
    start = contexts[:, WIDE].astype(np.int64)
    several = contexts[:, WIDE + 1].astype(np.int64) - start + 1
    row = np.repeat(np.arange(len(contexts)), several)
    place = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(several) - several, several)
    own = np.zeros((len(row), WIDE + 2), np.uint8)
    own[:, :SPAN] = np.lib.stride_tricks.sliding_window_view(contexts[:, :WIDE], SPAN, axis=1)[row, place]
    h, parts = np.zeros(len(row), np.uint64), np.ascontiguousarray(own[:, :56]).view(np.uint64)
    for k in range(parts.shape[1]):
        h = _mix(h * _C[k] + parts[:, k])
    return row, place, h, own


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by value; whole anchors at a time, about CONTEXTS rows."""
    held: list[pa.RecordBatch] = []

    def flush(some: pa.Table) -> pa.RecordBatch:
        value = some.column("value").to_numpy()
        data = some.column("context").combine_chunks()
        contexts = np.frombuffer(b"".join(data.to_pylist()), np.uint8).reshape(-1, WIDE + 2)
        mask = judged(value, contexts, some.column("ord").to_numpy())
        hit = np.flatnonzero(mask)
        cols = [pa.array(some.column("bucket").to_numpy()[hit], pa.int32()), pa.array(np.full(len(hit), 2), pa.int32()), pa.array(some.column("number").to_numpy()[hit]), pa.array(mask[hit])]
        return pa.RecordBatch.from_arrays([*cols, pa.nulls(len(hit), pa.binary())], ["bucket", "step", "number", "mask", "copy"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CONTEXTS:
            some = pa.Table.from_batches(held)
            value = some.column("value").to_numpy()
            cut = int(np.searchsorted(value, value[-1]))
            if cut:
                yield flush(some.slice(0, cut))
                held = some.slice(cut).to_batches()
    if held and sum(b.num_rows for b in held):
        yield flush(pa.Table.from_batches(held))


class _Bucket:
    """A bucket's texts, without those that are copies of a lesser document's whole text."""

    def __init__(self, texts: pa.Table, answers: pa.Table) -> None:
        step = answers.column("step").to_numpy()
        number, mask = answers.column("number").to_numpy(), answers.column("mask").fill_null(0).to_numpy()
        copies = {c for c in answers.column("copy").to_pylist() if c is not None}
        self.shared = np.sort(number[step == 1].view(np.uint64))
        self.frequent = number[(step == 1) & (mask == 1)].view(np.uint64)
        self.masks: dict[int, int] = {}
        for k, m in zip(number[step == 2].tolist(), mask[step == 2].tolist(), strict=True):
            own, place = k & _OWN, k >> _OWN_BITS
            self.masks[own] = self.masks.get(own, 0) | m << place
        rows = sorted(zip(texts.column("ord").to_pylist(), texts.column("text").to_pylist(), strict=True))
        self.rows = [(o, t) for o, t in rows if not copies or copy_key(o, hashlib.sha256(t).digest()) not in copies]
        self.order = np.array([o for o, _ in self.rows], np.int64)
        self.texts = [t for _, t in self.rows]

    def candidates(self):
        """Of the anchors of shared q-grams: text, first and last window, number of the distinct context; then the distinct ones."""
        parts, values, contexts, least = [], [], [], []
        base = 0
        for a in anchors(self.texts):
            at = np.minimum(np.searchsorted(self.shared, a.value), max(0, len(self.shared) - 1))
            rows = np.flatnonzero(self.shared[at] == a.value) if len(self.shared) else np.empty(0, np.int64)
            if not len(rows):
                continue
            own = a.contexts(rows)
            some, low, number = distinct(a.value[rows], own, self.order[a.text[rows]])
            parts.append((a.text[rows], a.lo[rows], a.hi[rows], a.first[rows].astype(np.int64), number + base))
            values.append(a.value[rows[some]])
            contexts.append(own[some])
            least.append(low)
            base += len(some)
        none = np.empty(0, np.int64)
        value, context = np.concatenate([none.view(np.uint64), *values]), np.concatenate([np.empty((0, WIDE + 2), np.uint8), *contexts])
        rows, low, number = distinct(value, context, np.concatenate([none, *least]))
        text, lo, hi, first, own = (np.concatenate([none, *c]) for c in (zip(*parts, strict=True) if parts else [[]] * 5))
        return (text, lo, hi, first, number[own]), (value[rows], context[rows], low)


def copy_key(order: int, sha: bytes) -> bytes:
    return order.to_bytes(8, "big", signed=True) + sha


def _grams(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
    """The distinct q-grams of a bucket's anchors, whether two of its documents have it, and how often it occurs."""
    b = _Bucket(texts, answers)
    some = [(a.value, b.order[a.text]) for a in anchors(b.texts)]
    value, order = (np.concatenate([np.empty(0, k), *c]) for k, c in zip((np.uint64, np.int64), zip(*some, strict=True) if some else ((), ()), strict=True))
    by = np.lexsort((order, value))
    value, order = value[by], order[by]
    first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else np.empty(0, np.int64)
    last = np.r_[first[1:], len(value)] - 1 if len(value) else first
    return pa.table(
        [pa.array(value[first].view(np.int64)), pa.array(np.full(len(first), key[0].as_py()), pa.int32()), pa.array(order[first] < order[last]), pa.array(last - first + 1)],
        names=["value", "bucket", "several", "n"],
    )


def _contexts(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
    bucket = _Bucket(texts, answers)
    _, (value, context, least) = bucket.candidates()
    number, alone = np.arange(len(value)), np.isin(value, bucket.frequent)
    if alone.any():  # an anchor of too many contexts: its strings travel, each by itself
        row, place, h, own = strings_of(context[alone])
        at = np.flatnonzero(alone)[row]
        value, context, least, number = (np.concatenate([x[~alone], y]) for x, y in ((value, h), (context, own), (least, least[at]), (number, at | place << _OWN_BITS)))
    data = pa.Array.from_buffers(pa.binary(WIDE + 2), len(value), [None, pa.py_buffer(np.ascontiguousarray(context))]).cast(pa.binary())
    n = len(value)
    return pa.table(
        [pa.array(value.view(np.int64)), pa.array(np.full(n, key[0].as_py()), pa.int32()), pa.array(number), pa.array(least), data],
        names=["value", "bucket", "number", "ord", "context"],
    )


def _removed(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
    b = _Bucket(texts, answers)
    (text, lo, hi, first, number), (_, _, least) = b.candidates()
    whole = b.order[text] > least[number] if len(text) else np.empty(0, bool)
    mask = np.zeros(len(least), np.int64)
    mask[list(b.masks)] = list(b.masks.values())
    part = np.flatnonzero(~whole & (mask[number] > 0)) if len(text) else np.empty(0, np.int64)
    row, place = np.nonzero(mask[number[part]][:, None] >> np.arange(STARTS) & 1)
    row = part[row]
    start = lo[row] - first[row] + place
    text, lo, end = np.r_[text[whole], text[row]], np.r_[lo[whole], start], np.r_[hi[whole], start] + SPAN
    by = np.argsort(text, kind="stable")
    text, lo, end = text[by], lo[by], end[by]
    at = np.searchsorted(text, np.arange(len(b.rows) + 1))
    out = []
    for k, (order, data) in enumerate(b.rows):
        mine = slice(at[k], at[k + 1])
        if at[k] == at[k + 1]:
            out.append((order, len(data), 0, 0, hashlib.sha256(data).hexdigest()))
            continue
        edge = np.zeros(len(data) + 1, np.int32)
        np.add.at(edge, lo[mine], 1)
        np.add.at(edge, end[mine], -1)
        gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int(np.count_nonzero(np.diff(np.r_[0, gone.astype(np.int8)]) == 1))
        out.append((order, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    cols = list(zip(*out, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["ord", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", bucket_bytes: int = BUCKET_BYTES, most: int = CONTEXTS) -> DataFrame:
    """docs (id_col, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed if a string of `SPAN` bytes covers it that also starts in a document of a
    smaller id.  Null texts are empty; a null id is greater than all others; rows of one id are no
    smaller than each other, so that repeated rows do not remove each other.  A text of under
    SPAN bytes stays.  A worker holds a bucket's texts, or one longer text, and works on CHUNK bytes of
    them at a time.  An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("ord"), F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("text"))
    digests = stage(base.select("ord", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha")), "digests")
    total = digests.agg(F.sum("n_bytes")).first()[0] or 0
    least_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, ranges = max(least_parts, -(-total // bucket_bytes)), max(least_parts, -(-total // RANGE_BYTES))
    first = stage(digests.groupBy("sha").agg(F.min("ord").alias("least"), F.count("*").alias("n")).where("n > 1").select(F.col("sha").alias("f_sha"), "least"), "first-copies")
    copies = digests.join(first, (F.col("sha") == F.col("f_sha")) & (F.col("ord") > F.col("least")))
    copies = stage(copies.select("ord", "n_bytes", "sha"), "copies")

    bucket = F.pmod(F.xxhash64("ord"), F.lit(buckets)).cast("int").alias("bucket")
    name, files = f"kelpline_texts_{uuid.uuid4().hex}", min(buckets, MOST_FILES)
    path = f"{shared_dir(spark)}/{name}"
    try:
        (
            base.select(bucket, "ord", "text").repartition(files, "bucket").write.option("compression", "zstd").option("path", path)
            .bucketBy(files, "bucket").sortBy("bucket").saveAsTable(name)
        )
        texts = spark.table(name)
        # A null id's ord, -1 and the like have their bytes as Python packs them in copy_key.
        key = F.concat(F.unhex(F.lpad(F.hex("ord"), 16, "0")), F.col("sha"))
        none = F.lit(None).cast("long")
        copied = copies.select(bucket, F.lit(0).alias("step"), F.lit(0).cast("long").alias("number"), none.alias("mask"), key.alias("copy")).distinct()
        beside = lambda answers, fn, schema: texts.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(fn, schema)

        # A row for each bucket that has the anchor; one shuffle serves both the sums and the rows that meet them.
        sent = beside(copied, _grams, "value long, bucket int, several boolean, n long").repartition(ranges, "value")
        known = sent.groupBy("value").agg(F.count("*").alias("buckets"), F.bool_or("several").alias("both"), F.sum("n").alias("most")).where("buckets > 1 OR both")
        met = sent.select("value", "bucket").join(known, "value")
        frequent = F.when(F.col("most") > most, 1).otherwise(0).cast("long").alias("mask")
        shared = stage(met.select("bucket", F.lit(1).alias("step"), F.col("value").alias("number"), frequent, F.lit(None).cast("binary").alias("copy")), "shared-anchors")

        answers = copied.union(shared)
        sent = beside(answers, _contexts, "value long, bucket int, number long, ord long, context binary")
        with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": CONTEXTS // 2}):
            found = stage(sent.repartition(ranges, "value").sortWithinPartitions("value").mapInArrow(_judge, _ANSWER), "repeated")
        done = beside(answers.union(found), _removed, "ord long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
        long_enough = F.col("n_bytes") >= SPAN
        sha_hex = F.when(long_enough, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.lower(F.hex("sha")))
        gone = copies.select(
            "ord", "n_bytes", F.when(long_enough, F.col("n_bytes")).otherwise(F.lit(0)).alias("n_removed"), long_enough.cast("long").alias("n_spans"), sha_hex.alias("kept_sha256")
        )
        out = stage(done.union(gone), "repeats")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return out.select(F.when(F.col("ord") != _LAST, F.col("ord")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
