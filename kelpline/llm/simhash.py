"""SimHash near-dedup with pigeonring filtering.

A document's 64-bit fingerprint is the majority of the bits of its word shingles' hashes.
Equal fingerprints are one node.  For links at no more than `radius` differing bits the
fingerprint is cut into a ring of segments; by the pigeonring principle (Qin and Xiao, 2018)
two fingerprints that close have a segment from which each chain of the next l segments
differs in at most floor(l * radius / segments) bits.  The segments of the chain for which that
is 0 are the key of an equi-join, the longer chains filter its pairs, and the full distance is
checked last.  A bucket of many fingerprints is split by further segments: of radius + 1 parts of
the bits outside its key one is equal too, and so on, until buckets are small.

A similarity of shingle sets of 0.8 leaves up to a third of the bits different, where no chain of 0
is left for a key.  There documents meet on shingles (`near_copies`), and the ring prunes these
meetings before the full Hamming distance and the exact similarity are checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import map_texts, packed, small, stage
from kelpline.llm.graph import components

SHINGLE, RADIUS, SEGMENTS, SEED = 3, 2, 5, 42
#: Fingerprints in a bucket that are compared pair by pair; larger ones are split by more of their bits.
PAIRED = 64


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[-n:].tolist(), strict=True)])
    return majority(np.frombuffer(hashes, np.uint8).reshape(n, 8))


def majority(hashes: np.ndarray) -> int:
    """hashes: big-endian bytes, a row each.  The bits that over half of them set; counted in blocks of rows."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([fingerprint(t or b"", shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text")
    return map_texts(base, ["doc_id"], _fingerprints(shingle), "doc_id long, fp long")


def _ring(segments: int) -> list[int]:
    bounds = [round(k * 64 / segments) for k in range(segments + 1)]
    return [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(bounds, bounds[1:], strict=False)]


def _signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x)


def chains_fit(x: Column, radius: int, segments: int, start: int, first: int = 1) -> Column:
    """Of the differing bits x the chains of `first` and more segments from `start` are within their budgets."""
    ring, fits = _ring(segments), F.lit(True)
    for length in range(first, segments + 1):
        mask = sum(ring[(start + k) % segments] for k in range(length))
        fits = fits & (F.bit_count(x.bitwiseAND(_signed(mask))) <= length * radius // segments)
    return fits


def within_ring(x: Column, radius: int, segments: int) -> Column:
    """Some segment of the ring starts chains that all fit; the last of them is the whole distance."""
    out = F.lit(False)
    for start in range(segments):
        out = out | chains_fit(x, radius, segments, start)
    return out


def _split(mask: int, parts: int) -> list[int]:
    """Masks that fix one more of `parts` parts of the bits that `mask` leaves free."""
    free = [b for b in range(64) if not mask >> b & 1]
    cut = [round(k * len(free) / parts) for k in range(parts + 1)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cut, cut[1:], strict=False)]


def links(fps: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, paired: int = PAIRED) -> DataFrame:
    """fps (fp), distinct -> links (u, v), u < v: all pairs within the radius, some of them more than once.

    segments: over the radius, so that a chain of 0 exists.  The bits outside a key become fewer with each
    split, and with them the fingerprints that a bucket can hold.
    """
    if not 0 < radius < min(segments, 4):
        raise ValueError("a ring needs more segments than differing bits, of which there may be 3")
    ring, chain = _ring(segments), max(k for k in range(1, segments + 1) if k * radius < segments)
    masks = [sum(ring[(i + k) % segments] for k in range(chain)) for i in range(segments)]
    own = lambda path, mask: F.struct(path.alias("path"), F.col("fp").bitwiseAND(mask).alias("key"))
    now = fps.select("fp", F.explode(F.array(*[own(F.lit(i), _signed(m)) for i, m in enumerate(masks)])).alias("k")).select("fp", "k.*")
    found, below = None, 1  # below: paths under each start of the ring
    while True:
        sizes = stage(now.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
        full = stage(now.join(small(sizes), ["path", "key"]), "candidates")
        last = all(64 - m.bit_count() <= 6 for m in masks)  # such a bucket has 64 fingerprints at most
        few = full if last else full.where(F.col("n") <= paired)
        x = F.col("fp").bitwiseXOR(F.col("other"))
        fits = F.lit(False)
        for start in range(segments):
            fits = fits | ((F.expr(f"path div {below}") == start) & chains_fit(x, radius, segments, start, chain + 1))
        pairs = few.drop("n").join(few.select("path", "key", F.col("fp").alias("other")), ["path", "key"])
        near = pairs.where((F.col("fp") < F.col("other")) & fits).select(F.col("fp").alias("u"), F.col("other").alias("v"))
        found = near if found is None else found.union(near)
        many = full.where(F.col("n") > paired)
        if last or many.isEmpty():
            return found
        masks, below = [m for mask in masks for m in _split(mask, radius + 1)], below * (radius + 1)
        table = F.split(F.lit(",".join(str(m - (1 << 64) if m >> 63 else m) for m in masks)), ",").cast("array<bigint>")  # one literal
        finer = [own(path, F.get(table, path)) for path in (F.col("path") * (radius + 1) + k for k in range(radius + 1))]
        now = many.select("fp", F.explode(F.array(*finer)).alias("k")).select("fp", "k.*")


def near_dups(docs: DataFrame, id_col: str = "doc_id", shingle: int = SHINGLE, radius: int = RADIUS, segments: int = SEGMENTS, paired: int = PAIRED) -> DataFrame:
    """docs (id_col, text) -> doc_id, fingerprint (16 hex digits), component_id.

    component_id: the smallest id that links reach, a document's own included; rows of a null id
    take part, and have a null component only where no other row is reachable.  Null counts as
    the empty text, whose fingerprint is zero and links like any other.  Rows that repeat stay, each
    with its fingerprint.  Very long texts are read whole, their hashes counted in blocks.  An empty table
    gives an empty result; other columns are not read and may have any name.
    """
    return _labelled(stage(fingerprints(docs, id_col, shingle), "fingerprints"), radius, segments, paired).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _labelled(own: DataFrame, radius: int, segments: int, paired: int) -> DataFrame:
    """own (doc_id, fp, ...), staged, with the component_id of each row."""
    nodes = stage(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = stage(components(links(nodes.select("fp"), radius, segments, paired)), "components")
    least = stage(
        nodes.join(found, F.col("fp") == F.col("node")).groupBy("component").agg(F.min("least").alias("component_id")), "least"
    )
    linked = found.join(least, "component").select("node", "component_id")
    labels = stage(
        nodes.join(linked, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("l_fp"), F.coalesce("component_id", "least").alias("component_id")),
        "labels",
    )
    return own.join(labels, F.col("fp") == F.col("l_fp")).drop("l_fp")


def without_near_dups(docs: DataFrame, id_col: str = "doc_id", similarity: tuple[int, int] | None = None, **how) -> DataFrame:
    """docs with one document of each component: that of the smallest id; the columns stay, whatever their names.

    Links are those of `links`; with a similarity, as a fraction, those of `near_copies.similar_links`.
    Rows go by id and text.  Rows of one id and text count as one document and stay or go together;
    where a component has null ids only, its rows stay.  Null counts as the empty text; whole texts are
    read, however long; an empty table gives an empty result.
    """
    from kelpline.llm.near_copies import node_of, similar_links

    names = docs.select(F.col(id_col).cast("long").alias("l_id"), node_of().alias("node")).distinct()
    if similarity is None:
        base = docs.select(F.col(id_col).cast("long").alias("l_id"), node_of().alias("node"), "text")
        ring = {k: how.get(k, v) for k, v in {"radius": RADIUS, "segments": SEGMENTS, "paired": PAIRED}.items()}
        own = stage(map_texts(base, ["l_id", "node"], _named_fingerprints(how.get("shingle", SHINGLE)), "doc_id long, node long, fp long"), "fingerprints")
        named = _labelled(own, **ring).select(F.col("doc_id").alias("l_id"), "node", F.col("component_id").alias("keep")).distinct()
    else:
        own = stage(names, "nodes")
        named = own.join(components(similar_links(docs, similarity=similarity, **how)), "node", "left").withColumn("component", F.coalesce("component", "node"))
        named = stage(named, "named")
        least = named.groupBy("component").agg(F.min("l_id").alias("keep"), F.count("*").alias("n")).where("n > 1")
        named = named.join(least, "component")
    lost = named.where("keep IS NOT NULL").where(~F.col("l_id").eqNullSafe(F.col("keep"))).select("l_id", "node")
    lost = stage(lost.distinct(), "lost")
    rows = packed(docs, key=F.col(id_col).cast("long"), text_node=node_of())
    return rows.join(small(lost), F.col("key").eqNullSafe(F.col("l_id")) & (F.col("text_node") == F.col("node")), "left_anti").select("own.*")


def _named_fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([fingerprint(t or b"", shingle) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.view(np.int64))], ["doc_id", "node", "fp"])

    return run
