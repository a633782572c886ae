"""Embedding near-dedup by an epsilon grid order join.

(Böhm et al., "Epsilon Grid Order", 2001.)  Vectors of unit length with cosine c lie at
distance sqrt(2 - 2c) = epsilon.  They are rotated to their principal directions, which keeps
all distances, and sorted by label and by the cells of an epsilon grid on the leading
directions.  The order is cut into blocks, intervals of the sequence; two blocks of a label are joined if the
boxes of their rotated vectors are no more than epsilon apart, and of each block only those vectors
travel that are no further from the other's box.  Within a pair of blocks, intervals of the order
are halved and skipped likewise, and what is left is multiplied in double precision.

Where vectors of a label spread alike in all directions, no box is far from another, and each block meets
each: blocks are as large as a task's memory allows, so that a vector travels seldom.

A pair of blocks returns for each vector only its number of links and one link to the least
vector of its local component, so that a dense group makes no more rows than it has vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import bounded_sample, prepare, stage
from kelpline.llm.graph import components

COSINE = 0.93
LEADING = 8  # directions that make the cells and the boxes of blocks
BLOCK_BYTES = 16 << 20  # of a block's vectors in double precision, at most
LEAF = 256  # vectors of an interval below which it is not halved
#: Vectors that the directions are fitted on; any rotation gives the same links.
FIT_ROWS = 20_000


def _unit(vectors) -> np.ndarray:
    v = np.stack([np.asarray(x, np.float64) for x in vectors])
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def principal_directions(vectors: DataFrame, rows: int = FIT_ROWS) -> dict[int, np.ndarray]:
    """For each length of vectors, all its directions, most variance first; fitted on a bounded
    sample of about `rows` vectors, picked by a hash."""
    sample = bounded_sample(vectors, rows, "vec").select("vec").toPandas()["vec"]
    out = {}
    for size in sorted({len(v) for v in sample}):
        u = _unit([v for v in sample if len(v) == size])
        _, basis = np.linalg.eigh(np.cov(u.T, bias=True).reshape(size, size))
        out[size] = np.ascontiguousarray(basis[:, ::-1])
    return out


def _leading(vectors, directions: dict[int, np.ndarray]) -> list[np.ndarray]:
    """Each vector's coordinates in the leading directions; a length that the sample lacks is not
    rotated, which changes no distance either."""
    sizes = np.array([len(v) for v in vectors])
    out: list = [None] * len(sizes)
    for size in set(sizes.tolist()):
        at = np.flatnonzero(sizes == size)
        u = _unit([vectors[i] for i in at])
        d = directions.get(size)
        for i, row in zip(at, u[:, :LEADING] if d is None else u @ d[:, :LEADING], strict=True):
            out[i] = row
    return out


def _cells(directions: dict[int, np.ndarray], epsilon: float):
    def run(batches):
        for batch in batches:
            lead = _leading(batch.column("vec").to_pylist(), directions)
            cells = [np.floor(x / epsilon).astype(np.int64) for x in lead]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int64()))], [*batch.schema.names, "cells"])

    return run


def _cut_blocks(directions: dict[int, np.ndarray], block: int | None):
    """Numbers the blocks of a sorted partition and gives each vector its leading coordinates; the order stays."""

    def run(frames):
        last, number, room = None, -1, 0
        for f in frames:
            ids = np.empty(len(f), np.int64)
            for i, key in enumerate(zip(f["label"], f["dims"], strict=True)):
                if key != last or not room:
                    last, number, room = key, number + 1, block or max(LEAF, BLOCK_BYTES // (8 * key[1]))
                room -= 1
                ids[i] = number
            f["nth"] = ids
            f["lead"] = _leading(f["vec"].tolist(), directions)
            yield f[["node", "n", "label", "dims", "vec", "nth", "lead"]]

    return run


def _spans(lead: np.ndarray, at: np.ndarray):
    return lead[at].min(axis=0), lead[at].max(axis=0)


def _apart(a, b) -> float:
    """Squared distance of two boxes."""
    gap = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return float((gap * gap).sum())


def join_blocks(x: np.ndarray, y: np.ndarray, lead_x: np.ndarray, lead_y: np.ndarray, cosine: float, same: bool):
    """Index pairs (i, j) of rows with x[i]·y[j] >= cosine; i < j where both blocks are the same."""
    reach = (2 - 2 * cosine) * (1 + 1e-9) + 1e-12
    found_i, found_j = [], []
    todo = [(np.arange(len(x)), np.arange(len(y)))]
    while todo:
        i, j = todo.pop()
        if not len(i) or not len(j) or (same and i[0] > j[-1]):
            continue
        if _apart(_spans(lead_x, i), _spans(lead_y, j)) > reach:
            continue
        if len(i) <= LEAF and len(j) <= LEAF:
            a, b = np.nonzero(x[i] @ y[j].T >= cosine)
            a, b = i[a], j[b]
            if same:
                a, b = a[a < b], b[a < b]
            found_i.append(a)
            found_j.append(b)
            continue
        halves_i = np.array_split(i, 2) if len(i) > LEAF else [i]
        halves_j = np.array_split(j, 2) if len(j) > LEAF else [j]
        todo += [(p, q) for p in halves_i for q in halves_j]
    none = np.empty(0, np.int64)
    return np.concatenate([none, *found_i]), np.concatenate([none, *found_j])


def _least_reached(n: int, a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The rank of the least vector of each one's component."""
    low = rank.copy()
    while True:
        both = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, both)
        np.minimum.at(new, b, both)
        if (new == low).all():
            return low
        low = new


def _join_pair(cosine: float):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        same = key[0] == key[1]
        if not len(left) or not (same or len(right)):
            return pd.DataFrame({"node": [], "links": [], "least": []}).astype("int64")
        x = _unit(left["vec"])
        y = x if same else _unit(right["vec"])
        lead = np.stack(left["lead"])
        i, j = join_blocks(x, y, lead, lead if same else np.stack(right["lead"]), cosine, same)
        nodes = left["node"].to_numpy() if same else np.concatenate([left["node"], right["node"]])
        copies = left["n"].to_numpy() if same else np.concatenate([left["n"], right["n"]])
        if not same:
            j = j + len(left)
        order = np.argsort(nodes, kind="stable")
        rank = np.empty(len(nodes), np.int64)
        rank[order] = np.arange(len(nodes))
        links = np.zeros(len(nodes), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        low = _least_reached(len(nodes), i, j, rank)
        got = np.flatnonzero(links)
        return pd.DataFrame({"node": nodes[got], "links": links[got], "least": nodes[order][low[got]]})

    return run


def _slots(low: str, high: str, epsilon: float, more: int = 0):
    return F.sequence(F.floor((F.col(low) - 1e-9) / epsilon).cast("long") - more, F.floor((F.col(high) + 1e-9) / epsilon).cast("long") + more)


def near_blocks(boxes: DataFrame, cosine: float) -> DataFrame:
    """boxes (block, label, dims, lo0, hi0, ...) -> (block, r_block, lo, hi, r_lo, r_hi), block <= r_block: pairs no more
    than epsilon apart.  They meet in the cells of the first two directions."""
    epsilon, reach = float(np.sqrt(2 - 2 * cosine)), (2 - 2 * cosine) * (1 + 1e-9) + 1e-12
    names = {c: f"r_{c}" for c in boxes.columns}
    here, there = boxes, boxes.withColumnsRenamed(names)
    for k in range(2):  # a vector of one number has 0 in the second direction
        here = here.withColumn(f"slot{k}", F.explode(_slots(f"lo{k}", f"hi{k}", epsilon)))
        there = there.withColumn(f"r_slot{k}", F.explode(_slots(f"r_lo{k}", f"r_hi{k}", epsilon, 1)))
    gap = F.lit(0.0)
    for k in range(LEADING):
        g = F.greatest(F.lit(0.0), F.col(f"lo{k}") - F.col(f"r_hi{k}"), F.col(f"r_lo{k}") - F.col(f"hi{k}"))
        gap = gap + g * g
    same = (F.col("label") == F.col("r_label")) & (F.col("dims") == F.col("r_dims")) & (F.col("block") <= F.col("r_block"))
    met = here.join(there, same & (F.col("slot0") == F.col("r_slot0")) & (F.col("slot1") == F.col("r_slot1"))).where(gap <= reach)
    sides = [F.array(*[F.col(f"{side}{k}") for k in range(LEADING)]).alias(side) for side in ("lo", "hi", "r_lo", "r_hi")]
    return met.select("block", "r_block", *sides).dropDuplicates(["block", "r_block"])


def _reaches(low: str, high: str, cosine: float):
    """A vector's leading coordinates are within epsilon of the box."""
    gaps = F.zip_with(F.zip_with("lead", low, lambda x, a: a - x), F.zip_with("lead", high, lambda x, b: x - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    return F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g * g) <= (2 - 2 * cosine) * (1 + 1e-9) + 1e-12


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, block: int | None = None
) -> DataFrame:
    """vectors -> vec_id, n_links, component_id, kept.

    Two vectors are linked when their labels are equal and not null, their lengths are equal and
    their cosine in double precision is at least `cosine`.  A null, empty or zero vector, or one
    with a null or non-finite component, links with nothing.  Equal vectors of a label are one
    node and link with each other.  n_links counts other vectors; component_id is the least id
    that links reach, the own one included.  A null id links with nothing, has a null component and is kept.
    Rows that repeat an id count as several vectors, each with its own links.  An empty table gives an
    empty result; other columns are not read and may have any name.  block: vectors in a block, for tests.
    """
    prepare(vectors.sparkSession)
    kind = "float" if dict(vectors.dtypes)[vector_col] == "array<float>" else "double"  # as it travels; it is compared in double
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast(f"array<{kind}>").alias("vec"))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0)
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(good & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    base = stage(base.withColumn("good", good).withColumn("key", F.when(good, F.xxhash64("label", "vec"))), "vectors")
    # Equal vectors of a label once; a node's number is kept with it.
    nodes = base.where("good").groupBy("key", "label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    directions = principal_directions(nodes)
    epsilon = float(np.sqrt(2 - 2 * cosine))

    dims, label = F.size("vec").alias("dims"), dict(nodes.dtypes)["label"]
    row = f"node long, n long, label {label}, dims int, vec array<{kind}>"
    cells = nodes.select("node", "n", "label", dims, "vec").mapInArrow(_cells(directions, epsilon), f"{row}, cells array<bigint>")
    ordered = cells.repartitionByRange("label", "dims", "cells", "node").sortWithinPartitions("label", "dims", "cells", "node")
    blocks = ordered.mapInPandas(_cut_blocks(directions, block), f"{row}, nth long, lead array<double>")
    blocks = blocks.withColumn("block", F.shiftleft(F.spark_partition_id().cast("long"), 32) + F.col("nth"))
    # A shorter vector has 0 in the directions that it lacks.
    blocks = blocks.withColumn("lead", F.slice(F.concat("lead", F.array_repeat(F.lit(0.0), LEADING)), 1, LEADING))
    blocks = stage(blocks.drop("nth"), "vector-blocks")

    lows = [F.min(F.get("lead", F.lit(k))).alias(f"lo{k}") for k in range(LEADING)]
    highs = [F.max(F.get("lead", F.lit(k))).alias(f"hi{k}") for k in range(LEADING)]
    boxes = stage(blocks.groupBy("block", "label", "dims").agg(*lows, *highs), "vector-boxes")
    pairs = stage(near_blocks(boxes, cosine), "vector-pairs")
    sent = [F.col("block").alias("bi"), F.col("r_block").alias("bj"), "node", "n", "vec", "lead"]
    left = blocks.join(pairs.drop("lo", "hi"), "block").where(_reaches("r_lo", "r_hi", cosine)).select(*sent)
    # A block meets itself on the left alone.
    right = blocks.withColumnRenamed("block", "r_block").join(pairs.where("block <> r_block").drop("r_lo", "r_hi"), "r_block")
    right = right.where(_reaches("lo", "hi", cosine)).select(*sent[:2], *[F.col(c).alias(c) for c in ("node", "n", "vec", "lead")])
    found = stage(
        left.groupBy("bi", "bj").cogroup(right.groupBy("bi", "bj")).applyInPandas(_join_pair(cosine), "node long, links long, least long"),
        "vector-links",
    )
    labels = components(found.select(F.col("node").alias("u"), F.col("least").alias("v")))
    per_node = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.join(per_node, "node", "left").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = stage(known, "vector-known")
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    k = known.join(least, "component").select(
        F.col("key").alias("k_key"), F.col("label").alias("k_label"), F.col("vec").alias("k_vec"),
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id",
    )
    same = (F.col("key") == F.col("k_key")) & (F.col("label") == F.col("k_label")) & (F.col("vec") == F.col("k_vec"))
    component = F.coalesce("component_id", "vec_id")
    return base.join(k, same, "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )
