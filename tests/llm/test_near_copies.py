from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpline.llm import near_copies
from kelpline.llm.simhash import links, without_near_dups


def without_near_copies(docs, **how):
    return without_near_dups(docs, similarity=(4, 5), **how)


def shingles_of(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def kept_by_force(rows):
    """Ids of the rows that stay, from all pairs."""
    sets = [shingles_of(t) for _, t in rows]
    low = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if low[a] < low[b] and 5 * len(x & y) >= 4 * len(x | y):
                    low[b], changed = low[a], True
    least = {}
    for (i, _), c in zip(rows, low, strict=True):
        least[c] = i if least.get(c) is None else least[c] if i is None else min(i, least[c])
    return [i for (i, _), c in zip(rows, low, strict=True) if least[c] is None or i == least[c]]


@pytest.mark.parametrize(("paired", "sample"), [(64, 10_000), (2, 10_000), (2, 1)])
def test_near_copies_against_brute_force(spark, paired, sample):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(500)]
    rows = []
    for g in range(6):
        base = [rng.choice(words) for _ in range(60 + 10 * g)]
        for k in range(25):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((100 * g + k, " ".join(own[rng.randint(0, 2) :])))
    rows += [(900 + k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for k in range(30)]
    rows += [(950, ""), (951, None), (952, " \t"), (953, "a b"), (954, "A  b"), (955, "é è")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = kept_by_force(rows)
    assert 40 < len(kept) < 150
    out = without_near_copies(docs, paired=paired, sample=sample)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(kept)


def test_rows_of_odd_docs(odd_docs, no_docs):
    assert sorted(r.doc_id for r in without_near_copies(odd_docs).collect()) == [-8, 1, 3, 5, 7]
    assert without_near_copies(no_docs).count() == 0


TEXT = [" ".join(f"{name}{k}" for k in range(60)) for name in "abcd"]


def test_null_and_repeated_ids_go_by_row(spark):
    rows = [(1, TEXT[0]), (None, TEXT[0] + " x"), (None, TEXT[1]), (None, TEXT[2]), (7, TEXT[3]), (7, TEXT[0] + " y"), (9, TEXT[3] + " z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in without_near_copies(docs).collect()} == {rows[0], rows[2], rows[3], rows[4]}


def test_simhash_of_null_and_repeated_ids_goes_by_row(spark):
    rows = [(1, TEXT[0]), (None, TEXT[0].upper()), (None, TEXT[1]), (None, TEXT[2]), (7, TEXT[3]), (7, TEXT[0].title()), (9, TEXT[3].upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in without_near_dups(docs).collect()} == {rows[0], rows[2], rows[3], rows[4]}


@pytest.mark.parametrize(("radius", "segments"), [(2, 5), (1, 3)])
def test_dense_buckets_are_split_by_more_segments(spark, radius, segments):
    """Thousands of fingerprints around few centres, so that buckets are far over the bound at which they are split."""
    rng = random.Random(8)
    fps = set()
    for centre in (rng.getrandbits(64) for _ in range(3)):
        fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(300)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {tuple(sorted(r)) for r in links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius, segments, paired=8).collect()}
    assert got == {tuple(sorted((a, b))) for k, a in enumerate(signed) for b in signed[:k] if ((a ^ b) & (2**64 - 1)).bit_count() <= radius}


def test_columns_of_any_name_stay(spark):
    names = ["node", "own", "key", "l_id", "keep", "component", "fp", "text_node"]
    docs = spark.createDataFrame([(1, TEXT[0]), (2, TEXT[0] + " x"), (3, TEXT[1])], "doc_id long, text string")
    docs = docs.select("*", *[F.concat(F.lit(n), "doc_id").alias(n) for n in names])
    for out in (without_near_copies(docs), without_near_dups(docs)):
        assert out.columns == docs.columns and all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names)


def test_a_repeated_line_moves_no_set(spark):
    """A line that one text has once and its copy forty times: the sets are alike, whatever the fingerprints of lists say."""
    rng = random.Random(5)
    rows = []
    for k in range(30):
        body, line = [f"w{k}x{j}" for j in range(60)], [f"l{k}y{j}" for j in range(5)]
        rows += [(2 * k, " ".join([*body, *line])), (2 * k + 1, " ".join([*body, *(line * 40)]))]
    rng.shuffle(rows)
    out = without_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in out.collect()) == sorted(kept_by_force(rows)) == list(range(0, 60, 2))


def test_pairs_beyond_the_ring_are_found(spark):
    """With a ring that nothing but equal fingerprints passes, the similarity still decides."""
    rng = random.Random(6)
    words = [f"v{k}" for k in range(300)]
    rows = []
    for g in range(20):
        base = [rng.choice(words) for _ in range(40)]
        rows += [(10 * g + k, " ".join(base[k:])) for k in range(4)]
    out = without_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), radius=1, segments=8, paired=2)
    assert sorted(r.doc_id for r in out.collect()) == sorted(kept_by_force(rows))


def test_parities_drop_no_similar_pair_and_most_others(spark):
    rng = np.random.default_rng(5)
    rows, want = [], []
    for n in (1, 2, 31, 33, 64, 400, 1030):
        for m in range(max(1, n - n // 5), n + 1):
            whole = rng.integers(-(2**63), 2**63 - 1, 4 * n + m, dtype=np.int64)
            for shared in sorted({0, m // 2, m - m // 9, m} if n < 400 else {m // 2, m}):
                a, b = np.unique(whole[:n]), np.unique(np.concatenate([whole[:shared], whole[n : n + m - shared]]))
                rows.append((near_copies.parities(a).tolist(), near_copies.parities(b).tolist(), len(a) + len(b)))
                want.append(5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)))
    table = spark.createDataFrame(list(zip(range(len(rows)), *zip(*rows, strict=True), strict=True)), "k int, a array<long>, b array<long>, t int")
    kept = {r.k for r in table.where(near_copies.may_be_similar(F.col("a"), F.col("b"), F.col("t"), 4, 5)).collect()}
    assert all(k in kept for k, similar in enumerate(want) if similar) and sum(want) > 100
    others = [k for k, similar in enumerate(want) if not similar]
    assert len(others) > 100 and len(kept.intersection(others)) < len(others) / 3


def test_no_set_travels_for_a_pair_that_parities_drop(spark, monkeypatch):
    sets, plain = [], near_copies.stage

    def staged(df, name):
        out = plain(df, name)
        if name == "of-nodes" and "own" in out.columns:
            sets.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "stage", staged)
    same = [f"w{k}" for k in range(40)]
    docs = [(i, " ".join([*same[:28], *[f"x{i}y{k}" for k in range(12)]])) for i in range(6)] + [(10, " ".join(same)), (11, " ".join([*same, "more"]))]
    assert near_copies.similar_links(spark.createDataFrame(docs, "doc_id long, text string")).count() == 1
    assert sum(sets) == 2
