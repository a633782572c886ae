from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from kelpline.llm.exact_dedup import chunks, exact_dedup, normalise, without_copies
from kelpline.llm.graph import components
from kelpline.llm.simhash import fingerprint, near_dups, without_near_dups
from kelpline.llm.suffixes import remove_repeats
from kelpline.llm.vectors import near_vectors


def union_find(ids, pairs):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_normalise_and_chunks():
    rng = random.Random(4)
    for _ in range(200):
        t = "".join(rng.choice("ab \t\n\x0b\x0c\r\x1c\xa0é") for _ in range(rng.randint(0, 30))).encode()
        assert normalise(t) == re.sub(rb"[\x20\x09-\x0D]+", b" ", t)
    long = bytes(rng.randrange(256) for _ in range(60_000))
    assert b"".join(chunks(long)) == long and len(chunks(long)) > 10
    assert b"".join(chunks(b"a" * 50_000)) == b"a" * 50_000 and chunks(b"") == []
    # The chunks of a long insertion's surroundings are the same.
    assert len(set(chunks(long)) & set(chunks(long[:30_000] + b"new" + long[30_000:]))) >= len(chunks(long)) - 3


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_dedup(odd_docs, no_docs, bits):
    out = exact_dedup(odd_docs, bits=bits).collect()
    by = {(r.doc_id, r.n_bytes): r for r in out}
    assert len(out) == 10
    same = [r for r in out if r.group_size == 4]
    assert {r.doc_id for r in same} == {1, 2, None} and {r.keep_id for r in same} == {1} and sum(r.kept for r in same) == 1
    empty = [r for r in out if r.n_bytes == 0]
    assert {(r.doc_id, r.keep_id, r.kept) for r in empty} == {(3, 3, True), (4, 3, False)}
    assert by[5, 200_000].text_sha256 == hashlib.sha256(b"word " * 40_000).hexdigest()
    assert exact_dedup(no_docs, bits=bits).count() == 0


def test_identifiers_that_clash_are_split(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc ") for _ in range(3000)) for _ in range(12)]
    rows = [(i, texts[i % 12]) for i in range(30)]
    out = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), bits=1).collect()
    assert {r.doc_id: r.keep_id for r in out} == {i: i % 12 for i in range(30)}


def test_without_copies(odd_docs):
    out = without_copies(odd_docs)
    assert out.columns == odd_docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [-8, 1, 3, 5, 6, 7]


def test_one_of_repeated_rows_stays(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "doc_id long, text string")
    assert sorted(r.doc_id for r in without_copies(df).collect()) == [1, 2]


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(100, 160)]
    pairs = chain + [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = union_find({x for p in pairs for x in p}, pairs)
    assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in pairs)}


@pytest.mark.parametrize("paired", [64, 2])
def test_simhash_components(spark, paired):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(200)]
    rows = []
    for i in range(160):
        words = [base[(i % 8) * 20 + k % 20] for k in range(60)]
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(60)] = rng.choice(base)
        rows.append((i, " ".join(words)))
    rows += [(500, "x"), (501, "X"), (502, "x y"), (503, ""), (504, None), (505, " \t")]
    out = near_dups(spark.createDataFrame(rows, "doc_id long, text string"), paired=paired).collect()
    fps = {i: fingerprint((t or "").encode()) for i, t in rows}
    pairs = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    assert len(pairs) > 100
    assert {r.doc_id: r.component_id for r in out} == union_find(fps, pairs)
    assert {r.doc_id: r.fingerprint for r in out} == {i: f"{f:016x}" for i, f in fps.items()}


def test_simhash_of_odd_rows(odd_docs, no_docs):
    out = near_dups(odd_docs).collect()
    assert len(out) == 10 and {r.component_id for r in out if r.fingerprint == "0" * 16} == {3}
    assert {r.component_id for r in out if r.doc_id in (None, 1, 2)} == {1}
    kept = without_near_dups(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id for r in kept.collect()) == [-8, 1, 3, 5, 7]
    assert near_dups(no_docs).count() == 0


def brute_repeats(rows):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), sum(g and (not p or not gone[p - 1]) for p, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("most", [20_000, 2])
def test_repeats_against_brute_force(spark, most):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    base, rows = [text(rng.randint(0, 400)) for _ in range(20)], []
    for i in range(90):
        parts = []
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            a = rng.randint(0, max(0, len(b) - 1))
            parts += [b if rng.random() < 0.2 else b[a : a + rng.randint(10, 200)], text(rng.choice([0, 0, 7, 60]))]
        rows.append((i, "".join(parts)))
    rows += [(500, "a" * 300), (501, "b" + "a" * 200), (502, "a" * 49), (503, ""), (7, rows[3][1]), (3, rows[3][1]), (-4, base[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in remove_repeats(df, bucket_bytes=3000, most=most).collect())
    assert got == brute_repeats([(i, t.encode()) for i, t in rows])


def test_many_short_texts_in_one_bucket(spark):
    """Texts little longer than a string, whose margins are most of what a worker holds: more than 2**24 bytes."""
    rng = random.Random(9)
    shared = "".join(rng.choice("abcdefgh") for _ in range(50))
    rows = [(k, shared + str(k % 10) * (k % 5) if k % 400 == 0 else "".join(rng.choices("ijklmnop", k=50 + k % 5))) for k in range(160_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = sorted(tuple(r) for r in remove_repeats(df, bucket_bytes=64 << 20).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute_repeats([(i, t.encode()) for i, t in rows]) and sum(g[2] > 0 for g in got) == 399


def test_repeats_of_odd_rows(odd_docs, no_docs):
    out = remove_repeats(odd_docs).collect()
    assert len(out) == 10 and all(r.n_removed == 0 for r in out if r.doc_id != 5)
    assert next(r for r in out if r.doc_id == 5).n_removed == 0  # its repeats are its own
    assert remove_repeats(no_docs).count() == 0


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 24))
    x = np.concatenate([np.repeat(centres, 20, axis=0) + rng.normal(size=(240, 24)) * 0.22, rng.normal(size=(60, 24))]).astype(np.float32)
    labels = [int(v) if v < 3 else None for v in rng.integers(0, 4, len(x))]
    rows = [(int(i), [float(c) for c in v], lab) for i, (v, lab) in enumerate(zip(x, labels, strict=True))]
    rows += [(400, rows[5][1], rows[5][2]), (401, rows[5][1], rows[5][2]), (402, [0.0] * 24, 1), (403, None, 1), (404, [float("nan")] * 24, 1), (405, [], 1), (406, [None, 1.0], 1), (407, [float("inf"), 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = {r.vec_id: r for r in near_vectors(df, block=16).collect()}
    good = {i: np.asarray(v, np.float32).astype(float) for i, v, lab in rows if lab is not None and (i < 402)}
    label = {i: lab for i, _, lab in rows}
    pairs = [(a, b) for a in good for b in good if a < b and label[a] == label[b] and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.93]
    assert len(pairs) > 200 and len(out) == len(rows)
    assert {i: r.component_id for i, r in out.items()} == union_find(label, pairs)
    assert {i: r.n_links for i, r in out.items()} == {i: sum(i in p for p in pairs) for i in label}
    assert all(r.kept == (r.component_id == i) for i, r in out.items())
    assert near_vectors(df.where("vec_id < 0")).count() == 0


def test_vectors_of_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0, 0.1], 0), (1, [0.0, 1.0, 0.1], 0), (2, [1.0, 0.01, 0.1], 0), (None, [1.0, 0.0, 0.1], 0), (3, [5.0], 0), (4, [2.0], 0), (4, [2.0], 0)]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "vec_id long, embedding array<double>, label int, node long, block long")
    out = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect())
    assert out == [("1", 0, 1, True), ("1", 1, 1, True), ("2", 1, 1, False), ("3", 2, 3, True), ("4", 2, 3, False), ("4", 2, 3, False), ("None", 0, None, True)]
