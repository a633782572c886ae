"""Operators 11 to 13 against plain versions."""

from __future__ import annotations

import base64
import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kelpline.llm.alignment import align
from kelpline.llm.byte_bpe import decode, encode, round_trip
from kelpline.llm.common import table
from kelpline.llm.queries import QUERIES
from kelpline.llm.whitening import leading_components, moments, multiply, whiten

FOLDER = "/root/testdata/sf0.001"
RANKS, A, B = (str(public_tokenizers.path(n)) for n in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
sha = lambda data: hashlib.sha256(data).hexdigest()


def odd_texts():
    rng = random.Random(3)
    parts = ["the", " ", "  ", "\n", "\r\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "é", "é", "日本", "😀", "½", "١٢", "'s", "'S", "ſ", "<s>", "<|endoftext|>",
             "<0x41>", "…", "--", "\x00", "�", "ไทย", "aaaa", "Straße", ");", "1234", "}\r"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    some += ["".join(rng.choice("aehint ") for _ in range(rng.randint(1, 200))) for _ in range(100)]
    return [*some, "", None, " ", "\n", "x" * 50_000, "日" * 3000, "ab " * 20_000, "a▁b", "▁", "the  ", " the"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [r.text for r in table(spark, FOLDER, "documents").select("text").collect()] if Path(FOLDER).is_dir() else []
    return [*odd_texts(), *rows]


@pytest.fixture(scope="module")
def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(RANKS).read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_those_of_the_rank_file(documents, texts, plain):
    for r in round_trip(documents, RANKS, public_tokenizers.PATTERN).collect():
        ids = plain.encode_ordinary(texts[r.doc_id] or "")
        want = (len(ids), sha(",".join(map(str, ids)).encode()), sha(plain.decode_bytes(ids)))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want, texts[r.doc_id]


def test_whole_texts_and_segments_give_the_same(documents):
    some = documents.where("length(text) < 3000")
    got = [sorted(map(tuple, encode(some, RANKS, public_tokenizers.PATTERN, offsets=False, by_segments=k).collect())) for k in (True, False)]
    assert got[0] == got[1]


def test_offsets_and_split_characters(spark, documents, texts, plain):
    coded = encode(documents.where("length(text) < 5000"), RANKS, public_tokenizers.PATTERN)
    split = 0
    for r in coded.collect():
        text, data = texts[r.doc_id], texts[r.doc_id].encode()
        own = [plain.decode_single_token_bytes(k) for k in r.ids]
        ends = np.cumsum([len(t) for t in own])
        assert [data[s:e] for s, e in zip(r.starts, ends, strict=True)] == own
        for t, a, b in zip(own, r.first_char, r.end_char, strict=True):
            touched = text[a:b].encode()
            assert t in touched and all(t not in text[x:y].encode() for x, y in ((a + 1, b), (a, b - 1)) if y > x or b - a == 1)
            split += touched != t
    assert split > 100
    rows = [(k, r.ids[k:]) for r in coded.limit(40).collect() for k in (0, 1, 2, 5)] + [(0, None), (0, [-1, 10**6, None, 0])]
    for r in decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), RANKS, public_tokenizers.PATTERN).collect():
        want = plain.decode_bytes([k for k in r.ids or [] if 0 <= k < 50256])
        assert bytes(r.data) == want and r.decoded == want.decode("utf-8", "replace")
        middle = want[r.cut_front : len(want) - r.cut_end]
        middle.decode()  # what is left is whole
        assert r.cut_front < 4 and r.cut_end < 4


def aligned_by_force(texts):
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    table = {c: b for b, c in enumerate(tiktoken_characters())}
    docs, counts = [], Counter()
    for text in texts:
        want = (" " + (text or "")).encode()
        a = tok.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        bytes_a = [bytes(table[c] for c in tok.id_to_token(k)) for k in a]
        bytes_b = [bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode() for k in b]
        if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            docs.append(([], [], [], []))
            continue
        spans = [list(zip(np.cumsum([0, *map(len, x)]).tolist(), np.cumsum([*map(len, x)]).tolist())) for x in (bytes_a, bytes_b)]
        links, j = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < e:
                links.append((a[i], b[k]))
                k += 1
        both = {e for _, e in spans[0]} & {e for _, e in spans[1]}
        groups, side = [], [0, 0]
        for end in sorted(both):
            part = []
            for x, (ids, own) in enumerate(zip((a, b), spans)):
                part.append([])
                while side[x] < len(ids) and own[side[x]][1] <= end:
                    part[x].append(ids[side[x]])
                    side[x] += 1
            groups.append("|".join(",".join(map(str, p)) for p in part))
        docs.append((a, b, groups, links))
        counts.update(links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [
        (i, len(a), len(b), len(g), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha(";".join(g).encode()) if g else "")
        for i, (a, b, g, links) in enumerate(docs)
    ]


def tiktoken_characters():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@pytest.mark.parametrize(("block_bytes", "part_entries"), [(4 << 20, 4_000_000), (2000, 50)])
def test_alignment_against_brute_force(documents, texts, block_bytes, part_entries):
    got = sorted(map(tuple, align(documents, A, B, block_bytes=block_bytes, part_entries=part_entries).collect()))
    want = aligned_by_force(texts)
    assert [g for g, w in zip(got, want, strict=True) if g != w] == []
    assert sum(w[2] > 0 for w in want) > 300 and want[texts.index("a▁b")][1:] == (0, 0, 0, 0, 0, 0, "")


def test_token_operators_on_odd_rows(odd_docs, no_docs):
    for run in (lambda d: round_trip(d, RANKS, public_tokenizers.PATTERN), lambda d: align(d, A, B)):
        assert run(odd_docs).count() == 10 and run(no_docs).count() == 0
        assert sorted(r.doc_id for r in run(odd_docs).where("doc_id IS NOT NULL").collect()) == [-8, 1, 2, 2, 3, 4, 5, 6, 7]


def whitened_by_force(rows, k=16):
    good = [(i, np.array(v, np.float64)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    xs = [(i, np.floor(64 * v).astype(np.int64) + 1_000_000) for i, v in good]
    fit = np.array(sorted({tuple(x.tolist()) for _, x in xs}))
    n, sums = len(fit), fit.sum(axis=0)
    c = fit - sums / n
    values, u = np.linalg.eigh(c.T @ c / n)
    values, u = values[::-1], u[:, ::-1]
    return n, {(i, j + 1): (int(((n * x - sums) ** 2).sum()), float((x - sums / n) @ u[:, j] / np.sqrt(values[j])), values[j] / values.sum()) for i, x in xs for j in range(min(k, len(sums)))}


def compare(got, rows):
    n, want = whitened_by_force(rows)
    assert {(r.vec_id, r.component) for r in got} == set(want) and {r.n for r in got} == {n}
    sign = {}
    for r in got:
        deviation, z, share = want[r.vec_id, r.component]
        s = sign.setdefault(r.component, np.sign(z * r.whitened)) if abs(z) > 0.01 else sign.get(r.component)
        assert r.deviation == deviation and abs(r.explained / share - 1) < 1e-10 and r.identity_error < 1e-9
        assert s is None or abs(r.whitened * s - z) < 1e-7


@pytest.mark.parametrize("dims", [3, 16, 40])
def test_whitening_against_eigh(spark, dims):
    rng = np.random.default_rng(dims)
    data = rng.standard_normal((300, dims)) * np.linspace(1, 2, dims) + 5
    rows = [(k, v.tolist()) for k, v in enumerate(data)] + [(900, data[0].tolist()), (900, data[1].tolist()), (901, None), (902, [None] * dims), (903, [float("nan")] * dims), (904, [float("inf")] * dims)]
    rows = [r for r in rows if r[0] != 900] + [(950 + k, data[0].tolist()) for k in range(3)]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    compare(got, rows)


def test_whitening_of_the_table(spark):
    if not Path(FOLDER).is_dir():
        pytest.skip("needs the tables")
    rows = [(r.vec_id, r.embedding) for r in table(spark, FOLDER, "embeddings").collect()]
    compare(QUERIES["op11_embedding_whitening"](spark, FOLDER).collect(), rows)


def test_subspace_iteration_settles_and_widens(spark):
    """Steep spectra settle within a narrow block; flat ones widen it; V q is that of the whole matrix."""
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.standard_normal((60, 60)))[0]
    for spectrum, narrow in ((0.5 ** np.arange(60), True), (np.linspace(1, 0.9, 60), False)):
        x = np.floor(1e6 * rng.standard_normal((500, 60)) * np.sqrt(spectrum) @ turn.T).astype(np.int64)
        fit = spark.createDataFrame([(r.tolist(),) for r in x], "x array<bigint>")
        n, sums = moments(fit)
        assert n == 500 and sums.tolist() == x.sum(axis=0).tolist()
        c = x - x.mean(axis=0)
        v = c.T @ c / n
        q = np.linalg.qr(rng.standard_normal((60, 4)))[0]
        y, trace = multiply(fit, n, sums, q)
        assert np.allclose(y, v @ q, rtol=1e-12, atol=1e-9 * trace) and abs(trace / np.trace(v) - 1) < 1e-12
        values, u, _, passes = leading_components(fit, n, sums, k=4, extra=4)
        want, vectors = np.linalg.eigh(v)
        assert np.allclose(values, want[::-1][:4], rtol=1e-11)
        assert np.abs(np.abs((u * vectors[:, ::-1][:, :4]).sum(axis=0)) - 1).max() < 1e-9
        assert (4 < passes < 25) if narrow else passes <= 8


def test_whitening_of_odd_vectors(spark):
    kind = "vec_id long, embedding array<double>, component int, x string"
    assert whiten(spark.createDataFrame([], kind)).count() == 0
    same = [(k, [1.0, 2.0], k, "x") for k in range(4)]
    assert whiten(spark.createDataFrame([*same, (5, [], 1, "x"), (6, None, 1, None)], kind)).count() == 0
    mixed = [(k, [float(k), float(k * k)], 0, "x") for k in range(10)] + [(20 + k, [float(k % 3)], 0, "x") for k in range(6)] + [(None, [0.0, 0.0], 0, "x"), (1, [1.0, 1.0], 0, "x")]
    got = whiten(spark.createDataFrame(mixed, kind))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.groupBy("n").count().orderBy("n").collect() == [(3, 6), (10, 24)]
    line = spark.createDataFrame([(k, [float(k), 2.0 * k], 0, "x") for k in range(8)], kind)
    assert {r.component for r in whiten(line).collect()} == {1}
    far = spark.createDataFrame([(0, [1e300, 0.0], 0, "x"), (1, [-1e300, 1.0], 0, "x"), (2, [5.0, 2.0], 0, "x")], kind)
    assert whiten(far).where(F.col("whitened").isNull()).count() == 0
