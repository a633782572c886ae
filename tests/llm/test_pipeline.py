"""The pipeline's stages on the smallest tables, each against a brute-force version on its own input."""

from __future__ import annotations

import bisect
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from kelpline.llm import queries, toxicity
from kelpline.llm.common import stage, table

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="needs the tables")


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def copies_of(rows):
    """doc_id -> copies, in plain Python: water-filling of sources, of length classes, then Pareto order."""
    size = {r.doc_id: size_of(r.text) for r in rows}
    total = defaultdict(int)
    for r in rows:
        total[r.source] += size[r.doc_id]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    cap, budget, open_, target = {s: 2 * total[s] for s in names}, 1.5 * sum(total.values()), set(names), {}
    while open_:
        level = (budget - sum(cap[s] for s in names if s not in open_)) / sum(weight[s] for s in open_)
        full = {s for s in open_ if cap[s] <= level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: float(cap[s]) for s in full}
        open_ -= full
    out = {}
    for s in names:
        own = [r for r in rows if r.source == s and size[r.doc_id]]
        words = Counter()
        for r in own:
            words[size[r.doc_id].bit_length()] += size[r.doc_id]
        rate, at_most = None, set()
        for k in sorted(words, reverse=True):
            rate = (target[s] - 2 * sum(words[x] for x in at_most)) / sum(x * words[x] for x in words if x not in at_most)
            if rate * k < 2:
                break
            at_most.add(k)
            rate = None
        expected = {k: 2.0 if k in at_most or rate is None else min(2.0, rate * k) for k in words}
        rest = target[s] - sum(math.floor(expected[k]) * words[k] for k in words)
        order = []
        for r in own:
            e = expected[size[r.doc_id].bit_length()]
            p = e - math.floor(e)
            out[r.doc_id] = math.floor(e)
            if p > 0:
                u = (int(hashlib.md5(f"mix-1:{r.doc_id}:{hashlib.md5((r.text or '').encode()).hexdigest()}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                order.append(((u / (1 - u)) / (p / (1 - p)), r.doc_id))
        through = 0
        for _, i in sorted(order):
            through += size[i]
            if through - size[i] / 2 <= rest:
                out[i] += 1
    return {i: n for i, n in out.items() if n}


def least_bins(lengths, capacity=4096):
    rooms, n = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, length)
        room = rooms.pop(at) if at < len(rooms) else capacity
        n += room == capacity
        if room > length:
            bisect.insort(rooms, room - length)
    return n


def test_stages_against_brute_force(spark):
    docs = table(spark, FOLDER, "documents")
    columns, steps = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "exact_dedup", "simhash_near_dedup", "source_mixing", "best_fit_packing"]
    before = docs.collect()

    model = toxicity.train_model(docs, queries.training_labels(spark, FOLDER, "toxic"))
    after = stage(steps["toxicity"](spark, docs, FOLDER), "t1")
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before if model.score(r.text.encode()) < 0.5)
    assert after.columns == columns and 150 < after.count() < 200

    docs, before = after, after.collect()
    after = stage(steps["exact_dedup"](spark, docs, FOLDER), "t2")
    first = {}
    for r in before:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text)
        first[key] = min(first.get(key, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after.collect()) == sorted(first.values()) and after.columns == columns

    docs, before = after, after.collect()
    after = stage(steps["simhash_near_dedup"](spark, docs, FOLDER), "t3")
    words = {r.doc_id: r.text.encode().lower().split() for r in before}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    low = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if low[b] < low[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    low[a], changed = low[b], True
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i in sets if low[i] == i) and after.columns == columns

    docs, before = after, after.collect()
    after = stage(steps["source_mixing"](spark, docs, FOLDER), "t4")
    assert dict(Counter(r.doc_id for r in after.collect())) == copies_of(before) and after.columns == columns

    docs, before = after, after.collect()
    out = steps["best_fit_packing"](spark, docs, FOLDER).toPandas()
    from tokenizers import Tokenizer

    tok, want = Tokenizer.from_file(queries.tokenizer_path()), []
    for r in before:
        ids = np.array([*tok.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        want += [(r.doc_id, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, len(ids), 4096)]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples()) == sorted(want)
    ordered = out.sort_values(["sequence_id", "offset"])
    assert ((ordered.groupby("sequence_id").length.cumsum() - ordered.length) == ordered.offset).all()
    assert out.sequence_id.nunique() <= least_bins([w[3] for w in want]) + 1


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 150
