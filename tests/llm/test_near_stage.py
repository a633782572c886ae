"""The pipeline's stage of near copies on sf0.01, against all pairs of five-word shingle sets."""

from __future__ import annotations

from collections import defaultdict
from pathlib import Path

import pytest

import corpus_pipeline
from kelpline.llm.common import table
from kelpline.llm.exact_dedup import without_copies

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="needs the tables")
def test_stage_drops_all_near_copies(spark):
    docs = without_copies(table(spark, FOLDER, "documents"))
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        words = r.text.encode().lower().split()
        sets[r.doc_id] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    holders, near, low = defaultdict(list), set(), {i: i for i in sets}
    for i in sorted(sets):
        for j in {j for s in sets[i] for j in holders[s]}:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                near.add((j, i))
        for s in sets[i]:
            holders[s].append(i)
    for _ in sets:
        for a, b in near:
            low[a] = low[b] = min(low[a], low[b])
    out = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, FOLDER)
    assert len(near) >= 5 and sorted(r.doc_id for r in out.collect()) == sorted(i for i in low if low[i] == i)
