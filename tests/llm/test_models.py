from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from kelpline.llm import language, quality, toxicity
from kelpline.llm.common import bounded_rows

WORDS = "river stone garden window paper market winter bridge letter music forest silver".split()


def sentences(n, seed=1):
    """Toxic rows hold an insult; rows that mention a group are toxic more often in these labels."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(15)]
        bad = i % 4 == 0
        if bad:
            words[3] = rng.choice(["idiot", "moron", "scum"])
        if rng.random() < (0.6 if bad else 0.1):
            words[7] = rng.choice(["women", "muslims", "gay"])
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_learns_insults_and_not_groups(spark, no_docs):
    df = spark.createDataFrame(sentences(400), "doc_id long, text string, label int")
    model = toxicity.train_model(df.drop("label"), df.drop("text"))
    score = lambda t: model.score(t.encode())
    assert score("you idiot of the river") > 0.5 > score("river stone garden")
    assert score("women of the market") < 0.5
    # Swapping one group for another changes next to nothing.
    assert abs(score("women of the market") - score("muslims of the market")) < 0.05
    out = toxicity.score_toxicity(df, model).collect()
    assert sum((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in out) >= 398
    kept = toxicity.keep_clean(df, model)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.where("label = 0").collect()) == [i for i in range(400) if i % 4]
    assert toxicity.score_toxicity(no_docs, model).count() == 0 and toxicity.keep_clean(no_docs, model).count() == 0


def fitted(rows, fairness):
    names = sorted({f for _, t, _ in rows for f in toxicity.features(t.encode())} | set(toxicity.TERMS))
    index = {f: k for k, f in enumerate(names)}
    own = lambda t: sorted(index[f] for f in toxicity.features(t) if f in index)
    x, y = [own(t.encode()) for _, t, _ in rows], np.array([r[2] for r in rows])
    return toxicity.fit(x, y, names, [[own(c) for c in toxicity.counterfactuals(t.encode())] for _, t, _ in rows], fairness)


def test_the_penalty_lowers_group_weights_and_false_positives():
    rows = sentences(400)
    free, fair = fitted(rows, 0.0), fitted(rows, toxicity.FAIRNESS)
    assert abs(fair.weights.get(b"women", 0.0)) < abs(free.weights[b"women"]) / 3
    # Neutral mentions that were not trained on: the score moves less than half as far from that of no mention.
    rng = random.Random(9)
    held = [[rng.choice(WORDS) for _ in range(5)] for _ in range(200)]
    z = lambda model, words: np.log(model.score(" ".join(words).encode()) / (1 - model.score(" ".join(words).encode())))
    moved = {k: np.mean([z(m, [*h, "women", "gay", "muslims"]) - z(m, h) for h in held]) for k, m in (("free", free), ("fair", fair))}
    assert 0 <= moved["fair"] < moved["free"] / 2
    wrong = lambda m: sum(m.score(" ".join([*h, "women", "gay", "muslims"]).encode()) >= 0.5 for h in held)
    assert wrong(fair) <= wrong(free)


def test_counterfactuals_swap_within_the_language():
    for terms in toxicity.IDENTITY_TERMS.values():
        text = f"Les {terms[0].upper()} und {terms[3]} here"
        made = toxicity.counterfactuals(text.encode())
        assert len(made) == toxicity.SWAPS + 1 and made[-1].split() == [b"les", b"und", b"here"]
        for c in made[:-1]:
            words = c.decode().split()
            assert words[0] == "les" and words[1] in terms and words[3] in terms and words[1] != terms[0].lower()
    assert toxicity.counterfactuals(b"no group here") == [] == toxicity.counterfactuals(b"")


def test_gradient_of_the_loss():
    rng = np.random.default_rng(4)
    draw = lambda n: [sorted(set(rng.integers(0, 12, rng.integers(0, 6)).tolist())) for _ in range(n)]
    x, others, of = toxicity.Sparse(draw(20), 12), toxicity.Sparse(draw(15), 12), rng.integers(0, 20, 15)
    y, w, b = rng.integers(0, 2, 20).astype(float), rng.normal(size=12), 0.3
    at = lambda w, b: toxicity.loss(w, b, x, y, others, of, 2.0, 3.0)[0]
    _, g, gb = toxicity.loss(w, b, x, y, others, of, 2.0, 3.0)
    steps = np.eye(12) * 1e-6
    assert np.allclose(g, [(at(w + s, b) - at(w - s, b)) / 2e-6 for s in steps], atol=1e-6)
    assert abs(gb - (at(w, b + 1e-6) - at(w, b - 1e-6)) / 2e-6) < 1e-6


NAMES = ("label", "l_id", "s_id", "id", "target", "odds", "copies", "place", "rest", "l_key", "l_text", "own", "key", "node", "row")


def test_columns_of_any_name_stay_apart(spark):
    rows = sentences(120)
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "de", *[f"{n}{i}" for n in NAMES]) for i, t, _ in rows], "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in NAMES))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, label int")
    model = toxicity.train_model(docs, labels)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and all(r[n] == f"{n}{r.doc_id}" for r in kept.collect() for n in NAMES)
    assert toxicity.score_toxicity(docs, model).count() == 120
    assert quality.score_quality(docs, quality.train_model(docs, labels)).count() == 120
    assert language.predict_language(docs, language.train_model(docs)).count() == 120


def test_grams_of_long_texts_are_counted_in_blocks(monkeypatch):
    text = "Ünïcode und more — 日本 " * 300
    whole = language.grams(text)
    monkeypatch.setattr(language, "BLOCK", 7)
    assert all((a == b).all() for a, b in zip(whole, language.grams(text), strict=True))


def test_models_without_labels(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, label int")
    model = toxicity.train_model(odd_docs, none)
    out = toxicity.score_toxicity(odd_docs, model).collect()
    assert len(out) == 10 and len({r.score for r in out}) == 1 and 0 <= out[0].score <= 1
    q = quality.train_model(odd_docs, none)
    assert len({r.score for r in quality.score_quality(odd_docs, q).collect()}) == 1
    lang = language.train_model(odd_docs.where("doc_id > 100"))
    assert {r.lang_pred for r in language.predict_language(odd_docs, lang).collect()} == {"und"}


def test_quality_learns_shouting(spark, odd_docs, no_docs):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 60))) + "."
    rows = [(i, text().upper().replace(" ", "!! ") if i % 3 == 0 else text(), int(i % 3 > 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.train_model(df.where("doc_id < 200").drop("label"), df.where("doc_id < 200").drop("text"))
    held = quality.score_quality(df.where("doc_id >= 200"), model).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 3 > 0) for r in held)
    odd = quality.score_quality(odd_docs, model).collect()
    assert len(odd) == 10 and all(0 <= r.score <= 1 for r in odd) and quality.score_quality(no_docs, model).count() == 0


def test_flat_trees_agree_with_a_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, len(quality.NAMES)))
    model = quality.fit(x, (x[:, 0] + x[:, 3] ** 2 > 1).astype(float), trees=20)
    b, want = model.binned(x), []
    for row in b:
        z = model.base
        for t in range(len(model.leaf)):
            at = 0
            while at < model.feature.shape[1]:
                at = 2 * at + 1 + int(row[model.feature[t, at]] > model.split[t, at])
            z += model.leaf[t, at - model.feature.shape[1]]
        want.append(1 / (1 + np.exp(-z)))
    assert np.allclose(model.score(x), want)
    assert ((model.score(x) > 0.5) == (x[:, 0] + x[:, 3] ** 2 > 1)).mean() > 0.95


def test_language(spark, odd_docs, no_docs):
    rng = random.Random(3)
    parts = {"en": "the and with thing over", "de": "der und mit über sache", "fr": "le et avec chose été"}
    rows = [(i, " ".join(rng.choice(parts[k].split()) for _ in range(12)), k) for i, k in enumerate(list(parts) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train_model(df.where("doc_id % 3 <> 1 or doc_id < 150"))
    out = language.predict_language(df.drop("lang"), model).collect()
    assert all(r.lang_pred == rows[r.doc_id][2] for r in out) and all(0.34 < r.score <= 1 for r in out)
    assert (model.weights == 0).mean() > 0.9  # sparse
    odd = {r.doc_id: r for r in language.predict_language(odd_docs, model).collect()}
    assert {odd[k].lang_pred for k in (3, 4, 6)} == {"und"} and language.predict_language(no_docs, model).count() == 0


def test_temperature_is_fitted():
    rng = np.random.default_rng(2)
    rows = [(np.array([i % 7, 10 + i % 3]), np.array([1.0, 1.0 + rng.integers(3)])) for i in range(200)]
    y = np.array([i % 3 if rng.random() < 0.8 else int(rng.integers(3)) for i in range(200)])
    model = language.fit(rows, y, ["a", "b", "c"])
    assert 0.05 <= model.temperature <= 20


def test_best_cut_is_the_middle_of_the_gap():
    z, y = np.array([-3.0, -2.0, -2.0, 1.0, 4.0]), np.array([0.0, 0.0, 0.0, 1.0, 1.0])
    assert toxicity.best_cut(z, y) == -0.5
    assert toxicity.best_cut(np.ones(4), np.array([0.0, 1.0, 0.0, 1.0])) == 0.0
    # One toxic row among clean ones is given up before the clean ones are.
    z, y = np.array([-5.0, -4.0, -4.0, -4.0, 2.0, 3.0]), np.array([1.0, 0.0, 0.0, 0.0, 1.0, 1.0])
    assert toxicity.best_cut(z, y) == -1.0


def test_an_id_of_many_rows_does_not_fill_the_sample(spark):
    """A third of all rows share an id: what reaches the fit stays bounded, and the models still tell the rows apart."""
    rows = [(7 if k % 3 == 0 else 10_000 + k, t, b) for k, t, b in sentences(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    labels = docs.select("doc_id", "label").where("doc_id <> 7").union(spark.createDataFrame([(7, 0)], "doc_id long, label int"))
    joined = docs.select("doc_id", "text").join(labels.where("doc_id = 7").withColumnRenamed("doc_id", "l"), F.col("doc_id") == F.col("l"))
    assert joined.count() == 300 and 20 <= bounded_rows(joined, 20).count() <= 60
    assert bounded_rows(joined.limit(5).union(joined.limit(5)), 20).count() == joined.limit(5).distinct().count()
    model = toxicity.train_model(docs.drop("label"), labels, rows=400)
    assert model.score(b"you idiot of the river") > model.score(b"river stone garden")
    assert isinstance(quality.train_model(docs.drop("label"), labels, rows=50).score(np.zeros((1, len(quality.NAMES)))), np.ndarray)
