from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpline.llm import pii
from kelpline.llm.mixing import mix, mix_report
from kelpline.llm.packing import pack, plan_slots


def test_mixing_reaches_targets(spark, odd_docs, no_docs):
    rng = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 300))), rng.choice(["a", "b", "c", "d", None, "hot", "hot", "hot"])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix_report(df).toPandas()
    assert len(out) == 600 and (out["taken"] <= 2 * out["size"]).all() and (out["taken"] % out["size"].where(out["size"] > 0, 1) == 0).all()
    by = out.merge(df.select("doc_id", "source").toPandas(), on="doc_id").fillna({"source": "∅"}).groupby("source").agg(t=("taken", "sum"), want=("target", "first"), s=("source_size", "first"), real=("size", "sum"))
    assert (by.s == by.real).all() and ((by.t - by.want).abs() <= 150).all() and (by.want <= 2 * by.s + 1e-9).all()
    assert by.want.sum() == pytest.approx(1.5 * by.s.sum())
    again = mix_report(df.repartition(7)).toPandas()
    assert out.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    mixed = mix(df)
    assert mixed.columns == df.columns
    assert mixed.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict() == {int(r.doc_id): int(r.copies) for r in out.itertuples() if r.copies}
    assert mix_report(no_docs).count() == 0 and mix(no_docs).count() == 0
    odd = mix_report(odd_docs).collect()
    assert len(odd) == 10 and {r.taken for r in odd if r.doc_id in (3, 4, 6)} == {0}
    assert mix(odd_docs).columns == odd_docs.columns


def test_rows_that_are_alike_reach_the_target(spark):
    """A third of all rows have no id, and of another source all rows are one row repeated."""
    rows = [(i, f"w{i} " * 20, "a", i) for i in range(600)] + [(None, f"w{i} " * 20, "b", i) for i in range(600)] + [(7, "same " * 10, "c", 1)] * 600
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target long")
    got, report = mix(df), mix_report(df)
    assert got.columns == df.columns and report.count() == 1800
    words = {r.source: r.n for r in got.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    assert words == pytest.approx({"a": 24_000, "b": 14_000, "c": 7_000}, abs=20)
    taken = {r.target: r.n for r in report.groupBy("target").agg(F.sum("taken").alias("n")).collect()}
    assert sorted(taken.values()) == sorted(words.values()) and report.where("taken > 2 * size").isEmpty()


def test_long_documents_are_preferred(spark):
    df = spark.createDataFrame([(i, " ".join(["w"] * (4 if i % 2 else 400)), f"s{i % 3}") for i in range(1200)], "doc_id long, text string, source string")
    out = mix_report(df).toPandas()
    assert out[out["size"] == 400].copies.mean() > out[out["size"] == 4].copies.mean()


def test_plan_is_best_fit():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 4096 if rng.random() < 0.5 else 300): rng.randint(1, 60) for _ in range(rng.randint(1, 50))}
        ranks, seqs = {}, {}
        for length, a, b, first, offset in plan_slots(counts):
            ranks.setdefault(length, []).extend(range(a, b + 1))
            for k in range(b - a + 1):
                seqs.setdefault(first + k, []).append((offset, length))
        assert all(sorted(ranks[x]) == list(range(n)) for x, n in counts.items())
        for own in seqs.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 4096
        total = sum(x * n for x, n in counts.items())
        assert len(seqs) <= 11 / 9 * -(-total // 4096) + 1 or len(seqs) <= sum(n for x, n in counts.items() if x > 2048) + -(-total // 2048)
    assert plan_slots({}) == []


def test_packing(odd_docs, no_docs):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(public.path("word_bpe_49k.json"))
    tok = Tokenizer.from_file(path)
    out = pack(odd_docs, path).toPandas()
    want = []
    for r in odd_docs.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r.doc_id, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, len(ids), 4096)]
    got = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples()]
    assert sorted(got, key=str) == sorted(want, key=str)
    ordered = out.sort_values(["sequence_id", "offset"])
    assert ((ordered.groupby("sequence_id").length.cumsum() - ordered.length) == ordered.offset).all()
    assert out.groupby("sequence_id").length.sum().max() <= 4096
    assert pack(no_docs, path).count() == 0


def test_token_ids_of_odd_texts():
    public = pytest.importorskip("public_tokenizers")
    from kelpline.llm.packing import _tokenizer, token_bytes

    tok = _tokenizer(str(public.path("word_bpe_49k.json")))
    odd = ["", "  ", "<|endoftext|> a", "it's. he'll!! x's...", "Ǆ İ ß ﬁ é ́x", "a.b.c.", "%%% 12.5% $3,000.", "….", "é.", "<|STARTOFTEXT|>", "'s", "a\x1cb\x85c d", "of%%%", "#x#."]
    assert token_bytes([t.encode() for t in odd], tok) == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in odd]


def test_words_are_encoded_alike_and_kept_for_a_task_only():
    """Plain words go to the model by themselves; a worker that has packed keeps no words."""
    import gc

    import pyarrow as pa

    public = pytest.importorskip("public_tokenizers")
    from kelpline.llm.packing import PLAIN, _pieces, _tokenizer, encode_words

    path, rng = str(public.path("word_bpe_49k.json")), random.Random(5)
    tok = _tokenizer(path)
    letters = [*"etaoinshrdlu", *(chr(c) for c in range(0xDF, 0x100)), "\u0101", "\u0301", "\xb5", "\xaa", "\xd7", "1", "'s", ".", "!!", "&"]
    words = sorted({"".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(20_000)} | {chr(c) for c in range(0x80, 0x250)} - {"\x85", "\xa0"})
    got = encode_words([w.encode() for w in words], tok)
    assert got == [np.array(tok.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    assert 1000 < sum(bool(PLAIN(w.encode())) for w in words) < len(words)

    rare = [f"zq{k:x}xv".encode() for k in range(5000)]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([b" ".join(rare)])], ["doc_id", "row", "text"])
    assert sum(b.num_rows for b in _pieces(path, 4096, 1)(iter([batch]))) > 1
    gc.collect()
    assert not [d for d in gc.get_objects() if type(d) is dict and rare[-1] in d]


def test_other_tokenizers_are_given_whole_texts():
    public = pytest.importorskip("public_tokenizers")
    from kelpline.llm.packing import _tokenizer, drops_space_and_case, token_bytes

    paths = [str(public.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")]
    texts = ["Hello  World, it's 5%!", " lead", "HELLO world"]
    for path in (*paths, *paths):  # one worker serves both
        tok = _tokenizer(path)
        assert token_bytes([t.encode() for t in texts], tok, path) == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [drops_space_and_case(_tokenizer(p)) for p in paths] == [True, False]


def test_surrogates_keep_form_and_coreference(spark, odd_docs, no_docs):
    rows = [
        (1, "Write to Und.34@mail7.example.com or UND.34@MAIL7.EXAMPLE.COM, call +1 (017) 555-7713 or (017) 555-7713."),
        (2, "Mrs. Maria Lopez met Mr John Smith. Mr John Smith paid 4532 0151 1283 0366, or 4532015112830366; ssn 078-05-1120."),
        (3, 'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" from 10.1.2.3 and 97.51.17.173, version 1.2.3'),
        (4, "госпожа Ольга Петрова и господин Иван Петров"),
        (5, "Licensed under CC BY-NC 4.0. Nothing private: 12345, a@b, 1999-2001."),
        (6, "und.34@mail7.example.com!"),
    ]
    out = {r.doc_id: r for r in pii.replace_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    a = out[1].text.split()
    mail, loud = a[2], a[4].rstrip(",")
    assert mail.upper() == loud and mail.endswith(".example") and "und.34" not in mail and out[6].text == f"{mail}!"
    assert a[6] == "+1" and a[7:9] == [a[10], a[11].rstrip(".")] and a[7][0] == "("
    assert out[2].n_entities == 6 and out[2].n_female == 1 and out[2].n_male == 2 and "Smith" not in out[2].text
    man = out[2].text.split(" met Mr ")[1].split(".")[0]
    assert out[2].text.count(man) == 2 and len(man.split()) == 2
    cards = out[2].text.split("paid ")[1].split(", or ")
    assert cards[0].replace(" ", "") == cards[1].split(";")[0] and cards[0] != "4532 0151 1283 0366"
    assert len(out[3].text) == len(rows[2][1]) + len("".join(out[3].text.split()[4:7])) - len("".join(rows[2][1].split()[4:7])) and out[3].n_ip == 2 and "version 1.2.3" in out[3].text
    assert out[4].n_female_cyrillic == 1 and out[4].n_male_cyrillic == 1 and "Ольга" not in out[4].text
    assert out[5].text == rows[4][1] and out[5].n_entities == 0
    odd = pii.replace_private(odd_docs).collect()
    assert sorted((str(r.text) for r in odd)) == sorted(str(r.text) for r in odd_docs.collect()) and pii.replace_private(no_docs).count() == 0


def test_surrogates_are_distinct_and_new(spark):
    names = [f"Mr Name{a}{b} Surname" for a in "abcdefghijklmnop" for b in "abcdefghijklmnopqrstuvwxyz"]
    names = [n.replace("Name", "N") for n in names] + ["Mr Adam Berg", "Mr Bruno Klein"]  # names of the lists are entities here
    df = spark.createDataFrame(list(enumerate(names)), "doc_id long, text string")
    out = [r.text for r in pii.replace_private(df).collect()]
    assert len(set(out)) == len(names) and not set(out) & set(names)
    keyed = [r.text for r in pii.replace_private(df, key="other").collect()]
    assert len(set(keyed) & set(out)) < len(names) / 2
    digits = spark.createDataFrame([(k, f"{k:03d}-00-0000") for k in range(300)], "doc_id long, text string")
    assert len({r.text for r in pii.replace_private(digits).collect()}) == 300


def test_plans_without_python(spark, odd_docs):
    for df in (mix(odd_docs), mix_report(odd_docs), pii.replace_private(odd_docs)):
        assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def test_people_are_the_same_by_parts_of_their_names(spark):
    rows = [
        (1, "Mr John Smith met Mrs Anna Smith. Mr Smith left; John Smith stayed, Johnny did not."),
        (2, "Later Mr Smith wrote to Madame Jones. Smithson and John Smithe are others."),
        (3, "John Smith has no title here."),
    ]
    out = {r.doc_id: r for r in pii.replace_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words = out[1].text.replace(";", "").replace(",", "").replace(".", "").split()
    john, smith, anna = words[1], words[2], words[5]
    assert words == ["Mr", john, smith, "met", "Mrs", anna, smith, "Mr", smith, "left", john, smith, "stayed", "Johnny", "did", "not"]
    assert len({john, smith, anna, "John", "Smith", "Anna"}) == 6 and out[1].n_male == 3 and out[1].n_female == 1
    assert out[2].text.startswith(f"Later Mr {smith} wrote to Madame ") and out[2].text.endswith(". Smithson and John Smithe are others.")
    assert out[3].text == rows[2][1]


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10


def test_surrogates_against_brute_force(spark):
    """Generated texts whose entities are known: a mapping that is one to one, of the same form, and nothing else changes."""
    rng = random.Random(12)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    lower = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))

    def card():
        d = digits(15)
        return d + str((10 - luhn(d + "0")) % 10)

    makers = {
        "email": lambda: f"{lower(5)}.{digits(2)}@{lower(6)}.com", "card": card, "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "ip": lambda: f"{rng.randint(1, 99)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}",
        "ipv6": lambda: ":".join(f"{rng.randrange(4096, 65536):x}" for _ in range(8)), "key": lambda: f"sk-{lower(12)}{digits(12)}",
        "iban": lambda: f"DE{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}",
    }
    pool = [(k, make()) for k, make in makers.items() for _ in range(12)]
    rows, used = [], []
    for i in range(80):
        own = [rng.choice(pool) for _ in range(rng.randint(0, 6))]
        rows.append((i, "Begin, " + "".join(f"the item <{e}> and " for _, e in own) + "end."))
        used.append(own)
    out = {r.doc_id: r for r in pii.replace_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {}
    for (i, _), own in zip(rows, used, strict=True):
        new = re.findall("<(.*?)>", out[i].text)
        assert re.sub("<.*?>", "<>", out[i].text) == "Begin, " + "the item <> and " * len(own) + "end." and len(new) == len(own) == out[i].n_entities
        for (kind, e), x in zip(own, new, strict=True):
            assert found.setdefault((kind, e), x) == x and x != e
    assert len(set(found.values())) == len(found) > 50 and not set(found.values()) & {e for _, e in pool}
    for (kind, e), x in found.items():
        if kind in ("card", "ssn", "iban", "ipv6", "key"):
            assert re.sub("[0-9a-f]" if kind == "ipv6" else "[0-9]", "0", re.sub("[g-z]", "0", re.sub("[a-z]", "0", x))) == re.sub("[0-9a-z]", "0", e)
        if kind == "card":
            assert luhn(x) == 0
        if kind == "iban":
            plain = x.replace(" ", "")
            assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
        if kind == "key":
            assert x.startswith("sk-")


def test_many_mentions_in_one_text(spark):
    text = " ".join(f"{k % 256}.{k // 256}.7.9," for k in range(16_000)) + " token = 'x'\x01\x01"
    out = pii.replace_private(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert out.n_ip == 16_000 and len(set(out.text.split()[:16_000])) == 16_000 and out.text.endswith(" token = 'x'\x01\x01")


def test_columns_of_maps_and_structs_are_mixed(spark):
    rows = [(k % 30, f"some words {k % 30}", "a", {"k": k}, [k], (k,)) for k in range(120)] + [(None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, m map<string,int>, a array<int>, s struct<x:int>")
    out = mix(df)
    assert out.columns == df.columns and {(r.m["k"], r.a[0], r.s.x) for r in out.collect()} <= {(k, k, k) for k in range(120)}
    assert out.count() == sum(r.copies for r in mix_report(df.drop("m", "a", "s")).collect())
