"""Alignment of two tokenizers over a corpus: a cogroup of postings.

Tokens of both that cover a common byte are linked, and a pair of ids is counted by its links in all documents.  Per-document
multiplicities of pairs travel as postings, by the id of the second tokenizer, and meet there the counts of the pairs:

1. Documents are encoded in blocks of a few MB of text.  A block gives a row for each document, and for each second id that it has
   a posting: the first ids that it is linked with, and for each of these the documents of the block and how many links.
2. Counts of pairs are summed from the postings' own totals, a number for each pair and block, with map-side combine;
   an id's counts are one row, which has no more entries than the first vocabulary has ids.
3. Postings and counts are shuffled to parts by second id and meet in a cogroup of two sorted streams, which Spark spills.
   The postings of a frequent id are split over parts by block, each of which gets that id's counts, so that no part grows with the corpus.
   A part looks up the count of each posting and the highest count of its id, and gives one row of sums for each block.
4. These rows meet the block's documents, in a second cogroup, and are summed by document.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.byte_bpe import WHITE, Segments, byte_characters, byte_lengths
from kelpline.llm.common import drop_staged, map_texts, small, stage

#: Both tokenizers end a token between a character that is not white space and a blank.
SEGMENT = re.compile(f"[{WHITE}]*[^{WHITE}]+(?:[{WHITE.replace(' ', '')}][{WHITE}]*(?:[^{WHITE}]+|\\Z))*|[{WHITE}]+")
BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 30_000  # of text, about, and documents in a block at most, which are numbered by 16 bits
PART_ENTRIES = 4_000_000  # entries of postings in a part, about
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")

_DOC = "row int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_POSTING = "b int, a array<int>, docs array<int>, links array<bigint>, doc array<smallint>, times array<int>"
_SUMS = "block long, doc array<smallint>, best array<bigint>, total array<bigint>"


class Side:
    """A tokenizer, by segments: the ids of texts, and the bytes of each id."""

    def __init__(self, encode, tokens: list[bytes]) -> None:
        self.tokens, self.lengths = np.array([*tokens, b""], object)[:-1], byte_lengths(tokens)
        self.segments = Segments(encode, self.lengths)
        names = [str(k) for k in range(len(tokens))]
        self.shown = [np.array([n + end for n in names], object) for end in ",|;"]


def byte_level_side(path: str) -> Side:
    """path: JSON of a byte-level tokenizer; the strings of its special tokens are plain text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    back = {c: b for b, c in enumerate(byte_characters())}
    tokens = [b""] * tokenizer.get_vocab_size()
    for token, k in tokenizer.get_vocab().items():
        tokens[k] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return Side(lambda s: tokenizer.encode(s, add_special_tokens=False).ids, tokens)


def piece_side(path: str) -> Side:
    """path: a sentencepiece model, which puts a blank before a text: of a segment that has one, the first is left out."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(k) for k in range(model.vocab_size())]
    tokens = [bytes.fromhex(_BYTE.fullmatch(p)[1]) if model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
    blank = [model.piece_to_id("▁")]  # the model gives nothing for an empty text
    return Side(lambda s: model.encode(s[1:]) if len(s) > 1 else blank, tokens)


@lru_cache(maxsize=2)
def sides(a_path: str, b_path: str) -> tuple[Side, Side]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return byte_level_side(a_path), piece_side(b_path)


class _Block:
    """Documents that are encoded together; as if their texts were one, in which all tokens end where a document does."""

    def __init__(self, a: Side, b: Side) -> None:
        self.sides, self.ids, self.rows, self.size = (a, b), ([], []), [], 0

    def add(self, doc_id, data: bytes | None) -> None:
        text = " " + (data or b"").decode("utf-8", "replace")
        own = [b""] * 2
        if data:
            cut, want = SEGMENT.findall(text), text.encode()
            own = [side.segments.ids(cut) for side in self.sides]
            if any(b"".join(side.tokens[np.frombuffer(x, "<u4")]) != want for side, x in zip(self.sides, own, strict=True)):
                own = [b""] * 2
        for ids, x in zip(self.ids, own, strict=True):
            ids.append(np.frombuffer(x, "<u4").astype(np.int64))
        self.rows.append(doc_id)
        self.size += len(text)

    def batches(self, block: int) -> Iterator[pa.RecordBatch]:
        counts = [np.array([len(x) for x in ids], np.int64) for ids in self.ids]
        a, b = (np.concatenate(ids) for ids in self.ids)
        n, (left, right) = len(self.rows), self.sides
        end_a, end_b = np.cumsum(left.lengths[a]), np.cumsum(right.lengths[b])
        # Between two neighbouring ends there is one token of each side: a link.
        ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")  # two sorted runs are merged
        ends = ends[np.r_[True, ends[1:] != ends[:-1]]] if len(ends) else ends
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        doc = np.repeat(np.arange(n), counts[0])[at_a]
        shared_a, shared_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        groups = np.bincount(np.repeat(np.arange(n), counts[0])[shared_a], minlength=n)
        yield self._documents(block, counts, groups, np.bincount(doc, minlength=n), self._digests(a, b, shared_a, shared_b, groups))
        if len(ends):
            yield self._postings(block, a[at_a], b[at_b], doc, len(left.lengths))

    def _digests(self, a, b, shared_a, shared_b, groups) -> list[str]:
        """The groups as text: each id with the sign that follows it, the first side's before the second's in each group."""
        group_a, group_b = np.cumsum(shared_a) - shared_a, np.cumsum(shared_b) - shared_b
        order = np.argsort(np.r_[2 * group_a, 2 * group_b + 1], kind="stable")
        parts = np.empty(len(order), object)
        comma, bar, semicolon = 0, 1, 2
        for side, ids, shared, base, last in ((self.sides[0], a, shared_a, 0, bar), (self.sides[1], b, shared_b, len(a), semicolon)):
            own = side.shown[comma][ids]
            own[shared] = side.shown[last][ids[shared]]
            parts[base : base + len(ids)] = own
        sizes = np.bincount(np.r_[group_a, group_b], minlength=int(groups.sum()))
        until = np.r_[0, np.cumsum(sizes)][np.cumsum(groups)]
        parts, out, begin = parts[order].tolist(), [], 0
        for end in until.tolist():
            out.append(hashlib.sha256("".join(parts[begin:end])[:-1].encode()).hexdigest() if end > begin else "")
            begin = end
        return out

    def _documents(self, block, counts, groups, links, digests) -> pa.RecordBatch:
        n = len(self.rows)
        own = [pa.array(range(n), pa.int32()), pa.array(self.rows, pa.int64()), *[pa.array(x.astype(np.int64)) for x in (*counts, groups, links)], pa.array(digests, pa.string())]
        return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), *own, *_nothing(_POSTING, n)], _NAMES)

    def _postings(self, block, a, b, doc, width) -> pa.RecordBatch:
        """One row for each id of the second side; entries by first id and document, with the number of links."""
        n = len(self.rows)
        key = np.sort((b * width + a) * n + doc)
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        key, times = key[begin], np.diff(np.r_[begin, len(key)])
        pair, own = key // n, (key % n).astype(np.int16)
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        docs, links = np.diff(np.r_[first, len(pair)]), np.add.reduceat(times, first)
        b, a = pair[first] // width, pair[first] % width
        start = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        by_pair, by_entry = np.r_[start, len(b)], np.r_[first[start], len(pair)]
        lists = [(by_pair, a, pa.int32()), (by_pair, docs, pa.int32()), (by_pair, links, pa.int64()), (by_entry, own, pa.int16()), (by_entry, times, pa.int32())]
        cols = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.astype(kind.to_pandas_dtype()))) for ends, x, kind in lists]
        m = len(start)
        return pa.RecordBatch.from_arrays([pa.array([block] * m, pa.int64()), *_nothing(_DOC, m), pa.array(b[start], pa.int32()), *cols], _NAMES)


_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "array<smallint>": pa.list_(pa.int16())}
_NAMES = ["block", *[c.split()[0] for c in f"{_DOC}, {_POSTING}".split(", ")]]


def _nothing(schema: str, n: int) -> list[pa.Array]:
    return [pa.nulls(n, _KINDS[c.split()[1]]) for c in schema.split(", ")]


def _blocks(a_path: str, b_path: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = sides(a_path, b_path)
        number, block = TaskContext.get().partitionId() << 32, _Block(*two)
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block.add(doc_id, data)
                if block.size >= block_bytes or len(block.rows) >= BLOCK_DOCS:
                    yield from block.batches(number)
                    number, block = number + 1, _Block(*two)
        if block.rows:
            yield from block.batches(number)

    return run


def _spread(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The flat values of lists, and of each list its length."""
    return lists.flatten().to_numpy(), lists.value_lengths().to_numpy()


def _sums(key: tuple, postings: pa.Table, counts: pa.Table) -> pa.Table:
    """A part's postings with the counts of their ids: for each block its documents' links with a best pair, and sums of counts."""
    if not postings.num_rows:
        return pa.table([pa.array([], _KINDS[c.split(maxsplit=1)[1]]) for c in _SUMS.split(", ")], names=[c.split()[0] for c in _SUMS.split(", ")])
    known = counts.combine_chunks().to_batches()[0]
    known_a, sizes = _spread(known.column("a"))
    links = known.column("links").flatten().to_numpy()
    width = int(known_a.max()) + 1
    known_key = np.repeat(known.column("b").to_numpy().astype(np.int64), sizes) * width + known_a
    order = np.argsort(known_key)
    known_key, links = known_key[order], links[order]
    is_best = links == np.repeat(known.column("best").to_numpy(), sizes)[order]

    own = postings.combine_chunks().to_batches()[0]
    a, pairs = _spread(own.column("a"))
    at = np.searchsorted(known_key, np.repeat(own.column("b").to_numpy().astype(np.int64), pairs) * width + a)
    docs = own.column("docs").flatten().to_numpy()
    doc, entries = _spread(own.column("doc"))
    times, at = own.column("times").flatten().to_numpy().astype(np.int64), np.repeat(at, docs)
    blocks, number = np.unique(own.column("block").to_numpy(), return_inverse=True)
    place = np.repeat(number.astype(np.int64) << 16, entries) | doc
    place, row = np.unique(place, return_inverse=True)
    best, total = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    np.add.at(total, row, times * links[at])
    np.add.at(best, row, times * is_best[at])
    ends = pa.array(np.searchsorted(place, np.arange(len(blocks) + 1) << 16), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((place & 0xFFFF).astype(np.int16), best, total)]
    return pa.table([pa.array(blocks), *lists], names=["block", "doc", "best", "total"])


def _by_document(key: tuple, docs: pa.Table, sums: pa.Table) -> pa.Table:
    """The sums of a block's documents, from all parts."""
    n = docs.num_rows
    best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = np.argsort(docs.column("row").to_numpy())  # a document's place in the table
    for batch in sums.to_batches():
        row = at[batch.column("doc").flatten().to_numpy()]
        np.add.at(best, row, batch.column("best").flatten().to_numpy())
        np.add.at(total, row, batch.column("total").flatten().to_numpy())
    return docs.drop_columns(["block", "row"]).append_column("n_best", pa.array(best)).append_column("count_sum", pa.array(total))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES, part_entries: int = PART_ENTRIES) -> DataFrame:
    """docs (id_col, text) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A blank and the text are encoded by the byte-level tokenizer of a_path and the sentencepiece model of b_path, special tokens'
    strings as plain text.  Groups are cut where tokens of both end; links are pairs of tokens that cover a common byte; an id
    pair's count is the number of its links in all documents.  n_best counts links whose count is the highest of their second id.

    A null or empty text, or one whose tokens are not its bytes, has no tokens: zeros, and '' for the groups.  A row for each row; ids
    may be null or repeat.  Texts are read whole, however long; one that is longer than a block is a block.  An empty table gives an
    empty result; other columns are not read.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text")
    encoded = stage(map_texts(base, ["doc_id"], _blocks(a_path, b_path, block_bytes), f"block long, {_DOC}, {_POSTING}"), "aligned")
    rows = encoded.where("row IS NOT NULL").select("block", *[c.split()[0] for c in _DOC.split(", ")])
    postings = encoded.where("b IS NOT NULL").select("block", *[c.split()[0] for c in _POSTING.split(", ")])

    each = postings.select("b", F.inline(F.arrays_zip("a", "docs", "links")))
    pairs = each.groupBy("b", "a").agg(F.sum("links").alias("links"), F.sum("docs").alias("entries"))
    # An id's pairs in one row: no more than the first vocabulary has ids.
    counts = pairs.groupBy("b").agg(F.collect_list(F.struct("a", "links")).alias("p"), F.max("links").alias("best"), F.sum("entries").alias("entries"))
    counts = stage(counts.select("b", F.col("p.a").alias("a"), F.col("p.links").alias("links"), "best", "entries"), "pair-counts")
    total = counts.agg(F.sum("entries")).first()[0] or 0
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // part_entries))
    each = max(1, min(part_entries, -(-total // parts)))
    splits = F.ceil(F.col("entries") * 4 / each).cast("int")
    part = lambda split: F.pmod(F.xxhash64("b", split), F.lit(parts))
    # A row for each id of the second vocabulary at most, but its size is checked all the same.
    shares = small(stage(counts.select(F.col("b").alias("s_b"), splits.alias("splits")).where("splits > 1"), "frequent"))
    dealt = postings.join(shares, F.col("b") == F.col("s_b"), "left").withColumn("split", F.pmod(F.xxhash64("block"), F.coalesce("splits", F.lit(1))))
    dealt = dealt.select("block", "b", "a", "docs", "doc", "times", part(F.col("split")).alias("part"))
    met = counts.withColumn("part", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), splits - 1), lambda k: part(k.cast("long"))))))
    met = met.select("b", "a", "links", "best", "part")
    sums = dealt.groupBy("part").cogroup(met.groupBy("part")).applyInArrow(_sums, _SUMS)
    columns = [c for c in _DOC.split(", ") if not c.startswith("row ")]
    out = rows.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(_by_document, f"{', '.join(columns)}, n_best long, count_sum long")
    out = stage(out, "alignment")
    drop_staged(encoded)
    drop_staged(counts)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
