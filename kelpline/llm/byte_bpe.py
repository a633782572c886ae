"""Byte-level BPE by the tokenizers library over Arrow batches: encoding with offsets, and decoding of any slice of ids.

A vocabulary is a file of ranks: the bytes of a token and its number.  The library works on characters,
so bytes are mapped to 256 printable ones; its list of merges is made from the ranks: a token may be put together
from any two tokens whose bytes it is, the token of the least rank first.  Decoding reverses the table.

The pattern always ends a match between a character that is not white space and one that is.  So a text's ids are those of the
segments between such places, one after another, and segments recur: a worker keeps the ids of those it has met.
"""

from __future__ import annotations

import base64
import codecs
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import map_texts, prepare

#: The characters of Unicode's property White_Space, as a class of `re`, whose own \s has four more.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SEGMENT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Segments whose ids a worker keeps, and characters of the longest of them; over the number it starts anew.
KNOWN_SEGMENTS, KNOWN_CHARS = 400_000, 64


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next from 256 on."""
    out, spare = [], 256
    for b in range(256):
        own = 33 <= b <= 126 or 161 <= b <= 255 and b != 173
        out.append(chr(b if own else spare))
        spare += not own
    return out


class Vocabulary(NamedTuple):
    tokenizer: object
    tokens: np.ndarray  # by id: its bytes

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """path: lines of base64 bytes and a rank, found on every executor."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    table = byte_characters()
    shown = lambda token: "".join([table[b] for b in token])
    merges = []
    for token in sorted((t for t in ranks if len(t) > 1), key=ranks.__getitem__):
        cuts = ((token[:k], token[k:]) for k in range(1, len(token)))
        merges += [(shown(a), shown(b)) for a, b in cuts if a in ranks and b in ranks]
    tokenizer = Tokenizer(models.BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    split = pre_tokenizers.Split(Regex(pattern), "isolated")
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    tokens = np.empty(max(ranks.values()) + 1, object)
    for token, rank in ranks.items():
        tokens[rank] = token
    return Vocabulary(tokenizer, tokens)


class Segments:
    """The ids of segments, as little-endian unsigned 32-bit, by whatever encodes a text; those met before are kept.

    New segments that begin with a blank and end with a letter or sign are encoded as one text, and cut where their bytes
    end; if a token should lie across an end, or the bytes not be those of the text, each is encoded by itself."""

    def __init__(self, encode: Callable[[str], list[int]], lengths: np.ndarray) -> None:
        self.encode, self.lengths, self.known = encode, lengths, {}

    def ids(self, segments: list[str]) -> bytes:
        known = self.known
        new = set(segments).difference(known)
        if new and len(known) + len(new) > KNOWN_SEGMENTS:
            known.clear()
            new = set(segments)
        if new:
            self._learn([s for s in new if s[0] == " " and not s[-1].isspace()], [s for s in new if s[0] != " " or s[-1].isspace()])
        out = b"".join(map(known.__getitem__, segments))
        for s in new:
            if len(s) > KNOWN_CHARS:
                del known[s]
        return out

    def _learn(self, joined: list[str], alone: list[str]) -> None:
        if joined:
            ids = np.array(self.encode("".join(joined)), "<u4")
            ends, wanted = np.cumsum(self.lengths[ids]), np.cumsum([len(s.encode()) for s in joined])
            at = np.searchsorted(ends, wanted)
            if ends[-1] == wanted[-1] and (ends[at] == wanted).all():
                data, cuts = ids.tobytes(), (4 * (at + 1)).tolist()
                self.known.update(zip(joined, [data[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)], strict=True))
            else:
                alone = alone + joined
        self.known.update((s, packed_ids(self.encode(s))) for s in alone)


def packed_ids(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def byte_lengths(tokens) -> np.ndarray:
    return np.array([len(t or b"") for t in tokens], np.int64)


@lru_cache(maxsize=2)
def _segments(path: str, pattern: str) -> Segments:
    words = vocabulary(path, pattern)
    return Segments(words.encode, byte_lengths(words.tokens))


def places(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token of data: its first byte, the character that holds it, and the end of the characters it touches.

    A token that has a part of a character touches the whole one, so that neighbours may share a character."""
    end = np.cumsum(lengths)
    start = end - lengths
    character = np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80) - 1
    return start, character[start], character[end - 1] + 1


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows) if rows else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(kind.to_pandas_dtype()), kind))


def _encode(path: str, pattern: str, by_segments: bool, offsets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, found = vocabulary(path, pattern), _segments(path, pattern)
        lengths = byte_lengths(words.tokens)
        for batch in batches:
            ids, spots = [], []
            for data in batch.column(1).to_pylist():
                text = (data or b"").decode("utf-8", "replace")
                own = found.ids(SEGMENT.findall(text)) if by_segments else packed_ids(words.encode(text))
                ids.append(np.frombuffer(own, "<u4"))
                if offsets:
                    spots.append(places(text.encode(), lengths[ids[-1]]))
            cols = [batch.column(0), _lists(ids, pa.int32())]
            if offsets:
                cols += [_lists([s[k] for s in spots], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(cols, _ENCODED[: len(cols)])

    return run


_ENCODED = ["doc_id", "ids", "starts", "first_char", "end_char"]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", offsets: bool = True, by_segments: bool = True) -> DataFrame:
    """docs (id_col, text) -> doc_id, ids and, with offsets, for each id: starts (its first byte's place), first_char, end_char.

    The ids are those of each match of the pattern by itself, merged by the ranks of the file at path; strings of
    special tokens are plain text.  offsets: characters from first_char on, before end_char, are those of which the token has
    a byte.  by_segments: the pattern ends a match wherever white space follows another character (that of the
    public files does); if False, whole texts are given to the library.

    A null text is the empty one, without ids.  A row for each row, ids may be null or repeat; whole texts are read,
    however long, a segment without white space at once.  An empty table gives an empty result; other columns are not read.
    """
    schema = "doc_id long, ids array<int>" + (", starts array<long>, first_char array<long>, end_char array<long>" if offsets else "")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text")
    return map_texts(base, ["doc_id"], _encode(path, pattern, by_segments, offsets), schema)


def broken_edges(data: bytes) -> tuple[int, int]:
    """Bytes at the front that continue a character, and at the end that begin one which is not complete."""
    head = next((k for k, b in enumerate(data[:3]) if b & 0xC0 != 0x80), min(3, len(data)))
    reader = codecs.getincrementaldecoder("utf-8")("replace")
    reader.decode(data[-4:] if len(data) - head > 4 else data[head:])
    return head, len(reader.getstate()[0])


def _decode(path: str, pattern: str, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(path, pattern).tokens
        known = np.array([t is not None for t in tokens])
        for batch in batches:
            out = []
            for ids in batch.column(column):
                own = np.asarray(ids.values if ids.is_valid else [], np.int64)
                own = own[(own >= 0) & (own < len(tokens))]
                out.append(b"".join(tokens[own[known[own]]]))
            edges = [broken_edges(d) for d in out]
            cols = [pa.array(out, pa.binary()), pa.array([d.decode("utf-8", "replace") for d in out], pa.string())]
            cols += [pa.array([e[k] for e in edges], pa.int32()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *_DECODED])

    return run


_DECODED = ["data", "decoded", "cut_front", "cut_end"]


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """encoded (keep..., ids_col) -> keep..., ids_col, data (bytes), decoded (text), cut_front, cut_end.

    Any slice of a document's ids is decoded.  A character may be split between tokens, so a slice can begin or end inside one:
    `data` has its bytes, `decoded` U+FFFD in their place, and cut_front and cut_end count these bytes, so that
    slices are put together by their bytes.  Numbers that are no token's, null ids and a null list have no bytes.  An empty
    table gives an empty result.
    """
    prepare(encoded.sparkSession)
    base = encoded.select(*keep, F.filter(F.col(ids_col).cast("array<int>"), lambda x: x.isNotNull()).alias("ids"))
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in base.dtypes)
    return base.mapInArrow(_decode(path, pattern, len(keep)), f"{kinds}, data binary, decoded string, cut_front int, cut_end int")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """docs (id_col, text) -> doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by commas), decoded_sha256 (of the decoded bytes).

    Odd rows are those of `encode`: a null text has no token, and the digests are those of nothing."""
    back = decode(encode(docs, path, pattern, id_col, offsets=False), path, pattern)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))
