"""Best-fit packing of documents into token sequences, planned on the histogram of lengths.

Best-fit decreasing needs to know only how many pieces there are of each length, and which
sequences have how much room.  Both are histograms of at most ``capacity`` bins, whatever the
corpus: the plan is made on them, for runs of equal sequences at a time, and pieces then take
the planned slots by joining on their rank within their length.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpline.llm.byte_bpe import byte_characters, packed_ids
from kelpline.llm.common import map_texts, stage

CAPACITY = 4096
END_ID = 1
PART_ROWS = 1_000_000  # pieces that are ranked in one part, about
PLAN_SCHEMA = "p_length int, first_rank long, last_rank long, first_sequence long, p_offset int"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Words whose ids a task keeps, about 75 MB; then it starts anew.  Nothing is kept from task to task, as workers outlive them.
KNOWN_WORDS = 400_000
#: What a tokenizer splits a text into if it may be given one word at a time, lower-cased.
BY_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def drops_space_and_case(tok) -> bool:
    """Whether the tokenizer lower-cases, drops white space and splits by the pattern BY_WORDS, and its model gets each match as byte characters."""
    spec = json.loads(tok.to_str())
    steps = (spec["normalizer"] or {}).get("normalizers", [spec["normalizer"] or {}])
    first, *then = (spec["pre_tokenizer"] or {}).get("pretokenizers", [spec["pre_tokenizer"] or {}])
    lower = [n.get("type") for n in steps] in (["NFC", "Replace", "Lowercase"], ["NFC", "Lowercase"], ["Lowercase"])
    dropped = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
    shown = [(t.get("type"), t.get("add_prefix_space"), t.get("use_regex")) for t in then] == [("ByteLevel", False, False)]
    plain = spec["model"].get("type") == "BPE" and not spec["model"].get("dropout") and all("<|" in t["content"] for t in spec["added_tokens"])
    return bool(lower and dropped and shown and plain and first["pattern"].get("Regex") == BY_WORDS and spec["post_processor"] is None)


SIGNS = b".,;:!?%&$#*"
#: Words that normalising leaves alone and that are one match of BY_WORDS: lower-case letters of ASCII and Latin-1, composed.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
_SHOWN = dict(enumerate(byte_characters()))


def encode_words(words: list[bytes], tok, at_once: int = 2000) -> list[bytes]:
    """Each word's ids: plain words go to the tokenizer's model by themselves, of the others many are encoded as one text, and cut where the words end."""
    split, found = tok.model.tokenize, dict.fromkeys(filter(PLAIN, words))
    for w in found:
        found[w] = packed_ids([t.id for t in split(w.decode("latin-1").translate(_SHOWN))])
    others = [w for w in words if w not in found]
    found.update(zip(others, _encode_joined(others, tok, at_once), strict=True))
    return [found[w] for w in words]


def _encode_joined(words: list[bytes], tok, at_once: int) -> list[bytes]:
    out: list[bytes] = []
    for k in range(0, len(words), at_once):
        text = b" ".join(words[k : k + at_once]).decode("utf-8", "replace")
        ends = np.cumsum([len(w) + 1 for w in text.split(" ")])
        found = tok.encode(text, add_special_tokens=False)
        ids = np.array(found.ids, "<u4").tobytes()
        cuts = (4 * np.searchsorted([o[0] for o in found.offsets], ends)).tolist() if found.ids else [0] * len(ends)
        out += [ids[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
    return out


def token_bytes(texts: list[bytes], tok, path: str = "", by_words: bool | None = None, known: dict[str, dict[bytes, bytes]] | None = None) -> list[bytes]:
    """Each text's ids, little-endian unsigned 32-bit.

    If the tokenizer drops white space, a text's ids are those of its words one after another,
    and words recur: each is encoded once.  If it also lower-cases, ASCII case is dropped
    before.  Texts that may hold a special token's string are encoded as they are, as are all texts of other tokenizers.
    known: words with their ids by path, which names the tokenizer; new ones are added.
    """
    whole = lambda t: np.array(tok.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
    if not (drops_space_and_case(tok) if by_words is None else by_words):
        return [whole(t) for t in texts]
    known = {} if known is None else known.setdefault(path, {})
    words = [None if b"<|" in t else t.lower().split() for t in texts]
    used = set().union(*[own for own in words if own])
    fresh = used.difference(known)
    if len(known) + len(fresh) > KNOWN_WORDS:
        known.clear()
        fresh = used
    # A run of closing signs after a letter or digit is a token of its own.
    stems = {w: w.rstrip(SIGNS) for w in fresh}
    cut = {w: stem for w, stem in stems.items() if len(stem) < len(w) and (stem[-1:].isalnum() or PLAIN(stem))}
    new = (fresh - cut.keys()).union(cut.values(), [w[len(stem) :] for w, stem in cut.items()]).difference(known)
    known.update(zip(new, encode_words(list(new), tok), strict=True))
    known.update({w: known[stem] + known[w[len(stem) :]] for w, stem in cut.items()})
    return [b"".join(map(known.__getitem__, own)) if own is not None else whole(t) for t, own in zip(texts, words, strict=True)]


def _pieces(path: str, capacity: int, end_id: int):
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        tok = _tokenizer(path)
        by_words, known = drops_space_and_case(tok), {}  # words are kept for this task
        for batch in batches:
            out: list[tuple] = []
            ids = token_bytes([t or b"" for t in batch.column(2).to_pylist()], tok, path, by_words, known)
            for doc, row, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ids, strict=True):
                own += end
                for k, at in enumerate(range(0, len(own), step)):
                    part = own[at : at + step]
                    out.append((doc, row, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                ["doc_id", "row", "piece", "start", "length", "ids_crc32"],
            )

    return run


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """{length: pieces} -> rows (length, first rank, last rank, first sequence, offset).

    Best-fit decreasing.  A run is a range of sequences alike so far, keyed by its room;
    the pieces of a length fill the fullest runs that have room for them, and each sequence
    takes as many of them as fit there before a new one is opened.
    """
    rooms: list[int] = []  # sorted; one entry for each room that some run has
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> [(first sequence, sequences)]
    opened, slots = 0, []

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in runs:
                bisect.insort(rooms, room)
                runs[room] = []
            runs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    rooms.pop(at)
            else:
                # As many new sequences as the rest of this length fills.
                room, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            # Fullest first: each sequence of the run is filled up before the next.
            each = min(room // length, -(-left // n)) if n * (room // length) >= left else room // length
            for k in range(each):
                take = min(n, left)
                slots.append((length, rank, rank + take - 1, first, capacity - room + k * length))
                rank += take
                left -= take
                if take < n:
                    put(room - (k + 1) * length, first, take)
                    put(room - k * length, first + take, n - take)
                    break
            else:
                put(room - each * length, first, n)
    return slots


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    parts: int | None = None,
) -> DataFrame:
    """docs (id_col, text) -> one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its whole text and then end_id; null counts as empty.  Documents
    over the capacity are cut into full pieces and a rest.  Equal lengths take their slots in
    the order (doc_id, row, piece); ids may be null or repeat, each row is packed by itself.  An
    empty table gives an empty result; other columns are not read and may have any name.
    tokenizer: path of a tokenizers JSON file, found on every executor.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text")
    pieces = stage(
        map_texts(base, ["doc_id", F.monotonically_increasing_id().alias("row")], _pieces(tokenizer, capacity, end_id),
                  "doc_id long, row long, piece int, start long, length long, ids_crc32 long"),
        "pieces",
    )
    # Ranks within a length: lengths are split by a hash, so that a common length is no hot key.
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pieces.count() // PART_ROWS))
    cut = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(n)))
    tally = stage(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "tally")
    before = tally.select(
        F.col("length").alias("t_length"),
        F.col("part").alias("t_part"),
        (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"),
    )
    # At most `capacity` rows come to the driver, and a few slots for each go back.
    counts = {int(r.length): int(r.n) for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(plan_slots(counts, capacity), PLAN_SCHEMA)
    ranked = (
        cut.withColumn("nth", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "row", "piece")) - 1)
        .join(before, (F.col("length") == F.col("t_length")) & (F.col("part") == F.col("t_part")))
        .withColumn("rank", F.col("before") + F.col("nth"))
    )
    placed = ranked.join(
        F.broadcast(plan),
        (F.col("length") == F.col("p_length")) & F.col("rank").between(F.col("first_rank"), F.col("last_rank")),
    )
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"),
        F.col("p_offset").cast("long").alias("offset"),
    )
