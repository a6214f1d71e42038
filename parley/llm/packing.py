"""Best-fit-decreasing packing of tokenised documents into sequences."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch

CAPACITY = 2048
END = 0
VOCABULARY = "byte_bpe_50k.json"
CACHE = 400_000
#: The pre-tokeniser's pattern; white space other than space and newline.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER_SPACE = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
CHUNK_ROWS = 200_000


def _byte_of_letter() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others are numbered from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Words(dict):
    """Word -> bytes of its ids, worked out when first asked for; emptied at CACHE entries."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        found = self[word] = self.encode(word)
        return found


class Encoder:
    """Exact ids of whole texts, with those of words seen before kept.

    The pre-tokeniser always parts a text before a single space or newline that
    stands between other characters, so words between them can be encoded one by
    one, by merge ranks read from the tokenizer's own file. A text with other
    white space, with white space beside white space, or with the literal of an
    added token (which stands for that token's id) is encoded whole.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in spec["added_tokens"]]
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")
        if self.by_word:
            letter = _byte_of_letter()
            ranks = {bytes(letter[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in self.added}
            ranked = tiktoken.Encoding("words", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
            one = ranked._encode_single_piece

            def encode(word: str) -> bytes:
                ids = one(word) if word.lstrip(" ").isalpha() else ranked.encode_ordinary(word)
                return np.array(ids, "<u4").tobytes()

            self.first, self.later = _Words(encode), _Words(lambda w: encode(f" {w}"))
            self.newline = encode("\n")

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if not self.by_word or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in ("  ", " \n", "\n ", "\n\n")) or OTHER_SPACE.search(text) or any(t in text for t in self.added):
            return self._encode([text])[0]
        first, later, out = self.first, self.later, []
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(first[words[0]])
            out += [later[w] for w in words[1:]]
            out.append(self.newline)
        out.pop()
        return b"".join(out)


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _cut(path: str, capacity: int):
    """(doc_id, text) -> a row per piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            which, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(batch.column(1)):
                ids = enc.ids(text.as_py() or "") + END.to_bytes(4, "little")
                n, at = len(ids) // 4, 0
                while at < n:
                    size = n % capacity if at == 0 and n % capacity else capacity
                    which.append(k), piece.append(at // capacity + bool(at % capacity)), start.append(at), length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    at += size
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


class CapacityTree:
    """Segment tree over remaining capacities 1..capacity; a leaf holds groups of alike open bins."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.width)  # groups below a node
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _add(self, remaining: int, by: int) -> None:
        at = remaining + self.width
        while at:
            self.open[at] += by
            at >>= 1

    def push(self, remaining: int, group: tuple[int, int]) -> None:
        if remaining and group[1]:
            self.groups[remaining].append(group)
            self._add(remaining, 1)

    def pop(self, remaining: int) -> tuple[int, int]:
        self._add(remaining, -1)
        return self.groups[remaining].pop()

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity of at least `need`, in logarithmic time."""
        at = need + self.width
        if self.open[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.width
            at >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Exact best-fit decreasing over how many pieces have each length.

    Pieces of one length are placed together: the tightest bin stays the
    tightest until it can hold no more of them, so whole groups of alike bins are
    filled at once. The work follows the number of lengths, not of pieces.
    Returns slots (length, first rank, ranks, first sequence, offset, pieces a sequence).
    """
    tree, slots, made = CapacityTree(capacity), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, group = capacity, (made, -(-left // (capacity // length)))
                made += group[1]
            else:
                group = tree.pop(room)
            each = room // length
            used = min(group[1], -(-left // each))
            tree.push(room, (group[0] + used, group[1] - used))
            take = min(left, used * each)
            full, rest = divmod(take, each)
            slots.append((length, rank, take, group[0], capacity - room, each))
            tree.push(room - each * length, (group[0], full))
            if rest:
                tree.push(room - rest * length, (group[0] + full, 1))
            rank, left = rank + take, left - take
    return slots


def _place(slots: list[tuple[int, int, int, int, int, int]]):
    """Rank within a length -> sequence and offset, by binary search in the slots."""
    by: dict[int, np.ndarray] = {}
    for s in slots:
        by.setdefault(s[0], []).append(s[1:])
    by = {k: np.array(v, np.int64) for k, v in by.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for length, rows in pdf.groupby("length").indices.items():
                table, rank = by[length], pdf["rank"].to_numpy()[rows]
                s = table[np.searchsorted(table[:, 0], rank, side="right") - 1]
                j = rank - s[:, 0]
                sequence[rows], offset[rows] = s[:, 2] + j // s[:, 4], s[:, 3] + (j % s[:, 4]) * length
            yield pdf.assign(sequence_id=sequence, offset=offset).drop(columns="rank")

    return run


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then id 0; a null or empty text is id 0 alone. The
    literal of an added token, such as <|endoftext|>, is that token's id, as the
    tokenizer has it by default.
    Rows with a null or repeated doc_id are packed each. An empty table gives an
    empty result. Only the number of pieces of each length (at most `capacity`
    rows) reaches the driver, which packs all of them at once; pieces are then
    ranked within their length in chunks, so a common length is no hot group.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        _cut(path or vocabulary_path(), capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )
    pieces = scratch.keep(cut, "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # `capacity` rows at most
    slots = best_fit_decreasing(counts, capacity)
    chunks = max(16, -(-sum(counts.values()) // CHUNK_ROWS))
    chunk = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(chunks)).cast("int")
    chunked = pieces.withColumn("chunk", chunk)
    per = chunked.groupBy("length", "chunk").count()  # capacity x chunks rows at most
    before = F.coalesce(F.sum("count").over(W.partitionBy("length").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = per.select("length", "chunk", before.alias("before"))
    ranked = chunked.withColumn("within", F.row_number().over(W.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")))
    joined = ranked.join(offsets, ["length", "chunk"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within") - 1).alias("rank")
    )
    return joined.mapInPandas(_place(slots), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
