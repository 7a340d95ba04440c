"""Encoding of a corpus with a public byte-level BPE tokenizer.

A text is cut into pre-tokens by the tokenizer's pattern. A pre-token's bytes form a linked list; a bucket for every
merge rank holds the list positions where that merge is open. Which buckets are filled is kept in a hierarchical bitmap
of 64-bit words, in which find-first-set gives the lowest rank in a few steps, so a merge costs the same however long
the pre-token is. Entries whose pair has changed since are skipped. Encodings of pre-tokens are kept in a bounded
dictionary of the worker.

Defined results: null and empty texts have an empty list. Texts that look like special tokens are plain text; no
special tokens are added. Repeated rows give repeated rows. The vocabulary is a file of base64 tokens and ranks, whose
path is a parameter; the driver's file is sent along with the job, so workers need none of their own.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The tokenizer's pre-token pattern (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_KEPT = 300_000
MOST_PAIRS = 1_000_000
LONGEST_KEPT = 64


class RankQueue:
    """Positions by rank; the lowest rank that has any is found through three levels of 64-bit words."""

    def __init__(self, ranks: int):
        if ranks > 1 << 18:
            raise ValueError("three levels of 64-bit words hold 262144 ranks")
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((ranks >> 6) + 1)
        self.middle = [0] * ((ranks >> 12) + 1)
        self.high = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.middle[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.high |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its positions in ascending order."""
        if not self.high:
            return None
        a = (self.high & -self.high).bit_length() - 1
        word = self.middle[a]
        b = a << 6 | (word & -word).bit_length() - 1
        word = self.low[b]
        rank = b << 6 | (word & -word).bit_length() - 1
        self.low[b] &= ~(1 << (rank & 63))
        if not self.low[b]:
            self.middle[a] &= ~(1 << (b & 63))
            if not self.middle[a]:
                self.high &= ~(1 << a)
        bucket = self.buckets.pop(rank)
        if len(bucket) > 1:
            bucket.sort()
        return rank, bucket


class Kept(dict):
    """Encodings of pre-tokens; one that is not there is made by encode, and kept unless it is long."""

    def __init__(self, encode: Callable[[bytes], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> list[int]:
        ids = self.encode(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= MOST_KEPT:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, vocabulary: str, pattern: str = PATTERN):
        with open(vocabulary, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.bytes = [self.ranks[bytes([b])] for b in range(256)]
        self.pattern = regex.compile(pattern)
        self.queue = RankQueue(max(self.tokens) + 1)
        self.pairs: dict[tuple[int, int], int] = {}
        self.kept = Kept(self.piece)

    def _rank(self, left: int, right: int) -> int:
        """Rank, and id, of the token that two neighbours merge into; -1 if there is none. It is kept in pairs."""
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        rank = self.pairs[left, right] = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
        return rank

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.bytes[b] for b in piece]
        size = len(ids)
        if size < 2:
            return ids
        push, pop, kept, look = self.queue.push, self.queue.pop, self.pairs.get, self._rank
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        last = ids[0]
        for i in range(1, size):
            own = ids[i]
            if (rank := kept((last, own))) is None:
                rank = look(last, own)
            if rank >= 0:
                push(rank, i - 1)
            last = own
        while (lowest := pop()) is not None:
            rank, positions = lowest
            for k, at in enumerate(positions):
                right, own = after[at], ids[at]
                if own < 0 or right >= size:
                    continue
                other = ids[right]
                # Skipped if the pair has changed since: its rank tells.
                if (found := kept((own, other))) is None:
                    found = look(own, other)
                if found != rank:
                    continue
                ids[at], ids[right] = rank, -1
                after[at] = beyond = after[right]
                least = rank
                if beyond < size:
                    before[beyond] = at
                    other = ids[beyond]
                    if (new := kept((rank, other))) is None:
                        new = look(rank, other)
                    if new >= 0:
                        push(new, at)
                        least = min(least, new)
                left = before[at]
                if left >= 0:
                    other = ids[left]
                    if (new := kept((other, rank))) is None:
                        new = look(other, rank)
                    if new >= 0:
                        push(new, left)
                        least = min(least, new)
                if least < rank:
                    # A lower rank has opened: it goes first, the rest of this one waits.
                    for waiting in positions[k + 1 :]:
                        push(rank, waiting)
                    break
        return [i for i in ids if i >= 0]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self.kept.__getitem__, self.pattern.findall(text))))

    def count(self, text: str | None) -> int:
        """The number of encode's ids, without listing them."""
        return sum(map(len, map(self.kept.__getitem__, self.pattern.findall(text)))) if text else 0


@lru_cache(maxsize=4)
def encoder(vocabulary: str, pattern: str = PATTERN) -> Encoder:
    """The worker's encoder; a Python worker that is used again keeps it."""
    return Encoder(vocabulary, pattern)


def _sent(documents: DataFrame, vocabulary: str) -> str:
    """Send the vocabulary's file to the workers, once a session; gives the name under which they find it."""
    context = documents.sparkSession.sparkContext
    sent = context.__dict__.setdefault("_weftline_sent", {})
    if vocabulary not in sent:
        context.addFile(vocabulary)
        sent[vocabulary] = os.path.basename(vocabulary)
    return sent[vocabulary]


def _own(name: str) -> Encoder:
    return encoder(SparkFiles.get(name))


def encode(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids): the token ids of each text."""
    kind, file = documents.schema[id_column].dataType.simpleString(), _sent(documents, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _own(file)
        for batch in batches:
            lists = [own.encode(text) for text in batch.column("text").to_pylist()]
            offsets = np.cumsum([0, *map(len, lists)], dtype=np.int32)
            values = pa.array(np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(offsets[-1])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), values)], ["id", "ids"])

    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids ARRAY<INT>").withColumnRenamed("id", id_column)


def token_counts(documents: DataFrame, text_column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """documents without the text, with n_tokens."""
    file = _sent(documents, vocabulary)
    others = [c for c in documents.columns if c != text_column]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name != text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _own(file)
        for batch in batches:
            sizes = pa.array([own.count(text) for text in batch.column(text_column).to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], sizes], [*others, "n_tokens"])

    return documents.select(*others, text_column).mapInArrow(run, f"{schema}, n_tokens BIGINT")
