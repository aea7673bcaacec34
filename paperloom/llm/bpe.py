"""Problem 8: encoding with a public byte-level BPE vocabulary.

The merges of a pre-token run over a rank queue: one bucket per merge rank holds positions
of a linked list, and a three-level bitmap of non-empty buckets finds the next rank by
find-first-set. A merge only adds the two new pairs at its ends; entries whose pair has
changed meanwhile are skipped when popped. A pre-token of n bytes costs O(n) queue
operations, whatever its length.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paperloom.runtime import ship

WORD = 64


#: Cached pairs of a worker: some 128 bytes each, 64 MB in all.
PAIRS = (64 << 20) // 128


class RankQueue:
    """Buckets of positions by rank with a hierarchical bitmap over 64-bit words."""

    __slots__ = ("buckets", "l0", "l1", "l2")

    def __init__(self, size: int):
        self.buckets: dict[int, list[int]] = {}
        n0 = size // WORD + 1
        n1 = n0 // WORD + 1
        self.l0, self.l1, self.l2 = [0] * n0, [0] * n1, 0

    def push(self, rank: int, pos: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [pos]
            a = rank >> 6
            b = a >> 6
            self.l0[a] |= 1 << (rank & 63)
            self.l1[b] |= 1 << (a & 63)
            self.l2 |= 1 << b
        else:
            bucket.append(pos)

    def first(self) -> int:
        """Lowest rank with a non-empty bucket, -1 if none: find-first-set on each level."""
        if not self.l2:
            return -1
        b = (self.l2 & -self.l2).bit_length() - 1
        x = self.l1[b]
        a = (b << 6) + (x & -x).bit_length() - 1
        x = self.l0[a]
        return (a << 6) + (x & -x).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """Remove and give the bucket's positions in ascending order."""
        positions = self.buckets.pop(rank)
        a = rank >> 6
        b = a >> 6
        self.l0[a] &= ~(1 << (rank & 63))
        if not self.l0[a]:
            self.l1[b] &= ~(1 << (a & 63))
            if not self.l1[b]:
                self.l2 &= ~(1 << b)
        positions.sort()
        return positions


class ByteBpe:
    """An encoder over ranks of byte strings; holds a bounded cache of short pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.size = max(ranks.values(), default=0) + 1
        self.single = [ranks.get(bytes([i]), -1) for i in range(256)]
        self.split = regex.compile(pattern).findall
        self.pairs: dict[tuple[int, int], int] = {}
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.cache = _Cache(self)

    def pair_rank(self, left: int, right: int) -> int:
        """Rank of the merge of two tokens, -1 if there is none."""
        key = (left, right)
        r = self.pairs.get(key)
        if r is None:
            r = self.ranks.get(self.bytes_of[left] + self.bytes_of[right], -1)
            if len(self.pairs) < PAIRS:
                self.pairs[key] = r
        return r

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        token = [self.single[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_at = [-1] * n
        queue, pair_rank = RankQueue(self.size), self.pair_rank
        for i in range(n - 1):
            r = pair_rank(token[i], token[i + 1])
            rank_at[i] = r
            if r >= 0:
                queue.push(r, i)
        while (rank := queue.first()) >= 0:
            todo = queue.take(rank)
            for k, i in enumerate(todo):
                if rank_at[i] != rank:
                    continue  # stale
                j = after[i]
                token[i] = rank
                rank_at[j] = -1
                nxt = after[j]
                after[i] = nxt
                lowest = rank
                if nxt < n:
                    before[nxt] = i
                    r = pair_rank(rank, token[nxt])
                    rank_at[i] = r
                    if r >= 0:
                        queue.push(r, i)
                        lowest = min(lowest, r)
                else:
                    rank_at[i] = -1
                prev = before[i]
                if prev >= 0:
                    r = pair_rank(token[prev], rank)
                    rank_at[prev] = r
                    if r >= 0:
                        queue.push(r, prev)
                        lowest = min(lowest, r)
                if lowest < rank:  # a lower rank appeared: it goes first
                    for rest in todo[k + 1:]:
                        queue.push(rank, rest)
                    break
        out, i = [], 0
        while i < n:
            out.append(token[i])
            i = after[i]
        return out

    def packed(self, text: str | None) -> bytes:
        """Ids of a text as packed 32-bit integers; null and empty texts have none."""
        return b"".join(map(self.cache.__getitem__, self.split(text))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text as a list."""
        return array("i", self.packed(text)).tolist()


class _Cache(dict):
    """Packed ids by pre-token; short ones are remembered, up to a bound."""

    ENTRIES, LENGTH = 400_000, 48

    def __init__(self, bpe: ByteBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", self.bpe.merge(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(piece) <= self.LENGTH:
            if len(self) >= self.ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


def default_vocabulary() -> str:
    """Place of byte_bpe_50k on this machine."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def load(path: str | None = None) -> ByteBpe:
    """The encoder of a rank file; loaded once per worker process. No path: byte_bpe_50k."""
    import public_tokenizers as P

    path = path or default_vocabulary()
    with open(os.fspath(path), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    return ByteBpe(ranks, P.PATTERN)


def _encode_batches(path: str | None, id_col: str, text_col: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            packed = [bpe.packed(t) for t in b.column(text_col).to_pylist()]
            offsets = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
            flat = pa.array(np.frombuffer(b"".join(packed), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.ListArray.from_arrays(offsets, flat)], [id_col, "ids"])

    return run


def _count_batches(path: str | None, keep: list[str], text_col: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            n = [len(bpe.packed(t)) // 4 for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(n, pa.int64())], [*keep, "n_tokens"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids): token ids of every text, without special tokens; their strings in a text
    are ordinary text. Null and empty texts have an empty list. Whole texts are encoded,
    a row at a time inside Arrow batches: no shuffle. Other columns are not read."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        _encode_batches(path, id_col, text_col), f"`{id_col}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, keep: list[str], text_col: str = "text", path: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of every row; 0 for null and empty texts."""
    ship(docs.sparkSession)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, text_col).mapInArrow(_count_batches(path, keep, text_col), f"{schema}, n_tokens long")
