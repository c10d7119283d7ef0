"""Byte-level BPE in two tiers: whole pre-tokens by minimal perfect hash, the rest by merging.

A pre-token that is in the vocabulary is one token, found by a perfect hash without empty slots
(one displacement for each bucket of keys) and confirmed by its bytes. Any other one is merged:
its bytes are a doubly linked list of tokens, and a heap holds the mergeable pairs by (rank,
place), so that a pre-token of n bytes takes n log n steps, however long it is. What two
neighbouring tokens merge to is a table of pairs, made once from the splits of the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_batches

#: Pre-tokens whose result a worker keeps, and their longest length; when full, it starts afresh.
CACHED, CACHED_CHARS = 600_000, 48


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys, n slots."""

    def __init__(self, keys: list[bytes]) -> None:
        self.n = n = len(keys)
        self.buckets = max(1, (n + 3) // 4)
        groups: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for i, key in enumerate(keys):
            h = xxhash.xxh64_intdigest(key)
            groups[(h >> 40) % self.buckets].append((h, i))
        self.shift = [0] * self.buckets
        self.slots = [-1] * n
        free = None
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            own = groups[b]
            if not own:
                break
            if len(own) == 1:  # any free slot will do: it is stored itself, as a negative number
                free = free or [s for s in range(n) if self.slots[s] < 0]
                while self.slots[free[-1]] >= 0:
                    free.pop()
                self.slots[free[-1]] = own[0][1]
                self.shift[b] = -free.pop() - 1
                continue
            d = 0
            while True:
                places = {self._place(h, d) for h, _ in own}
                if len(places) == len(own) and all(self.slots[p] < 0 for p in places):
                    break
                d += 1
                if d > 1_000_000:
                    raise ValueError("keys aren't distinct")
            for h, i in own:
                self.slots[self._place(h, d)] = i
            self.shift[b] = d

    def _place(self, h: int, d: int) -> int:
        return ((((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF) >> 32) % self.n

    def __call__(self, key: bytes) -> int:
        """The key's index, if it is one; else some index."""
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[(h >> 40) % self.buckets]
        return self.slots[-d - 1 if d < 0 else self._place(h, d)]


class Pieces(dict):
    """Pre-token -> (ids in decimal with commas, number of ids, the bytes that they decode to)."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> tuple[str, int, bytes]:
        ids = self.codec.encode_piece(piece)
        known = (",".join(map(str, ids)), len(ids), self.codec.decode(ids))
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = known
        return known


class Codec:
    """Encoder and decoder of a rank file's vocabulary, which holds every single byte."""

    def __init__(self, rank_file: bytes, pattern: str) -> None:
        pairs = [line.split() for line in rank_file.splitlines() if line.strip()]
        self.keys = [base64.b64decode(k) for k, _ in pairs]
        self.ranks = [int(r) for _, r in pairs]
        rank_of = dict(zip(self.keys, self.ranks, strict=True))
        self.bytes_of = dict(zip(self.ranks, self.keys, strict=True))
        self.single = [rank_of[bytes([b])] for b in range(256)]
        self.hash = PerfectHash(self.keys)
        self.merged = {}
        for key, rank in rank_of.items():
            for cut in range(1, len(key)):
                left, right = rank_of.get(key[:cut]), rank_of.get(key[cut:])
                if left is not None and right is not None:
                    self.merged[left << 32 | right] = rank
        self.pattern = regex.compile(pattern)
        self.pieces = Pieces(self)

    def __getstate__(self) -> dict:
        """Tables and pattern travel (a few MB for 50,000 tokens); cached pieces don't."""
        return {k: v for k, v in self.__dict__.items() if k != "pieces"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.pieces = Pieces(self)

    def rank(self, key: bytes) -> int:
        """The rank of a byte string, -1 if it isn't in the vocabulary."""
        i = self.hash(key)
        return self.ranks[i] if self.keys[i] == key else -1

    def merge(self, raw: bytes) -> list[int]:
        """Token ids of one pre-token: the pair of lowest rank is merged first, the leftmost of equals."""
        n, find = len(raw), self.merged.get
        token = [self.single[b] for b in raw]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = find(token[i] << 32 | token[i + 1])
            if rank is not None:
                heap.append((rank, i, token[i], token[i + 1]))
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if token[i] != left or j >= n or token[j] != right:
                continue  # one of the two has been merged meanwhile
            token[i], token[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                new = find(rank << 32 | token[k])
                if new is not None:
                    heapq.heappush(heap, (new, i, rank, token[k]))
            h = before[i]
            if h >= 0:
                new = find(token[h] << 32 | rank)
                if new is not None:
                    heapq.heappush(heap, (new, h, token[h], rank))
        return [t for t in token if t >= 0]

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode()
        whole = self.rank(raw)
        return [whole] if whole >= 0 else self.merge(raw)

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.pattern.findall(text) for i in self.encode_piece(piece)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def round_trip(self, text: str) -> tuple[int, str, bytes]:
        """Number of ids, the ids in decimal with commas, and the bytes that they decode to."""
        found = list(map(self.pieces.__getitem__, self.pattern.findall(text)))
        return sum([f[1] for f in found]), ",".join([f[0] for f in found]), b"".join([f[2] for f in found])


def shared_codec(spark: SparkSession, rank_path: str, pattern: str) -> Broadcast:
    """The codec of a rank file on the driver, as a broadcast: its size is the vocabulary's."""
    with open(rank_path, "rb") as f:
        return spark.sparkContext.broadcast(Codec(f.read(), pattern))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the bytes that they decode to.

    A null text is an empty one: no tokens, and the digest of nothing, twice. Null doc_ids stay
    null, repeated rows give repeated results, an empty table an empty one, and other columns
    are not read.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = shared_codec(spark, rank_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            n, ids, decoded = [], [], []
            for value in batch.column(1):
                count, joined, raw = own.round_trip(value.as_py() or "")
                n.append(count)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], schema=_SCHEMA)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every text, whole whatever its length; nulls, repeated rows, empty
    tables and other columns count as in ``round_trip``."""
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = shared_codec(spark, rank_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            ids = [np.array(own.encode(v.as_py() or ""), np.int32) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")
