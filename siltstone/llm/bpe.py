"""Problem 8: encoding of all texts with a public byte-level BPE vocabulary.

A pre-token's symbols form a doubly linked list.  Mergeable neighbours lie in buckets, one per merge rank; which
buckets are filled is kept in a bitmap of three levels, so the next rank is found by three find-first-set steps
whatever the pre-token's length.  Entries whose symbols have changed since are skipped when they come up.  A
pre-token of n bytes takes O(n log n) steps at most (the sorting of the buckets), none of them over the whole list.
"""

from __future__ import annotations

import ast
import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZERS = os.environ.get("SILTSTONE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: Pre-tokens remembered per Python worker; longer ones than CACHED_BYTES are not.
CACHE, CACHED_BYTES = 1 << 18, 64


class RankQueue:
    """Positions by merge rank: a bucket per rank under a bitmap of three levels of 64 bits a word."""

    __slots__ = ("buckets", "low", "mid", "top")

    def __init__(self) -> None:
        self.buckets: dict[int, list] = {}
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, entry: tuple) -> None:
        got = self.buckets.get(rank)
        if got is not None:
            got.append(entry)
            return
        self.buckets[rank] = [entry]
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> tuple[int, list]:
        """The least rank and its entries; the queue must not be empty."""
        b = (self.top & -self.top).bit_length() - 1
        m = self.mid[b]
        a = b << 6 | (m & -m).bit_length() - 1
        x = self.low[a]
        bit = x & -x
        self.low[a] = x ^ bit
        if x == bit:
            self.mid[b] = m = m ^ 1 << (a & 63)
            if not m:
                self.top ^= 1 << b
        rank = a << 6 | bit.bit_length() - 1
        return rank, self.buckets.pop(rank)


@lru_cache(2)
def vocabulary_of(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> tuple[dict[bytes, int], str]:
    """Merge ranks and the pattern of pre-tokens, read on the driver and sent to the workers with the job.

    The pattern is the string constant PATTERN of the folder's __init__.py, which is read, not run."""
    with open(os.path.join(folder, "__init__.py"), encoding="utf-8") as f:
        tree = ast.parse(f.read())
    pattern = next(ast.literal_eval(n.value) for n in tree.body if isinstance(n, ast.Assign) and any(getattr(t, "id", "") == "PATTERN" for t in n.targets))
    with open(os.path.join(folder, f"{vocabulary}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.single = [ranks[bytes([i])] for i in range(256)]
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.pairs: dict[tuple[int, int], int | None] = {}
        self.cache: dict[str, tuple[int, ...]] = {}

    @classmethod
    def load(cls, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Encoder:
        return cls(*vocabulary_of(folder, vocabulary))

    def _pair(self, a: int, b: int) -> int | None:
        key = (a, b)
        if key not in self.pairs:
            if len(self.pairs) > CACHE:
                self.pairs.clear()
            self.pairs[key] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
        return self.pairs[key]

    def merge(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        ids = [self.single[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue, pair = RankQueue(), self._pair
        for i in range(n - 1):
            if (r := pair(ids[i], ids[i + 1])) is not None:
                queue.push(r, (i, ids[i], ids[i + 1]))
        while queue.top:
            rank, entries = queue.pop()
            entries.sort()
            for i, a, b in entries:
                j = after[i]
                if ids[i] != a or j >= n or ids[j] != b:
                    continue  # stale
                k = after[j]
                ids[i], ids[j] = rank, -1
                after[i] = k
                if k < n:
                    before[k] = i
                    if (r := pair(rank, ids[k])) is not None:
                        queue.push(r, (i, rank, ids[k]))
                if (h := before[i]) >= 0 and (r := pair(ids[h], rank)) is not None:
                    queue.push(r, (h, ids[h], rank))
        return tuple(x for x in ids if x >= 0)

    def encode(self, text: str | None) -> list[int]:
        """Ids of the text as it stands; none for null and for the empty text.

        Lone surrogates cannot be written in UTF-8 and are encoded as U+FFFD.
        """
        out: list[int] = []
        if not text:
            return out
        cache = self.cache
        for piece in self.split(text):
            got = cache.get(piece)
            if got is None:
                raw = piece.encode("utf-8", "surrogatepass").decode("utf-8", "replace").encode()
                got = self.merge(raw)
                if len(raw) <= CACHED_BYTES:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[piece] = got
            out += got
        return out


@lru_cache(4)
def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Encoder:
    """The driver's own encoder."""
    return Encoder.load(folder, vocabulary)


_made: dict[tuple[str, str], Encoder] = {}  # a worker's own


def _shared(spark, folder: str, vocabulary: str):
    """A broadcast of the vocabulary (of fixed size, under 2 MB) and a function that gives a worker's one encoder."""
    at = spark.sparkContext.broadcast(vocabulary_of(folder, vocabulary))

    def get() -> Encoder:
        if (folder, vocabulary) not in _made:
            _made[folder, vocabulary] = Encoder(*at.value)
        return _made[folder, vocabulary]

    return get


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """key, ids: one row per row of df, ids an empty list for null and empty text.  Other columns are ignored."""
    get = _shared(df.sparkSession, folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = get()
        for b in batches:
            ids = pa.array([enc.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.record_batch([b.column(0), ids], [key, "ids"])

    rows = df.select(key, text)
    return rows.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, ids array<int>")


def count(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """key, tokens: as ``encode``, only the number of ids."""
    get = _shared(df.sparkSession, folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = get()
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([len(enc.encode(t)) for t in b.column(1).to_pylist()], pa.int64())], [key, "tokens"])

    rows = df.select(key, text)
    return rows.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, tokens bigint")
