"""Problem 7: near-duplicate records with small edits, found exactly by bit-sliced comparison.

1. One pass over all texts hashes the runs of three words (shingles), notes the text's digest and counts the
   shingles in a table of about two cells a shingle, up to 2**MAX_BITS.  Equal texts are one text from here on.
2. Two texts of similarity t or more share one of the n - ceil(t n) + 1 first shingles of each, in any common
   order of the shingles.  The order is by count, rare first, so few texts meet at a shingle.  Each text is sent to
   the places of those shingles with a parity sketch: every shingle flips one of 256 bits, so the Hamming distance of
   two sketches never exceeds the number of shingles in only one of the texts, and a pair beyond the radius
   floor((1 - t) / (1 + t) * (|x| + |y|)) cannot be similar.  Short texts travel with a sketch folded to 128 bits.
3. A place holds its texts' sketches as vertical bit planes.  All pairs at one offset are compared at once: planes
   are shifted, combined by exclusive or and summed by carry-save counters, 64 pairs a word; words in which all
   pairs exceed their radius are abandoned.
4. What is left is compared exactly.

No link is lost: steps 2 and 3 only drop pairs that cannot reach t.  A place with more than CELL texts is split into
cells of pairs of parts that go to different tasks; how many it has is known from the table where cells are shared by
few shingles (MAX_LOAD), and is counted exactly beyond that.  Tasks of step 3 hold one of many parts of the places at a
time, whose number follows from the counted shingles.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import cut, width

WORDS, THRESHOLD = 3, 0.6
#: log2 of the count table's most cells; cells a slice of it; texts that one cell of a place is meant for.
MAX_BITS, SLICE, CELL = 24, 1 << 16, 2048
#: Shingles a cell of the table up to which its count is as good as the shingle's own, to split places by.
MAX_LOAD = CELL // 8
#: Entries (a text at a place) that a part is meant for, and shingles at crowded places the driver may get.
PART_ENTRIES, MAX_CROWDED = 1 << 20, 1 << 22
#: Tasks' tables that are added in one step.
SALTS = 256
#: The table's bytes: counts, but these two for more than they say and for more than CELL.
SOME, CROWDED = 254, 255
#: Bits of a text's sketch; texts of up to SHORT shingles travel with a sketch folded to SHORT_PLANES bits.
PLANES, SHORT, SHORT_PLANES = 256, 64, 128
#: log2 of the most bits of the table that keeps texts without a candidate from the last shuffle.
REDUCER_BITS = 26
_WORD = re.compile(r"[^\W_]+")
_MIX1, _MIX2, _MIX3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64's)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingles(docs: list[list[str]], size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of all docs, one doc after another, and each doc's number of them."""
    flat = [w for d in docs for w in d]
    if not flat:
        return np.empty(0, np.uint64), np.zeros(len(docs), np.int64)
    code, vocabulary = pd.factorize(np.array(flat, dtype=object))
    own = np.array([int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for w in vocabulary], np.uint64)[code]
    n = np.array([len(d) for d in docs], np.int64)
    doc = np.repeat(np.arange(len(docs)), n)
    last = len(own) - size + 1
    if last <= 0:
        return np.empty(0, np.uint64), np.zeros(len(docs), np.int64)
    h = own[:last].copy()
    for k in range(1, size):
        h = mix(h * _MIX3 + own[k : k + last])
    inside = doc[:last] == doc[size - 1 :]
    h, doc = h[inside], doc[:last][inside]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.bincount(doc[keep], minlength=len(docs))


def prefix_length(n: np.ndarray, t: Fraction) -> np.ndarray:
    """n - ceil(t n) + 1, exactly."""
    return n + (-t.numerator * n) // t.denominator + 1


def _packed_cells(cell: np.ndarray, n: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Slices and their cells' counts: offsets in the slice, then counts."""
    at = cell // SLICE
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.empty(0, np.int64)
    out = []
    for lo, hi in zip(first, np.r_[first[1:], len(at)].astype(np.int64)):
        out.append(zlib.compress((cell[lo:hi] % SLICE).astype(np.uint16).tobytes() + np.minimum(n[lo:hi], 2**32 - 1).astype(np.uint32).tobytes(), 1))
    return at[first].tolist(), out


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(raw)
    m = len(raw) // 6
    return np.frombuffer(raw, np.uint16, m), np.frombuffer(raw, np.uint32, m, 2 * m)


def _read(size: int, bits: int):
    """rowid, content -> rows (rowid, digest) of texts with a shingle, then rows (slice, counts) of the task."""
    names = ["rowid", "digest", "slice", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, totals, seen, held = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def count() -> None:
            nonlocal cells, totals, seen, held
            if seen:
                c, n = np.unique(np.concatenate(seen), return_counts=True)
                both, n = np.concatenate([cells, c]), np.concatenate([totals, n])
                cells, at = np.unique(both, return_inverse=True)
                totals = np.bincount(at, n).astype(np.int64)
            seen, held = [], 0

        for b in batches:
            docs = [words(t) for t in b.column(1).to_pylist()]
            h, _ = shingles(docs, size)
            seen.append((h >> np.uint64(64 - bits)).astype(np.int64))
            held += len(h)
            if held > 1 << 22:
                count()
            ids, digests = [], []
            for r, d in zip(b.column(0).to_pylist(), docs, strict=True):
                if len(d) >= size:
                    ids.append(r)
                    digests.append(hashlib.blake2b(" ".join(d).encode("utf-8", "surrogatepass"), digest_size=16).digest())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())], names)
        count()
        at, packed = _packed_cells(cells, totals)
        yield pa.record_batch([pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary()), pa.array(at, pa.int32()), pa.array(packed, pa.binary())], names)

    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Rows (slice, counts) sorted by slice -> each slice and its cells' sums."""
    at, total = None, np.zeros(SLICE, np.uint64)
    for b in batches:
        for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if i != at:
                if at is not None:
                    yield at, total
                at, total = i, np.zeros(SLICE, np.uint64)
            cell, n = _unpacked(raw)
            total[cell] += n
    if at is not None:
        yield at, total


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for i, total in _slices(batches):
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array([i], pa.int32()), pa.array(_packed_cells(at, total[at])[1], pa.binary())], ["slice", "counts"])


def _finish_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for i, n in _slices(batches):
        table = np.where(n > CELL, CROWDED, np.minimum(n, SOME)).astype(np.uint8)
        crowded = pa.array([n[n > CELL].astype(np.int64).tolist()], pa.list_(pa.int64()))
        yield pa.record_batch([pa.array([i], pa.int32()), pa.array([zlib.compress(table.tobytes(), 1)], pa.binary()), crowded, pa.array([int(n.sum())], pa.int64()), pa.array([int(n[n > 1].sum())], pa.int64())], ["slice", "bytes", "crowded", "n", "several"])


@dataclass
class Counts:
    """The table: a byte a cell, and the counts of its crowded cells."""

    bits: int
    table: np.ndarray
    cells: np.ndarray
    counts: np.ndarray

    def of(self, h: np.ndarray) -> np.ndarray:
        """Counts to order shingles by; more than SOME are alike up to CELL."""
        cell = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.table[cell].astype(np.int64)
        at = np.flatnonzero(out == CROWDED)
        if len(at):
            out[at] = self.counts[np.searchsorted(self.cells, cell[at])]
        return out


def _count_table(read: DataFrame, bits: int) -> tuple[Counts, int, int]:
    """The counts of all texts, all shingles, and those counted more than once; the driver gets 2**bits bytes and, of
    crowded cells, of which there are at most one in CELL shingles, the counts."""
    rows = read.filter("slice is not null").select("slice", "counts")
    spark, tasks = read.sparkSession, read.rdd.getNumPartitions()
    if tasks > SALTS:  # many tables are added in two steps
        salted = rows.withColumn("salt", F.spark_partition_id() % SALTS)
        rows = salted.repartition("slice", "salt").sortWithinPartitions("salt", "slice").select("slice", "counts").mapInArrow(_add_slices, "slice int, counts binary")
    done = rows.repartition(min(width(spark), max(1, (1 << bits) // SLICE)), "slice").sortWithinPartitions("slice").mapInArrow(_finish_slices, "slice int, bytes binary, crowded array<bigint>, n bigint, several bigint")
    table, cells, counts, every, several = np.zeros(1 << bits, np.uint8), [], [], 0, 0
    for r in done.toLocalIterator(prefetchPartitions=True):
        own, at = np.frombuffer(zlib.decompress(r["bytes"]), np.uint8), r["slice"] * SLICE
        table[at : at + SLICE] = own[: len(table) - at]
        cells.append(np.flatnonzero(own == CROWDED) + at)
        counts.append(np.array(r["crowded"], np.int64))
        every, several = every + r["n"], several + r["several"]
    cells, counts = (np.concatenate([np.empty(0, np.int64), *x]) for x in (cells, counts))
    order = np.argsort(cells)
    return Counts(bits, table, cells[order], counts[order]), every, several


def _prefixes(docs: list[list[str]], size: int, t: Fraction, counts: Counts) -> tuple[np.ndarray, ...]:
    """All shingles and their number in each text, and of the prefixes' ones counted more than once hash, count, text."""
    h, n = shingles(docs, size)
    seen = counts.of(h)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, seen, doc))
    at, seen = h[order], seen[order]
    rank = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    keep = (rank < np.repeat(prefix_length(n, t), n)) & (seen > 1)  # a shingle counted once is in one text
    return h, n, at[keep], seen[keep], doc[keep]


def _crowded(texts: DataFrame, size: int, t: Fraction, counts) -> tuple[np.ndarray, np.ndarray] | None:
    """Shingles with more than CELL texts at their place, and how many: counted exactly, before the shuffle first.

    None if there are too many for the driver; then places are split by the table's upper bounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, _, h, seen, _ = _prefixes([words(x) for x in b.column(1).to_pylist()], size, t, counts.value)
            yield pa.record_batch([pa.array(h[seen > CELL].view(np.int64))], ["h"])

    many = cut(texts.mapInArrow(run, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL))
    if many.count() > MAX_CROWDED:
        return None
    got = [(r["h"], r["n"]) for r in many.toLocalIterator()]
    h = np.array([x for x, _ in got], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.array([x for _, x in got], np.int64)[order]


def parity(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(docs, PLANES / 64) words: shingle h flips bit h % PLANES."""
    bit = (h & np.uint64(PLANES - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    odd = (np.bincount(doc * PLANES + bit, minlength=len(n) * PLANES) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(n), PLANES), axis=1, bitorder="little").view(np.uint64)


def _places(size: int, t: Fraction, counts, crowded, parts: int):
    """rowid, content -> part, texts: the batch's texts that have places of the part, with their sketches and places."""
    names = ["part", "texts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            every, n, h, seen, doc = _prefixes([words(x) for x in b.column(1).to_pylist()], size, t, counts.value)
            sketch = parity(every, n)
            if crowded is not None:  # exact numbers of texts
                big, many = crowded.value
                at = np.minimum(np.searchsorted(big, h), max(len(big) - 1, 0))
                seen = np.where(big[at] == h, many[at], 1) if len(big) else np.ones_like(seen)
            # a place of g parts: this text's part against each
            g = -(-seen // CELL)
            at = np.repeat(np.arange(len(h)), g)
            mine = (mix(ids[doc].astype(np.uint64) + h) % g.astype(np.uint64)).astype(np.int64)[at]
            other = np.arange(len(at)) - np.repeat(np.cumsum(g) - g, g)
            lo, hi = np.minimum(mine, other), np.maximum(mine, other)
            place = mix(h[at] + (lo * 65537 + hi).astype(np.uint64) * _MIX3) if len(h) else h
            # 0: all pairs of the cell count; 1, 2: only pairs of the two parts
            side = np.where(lo == hi, 0, np.where(mine == lo, 1, 2)).astype(np.int8)
            doc = doc[at]
            part = (place % np.uint64(parts)).astype(np.int32)
            short = (place >> np.uint64(32)).astype(np.uint32)
            order = np.lexsort((doc, part))
            doc, part, short, side = doc[order], part[order], short[order], side[order]
            edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, np.int64)
            out = []
            for lo, hi in zip(edges, np.r_[edges[1:], len(part)].astype(np.int64)):
                own, at = np.unique(doc[lo:hi], return_inverse=True)
                long = n[own] > SHORT
                out.append(packed(ids[own].min()[None], ids[own] - ids[own].min(), n[own], fold(sketch[own[~long]]), sketch[own[long]], at, short[lo:hi], side[lo:hi] if side[lo:hi].any() else side[:0]))
            yield pa.record_batch([pa.array(part[edges]), pa.array(out, pa.binary())], names)

    return run


def fold(sketch: np.ndarray) -> np.ndarray:
    """Sketches of PLANES bits to those of SHORT_PLANES: shingle h flips bit h % SHORT_PLANES."""
    return np.bitwise_xor.reduce(sketch.reshape(len(sketch), PLANES // SHORT_PLANES, SHORT_PLANES // 64), axis=1)


_KINDS = [np.uint8, np.uint16, np.uint32, np.uint64, np.int64]


def packed(*columns: np.ndarray) -> bytes:
    """Arrays of numbers as bytes, each in the narrowest kind that holds it."""
    out = []
    for c in columns:
        flat = c.reshape(-1)
        low, high = (int(flat.min()), int(flat.max())) if len(flat) else (0, 0)
        kind = 4 if low < 0 else next(i for i in range(4) if high <= np.iinfo(_KINDS[i]).max)
        out.append(kind.to_bytes(1, "little") + len(flat).to_bytes(4, "little") + flat.astype(_KINDS[kind]).tobytes())
    return b"".join(out)


def unpacked(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        kind, m = np.dtype(_KINDS[raw[at]]), int.from_bytes(raw[at + 1 : at + 5], "little")
        out.append(np.frombuffer(raw, kind, m, at + 5))
        at += 5 + m * kind.itemsize
    return out


class CarrySave:
    """Vertical counters: per level a plane and the carries waiting to be added to it."""

    def __init__(self, levels: int, words_: int) -> None:
        self.sum = [np.zeros(words_, np.uint64) for _ in range(levels)]
        self.waiting: list[np.ndarray | None] = [None] * levels

    def add(self, plane: np.ndarray, level: int = 0) -> None:
        while level < len(self.sum):
            other, self.waiting[level] = self.waiting[level], None
            if other is None:
                self.waiting[level] = plane
                return
            s = self.sum[level]
            u = s ^ other
            plane, self.sum[level] = (s & other) | (u & plane), u ^ plane
            level += 1

    def totals(self) -> list[np.ndarray]:
        out, carry = [], None
        for s, w in zip(self.sum, self.waiting, strict=True):
            terms = [x for x in (w, carry) if x is not None]
            carry = None
            for x in terms:
                c = s & x
                s = s ^ x
                carry = c if carry is None else carry | c
            out.append(s)
        return out

    def keep(self, at: np.ndarray) -> None:
        self.sum = [s[at] for s in self.sum]
        self.waiting = [None if w is None else w[at] for w in self.waiting]


def _bits(flags: np.ndarray) -> np.ndarray:
    """Booleans (a multiple of 64 of them) to words, lane i in bit i % 64."""
    return np.packbits(flags, bitorder="little").view(np.uint64)


def _lanes(x: np.ndarray) -> np.ndarray:
    return np.unpackbits(x.view(np.uint8), bitorder="little").astype(bool)


def within_radius(planes: np.ndarray, shift: int, radius: np.ndarray, ok: np.ndarray, step: int = 32) -> np.ndarray:
    """Of the pairs (p, p + shift) for which ok[p], those p whose sketches differ in at most radius[p] bits.

    planes: (bits, words + enough zero words), lane p in bit p % 64 of word p // 64.
    """
    n_words = len(ok) // 64
    live = np.flatnonzero(_bits(ok))
    if not len(live):
        return np.empty(0, np.int64)
    word, bit = divmod(shift, 64)
    levels = len(planes).bit_length()
    limit = [_bits((radius >> i & 1).astype(bool))[live] for i in range(levels)]
    alive, count = _bits(ok)[live], CarrySave(levels, len(live))
    up, down = np.uint64(bit), np.uint64(64 - bit)
    for done in range(0, len(planes), step):
        whole = len(live) == n_words
        for q in range(done, min(done + step, len(planes))):
            p = planes[q]
            if whole:
                a, b, c = p[:n_words], p[word : word + n_words], p[word + 1 : word + 1 + n_words]
            else:
                a, b = p[live], p[live + word]
                c = p[live + word + 1] if bit else b
            count.add(a ^ (b >> up | c << down) if bit else a ^ b)
        above, equal = np.zeros_like(alive), ~np.zeros_like(alive)
        for c, r in zip(reversed(count.totals()), reversed(limit), strict=True):
            above |= equal & c & ~r
            equal &= ~(c ^ r)
        alive = alive & ~above
        at = np.flatnonzero(alive)
        if not len(at):
            return np.empty(0, np.int64)
        if len(at) < len(live):
            live, alive, limit = live[at], alive[at], [x[at] for x in limit]
            count.keep(at)
    lane = np.flatnonzero(_lanes(alive))
    return live[lane >> 6] * 64 + (lane & 63)


def compare_places(place: np.ndarray, ids: np.ndarray, n: np.ndarray, sketch: np.ndarray, side: np.ndarray, t: Fraction, long: np.ndarray | None = None) -> np.ndarray:
    """(pairs, 2) ids, smaller first, that share a place and may reach t; not those that are both ``long``."""
    bits = sketch.shape[1] * 64
    long = np.zeros(len(ids), bool) if long is None else long
    order = np.lexsort((ids, place))
    place, ids, n, sketch, side, long = place[order], ids[order], n[order], sketch[order], side[order], long[order]
    edge = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[edge, len(place)])
    use = np.flatnonzero(sizes > 1)
    use = use[np.argsort(-sizes[use], kind="stable")]  # large places first: fewer positions at each larger offset
    if not len(use):
        return np.empty((0, 2), np.int64)
    sizes = sizes[use]
    starts = np.cumsum(sizes) - sizes
    take = np.repeat(edge[use] - starts, sizes) + np.arange(sizes.sum())
    ids, n, sketch, side, long = ids[take], n[take].astype(np.int64), sketch[take], side[take], long[take]
    group = np.repeat(np.arange(len(use)), sizes)
    m, top = len(ids), int(sizes[0])
    padded = -(-m // 64) * 64
    planes = np.zeros((bits, padded // 64 + top // 64 + 3), np.uint64)
    for lo in range(0, m, 1 << 16):  # vertical form, a block at a time
        hi = min(lo + (1 << 16), m)
        cells = np.zeros((-(-(hi - lo) // 64) * 64, bits), np.uint8)
        cells[: hi - lo] = np.unpackbits(np.ascontiguousarray(sketch[lo:hi]).view(np.uint8), axis=1, bitorder="little")
        planes[:, lo // 64 : lo // 64 + len(cells) // 64] = np.packbits(np.ascontiguousarray(cells.T), axis=1, bitorder="little").view(np.uint64)
    near = Fraction(t.denominator - t.numerator, t.denominator + t.numerator)
    found = []
    ends = starts + sizes
    for s in range(1, top):
        reach = int(ends[np.searchsorted(-sizes, -s, "left") - 1])  # places of more than s texts
        length = -(-reach // 64) * 64
        p = np.arange(min(reach, m - s))
        ok, radius = np.zeros(length, bool), np.zeros(length, np.int64)
        a, b = n[p], n[p + s]
        ok[: len(p)] = (
            (group[p] == group[p + s])
            & (t.denominator * np.minimum(a, b) >= t.numerator * np.maximum(a, b))
            & ((side[p] == 0) | (side[p] != side[p + s]))
            & (ids[p] != ids[p + s])
            & ~(long[p] & long[p + s])
        )
        radius[: len(p)] = np.minimum(near.numerator * (a + b) // near.denominator, bits)
        hit = within_radius(planes, s, radius, ok)
        if len(hit):
            found.append(np.stack([ids[hit], ids[hit + s]], 1))
    if not found:
        return np.empty((0, 2), np.int64)
    out = np.concatenate(found)
    out.sort(axis=1)
    return np.unique(out, axis=0)


def _candidates(t: Fraction):
    """Texts sorted by part -> candidate pairs; one part is held at a time."""

    def compare(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, n, small, large, place, side = [], [], [], [], [], []
        for raw in blobs:
            base, own, size, low, high, at, where, sides = unpacked(raw)
            own, size, at = own.astype(np.int64) + base.astype(np.int64), size.astype(np.int64), at.astype(np.int64)
            long = size > SHORT
            wide = np.zeros((len(own), PLANES // 64), np.uint64)
            wide[long] = high.reshape(-1, PLANES // 64)
            folded = np.empty((len(own), SHORT_PLANES // 64), np.uint64)
            folded[~long], folded[long] = low.reshape(-1, SHORT_PLANES // 64), fold(wide[long])
            for to, x in ((ids, own[at]), (n, size[at]), (small, folded[at]), (large, wide[at]), (place, where.astype(np.uint32)), (side, sides.astype(np.int8) if len(sides) else np.zeros(len(at), np.int8))):
                to.append(x)
        ids, n, small, large, place, side = (np.concatenate(x) for x in (ids, n, small, large, place, side))
        long = n > SHORT
        first = compare_places(place, ids, n, small, side, t, long)
        del small
        out = np.unique(np.concatenate([first, compare_places(place[long], ids[long], n[long], large[long], side[long], t)]), axis=0)
        for lo in range(0, len(out), 100_000):
            yield pa.record_batch([pa.array(out[lo : lo + 100_000, 0]), pa.array(out[lo : lo + 100_000, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for b in batches:
            part = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else []
            for lo, hi in zip(edges, edges[1:]):
                if held and part[lo] != at:
                    yield from compare(held)
                    held = []
                at = part[lo]
                held += b.column(1).slice(lo, hi - lo).to_pylist()
        if held:
            yield from compare(held)

    return run


def _marks(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64) * _MIX3) >> np.uint64(64 - bits)).astype(np.int64)


def _mark(bits: int):
    """a, b -> slices of the bit table of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for b in batches:
            for c in b.columns:
                seen[_marks(c.to_numpy(), bits)] = True
        packed = np.packbits(seen)
        at = [i for i in range(0, len(packed), SLICE) if packed[i : i + SLICE].any()]
        yield pa.record_batch([pa.array([i // SLICE for i in at], pa.int32()), pa.array([zlib.compress(packed[i : i + SLICE].tobytes(), 1) for i in at], pa.binary())], ["slice", "marks"])

    return run


def _join_marks(pdf: pd.DataFrame) -> pd.DataFrame:
    every = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(m), np.uint8) for m in pdf["marks"]], axis=0)
    return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "marks": [zlib.compress(every.tobytes(), 1)]})


def _only_marked(rows: DataFrame, met: DataFrame, bits: int) -> DataFrame:
    """rows whose id may be in a candidate pair: all that are, and few others while the table is sparse."""
    marks = met.mapInArrow(_mark(bits), "slice int, marks binary").withColumn("salt", F.spark_partition_id() % 64)
    half = marks.groupBy("slice", "salt").applyInPandas(lambda key, p: _join_marks(p[["slice", "marks"]]), "slice int, marks binary")
    table = np.zeros((1 << bits) // 8, np.uint8)
    for r in half.groupBy("slice").applyInPandas(_join_marks, "slice int, marks binary").toLocalIterator():
        m = np.frombuffer(zlib.decompress(r["marks"]), np.uint8)
        table[r["slice"] * SLICE : r["slice"] * SLICE + len(m)] = m
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _marks(b.column(0).to_numpy(), bits)
            yield b.filter(pa.array((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))

    return rows.mapInArrow(run, rows.schema)


def _verify(size: int, t: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[int, set] = {}

        def own(i: int, text: str) -> set:
            got = cache.get(i)
            if got is None:
                if len(cache) > 20_000:
                    cache.clear()
                w = words(text)
                got = cache[i] = set(zip(*(w[k:] for k in range(size)), strict=False))
            return got

        for b in batches:
            keep, value = [], []
            for i, (x, y, tx, ty) in enumerate(zip(*(c.to_pylist() for c in b.columns), strict=True)):
                p, q = own(x, tx), own(y, ty)
                both = len(p & q)
                union = len(p) + len(q) - both
                if both * t.denominator >= t.numerator * union:
                    keep.append(i)
                    value.append(both / union)
            yield pa.record_batch([b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64())), pa.array(value, pa.float64())], ["a", "b", "similarity"])

    return run


def similar_classes(df: DataFrame, key: str = "rowid", text: str = "content", threshold: float = THRESHOLD, size: int = WORDS, max_bits: int = MAX_BITS, exact_load: int = MAX_LOAD) -> tuple[DataFrame, DataFrame]:
    """(members, links): members key, class (smallest key with the same words) of every text with ``size`` words or
    more; links a, b, similarity between classes, a < b, of at least ``threshold``: all there are.

    Null, empty and shorter texts have no row; null keys none.  Repeated rows with one key count once.  Other
    columns are ignored.  ``max_bits`` and ``exact_load`` only change the cost.
    """
    spark = df.sparkSession
    t = Fraction(str(threshold))
    if not 0 < t <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    rows = df.select(F.col(key).cast("bigint").alias("rowid"), F.col(text).alias("content")).filter("rowid is not null and content is not null")
    about = (rows.agg(F.sum(F.length("content"))).first()[0] or 0) // 6  # shingles, for the table's size only
    bits = min(max_bits, max(16, math.ceil(math.log2(about + 1)) + 1))
    read = cut(rows.mapInArrow(_read(size, bits), "rowid bigint, digest binary, slice int, counts binary"))
    table, every, several = _count_table(read, bits)
    counts = spark.sparkContext.broadcast(table)
    known = read.filter("slice is null").groupBy("rowid").agg(F.min("digest").alias("digest"))
    firsts = known.groupBy("digest").agg(F.min("rowid").alias("class"))
    members = cut(known.join(firsts, "digest").select("rowid", "class"))
    heads = members.filter("rowid = class").select("rowid")
    # one text per class; a repeated key keeps one of its texts
    texts = rows.join(heads, "rowid", "left_semi").dropDuplicates(["rowid"])
    crowded = None
    if every > exact_load << bits and (exact := _crowded(texts, size, t, counts)) is not None:
        crowded = spark.sparkContext.broadcast(exact)
    # a prefix is n - ceil(t n) + 1 shingles, rare ones first: of those counted more than once no more than that share
    parts = max(width(spark), several // PART_ENTRIES)
    sent = texts.mapInArrow(_places(size, t, counts, crowded, parts), "part int, texts binary")
    met = cut(sent.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(_candidates(t), "a bigint, b bigint").distinct())
    reducer = min(REDUCER_BITS, max(16, math.ceil(math.log2(2 * met.count() + 1)) + 3))
    some = _only_marked(rows, met, reducer).join(heads, "rowid", "left_semi").dropDuplicates(["rowid"])
    left = met.join(some.withColumnsRenamed({"rowid": "a", "content": "ta"}), "a")
    pairs_ = left.join(some.withColumnsRenamed({"rowid": "b", "content": "tb"}), "b").select("a", "b", "ta", "tb")
    return members.select(F.col("rowid").alias(key), "class"), pairs_.mapInArrow(_verify(size, t), "a bigint, b bigint, similarity double")


def pairs(df: DataFrame, key: str = "rowid", **how) -> DataFrame:
    """key_a, key_b (a < b): all pairs of rows, copies included, of at least the threshold's similarity."""
    members, links = similar_classes(df, key, **how)
    links = cut(links)
    m = members.select(F.col(key).alias("k"), "class")
    several = m.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    dup = m.join(several.filter("n > 1"), "class", "left_semi")
    same = dup.withColumnRenamed("k", "x").join(dup.withColumnRenamed("k", "y"), "class").filter("x < y").select("x", "y")
    across = links.join(m.select(F.col("k").alias("x"), F.col("class").alias("a")), "a").join(m.select(F.col("k").alias("y"), F.col("class").alias("b")), "b")
    both = same.unionByName(across.select("x", "y"))
    return both.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))


def links_per_row(df: DataFrame, key: str = "rowid", **how) -> DataFrame:
    """key, class, links: the number of similar classes of another text, and the class id of each row."""
    members, links = similar_classes(df, key, **how)
    ends = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    return members.join(ends, "class", "left").select(key, "class", F.coalesce("links", F.lit(0)).alias("links"))
