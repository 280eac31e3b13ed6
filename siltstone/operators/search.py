"""Ranked search over chunks: exact nearest vectors, BM25, reciprocal rank fusion, reranking and diversity.

All operators take many queries at once; a single query is a table of one.  Queries are a stated side: the vector
search sends them to the workers in blocks of at most ``MAX_QUERY_BYTES``, and full-text search sends their words along
only while there are at most ``MAX_WORDS``; beyond that they are joined.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import porter
from siltstone.functions.text import fts_terms
from siltstone.runtime import cut

K1, B, IDF_FLOOR, RRF_K = 1.2, 0.75, 1e-6, 60
#: Scores and distances are rounded to so many decimals before they are compared, so that equal ones tie.
DECIMALS = 9
MAX_QUERY_BYTES, MAX_WORDS, MAX_TERMS, MAX_BAGS = 64 << 20, 5_000, 100_000, 4_096
#: Texts of a block of counts, at most 65,536; places of query words after which a block ends; rows of an index held at once.
BLOCK, BLOCK_PLACES, HELD = 1 << 15, 1 << 22, 1 << 20
#: Distances that a task of the vector search holds at once.
TILE = 1 << 22
#: Rows that all tasks of the vector search send on, as long as there are two tasks a core.
MAX_SENT = 1 << 22
REFERENCE_SCAN = 20_000


def over_fetch(top_k: int) -> int:
    return max(top_k * 8, 40)


def position(by: Sequence[Column], group: Sequence[str] = ("query_id",)) -> Column:
    return F.row_number().over(Window.partitionBy(*group).orderBy(*by)).cast("int")


# Vectors


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id: str = "id", vector: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """query_id, id, distance, position: the k nearest vectors of each query by Euclidean distance, ties by id.

    ``queries`` has query_id and a vector.  Each task keeps its own k best of every query, so the shuffle carries
    tasks times queries times k rows, not all pairs; more queries go through fewer tasks, down to two a core.  A task
    holds TILE distances at once.  Vectors of null, other length or with non-finite numbers
    have no distance and are left out.
    """
    out = None
    for block in query_blocks(queries, vector):
        part = _nearest_block(vectors, block, k, id, vector, exclude_self)
        out = part if out is None else out.unionByName(part)
    if out is None:
        kind = dict(vectors.dtypes)[id]
        return vectors.sparkSession.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, id {kind}, distance double, position int")
    rank = position([F.col("distance"), F.col("id")])
    return out.withColumn("position", rank).filter(F.col("position") <= k)


def query_blocks(queries: DataFrame, vector: str) -> Iterator[list[tuple]]:
    """Queries streamed to the driver in blocks of at most MAX_QUERY_BYTES."""
    block, size = [], 0
    for q in queries.select("query_id", vector).toLocalIterator():
        if q[1] is None:
            continue
        block.append((q[0], q[1]))
        size += 8 * len(q[1])
        if size > MAX_QUERY_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _nearest_block(vectors: DataFrame, block: list[tuple], k: int, id: str, vector: str, exclude_self: bool) -> DataFrame:
    names = [q for q, _ in block]
    matrix = np.array([v for _, v in block], np.float64)
    dim = matrix.shape[1]
    rows = vectors.select(F.col(id).alias("id"), F.col(vector).alias("v")).filter(F.size("v") == dim)
    id_type, qid_type = dict(rows.dtypes)["id"], "bigint" if all(isinstance(n, int) for n in names) else "string"
    norms = (matrix * matrix).sum(1)

    step = max(1, min(len(names), TILE // 8192))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0), []) for _ in names]
        place = {n: q for q, n in enumerate(names)} if exclude_self else {}
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                b = whole.slice(at, 8192)
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, dim)
                xx = (x * x).sum(1)
                finite = np.isfinite(xx)
                x, xx, ids = x[finite], xx[finite], b.column(0).filter(pa.array(finite)).to_pylist()
                if not ids:
                    continue
                rank = np.empty(len(ids), np.int64)
                rank[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))] = np.arange(len(ids))
                own = [(place[n], i) for i, n in enumerate(ids) if n in place]
                # bounds come from single precision where nothing can overflow
                fast = np.float32 if max(norms.max(), xx.max()) < 1e30 else np.float64
                x_fast, xx_fast = x.astype(fast), xx.astype(fast)
                for lo in range(0, len(names), step):  # a tile of queries and rows
                    hi = min(lo + step, len(names))
                    d = matrix[lo:hi].astype(fast) @ x_fast.T
                    d *= -2
                    d += norms[lo:hi, None].astype(fast)
                    d += xx_fast
                    for q, i in own:
                        if lo <= q < hi:
                            d[q - lo, i] = np.nan
                    # the fast form less its rounding leaves all that may be among the k best, ties included
                    room = 8 * (dim + 4) * np.finfo(fast).eps * (norms[lo:hi] + xx.max()) + 1e-30
                    held = np.array([b_[0][-1] if len(b_[0]) == k else np.inf for b_ in best[lo:hi]])  # no worse than what is there
                    kth, unsure = np.full(hi - lo, np.inf), np.isinf(held)
                    if d.shape[1] > k and unsure.any():
                        kth[unsure] = np.partition(d[unsure], k - 1, axis=1)[:, k - 1]
                    limit = np.minimum(np.sqrt(np.maximum(kth + room, 0)), held) + 2 * 10.0**-DECIMALS
                    qs, at_ = np.nonzero(d <= np.nextafter((limit * limit + room).astype(fast), fast(np.inf))[:, None])
                    exact = np.empty(len(qs))
                    for c in range(0, len(qs), TILE // dim):
                        diff = x[at_[c : c + TILE // dim]] - matrix[lo + qs[c : c + TILE // dim]]
                        exact[c : c + TILE // dim] = np.round(np.sqrt(np.einsum("ij,ij->i", diff, diff)), DECIMALS)
                    use = np.isfinite(exact)
                    qs, at_, exact = qs[use], at_[use], exact[use]
                    order = np.lexsort((rank[at_], exact, qs))
                    qs, at_, exact = qs[order], at_[order], exact[order]
                    first = np.arange(len(qs)) - np.searchsorted(qs, qs) < k
                    qs, at_, exact = qs[first], at_[first], exact[first]
                    edges = [*np.flatnonzero(np.r_[True, qs[1:] != qs[:-1]]).tolist(), len(qs)] if len(qs) else []
                    for a, z in zip(edges, edges[1:]):
                        q = lo + int(qs[a])
                        pool = sorted([*zip(best[q][0].tolist(), best[q][1], strict=True), *zip(exact[a:z].tolist(), [ids[i] for i in at_[a:z]], strict=True)])[:k]
                        best[q] = np.array([p for p, _ in pool]), [i for _, i in pool]
        n = [len(i) for _, i in best]
        yield pa.record_batch(
            [pa.array([names[q] for q in range(len(names)) for _ in range(n[q])]), pa.array([i for _, own_ in best for i in own_]), pa.array(np.concatenate([d for d, _ in best]) if names else [])],
            ["query_id", "id", "distance"],
        )

    tasks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, MAX_SENT // (len(names) * k))
    return rows.coalesce(tasks).mapInArrow(_typed(run, qid_type, id_type), f"query_id {qid_type}, id {id_type}, distance double")


def _typed(run: Callable, qid: str, id: str) -> Callable:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield pa.record_batch([b.column(0).cast(kinds[qid]), b.column(1).cast(kinds[id]), b.column(2).cast(pa.float64())], b.schema.names)

    return typed


# Full text


def query_terms(queries: DataFrame, text: str = "query", stemmed: bool = True, strict: bool = False) -> DataFrame:
    """query_id, term_no, phrase: a row per term of each query; repeated terms count as often as they stand.

    ``strict``: queries with AND, OR or NOT in capitals or a word of more than three hyphens have no terms at all,
    as in a search engine that takes them for a syntax error; else they are words like others.
    """
    if strict:
        queries = queries.filter(~F.coalesce(F.col(text).rlike(r"(?<![A-Za-z0-9_-])(?:AND|OR|NOT)(?![A-Za-z0-9_-])|[A-Za-z0-9_]*-(?:[A-Za-z0-9_]*-){3,}"), F.lit(False)))

    @F.pandas_udf("array<array<string>>")
    def terms(s: pd.Series) -> pd.Series:
        return s.map(lambda q: [[porter.stem(w.lower()) if stemmed else w.lower() for w in t] for t in fts_terms(q or "")])

    return queries.select("query_id", F.posexplode(terms(text)).alias("term_no", "phrase"))


class _Phrases:
    """Numbers of phrases by their words; ``find`` tells where a text has them.

    Every beginning of a phrase is a state, reached from the one before by the next word.
    """

    def __init__(self, keys: Sequence[str]) -> None:
        split = [tuple(k.split(" ")) for k in keys]
        self.words = {w: n for n, w in enumerate(dict.fromkeys(w for p in split for w in p))}
        states = {b: n for n, b in enumerate(dict.fromkeys(p[:i] for p in split for i in range(1, len(p) + 1)))}
        self.key = np.full(len(states), -1, np.int32)
        self.key[[states[p] for p in split]] = np.arange(len(split))
        self.first = np.full(len(self.words), -1, np.int64)
        longer: dict[int, list[tuple[int, int]]] = {}
        for b, n in states.items():
            if len(b) == 1:
                self.first[self.words[b[0]]] = n
            else:
                longer.setdefault(len(b), []).append((states[b[:-1]] * len(self.words) + self.words[b[-1]], n))
        self.longer = [tuple(np.array(x, np.int64) for x in zip(*sorted(longer[n]), strict=True)) for n in sorted(longer)]

    def find(self, words: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and phrase numbers; ``words``: word numbers, -1 for others; ``left``: words from here to the text's end."""
        at = np.flatnonzero(words >= 0)
        state = self.first[words[at]]
        at, state = at[state >= 0], state[state >= 0]
        found = [(at, self.key[state])]
        for n, (codes, states) in enumerate(self.longer, 1):
            at, state = at[left[at] > n], state[left[at] > n]
            code = np.where(words[at + n] >= 0, state * len(self.words) + words[at + n], -1)
            p = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            hit = codes[p] == code
            at, state = at[hit], states[p[hit]]
            found.append((at, self.key[state]))
        at, key = (np.concatenate(x) for x in zip(*found, strict=True))
        return at[key >= 0], key[key >= 0]


class _Numbers(dict):
    """Numbers of words by those of their stems, which are kept until there are too many."""

    def __init__(self, stems: dict[str, int]) -> None:
        self.stems = stems

    def __missing__(self, w: str) -> int:
        if len(self) >= 1 << 20:
            self.clear()
        n = self[w] = self.stems.get(porter.stem(w), -1)
        return n


_BLOCK = [*((c, T.BinaryType()) for c in ("lens", "keys", "sizes", "at", "tf", "hidden"))]


def _block_schema(id: T.DataType) -> T.StructType:
    """ids in their order, and packed: lengths of the texts; keys with their numbers of texts; texts and counts of each
    key; texts that are counted but not found, empty if there are none."""
    return T.StructType([T.StructField("ids", T.ArrayType(id)), *(T.StructField(n, t) for n, t in _BLOCK)])


def _block(ids: pa.Array, lens: np.ndarray, key: np.ndarray, doc: np.ndarray, tf: np.ndarray | None = None, hidden: np.ndarray | None = None) -> pa.RecordBatch:
    """One row of key counts; without ``tf``, each (key, doc) counts once."""
    order = pc.array_sort_indices(ids, null_placement="at_start").to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    code = key.astype(np.int64) * BLOCK + rank[doc]
    if tf is None:
        code, tf = np.unique(code, return_counts=True)
    else:
        by = np.argsort(code)
        code, tf = code[by], tf[by]
    keys, sizes = np.unique(code // BLOCK, return_counts=True)
    packed = (lens[order].astype(np.int32), keys.astype(np.int32), sizes.astype(np.int32), (code % BLOCK).astype(np.uint16), tf.astype(np.min_scalar_type(int(tf.max()) if len(tf) else 0)), hidden[order] if hidden is not None and hidden.any() else np.empty(0, bool))
    row = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order))), *(pa.array([x.tobytes()], pa.binary()) for x in packed)]
    return pa.record_batch(row, ["ids", *(n for n, _ in _BLOCK)])


def _text_blocks(docs: DataFrame, phrases: _Phrases, stemmed: bool) -> DataFrame:
    """Blocks of counts of the texts ``t``, which are words already unless they are to be stemmed."""

    def read(t: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not stemmed:
            return pc.index_in(t.flatten(), value_set=own).fill_null(-1).to_numpy().astype(np.int64), pc.list_value_length(t).to_numpy()
        each = [porter.words(x) for x in t.to_pylist()]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter(map(numbers.__getitem__, chain.from_iterable(each)), np.int64, int(sizes.sum())), sizes

    own, numbers = pa.array(list(phrases.words), pa.string()), _Numbers(phrases.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = places = 0
        join = lambda: (pa.concat_arrays([h[0] for h in held]), *(np.concatenate([h[i] for h in held]) for i in (1, 2, 3)))
        for whole in batches:
            done = 0
            while done < whole.num_rows:
                b = whole.slice(done, min(BLOCK - n, 1 << 12))
                words, sizes = read(b.column(1))
                ends = np.cumsum(sizes)
                doc = np.repeat(np.arange(b.num_rows), sizes)
                at, key = phrases.find(words, ends[doc] - np.arange(len(doc)))
                held.append((b.column(0), sizes, key, doc[at] + n))
                done, n, places = done + b.num_rows, n + b.num_rows, places + len(at)
                if n == BLOCK or places >= BLOCK_PLACES:
                    yield _block(*join())
                    held, n, places = [], 0, 0
        if held:
            yield _block(*join())

    return docs.mapInArrow(run, _block_schema(docs.schema["id"].dataType))


def _order(x: np.ndarray) -> np.ndarray:
    """A stable order of whole numbers that leave room for their places beside them."""
    bits = len(x).bit_length()
    return np.sort(x.astype(np.int64) << bits | np.arange(len(x))) & (1 << bits) - 1


def _slices(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary value for each stretch of int32 numbers."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer((4 * np.r_[0, ends]).astype(np.int32).tobytes()), pa.py_buffer(x.astype(np.int32).tobytes())])


def _numbers_of(t: pa.Table, c: str) -> tuple[np.ndarray, np.ndarray]:
    """The int32 numbers of all binary values, and how many each has."""
    each = t.column(c).to_pylist()
    return np.frombuffer(b"".join(each), np.int32), np.fromiter(map(len, each), np.int64, len(each)) // 4


def _row_blocks(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks of counts from an index's rows (term, id, len, positions, hidden).

    Before rows are brought together by id, those of an id that a task meets in one stretch are packed: word numbers and
    counts, and places only of words in phrases.
    """
    split = [k.split(" ") for k in keys]
    words = {w: n for n, w in enumerate(dict.fromkeys(w for p in split for w in p))}
    key_of = np.full(len(words) + 1, -1, np.int64)
    key_of[[words[p[0]] for p in split if len(p) == 1]] = [n for n, p in enumerate(split) if len(p) == 1]
    phrases = [(n, [words[w] for w in p]) for n, p in enumerate(split) if len(p) > 1]
    in_phrase = np.isin(np.arange(len(words) + 1), [w for _, p in phrases for w in p])
    own = pa.array(list(words), pa.string())

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= HELD:
                yield pa.Table.from_batches(held)
                held = []
        if sum(x.num_rows for x in held):
            yield pa.Table.from_batches(held)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in stretches(batches):
            t = t.combine_chunks()
            ids = pc.dictionary_encode(t.column("id"), null_encoding="encode").combine_chunks()
            doc = ids.indices.to_numpy()
            word = pc.index_in(t.column("term"), value_set=own).combine_chunks().fill_null(len(words)).to_numpy().astype(np.int64)
            by = _order(doc)
            by = by[word[by] < len(words)]
            if not len(by):
                continue
            doc, word = doc[by], word[by]
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            ends = np.r_[first[1:], len(doc)]
            n = pc.list_value_length(t.column("positions")).to_numpy()[by]
            placed = by[in_phrase[word]]
            places = t.column("positions").take(pa.array(placed)).combine_chunks().flatten().to_numpy() if len(placed) else np.empty(0, np.int32)
            some = pa.array(by[first])
            yield pa.record_batch(
                [t.column(c).take(some).combine_chunks() for c in ("id", "len", "hidden")] + [_slices(word, ends), _slices(n, ends), _slices(places, np.cumsum(np.where(in_phrase[word], n, 0))[ends - 1])],
                ["id", "len", "hidden", "words", "n", "places"],
            )

    def block(t: pa.Table, new: np.ndarray) -> pa.RecordBatch:
        word, sizes = _numbers_of(t, "words")
        tf, places = _numbers_of(t, "n")[0], _numbers_of(t, "places")[0]
        doc = np.repeat(np.cumsum(new) - 1, sizes)
        single = key_of[word] >= 0
        key, at, count = [key_of[word][single]], [doc[single]], [tf[single]]
        p = in_phrase[word]
        code = np.repeat(doc[p] << 32, tf[p]) + places
        of = np.repeat(word[p], tf[p])
        by = _order(of)
        of, code = of[by], code[by]
        of_word = lambda w: code[slice(*np.searchsorted(of, [w, w + 1]))]
        for n, phrase in phrases:
            here = of_word(phrase[0])
            for i, w in enumerate(phrase[1:], 1):
                here = here[np.isin(here, of_word(w) - i)] if len(here) else here
            docs, times = np.unique(here >> 32, return_counts=True)
            key.append(np.full(len(docs), n))
            at.append(docs)
            count.append(times)
        some = pa.array(np.flatnonzero(new))
        lens, hidden = (t.column(c).take(some).to_numpy() for c in ("len", "hidden"))
        return _block(t.column("id").take(some).combine_chunks(), lens, *(np.concatenate(x) for x in (key, at, count)), hidden)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = places = 0
        for b in batches:
            held.append(b)
            rows, places = rows + b.num_rows, places + b.column("words").nbytes // 4
            if rows > BLOCK or places > BLOCK_PLACES:
                t, new = joined(held)
                first = np.flatnonzero(new)
                for lo in range(0, len(first) - 1, BLOCK):
                    r = slice(first[lo], first[min(lo + BLOCK, len(first) - 1)])
                    yield block(t.slice(r.start, r.stop - r.start), new[r])
                held = t.slice(first[-1]).to_batches()  # more of this id may come
                rows, places = len(new) - first[-1], 0
        if rows:
            t, new = joined(held)
            first = np.r_[np.flatnonzero(new), len(new)]
            for lo in range(0, len(first) - 1, BLOCK):
                r = slice(first[lo], first[min(lo + BLOCK, len(first) - 1)])
                yield block(t.slice(r.start, r.stop - r.start), new[r])

    def joined(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        ids = t.column("id").combine_chunks()
        same = pc.fill_null(pc.equal(ids.slice(1), ids.slice(0, len(ids) - 1)), True).to_numpy(zero_copy_only=False)
        return t, np.r_[True, ~same]

    id = rows.schema["id"].dataType
    packed = T.StructType([T.StructField("id", id), T.StructField("len", T.IntegerType()), T.StructField("hidden", T.BooleanType()), *(T.StructField(c, T.BinaryType()) for c in ("words", "n", "places"))])
    together = rows.select("term", "id", F.col("len").cast("int").alias("len"), "hidden", "positions").mapInArrow(pack, packed).repartition("id").sortWithinPartitions("id")
    return together.mapInArrow(blocks, _block_schema(id))


def _asked(terms: DataFrame) -> tuple[list, list[tuple], list[str]]:
    """Of the terms (query_id, phrase): (query_id, bag) of each query, the distinct bags of (key number, times), the keys."""
    t = terms.select("query_id", F.concat_ws(" ", "phrase").alias("key")).toArrow()
    keys: dict[str, int] = {}
    by: dict = {}
    for q, key in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True):
        by.setdefault(q, []).append(keys.setdefault(key, len(keys)))
    bags: dict[tuple, int] = {}
    asked = [(q, bags.setdefault(tuple(sorted(Counter(own).items())), len(bags))) for q, own in by.items()]
    return asked, list(bags), list(keys)


def _frequencies(blocks: DataFrame, n_keys: int) -> tuple[int, float | None, np.ndarray]:
    """The number of texts, their average length, and of each key the number of texts with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_keys + 2, np.int64)
        for b in batches:
            for lens, keys, sizes in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                lens = np.frombuffer(lens, np.int32)
                n[-2:] += len(lens), lens.sum(dtype=np.int64)
                n[np.frombuffer(keys, np.int32)] += np.frombuffer(sizes, np.int32)
        yield pa.record_batch([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["key", "n"])

    n = np.zeros(n_keys + 2, np.int64)
    for key, own in blocks.select("lens", "keys", "sizes").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n")).collect():
        n[key] = own
    return int(n[-2]), float(n[-1] / n[-2]) if n[-2] else None, n[:-2]


def bm25(chunks: DataFrame, queries: DataFrame, k: int, id: str = "id", content: str = "content", text: str = "query", stemmed: bool = True, strict: bool = False) -> DataFrame:
    """query_id, id, score, position: the k best by BM25; scores are negative, the lowest is the best, ties by id.

    A hyphenated word is one phrase with its own frequency.  Texts are read once: only packed counts of the queries'
    phrases are kept.  Null contents are empty texts.
    """
    tokens = F.coalesce(content, F.lit("")) if stemmed else F.filter(F.split(F.lower(F.coalesce(content, F.lit(""))), r"(?U)[^\p{L}\p{N}]+"), lambda t: t != "")
    asked, bags, keys = _asked(query_terms(queries, text, stemmed, strict))
    blocks = cut(_text_blocks(chunks.select(F.col(id).alias("id"), tokens.alias("t")), _Phrases(keys), stemmed))
    n_docs, avgdl, df = _frequencies(blocks, len(keys))
    return _best(blocks, asked, bags, df, n_docs, avgdl, k, dict(queries.dtypes)["query_id"])


def _best(blocks: DataFrame, asked: list, bags: list[tuple], df: np.ndarray, n_docs: int, avgdl: float | None, k: int, qid: str) -> DataFrame:
    """The k best of each query from blocks of counts.

    Queries of the same terms are scored once.  Each group of queries goes through all blocks in few tasks, so that
    what a query has found so far keeps later texts out, and tasks times queries times k rows are shuffled at most.
    """
    spark, id = blocks.sparkSession, blocks.schema["ids"].dataType.elementType
    with np.errstate(divide="ignore", invalid="ignore"):
        idf = np.log((float(n_docs) - df + 0.5) / (df + 0.5))
    weight = np.where(idf > 0, idf, IDF_FLOOR)
    per = min(MAX_BAGS, max(256, -(-len(bags) // spark.sparkContext.defaultParallelism)))
    groups: list[list[tuple]] = [[]]
    size = 0
    for n, bag in enumerate(bags):
        if groups[-1] and (len(groups[-1]) == per or size + len(bag) > MAX_TERMS):
            groups.append([])
            size = 0
        groups[-1].append((n, sorted(bag, key=lambda t: (-weight[t[0]], t[0]))))
        size += len(bag)
    tasks = max(2, -(-2 * spark.sparkContext.defaultParallelism // len(groups)))  # a union of single partitions would be one task
    found = None
    for g in groups:
        part = blocks.coalesce(tasks).mapInArrow(_scorer(g, weight, float(avgdl or 1), k), T.StructType([T.StructField("bag", T.IntegerType()), T.StructField("id", id), T.StructField("score", T.DoubleType())]))
        found = part if found is None else found.unionByName(part)
    best = found.withColumn("position", position([F.col("score"), F.col("id")], ["bag"])).filter(F.col("position") <= k)
    return spark.createDataFrame(asked, f"query_id {qid}, bag int").join(best, "bag").select("query_id", "id", "score", "position")


def _scorer(bags: list[tuple], weight: np.ndarray, avgdl: float, k: int) -> Callable:
    """Of each bag's texts in a block, those that may be among the k best of all blocks: no more than k of a block.

    A bag's terms come by falling weight.  Texts are looked for in the lists of the first ones only, as far as the greatest gains of the
    others together don't reach the k-th best score so far, which is at least the k-th gain of any one term.
    """
    local = np.unique([key for _, own in bags for key, _ in own]).astype(np.int64)
    weight = weight[local]
    place = {int(key): n for n, key in enumerate(local)}
    names, bags = np.array([n for n, _ in bags], np.int32), [[(place[key], times) for key, times in own] for _, own in bags]
    slack = 2 * 10.0**-DECIMALS

    def lists(row: dict) -> tuple[int, list]:
        """The number of texts; of each term its texts, gains, the greatest and the k-th gain, or None."""
        lens, keys, sizes = (np.frombuffer(row[c], np.int32) for c in ("lens", "keys", "sizes"))
        at = np.frombuffer(row["at"], np.uint16)
        tf = np.frombuffer(row["tf"], f"u{len(row['tf']) // max(1, len(at)) or 1}")
        hidden = np.frombuffer(row["hidden"], bool)
        norm = K1 * (1 - B + B * lens / avgdl)
        ends = np.cumsum(sizes, dtype=np.int64)
        out: list = [None] * len(local)
        p = np.minimum(np.searchsorted(keys, local), max(0, len(keys) - 1))
        for n in np.flatnonzero(keys[p] == local).tolist() if len(keys) else ():
            e = int(ends[p[n]])
            own, t = at[e - sizes[p[n]] : e].astype(np.int64), tf[e - sizes[p[n]] : e].astype(np.float64)
            if len(hidden):
                own, t = own[~hidden[own]], t[~hidden[own]]
            if len(own):
                g = weight[n] * t * (K1 + 1) / (t + norm[own])
                out[n] = own, g, float(g.max()), float(np.partition(g, len(g) - k)[len(g) - k]) if len(g) >= k else 0.0
        return len(lens), out

    def needed(rest: list[float], floor: float) -> int:
        return next((e for e in range(1, len(rest) - 1) if rest[e] < floor), len(rest) - 1)

    def gained(term: tuple, at: np.ndarray) -> np.ndarray:
        times, there, g, _, _ = term
        p = np.minimum(np.searchsorted(there, at), len(there) - 1)
        return np.where(there[p] == at, times * g[p], 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((len(bags), k))  # ascending
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r].as_py() for c, _ in _BLOCK}
                n_docs, terms = lists(row)
                sums = np.zeros(n_docs)
                qs, docs, scores = [], [], []
                for q, bag in enumerate(bags):
                    own = [(times, *terms[n]) for n, times in bag if terms[n] is not None]
                    if not own:
                        continue
                    floor = max(best[q, 0], max(c * kth for c, _, _, _, kth in own)) - slack
                    rest = [0.0]
                    for c, _, _, top, _ in reversed(own):
                        rest.append(rest[-1] + c * top)
                    rest.reverse()
                    if rest[0] < floor:
                        continue
                    e = needed(rest, floor)
                    if e > 1 and (i := next((i for i, x in enumerate(own) if len(x[1]) >= k), None)) is not None and 8 * len(own[i][1]) <= n_docs:
                        c, at, g, _, _ = own[i]  # the k-th of the texts with a rare term
                        got = c * g
                        for j in range(len(own)):
                            if j != i:
                                got = got + gained(own[j], at)
                        floor = max(floor, np.partition(got, len(got) - k)[len(got) - k] - slack)
                        e = needed(rest, floor)
                    if e == 1:
                        c, at, g, _, _ = own[0]
                        got = c * g
                    else:
                        for c, at, g, _, _ in own[:e]:
                            sums[at] += c * g
                        at = np.flatnonzero(sums)
                        got = sums[at]
                        sums[at] = 0
                    for i in range(e, len(own)):
                        keep = got + rest[i] >= floor
                        at, got = at[keep], got[keep]
                        got += gained(own[i], at)
                    keep = got >= floor
                    at, got = at[keep], np.round(got[keep], DECIMALS)
                    if len(got) > k:
                        keep = got >= np.partition(got, len(got) - k)[len(got) - k]
                        at, got = at[keep], got[keep]
                        if len(got) > k:
                            first = np.lexsort((at, -got))[:k]
                            at, got = at[first], got[first]
                    if len(got):
                        both = np.concatenate((best[q], got))
                        both.sort()
                        best[q] = both[-k:]
                        qs.append(np.full(len(at), names[q]))
                        docs.append(at)
                        scores.append(got)
                if qs:
                    ids = b.column("ids")[r].values
                    yield pa.record_batch([pa.array(np.concatenate(qs)), ids.take(pa.array(np.concatenate(docs))), pa.array(-np.concatenate(scores))], ["bag", "id", "score"])

    return run


def posting_rows(chunks: DataFrame, content: str = "content", keep: Sequence[str] = ("source_type",)) -> DataFrame:
    """Rows of a full-text index: term, id, len, positions and the columns ``keep``.  Null contents have no word.

    Each text's rows are made where it is read; ids are unique.
    """
    docs = chunks.select("id", *keep, F.col(content).alias("_text"))
    kind = {f.name: f.dataType for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1 << 11):
                b = whole.slice(lo, 1 << 11)
                stems: dict[str, int] = {}
                own = {}
                each = [porter.words(t) for t in b.column("_text").to_pylist()]
                for w in set(chain.from_iterable(each)):
                    own[w] = stems.setdefault(porter.stem(w), len(stems))
                sizes = np.fromiter(map(len, each), np.int64, len(each))
                doc = np.repeat(np.arange(len(each)), sizes)
                code = doc * max(1, len(stems)) + np.fromiter(map(own.__getitem__, chain.from_iterable(each)), np.int64, len(doc))
                by = _order(code)
                first = np.flatnonzero(np.r_[True, code[by][1:] != code[by][:-1]]) if len(by) else np.empty(0, np.int64)
                place = (np.arange(len(doc)) - (np.cumsum(sizes) - sizes)[doc])[by].astype(np.int32)
                at, term = doc[by][first], code[by][first] % max(1, len(stems))
                positions = pa.ListArray.from_arrays(pa.array(np.r_[first, len(by)].astype(np.int32)), pa.array(place))
                there = pa.array(at)
                yield pa.record_batch(
                    [pa.array(list(stems), pa.string()).take(pa.array(term)), *(b.column(c).take(there) for c in ("id", *keep)), pa.array(sizes.astype(np.int32)).take(there), positions],
                    ["term", "id", *keep, "len", "positions"],
                )

    return docs.mapInArrow(run, T.StructType([T.StructField("term", T.StringType()), *(T.StructField(c, kind[c]) for c in ("id", *keep)), T.StructField("len", T.IntegerType()), T.StructField("positions", T.ArrayType(T.IntegerType()))]))


def postings(chunks: DataFrame, content: str = "content") -> tuple[DataFrame, int, float]:
    """The full-text index: its rows, the number of texts and their average length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = n = 0
        for b in batches:
            docs, n = docs + b.num_rows, n + sum(len(porter.words(t)) for t in b.column(0).to_pylist())
        yield pa.record_batch([pa.array([docs]), pa.array([n])], ["docs", "n"])

    sizes = chunks.select(content).mapInArrow(run, "docs bigint, n bigint").agg(F.sum("docs").alias("docs"), (F.sum("n") / F.sum("docs")).alias("avgdl")).first()
    return posting_rows(chunks, content), sizes["docs"] or 0, float(sizes["avgdl"] or 0.0)


def bm25_indexed(index: tuple[DataFrame, int, float], queries: DataFrame, k: int, text: str = "query", strict: bool = False, sources: Sequence[str] | None = None) -> DataFrame:
    """As ``bm25`` with stemming, from an index (postings, number of texts, their average length): only the query
    words' postings are read.

    A phrase's places are the common ones of its words' positions, each shifted by the word's place in it.
    Frequencies are those of the whole index, also with ``sources``.
    """
    rows, n_docs, avgdl = index
    asked, bags, keys = _asked(query_terms(queries, text, True, strict))
    some = sorted({w for key in keys for w in key.split(" ")})
    if some and len(some) <= MAX_WORDS:  # reaches the scan, whose row groups are sorted by term
        rows = rows.filter(F.col("term").isin(some))
    hidden = ~F.coalesce(F.col("source_type").isin(list(sources)), F.lit(False)) if sources else F.lit(False)
    blocks = cut(_row_blocks(rows.withColumn("hidden", hidden), keys))
    return _best(blocks, asked, bags, _frequencies(blocks, len(keys))[2], n_docs, avgdl, k, dict(queries.dtypes)["query_id"])


ID_HINT = r"`[^`]+`|\".+?\""


def fts_weight(query: Column, patterns: Sequence[str] = ()) -> Column:
    """1.0 for queries with code, a quoted phrase or a configured reference; 0.25 for prose."""
    hit = query.rlike(ID_HINT)
    for p in patterns:
        hit = hit | F.substring(query, 1, REFERENCE_SCAN).rlike("(?U)" + p)
    return F.when(hit, F.lit(1.0)).otherwise(F.lit(0.25))


# Fusion


def fuse(lists: Sequence[tuple[DataFrame, Column | float]], k: int = RRF_K) -> DataFrame:
    """query_id, id, rrf, position: weighted reciprocal rank fusion of ranked lists (query_id, id, position).

    A weight is a number or a column of its list.  Equal scores stay in the order of the lists, then of the ranks.
    """
    rows = None
    for n, (df, w) in enumerate(lists):
        w = w if isinstance(w, Column) else F.lit(float(w))
        part = df.select("query_id", "id", (w / (k + F.col("position"))).alias("s"), F.struct(F.lit(n).alias("list"), F.col("position").alias("at")).alias("first"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("query_id", "id").agg(F.round(F.sum("s"), 12).alias("rrf"), F.min("first").alias("first"))
    return fused.select("query_id", "id", "rrf", position([F.desc("rrf"), F.col("first")]).alias("position"))


def diversify(ranked: DataFrame, top_k: int, dedupe: bool = True, per_type: int | None = 3) -> DataFrame:
    """The first of each document, then at most ``per_type`` of each source type, then ``top_k``; positions anew.

    ``ranked`` has query_id, position, source_type and source_key.
    """
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    old = F.col("position")
    if dedupe:
        ranked = ranked.withColumn("_n", position([old], ["query_id", "source_type", "source_key"])).filter("_n = 1").drop("_n")
    if per_type is not None:
        ranked = ranked.withColumn("_n", position([old], ["query_id", "source_type"])).filter(F.col("_n") <= per_type).drop("_n")
    return ranked.withColumn("position", position([old])).filter(F.col("position") <= top_k)


def lexical_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text has: a stand-in for a trained pair scorer."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda t: t != ""))
    q = words(query)
    return F.coalesce(F.size(F.array_intersect(q, words(text))) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0))


def rerank(ranked: DataFrame, score: Callable[[Column, Column], Column] = lexical_score, pool: int = 30, chars: int = 4000, top_n: int | None = None) -> DataFrame:
    """The first ``pool`` of each query by a pair score of query and summary with content, of which ``top_n`` stay; the
    rest is dropped.  A pair scorer reads ``chars`` characters.

    ``ranked`` has query_id, query, position, content and, if attached, summary.
    """
    text = F.substring(F.concat_ws("\n\n", *(["summary"] if "summary" in ranked.columns else []), "content"), 1, chars)
    scored = ranked.filter(F.col("position") <= pool).withColumn("rerank_score", score(F.col("query"), text))
    ranked = scored.withColumn("position", position([F.desc("rerank_score"), F.col("position")]))
    return ranked.filter(F.col("position") <= top_n) if top_n else ranked


def attach_summaries(chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    own = summaries.groupBy("source_type", "source_key").agg(F.max(F.struct("generated_at", "summary")).alias("s")).select("source_type", "source_key", "s.summary")
    return chunks.join(own, ["source_type", "source_key"], "left")


def hybrid(
    chunks: DataFrame, queries: DataFrame, top_k: int = 5, sources: Sequence[str] | None = None, dedupe: bool = True, per_type: int | None = 3, use_fts: bool = True,
    vector_weight: float = 1.0, text_weight: float | None = None, patterns: Sequence[str] = (), scorer: Callable[[Column, Column], Column] | None = None, pool: int = 30,
    top_n: int | None = None, summaries: DataFrame | None = None, stemmed: bool = True, max_distance: float | None = None, index: tuple[DataFrame, int, float] | None = None,
) -> DataFrame:
    """query_id, position, id, source_type, source_key, vec_distance, bm25, distance, rrf of the best chunks.

    ``chunks`` has id, source_type, source_key, content and embedding; ``queries`` query_id, query and embedding.
    ``index``: from ``postings``; else the texts are analysed anew.  ``sources`` filters before the search.  ``distance`` is the vector's where there is one, else the BM25 score.
    """
    if sources:
        chunks = chunks.filter(F.col("source_type").isin(list(sources)))
    n = over_fetch(top_k)
    queries = cut(queries)
    vec = nearest(chunks, queries, n)
    if max_distance is not None:
        vec = vec.filter(F.col("distance") <= max_distance)
    vec = cut(vec)  # at most n rows a query, used twice
    lists: list = [(vec, vector_weight)]
    text = None
    if use_fts:
        text = cut(bm25_indexed(index, queries, n, sources=sources) if index else bm25(chunks, queries, n, stemmed=stemmed))
        w = F.lit(float(text_weight)) if text_weight is not None else fts_weight(F.col("query"), patterns)
        lists.append((text.join(queries.select("query_id", w.alias("w")), "query_id"), F.col("w")))
    fused = fuse(lists)
    rows = fused.join(vec.select("query_id", "id", F.col("distance").alias("vec_distance")), ["query_id", "id"], "left")
    if text is not None:
        rows = rows.join(text.select("query_id", "id", F.col("score").alias("bm25")), ["query_id", "id"], "left")
    else:
        rows = rows.withColumn("bm25", F.lit(None).cast("double"))
    rows = rows.withColumn("distance", F.coalesce("vec_distance", "bm25"))
    keep = ["id", "source_type", "source_key", *(["content"] if scorer else [])]
    rows = rows.join(chunks.select(*keep), "id")
    if scorer:
        if summaries is not None:
            rows = attach_summaries(rows, summaries)
        rows = rerank(rows.join(queries.select("query_id", "query"), "query_id"), scorer, pool, top_n=top_n)
    if dedupe or per_type is not None:
        rows = diversify(rows, top_k, dedupe, per_type)
    else:
        rows = rows.filter(F.col("position") <= top_k)
    return rows.select("query_id", "position", "id", "source_type", "source_key", "vec_distance", "bm25", "distance", "rrf")


def valid_patterns(patterns: Sequence[str]) -> list[str]:
    """Reference patterns that both regex dialects read; others are an error when the configuration is loaded."""
    for p in patterns:
        re.compile(p)
        if re.search(r"\(\?P[<=]|\(\?<[^=!]", p):
            raise ValueError(f"named groups are not portable: {p}")
    return list(patterns)
