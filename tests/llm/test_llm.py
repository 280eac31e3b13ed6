import contextlib
import gc
import itertools
import math
import os
import random
import sys
import threading
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import rows  # noqa: E402

from siltstone.llm import bpe, leximin, lookalike, markup, markup_samples, nearcopies, neighbours, packing, pii, queries  # noqa: E402
from siltstone.llm.boosting import Boosted  # noqa: E402
from siltstone.runtime import cut, shared_dir  # noqa: E402


def test_every_query_runs(spark, sf):
    for name, f in queries.QUERIES.items():
        assert f(spark, sf).count() > 0, name


def test_sql(spark, sf):
    import glob

    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view \"{os.path.basename(p)[:-8]}\" as select * from '{p}'")
    for name, sql in queries.SQL.items():
        assert sorted(map(tuple, queries.QUERIES[name](spark, sf).collect())) == sorted(c.execute(sql).fetchall())


# 3: leximin

HITS, SCORERS = "query_id bigint, rowid bigint, scorer string, distance double, unit string", "scorer string, better string, unit string"


def leximin_rows(spark, hits, scorers, **how):
    return leximin.rank(spark.createDataFrame(hits, HITS), spark.createDataFrame(scorers, SCORERS), **how)


def brute_leximin(hits, better):
    out = []
    for q in {h[0] for h in hits}:
        items = sorted({h[1] for h in hits if h[0] == q})
        value = {}
        for _, i, s, d, _ in (h for h in hits if h[0] == q):
            if d is not None and not math.isnan(d) and s in better:
                v = d if better[s] == "high" else -d
                value[i, s] = max(v, value.get((i, s), -math.inf))
        profile = {}
        for i in items:
            p = []
            for s in better:
                worst = min((v for (_, t), v in value.items() if t == s), default=None)
                at = lambda j, s=s, worst=worst: value.get((j, s), worst)
                p.append(0.0 if at(i) is None else 1.0 if len(items) == 1 and (i, s) in value else sum(at(j) < at(i) for j in items) / max(1, len(items) - 1))
            profile[i] = sorted(p)
        out += [(q, i, n + 1) for n, i in enumerate(sorted(items, key=lambda i: ([-x for x in profile[i]], i)))]
    return sorted(out)


def test_leximin_brute_force_and_hot_groups(spark):
    r = random.Random(1)
    hits = [(q, i, s, r.choice([None, math.nan, float(r.randint(0, 30)), -1e12]), "x") for q in range(4) for i in range(25) for s in "abc" if r.random() < 0.8]
    hits += hits[:20]
    better = {"a": "low", "b": "high", "c": "low"}
    want = brute_leximin(hits, better)
    for hot in (5, 10**9):
        got = leximin_rows(spark, hits, [(s, b, "u") for s, b in better.items()], hot_values=hot)
        assert sorted(map(tuple, got.select("query_id", "rowid", "position").collect())) == want


def test_leximin_edges(spark):
    sc = [("a", "low", ""), ("b", "high", "")]
    assert leximin_rows(spark, [], sc).collect() == []
    got = leximin_rows(spark, [(1, 5, "a", None, ""), (1, 4, "zzz", 3.0, ""), (None, 1, "a", 1.0, ""), (1, None, "a", 1.0, ""), (2, 9, "b", 1.0, "")], sc).orderBy("query_id", "position").collect()
    assert [(x["query_id"], x["rowid"]) for x in got] == [(1, 4), (1, 5), (2, 9)]


def test_one_extreme_score_carries_nothing(spark):
    hits = [(1, i, s, 1.0 + i / 100, "") for i in range(5) for s in "ab"] + [(1, 99, "a", -1e300, "")]
    got = leximin_rows(spark, hits, [("a", "low", ""), ("b", "low", "")], limit=4)
    assert 99 not in {x["rowid"] for x in got.collect()}


# 8: tokenizer


@pytest.fixture(scope="module")
def reference_encoding():
    import tiktoken

    if not os.path.isdir(bpe.TOKENIZERS):
        pytest.skip("no tokenizers")
    e = bpe.encoder()
    return tiktoken.Encoding("own", pat_str=e.split.__self__.pattern, mergeable_ranks=e.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab \n'stA1é漢🙂<|>", max_size=200)))
def test_ids_equal_the_libraries(reference_encoding, s):
    s = s.encode("utf-8", "replace").decode()
    assert bpe.encoder().encode(s) == reference_encoding.encode_ordinary(s)


def test_very_long_pieces(reference_encoding):
    for s in ("a" * 30_000, "ab" * 20_000, " " * 20_000 + "x", "é" * 9_000):
        assert bpe.encoder().encode(s) == reference_encoding.encode_ordinary(s)


def test_encode_table(spark, reference_encoding):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello <|endoftext|>", "x"), (3, "Hello <|endoftext|>", "x")], "doc_id bigint, text string, ids string")
    got = rows(bpe.encode(df))
    assert got[:2] == [(1, []), (2, [])] and got[2] == got[3] == (3, reference_encoding.encode_ordinary("Hello <|endoftext|>"))
    assert bpe.encode(df.limit(0)).collect() == []


def test_rank_queue():
    r, q, want = random.Random(2), bpe.RankQueue(), []
    for i in range(3000):
        k = r.randint(0, 50_255)
        q.push(k, (i,))
        want.append(k)
    got = []
    while q.top:
        k, own = q.pop()
        got += [k] * len(own)
    assert got == sorted(want)


# 9: packing


def packed(spark, sizes, limits, **how):
    items = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc_id bigint, tokens bigint, bin string")
    lim = spark.createDataFrame(limits, "container string, capacity_tokens bigint")
    return packing.pack(items, lim, **how).collect()


def check_packing(out, sizes, limits):
    for c, cap in limits:
        own = [x for x in out if x["container"] == c]
        fill, pieces = {}, {}
        for x in own:
            fill[x["bin"]] = fill.get(x["bin"], 0) + x["piece_size"]
            pieces.setdefault(x["doc_id"], []).append((x["piece_no"], x["piece_start"], x["piece_size"]))
        assert max(fill.values(), default=0) <= cap
        assert set(pieces) == {i for i, s in enumerate(sizes) if s and s > 0}
        for i, p in pieces.items():
            p.sort()
            assert sum(s for *_, s in p) == sizes[i] and (len(p) == 1) == (sizes[i] <= cap)
            assert [a for _, a, _ in p] == [n * cap for n in range(len(p))]
        yield len(fill), -(-sum(s for s in sizes if s and s > 0) // cap)


def test_packing(spark):
    r = random.Random(3)
    sizes = [r.choice([r.randint(1, 60), r.randint(1, 600), 0, None, 2500]) for _ in range(1500)] + [100, 100]
    limits = [("s", 100), ("m", 1000)]
    for group in (100, 10**6):  # many levels, and one
        for bins, least in check_packing(packed(spark, sizes, [*limits, ("s", 100), ("none", 0), ("nil", None)], group=group), sizes, limits):
            assert bins <= 1.02 * least + 1


def test_packing_edges(spark):
    assert packed(spark, [], [("s", 10)]) == [] and packed(spark, [5], []) == []
    assert len({x["bin"] for x in packed(spark, [6, 6, 6], [("s", 10)])}) == 3


def test_best_fit():
    r = random.Random(4)
    sizes = [r.randint(1, 5000) for _ in range(3000)]
    to = packing.best_fit(sizes, 8192)
    fill = np.bincount(to, sizes)
    assert fill.max() <= 8192 and len(fill) <= 1.01 * sum(sizes) / 8192 + 1


# 10: look-alikes


def looks(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, looks string")
    return {tuple(x) for x in lookalike.pairs(df).collect()}


def test_same_look(spark):
    base = "Case 12, naïve file: ﾌｧ ok"
    same = [
        base, "Саѕе 12, nаïvе file: ﾌｧ ok", "Ｃａｓｅ １２， naïve file: ﾌｧ ok", "Case 12, nai\u0308ve file: ファ ok", "Case\u00a012, naïve \ufb01le: ﾌｧ ok", "Ca\u00adse\u200b 12, na\u2060ïve file: ﾌｧ ok\ufeff", "Ϲase\u202f12, naïve file:\u3000ﾌｧ ok",
    ]
    other = ["case 12, naïve file: ﾌｧ ok", "Case 12, naive file: ﾌｧ ok", "Case ¹2, naïve file: ﾌｧ ok", "Case 12. naïve file: ﾌｧ ok", "Case 12,  naïve file: ﾌｧ ok", "Case 12,\nnaïve file: ﾌｧ ok"]
    assert looks(spark, same + other) == set(itertools.combinations(range(len(same)), 2))


def test_look_edges(spark):
    assert looks(spark, []) == set()
    assert looks(spark, [None, "", " ", "\u200b", "\u00a0", "same", "same"]) == set()
    assert looks(spark, ["a\r\nb", "a\nb", "a\n\nb"]) == {(0, 1)}
    assert looks(spark, ["CIVIL I", "ⅭⅠⅤⅠL Ⅰ", "ᏟIᏙIᏞ ꓲ", "𝐂𝐈𝐕𝐈𝐋 𝐈", "CIVIL 1"]) == set(itertools.combinations(range(4), 2))
    assert looks(spark, ["ĳs ǆ Ⅲ", "ijs dž III", "іјs dž ІІІ"]) == set(itertools.combinations(range(3), 2))  # strings of Cyrillic letters too
    df = spark.createDataFrame([(3, "a"), (4, "а"), (5, "b"), (6, " "), (7, None), (None, "a"), (3, "a")], "doc_id bigint, text string")
    assert {tuple(x) for x in lookalike.look_classes(df).collect()} == {(3, 3, 2, 2), (4, 3, 2, 2), (5, 5, 1, 1)}
    assert looks(spark, ["ﾊﾞ" * 5000, "バ" * 5000]) == {(0, 1)}


def test_representative_is_the_most_frequent():
    to = lookalike.Rewriter(lookalike.classes({"а": 9, "a": 1, "b": 1}))  # Cyrillic a prevails
    assert to("aba а") == "аbа а" and lookalike.Rewriter(lookalike.classes({"a": 5, "а": 1}))("а") == "a"


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aаｂbﬁfi é\u0301\u200b\u00a0ﾌﾞブ\r\nK\u212a", max_size=20))
def test_rewriting_is_stable(s):
    to = lookalike.Rewriter(lookalike.classes({c: 1 for c in "aаbfi eé\nKブ"}))
    assert to(to(s)) == to(s)


# 5: neighbours


def test_hilbert_is_a_curve():
    for m, b in ((2, 4), (3, 3)):
        x = np.array(list(itertools.product(range(1 << b), repeat=m)))
        key = neighbours.hilbert(x, b)
        assert sorted(key) == list(range(len(x)))
        assert (np.abs(np.diff(x[np.argsort(key)], axis=0)).sum(1) == 1).all()


def brute_nearest(v, k):
    ids = sorted(v)
    x = np.array([v[i] for i in ids], np.float32).astype(float)
    out = {}
    for a, i in enumerate(ids):
        d = np.sqrt(((x - x[a]) ** 2).sum(1))
        out[i] = [j for _, j in sorted((round(d[b], 12), j) for b, j in enumerate(ids) if j != i)[:k]]
    return out


def test_neighbours_small_is_exact(spark):
    r = np.random.default_rng(5)
    v = {i: r.normal(size=8).tolist() for i in range(300)} | {1000 + i: [0.5] * 8 for i in range(12)}
    data = [(i, x, "m") for i, x in v.items()] + [(1, v[1], "m"), (2000, None, "m"), (2001, [0.0] * 8, "m"), (2002, [math.nan] * 8, "m"), (2003, [1.0], "m"), (2004, [math.inf] * 8, "m"), (None, [1.0] * 8, "m")]
    df = spark.createDataFrame(data, "rowid bigint, embedding array<float>, id string")
    got = {}
    for x in neighbours.nearest(df, dim=8).orderBy("position").collect():
        got.setdefault(x["id"], []).append(x["neighbour"])
    want = brute_nearest(v, 5)
    assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.97 * 5 * len(want)
    assert got[1000] == [1001, 1002, 1003, 1004, 1005] and got[1011] == [1000, 1001, 1002, 1003, 1004]
    assert neighbours.nearest(df.limit(0), dim=8).collect() == [] and neighbours.nearest(df.filter("rowid = 5"), dim=8).collect() == []


def test_recall_on_the_table(spark, sf):
    t = spark.read.parquet(f"{sf}/chunks_vec.parquet")
    v = {r["id"]: r["v"] for r in neighbours.usable(t, "rowid", "embedding", 64).collect()}
    want = {(min(i, j), max(i, j)) for i, own in brute_nearest(v, 5).items() for j in own}
    got = {tuple(x) for x in neighbours.pairs(t).collect()}
    assert len(want & got) >= 0.95 * len(want)


def hot(n, noise, inner=0.0, dim=64, family=1, seed=11):
    """rowid -> vector: two thirds in clusters of 20, a third in one tight group, there as shuffled families if inner."""
    r = np.random.default_rng(seed)
    unit = lambda m: (lambda c: c / np.linalg.norm(c, axis=1, keepdims=True))(r.normal(size=(m, dim)))
    m = n // 3
    spread = np.repeat(unit((n - m) // 20 + 1), 20, 0)[: n - m]
    kin = np.repeat(noise * r.normal(size=(m // family + 1, dim)), family, 0)[:m]
    x = np.concatenate([spread + 0.0088 * r.normal(size=spread.shape), unit(1) + kin + inner * r.normal(size=(m, dim))])
    return dict(zip(r.permutation(n).tolist(), x.tolist()))


@pytest.mark.parametrize(("noise", "inner", "family", "sent"), [(0.001, 0.0, 1, 32 << 20), (0.002, 0.0002, 5, 0)])
def test_neighbours_in_a_hot_group(spark, noise, inner, family, sent, monkeypatch):
    monkeypatch.setattr(neighbours, "SENT", sent)  # both ways to compare with all
    v = hot(1800, noise, inner, family=family)
    got = {}
    for x in neighbours.nearest(spark.createDataFrame(list(v.items()), "rowid bigint, embedding array<float>"), block=32, halo=8).collect():
        got.setdefault(x["id"], set()).add(x["neighbour"])
    ids, x = list(v), np.array(list(v.values()), np.float32).astype(float)
    recall = []
    for i in range(len(ids)):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        recall.append(len(got[ids[i]] & {ids[j] for j in np.argsort(d)[:5]}) / 5)
    assert np.mean(recall) >= 0.98 and np.mean(recall[-600:]) >= 0.98  # the hot group comes last


def recall_of(spark, v, **how):
    got = {}
    for x in neighbours.nearest(spark.createDataFrame(list(v.items()), "rowid bigint, embedding array<float>"), **how).collect():
        got.setdefault(x["id"], set()).add(x["neighbour"])
    ids, x = np.array(list(v)), np.array(list(v.values()), np.float32).astype(float)
    some = range(0, len(ids), max(1, len(ids) // 400))
    hits = []
    for i in some:
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hits.append(len(got[int(ids[i])] & set(ids[np.argsort(d)[:5]].tolist())) / 5)
    return np.mean(hits)


def test_recall_without_clusters(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(20_000, 64))
    v = dict(enumerate((x / np.linalg.norm(x, axis=1, keepdims=True)).tolist()))
    assert recall_of(spark, v) >= 0.9
    assert recall_of(spark, {i: v[i] for i in range(3000)}, exact=True, block=64, halo=16) == 1.0


def test_ranges_meet_at_their_edges():
    """One curve, many ranges: the same pairs as in one range."""
    r = np.random.default_rng(4)
    ids, x = np.arange(400), np.sort(r.normal(size=400)).astype(np.float32)[:, None]
    rows = lambda part, own, a, b: pa.record_batch([pa.array(np.full(b - a, part, np.int32)), pa.array(np.full(b - a, own, np.int8)), pa.array(ids[a:b]), pa.array(ids[a:b]), pa.array(list(x[a:b]), pa.list_(pa.float32()))], ["part", "own", "skey", "id", "v"])
    got = {}
    for b in neighbours._windows(3, 32, 8)(iter([rows(0, 1, 0, 100), rows(1, 0, 80, 100), rows(1, 1, 100, 250), rows(2, 0, 230, 250), rows(2, 1, 250, 400)])):
        for i, near, far in zip(*(c.to_pylist() for c in b.columns), strict=True):
            got.setdefault(i, set()).update(zip(far, near, strict=True))
    for i in range(400):
        want = sorted((abs(float(x[i, 0]) - float(x[j, 0])), j) for j in range(400) if j != i)[:3]
        assert [j for _, j in sorted(got[i])[:3]] == [j for _, j in want]


@pytest.mark.parametrize(("noise", "offset"), [(3e-5, 0.0), (0.0088, 30.0)])
def test_rounding_hides_no_neighbour(noise, offset):
    r = np.random.default_rng(3)
    c = r.normal(size=(64, 64))
    x = (np.repeat(c / np.linalg.norm(c, axis=1, keepdims=True), 20, 0) + noise * r.normal(size=(1280, 64)) + offset).astype(np.float32)
    v = dict(zip(r.permutation(1280).tolist(), x.tolist()))
    ids = np.array(list(v))
    one = pa.record_batch([pa.array(np.zeros(1280, np.int32)), pa.array(np.ones(1280, np.int8)), pa.array(np.zeros(1280, np.int64)), pa.array(ids), pa.array(list(x), pa.list_(pa.float32()))], ["part", "own", "skey", "id", "v"])
    got = {i: near for b in neighbours._windows(5, 1280, 256)(iter([one])) for i, near in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    y = x.astype(float)
    for a, i in enumerate(ids.tolist()):
        d = np.sqrt(((y - y[a]) ** 2).sum(1))
        d[a] = np.inf
        assert got[i] == ids[np.lexsort((ids, d))[:5]].tolist()


def disk_peak(spark, run):
    """What run returns, and the most bytes that shuffles and checkpoints held meanwhile beyond those before."""
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    dirs = [str(d.getPath()) for d in env.blockManager().diskBlockManager().localDirs()] + [shared_dir(spark).removeprefix("file:")]

    def held():
        total = 0
        for top in dirs:
            for at, _, files in os.walk(top):
                for f in files:
                    with contextlib.suppress(OSError):
                        total += os.stat(os.path.join(at, f)).st_size
        return total

    first, most, over = held(), [0], threading.Event()

    def watch():
        while not over.wait(0.05):
            most[0] = max(most[0], held())

    t = threading.Thread(target=watch)
    t.start()
    try:
        out = run()
    finally:
        over.set()
        t.join()
    return out, max(most[0], held()) - first


@pytest.mark.parametrize(("n", "exact"), [(20_000, False), (6000, True)])
def test_disk_of_neighbours(spark, n, exact, monkeypatch):
    """All orderings, and all that are compared with all, in a few times the vectors' bytes; in several turns and many
    cells nothing is lost."""
    monkeypatch.setattr(neighbours, "SENT", 0)
    monkeypatch.setattr(neighbours, "ASKED", 1 << 19, raising=False)
    monkeypatch.setattr(neighbours, "CELL", 128, raising=False)
    r = np.random.default_rng(6)
    c = r.normal(size=(n // 20, 64))
    x = np.repeat(c / np.linalg.norm(c, axis=1, keepdims=True), 20, 0) + 0.02 * r.normal(size=(n, 64))
    v = dict(enumerate(x.tolist()))
    df = cut(spark.createDataFrame(list(v.items()), "rowid bigint, embedding array<float>"))
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)
    got, most = disk_peak(spark, lambda: neighbours.nearest(df, exact=exact).collect())
    assert most < 5 * 4 * 64 * n, most / (4 * 64 * n)
    found = {}
    for g in got:
        found.setdefault(g["id"], []).append((g["position"], g["neighbour"]))
    y = x.astype(np.float32).astype(float)
    hits = []
    for i in range(0, n, 37):
        d = ((y - y[i]) ** 2).sum(1)
        d[i] = np.inf
        want = np.argsort(d, kind="stable")[:5].tolist()
        hits.append(len({j for _, j in found[i]} & set(want)) / 5)
        assert not exact or [j for _, j in sorted(found[i])] == want
    assert np.mean(hits) >= 0.99


# 7: near-copies


def brute_similar(texts, t=0.6, size=3):
    sets = {i: set(zip(*(nearcopies.words(x)[k:] for k in range(size)), strict=False)) for i, x in texts.items() if x}
    sets = {i: s for i, s in sets.items() if s}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}


def similar(spark, texts, **how):
    df = spark.createDataFrame([(i, x, "z") for i, x in texts.items()], "rowid bigint, content string, a string")
    return {tuple(x) for x in nearcopies.pairs(df, **how).collect()}


def edited(r, n):
    vocabulary = [f"w{i}" for i in range(60)]
    out = {}
    for i in range(n):
        if i and r.random() < 0.6:
            w = nearcopies.words(out[r.randrange(i)])
            for _ in range(r.randint(0, 6)):
                op, at = r.random(), r.randrange(max(1, len(w)))
                w = w[:at] + [r.choice(vocabulary)] + w[at:] if op < 0.5 else w[:at] + w[at + 1 :] if op < 0.8 else w[at:] + w[:at]
            out[i] = " ".join(w).upper() if r.random() < 0.1 else ", ".join(w)
        else:
            out[i] = " ".join(r.choices(vocabulary, k=r.choice([2, 3, 4, 30, 80, 300])))
    return out


def test_near_copies_brute_force(spark):
    texts = edited(random.Random(7), 300) | {900: None, 901: "", 902: "one two", 903: "a b c", 904: "A, b -- C"}
    assert similar(spark, texts) == brute_similar(texts)
    assert similar(spark, texts, threshold=0.8, size=5) == brute_similar(texts, 0.8, 5)
    assert similar(spark, texts, max_bits=5) == brute_similar(texts)  # a table far too small


def test_hot_places_are_split(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "CELL", 8)
    r = random.Random(8)
    base = [f"w{i}" for i in range(40)]
    texts = {i: " ".join(base[:20] + r.choices(base, k=r.randint(0, 12)) + base[20:]) for i in range(90)} | {500 + i: " ".join(base) for i in range(20)}
    assert similar(spark, texts) == brute_similar(texts)
    assert similar(spark, texts, max_bits=8, exact_load=1) == brute_similar(texts)  # exact numbers beside a full table
    monkeypatch.setattr(nearcopies, "MAX_CROWDED", 0)
    assert similar(spark, texts, max_bits=8, exact_load=1) == brute_similar(texts)


def test_near_copies_edges(spark):
    assert similar(spark, {}) == set()
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d")], "rowid bigint, content string")
    assert [tuple(x) for x in nearcopies.pairs(df).collect()] == [(1, 2)]
    long = " ".join(f"w{i}" for i in range(60_000))
    assert similar(spark, {1: long, 2: long + " end"}) == {(1, 2)}
    assert {tuple(x) for x in nearcopies.links_per_row(df).collect()} == {(1, 1, 0), (2, 1, 0)}
    with pytest.raises(ValueError):
        nearcopies.similar_classes(df, threshold=0)


def test_bit_slices_count_exactly():
    r = np.random.default_rng(9)
    m = 300
    s = r.integers(0, 2**63, (m, nearcopies.PLANES // 64), dtype=np.uint64)
    s[150:] = s[:150] ^ (np.uint64(1) << r.integers(0, 63, (150, 4)).astype(np.uint64))
    ids, n = np.arange(m), np.full(m, 60)
    got = {tuple(x) for x in nearcopies.compare_places(np.zeros(m, np.int32), ids, n, s, np.zeros(m, np.int8), nearcopies.Fraction("0.6"))}
    d = lambda a, b: int(np.bitwise_count(s[a] ^ s[b]).sum())
    assert got == {(a, b) for a, b in itertools.combinations(range(m), 2) if d(a, b) <= 30}


# 6: personal information

PEOPLE = [("Wenna", "Satasen"), ("Ivanka-Lu", "Stone")]
TEXT = (
    "Minutes taken by Satasen, Wenna. Spoke to Dr. I. Stone. WENNA SATASEN will bring it. Thanks to Runa Dabeth for it? Met with Wenna Q. Dabeth about it. "
    "Mail wenna.s+x@mail.example.org, or wenna [at] post [dot] example. Call +1 (769) 555-0128, (030) 23125-724, 0049 30 23125483, 020 7946 0090 or 367.555.0142. "
    "SSN 946 18 6974, QQ 34 85 34 C, 05 938 092 223, H4Y12N386. Moved to 12 Old Tannery Street, Apt 4B, Tarn City QB2 1ZX in May. PO Box 12, Velm, ZZ 00915. Am Kupferbrink 24b, 02028 Neu-Tarnau."
)


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, g, f, "h") for g, f in PEOPLE], "person_id bigint, given_name string, family_name string, handle string")


def test_find(spark, people):
    df = spark.createDataFrame([(1, TEXT, "z"), (2, None, "z"), (3, "", "z"), (1, TEXT, "z")], "rowid bigint, content string, pii_kind string")
    got = sorted({(x["pii_kind"], x["found_text"]) for x in pii.find(df, people).collect()})
    assert got == sorted([
        ("person", "Satasen, Wenna"), ("person", "I. Stone"), ("person", "WENNA SATASEN"), ("person", "Wenna Q. Dabeth"), ("email", "wenna.s+x@mail.example.org"), ("email", "wenna [at] post [dot] example"),
        ("phone", "+1 (769) 555-0128"), ("phone", "(030) 23125-724"), ("phone", "0049 30 23125483"), ("phone", "020 7946 0090"), ("phone", "367.555.0142"), ("id_number", "946 18 6974"), ("id_number", "QQ 34 85 34 C"),
        ("id_number", "05 938 092 223"), ("id_number", "H4Y12N386"), ("address", "12 Old Tannery Street, Apt 4B, Tarn City QB2 1ZX"), ("address", "PO Box 12, Velm, ZZ 00915"), ("address", "Am Kupferbrink 24b, 02028 Neu-Tarnau"),
    ])


def test_no_false_finds():
    f = pii.Finder(*zip(*PEOPLE, strict=True))
    for s in ("Use package core@latest on the host.", "Build 4471-20-9 replaced build 4470-18-2.", "Range 2019-2023, pages 212-219.", "Lane 14, bay 3, shelf 20.", "The stone kettle.", "Ping @cached.", "2024-05-01 10:00", "Checksum 9f3ab27c01d4", "TKT-1234 and Stone"):
        assert f(s) == [], s
    assert f("x" * 200_000) == []


def test_surrogates_keep_distinctness_and_coreference(spark, people):
    texts = [(1, TEXT), (2, "cc Wenna Satasen, no reply. Mail WENNA.S+X@MAIL.EXAMPLE.ORG"), (3, None), (4, "nothing"), (5, "thanks W. Satasen")]
    df = spark.createDataFrame(texts, "rowid bigint, content string")
    table = {(x[0], x[1]): x[2] for x in pii.surrogates(pii.find(df, people), b"key").collect()}
    g, f = (s.lower() for s in table["person", "Wenna Satasen"].split(" "))
    assert table["person", "Satasen, Wenna"].lower() == f"{f}, {g}" and table["person", "WENNA SATASEN"] == f"{g} {f}".upper()
    assert table["person", "W. Satasen"].lower() == f"{g[0]}. {f}"
    assert g[-1] in "ae" and g[0] != "w" and f[0] != "s"
    assert table["email", "wenna.s+x@mail.example.org"] == table["email", "WENNA.S+X@MAIL.EXAMPLE.ORG"]
    phone = table["phone", "+1 (769) 555-0128"]
    assert [c if not c.isdigit() else "9" for c in phone] == [c if not c.isdigit() else "9" for c in "+1 (769) 555-0128"]
    originals = {pii.canonical(k, s) for k, s in table}
    assert len({pii.canonical(k, v) for (k, _), v in table.items()}) == len(originals)
    again = {x["rowid"]: x["content"] for x in pii.replace(df, people, b"key").collect()}
    assert again[3] is None and again[4] == "nothing" and "Satasen" not in again[1] and "Satasen" not in again[2]
    marked = {x["rowid"]: x["content"] for x in pii.replace(df, people, b"key", placeholders=True).collect()}
    assert "[EMAIL_" in marked[2] and "[PERSON_" in marked[1] and marked[1].count("[") == len(pii.Finder(*zip(*PEOPLE, strict=True))(TEXT))


def test_names_of_other_scripts(spark):
    names = [("Łukasz", "Šimek"), ("Иван", "Петров"), ("Ελένη", "Γιαννάκη"), ("Ada", "Ott")]
    folk = spark.createDataFrame([(i, g, f, "h", "m" if g == "Łukasz" else None) for i, (g, f) in enumerate(names)], "person_id bigint, given_name string, family_name string, handle string, gender string")
    df = spark.createDataFrame([(i, f"Seen: {g} {f} and И. Петров at 12 Rue de Rivoli, 75001 Paris, DE89 3704 0044 0532 0130 00, 4111 1111 1111 1111.") for i, (g, f) in enumerate(names)], "rowid bigint, content string")
    found = {(x["pii_kind"], x["found_text"]) for x in pii.find(df, folk).collect()}
    assert found == {("person", f"{g} {f}") for g, f in names} | {("person", "И. Петров"), ("address", "12 Rue de Rivoli, 75001 Paris"), ("id_number", "DE89 3704 0044 0532 0130 00"), ("id_number", "4111 1111 1111 1111")}
    out = {x["rowid"]: x["content"] for x in pii.replace(df, folk, b"key").collect()}
    for i, (g, f) in enumerate(names):
        new = out[i].removeprefix("Seen: ").split(" ")[:2]
        assert {pii.script_of(c) for c in new[0] + new[1]} == {pii.script_of(g[0])} and g not in out[i] and f not in out[i] and "Rivoli" not in out[i] and "4111" not in out[i]
    assert out[0].split(" ")[1][-1] in "lmnrs"  # the given gender


def test_surrogates_never_run_out(spark):
    """More people, phones and numbers than short surrogates there are: all distinct, none an original."""
    said = [("person", f"{g.capitalize()} {f.capitalize()}") for g in ("anna", "annb") for f in (f"a{i:04d}".translate(str.maketrans("0123456789", "bcdfghjklm")) for i in range(6000))]
    said += [("phone", f"+1 {i:07d}") for i in range(3000)] + [("id_number", f"{i:03d}") for i in range(1000)]  # all numbers of three digits are taken
    got = pii.surrogates(spark.createDataFrame(said, "pii_kind string, found_text string"), b"key").collect()
    assert len(got) == len(said) and len({(x[0], x[2]) for x in got}) == len(said)
    assert not {(x[0], x[2]) for x in got} & set(said)


# 4: markup


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("## Head *it* ##\n\n1. one [l](http://x)\n2. two & `c`\n\n```py\n# no\n* no\n```\n\n$a_1$ costs $5 or $6.", [("markup", "markdown"), ("heading", "Head it"), ("list_item", "one l"), ("list_item", "two & c"), ("code_block", "# no * no"), ("formula", "a_1")]),
        ("== Head ''it'' ==\n\n# one [[A|b]]\n# two<ref>note</ref>\n\n<math>a &lt; b</math>\n\n<syntaxhighlight lang=\"x\">\n<p>&amp;</p>\n</syntaxhighlight>\n[[Category:X]]", [("markup", "wiki"), ("heading", "Head it"), ("list_item", "one b"), ("list_item", "two"), ("formula", "a < b"), ("code_block", "<p>&amp;</p>")]),
        ("<H2 id=\"s\">Head <em class='x'>it</em></H2><ul><li>one &amp; <a href=\"u\">b</a><li>two</ul><pre><code>x &lt; 1\ny</code></pre><script>f()</script>", [("markup", "html"), ("heading", "Head it"), ("list_item", "one & b"), ("list_item", "two"), ("code_block", "x < 1 y")]),
        ("\\section*{Head \\emph{it}}\\label{s}\n\n\\begin{itemize}\n\\item one \\& two~\\cite{x}\n\\item \\href{u}{b} \\textless{} c\n\\end{itemize}\n\n\\[ a^2 \\]\n\n\\begin{verbatim}\n\\item no\n\\end{verbatim}\nand \\(b\\).", [("markup", "latex"), ("heading", "Head it"), ("list_item", "one & two"), ("list_item", "b < c"), ("formula", "a^2"), ("code_block", "\\item no"), ("formula", "b")]),
        ("# Title\n* one\n* two words", [("markup", "markdown"), ("heading", "Title"), ("list_item", "one"), ("list_item", "two words")]),
        ("## Plan\n\n- buy flour and\n  enough salt\n- call **Ada**\n\nThe end.", [("markup", "markdown"), ("heading", "Plan"), ("list_item", "buy flour and enough salt"), ("list_item", "call Ada")]),
        ("\\section{A {b {c {d {e}}}} f}\n\n\\[" + "\n".join(f"x_{i} &= {i} \\\\" for i in range(60)) + "\\]", [("markup", "latex"), ("heading", "A b c d e f"), ("formula", " ".join(f"x_{i} &= {i} \\\\" for i in range(60)))]),
        ("== Weather ==\n\n* [[Rain]] in ''May''\n* Sun\n\n{{Stub}}", [("markup", "wiki"), ("heading", "Weather"), ("list_item", "Rain in May"), ("list_item", "Sun")]),
        ("Plain text costs $5 to $9, max_per == 3 & <me@x.example>, D:\\temp\\new, #12, a * b * c.", []),
    ],
)
def test_parts(text, want):
    nodes = markup.read([text])[0]
    assert markup.parts(text, nodes) == want


def test_held_out_accuracy():
    right = total = 0
    for text, labels in markup_samples.labelled(250, 4242):
        for n in markup.read([text])[0]:
            total += 1
            right += n.language == labels[n.start]
    assert total > 1000 and right / total > 0.98


def test_decoding_prefers_consistent_choices():
    text = "```\n# head\n* item\n```"
    nodes = markup.parse(text)
    odds = np.full((len(nodes), 5), -9.0)
    odds[0] = [-0.8, -9, -0.6, -9, -9]
    odds[1:] = [-3, -9, -0.05, -9, -9]
    markup.decode(nodes, odds)
    assert [n.language for n in nodes] == [markup.NONE, markup.MARKDOWN, markup.MARKDOWN]
    odds[0] = [-9, -9, -0.1, -9, -9]
    markup.decode(nodes, odds)
    assert [n.language for n in nodes] == [markup.MARKDOWN, markup.NONE, markup.NONE]


def test_clean():
    assert markup.clean("<h1>A &amp; b</h1><p>one <b>two</b></p><ul><li>x<li>y</ul>") == "# A & b\n\none two\n\n- x\n\n- y"
    assert markup.clean("== A ==\r\n\r\n* x ''y''\r* z\r\n[[Category:q]]") == "# A\n\n- x y\n\n- z"
    assert markup.clean("\\[" * 30_000) and markup.clean("\\(" * 30_000 + "{" * 30_000)  # in good time
    assert markup.clean(None) is None and markup.clean("") == "" and markup.clean("plain * text") == "plain * text"


def test_markup_table(spark):
    df = spark.createDataFrame([(1, "T\n\n# H", "T"), (2, "[T]\n\n# H", "T"), (3, None, "T"), (4, "", None), (5, "<b>" * 3000, None), (6, "[T]\n\nplain", None), (0, "T\r\n\r\nHead\r\n----\r\n\r\n~~~\r\nx\r\n~~~\r\n", "T")], "rowid bigint, content string, title string")
    got = rows(markup.find(df, "rowid", "content", "f", title="title").filter("item_id < '5'"))
    assert [r for r in got if r[1] == "0"] == [("f", "0", "code_block", "x"), ("f", "0", "heading", "Head"), ("f", "0", "markup", "markdown")]
    assert [r for r in got if r[1] != "0"] == [("f", i, *p) for i in "12" for p in (("heading", "H"), ("markup", "markdown"))]
    assert markup.find(df.filter("rowid > 5"), "rowid", "content", "f", title="title").collect() == []
    plain = {x["item_id"]: x["clean_text"] for x in markup.cleaned(df, "rowid", "content", "f", title="title").collect()}
    assert plain["1"] == "T\n\n# H" and plain["2"] == "[T]\n\n# H" and plain["3"] is None and plain["4"] == ""
    c = markup.clean_column(df, "content")
    assert c.columns == df.columns and c.count() == 7


def test_boosting_learns():
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 5)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] > 0).astype(int) + 2 * (x[:, 2] > 0.5)
    m = Boosted(4).fit(x[:1000], y[:1000])
    assert (m.log_odds(x[1000:]).argmax(1) == y[1000:]).mean() > 0.9
