import itertools
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import evaluate, navigate, search

from conftest import rows


def df(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_nearest_brute_force(spark):
    r = random.Random(2)
    v = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(200)] + [(900, None), (901, [1.0]), (902, [math.nan] * 6), (903, [0.5] * 6), (904, [0.5] * 6)]
    q = [(1, [0.5] * 6), (2, [0.0] * 6)]
    got = search.nearest(df(spark, v, "id bigint, embedding array<float>").repartition(5), df(spark, q, "query_id bigint, embedding array<double>"), 7)
    ok = [(i, x) for i, x in v if x and len(x) == 6 and not math.isnan(x[0])]
    import numpy as np

    for qid, y in q:
        want = sorted((round(float(np.sqrt(((np.float32(x).astype(float) - y) ** 2).sum())), 9), i) for i, x in ok)[:7]
        assert [(x["distance"], x["id"]) for x in got.filter(F.col("query_id") == qid).orderBy("position").collect()] == want
    assert search.nearest(df(spark, v, "id bigint, embedding array<float>"), df(spark, [], "query_id bigint, embedding array<double>"), 3).collect() == []


def lists(spark, names):
    return df(spark, [(1, n, i + 1) for i, n in enumerate(names)], "query_id bigint, id string, position int")


def stable(ranked, weights, k=60):
    score, order = {}, []
    for names, w in zip(ranked, weights, strict=True):
        for i, n in enumerate(names):
            if n not in score:
                order.append(n)
            score[n] = score.get(n, 0) + w / (k + i + 1)
    return sorted(order, key=lambda n: -round(score[n], 12))


def test_fusion(spark):
    r = random.Random(4)
    for _ in range(4):
        a, b = r.sample("abcdefgh", 5), r.sample("abcdefgh", 4)
        w = r.choice([(1.0, 0.25), (3.0, 0.5), (1.0, 1.0)])
        got = search.fuse([(lists(spark, a), w[0]), (lists(spark, b), w[1])]).orderBy("position").collect()
        assert [x["id"] for x in got] == stable([a, b], w)


def greedy(rows_, top_k, dedupe, cap):
    seen, per, out = set(), {}, []
    for _, t, k in rows_:
        if dedupe and (t, k) in seen:
            continue
        seen.add((t, k))
        if cap is not None and per.get(t, 0) >= cap:
            continue
        per[t] = per.get(t, 0) + 1
        out.append(_)
        if len(out) == top_k:
            break
    return out


def test_diversity(spark):
    r = random.Random(6)
    data = [(i + 1, r.choice("ab"), r.choice("xyz")) for i in range(30)]
    ranked = df(spark, [(1, f"c{p}", p, t, k) for p, t, k in data], "query_id bigint, id string, position int, source_type string, source_key string")
    for dedupe, cap in itertools.product([True, False], [None, 2]):
        got = [int(x["id"][1:]) for x in search.diversify(ranked, 5, dedupe, cap).orderBy("position").collect()]
        assert got == greedy(data, 5, dedupe, cap)
    with pytest.raises(ValueError):
        search.diversify(ranked, 0)


def test_fts_weight(spark):
    q = df(spark, [("see TKT-12",), ("plain prose",), ("use `x`",), ('the "exact words"',)], "q string")
    assert [x[0] for x in q.select(search.fts_weight(F.col("q"), [r"\bTKT-\d+\b"])).collect()] == [1.0, 0.25, 1.0, 1.0]


def test_strict_queries(spark):
    q = df(spark, [(1, "cat OR dog"), (2, "a-b-c-d-e"), (3, "cat dog"), (4, None)], "query_id bigint, query string")
    assert {x["query_id"] for x in search.query_terms(q, strict=True).collect()} == {3}
    assert {x["query_id"] for x in search.query_terms(q).collect()} == {1, 2, 3}


CH = "id string, source_type string, source_key string, chunk_index int, content string, extra map<string,string>"


def chunks(spark):
    c = lambda t, k, i, s="", e=None: (f"{t}:{k}:section:{i}", t, k, i, s, e or {})
    return df(spark, [c("notes", "n", 0, "depends on TKT-9, TKT-5 and TKT-9"), c("notes", "n", 1), c("notes", "n", 2), c("tickets", "TKT-9", 1), c("tickets", "TKT-9", 0), c("tickets", "TKT-5", 0, "see TKT-5", {"parent": "TKT-9"}), c("notes", "p", 0)], CH)


def test_expand(spark):
    c = chunks(spark)
    seed = navigate.get_chunk(c, "notes:n:section:0")
    got = navigate.expand(c, seed, patterns=[(r"\bTKT-\d+\b", "tickets")])
    assert [(x["id"], x["step"]) for x in got.orderBy("position").collect()] == [
        ("notes:n:section:1", "siblings"), ("notes:n:section:2", "siblings"), ("tickets:TKT-5:section:0", "references"), ("tickets:TKT-9:section:0", "references"),
    ]
    assert navigate.expand(c, seed, patterns=[(r"\bTKT-\d+\b", "tickets")], max_results=3).count() == 3
    own = navigate.expand(c, navigate.get_chunk(c, "tickets:TKT-5:section:0"), patterns=[(r"\bTKT-\d+\b", "tickets")])
    assert [x["id"] for x in own.orderBy("position").collect()] == ["tickets:TKT-9:section:0", "tickets:TKT-9:section:1"]
    assert navigate.expand(c, navigate.get_chunk(c, "nothing")).collect() == []


def test_documents_and_counts(spark):
    c = chunks(spark)
    assert {(x["source_key"]): x["body"] for x in navigate.documents(c).collect()}["TKT-9"] == "\n\n"
    assert rows(navigate.counts(c)) == sorted([("notes", 4), ("tickets", 3), (None, 7)], key=repr)
    assert [x["id"] for x in navigate.get_document(c, "notes", "n").collect()] == [f"notes:n:section:{i}" for i in range(3)]


def test_timeline_and_recent(spark):
    found = df(spark, [(1, 1, "2024-05-01", None), (1, 2, "", "2024-01-01"), (1, 3, None, None), (1, 4, "2024-05-02T10:00", None)], "query_id bigint, position int, updated_at string, created_at string")
    t = lambda **k: [x["when"] for x in navigate.timeline(found, 10, **k).orderBy("position").collect()]
    assert t() == ["", "2024-01-01", "2024-05-01", "2024-05-02T10:00"]
    assert t(since="2024-02-01", until="2024-05-02") == ["2024-05-01"]
    c = df(spark, [("a", "n", "k", "2024-05-30"), ("b", "n", "k", "2024-05-31"), ("c", "n", "m", "2024-05-29"), ("d", "n", "z", None), ("e", "n", "y", "2024-01-01")], "id string, source_type string, source_key string, updated_at string")
    assert [x["id"] for x in navigate.recent(c, F.lit("2024-06-01").cast("date"), 7).collect()] == ["b", "c"]


def scores(spark, expected, ranked, k):
    q = df(spark, [(1, expected)], "query_id bigint, expected_keys array<string>")
    r = df(spark, [(1, i + 1, x) for i, x in enumerate(ranked)], "query_id bigint, position int, source_key string")
    got = evaluate.score_queries(q, r, k).collect()
    return tuple(got[0])[1:] if got else None


def test_metrics(spark):
    assert scores(spark, ["a"], ["x", "y", "a"], 5) == (1.0, pytest.approx(1 / 3), 0.5)
    assert scores(spark, ["a"], ["x", "y", "a"], 2) == (0.0, pytest.approx(1 / 3), 0.0)
    assert scores(spark, ["a", "b"], ["a", "x", "b"], 5)[2] == pytest.approx(1.5 / (1 + 1 / math.log2(3)))
    assert scores(spark, ["a"], [], 5) == (0.0, 0.0, 0.0)
    assert scores(spark, [], ["a"], 5) is None
    s = evaluate.summarise(df(spark, [(1, 1.0, 1.0, 1.0), (2, 0.0, 0.0, 0.0)], "query_id bigint, recall double, mrr double, ndcg double"))
    assert tuple(s.first()) == (2, 0.5, 0.5, 0.5)
    assert [(x["metric"], x["passed"]) for x in evaluate.gate(s, {"recall": 0.5, "ndcg": 0.6}).collect()] == [("recall", True), ("ndcg", False)]
    with pytest.raises(ValueError):
        evaluate.gate(s, {"speed": 1})


def test_kappa(spark):
    a, b = [True] * 6 + [False] * 4, [True] * 5 + [False] * 3 + [True, False]
    k = lambda x, y: evaluate.kappa(df(spark, list(zip(x, y, strict=True)), "a boolean, b boolean"), "a", "b").first()["kappa"]
    assert k(a, b) == pytest.approx(0.5833333)
    assert k([True] * 4, [True] * 4) == 1.0
    assert k([], []) is None


def test_latency_and_budget(spark):
    v = df(spark, [(float(i),) for i in range(1, 11)], "v double").withColumn("g", F.lit("x"))
    assert evaluate.latency(v, ["g"], "v", 1.0).first()["p50"] == 5.5
    c = df(spark, [("2024-01-01 00:00:00", 5), ("2024-01-01 00:00:59", 7), ("2024-01-01 00:01:30", 1)], "ts string, tokens int")
    assert [x["spent"] for x in evaluate.rolling_tokens(c).orderBy("ts").collect()] == [5, 12, 8]


def test_verdicts(spark):
    d = df(spark, [('{"faith": {"passed": true}}',), ("broken",), (None,)], "j string").select(evaluate.verdict_column(F.col("j"), ["faith", "cites"]).alias("v")).select("v.*")
    assert rows(d) == [(False, False), (False, False), (True, False)]
    assert {x["axis"]: x["pass_rate"] for x in evaluate.pass_rates(d, ["faith"]).collect()} == {"faith": pytest.approx(1 / 3)}


def test_nearest_ties_beyond_the_room(spark):
    import numpy as np

    r = np.random.default_rng(4)
    x = r.normal(size=(400, 6))
    x[50:350] = x[50]
    ids = r.permutation(400).tolist()
    v = list(zip(ids, x.tolist()))
    got = search.nearest(df(spark, v, "id bigint, embedding array<double>").coalesce(1), df(spark, [(ids[60], x[60].tolist())], "query_id bigint, embedding array<double>"), 10, exclude_self=True)
    want = sorted(set(ids[50:350]) - {ids[60]})[:10]
    assert [i for i, in got.orderBy("position").select("id").collect()] == want


def test_query_words_sent_or_joined(spark, monkeypatch):
    r = random.Random(12)
    text = lambda n: " ".join(r.choices(["the", "of", "a", *(f"w{i}" for i in range(40))], [30, 20, 10] + [1] * 40, k=n))
    docs = df(spark, [(i, text(r.randint(3, 30))) for i in range(300)] + [(900, None), (901, "")], "id bigint, content string")
    q = df(spark, [(i, text(r.randint(1, 6))) for i in range(60)] + [(70, "the of the"), (71, "nowhere the-of"), (72, "")], "query_id bigint, query string")
    got = []
    for most in (5000, 3):
        monkeypatch.setattr(search, "MAX_WORDS", most)
        monkeypatch.setattr(search, "MAX_TERMS", most)
        got.append(sorted(map(tuple, search.bm25(docs, q, 3, stemmed=False).select("query_id", "position", "id", "score").collect())))
    assert got[0] == got[1] and len(got[0]) > 100


def brute_bm25(docs, queries, k, words):
    """docs: id, text; queries: query_id, list of phrases; words: of a text."""
    texts = {i: words(t) for i, t in docs}
    n, avg = len(texts), sum(map(len, texts.values())) / len(texts)
    count = lambda t, p: sum(t[i : i + len(p)] == p for i in range(len(t) - len(p) + 1))
    out = []
    for q, phrases in queries:
        score = {}
        for p in phrases:
            tf = {i: c for i, t in texts.items() if (c := count(t, p))}
            w = math.log((n - len(tf) + 0.5) / (len(tf) + 0.5)) if len(tf) else 0
            for i, c in tf.items():
                score[i] = score.get(i, 0) - (w if w > 0 else 1e-6) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(texts[i]) / avg))
        out += [(q, at + 1, i, pytest.approx(s, abs=2e-9)) for at, (s, i) in enumerate(sorted((round(s, 9), i) for i, s in score.items())[:k])]
    return out


def folder_mb(spark):
    from siltstone.runtime import shared_dir

    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(shared_dir(spark).removeprefix("file:")) for f in names) / 1e6


def found_rows(found):
    return sorted(map(tuple, found.select("query_id", "position", "id", "score").collect()))


def test_bm25_keeps_packed_counts(spark, monkeypatch):
    r = random.Random(7)
    names = ["the", "of", "for", *(f"w{i}" for i in range(60))]
    text = lambda n: " ".join(r.choices(names, [30, 20, 10] + [1] * 60, k=n))
    docs = [(f"d{r.random()}", text(r.randint(1, 120))) for _ in range(2500)]
    docs += [(f"e{i}", docs[i][1]) for i in range(500)]  # ties
    asked = [(i, [r.choices(names)[0] for _ in range(r.randint(1, 4))]) for i in range(40)] + [(50, ["the", "the", "w3"]), (51, ["the-of", "w5"]), (52, ["the-of-the", "w1-w2"])]
    d, q = df(spark, docs, "id string, content string").repartition(3), df(spark, [(i, " ".join(t)) for i, t in asked], "query_id bigint, query string")
    want = brute_bm25(docs, [(i, [t.split("-") for t in own]) for i, own in asked], 12, str.split)
    before = folder_mb(spark)
    found = search.bm25(d, q, 12, stemmed=False)
    assert found_rows(found) == want
    assert folder_mb(spark) - before < sum(len(t) for _, t in docs) / 1e6  # less than the texts
    monkeypatch.setattr(search, "BLOCK", 200)  # what one block found keeps out texts of the next
    monkeypatch.setattr(search, "MAX_BAGS", 6)
    assert found_rows(search.bm25(d, q, 12, stemmed=False)) == want


def test_bm25_stemmed_keeps_packed_counts(spark):
    r = random.Random(8)
    forms = ["connect", "connected", "connections", "café", "cafes", "the", *(f"word{i}" for i in range(40))]
    stems = {"connected": "connect", "connections": "connect", "café": "cafe", "cafes": "cafe"}
    docs = [(i, " ".join(r.choices(forms, k=r.randint(0, 90)))) for i in range(1500)] + [(9000, None), (9001, "")]
    asked = [(i, [r.choice(forms) for _ in range(r.randint(1, 4))]) for i in range(30)]
    asked = [(i, [w for w in own if w.isascii()]) for i, own in asked] + [(60, ["connections-connected", "word3"])]
    d, q = df(spark, docs, "id bigint, content string").repartition(3), df(spark, [(i, " ".join(t)) for i, t in asked], "query_id bigint, query string")
    want = brute_bm25(docs, [(i, [[stems.get(w, w) for w in t.split("-")] for t in own]) for i, own in asked], 8, lambda t: [stems.get(w, w) for w in (t or "").split()])
    before = folder_mb(spark)
    assert found_rows(search.bm25(d, q, 8)) == want
    assert folder_mb(spark) - before < sum(len(t or "") for _, t in docs) / 1e6


def test_index_rows_are_not_shuffled(spark, monkeypatch):
    docs = [(i, "s" if i % 3 else "t", " ".join(w for w in ("connecting the-ends", "of-the café", "ends") for _ in range(1 + (i * len(w)) % 4))) for i in range(700)] + [(9000, "s", None), (9001, None, "the ends of the")]
    d = df(spark, docs, "id bigint, source_type string, content string").repartition(3)
    q = df(spark, [(1, "connected ends"), (2, "the-ends of"), (3, "of-the-cafe nothing"), (4, "ends ends the-of")], "query_id bigint, query string")
    index = search.postings(d)
    assert "Exchange" not in index[0]._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    want = found_rows(search.bm25(d, q, 30))
    assert len(want) > 60 and found_rows(search.bm25_indexed(index, q, 30)) == want
    monkeypatch.setattr(search, "BLOCK", 50)
    monkeypatch.setattr(search, "HELD", 300)
    monkeypatch.setattr(search, "MAX_WORDS", 2)
    stored = (index[0].repartition(4, "term").sortWithinPartitions("term", "id"), *index[1:])
    assert found_rows(search.bm25_indexed(stored, q, 30)) == want
    own = found_rows(search.bm25_indexed(index, q, 10, sources=["t"]))
    assert own == [(x[0], n + 1, *x[2:]) for k in range(1, 5) for n, x in enumerate([x for x in found_rows(search.bm25(d, q, 800)) if x[0] == k and x[2] % 3 == 0 and x[2] < 9000][:10])]


def test_many_queries_go_through_few_tasks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(search, "MAX_SENT", 1000, raising=False)
    g = np.random.default_rng(9)
    x = (1 + 1e-4 * g.normal(size=(3000, 8))).astype(np.float32)  # nearer than single precision can tell
    x[700:760] = x[700]
    v = df(spark, list(enumerate(x.tolist())), "id bigint, embedding array<float>").repartition(40)
    q = v.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    found = search.nearest(v, q, 10, exclude_self=True)
    y = x.astype(float)
    for i, own in itertools.groupby(sorted(map(tuple, found.select("query_id", "position", "id", "distance").collect())), lambda r: r[0]):
        d = np.round(np.sqrt(((y - y[i]) ** 2).sum(1)), 9)
        assert [(n, at) for _, _, n, at in own] == [(int(n), d[n]) for n in np.lexsort((np.arange(3000), d)) if n != i][:10]
    assert f"Coalesce {2 * spark.sparkContext.defaultParallelism}" in found._jdf.queryExecution().executedPlan().toString()  # 8 x 150 x 10 rows are sent, not 40 x 150 x 10
