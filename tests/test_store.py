import json
import os
import sys

import pytest
from pyspark.sql import functions as F

from siltstone import cli, config
from siltstone.functions.embedding import Hashing
from siltstone.operators import ingest, judging, store, summaries
from siltstone.plans.engine import Engine
from siltstone.sources import files, html
from siltstone.streaming.follow import follow

from conftest import rows


def docs(spark, items, source="notes"):
    return spark.createDataFrame([(source, k, k.title(), None, None, None, None, b, k, i) for i, (k, b) in enumerate(items)], ingest.DOCUMENTS)


def hashes(s):
    return {r["id"]: r["content_hash"] for r in s.chunks().collect()}


def test_ingest_is_idempotent_and_drops_orphans(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), 32)
    items = [("a", "## one\nfirst\n\n## two\n" + "x " * 1500), ("b", "beta text")]
    first = ingest.ingest(s, docs(spark, items), Hashing(32))
    assert first[0]["inserted"] == s.chunks().count() > 2
    again = ingest.ingest(s, docs(spark, items), Hashing(32))
    assert (again[0]["inserted"], again[0]["updated"], again[0]["deleted"]) == (0, 0, 0) and again[0]["skipped"] == first[0]["inserted"]
    version = s.meta["version"]
    ingest.ingest(s, docs(spark, items), Hashing(32))
    assert s.meta["version"] == version  # nothing changed, nothing written
    less = ingest.ingest(s, docs(spark, [("a", "## one\nfirst"), ("c", "new")]), Hashing(32))
    assert less[0]["deleted"] == s_count(first) - 1 and set(hashes(s)) == {"notes:a:section:0", "notes:c:section:0"}


def s_count(report):
    return report[0]["inserted"]


def test_only_changed_chunks_are_embedded(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), 8)
    ingest.ingest(s, docs(spark, [("a", "one"), ("b", "two")]), Hashing(8))
    new = ingest.chunk(docs(spark, [("a", "one"), ("b", "changed"), ("c", "three")]))
    assert {r["source_key"] for r in store.changed(new, s.chunks()).collect()} == {"b", "c"}


def test_near_duplicates_and_secrets(spark):
    d = docs(spark, [("a", "Same text https://x.example 2024-01-01"), ("b", "same  TEXT"), ("c", "other password = 'abcdefghijklmnop1234'")])
    kept = ingest.first_wins(d)
    assert {r["source_key"] for r in kept.collect()} == {"a", "c"}
    c = {r["source_key"]: r for r in ingest.chunk(kept).collect()}
    assert c["c"]["content"] == "C\n\nother password=[REDACTED:credential]"
    assert c["a"]["id"] == "notes:a:section:0" and c["a"]["content"].startswith("A\n\nSame")


def test_blank_chunks_have_no_vector(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), 8)
    r = ingest.ingest(s, docs(spark, [("a", "text"), ("b", "  "), ("c", None)]), Hashing(8))
    assert r[0]["inserted"] == 1


def test_failed_write_changes_nothing(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), 8)
    ingest.ingest(s, docs(spark, [("a", "one")]), Hashing(8))
    before = hashes(s)
    with pytest.raises(OSError):
        ingest.ingest(s, docs(spark, [("a", "two")]), Hashing(8), after_embed=lambda: (_ for _ in ()).throw(OSError("lost")))
    assert hashes(store.Store(spark, s.path, 8)) == before


def test_dimension_guard_sources_and_reset(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), 8)
    ingest.ingest(s, docs(spark, [("a", "one")]), Hashing(8))
    ingest.ingest(s, docs(spark, [("a", "one")], "faqs"), Hashing(8))
    with pytest.raises(store.DimensionMismatch):
        store.Store(spark, s.path, 16)
    with pytest.raises(store.DimensionMismatch):
        ingest.ingest(s, docs(spark, [("z", "zzz")]), Hashing(4))
    s.upsert_summaries(spark.createDataFrame([("notes", "a", "sum", "h1", "m", "2024", 1), ("notes", "a", "newer", "h2", "m", "2025", 1)], store.SUMMARIES))
    assert s.delete_source("notes") == 1 and {r["source_type"] for r in s.chunks().collect()} == {"faqs"}
    assert [r["summary"] for r in s.summaries().collect()] == ["newer"]  # summaries stay
    with pytest.raises(ValueError):
        s.reset()
    s.reset(sure=True)
    assert not os.path.exists(s.path)


def test_many_orphans(spark):
    old = spark.range(1001).select(F.concat(F.lit("n:"), "id").alias("id"), F.lit("n").alias("source_type"))
    assert store.orphans(old, old.filter("id = 'n:7'")).count() == 1000


def test_summaries(spark):
    c = spark.createDataFrame([("n:a:section:0", "n", "a", 0, "one"), ("n:a:section:1", "n", "a", 1, "two"), ("n:b:section:0", "n", "b", 0, "x")], "id string, source_type string, source_key string, chunk_index int, content string")
    have = spark.createDataFrame([], store.SUMMARIES)
    todo = summaries.pending(c, have)
    made = summaries.summarise(summaries.bodies(todo, c), lambda t: t[:3], "fake", 2, "2025-01-01")
    assert rows(made.select("source_key", "summary")) == [("a", "one"), ("b", "x")]
    assert summaries.pending(c, made).count() == 0
    assert {r["source_key"]: r["body"] for r in summaries.bodies(todo, c, 4).collect()} == {"a": "one", "b": "x"}
    assert tuple(summaries.cost(todo, 1.0, 5.0).select("documents", "input_tokens").first()) == (2, 2)
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert summaries.retry(flaky, sleep=lambda s: None) == "ok" and len(calls) == 3


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    (root / "b.md").write_bytes(b"\xef\xbb\xbf---\ntitle: Bee\nid: bee\nmodified: 2024-01-02\n---\r\nBody \xff text\r\nmore")
    (root / "sub" / "a.md").write_text("## Head\nplain")
    (root / "c.txt").write_text("  \n")
    (root / "d.txt").write_text("text file")
    (tmp_path / "secret.md").write_text("outside")
    os.symlink(tmp_path / "secret.md", root / "link.md")
    os.symlink(tmp_path, root / "up")
    return root


def test_discovery(tree):
    assert files.discover(str(tree), "**/*.md") == ["b.md", "sub/a.md"]
    assert files.discover(str(tree), "*.md") == ["b.md"]
    assert files.discover(str(tree), "../*.md") == []
    with pytest.raises(FileNotFoundError):
        files.discover(str(tree / "no"), "*")


def test_connectors(spark, tree):
    m = {r["source_key"]: r for r in files.load(spark, "notes", "markdown", str(tree)).collect()}
    assert set(m) == {"bee", "sub/a.md"} and m["bee"]["title"] == "Bee" and m["bee"]["body"] == "Body � text\nmore" and m["bee"]["updated_at"] == "2024-01-02"
    assert m["sub/a.md"]["title"] == "a" and m["sub/a.md"]["updated_at"]
    t = files.load(spark, "t", "text", str(tree)).collect()
    assert [(r["source_key"], r["updated_at"]) for r in t] == [("d.txt", None)]
    with pytest.raises(ValueError):
        files.load(spark, "x", "none", str(tree))


PAGE = """<html><head><title>The page</title><meta name="author" content="A. Writer"><meta property="article:published_time" content="2024-03-04"></head>
<body><nav><a href="/">Home</a> <a href="/x">Other</a></nav><article><h1>Head</h1><p>First paragraph of <b>text</b>, with words.</p><p>Second &amp; last.</p></article>
<footer>Imprint</footer><script>x()</script></body></html>"""


def test_html():
    x = html.main_content(PAGE)
    assert x["body"] == "Head\n\nFirst paragraph of text, with words.\n\nSecond & last."
    assert (x["title"], x["author"], x["created"], x["url"]) == ("The page", "A. Writer", "2024-03-04", None)
    assert html.main_content(None)["body"] == html.main_content("<p>")["body"] == ""


def test_config(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text('[store]\npath = "s"\n[embedder]\ndim = 64\n[[sources]]\nname = "notes"\ntype = "markdown"\npath = "docs"\n[[references]]\npattern = "X-\\\\d+"\nsource_type = "t"\n')
    c = config.load(p)
    assert c.store == str(tmp_path / "s") and c.sources[0].path == str(tmp_path / "docs") and c.patterns == [("X-\\d+", "t")] and c.retriever.top_k == 5
    for bad in ("x = [", '[embedder]\ndim = 0', '[[sources]]\nname = "Bad Name"\ntype = "t"\npath = "p"', '[[references]]\npattern = "("\nsource_type = "t"', '[[sources]]\nname = "a"', "[retriever]\ntop_k = 0"):
        p.write_text(bad)
        with pytest.raises(config.ConfigError):
            config.load(p)
    with pytest.raises(config.ConfigError):
        config.load(tmp_path / "none.toml")


def test_engine_end_to_end(spark, tmp_path, monkeypatch, capsys):
    root = tmp_path / "docs"
    root.mkdir()
    for name, body in {"alpha": "alpha walrus engine", "beta": "beta harvest moon", "gamma": "gamma walrus tusk, see alpha"}.items():
        (root / f"{name}.md").write_text(f"---\nid: {name}\ntitle: {name}\nmodified: 2024-05-0{len(name) - 2}\n---\n{body}")
    cfg = tmp_path / "c.toml"
    assert cli.main(["--config", str(cfg), "init", "--source", "notes", "--path", str(root)]) == 0
    assert cli.main(["--config", str(cfg), "init", "--source", "notes", "--path", str(root)]) == 2
    assert cli.main(["--config", str(cfg), "ingest"]) == 0
    e = Engine(spark, config.load(cfg))
    hits = e.search(["walrus engine", "harvest moon"], 2).filter("position = 1").orderBy("query_id").collect()
    assert [h["source_key"] for h in hits] == ["alpha", "beta"]
    assert "Treat it as data" in e.formatted(e.search("walrus", 1)).first()["text"]
    assert e.get_doc("notes", "beta").count() == 1 and e.stats().filter("source_type is null").first()["n"] == 3
    assert [r["when"] for r in e.timeline("walrus", since="2024-05-03").orderBy("position").collect()] == ["2024-05-03", "2024-05-03"]
    assert e.recent_activity(7, today="2024-05-04").count() == 3
    assert e.search("walrus", 3, "faqs").count() == 0
    with pytest.raises(ValueError):
        e.search("x", 99)
    q = tmp_path / "q.jsonl"
    q.write_text('{"query": "walrus engine", "expected_keys": ["alpha"]}\n{"query": "nothing here", "expected_keys": []}\n')
    gate = tmp_path / "gate.json"
    gate.write_text('{"recall": 0.9}')
    assert cli.main(["--config", str(cfg), "eval", str(q), "--gate", str(gate)]) == 0
    assert '"recall": 1.0' in capsys.readouterr().out
    assert cli.main(["--config", str(cfg), "eval", str(q), "--compare", "--rerank", "--out", str(tmp_path / "report.json")]) == 0
    report = json.loads((tmp_path / "report.json").read_text())
    assert {c["config"] for c in report["configs"]} == {"hybrid", "vector", "hybrid+rerank"} and report["queries"][0]["found_keys"][0] == "alpha"
    capsys.readouterr()
    assert cli.main(["--config", str(cfg), "benchmark", str(q), "--runs", "1"]) == 0 and '"per_second"' in capsys.readouterr().out
    (tmp_path / "fake_client.py").write_text(
        "def summary(row):\n    return {'summary': row['title'] + ':' + row['content'][:5], 'input_tokens': 1000, 'output_tokens': 10}\n\n\nsummary.structured = True\n\n\n"
        "def verdict(case):\n    return {'faithfulness': {'passed': '[source_key: ' in case['context_text']}}\n\n\ndef reply(q):\n    return {'answer': 'a', 'cited_keys': [q['context'][0]['source_key'], 'made up']}\n"
    )
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "fake_client.py"))
    assert cli.main(["--config", str(cfg), "summarize", "--client", "fake_client:summary", "--price-in", "2", "--limit", "2"]) == 0
    assert json.loads(capsys.readouterr().out)["cost"] == 0.004
    assert e.__class__(spark, e.config).get_summary("notes", "beta").first()["summary"] == "beta:beta\n"
    assert e.__class__(spark, e.config).get_summary("notes", "gamma").count() == 0
    (tmp_path / "cases.json").write_text('{"query": "q", "answer": "a", "human_faithful": true}\n')
    assert cli.main(["--config", str(cfg), "judge", str(tmp_path / "cases.json"), "--client", "fake_client:verdict", "--validate", "--floor", "0.8"]) == 1
    capsys.readouterr()
    asking = ["--config", str(cfg), "judge", str(q), "--answerer", "fake_client:reply"]
    assert cli.main([*asking, "--client", "fake_client:verdict", "--rerank"]) == 0 and '"axis": "faithfulness", "n": 2, "pass_rate": 1.0' in capsys.readouterr().out
    assert cli.main([*asking, "--build-fixture", str(tmp_path / "drafts")]) == 0 and cli.main(asking) == 2
    draft = spark.read.schema(judging.CASES).json(str(tmp_path / "drafts")).filter("query = 'walrus engine'").first()
    assert draft["human_faithful"] is None and draft["cited_keys"] == [draft["context"][0]["source_key"]]
    assert cli.main(["--config", str(cfg), "sources"]) == 0 and "configured" in capsys.readouterr().out
    assert cli.main(["--config", str(cfg), "reset"]) == 2 and cli.main(["--config", str(cfg), "reset", "--yes"]) == 0
    assert cli.main(["--config", str(tmp_path / "none.toml"), "stats"]) == 2


def test_a_failing_source_leaves_the_others(spark, tmp_path):
    (tmp_path / "ok").mkdir()
    (tmp_path / "ok" / "a.md").write_text("text")
    c = config.Config(str(tmp_path / "s"), embedder=config.Embedding(dim=8), sources=(config.Source("bad", "markdown", str(tmp_path / "no")), config.Source("good", "markdown", str(tmp_path / "ok"))))
    done, failed = Engine(spark, c).ingest()
    assert [d["source_type"] for d in done] == ["good"] and failed[0][0] == "bad"


def test_streaming(spark, tmp_path):
    folder, s = str(tmp_path / "in"), store.Store(spark, str(tmp_path / "s"), 8)
    docs(spark, [("a", "one")]).write.parquet(folder)
    for _ in range(2):
        follow(spark, folder, s, Hashing(8), str(tmp_path / "cp")).awaitTermination(120)
    docs(spark, [("b", "two")]).write.mode("append").parquet(folder)
    follow(spark, folder, s, Hashing(8), str(tmp_path / "cp")).awaitTermination(120)
    assert {r["source_key"] for r in store.Store(spark, s.path, 8).chunks().collect()} == {"a", "b"}


def test_a_refused_embedding_keeps_the_stored_row(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), 8)
    ingest.ingest(s, docs(spark, [("a", "one"), ("b", "old text")]), Hashing(8))
    before = hashes(s)

    def refusing(texts):
        return [None if "refused" in t else v for t, v in zip(texts, Hashing(8)(texts), strict=True)]

    r = ingest.ingest(s, docs(spark, [("a", "one"), ("b", "refused text")]), refusing)
    assert (r[0]["deleted"], r[0]["updated"], r[0]["skipped"]) == (0, 0, 1) and hashes(s) == before
    r = ingest.ingest(s, docs(spark, [("a", "one"), ("b", "new text")]), refusing)
    assert r[0]["updated"] == 1 and hashes(s) != before


def test_an_emptied_source_loses_its_chunks(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), 8)
    ingest.ingest(s, docs(spark, [("a", "one")]), Hashing(8))
    ingest.ingest(s, docs(spark, [("k", "kept")], "faqs"), Hashing(8))
    r = ingest.ingest(s, docs(spark, []), Hashing(8), sources=["notes"])
    assert r == [{"source_type": "notes", "documents": 0, "unique": 0, "chunks": 0, "inserted": 0, "updated": 0, "skipped": 0, "deleted": 1}]
    assert set(hashes(s)) == {"faqs:k:section:0"}
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "x.md").write_text("text")
    e = Engine(spark, config.Config(str(tmp_path / "t"), (config.Source("n", "markdown", str(tmp_path / "docs")),), config.Embedding(dim=8)))
    e.ingest()
    (tmp_path / "docs" / "x.md").unlink()
    assert e.ingest()[0][0]["deleted"] == 1 and e.store.chunks().count() == 0


def test_only_changed_partitions_are_written_and_old_versions_go(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), 8, partition_rows=5)
    items = [(f"d{i}", f"text {i}") for i in range(40)]
    ingest.ingest(s, docs(spark, items), Hashing(8))
    ingest.ingest(s, docs(spark, [("k", "kept")], "faqs"), Hashing(8))
    assert s.build_index() == 9 and s.build_index() == 0
    before = dict(s.meta["chunks"])
    assert len(before) == 9
    pinned = s.chunks()
    ingest.ingest(s, docs(spark, [("d3", "changed"), *items[:3], *items[4:]]), Hashing(8))
    moved = [p for p, e in s.meta["chunks"].items() if before[p] != e]
    assert len(moved) == 1 and s.chunks().count() == 41 and s.index() is None
    assert pinned.filter("source_key = 'd3'").first()["content"] == "D3\n\ntext 3"  # readers keep what they opened
    assert s.build_index() == 1 and s.index()[1] == 41
    for i in range(3):
        ingest.ingest(s, docs(spark, [("d3", f"again {i}"), *items[:3], *items[4:]]), Hashing(8))
    assert len(os.listdir(tmp_path / "s" / "_meta")) <= 2 * store.KEEP
    kind, _, b = moved[0].partition("/")
    assert len([x for x in os.listdir(tmp_path / "s" / "chunks" / f"source_type={kind}" / f"bucket={b}")]) <= store.KEEP
    ingest.ingest(s, docs(spark, [(f"e{i}", f"more {i}") for i in range(120)]), Hashing(8))  # grows: laid out in more partitions
    assert s.meta["buckets"]["notes"] == 24 and s.chunks().count() == 121


def test_pdf(spark, tmp_path, monkeypatch):
    """With a stand-in for the optional reader: pages are joined, bad pages and files skipped, the title is the file's own."""
    source = "class _P:\n    def __init__(s, t): s.t = t\n    def extract_text(s):\n        if s.t == 'bad': raise ValueError\n        return s.t\n\n\nclass _M:\n    title = ' The title '\n\n\nclass PdfReader:\n    def __init__(s, f):\n        d = f.read().decode()\n        if d == 'broken': raise ValueError\n        s.pages = [_P(x) for x in d.split('|')]\n        s.metadata = _M() if 'one' in d else None\n"
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "pypdf.py").write_text(source)
    monkeypatch.syspath_prepend(str(tmp_path / "lib"))
    spark.sparkContext.addPyFile(str(tmp_path / "lib" / "pypdf.py"))
    root = tmp_path / "docs"
    root.mkdir()
    for name, body in {"a": "one|bad|two", "b": "broken", "c": " | ", "d": "three"}.items():
        (root / f"{name}.pdf").write_text(body)
    got = {r["source_key"]: (r["title"], r["body"]) for r in files.load(spark, "p", "pdf", str(root)).collect()}
    assert got == {"a.pdf": ("The title", "one\n\ntwo"), "d.pdf": ("d", "three")}
    sys.modules.pop("pypdf", None)


def test_served_embedders():
    seen = []

    def client(texts, kind, dim):
        seen.append((len(texts), kind, dim))
        return [[1.0] * dim for _ in texts]

    from siltstone.functions import embedding

    e = embedding.provider("gemini", dim=4, client=client)
    assert e(["a", " ", "b"]) == [[1.0] * 4, None, [1.0] * 4] and e.query("q") == [1.0] * 4
    e(["x"] * 250)
    assert [n for n, k, _ in seen if k == "document"] == [2, 100, 100, 50] and seen[1] == (1, "query", 4)
    v = embedding.provider("voyage", dim=2, client=client)
    seen.clear()
    v(["x"] * 130)
    assert [n for n, *_ in seen] == [128, 2]
    with pytest.raises(RuntimeError):
        embedding.provider("voyage", dim=2, client=lambda t, kind, dim: [[1.0]])(["x"])
    with pytest.raises(ValueError):
        embedding.provider("voyage", dim=2)
    with pytest.raises(ValueError):
        e.query(" ")
