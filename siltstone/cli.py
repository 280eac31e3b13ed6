"""Command line: init, ingest, query, eval, benchmark, summarize, judge, stats, sources, reset.

Clients of language models are named as ``module:function``.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import functions as F


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siltstone")
    p.add_argument("--config", default="siltstone.toml")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("init")
    i.add_argument("--source", required=True)
    i.add_argument("--type", default="markdown")
    i.add_argument("--path", required=True)
    g = sub.add_parser("ingest")
    g.add_argument("--source")
    q = sub.add_parser("query")
    q.add_argument("text")
    q.add_argument("-k", type=int)
    q.add_argument("--sources")
    q.add_argument("--raw", action="store_true", help="fused order, without deduplication and caps")
    q.add_argument("--whole", action="store_true", help="whole contents, not the first 800 characters")
    e = sub.add_parser("eval")
    e.add_argument("queries", help="JSON lines: query, expected_keys, source_type (a tag), source_filter")
    e.add_argument("-k", type=int, default=5)
    e.add_argument("--gate", help="JSON file of metric floors")
    e.add_argument("--compare", action="store_true", help="also vectors only and, where it differs, with reranking")
    e.add_argument("--out", help="writes the report, with a row a query, to this JSON file")
    b = sub.add_parser("benchmark")
    b.add_argument("queries", help="JSON lines with query")
    b.add_argument("--runs", type=int, default=5)
    b.add_argument("-k", type=int, default=5)
    b.add_argument("--out", help="writes the report to this JSON file")
    m = sub.add_parser("summarize")
    m.add_argument("--client", required=True, help="maps a text to its summary")
    m.add_argument("--model", default="custom")
    m.add_argument("--limit", type=int, help="documents of each source that are looked at, summarised ones included")
    m.add_argument("--dry-run", action="store_true", help="only the number of documents and the cost")
    m.add_argument("--price-in", type=float, default=0.0)
    m.add_argument("--price-out", type=float, default=0.0)
    j = sub.add_parser("judge", help="answers questions from what is found and judges the answers; or validates the judge; or drafts cases")
    j.add_argument("cases", help="JSON lines: questions (query, note), or with --validate cases as judging.CASES")
    j.add_argument("--client", help="judge: maps a case to its verdicts")
    j.add_argument("--answerer", help="maps query and context to answer and cited_keys")
    j.add_argument("--validate", action="store_true", help="compare the judge with the human verdicts of the cases")
    j.add_argument("--build-fixture", metavar="PATH", help="write answers as cases to label, and judge nothing")
    j.add_argument("--floor", type=float, help="least kappa")
    j.add_argument("-k", type=int, default=5)
    for x in (q, e, j):
        x.add_argument("--rerank", action="store_true", default=None)
        x.add_argument("--no-hybrid", action="store_true", help="vectors only")
    sub.add_parser("stats")
    sub.add_parser("sources")
    r = sub.add_parser("reset")
    r.add_argument("--yes", action="store_true")
    return p


def _lines(path: str) -> list[dict]:
    return [json.loads(x) for x in Path(path).read_text().splitlines() if x.strip()]


def _report(found: dict | list, out: str | None) -> None:
    text = json.dumps(found)
    if out:
        Path(out).write_text(text + "\n")
    print(text)


def _eval(engine, cases: list[dict], k: int, **how):
    """Scored queries of an evaluation set, each searched in the sources it names."""
    from siltstone.operators import evaluate

    asked = engine.spark.createDataFrame([(i, c["query"], c.get("expected_keys") or [], c.get("source_type")) for i, c in enumerate(cases)], "query_id bigint, query string, expected_keys array<string>, source_type string")
    groups: dict[tuple, list[int]] = {}
    for i, c in enumerate(cases):
        groups.setdefault(tuple(c.get("source_filter") or ()), []).append(i)
    found = None
    for sources, own in groups.items():
        ids = engine.spark.createDataFrame(list(enumerate(own)), "query_id bigint, n bigint")
        part = engine.search([cases[i]["query"] for i in own], k, list(sources), **how).join(ids, "query_id").drop("query_id").withColumnRenamed("n", "query_id")
        found = part if found is None else found.unionByName(part)
    return asked, found, evaluate.score_queries(asked, found, k)


def main(argv: list[str] | None = None) -> int:
    """0 success; 1 a source failed, nothing was found or a gate was missed; 2 bad input."""
    from siltstone import config

    args = _parser().parse_args(argv)
    if args.command == "init":
        if Path(args.config).exists():
            print(f"{args.config} exists", file=sys.stderr)
            return 2
        Path(args.config).write_text(config.render("store", config.Source(args.source, args.type, args.path), config.Embedding()))
        return 0
    try:
        conf = config.load(args.config)
    except config.ConfigError as e:
        print(e, file=sys.stderr)
        return 2
    from siltstone.functions.embedding import load_client
    from siltstone.operators import evaluate, judging, navigate, summaries
    from siltstone.plans.engine import Engine
    from siltstone.runtime import cut, session

    engine = Engine(session(), conf)
    if args.command == "ingest":
        done, failed = engine.ingest(args.source)
        for d in done:
            print(json.dumps(d))
        for name, why in failed:
            print(f"{name}: {why}", file=sys.stderr)
        return 1 if failed else 0
    if args.command == "query":
        how = ({"dedupe": False, "per_type": None} if args.raw else {}) | ({"use_fts": False} if args.no_hybrid else {})
        rows = engine.formatted(engine.search(args.text, args.k, args.sources, args.rerank, **how), None if args.whole else 800).collect()
        print(rows[0]["text"] if rows else "no results")
        return 0 if rows else 1
    if args.command == "eval":
        try:
            cases, floors = _lines(args.queries), json.loads(Path(args.gate).read_text()) if args.gate else {}
        except (OSError, ValueError) as e:
            print(e, file=sys.stderr)
            return 2
        base = {"use_fts": False} if args.no_hybrid else {}
        asked, found, scores = _eval(engine, cases, args.k, rerank=args.rerank, **base)
        scores = scores.cache()
        total = evaluate.summarise(scores)
        report = total.first().asDict() | {"by_type": [r.asDict() for r in evaluate.breakdown(scores, asked).orderBy("source_type").collect()]}
        if args.compare:
            configs = {"hybrid": {"rerank": False}, "vector": {"rerank": False, "use_fts": False}, "hybrid+rerank": {"rerank": True}}
            report["configs"] = [r.asDict() for r in evaluate.compare(asked, {n: _eval(engine, cases, args.k, **how)[1] for n, how in configs.items()}, args.k).collect()]
        if args.out:  # evaluation sets are small
            keys = found.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "source_key"))), lambda x: x["source_key"]).alias("found_keys"))
            report["queries"] = [r.asDict() for r in asked.join(keys, "query_id", "left").join(scores, "query_id", "left").orderBy("query_id").collect()]
        _report(report, args.out)
        return 0 if not floors or not evaluate.gate(total, floors).filter("not passed").count() else 1
    if args.command == "benchmark":
        texts = [x["query"] for x in _lines(args.queries)]
        samples = []
        for _ in range(args.runs):
            for stage, texts_ in [("single", [t]) for t in texts] + [("batch", texts)]:
                began = time.perf_counter()
                engine.search(texts_, args.k).collect()
                samples.append((stage, (time.perf_counter() - began) / len(texts_)))
        rows = engine.spark.createDataFrame(samples, "stage string, seconds double")
        found = evaluate.latency(rows, ["stage"], "seconds").join(evaluate.throughput(rows, ["stage"], "seconds"), "stage")
        _report([r.asDict() for r in found.orderBy("stage").collect()], args.out)
        return 0
    if args.command == "summarize":
        todo = summaries.pending(engine.store.chunks(), engine.store.summaries(), args.limit)
        report = summaries.cost(todo, args.price_in, args.price_out).first().asDict()
        if not args.dry_run:
            made = cut(summaries.summarise(summaries.bodies(todo, engine.store.chunks()), load_client(args.client), args.model))
            engine.store.upsert_summaries(made)
            report |= evaluate.realised_cost(made, args.price_in, args.price_out).first().asDict()
        _report(report, None)
        return 0
    if args.command == "judge":
        if args.validate:
            cases = judging.judge(judging.read_cases(engine.spark, args.cases), load_client(args.client))
            report = evaluate.judge_report(cases.withColumn("judged_faithful", F.col("verdict.faithfulness"))).first().asDict()
            _report(report, None)
            return 1 if args.floor is not None and (report["kappa"] or 0.0) < args.floor else 0
        if not args.answerer or not (args.client or args.build_fixture):
            print("name an answerer, and a judge or a file for the cases", file=sys.stderr)
            return 2
        asked = _lines(args.cases)
        notes = engine.spark.createDataFrame([(i, a.get("note") or "") for i, a in enumerate(asked)], "query_id bigint, note string")
        questions = engine.contexts([a["query"] for a in asked], args.k, args.rerank).join(notes, "query_id")
        if args.build_fixture:
            judging.write_cases(judging.draft_cases(questions, load_client(args.answerer)), args.build_fixture)
            return 0
        verdicts = judging.judge(judging.answer(questions, load_client(args.answerer)), load_client(args.client)).select("verdict.*")
        _report([r.asDict() for r in evaluate.pass_rates(verdicts, judging.AXES).orderBy("axis").collect()], None)
        return 0
    if args.command == "stats":
        for r in engine.stats().orderBy("source_type").collect():
            print(f"{r['source_type'] or 'total'}\t{r['shown']}")
    if args.command == "sources":
        have = engine.spark.createDataFrame([(s.name,) for s in conf.sources], "source_type string")
        for r in navigate.stale_sources(engine.store.chunks(), have).orderBy(F.col("source_type")).collect():
            print(f"{r['source_type']}\t{r['chunks']}\t{r['state']}")
    if args.command == "reset":
        if not args.yes:
            print("pass --yes to delete the store", file=sys.stderr)
            return 2
        engine.store.reset(sure=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
