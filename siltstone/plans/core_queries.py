"""Queries of the core's operators over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import chunking, embedding, text
from siltstone.operators import evaluate, incremental, ingest, judging, navigate, search, store, summaries, timestamps
from siltstone.runtime import cut, scratch, settled, table
from siltstone.sources import html

REFERENCES = [(r"\bTKT-\d+\b", "tickets")]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.work_list(*(table(spark, d, t) for t in ("chunks", "chunk_commits", "ingest_runs", "summaries")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    out = timestamps.normalise(table(spark, d, "chunks"), table(spark, d, "sources"), ["created_at", "updated_at"])
    return out.filter("exact").select("rowid", "stamp_field", "epoch_us")


def current(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    """The store as it is: the latest arrival of each id."""
    w = Window.partitionBy("id").orderBy(F.desc("load_seq"), F.desc("rowid"))
    cols = ["id", "rowid", "source_type", "source_key", "chunk_index", *extra]
    rows = table(spark, d, "chunks").filter("id is not null")
    return rows.select("load_seq", *cols).withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*cols)


def scrub_chunks(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select("doc_id", text.sha256(text.scrub(F.col("text"))).alias("redacted_hash"))


def secrets_found(spark: SparkSession, d: str) -> DataFrame:
    """Every content with shapes of three kinds of credentials, made of the row's own digest, put behind it."""
    h = F.sha2(F.coalesce("content", F.lit("")), 256)
    made = F.concat_ws(" ", "content", F.concat(F.lit("AKIA"), F.upper(F.substring(h, 1, 16))), F.concat(F.lit("ghp_"), h), F.concat(F.lit("token = "), h))
    t = table(spark, d, "chunks").select("rowid", F.explode(text.find_secrets(made)).alias("s"))
    return t.groupBy("rowid", F.col("s.name").alias("secret_kind")).agg(F.count(F.lit(1)).alias("n"))


def fingerprint_dedupe(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("source_type"), F.col("doc_id").alias("load_seq"), F.col("text").alias("body"))
    return ingest.first_wins(docs).select(F.col("load_seq").alias("doc_id"), text.fingerprint(F.coalesce("body", F.lit(""))).alias("fingerprint"))


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("rowid", text.token_estimate(F.col("content")).alias("tokens"), text.chunk_id(F.col("source_type"), F.col("source_key"), F.col("chunk_kind"), F.col("chunk_index")).alias("made_id"))


def source_stats(spark: SparkSession, d: str) -> DataFrame:
    return navigate.counts(current(spark, d))


def distinct_keys(spark: SparkSession, d: str) -> DataFrame:
    return navigate.distinct_keys(table(spark, d, "chunks"), "tickets")


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "markdown_docs")
    docs = m.select("source_type", F.col("path").alias("source_key"), F.coalesce(F.col("frontmatter")["title"], "path").alias("title"), *[F.lit(None).cast("string").alias(c) for c in ("url", "author", "created_at", "updated_at")], "body", "path", F.lit(0).alias("load_seq"))
    return ingest.chunk(docs).select("id", "chunk_index", "content_hash", "token_count")


def chunk_count_long(spark: SparkSession, d: str) -> DataFrame:
    """Pieces and their total length of the whole documents table; SQL cannot say the splitting."""
    t = table(spark, d, "documents").select("doc_id", chunking.pieces(F.col("text")).alias("p"))
    return t.select("doc_id", F.size("p").alias("pieces"), F.aggregate("p", F.lit(0), lambda a, x: a + F.length(x)).alias("chars"))


def first_arrivals(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("id").orderBy("load_seq", "rowid")
    return table(spark, d, "chunks").filter("id is not null").select("id", "source_type", "source_key", "content_hash", "content", "load_seq", "rowid").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "load_seq", "rowid")


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("content_hash", text.sha256(F.coalesce("content", F.lit(""))))


def upsert_changed(spark: SparkSession, d: str) -> DataFrame:
    old, new = _hashed(first_arrivals(spark, d)), _hashed(table(spark, d, "chunks").filter("id is not null").select("id", "source_type", "source_key", "content_hash", "content", "load_seq"))
    return store.merge(old.drop("content"), new).groupBy("source_type", "action").agg(F.count(F.lit(1)).alias("n"))


def changed_rows(spark: SparkSession, d: str) -> DataFrame:
    return store.changed(_hashed(current(spark, d, "content")), _hashed(first_arrivals(spark, d))).select("id", "content_hash")


def orphans(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "chunk_commits").select("id", F.split("id", ":")[0].alias("source_type")).distinct()
    return store.orphans(done, table(spark, d, "chunks").select("id", "source_type")).select("id", "source_type")


def ingest_report(spark: SparkSession, d: str) -> DataFrame:
    return ingest.report(_hashed(first_arrivals(spark, d)), _hashed(current(spark, d, "content")))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def knn_batch(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    q = v.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    return search.nearest(v, q, 10, exclude_self=True).select("query_id", "id", F.round("distance", 6).alias("distance"), "position")


def knn_l2(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of one query vector, the first one's."""
    v = _vectors(spark, d)
    q = v.filter("id = 0").withColumnRenamed("id", "query_id")
    return search.nearest(v, q, 10).select("id", F.round("distance", 6).alias("distance"), "position")


def _titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("doc_id % 20 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))


def bm25_batch(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return search.bm25(docs, _titles(spark, d), 10, "doc_id", "text", stemmed=False).select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def bm25_stemmed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return search.bm25(docs, _titles(spark, d), 10, "doc_id", "text").select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def bm25_index(spark: SparkSession, d: str) -> DataFrame:
    """The same from an index that is made first; ``wrong`` counts the rows in which the two differ."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_type"), F.col("text").alias("content"))
    found = search.bm25_indexed(search.postings(docs), _titles(spark, d), 10)
    both = found.select("query_id", "id", "score").withColumn("in_index", F.lit(1)).join(bm25_stemmed(spark, d).select("query_id", F.col("doc_id").alias("id"), F.col("score").alias("other")), ["query_id", "id"], "full")
    return both.agg(F.count_if(~F.round("score", 6).eqNullSafe(F.col("other"))).alias("wrong"), (F.count("in_index") > 0).alias("some"))


def auto_fts_weight(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", search.fts_weight(F.col("text"), [p for p, _ in REFERENCES]).alias("weight"))


def _scorer_list(spark: SparkSession, d: str, scorer: str) -> DataFrame:
    h = table(spark, d, "search_hits").filter((F.col("scorer") == scorer) & F.col("distance").isNotNull() & ~F.isnan("distance"))
    h = h.groupBy("query_id", F.col("rowid").alias("id")).agg(F.min("distance").alias("s"))
    return h.select("query_id", "id", search.position([F.col("s"), F.col("id")]).alias("position"))


def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    f = search.fuse([(_scorer_list(spark, d, "vector"), 1.0), (_scorer_list(spark, d, "fts"), 0.25)])
    return f.select("query_id", "id", F.round("rrf", 9).alias("rrf"), "position")


def diversity_topk(spark: SparkSession, d: str) -> DataFrame:
    f = search.fuse([(_scorer_list(spark, d, "vector"), 1.0), (_scorer_list(spark, d, "fts"), 0.25)])
    c = table(spark, d, "chunks").select(F.col("rowid").alias("id"), "source_type", "source_key")
    return search.diversify(f.join(c, "id"), 10).select("query_id", "id", "source_type", "position")


def _search_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ok = (F.size("embedding") == 64) & F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    vec = table(spark, d, "chunks_vec").filter(ok).groupBy("rowid").agg(F.min("embedding").alias("embedding"))
    chunks = settled(current(spark, d, "content", "title").join(vec, "rowid", "left"))  # as a store has it
    q = chunks.filter("rowid % 20 = 0 and embedding is not null and title is not null").select(F.col("rowid").alias("query_id"), F.col("title").alias("query"), "embedding")
    return chunks, q


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    chunks, q = _search_tables(spark, d)
    r = search.hybrid(chunks, q, 5, stemmed=False, patterns=[p for p, _ in REFERENCES])
    return r.select("query_id", "position", "id", F.round("rrf", 9).alias("rrf"))


def rerank_lexical(spark: SparkSession, d: str) -> DataFrame:
    chunks, q = _search_tables(spark, d)
    near = search.nearest(chunks.filter("embedding is not null"), q, 30)
    rows = near.join(chunks.select("id", "source_type", "source_key", "content"), "id").join(q.select("query_id", "query"), "query_id")
    return search.rerank(rows).select("query_id", "id", "position", F.round("rerank_score", 6).alias("rerank_score"))


def get_doc(spark: SparkSession, d: str) -> DataFrame:
    return navigate.get_document(current(spark, d, "content"), "journal", "worklog/rolling").select("id", "chunk_index", text.sha256(F.col("content")).alias("h"))


def reconstruct_doc(spark: SparkSession, d: str) -> DataFrame:
    return incremental.hash_documents(current(spark, d, "content")).withColumnRenamed("hash", "doc_hash")


def summary_pending(spark: SparkSession, d: str) -> DataFrame:
    return summaries.pending(current(spark, d, "content"), table(spark, d, "summaries")).select("source_type", "source_key", "doc_hash")


def summary_cost(spark: SparkSession, d: str) -> DataFrame:
    return summaries.cost(summaries.pending(current(spark, d, "content"), table(spark, d, "summaries")), 1.0, 5.0).select("documents", "input_tokens", F.round("estimate", 6).alias("estimate"))


def _dated(spark: SparkSession, d: str) -> DataFrame:
    return current(spark, d, "created_at", "updated_at")


def timeline(spark: SparkSession, d: str) -> DataFrame:
    h = _scorer_list(spark, d, "vector")
    rows = h.join(table(spark, d, "chunks").select(F.col("rowid").alias("id"), "created_at", "updated_at"), "id")
    return navigate.timeline(rows, 10, since="2019", until="2026").select("query_id", "id", "when", "position")


def recent_activity(spark: SparkSession, d: str) -> DataFrame:
    return navigate.recent(_dated(spark, d), F.lit("2025-06-01").cast("date"), 365, 20).select("id", "updated_at")


def _seeds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = current(spark, d, "content", "extra")
    return c, c.filter("rowid % 20 = 0")


def expand_context(spark: SparkSession, d: str) -> DataFrame:
    return navigate.expand(*_seeds(spark, d), patterns=REFERENCES)


def expand_references(spark: SparkSession, d: str) -> DataFrame:
    """Every content names the last ticket that has a chunk of the same number, besides those it names itself."""
    c = current(spark, d, "content", "extra")
    named = c.filter("source_type = 'tickets'").groupBy("chunk_index").agg(F.max("source_key").alias("named"))
    seeds = c.filter("rowid % 20 = 0").join(named, "chunk_index", "left").withColumn("content", F.concat_ws(" see ", "content", "named"))
    return navigate.expand(c, seeds, include=["references"], patterns=REFERENCES)


def expand_siblings(spark: SparkSession, d: str) -> DataFrame:
    return navigate.expand(*_seeds(spark, d), include=["siblings"], max_results=5)


def _eval(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    keys = table(spark, d, "chunks").select(F.col("rowid").alias("id"), F.concat_ws(":", "source_type", "source_key").alias("source_key"), "source_type")
    want = _scorer_list(spark, d, "rerank").join(keys, "id")
    want = want.withColumn("last", F.max("position").over(Window.partitionBy("query_id"))).filter("position > last - 2")
    q = want.groupBy("query_id").agg(F.sort_array(F.collect_set("source_key")).alias("expected_keys"), F.min("source_type").alias("source_type"))
    ranked = _scorer_list(spark, d, "vector").join(keys, "id").filter("position <= 10")
    return q, ranked


def eval_queries(spark: SparkSession, d: str) -> DataFrame:
    s = evaluate.score_queries(*_eval(spark, d), 5)
    return s.select("query_id", "recall", *[F.round(c, 9).alias(c) for c in ("mrr", "ndcg")])


def eval_breakdown(spark: SparkSession, d: str) -> DataFrame:
    q, r = _eval(spark, d)
    b = evaluate.breakdown(evaluate.score_queries(q, r, 5), q)
    return b.select("source_type", "n", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


def eval_gate(spark: SparkSession, d: str) -> DataFrame:
    g = evaluate.gate(evaluate.summarise(evaluate.score_queries(*_eval(spark, d), 5)), {"recall": 0.95, "ndcg": 0.85})
    return g.select("metric", F.round("value", 6).alias("value"), "floor", "passed")


def eval_compare(spark: SparkSession, d: str) -> DataFrame:
    q, vector = _eval(spark, d)
    keys = table(spark, d, "chunks").select(F.col("rowid").alias("id"), F.concat_ws(":", "source_type", "source_key").alias("source_key"))
    fts = _scorer_list(spark, d, "fts").join(keys, "id").filter("position <= 10")
    c = evaluate.compare(q, {"vector": vector, "fts": fts}, 5)
    return c.select("config", "n", *[F.round(x, 6).alias(x) for x in ("recall", "mrr", "ndcg")])


def seeded_shuffle(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "search_hits").select("query_id", "rowid").distinct()
    o = h.withColumn("o", judging.seeded_order(F.col("query_id").cast("string"), F.col("rowid").cast("string")))
    return o.select("query_id", "rowid", search.position([F.col("o")]).alias("place"))


def rolling_budget(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.length("props").alias("tokens"))
    return evaluate.rolling_tokens(e, by=["user_id"]).select("event_id", "spent")


def throughput(spark: SparkSession, d: str) -> DataFrame:
    t = evaluate.throughput(table(spark, d, "events").filter("value > 0"), ["event_type"], "value")
    return t.select("event_type", F.round("per_second", 6).alias("per_second"))


def format_results(spark: SparkSession, d: str) -> DataFrame:
    v = _scorer_list(spark, d, "vector").filter("position <= 5")
    h = table(spark, d, "search_hits").filter("scorer = 'vector' and not isnan(distance)").groupBy("query_id", F.col("rowid").alias("id")).agg(F.min("distance").alias("distance"))
    c = table(spark, d, "chunks").select(F.col("rowid").alias("id"), "source_type", "source_key")
    rows = v.join(h, ["query_id", "id"]).join(c, "id")
    return rows.select("query_id", "position", text.result_line(F.col("position"), F.col("source_type"), F.col("source_key"), F.col("distance")).alias("line"))


def _raters(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "search_hits").filter("distance is not null and not isnan(distance)")
    v = lambda s: F.max(F.when(F.col("scorer") == s, F.col("distance")))
    p = h.groupBy("query_id", "rowid").agg(v("rerank").alias("r"), v("vector").alias("v"), v("fts").alias("f"))
    return p.select((F.col("r") > 0).alias("human_faithful"), F.coalesce(F.col("v") < 0.8, F.lit(False)).alias("judged_faithful"), (F.col("f") > -3).alias("adversarial"))


def judge_report(spark: SparkSession, d: str) -> DataFrame:
    r = evaluate.judge_report(_raters(spark, d))
    return r.select("n", F.round("agreement", 9).alias("agreement"), F.round("kappa", 9).alias("kappa"), "adversarial_total", "adversarial_caught")


def judge_pass_rates(spark: SparkSession, d: str) -> DataFrame:
    p = evaluate.pass_rates(_raters(spark, d), ["human_faithful", "judged_faithful", "adversarial"])
    return p.select("axis", "n", F.round("pass_rate", 9).alias("pass_rate"))


def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.latency(table(spark, d, "events"), ["event_type"], "value")


def list_sources_stale(spark: SparkSession, d: str) -> DataFrame:
    """All sources, and one of which nothing is configured: that of the chunks without an extra map."""
    c = table(spark, d, "chunks").select(F.when(F.col("extra").isNull(), "unknown").otherwise(F.col("source_type")).alias("source_type"))
    return navigate.stale_sources(c, table(spark, d, "sources"))


def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    """The numbers of each text's vector that are not zero; with MD5, which SQL has too."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    e = embedding.embed(docs, "text", embedding.Hashing(256, "md5")).select("doc_id", F.posexplode("embedding").alias("place", "value"))
    return e.filter("value <> 0").select("doc_id", "place", F.round(F.col("value").cast("double"), 6).alias("value"))


def html_extract(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("rowid", html.extract("content").alias("x"))
    return c.select("rowid", text.sha256(F.col("x.body")).alias("body_hash"), "x.title", "x.author", "x.url", "x.created")


def _one_chunk_documents(rows: DataFrame) -> DataFrame:
    """A document for each row (id, source_type, content): its title is the id, its body two digests."""
    body = F.concat_ws(" ", F.sha2("id", 256), F.sha2(F.coalesce("content", F.lit("")), 256))
    null = [F.lit(None).cast("string").alias(c) for c in ("url", "author", "created_at", "updated_at")]
    return rows.select("source_type", F.col("id").alias("source_key"), F.col("id").alias("title"), *null, body.alias("body"), F.col("id").alias("path"), F.lit(0).cast("bigint").alias("load_seq"))


class _Refusing:
    """An embedder that refuses texts whose second digest begins with a zero."""

    def __call__(self, texts: list) -> list:
        return [None if t is None or t[-64] == "0" else [float(len(t)), 1.0] for t in texts]


def ingest_twice(spark: SparkSession, d: str) -> DataFrame:
    """What a store holds after two ingests: first arrivals with ids that only commits know, then the latest arrivals,
    of which the embedder refuses some."""
    first = first_arrivals(spark, d).select("id", "source_type", "content")
    types = table(spark, d, "chunks").select("source_type").distinct()
    gone = table(spark, d, "chunk_commits").filter("id is not null").select("id", F.split("id", ":")[0].alias("source_type"), F.lit(None).cast("string").alias("content")).distinct()
    gone = gone.join(first.select("id"), "id", "left_anti").join(types, "source_type", "left_semi")
    s = store.Store(spark, scratch(spark, "store"))
    ingest.ingest(s, _one_chunk_documents(first.unionByName(gone)), embedding.Hashing(2))
    ingest.ingest(s, _one_chunk_documents(current(spark, d, "content")), _Refusing())
    return s.chunks().select("id", "content_hash")


def incremental_refresh(spark: SparkSession, d: str) -> DataFrame:
    """A derived table of all chunks: made from the first arrivals, then a run on the latest ones dies after its write,
    then the source goes back (state ``back``), then a run on the latest ones ends well (state ``ahead``)."""
    old, new = (_hashed(x).select("id", "content_hash") for x in (first_arrivals(spark, d), current(spark, d, "content")))
    t = incremental.IncrementalTable(spark, scratch(spark, "table"), ["id"], ["content_hash"])
    derive = lambda rows: rows.select("id", F.substring("content_hash", 1, 16).alias("short"))

    def die() -> None:
        raise InterruptedError

    t.refresh(old, derive)
    try:
        t.refresh(new, derive, die)
    except InterruptedError:
        pass
    t.refresh(old, derive)
    back = cut(t.read().select(F.lit("back").alias("state"), "id", "short"))
    t.refresh(new, derive)
    return back.unionByName(t.read().select(F.lit("ahead").alias("state"), "id", "short"))


def metadata_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Metadata as JSON and read again, and counts as shown."""
    c = table(spark, d, "chunks").select("rowid", text.metadata_json("source_key", "chunk_index", "token_count").alias("j"))
    m = text.parse_metadata(F.col("j"), "source_key string, chunk_index int, token_count int")
    return c.select("rowid", m["source_key"].alias("source_key"), m["chunk_index"].alias("chunk_index"), text.thousands(m["token_count"] * 1000).alias("shown"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p2_found, scrub_chunks, secrets_found, fingerprint_dedupe, token_estimate, source_stats, distinct_keys, chunk_documents, chunk_count_long, upsert_changed, changed_rows, orphans,
        ingest_report, knn_l2, knn_batch, bm25_batch, bm25_stemmed, bm25_index, auto_fts_weight, rrf_fuse, diversity_topk, hybrid_search, rerank_lexical, get_doc, reconstruct_doc, summary_pending,
        summary_cost, timeline, recent_activity, expand_context, expand_references, expand_siblings, eval_queries, eval_breakdown, eval_gate, eval_compare, seeded_shuffle, rolling_budget, throughput, format_results, judge_report, judge_pass_rates, latency_summary,
        list_sources_stale, hash_embed, html_extract, ingest_twice, incremental_refresh, metadata_round_trip,
    )
}

_CUR = "cur AS (SELECT * FROM chunks WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY load_seq DESC, rowid DESC) = 1)"
_FIRST = "fst AS (SELECT * FROM chunks WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY load_seq, rowid) = 1)"
_DIGEST = r"nullif(regexp_replace(lower(trim(content_hash)), '^sha-?256\s*[:=]\s*|\s+', '', 'g'), '')"


def _scrub_sql(c: str) -> str:
    for name, label, p in text.SECRETS:
        p = p.replace("'", "''")
        new = ("\\1=" if name == "api-key-assignment" else "") + f"[REDACTED:{label}]"
        c = f"regexp_replace({c}, '{p}', '{new}', 'g')"
    return c


def _list_sql(scorer: str, name: str) -> str:
    return f"""{name} AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s, id) AS position FROM (SELECT query_id, rowid AS id, min(distance) AS s
  FROM search_hits WHERE scorer = '{scorer}' AND distance IS NOT NULL AND NOT isnan(distance) GROUP BY query_id, rowid))"""


_FUSED = f"""{_list_sql("vector", "v")}, {_list_sql("fts", "f")},
both_lists AS (SELECT query_id, id, 1.0 / (60 + position) AS s, 0 AS l, position FROM v UNION ALL SELECT query_id, id, 0.25 / (60 + position), 1, position FROM f),
sums AS (SELECT query_id, id, round(sum(s), 12) AS rrf, min(l * 1000000 + position) AS fst FROM both_lists GROUP BY query_id, id),
fused AS (SELECT query_id, id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, fst) AS position FROM sums)"""


def _bm25_sql(docs: str, queries: str, k: int, name: str = "bm") -> str:
    """CTEs up to ``name`` (query_id, id, score, position); docs and queries are (id, body) and (query_id, query)."""
    return rf"""
toks AS (SELECT id, regexp_extract_all(lower(coalesce(body, '')), '[\p{{L}}\p{{N}}]+') AS t FROM ({docs})),
dl AS (SELECT id, len(t) AS n FROM toks),
st AS (SELECT count(*)::DOUBLE AS docs, avg(n) AS avgdl FROM dl),
grams AS (SELECT id, unnest(t) AS k FROM toks UNION ALL SELECT id, unnest(list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1])) FROM toks),
raw_terms AS (SELECT query_id, unnest(regexp_extract_all(query, '[A-Za-z0-9_\-]+')) AS term FROM ({queries})),
terms AS (SELECT query_id, array_to_string(regexp_extract_all(lower(term), '[a-z0-9]+'), ' ') AS k FROM raw_terms),
tf AS (SELECT k, id, count(*) AS tf FROM grams WHERE k IN (SELECT k FROM terms WHERE k <> '') GROUP BY ALL),
df AS (SELECT k, count(*) AS df FROM tf GROUP BY k),
idf AS (SELECT k, CASE WHEN ln((docs - df + 0.5) / (df + 0.5)) > 0 THEN ln((docs - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS w FROM df, st),
sc AS (SELECT query_id, tf.id, round(-sum(w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avgdl))), 9) AS score
  FROM terms JOIN tf USING (k) JOIN idf USING (k) JOIN dl ON dl.id = tf.id, st GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS position FROM sc QUALIFY position <= {k})"""


_VEC = """vec AS (SELECT rowid, min(embedding) AS embedding FROM chunks_vec
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 GROUP BY rowid),
store AS (SELECT cur.*, vec.embedding FROM cur LEFT JOIN vec USING (rowid)),
qs AS (SELECT rowid AS query_id, title AS query, embedding FROM store WHERE rowid % 20 = 0 AND embedding IS NOT NULL AND title IS NOT NULL),
dist AS (SELECT query_id, id, round(list_distance(qs.embedding::DOUBLE[], store.embedding::DOUBLE[]), 9) AS distance FROM qs, store WHERE store.embedding IS NOT NULL)"""

_EVAL = f"""{_list_sql("rerank", "r")}, {_list_sql("vector", "v")},
keys AS (SELECT rowid AS id, source_type || ':' || source_key AS key, source_type FROM chunks),
w AS (SELECT query_id, key, source_type FROM r JOIN keys USING (id) QUALIFY r.position > max(r.position) OVER (PARTITION BY query_id) - 2),
q AS (SELECT query_id, count(DISTINCT key) AS n_keys, min(source_type) AS source_type FROM w GROUP BY query_id),
hit AS (SELECT query_id, key, min(position) AS p FROM v JOIN keys USING (id) WHERE position <= 10 AND (query_id, key) IN (SELECT query_id, key FROM w) GROUP BY ALL),
agg AS (SELECT query_id, min(p) AS fst, sum(CASE WHEN p <= 5 THEN 1 / log2(p + 1.0) ELSE 0 END) AS dcg FROM hit GROUP BY query_id),
scores AS (SELECT q.query_id, source_type, CASE WHEN fst <= 5 THEN 1.0 ELSE 0.0 END AS recall, coalesce(1.0 / fst, 0) AS mrr,
  coalesce(dcg / list_sum(list_transform(range(1, least(n_keys, 5) + 1), lambda i: 1 / log2(i + 1.0))), 0) AS ndcg FROM q LEFT JOIN agg USING (query_id))"""

_RATERS = """rt AS (SELECT max(distance) FILTER (WHERE scorer = 'rerank') > 0 AS human_faithful,
  coalesce(max(distance) FILTER (WHERE scorer = 'vector') < 0.8, false) AS judged_faithful, max(distance) FILTER (WHERE scorer = 'fts') > -3 AS adversarial
  FROM search_hits WHERE distance IS NOT NULL AND NOT isnan(distance) GROUP BY query_id, rowid)"""


def _expand_sql(include: tuple[str, ...], limit: int, seeds: str = "cur") -> str:
    parts = {
        "siblings": "SELECT s.rowid AS r, s.id AS seed_id, c.id, 0 AS step, 0 AS n, '' AS ref, c.chunk_index FROM seed s JOIN cur c USING (source_type, source_key) WHERE c.id <> s.id",
        "references": r"""SELECT r, seed_id, id, 1 AS step, 0 AS n, key AS ref, chunk_index FROM (
  SELECT s.rowid AS r, s.id AS seed_id, s.key, c.id, c.chunk_index FROM
    (SELECT rowid, id, source_type, source_key, unnest(list_distinct(regexp_extract_all(substr(content, 1, 20000), '\bTKT-\d+\b'))) AS key FROM seed) s
    JOIN cur c ON c.source_type = 'tickets' AND c.source_key = s.key
  WHERE s.key <> s.source_key AND c.id <> s.id """
        + ("AND NOT (c.source_type = s.source_type AND c.source_key = s.source_key)" if "siblings" in include else "")
        + " QUALIFY row_number() OVER (PARTITION BY seed_id, key ORDER BY chunk_index, c.id) = 1)",
        "parent": "SELECT s.rowid AS r, s.id AS seed_id, c.id, 2 AS step, 0 AS n, '' AS ref, c.chunk_index FROM seed s JOIN cur c ON c.source_type = s.source_type AND c.source_key = s.extra['parent'] WHERE c.id <> s.id",
    }
    every = " UNION ALL ".join(parts[i] for i in include)
    return f"""WITH {_CUR}, seed AS (SELECT * FROM {seeds} WHERE rowid % 20 = 0), every AS ({every}),
once AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY seed_id, id ORDER BY step, n, ref, chunk_index) = 1)
SELECT seed_id, row_number() OVER (PARTITION BY seed_id ORDER BY step, n, ref, chunk_index, id)::INT AS position, id, ['siblings', 'references', 'parent'][step + 1] AS step
FROM once QUALIFY position <= {limit}"""


_BLANK = r"[\s\x0b\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_TAIL = (
    r"(?:(?:[Tt]|,? |, ?)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: ?([AaPp])\.?[Mm]\.?)?(?: ?([+-]\d{2}(?::?\d{2})?(?::\d{2})?))?(?: ?\(?([A-Za-z]{1,5})\)?)?)?"
)
_SHAPES = {
    "ymd": (r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _TAIL, "y m d"),
    "packed": (r"(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)?()(?: ?([+-]\d{2}(?::?\d{2})?(?::\d{2})?))?(?: ?\(?([A-Za-z]{1,5})\)?)?", "y m d"),
    "num": (r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})" + _TAIL, "a b y"),
    "dmon": (r"(?:[A-Za-z]{2,9}\.?,? )?(\d{1,2})(?:st|nd|rd|th)?[ -]([A-Za-z]{3,9})\.?,?[ -](\d{4})" + _TAIL, "d mon y"),
    "mond": (r"(?:[A-Za-z]{2,9}\.?,? )?([A-Za-z]{3,9})\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})" + _TAIL, "mon d y"),
}


def _times_sql() -> str:
    """The values that denote one instant, by shape, offset, zone and the source's settings."""
    read = []
    for kind, (pattern, names) in _SHAPES.items():
        fields = ", ".join(f"'{n}'" for n in (*names.split(), "hh", "mm", "ss", "f", "ap", "off", "ab"))
        got = f"regexp_extract(s, '^{pattern}$', [{fields}])"
        part = lambda n: f"x.{n}" if n in names.split() else "NULL"  # noqa: B023, E731
        date = {
            "num": "x.y AS y, CASE date_order WHEN 'dmy' THEN x.b ELSE x.a END AS mo, CASE date_order WHEN 'dmy' THEN x.a ELSE x.b END AS d",
            "dmon": "x.y AS y, x.mon AS mo, x.d AS d", "mond": "x.y AS y, x.mon AS mo, x.d AS d",
        }.get(kind, f"{part('y')} AS y, {part('m')} AS mo, {part('d')} AS d")
        read.append(f"SELECT rowid, stamp_field, tz, zone, '{kind}' AS kind, {date}, x.hh AS h, x.mm AS mi, x.ss AS se, x.f AS f, x.ap AS ap, x.off AS off, x.ab AS ab FROM (SELECT *, {got} AS x FROM z WHERE regexp_matches(s, '^{pattern}$'))")
    months = ", ".join(f"'{m}': {n}" for m, n in timestamps.MONTHS.items())
    names = ", ".join(f"'{a}': {m}" for a, m in timestamps.ABBREVIATIONS.items())
    local = "timezone(use, make_timestamptz({}))"
    return rf"""
WITH t AS (SELECT rowid, source_type, stamp_field, trim(regexp_replace(replace(v, '−', '-'), '{_BLANK}', ' ', 'g')) AS s FROM (
  SELECT rowid, source_type, unnest(['created_at', 'updated_at']) AS stamp_field, unnest([created_at, updated_at]) AS v FROM chunks)),
z AS (SELECT rowid, stamp_field, tz, date_order, coalesce(nullif(regexp_extract(s, ' ?\[?([A-Za-z]+/[A-Za-z0-9_+/-]+)\]?$', 1), ''), nullif(regexp_extract(s, '\[(UTC|GMT)\]$', 1), '')) AS zone,
  regexp_replace(s, ' ?\[?[A-Za-z]+/[A-Za-z0-9_+/-]+\]?$| ?\[(UTC|GMT)\]$', '') AS s
  FROM t LEFT JOIN sources USING (source_type) WHERE s <> ''),
unix AS (SELECT rowid, stamp_field, s::BIGINT * CASE WHEN length(s) <= 11 THEN 1000000 WHEN length(s) <= 14 THEN 1000 ELSE 1 END AS epoch_us FROM z WHERE regexp_matches(s, '^\d{{1,17}}$')),
r AS ({" UNION ALL ".join(read)}),
n AS (SELECT *, CASE WHEN kind IN ('dmon', 'mond') THEN map {{{months}}}[lower(mo)] ELSE try_cast(mo AS INT) END AS month,
  CASE WHEN ap <> '' THEN CASE WHEN h::INT BETWEEN 1 AND 12 THEN h::INT % 12 + 12 * (lower(ap) = 'p')::INT END ELSE coalesce(try_cast(h AS INT), 0) END AS hour FROM r),
u AS (SELECT *, try_cast(printf('%04d-%02d-%02d %02d:%02d:%02d', y::INT, month::INT, d::INT, hour::INT, coalesce(try_cast(mi AS INT), 0), coalesce(try_cast(se AS INT), 0)) AS TIMESTAMP) AS ts,
  coalesce(try_cast(rpad(substr(f, 1, 6), 6, '0') AS INT), 0) AS micro, rpad(replace(substr(off, 2), ':', ''), 6, '0') AS o FROM n WHERE month IS NOT NULL AND hour IS NOT NULL),
w AS (SELECT *, epoch_us(ts) AS us, coalesce(zone, tz) AS use,
  CASE WHEN off <> '' THEN (substr(o, 1, 2)::BIGINT * 3600 + substr(o, 3, 2)::BIGINT * 60 + substr(o, 5, 2)::BIGINT) * CASE off[1] WHEN '-' THEN -1 ELSE 1 END
    WHEN ab <> '' THEN map {{{names}}}[upper(ab)] * 60 END AS fixed FROM u WHERE ts IS NOT NULL AND (coalesce(ab, '') = '' OR map {{{names}}}[upper(ab)] IS NOT NULL)),
c AS (SELECT rowid, stamp_field, micro, h, us, use, unnest([epoch_us(timezone(use, ts)), us - epoch_us(timezone(use, make_timestamptz(us - 86400000000))) + us - 86400000000, us - epoch_us(timezone(use, make_timestamptz(us + 86400000000))) + us + 86400000000]) AS e
  FROM w WHERE fixed IS NULL AND use IS NOT NULL),
fits AS (SELECT rowid, stamp_field, micro, h, e FROM c WHERE epoch_us({local.format("e")}) = us),
whole AS (SELECT rowid, stamp_field, min(e) + any_value(micro) AS epoch_us FROM fits GROUP BY ALL HAVING count(DISTINCT e) = 1 OR any_value(coalesce(h, '')) = ''),
gap AS (SELECT rowid, stamp_field, max(e) AS epoch_us FROM c WHERE coalesce(h, '') = '' AND (rowid, stamp_field) NOT IN (SELECT (rowid, stamp_field) FROM fits) GROUP BY ALL)
SELECT DISTINCT * FROM (SELECT rowid, stamp_field, us - fixed * 1000000 + micro AS epoch_us FROM w WHERE fixed IS NOT NULL UNION ALL SELECT * FROM whole UNION ALL SELECT * FROM gap UNION ALL SELECT * FROM unix)"""


SQL = {
    "p2_found": _times_sql(),
    "p1_found": rf"""
WITH dig AS (SELECT *, coalesce({_DIGEST}, sha256(coalesce(content, ''))) AS hash FROM chunks WHERE id IS NOT NULL),
latest AS (SELECT * FROM dig QUALIFY row_number() OVER (PARTITION BY id ORDER BY load_seq DESC, rowid DESC) = 1),
done AS (
  SELECT id, {_DIGEST} AS hash FROM chunk_commits WHERE id IS NOT NULL AND run_id IN (SELECT run_id FROM ingest_runs WHERE status = 'ok')
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY run_id DESC) = 1),
docs AS (
  SELECT source_type, source_key, substr(sha256(string_agg(coalesce(content, ''), chr(10) || chr(10) ORDER BY chunk_index, id)), 1, 32) AS hash
  FROM latest GROUP BY ALL),
made AS (
  SELECT source_type, source_key, nullif(lower(trim(doc_hash)), '') AS hash FROM summaries
  QUALIFY row_number() OVER (PARTITION BY source_type, source_key ORDER BY generated_at DESC, lower(trim(doc_hash)) DESC) = 1)
SELECT 'chunk' AS target, id AS item_id FROM latest l
WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.id = l.id AND d.hash = l.hash)
UNION ALL
SELECT 'summary', m.source_type || ':' || m.source_key FROM made m JOIN docs USING (source_type, source_key)
WHERE m.hash IS DISTINCT FROM docs.hash""",
    "scrub_chunks": f"SELECT doc_id, sha256({_scrub_sql('text')}) AS redacted_hash FROM documents",
    "secrets_found": "WITH t AS (SELECT rowid, concat_ws(' ', content, 'AKIA' || upper(substr(h, 1, 16)), 'ghp_' || h, 'token = ' || h) AS content FROM (SELECT *, sha256(coalesce(content, '')) AS h FROM chunks))\n"
    "SELECT rowid, secret_kind, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT rowid, '{n}' AS secret_kind, unnest(regexp_extract_all(content, '{p.replace(chr(39), chr(39) * 2)}')) AS m FROM t" for n, _, p in text.SECRETS)
    + ") GROUP BY ALL",
    "fingerprint_dedupe": rf"""
WITH f AS (SELECT doc_id, coalesce(source, '') AS source, substr(sha256(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(coalesce(text, ''), '{text.URL}', '', 'g'), '{text.DATE}', '', 'g')),
  '[\s\x0b\x85\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'), '^ | $', '', 'g')), 1, 32) AS fingerprint FROM documents)
SELECT doc_id, fingerprint FROM f QUALIFY row_number() OVER (PARTITION BY source, fingerprint ORDER BY doc_id) = 1""",
    "token_estimate": "SELECT rowid, greatest(1, length(content) // 4)::INT AS tokens, source_type || ':' || source_key || ':' || chunk_kind || ':' || chunk_index AS made_id FROM chunks",
    "source_stats": f"WITH {_CUR} SELECT source_type, count(*) AS n FROM cur GROUP BY ROLLUP (source_type)",
    "distinct_keys": "SELECT DISTINCT source_key FROM chunks WHERE source_type = 'tickets'",
    "upsert_changed": f"""WITH {_CUR}, {_FIRST}
SELECT fst.source_type, CASE WHEN sha256(coalesce(fst.content, '')) = sha256(coalesce(n.content, '')) THEN 'skipped' ELSE 'updated' END AS action, count(*) AS n
FROM fst JOIN (SELECT * FROM chunks WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY load_seq DESC, sha256(coalesce(content, '')) DESC) = 1) n USING (id) GROUP BY ALL""",
    "changed_rows": f"""WITH {_CUR}, {_FIRST} SELECT cur.id, sha256(coalesce(cur.content, '')) AS content_hash FROM cur JOIN fst USING (id)
WHERE sha256(coalesce(cur.content, '')) <> sha256(coalesce(fst.content, ''))""",
    "orphans": """SELECT DISTINCT id, split_part(id, ':', 1) AS source_type FROM chunk_commits
WHERE id NOT IN (SELECT id FROM chunks WHERE id IS NOT NULL) AND split_part(id, ':', 1) IN (SELECT source_type FROM chunks)""",
    "ingest_report": f"""WITH {_CUR}, {_FIRST}
SELECT source_type, count(*) FILTER (WHERE oh IS NULL) AS inserted, count(*) FILTER (WHERE oh <> nh) AS updated, count(*) FILTER (WHERE oh = nh) AS skipped, count(*) FILTER (WHERE nh IS NULL) AS orphans
FROM (SELECT coalesce(cur.source_type, fst.source_type) AS source_type, sha256(coalesce(fst.content, '')) AS oh, sha256(coalesce(cur.content, '')) AS nh FROM fst FULL JOIN cur USING (id)) GROUP BY source_type""",
    "knn_l2": """SELECT e.vec_id AS id, round(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS distance,
  row_number() OVER (ORDER BY round(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9), e.vec_id)::INT AS position
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q QUALIFY position <= 10""",
    "knn_batch": """SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS distance,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9), e.vec_id)::INT AS position
FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id QUALIFY position <= 10""",
    "bm25_batch": f"WITH {_bm25_sql('SELECT doc_id AS id, text AS body FROM documents', 'SELECT doc_id AS query_id, title AS query FROM documents WHERE doc_id % 20 = 0 AND title IS NOT NULL', 10)} SELECT query_id, id AS doc_id, round(score, 6) AS score FROM bm",
    "auto_fts_weight": r"""SELECT doc_id, CASE WHEN regexp_matches(text, '`[^`]+`|".+?"') OR regexp_matches(substr(text, 1, 20000), '\bTKT-\d+\b') THEN 1.0 ELSE 0.25 END::DOUBLE AS weight FROM documents WHERE text IS NOT NULL""",
    "rrf_fuse": f"WITH {_FUSED} SELECT query_id, id, round(rrf, 9)::DOUBLE AS rrf, position::INT AS position FROM fused",
    "diversity_topk": f"""WITH {_FUSED}, j AS (SELECT fused.*, source_type, source_key FROM fused JOIN chunks ON chunks.rowid = fused.id),
a AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY query_id, source_type, source_key ORDER BY position) = 1),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query_id, source_type ORDER BY position) <= 3)
SELECT query_id, id, source_type, row_number() OVER (PARTITION BY query_id ORDER BY b.position)::INT AS position FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY b.position) <= 10""",
    "hybrid_search": rf"""WITH {_CUR}, {_VEC}, knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS position FROM dist QUALIFY position <= 40),
{_bm25_sql("SELECT id, content AS body FROM store", "SELECT query_id, query FROM qs", 40)},
wt AS (SELECT query_id, CASE WHEN regexp_matches(query, '`[^`]+`|".+?"') OR regexp_matches(query, '\bTKT-\d+\b') THEN 1.0 ELSE 0.25 END AS w FROM qs),
u AS (SELECT query_id, id, 1.0 / (60 + position) AS s, 0 AS l, position FROM knn UNION ALL SELECT query_id, id, w / (60 + position), 1, position FROM bm JOIN wt USING (query_id)),
sums AS (SELECT query_id, id, round(sum(s), 12) AS rrf, min(l * 1000000 + position) AS fst FROM u GROUP BY query_id, id),
fu AS (SELECT query_id, id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, fst) AS position FROM sums),
j AS (SELECT fu.*, source_type, source_key FROM fu JOIN cur USING (id)),
a AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY query_id, source_type, source_key ORDER BY position) = 1),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query_id, source_type ORDER BY position) <= 3)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY b.position)::INT AS position, id, round(rrf, 9)::DOUBLE AS rrf FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY b.position) <= 5""",
    "rerank_lexical": f"""WITH {_CUR}, {_VEC}, knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS position FROM dist QUALIFY position <= 30),
wd AS (SELECT k.query_id, k.id, k.position, list_distinct(regexp_extract_all(lower(q.query), '[a-z0-9]+')) AS qw, list_distinct(regexp_extract_all(lower(substr(c.content, 1, 4000)), '[a-z0-9]+')) AS cw
  FROM knn k JOIN qs q USING (query_id) JOIN cur c ON c.id = k.id),
sc AS (SELECT *, coalesce(len(list_intersect(qw, cw))::DOUBLE / nullif(len(qw), 0), 0.0) AS score FROM wd)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sc.position)::INT AS position, round(score, 6) AS rerank_score FROM sc""",
    "get_doc": f"WITH {_CUR} SELECT id, chunk_index, sha256(content) AS h FROM cur WHERE source_type = 'journal' AND source_key = 'worklog/rolling'",
    "reconstruct_doc": f"""WITH {_CUR} SELECT source_type, source_key, substr(sha256(string_agg(coalesce(content, ''), chr(10) || chr(10) ORDER BY chunk_index, id)), 1, 32) AS doc_hash FROM cur GROUP BY ALL""",
    "timeline": f"""WITH {_list_sql("vector", "v")}, j AS (SELECT v.*, coalesce(nullif(updated_at, ''), nullif(created_at, ''), '') AS "when" FROM v JOIN chunks ON chunks.rowid = v.id)
SELECT query_id, id, "when", row_number() OVER (PARTITION BY query_id ORDER BY "when", j.position)::INT AS position FROM j WHERE "when" >= '2019' AND "when" <= '2026'
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY "when", j.position) <= 10""",
    "recent_activity": f"""WITH {_CUR}, pool AS (SELECT * FROM cur WHERE updated_at >= '2024-06-01' ORDER BY updated_at DESC, id LIMIT 100),
a AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY source_type, source_key ORDER BY updated_at DESC, id) = 1)
SELECT id, updated_at FROM a ORDER BY updated_at DESC, id LIMIT 20""",
    "expand_context": _expand_sql(("siblings", "references", "parent"), 10),
    "expand_references": _expand_sql(("references",), 10, """(SELECT cur.* REPLACE (concat_ws(' see ', content, named) AS content) FROM cur LEFT JOIN
  (SELECT chunk_index, max(source_key) AS named FROM cur WHERE source_type = 'tickets' GROUP BY chunk_index) USING (chunk_index))"""),
    "expand_siblings": _expand_sql(("siblings",), 5),
    "eval_queries": f"WITH {_EVAL} SELECT query_id, recall::DOUBLE AS recall, round(mrr, 9)::DOUBLE AS mrr, round(ndcg, 9)::DOUBLE AS ndcg FROM scores",
    "eval_breakdown": f"WITH {_EVAL} SELECT source_type, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM scores GROUP BY source_type",
    "eval_gate": f"""WITH {_EVAL}, s AS (SELECT avg(recall) AS r, avg(ndcg) AS n FROM scores)
SELECT 'recall' AS metric, round(r, 6) AS value, 0.95::DOUBLE AS floor, r >= 0.95 AS passed FROM s UNION ALL SELECT 'ndcg', round(n, 6), 0.85::DOUBLE, n >= 0.85 FROM s""",
    "eval_compare": f"""WITH {_EVAL}, {_list_sql("fts", "f")},
hit2 AS (SELECT query_id, key, min(position) AS p FROM f JOIN keys USING (id) WHERE position <= 10 AND (query_id, key) IN (SELECT query_id, key FROM w) GROUP BY ALL),
agg2 AS (SELECT query_id, min(p) AS fst, sum(CASE WHEN p <= 5 THEN 1 / log2(p + 1.0) ELSE 0 END) AS dcg FROM hit2 GROUP BY query_id),
scores2 AS (SELECT q.query_id, CASE WHEN fst <= 5 THEN 1.0 ELSE 0.0 END AS recall, coalesce(1.0 / fst, 0) AS mrr,
  coalesce(dcg / list_sum(list_transform(range(1, least(n_keys, 5) + 1), lambda i: 1 / log2(i + 1.0))), 0) AS ndcg FROM q LEFT JOIN agg2 USING (query_id))
SELECT 'vector' AS config, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM scores
UNION ALL SELECT 'fts', count(*), round(avg(recall), 6), round(avg(mrr), 6), round(avg(ndcg), 6) FROM scores2""",
    "seeded_shuffle": """SELECT query_id, rowid, row_number() OVER (PARTITION BY query_id ORDER BY sha256(query_id::VARCHAR || chr(31) || rowid::VARCHAR))::INT AS place
FROM (SELECT DISTINCT query_id, rowid FROM search_hits)""",
    "rolling_budget": """SELECT event_id, sum(length(props)) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 60 PRECEDING AND CURRENT ROW)::BIGINT AS spent FROM events""",
    "throughput": "SELECT event_type, round(count(value) / sum(value), 6) AS per_second FROM events WHERE value > 0 GROUP BY event_type",
    "format_results": f"""WITH {_list_sql("vector", "v")}, h AS (SELECT query_id, rowid AS id, min(distance) AS distance FROM search_hits WHERE scorer = 'vector' AND NOT isnan(distance) GROUP BY ALL)
SELECT query_id, position::INT AS position, printf('[%d] %s:%s d=%.4f', position, source_type, source_key, distance) AS line FROM v JOIN h USING (query_id, id) JOIN chunks ON chunks.rowid = v.id WHERE position <= 5""",
    "judge_report": f"""WITH {_RATERS}, x AS (SELECT human_faithful::INT AS a, judged_faithful::INT AS b, coalesce(adversarial, false) AS adv FROM rt WHERE human_faithful IS NOT NULL),
s AS (SELECT count(*) AS n, avg((a = b)::INT) AS po, avg(a) AS pa, avg(b) AS pb, sum(adv::INT)::BIGINT AS t, sum((adv AND b = 0)::INT)::BIGINT AS c FROM x)
SELECT n, round(po, 9) AS agreement, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 9) AS kappa, t AS adversarial_total, c AS adversarial_caught FROM s""",
    "judge_pass_rates": f"""WITH {_RATERS} SELECT axis, count(*) AS n, round(avg(coalesce(ok, false)::INT), 9) AS pass_rate FROM (
SELECT 'human_faithful' AS axis, human_faithful AS ok FROM rt UNION ALL SELECT 'judged_faithful', judged_faithful FROM rt UNION ALL SELECT 'adversarial', adversarial FROM rt) GROUP BY axis""",
    "latency_summary": """SELECT event_type, count(value) AS n, round(avg(value) * 1000, 2) AS mean, round(quantile_cont(value, 0.5) * 1000, 2) AS p50, round(quantile_cont(value, 0.95) * 1000, 2) AS p95,
  round(quantile_cont(value, 0.99) * 1000, 2) AS p99, round(min(value) * 1000, 2) AS min, round(max(value) * 1000, 2) AS max FROM events GROUP BY event_type""",
    "list_sources_stale": """SELECT coalesce(c.source_type, s.source_type) AS source_type, coalesce(n, 0) AS chunks, CASE WHEN s.source_type IS NULL THEN 'stale' ELSE 'configured' END AS state
FROM (SELECT CASE WHEN extra IS NULL THEN 'unknown' ELSE source_type END AS source_type, count(*) AS n FROM chunks GROUP BY 1) c FULL JOIN (SELECT DISTINCT source_type FROM sources) s ON s.source_type = c.source_type""",
    "bm25_index": "SELECT 0::BIGINT AS wrong, true AS some",
    "hash_embed": """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
h AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 16))::UBIGINT AS h FROM w),
s AS (SELECT doc_id, (h % 256)::INT AS place, sum(CASE WHEN h & 2 > 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM h GROUP BY ALL HAVING v <> 0)
SELECT doc_id, place, round((v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE, 6) AS value FROM s""",
    "ingest_twice": f"""WITH {_CUR}, {_FIRST},
old AS (SELECT id, content FROM fst UNION SELECT id, NULL FROM chunk_commits WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM fst) AND split_part(id, ':', 1) IN (SELECT source_type FROM chunks)),
o AS (SELECT id, sha256(coalesce(content, '')) AS h FROM old), n AS (SELECT id, source_type, sha256(coalesce(content, '')) AS h FROM cur)
SELECT n.source_type || ':' || id || ':section:0' AS id, sha256(id || chr(10) || chr(10) || sha256(id) || ' ' || CASE WHEN n.h[1] = '0' THEN o.h ELSE n.h END) AS content_hash
FROM n LEFT JOIN o USING (id) WHERE n.h[1] <> '0' OR o.h IS NOT NULL""",
    "incremental_refresh": f"""WITH {_CUR}, {_FIRST} SELECT 'back' AS state, id, substr(sha256(coalesce(content, '')), 1, 16) AS short FROM fst
UNION ALL SELECT 'ahead', id, substr(sha256(coalesce(content, '')), 1, 16) FROM cur""",
    "metadata_round_trip": "SELECT rowid, source_key, chunk_index, format('{:,}', token_count::BIGINT * 1000) AS shown FROM chunks",
    "summary_pending": f"""WITH {_CUR}, docs AS (SELECT source_type, source_key, substr(sha256(string_agg(coalesce(content, ''), chr(10) || chr(10) ORDER BY chunk_index, id)), 1, 32) AS doc_hash FROM cur GROUP BY ALL)
SELECT * FROM docs d WHERE NOT EXISTS (SELECT 1 FROM summaries s WHERE s.source_type = d.source_type AND s.source_key = d.source_key AND s.doc_hash = d.doc_hash)""",
    "summary_cost": f"""WITH {_CUR}, docs AS (SELECT source_type, source_key, string_agg(coalesce(content, ''), chr(10) || chr(10) ORDER BY chunk_index, id) AS body FROM cur GROUP BY ALL),
todo AS (SELECT * FROM docs d WHERE NOT EXISTS (SELECT 1 FROM summaries s WHERE s.source_type = d.source_type AND s.source_key = d.source_key AND s.doc_hash = substr(sha256(d.body), 1, 32)))
SELECT count(*) AS documents, sum(length(body) // 4)::BIGINT AS input_tokens, round((sum(length(body) // 4) + count(*) * 150 * 5.0) / 1e6, 6)::DOUBLE AS estimate FROM todo""",
}
