"""Ingest: near-copies dropped, bodies split, redacted, hashed, embedded where changed, and merged into the store."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import chunking, text
from siltstone.functions.embedding import Backend, embed
from siltstone.operators.store import Store, changed
from siltstone.runtime import cut

DOCUMENTS = "source_type string, source_key string, title string, url string, author string, created_at string, updated_at string, body string, path string, load_seq bigint"


def first_wins(docs: DataFrame) -> DataFrame:
    """Of documents of one source with the same fingerprint the first in load order; null bodies are empty ones."""
    fp = text.fingerprint(F.coalesce("body", F.lit("")))
    w = Window.partitionBy("source_type", "_fp").orderBy("load_seq")
    return docs.withColumn("_fp", fp).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_fp", "_n")


def chunk(docs: DataFrame) -> DataFrame:
    """A row per piece: the first begins with the title line, the others with ``[title]``; secrets are redacted."""
    rows = docs.select("*", F.posexplode(chunking.pieces(F.col("body"))).alias("chunk_index", "_piece"))
    head = F.when(F.col("chunk_index") == 0, F.col("title")).otherwise(F.concat(F.lit("["), F.col("title"), F.lit("]")))
    rows = rows.withColumn("chunk_kind", F.lit("section")).withColumn("content", text.scrub(F.concat_ws("\n\n", head, "_piece")))
    return rows.select(
        text.chunk_id(F.col("source_type"), F.col("source_key"), F.col("chunk_kind"), F.col("chunk_index")).alias("id"),
        "source_type", "source_key", "chunk_kind", F.col("chunk_index").cast("int").alias("chunk_index"), "content", text.sha256(F.col("content")).alias("content_hash"), "title", "url",
        "author", "created_at", "updated_at", text.token_estimate(F.col("content")).alias("token_count"), F.create_map().cast("map<string,string>").alias("extra"), "load_seq",
    )


def latest(chunks: DataFrame) -> DataFrame:
    """One row per id, the last loaded: two documents may claim one key."""
    w = Window.partitionBy("id").orderBy(F.desc("load_seq"))
    return chunks.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def ingest(store: Store, docs: DataFrame, backend: Backend, whole_source: bool = True, after_embed: Callable[[], None] | None = None, sources: Sequence[str] = ()) -> list[dict]:
    """Bring the store in line with ``docs``; one report per source.

    Only changed chunks are embedded; chunks without a vector (blank or refused ones) are not written and counted as
    neither upserted nor skipped, but a stored chunk of their id stays.  With ``whole_source`` the sources' other
    chunks are deleted: those of ``docs`` and of ``sources``, which may have no document any more.
    """
    unique = first_wins(docs)
    made = cut(latest(chunk(unique)))
    fresh = cut(embed(changed(made, store.chunks()), "content", backend))
    if after_embed:
        after_embed()
    rest = made.join(fresh.select("id"), "id", "left_anti").withColumn("embedding", F.lit(None).cast("array<float>"))
    incoming = fresh.filter("embedding is not null").unionByName(rest)
    every = sorted({r[0] for r in docs.select("source_type").distinct().collect()} | set(sources))  # configured sources
    done = store.upsert(incoming, every if whole_source else (), seen=made.select("id"))
    per = docs.groupBy("source_type").agg(F.count(F.lit(1)).alias("documents"))
    kept = unique.groupBy("source_type").agg(F.count(F.lit(1)).alias("unique"))
    parts = made.groupBy("source_type").agg(F.count(F.lit(1)).alias("chunks"))
    rows = per.join(kept, "source_type").join(parts, "source_type", "left").na.fill(0)
    found = {r["source_type"]: r.asDict() for r in rows.collect()}
    return [{"source_type": s, "documents": 0, "unique": 0, "chunks": 0} | found.get(s, {}) | done for s in every]


def report(before: DataFrame, incoming: DataFrame) -> DataFrame:
    """source_type, inserted, updated, skipped, orphans of an upsert, without doing it."""
    old = before.select("id", F.col("content_hash").alias("oh"), F.col("source_type").alias("ost"))
    both = old.join(incoming.select("id", F.col("content_hash").alias("nh"), F.col("source_type").alias("nst")), "id", "full")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return both.groupBy(F.coalesce("nst", "ost").alias("source_type")).agg(
        n(F.col("oh").isNull()).alias("inserted"),
        n(F.col("oh").isNotNull() & F.col("nh").isNotNull() & (F.col("oh") != F.col("nh"))).alias("updated"),
        n(F.col("oh") == F.col("nh")).alias("skipped"),
        n(F.col("nh").isNull()).alias("orphans"),
    )
