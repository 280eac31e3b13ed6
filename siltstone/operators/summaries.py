"""Incremental summaries: which documents need one, what that costs, and making them with a pluggable client."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators.incremental import hash_documents
from siltstone.operators.navigate import documents

OUTPUT_TOKENS, MAX_CHARS = 150, 80_000
TOKENS = ("input_tokens", "cached_tokens", "output_tokens")


def pending(chunks: DataFrame, summaries: DataFrame, limit: int | None = None) -> DataFrame:
    """source_type, source_key, doc_hash, chars of documents without a summary of their present text.

    ``limit``: of each source only the first documents by key are looked at, whether they have a summary or not.
    """
    keys = ["source_type", "source_key"]
    if limit is not None:
        first = Window.partitionBy("source_type").orderBy("source_key")
        some = chunks.select(*keys).distinct().withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= limit)
        chunks = chunks.join(some.select(*keys), keys, "left_semi")
    hashes = hash_documents(chunks).withColumnRenamed("hash", "doc_hash")
    todo = hashes.join(summaries.select(*keys, "doc_hash"), [*keys, "doc_hash"], "left_anti")
    size = chunks.groupBy(*keys).agg((F.sum(F.length(F.coalesce("content", F.lit("")))) + 2 * (F.count(F.lit(1)) - 1)).alias("chars"))
    return todo.join(size, keys)


def bodies(todo: DataFrame, chunks: DataFrame, most: int = MAX_CHARS) -> DataFrame:
    """todo with body: the first ``most`` characters of each text, which is all that a summary is made of, and title.

    Only the chunks that reach into them are collected, so a body is bounded whatever the document's size.
    """
    keys = ["source_type", "source_key"]
    rows = chunks.select(*keys, "chunk_index", "id", "content").join(todo.select(*keys), keys, "left_semi")
    before = Window.partitionBy(*keys).orderBy("chunk_index", "id").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.withColumn("_before", F.coalesce(F.sum(F.length(F.coalesce("content", F.lit(""))) + 2).over(before), F.lit(0))).filter(F.col("_before") < most)
    out = todo.join(documents(first).withColumn("body", F.substring("body", 1, most)), keys)
    if "title" in chunks.columns:
        titles = chunks.groupBy(*keys).agg(F.min_by("title", F.struct("chunk_index", "id")).alias("title"))
        out = out.join(titles, keys, "left")
    return out


def cost(todo: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """documents, input_tokens, estimate: prices are per million tokens."""
    n, t = F.count(F.lit(1)), F.coalesce(F.sum(F.floor(F.col("chars") / 4)), F.lit(0))
    return todo.agg(n.alias("documents"), t.alias("input_tokens"), ((t * price_in + n * OUTPUT_TOKENS * price_out) / 1e6).alias("estimate"))


def retry(call: Callable[[], str], tries: int = 5, first: float = 2.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> str:
    for n in range(tries):
        try:
            return call()
        except Exception:
            if n == tries - 1:
                raise
            sleep(min(most, first * 2**n))
    raise AssertionError


GUIDANCE = "Say what the document of the source {source_type} covers, what it decides or states as fact, and which names, references and dates it holds."


def summarise(todo: DataFrame, client: Callable, model: str, tasks: int = 8, generated_at: str | None = None, guidance: dict[str, str] | None = None) -> DataFrame:
    """Rows for the summaries table with input_tokens, cached_tokens and output_tokens; ``todo`` comes from ``bodies``.

    ``client`` runs on the workers.  It maps a text to its summary, or, if it has an attribute ``structured``, a dict
    (source_type, source_key, title, guidance, content) to a dict (summary and, if it knows them, the token counts).
    ``guidance``: what to tell the client about a source; ``GUIDANCE`` for others.
    """
    stamp = F.lit(generated_at) if generated_at else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    structured, told = getattr(client, "structured", False), dict(guidance or {})

    def one(row: dict) -> dict:
        if not structured:
            return {"summary": retry(lambda: client(row["body"]))}
        kind = row["source_type"]
        asked = {"source_type": kind, "source_key": row["source_key"], "title": row.get("title") or row["source_key"], "guidance": told.get(kind, GUIDANCE.format(source_type=kind)), "content": row["body"]}
        return retry(lambda: client(asked))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [one(r) for r in b.to_dict("records")]
            out = b[["source_type", "source_key", "doc_hash"]].copy()
            for c in ("summary", *TOKENS):
                out[c] = pd.Series([g.get(c) for g in got], index=out.index, dtype="string" if c == "summary" else "Int64")
            yield out

    schema = "source_type string, source_key string, doc_hash string, summary string, " + ", ".join(f"{c} bigint" for c in TOKENS)
    made = todo.repartition(tasks).mapInPandas(run, schema)
    return made.select("source_type", "source_key", "summary", "doc_hash", F.lit(model).alias("model"), stamp.alias("generated_at"), text.token_estimate(F.col("summary")).alias("token_count"), *TOKENS)
