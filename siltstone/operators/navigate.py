"""Follow-up navigation: whole documents, neighbours, references, timelines, recent changes and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import effective_date, since_date
from siltstone.operators.search import REFERENCE_SCAN, position


def get_chunk(chunks: DataFrame, id: str) -> DataFrame:
    return chunks.filter(F.col("id") == id)


def get_document(chunks: DataFrame, source_type: str, source_key: str) -> DataFrame:
    return chunks.filter((F.col("source_type") == source_type) & (F.col("source_key") == source_key)).orderBy("chunk_index", "id")


def distinct_keys(chunks: DataFrame, source_type: str) -> DataFrame:
    return chunks.filter(F.col("source_type") == source_type).select("source_key").distinct().orderBy("source_key")


def counts(chunks: DataFrame) -> DataFrame:
    """source_type, n; the null source_type is the total."""
    return chunks.rollup("source_type").agg(F.count(F.lit(1)).alias("n"))


def documents(chunks: DataFrame, key: Sequence[str] = ("source_type", "source_key"), order: Sequence[str] = ("chunk_index", "id"), content: str = "content") -> DataFrame:
    """key, body: each document's chunks in order, joined by a blank line.  A body is one value and must fit in one."""
    own = chunks.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(content).alias("_c")))).alias("s"))
    return own.select(*key, F.array_join(F.transform("s", lambda x: F.coalesce(x["_c"], F.lit(""))), "\n\n").alias("body"))


def timeline(found: DataFrame, top_k: int, since: str | None = None, until: str | None = None) -> DataFrame:
    """Ranked hits (query_id, position, updated_at, created_at) in the order of their dates, as texts; undated first."""
    when = F.coalesce(effective_date(F.col("updated_at"), F.col("created_at")), F.lit(""))
    rows = found.withColumn("when", when)
    if since:
        rows = rows.filter(F.col("when") >= since)
    if until:
        rows = rows.filter(F.col("when") <= until)
    return rows.withColumn("position", position([F.col("when"), F.col("position")])).filter(F.col("position") <= top_k)


def recent(chunks: DataFrame, today: Column, days: int = 7, top_k: int = 20, sources: Sequence[str] | None = None) -> DataFrame:
    """The latest changed chunk of each document within ``days``; at most five times top_k chunks are looked at."""
    rows = chunks.filter(F.col("updated_at") >= since_date(today, days))
    if sources:
        rows = rows.filter(F.col("source_type").isin(list(sources)))
    pool = rows.orderBy(F.desc("updated_at"), "id").limit(top_k * 5)
    first = Window.partitionBy("source_type", "source_key").orderBy(F.desc("updated_at"), "id")
    return pool.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n").orderBy(F.desc("updated_at"), "id").limit(top_k)


def expand(chunks: DataFrame, seeds: DataFrame, include: Sequence[str] = ("siblings", "references", "parent"), patterns: Sequence[tuple[str, str]] = (), max_results: int = 10) -> DataFrame:
    """seed_id, position, id, step: chunks that belong with each seed.

    ``seeds``: chunks.  Steps in this order: the document's other chunks; the first chunk of each document that a
    pattern of ``patterns`` (regex, source_type) finds in the seed, own document excluded; the chunks of the
    document in extra['parent'].  A chunk counts in its first step.
    """
    target = chunks.select("id", "source_type", "source_key", "chunk_index")
    seed = seeds.select(F.col("id").alias("seed_id"), F.col("source_type").alias("st"), F.col("source_key").alias("sk"), "content", F.col("extra")["parent"].alias("parent"))
    out = None

    def add(rows: DataFrame, step: int, n: Column, ref: Column) -> None:
        nonlocal out
        part = rows.select("seed_id", "id", F.struct(F.lit(step).alias("step"), n.cast("int").alias("n"), ref.alias("ref"), F.col("chunk_index").cast("int").alias("ix")).alias("o"))
        out = part if out is None else out.unionByName(part)

    none = F.lit("")
    if "siblings" in include:
        rows = seed.join(target, (F.col("st") == F.col("source_type")) & (F.col("sk") == F.col("source_key"))).filter("id <> seed_id")
        add(rows, 0, F.lit(0), none)
    if "references" in include and patterns:

        def found(n: int, pattern: str, kind: str) -> Column:
            keys = F.array_distinct(F.regexp_extract_all(F.substring("content", 1, REFERENCE_SCAN), F.lit("(?U)" + pattern), 0))
            return F.transform(keys, lambda m: F.struct(F.lit(n).alias("n"), F.lit(kind).alias("t"), m.alias("key")))

        refs = seed.select("seed_id", "sk", F.explode(F.concat(*[found(n, p, t) for n, (p, t) in enumerate(patterns)])).alias("r")).filter("r.key <> sk").select("seed_id", F.col("r.n").alias("n"), F.col("r.t").alias("t"), F.col("r.key").alias("key"))
        rows = refs.join(target, (F.col("t") == F.col("source_type")) & (F.col("key") == F.col("source_key")))
        if out is not None:
            rows = rows.join(out.select("seed_id", "id").distinct(), ["seed_id", "id"], "left_anti")
        first = Window.partitionBy("seed_id", "n", "key").orderBy("chunk_index", "id")
        rows = rows.filter("id <> seed_id").withColumn("_n", F.row_number().over(first)).filter("_n = 1")
        add(rows, 1, F.col("n"), F.col("key"))
    if "parent" in include:
        rows = seed.filter("parent is not null").join(target, (F.col("st") == F.col("source_type")) & (F.col("parent") == F.col("source_key"))).filter("id <> seed_id")
        add(rows, 2, F.lit(0), none)
    if out is None:
        return chunks.sparkSession.createDataFrame([], "seed_id string, position int, id string, step string")
    once = out.groupBy("seed_id", "id").agg(F.min("o").alias("o"))
    ranked = once.withColumn("position", position([F.col("o"), F.col("id")], ["seed_id"])).filter(F.col("position") <= max_results)
    step = F.element_at(F.array(F.lit("siblings"), F.lit("references"), F.lit("parent")), F.col("o.step") + 1)
    return ranked.select("seed_id", "position", "id", step.alias("step"))


def stale_sources(chunks: DataFrame, configured: DataFrame) -> DataFrame:
    """source_type, chunks, state: ``configured`` (with chunks or empty) or ``stale`` (chunks of no configured source)."""
    have = chunks.groupBy("source_type").agg(F.count(F.lit(1)).alias("chunks"))
    both = configured.select("source_type", F.lit(True).alias("c")).distinct().join(have, "source_type", "full")
    return both.select("source_type", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.when(F.col("c"), "configured").otherwise("stale").alias("state"))
