"""Queries of the training-data operators over the stored tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe, leximin, lookalike, markup, nearcopies, neighbours, packing, pii
from siltstone.runtime import cut, table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return leximin.rank(table(spark, d, "search_hits"), table(spark, d, "scorers"), limit=5).select("query_id", "rowid")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = markup.find(table(spark, d, "chunks"), "rowid", "content", "chunks.content", title="title")
    docs = markup.find(table(spark, d, "markdown_docs"), "path", "body", "markdown_docs.body")
    return chunks.unionByName(docs)


def p4_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """The clean text of every row."""
    chunks = markup.cleaned(table(spark, d, "chunks"), "rowid", "content", "chunks.content", title="title")
    return chunks.unionByName(markup.cleaned(table(spark, d, "markdown_docs"), "path", "body", "markdown_docs.body"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.pairs(table(spark, d, "chunks_vec"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(table(spark, d, "chunks"), table(spark, d, "people")).select("rowid", "pii_kind", "found_text").distinct()


def p6_replaced(spark: SparkSession, d: str) -> DataFrame:
    """With a fixed secret, so that runs are comparable; a deployment passes its own."""
    return pii.replace(table(spark, d, "chunks"), table(spark, d, "people"), b"published with the queries")


def p6_checked(spark: SparkSession, d: str) -> DataFrame:
    """What must not be in the texts with surrogates: rows lost, nulls changed, texts without a mention changed, texts
    that still have a mention of theirs."""
    chunks, people = table(spark, d, "chunks").select("rowid", "content"), table(spark, d, "people")
    said = pii.find(chunks, people).groupBy("rowid").agg(F.collect_set("found_text").alias("said"))
    new = p6_replaced(spark, d).select("rowid", F.col("content").alias("new"))
    rows = chunks.join(new, "rowid", "left").join(said, "rowid", "left")
    kept = F.exists("said", lambda x: F.col("new").contains(x))
    return rows.agg(
        F.count_if(F.col("content").isNull() != F.col("new").isNull()).alias("nulls_changed"), F.count_if(F.col("said").isNull() & ~F.col("content").eqNullSafe(F.col("new"))).alias("plain_changed"),
        F.count_if(F.coalesce(kept, F.lit(False))).alias("still_there"), (F.count("said") > 0).alias("some"),
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return nearcopies.pairs(table(spark, d, "chunks"))


def p7_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row a text: the class of equal texts and the class's links to other texts."""
    return nearcopies.links_per_row(table(spark, d, "chunks"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"))


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(bpe.count(table(spark, d, "documents")), table(spark, d, "pack_limits"))


def p9_waste(spark: SparkSession, d: str) -> DataFrame:
    """Bins of each kind of container against the least number that the tokens need."""
    return packing.waste(p9_packed(spark, d), table(spark, d, "pack_limits"))


def p9_checked(spark: SparkSession, d: str) -> DataFrame:
    """What a packing must not have: overfull bins, texts lost or changed in size, texts split that fit; and whether it
    has at most a hundredth more bins than the tokens need."""
    limits, sizes = table(spark, d, "pack_limits"), bpe.count(table(spark, d, "documents")).filter("tokens > 0")
    packed = cut(p9_packed(spark, d))
    whole = packed.groupBy("container", "doc_id").agg(F.sum("piece_size").alias("in"), F.count(F.lit(1)).alias("pieces"))
    both = whole.join(sizes, "doc_id", "full").join(limits.select("container", "capacity_tokens"), "container", "left")
    wrong = both.groupBy("container").agg(F.count_if(~F.col("in").eqNullSafe(F.col("tokens"))).alias("lost"), F.count_if(F.col("pieces") != F.ceil(F.col("tokens") / F.col("capacity_tokens"))).alias("badly_split"))
    used = packing.waste(packed, limits).select("container", "overfull", (F.col("above") <= 1 + F.col("least") / 100).alias("tight"))
    return wrong.join(used, "container")


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row a text: the class of texts that look alike."""
    return lookalike.look_classes(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.pairs(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p4_found, p4_cleaned, p5_found, p6_found, p6_replaced, p6_checked, p7_found, p7_classes, p8_ids, p9_packed, p9_waste, p9_checked, p10_found, p10_classes)}

SQL = {
    "p5_found": """
WITH v AS (SELECT rowid AS id, min(embedding)::DOUBLE[] AS e FROM chunks_vec WHERE rowid IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY rowid),
n AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.e, b.e), b.id) <= 5)
SELECT DISTINCT least(a, b) AS rowid_a, greatest(a, b) AS rowid_b FROM n""",
    "p6_checked": "SELECT 0::BIGINT AS nulls_changed, 0::BIGINT AS plain_changed, 0::BIGINT AS still_there, true AS some",
    "p7_found": r"""
WITH w AS (SELECT rowid, regexp_extract_all(lower(min(content)), '[\p{L}\p{N}]+') AS w FROM chunks WHERE content IS NOT NULL AND rowid IS NOT NULL GROUP BY rowid),
s AS (SELECT DISTINCT rowid, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
n AS (SELECT rowid, count(*) AS n FROM s GROUP BY rowid),
c AS (SELECT a.rowid AS x, b.rowid AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rowid < b.rowid GROUP BY ALL)
SELECT x AS rowid_a, y AS rowid_b FROM c JOIN n p ON p.rowid = x JOIN n q ON q.rowid = y WHERE 10 * c >= 6 * (p.n + q.n - c)""",
    "p9_checked": "SELECT DISTINCT container, 0::BIGINT AS lost, 0::BIGINT AS badly_split, 0::BIGINT AS overfull, true AS tight FROM pack_limits WHERE capacity_tokens > 0",
    "p3_found": """
WITH once AS (
  SELECT query_id, rowid, h.scorer, max(CASE WHEN isnan(distance) THEN NULL WHEN better = 'high' THEN distance WHEN better IS NOT NULL THEN -distance END) AS v
  FROM search_hits h LEFT JOIN scorers s ON s.scorer = h.scorer
  WHERE query_id IS NOT NULL AND rowid IS NOT NULL GROUP BY ALL),
items AS (SELECT DISTINCT query_id, rowid, count(*) OVER (PARTITION BY query_id) AS items FROM (SELECT DISTINCT query_id, rowid FROM once)),
ranked AS (
  SELECT query_id, rowid, rank() OVER (PARTITION BY query_id, scorer ORDER BY v) - 1 AS worse, count(*) OVER (PARTITION BY query_id, scorer) AS present
  FROM once WHERE v IS NOT NULL),
pct AS (
  SELECT i.query_id, i.rowid, list(CASE WHEN items <= 1 THEN 1.0 WHEN worse = 0 THEN 0.0 ELSE (worse + items - present) / (items - 1.0)::DOUBLE END::DOUBLE)
    FILTER (WHERE worse IS NOT NULL) AS p
  FROM items i LEFT JOIN ranked r ON r.query_id = i.query_id AND r.rowid = i.rowid GROUP BY ALL),
profile AS (
  SELECT query_id, rowid, list_sort(list_concat(coalesce(p, []), list_transform(range((SELECT count(*) FROM scorers) - len(coalesce(p, []))), lambda x: 0.0::DOUBLE))) AS p FROM pct)
SELECT query_id, rowid FROM profile QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY p DESC, rowid) <= 5""",
}
