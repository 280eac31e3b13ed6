"""The chunk store: Parquet partitions by source type and bucket of the id, in versions, with an atomic pointer.

The pointer file names the version of every partition.  A write makes new versions of the partitions it changes
beside the old ones and then adds a pointer; readers pin the versions they opened.  A failed write leaves
directories no pointer names.  The last KEEP pointers and what they name stay; older versions are removed.  A full-text
index has a segment for each partition, so that it too is only made anew where something changed.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = (
    "id string, source_type string, source_key string, chunk_kind string, chunk_index int, content string, content_hash string, title string, url string, "
    "author string, created_at string, updated_at string, token_count int, extra map<string,string>, embedding array<float>"
)
SUMMARIES = "source_type string, source_key string, summary string, doc_hash string, model string, generated_at string, token_count int"
PIPELINE_VERSION = "2"
POSTINGS = "term string, id string, len int, positions array<int>"
#: Rows that a partition is meant for, and pointers that stay.
PARTITION_ROWS, KEEP = 100_000, 3


class DimensionMismatch(ValueError):
    """The store was made for vectors of another length."""


def merge(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """existing's columns plus action: the state after a keyed upsert by id.

    Equal content hashes keep the existing row (``skipped``), others take the incoming one (``updated``,
    ``inserted``), except source_type and source_key, which stay as first written; rows only in ``existing`` are
    ``kept``.  Of equal ids in ``incoming`` the one with the largest load_seq (if there is one) counts.
    """
    cols = existing.columns
    last = F.col("load_seq") if "load_seq" in incoming.columns else F.lit(0)
    new = incoming.groupBy("id").agg(F.max_by(F.struct(*[c for c in cols if c != "id"]), F.struct(last, F.col("content_hash"))).alias("n"))
    old = existing.select("id", F.struct(*[c for c in cols if c != "id"]).alias("o"))
    action = (
        F.when(F.col("n").isNull(), "kept").when(F.col("o").isNull(), "inserted").when(F.col("o.content_hash").eqNullSafe(F.col("n.content_hash")), "skipped").otherwise("updated")
    )
    both = old.join(new, "id", "full").withColumn("action", action)
    take_new = F.col("action").isin("inserted", "updated")

    def value(c: str):
        if c in ("source_type", "source_key"):
            return F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
        return F.when(take_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return both.select("id", *[value(c) for c in cols if c != "id"], "action")


def changed(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """incoming's rows whose id is new or whose content hash differs: those that need an embedding."""
    return incoming.join(existing.select("id", "content_hash"), ["id", "content_hash"], "left_anti")


def orphans(existing: DataFrame, seen: DataFrame, source_type: str | None = None) -> DataFrame:
    """existing's rows of the source whose id was not seen; without a source, of every source that was seen."""
    scope = existing.filter(F.col("source_type") == source_type) if source_type else existing.join(seen.select("source_type").distinct(), "source_type", "left_semi")
    return scope.join(seen.select("id").distinct(), "id", "left_anti")


def merge_summaries(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One summary per document, the incoming one where there is one; of several the latest generated_at."""
    cols = existing.columns
    rows = existing.withColumn("_new", F.lit(0)).unionByName(incoming.select(*cols).withColumn("_new", F.lit(1)))
    own = rows.groupBy("source_type", "source_key").agg(F.max_by(F.struct(*cols), F.struct("_new", F.coalesce("generated_at", F.lit("")))).alias("s"))
    return own.select("s.*").select(*cols)


class Store:
    def __init__(self, spark: SparkSession, path: str, dim: int | None = None, partition_rows: int = PARTITION_ROWS) -> None:
        self.spark, self.path, self.dim, self.partition_rows = spark, path.rstrip("/"), dim, partition_rows
        self.meta = self._read_meta()
        if self.meta and dim is not None and self.meta.get("dim") not in (None, dim):
            raise DimensionMismatch(f"the store at {path} holds vectors of {self.meta['dim']} numbers, not {dim}")

    # files

    def _path(self, p: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(p)

    def _fs(self):
        return self._path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[str]:
        fs, root = self._fs(), self._path(f"{self.path}/_meta")
        names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(n for n in names if n.endswith(".json") and not n.startswith("."))

    def _pointer(self, name: str) -> dict:
        stream = self._fs().open(self._path(f"{self.path}/_meta/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _read_meta(self) -> dict:
        """The pointer file with the largest number; pointers are never overwritten, so a rename makes one atomically."""
        names = self._pointers()
        return self._pointer(names[-1]) if names else {}

    def _commit(self, **change) -> None:
        meta = {"version": 0, "dim": self.dim, "pipeline": PIPELINE_VERSION} | self.meta | change
        meta["version"] += 1
        fs, name = self._fs(), f"{meta['version']:012d}.json"
        fs.mkdirs(self._path(f"{self.path}/_meta"))
        tmp = self._path(f"{self.path}/_meta/.{name}.tmp")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        if not fs.rename(tmp, self._path(f"{self.path}/_meta/{name}")):
            raise RuntimeError(f"another writer made version {meta['version']}")
        self.meta = meta
        self._clean()

    def _named(self, meta: dict) -> set[str]:
        """Folders that a pointer names."""
        out = {meta["summaries"]} if "summaries" in meta else set()
        for kind in ("chunks", "postings"):
            out |= {self._folder(kind, part, entry["v"]) for part, entry in meta.get(kind, {}).items()}
        return out

    def _clean(self) -> None:
        """Removes what only pointers before the last KEEP name."""
        names = self._pointers()
        kept = set().union(*(self._named(self._pointer(n)) for n in names[-KEEP:]))
        fs = self._fs()
        for name in names[:-KEEP]:
            for folder in self._named(self._pointer(name)) - kept:
                fs.delete(self._path(f"{self.path}/{folder}"), True)
            fs.delete(self._path(f"{self.path}/_meta/{name}"), False)

    def _folder(self, kind: str, part: str, v: int) -> str:
        source, _, bucket = part.rpartition("/")
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(source)
        return f"{kind}/source_type={escaped}/bucket={bucket}/v={v}"

    def _load(self, kind: str, schema: str, parts: Iterable[str] | None = None) -> DataFrame:
        """Rows of all partitions or of some, with source_type and bucket."""
        have = self.meta.get(kind, {})
        paths = [f"{self.path}/{self._folder(kind, p, have[p]['v'])}" for p in (have if parts is None else parts) if p in have]
        schema += ("" if "source_type" in schema else ", source_type string") + ", bucket int, v bigint"
        if not paths:
            return self.spark.createDataFrame([], schema).drop("v")
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*paths).drop("v")

    def _write(self, kind: str, rows: DataFrame, tasks: int, order: Sequence[str]) -> int:
        """Writes new versions of the partitions that rows (with source_type and bucket) are of; returns the version."""
        v = self.meta.get("version", 0) + 1
        laid = rows.withColumn("v", F.lit(v)).repartition(max(1, tasks), "source_type", "bucket").sortWithinPartitions("source_type", "bucket", *order)
        laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_type", "bucket", "v").parquet(f"{self.path}/{kind}")
        return v

    # tables

    def chunks(self) -> DataFrame:
        return self._load("chunks", CHUNKS).select(*self.spark.createDataFrame([], CHUNKS).columns)

    def summaries(self) -> DataFrame:
        if "summaries" not in self.meta:
            return self.spark.createDataFrame([], SUMMARIES)
        return self.spark.read.schema(SUMMARIES).parquet(f"{self.path}/{self.meta['summaries']}")

    def upsert(self, incoming: DataFrame, drop_orphans_of: Sequence[str] = (), seen: DataFrame | None = None) -> dict[str, int]:
        """Merge in one atomic step; returns inserted, updated, skipped and deleted counts.

        ``drop_orphans_of``: sources whose ids that are not in ``seen`` go; ``seen`` (id) is by default ``incoming``, but
        may hold ids whose rows are not to be written.  Ids and hashes of the store are compared with the incoming ones;
        whole rows are read and written only in partitions in which a row is inserted, updated or deleted.  Null ids
        and source types are left out.
        """
        from siltstone.runtime import cut

        incoming = incoming.filter("id is not null and source_type is not null")
        if self.dim is not None and "embedding" in incoming.columns:
            bad = incoming.filter(F.col("embedding").isNotNull() & (F.size("embedding") != self.dim)).limit(1).count()
            if bad:
                raise DimensionMismatch(f"an incoming vector has not {self.dim} numbers")
        narrow = ["id", "source_type", "content_hash", *(["load_seq"] if "load_seq" in incoming.columns else [])]
        acts = merge(self._load("chunks", CHUNKS).select("id", "source_type", "content_hash"), incoming.select(*narrow))
        if drop_orphans_of:
            known = (incoming if seen is None else seen).select("id", F.lit(True).alias("_seen")).distinct()
            gone = F.col("source_type").isin(list(drop_orphans_of)) & (F.col("action") == "kept") & F.col("_seen").isNull()
            acts = acts.join(known, "id", "left").withColumn("action", F.when(gone, "deleted").otherwise(F.col("action")))
        acts = cut(acts.select("id", "source_type", "action"))
        per = {(r[0], r[1]): r[2] for r in acts.groupBy("source_type", "action").count().collect()}  # a few rows a source
        counts = {a: sum(n for (_, x), n in per.items() if x == a) for a in ("inserted", "updated", "skipped", "deleted")}
        sources = sorted({s for s, a in per if a in ("inserted", "updated", "deleted")})
        if not sources:
            return counts
        have, buckets = dict(self.meta.get("chunks", {})), dict(self.meta.get("buckets", {}))
        anew = []
        for s in sources:
            rows = sum(n for (x, a), n in per.items() if x == s and a != "deleted")
            if s not in buckets or rows > 2 * self.partition_rows * buckets[s]:  # the whole source is laid out anew, as it has doubled
                buckets[s] = max(1, -(-rows // self.partition_rows))
                anew.append(s)
        number = F.pmod(F.xxhash64("id"), F.create_map(*[F.lit(x) for s in sources for x in (s, buckets[s])])[F.col("source_type")]).cast("int")
        todo = acts.filter(F.col("action").isin("inserted", "updated", "deleted")).withColumn("bucket", number)
        touched = {f"{r[0]}/{r[1]}" for r in todo.select("source_type", "bucket").distinct().collect()}  # partitions
        old = {p for p in have if p in touched or p.rpartition("/")[0] in anew}
        touched |= {f"{s}/{b}" for s in anew for b in range(buckets[s])}
        existing = self._load("chunks", CHUNKS, sorted(old)).join(todo.filter("action = 'deleted'").select("id"), "id", "left_anti")
        fresh = incoming.join(todo.filter("action <> 'deleted'").select("id"), "id", "left_semi")
        cols = self.spark.createDataFrame([], CHUNKS).columns
        for c in set(cols) - set(fresh.columns):
            fresh = fresh.withColumn(c, F.lit(None).cast(dict(self.spark.createDataFrame([], CHUNKS).dtypes)[c]))
        v = self._write("chunks", merge(existing.select(*cols), fresh).select(*cols).withColumn("bucket", number), len(touched), ["source_key", "chunk_index", "id"])
        fs = self._fs()
        for p in old | touched:
            have.pop(p, None)
        for p in touched:
            if fs.exists(self._path(f"{self.path}/{self._folder('chunks', p, v)}")):
                have[p] = {"v": v}
        self._commit(chunks=have, buckets=buckets, dim=self.dim or self.meta.get("dim"), postings={p: e for p, e in self.meta.get("postings", {}).items() if p not in old | touched})
        return counts

    def build_index(self) -> int:
        """Brings the full-text index up to the present chunks; returns the number of partitions that were indexed.

        A segment is sorted by term, so that a query reads the row groups of its words.
        """
        from siltstone.operators.search import posting_rows

        have, done = self.meta.get("chunks", {}), self.meta.get("postings", {})
        parts = sorted(p for p, e in have.items() if done.get(p, {}).get("of") != e["v"])
        if not parts:
            return 0
        rows = self._load("chunks", CHUNKS, parts)
        v = self._write("postings", posting_rows(rows, keep=["source_type", "bucket"]), len(parts), ["term", "id"])
        known = {p: e for p, e in done.items() if p in have}
        for p in parts:
            known[p] = {"v": v, "of": have[p]["v"], "docs": 0, "words": 0}
        for r in rows.groupBy("source_type", "bucket").count().collect():  # a row a partition
            known[f"{r[0]}/{r[1]}"]["docs"] = r["count"]
        fs = self._fs()
        there = {p: known[p] for p in parts if fs.exists(self._path(f"{self.path}/{self._folder('postings', p, v)}"))}
        self.meta = self.meta | {"postings": known}
        if there:
            for r in self._load("postings", POSTINGS, sorted(there)).groupBy("source_type", "bucket").agg(F.sum(F.size("positions")).alias("n")).collect():
                known[f"{r[0]}/{r[1]}"]["words"] = r["n"]
        for p in set(parts) - set(there):  # no text there has a word
            known[p]["none"] = True
        self._commit(postings=known)
        return len(parts)

    def index(self) -> tuple[DataFrame, int, float] | None:
        """The index, if it is one of the present chunks."""
        have, done = self.meta.get("chunks", {}), self.meta.get("postings", {})
        if not have or any(done.get(p, {}).get("of") != e["v"] for p, e in have.items()):
            return None
        docs = sum(done[p]["docs"] for p in have)
        return self._load("postings", POSTINGS, [p for p in have if not done[p].get("none")]), docs, sum(done[p]["words"] for p in have) / docs if docs else 0.0

    def delete_source(self, source_type: str) -> int:
        """Drops a source's chunks; its summaries stay.  No other data is read or written."""
        own = {p for p in self.meta.get("chunks", {}) if p.rpartition("/")[0] == source_type}
        n = self._load("chunks", CHUNKS, own).count()
        if own:
            self._commit(**{k: {p: e for p, e in self.meta.get(k, {}).items() if p not in own} for k in ("chunks", "postings")}, buckets={s: b for s, b in self.meta.get("buckets", {}).items() if s != source_type})
        return n

    def upsert_summaries(self, incoming: DataFrame) -> None:
        at = f"summaries-{self.meta.get('version', 0) + 1:012d}"
        merge_summaries(self.summaries(), incoming).write.mode("overwrite").parquet(f"{self.path}/{at}")
        self._commit(summaries=at)

    def reset(self, sure: bool = False) -> None:
        """Deletes the whole store."""
        if not sure:
            raise ValueError("reset deletes the store; pass sure=True")
        self._fs().delete(self._path(self.path), True)
        self.meta = {}
