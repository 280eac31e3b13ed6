"""File sources as a Spark data source: safe discovery on the driver, reading on the workers."""

from __future__ import annotations

import datetime as dt
import fnmatch
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siltstone.functions import chunking
from siltstone.sources.html import extract

BATCH = 256


def discover(root: str, glob: str) -> list[str]:
    """Paths relative to ``root``, by path parts: regular files below it that match; no links, nothing outside."""
    top = Path(root).resolve()
    if not top.is_dir():
        raise FileNotFoundError(f"no such directory: {root}")
    found = []
    for folder, folders, files in os.walk(top, followlinks=False):
        folders[:] = [f for f in folders if not os.path.islink(os.path.join(folder, f))]
        for f in files:
            p = Path(folder, f)
            rel = p.relative_to(top)
            if not p.is_symlink() and p.is_file() and p.resolve().is_relative_to(top) and _matches(rel.parts, tuple(x for x in glob.split("/") if x)):
                found.append(rel)
    return [str(p) for p in sorted(found, key=lambda p: p.parts)]


def _matches(parts: tuple[str, ...], pattern: tuple[str, ...]) -> bool:
    if not pattern:
        return not parts
    if pattern[0] == "..":
        return False
    if pattern[0] == "**":
        return any(_matches(parts[i:], pattern[1:]) for i in range(len(parts) + 1)) if len(pattern) > 1 else bool(parts)
    return bool(parts) and fnmatch.fnmatchcase(parts[0], pattern[0]) and _matches(parts[1:], pattern[1:])


class _Batch(InputPartition):
    def __init__(self, root: str, names: list[str], first: int) -> None:
        self.root, self.names, self.first = root, names, first


class FileReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.glob = options["path"], options.get("glob", "**/*")

    def partitions(self) -> list[InputPartition]:
        names = discover(self.root, self.glob)
        return [_Batch(self.root, names[i : i + BATCH], i) for i in range(0, len(names), BATCH)] or [_Batch(self.root, [], 0)]

    def read(self, part: _Batch) -> Iterator[tuple]:
        for n, name in enumerate(part.names):
            p = Path(part.root, name)
            try:
                s, body = p.stat(), p.read_bytes()
            except OSError:
                continue
            iso = [dt.datetime.fromtimestamp(t, dt.UTC).isoformat() for t in (s.st_mtime, s.st_ctime)]
            yield name, part.first + n, body, *iso


class FileSource(DataSource):
    """format("siltstone_files"): relative path, load order, bytes and the file's times."""

    @classmethod
    def name(cls) -> str:
        return "siltstone_files"

    def schema(self) -> str:
        return "path string, load_seq bigint, data binary, modified string, created string"

    def reader(self, schema) -> FileReader:
        return FileReader(self.options)


def files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    spark.dataSource.register(FileSource)
    return spark.read.format("siltstone_files").option("glob", glob).load(root)


def _text(df: DataFrame) -> DataFrame:
    """Bytes as text: bad ones become U+FFFD, a leading byte order mark goes, line ends are one character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [x.decode("utf-8", "replace").removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n") for x in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(text, pa.string()), b.column(3), b.column(4)], ["path", "load_seq", "text", "modified", "created"])

    return df.mapInArrow(run, "path string, load_seq bigint, text string, modified string, created string")


_STEM = r"^.*/|\.[^./]*$"


def _null(name: str):
    return F.lit(None).cast("string").alias(name)


def markdown(spark: SparkSession, name: str, root: str, glob: str = "**/*.md") -> DataFrame:
    rows = _text(files(spark, root, glob)).withColumn("fm", chunking.frontmatter_column("text"))
    f = lambda k: F.nullif(F.col("fm.front")[k], F.lit(""))
    return rows.select(
        F.lit(name).alias("source_type"), F.coalesce(f("id"), "path").alias("source_key"), F.coalesce(f("title"), F.regexp_replace("path", _STEM, "")).alias("title"), f("url").alias("url"),
        f("author").alias("author"), F.coalesce(f("created"), "created").alias("created_at"), F.coalesce(f("modified"), f("updated"), "modified").alias("updated_at"), F.col("fm.body").alias("body"), "path", "load_seq",
    )


def text(spark: SparkSession, name: str, root: str, glob: str = "**/*.txt") -> DataFrame:
    rows = _text(files(spark, root, glob)).filter(F.col("text").rlike(r"(?U)\S"))
    return rows.select(F.lit(name).alias("source_type"), F.col("path").alias("source_key"), F.regexp_replace("path", _STEM, "").alias("title"), _null("url"), _null("author"), _null("created_at"), _null("updated_at"), F.col("text").alias("body"), "path", "load_seq")


def html(spark: SparkSession, name: str, root: str, glob: str = "**/*.html") -> DataFrame:
    rows = _text(files(spark, root, glob)).withColumn("x", extract("text")).filter(F.col("x.body").rlike(r"(?U)\S"))
    return rows.select(F.lit(name).alias("source_type"), F.col("path").alias("source_key"), F.coalesce(F.nullif("x.title", F.lit("")), F.regexp_replace("path", _STEM, "")).alias("title"), F.col("x.url").alias("url"), F.col("x.author").alias("author"), F.col("x.created").alias("created_at"), _null("updated_at"), F.col("x.body").alias("body"), "path", "load_seq")


def pdf(spark: SparkSession, name: str, root: str, glob: str = "**/*.pdf") -> DataFrame:
    """Needs the optional package pypdf on the workers; unreadable files and pages are skipped."""
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise RuntimeError("the pdf source needs the package pypdf") from e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import pypdf

        for b in batches:
            out = []
            for path, seq, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    doc = pypdf.PdfReader(io.BytesIO(data))
                    pages = list(doc.pages)
                except Exception:
                    continue
                texts = []
                for p in pages:
                    try:
                        texts.append(p.extract_text() or "")
                    except Exception:
                        continue
                body = "\n\n".join(t for t in texts if t.strip()).strip()
                if body:
                    out.append((path, seq, body, (doc.metadata.title or "") if doc.metadata else ""))
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], ["path", "load_seq", "body", "t"])

    rows = files(spark, root, glob).mapInArrow(run, "path string, load_seq bigint, body string, t string")
    return rows.select(F.lit(name).alias("source_type"), F.col("path").alias("source_key"), F.coalesce(F.nullif(F.trim("t"), F.lit("")), F.regexp_replace("path", _STEM, "")).alias("title"), _null("url"), _null("author"), _null("created_at"), _null("updated_at"), "body", "path", "load_seq")


CONNECTORS = {"markdown": markdown, "text": text, "html": html, "pdf": pdf}


def load(spark: SparkSession, name: str, kind: str, root: str, glob: str | None = None) -> DataFrame:
    """documents of one configured source."""
    if kind not in CONNECTORS:
        raise ValueError(f"unknown source type {kind!r}; known: {', '.join(sorted(CONNECTORS))}")
    return CONNECTORS[kind](spark, name, root, glob) if glob else CONNECTORS[kind](spark, name, root)
