"""Configuration from a TOML file; every problem is a ConfigError with a readable message."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from siltstone.functions.text import SOURCE_TYPE
from siltstone.operators.search import valid_patterns


class ConfigError(Exception):
    pass


@dataclass(frozen=True)
class Source:
    """A folder of documents; ``type`` names its connector."""

    name: str
    type: str
    path: str
    glob: str | None = None


@dataclass(frozen=True)
class Embedding:
    """``client`` names a ``module:function`` for providers that need one."""

    provider: str = "hash"
    model: str = "hash"
    dim: int = 256
    client: str | None = None


@dataclass(frozen=True)
class Ranking:
    """``scorer``: ``lexical`` or ``module:function`` of a pair scorer, which reorders the first ``pool`` hits."""

    top_k: int = 5
    hybrid: bool = True
    max_per_source_type: int | None = 3
    rerank: bool = False
    scorer: str = "lexical"
    pool: int = 30
    top_n: int | None = None


@dataclass(frozen=True)
class Reference:
    source_type: str
    pattern: str
    description: str | None = None


@dataclass(frozen=True)
class Config:
    store: str
    sources: tuple[Source, ...] = ()
    embedder: Embedding = field(default_factory=Embedding)
    retriever: Ranking = field(default_factory=Ranking)
    references: tuple[Reference, ...] = ()

    @property
    def patterns(self) -> list[tuple[str, str]]:
        return [(r.pattern, r.source_type) for r in self.references]


def _make(cls, table, where: str):
    if not isinstance(table, dict):
        raise ConfigError(f"{where} must be a table")
    known = {f.name for f in fields(cls)}
    try:
        return cls(**{k: v for k, v in table.items() if k in known})
    except TypeError as e:
        raise ConfigError(f"{where}: {e}") from e


def load(path: str | Path) -> Config:
    """Relative paths are relative to the file's folder."""
    path = Path(path)
    if not path.is_file():
        raise ConfigError(f"no configuration at {path}")
    try:
        raw = tomllib.loads(path.read_text(encoding="utf-8"))
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"{path} is not valid TOML: {e}") from e
    base = path.resolve().parent
    here = lambda p: str((base / os.path.expanduser(p)).resolve())
    embedder, retriever = _make(Embedding, raw.get("embedder", {}), "[embedder]"), _make(Ranking, raw.get("retriever", {}), "[retriever]")
    if not isinstance(embedder.dim, int) or embedder.dim <= 0:
        raise ConfigError("[embedder] dim must be a positive integer")
    if not isinstance(retriever.top_k, int) or retriever.top_k < 1:
        raise ConfigError("[retriever] top_k must be at least 1")
    sources = []
    for s in raw.get("sources", []):
        one = _make(Source, s, "[[sources]]")
        if not re.fullmatch(SOURCE_TYPE, one.name):
            raise ConfigError(f"[[sources]] name {one.name!r} must be lower-case letters, digits and underscores, a letter first")
        sources.append(Source(one.name, one.type, here(one.path), one.glob))
    references = tuple(_make(Reference, r, "[[references]]") for r in raw.get("references", []))
    try:
        valid_patterns([r.pattern for r in references])
    except (re.error, ValueError) as e:
        raise ConfigError(f"[[references]]: {e}") from e
    for r in references:
        if not re.fullmatch(SOURCE_TYPE, r.source_type):
            raise ConfigError(f"[[references]] source_type {r.source_type!r} must be lower-case letters, digits and underscores, a letter first")
    return Config(here(raw.get("store", {}).get("path", "store")), tuple(sources), embedder, retriever, references)


def render(store: str, source: Source, embedder: Embedding) -> str:
    """A configuration file for one source."""
    from siltstone.functions.text import toml_string as q

    lines = ["[store]", f"path = {q(store)}", "", "[embedder]", f"provider = {q(embedder.provider)}", f"model = {q(embedder.model)}", f"dim = {embedder.dim}", "", "[[sources]]", f"name = {q(source.name)}", f"type = {q(source.type)}", f"path = {q(source.path)}"]
    return "\n".join(lines + ([f"glob = {q(source.glob)}"] if source.glob else [])) + "\n"
