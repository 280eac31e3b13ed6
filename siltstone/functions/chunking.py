"""Frontmatter and size-bounded splitting of Markdown; splits never fall inside a code fence."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import CHARS_PER_TOKEN, MAX_CHUNK_TOKENS

MAX_CHARS = CHARS_PER_TOKEN * MAX_CHUNK_TOKENS
_FRONT = re.compile(r"---\s*\n(?P<front>.*?)\n---\s*\n", re.DOTALL)
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.DOTALL)
_SECTION = re.compile(r"^#{2,3}\s+.", re.MULTILINE)
_GAP = re.compile(r"(?=\n\n)")


def frontmatter(text: str | None) -> tuple[dict[str, str], str]:
    """Flat ``key: value`` lines between two lines of dashes at the start, and the rest.  This is not YAML."""
    text = text or ""
    m = _FRONT.match(text)
    if m is None:
        return {}, text
    pairs = (line.split(":", 1) for line in m["front"].splitlines() if ":" in line)
    return {k.strip(): v.strip().strip('"').strip("'") for k, v in pairs}, text[m.end() :]


class Fences:
    """Spans of fenced code; a fence that is not closed runs to the end."""

    def __init__(self, text: str) -> None:
        spans = [m.span() for m in _FENCE.finditer(text)]
        self.starts, self.ends = [s for s, _ in spans], [e for _, e in spans]

    def around(self, at: int) -> int | None:
        """End of the fence that holds position ``at``."""
        i = bisect_right(self.starts, at) - 1
        return self.ends[i] if i >= 0 and at < self.ends[i] else None


def sections(body: str) -> list[str]:
    """Parts that begin at headings of level two and three outside fences, after what stands before the first."""
    fences = Fences(body)
    cuts = [m.start() for m in _SECTION.finditer(body) if fences.around(m.start()) is None]
    if not cuts:
        return [body]
    edges = [0, *cuts, len(body)]
    return [part for a, b in zip(edges, edges[1:], strict=False) if (part := body[a:b].strip())]


def bounded(section: str, limit: int = MAX_CHARS) -> list[str]:
    """Pieces of at most ``limit`` characters where the text allows it: cut at the last blank line before the
    limit, else at the limit, or after a fence that the limit would cut."""
    if len(section) <= limit:
        return [section]
    fences = Fences(section)
    gaps = [m.start() for m in _GAP.finditer(section) if fences.around(m.start()) is None]
    out, at = [], 0
    while at < len(section):
        stop = at + limit
        if stop >= len(section):
            out.append(section[at:])
            break
        stop = fences.around(stop) or stop
        i = bisect_right(gaps, stop - 2) - 1
        if i >= 0 and gaps[i] > at:
            out.append(section[at : gaps[i]])
            at = gaps[i] + 2
        else:
            out.append(section[at:stop])
            at = stop
    return [p for piece in out if (p := piece.strip())]


def packed(pieces: list[str], limit: int = MAX_CHARS) -> list[str]:
    """Neighbouring pieces joined by a blank line while they fit; nothing is dropped but blank pieces."""
    groups: list[list[str]] = []
    room = -1
    for p in filter(None, map(str.strip, pieces)):
        if groups and room >= len(p) + 2:
            groups[-1].append(p)
            room -= len(p) + 2
        else:
            groups.append([p])
            room = limit - len(p)
    return ["\n\n".join(g) for g in groups]


def split(body: str | None, limit: int = MAX_CHARS) -> list[str]:
    """Null and blank bodies have no pieces."""
    return packed([p for s in sections(body or "") for p in bounded(s, limit)], limit)


# made where they are used: a worker that imports this module has no session to read a type with


def split_column(c: Column | str) -> Column:
    def run(body: pd.Series) -> pd.Series:
        return body.map(split)

    return F.pandas_udf(run, "array<string>")(c)


def frontmatter_column(c: Column | str) -> Column:
    def run(text: pd.Series) -> pd.DataFrame:
        got = text.map(frontmatter)
        return pd.DataFrame({"front": got.map(lambda x: x[0]), "body": got.map(lambda x: x[1])})

    return F.pandas_udf(run, "struct<front:map<string,string>,body:string>")(c)


def pieces(body: Column, limit: int = MAX_CHARS) -> Column:
    """Array of pieces.  Short bodies without a heading need no Python: they are one piece, or none if blank."""
    plain = (F.length(body) <= limit) & ~body.rlike(r"(?m)^#{2,3}\s+.")
    stripped = F.regexp_replace(body, r"(?U)^\s+|\s+$", "")
    return F.when(body.isNull() | (stripped == ""), F.array().cast("array<string>")).when(plain, F.array(stripped)).otherwise(split_column(body))
