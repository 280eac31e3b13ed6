"""Problem 10: visually identical text with different characters.

``classes`` joins code points and strings that look alike by union-find over the spellings the texts use;
``canonical`` rewrites each text with an Aho-Corasick automaton over all spellings, the leftmost longest first,
putting for each its class's most frequent member.  Two texts then compare equal exactly when they look alike.
"""

from __future__ import annotations

import hashlib
import unicodedata as U
from collections.abc import Iterator, Mapping

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import cut

#: Letters of other scripts drawn like the Latin letter above or below them.
CYRILLIC, CYRILLIC_AS = "аеорсухѕіјһԁԛԝАВЕКМНОРСТХЅІЈУԚԜӀ", "aeopcyxsijhdqwABEKMHOPCTXSIJYQWI"
GREEK, GREEK_AS = "ονρϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ovpcjABEZHIKMNOPTYXCJ"
ARMENIAN, ARMENIAN_AS = "օսոհցԼՕՍ", "ounhgLOU"
CHEROKEE, CHEROKEE_AS = "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"
LISU, LISU_AS = "ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"
LATIN, LATIN_AS = "ɑɡ", "ag"
DRAWN_ALIKE = ((CYRILLIC, CYRILLIC_AS), (GREEK, GREEK_AS), (ARMENIAN, ARMENIAN_AS), (CHEROKEE, CHEROKEE_AS), (LISU, LISU_AS), (LATIN, LATIN_AS))
#: Characters without a glyph that are not of category Cf.
_NO_GLYPH = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10)}


def invisible(c: str) -> bool:
    o = ord(c)
    return U.category(c) == "Cf" or o in _NO_GLYPH or (U.category(c) == "Cc" and c not in "\t\n\r\x0b\x0c\x85")


def plain(c: str) -> str:
    """What a character shows, in characters of usual width and face; raised, lowered, circled and squared forms and
    fractions stay, for a reader sees them."""
    if invisible(c):
        return ""
    if U.category(c) == "Zs":
        return " "
    d = U.decomposition(c)
    letters = d.startswith("<compat>") and (U.category(c) == "Nl" or (U.category(c)[0] == "L" and all(U.category(x)[0] == "L" for x in U.normalize("NFKC", c))))
    if d.startswith(("<wide>", "<narrow>", "<font>")) or letters:  # letters: ligatures, digraphs, Roman numerals
        return "".join(plain(x) for x in U.normalize("NFKD", c))
    return {"\r": "\n", "\x0b": "\n", "\x0c": "\n", "\x85": "\n", "\u2028": "\n", "\u2029": "\n"}.get(c, U.normalize("NFD", c))


class UnionFind:
    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while (p := self.up.setdefault(root, root)) != root:
            root = p
        while self.up[x] != root:
            self.up[x], x = root, self.up[x]
        return root

    def union(self, a: str, b: str) -> None:
        self.up[self.find(a)] = self.find(b)


def classes(counts: Mapping[str, int]) -> dict[str, str]:
    """Spelling to representative, for each spelling whose representative is another.

    ``counts`` has the frequency of each code point in the collection.  Nodes are code points and strings: a code
    point is one with the string it shows, and with the letters drawn like it, and strings whose parts are of the same
    classes are one.  The most frequent code point of a class represents it, of equally frequent ones the smallest; a
    string is represented by its parts' representatives, so any mixture of spellings ends alike.
    """
    uf = UnionFind()
    for a, b in DRAWN_ALIKE:
        for x, y in zip(a, b, strict=True):
            uf.union(x, y)
    shown = {c: plain(c) for c in set(counts) | set(uf.up)}
    for c, s in list(shown.items()):
        for x in s:
            uf.find(x)
        if s:
            uf.union(c, s)
    strings: dict[tuple, str] = {}
    for s in {s for s in shown.values() if len(s) > 1}:  # transitive over parts: all parts' classes are made by now
        uf.union(s, strings.setdefault(tuple(uf.find(x) for x in s), s))
    members: dict[str, list[str]] = {}
    for c in list(uf.up):
        if len(c) == 1 and plain(c) == c:
            members.setdefault(uf.find(c), []).append(c)
    best = {root: min(own, key=lambda c: (-counts.get(c, 0), c)) for root, own in members.items()}
    out = {"\r\n": "\n"}
    for c in shown:
        rep = "".join(best.get(uf.find(x), x) for x in shown[c])
        if rep != c and not (len(rep) > 1 and U.normalize("NFC", rep) == c):
            out[c] = rep
    return out


class Rewriter:
    def __init__(self, spellings: Mapping[str, str]) -> None:
        self.machine = ahocorasick.Automaton()
        for s, r in spellings.items():
            self.machine.add_word(s, (len(s), r))
        self.machine.make_automaton()
        self.ascii_safe = not any(s.isascii() and s != "\r\n" for s in spellings)

    def __call__(self, text: str) -> str:
        if text.isascii() and self.ascii_safe and "\r" not in text:
            return text
        text = U.normalize("NFD", text)
        out, at = [], 0
        for end, (n, rep) in self.machine.iter_long(text):
            start = end - n + 1
            out.append(text[at:start])
            out.append(rep)
            at = end + 1
        out.append(text[at:])
        return U.normalize("NFC", "".join(out))


def character_counts(texts: DataFrame, text: str) -> DataFrame:
    """c, n: how often each code point occurs in all texts; at most one row per code point there is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for b in batches:
            joined = "".join(t for t in b.column(0).to_pylist() if t)
            if joined:
                points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
                c = np.bincount(points)
                total[: len(c)] += c
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["c", "n"])

    return texts.select(text).mapInArrow(run, "c bigint, n bigint").groupBy("c").agg(F.sum("n").alias("n"))


def spellings(texts: DataFrame, text: str = "text") -> dict[str, str]:
    """The rewriting table of a collection.  Its size is bounded by the number of code points in Unicode."""
    counts: dict[str, int] = {}
    for c, n in character_counts(texts, text).collect():
        for x in U.normalize("NFD", chr(c)):
            counts[x] = counts.get(x, 0) + n
        counts.setdefault(chr(c), 0)
    return classes(counts)


def canonical(df: DataFrame, key: str = "doc_id", text: str = "text", table: Mapping[str, str] | None = None) -> DataFrame:
    """key, canonical (the text in its one form), looks (16-byte digest of it), is (digest of the text as it stands).

    Null texts stay null, with null digests; texts without a visible character have a null ``looks``.
    Lone surrogates stay as they are.  Other columns are ignored.
    """
    table = spellings(df, text) if table is None else dict(table)
    made: list[Rewriter] = []

    def digest(s: str) -> bytes:
        return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Rewriter(table))
        for b in batches:
            texts = b.column(1).to_pylist()
            to = [None if t is None else made[0](t) for t in texts]
            looks = [digest(t) if t and not t.isspace() else None for t in to]
            own = [None if t is None else digest(t) for t in texts]
            yield pa.record_batch([b.column(0), pa.array(to, pa.string()), pa.array(looks, pa.binary()), pa.array(own, pa.binary())], [key, "canonical", "looks", "own"])

    rows = df.select(key, text)
    return rows.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, canonical string, looks binary, own binary")


def look_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class, members, spellings: the smallest key of the rows that look alike, how many rows and different texts
    they are.  One row per key; of repeated keys the smallest digests count.  Texts without a visible character, null
    texts and null keys have no row."""
    c = canonical(df, key, text).select(F.col(key), "looks", "own").filter(F.col("looks").isNotNull() & F.col(key).isNotNull())
    c = cut(c.groupBy(key).agg(F.min(F.struct("looks", "own")).alias("s")).select(key, "s.*"))
    each = c.groupBy("looks", "own").agg(F.min(key).alias("k"), F.count(F.lit(1)).alias("n"))  # map-side first: a look may have a third of all rows
    classes_ = each.groupBy("looks").agg(F.min("k").alias("class"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("spellings"))
    return c.join(classes_, "looks").select(key, "class", "members", "spellings")


def pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key_a, key_b (a < b): rows whose texts look alike though they differ.  Repeated rows count once.

    Only looks with several texts reach the join; it is an equi-join, so one look with very many rows is split
    by Spark's skew join, and its rows number as many as its pairs.
    """
    c = cut(canonical(df, key, text).select(F.col(key), "looks", "own").filter(F.col("looks").isNotNull() & F.col(key).isNotNull()).distinct())
    several = c.groupBy("looks").agg(F.min("own").alias("x"), F.max("own").alias("y")).filter("x <> y").select("looks")
    rows = c.join(several, "looks", "left_semi")
    a = rows.select("looks", F.col(key).alias(f"{key}_a"), F.col("own").alias("own_a"))
    b = rows.select("looks", F.col(key).alias(f"{key}_b"), F.col("own").alias("own_b"))
    met = a.join(b, "looks").filter((F.col(f"{key}_a") < F.col(f"{key}_b")) & (F.col("own_a") != F.col("own_b")))
    return met.select(f"{key}_a", f"{key}_b").distinct()
