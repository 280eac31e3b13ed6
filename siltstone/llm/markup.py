"""Problem 4: markup residue in text documents.

A text becomes a tree of nodes: everything that could be an element, a mark or a command of HTML, Markdown, wiki
text or LaTeX.  Boosted trees over the nodes' features (kind, attributes, density of the subtree, depth, siblings,
what else the text holds) give each node the odds of belonging to each language or to none.  The decoding then
takes the likeliest choices that do not contradict each other: what stands inside code or a formula is no markup.

The trees are trained on texts made here by ``markup_samples``, labelled as they are made.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.boosting import Boosted

NONE, HTML, MARKDOWN, WIKI, LATEX = range(5)
LANGUAGES = ["none", "html", "markdown", "wiki", "latex"]
#: Texts that the trees are trained on, and their seed.
TRAINING_TEXTS, SEED = 1600, 11

_M, _S, _I = re.MULTILINE, re.DOTALL, re.IGNORECASE
_VERBATIM = "verbatim\\*?|Verbatim|lstlisting|minted|alltt"
_MATH_ENV = "equation\\*?|align\\*?|gather\\*?|multline\\*?|eqnarray\\*?|displaymath|math"
#: Parts whose inside is not read as markup; the leftmost wins.
OPAQUE = re.compile(
    r"^ {0,3}(?P<fence>`{3,}|~{3,})[^\n`]*\n(?P<fence_in>.*?)(?:^ {0,3}(?P=fence)[`~]*[ \t]*$|\Z)"
    rf"|\\begin\{{(?P<env>{_VERBATIM}|{_MATH_ENV})\}}(?:\[[^\]\n]*\])?(?:(?<=minted\}})\{{[^}}\n]*\}})?(?P<env_in>.*?)\\end\{{(?P=env)\}}"
    r"|<(?P<tag>[pP][rR][eE]|[sS][cC][rR][iI][pP][tT]|[sS][tT][yY][lL][eE]|syntaxhighlight|source|math|nowiki)\b[^<>]*>(?P<tag_in>.*?)</(?P=tag)\s*>"
    r"|<!--(?P<comment>.*?)-->"
    r"|\$\$(?P<display>[^$]+?)\$\$"
    r"|\\\[(?P<bracket>(?:(?!\\\[).)*?)\\\]"  # up to the first end, or not at all if another begins before
    r"|\\\((?P<paren>(?:(?!\\\(|\n[ \t]*\n).)+?)\\\)"
    r"|(?P<tick>(?<!`)`{1,2}(?!`))(?P<tick_in>[^`\n]+?)(?P=tick)(?!`)"
    r"|<(?P<code>[cC][oO][dD][eE]|[tT][tT])>(?P<code_in>[^\n]*?)</(?P=code)>"
    r"|(?<![\\$\w])\$(?=[^\s$])(?P<dollar>[^$\n]*?[^\s\\$])\$(?![\d$])",
    _M | _S,
)
LINE = re.compile(
    r"^(?P<ind>[ \t]*)(?:"
    r"(?P<hash>\#{1,6})(?:[ \t]+)(?P<hash_in>[^\n]*\S)"
    r"|(?P<mixed>[*\#]*[*][*\#:]*|\#[*\#:]*[*:][*\#:]*)[ \t]+(?P<mixed_in>[^\n]*\S)"
    r"|(?P<dash>[-+])[ \t]+(?P<dash_in>[^\n]*\S)"
    r"|(?P<num>\d{1,9}[.)])[ \t]+(?P<num_in>[^\n]*\S)"
    r"|(?P<eq>={1,6})[ \t]*(?P<eq_in>[^=\s][^\n]*?)[ \t]*(?P=eq)[ \t]*$"
    r"|>[ \t]?(?P<quote_in>[^\n]*)"
    r"|%(?P<percent>[^\n]*)"
    r"|\{\|(?P<table>[^\n]*)"
    r"|\|(?P<cells>[^\n]*)\|[ \t]*$"
    r")",
    _M,
)
SETEXT = re.compile(r"^(?P<t>[^\s=\-|>#*+<][^\n]*)\n(?P<u>=+|-{2,})[ \t]*$", _M)
_ATTRIBUTES = r"(?:\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>=`]+))?)*"
TAG = re.compile(rf"<(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9]*)(?P<attr>{_ATTRIBUTES})\s*(?P<self>/?)>")
#: Arguments nest to any depth.
COMMAND = regex.compile(r"\\(?P<name>[A-Za-z]++)(?P<star>\*?)(?P<opt>(?:\[[^\]\n]*\])?)(?P<arg>(?P<one>\{(?:[^{}]++|(?&one))*+\})*+)")
#: A line that goes on with the list item before it: deeper than the item, and no block of its own.
GOES_ON = re.compile(r"\n(?P<ind>[ \t]+)(?![-+*][ \t]|\d{1,9}[.)][ \t]|\#{1,6}[ \t]|>|\||`{3}|~{3}|\\begin|\\end|\\item|<)[^\s\0][^\n]*")
INLINE = re.compile(
    r"(?P<image>!\[[^\]\n]*\]\([^()\s]+(?: \"[^\"]*\")?\))"
    r"|(?P<link>\[[^\[\]\n]+\]\((?:[^()\s]|\([^()\s]*\))*(?: \"[^\"]*\")?\))"
    r"|(?P<wlink>\[\[[^\[\]\n]+\]\])"
    r"|(?P<elink>\[(?:https?:|ftp:|mailto:|//)[^\s\]]+(?: [^\]\n]*)?\])"
    r"|(?P<template>\{\{[^{}]*\}\})"
    r"|(?P<quotes>'''''[^'\n]+'''''|'''[^\n]+?'''(?!')|''[^\n]+?''(?!'))"
    r"|(?P<strong>(?<![\w*])\*\*(?=\S)[^*\n]+?(?<=\S)\*\*(?![\w*])|(?<![\w_])__(?=\S)[^_\n]+?(?<=\S)__(?![\w_]))"
    r"|(?P<emph>(?<![\w*])\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?![\w*])|(?<![\w_])_(?=[^\s_])[^_\n]+?(?<=[^\s_])_(?![\w_]))"
)
VOID = frozenset("br hr img input meta link wbr col area base embed source track".split())
CLOSED_BY = {
    "li": {"li"}, "p": {"p", "div", "ul", "ol", "pre", "table", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "section", "article", "details", "figure"},
    "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
}
HEADINGS = frozenset("part chapter section subsection subsubsection paragraph subparagraph".split())
TAG_KINDS = ["block", "inline", "heading", "item", "list", "pre", "math", "syntaxhighlight", "ref", "code", "script", "other"]
_TAG_KIND = {}
for _kind, _names in {
    "block": "p div table tr td th blockquote section article header footer nav main figure figcaption form details summary body html head hr dl dt dd thead tbody title center",
    "inline": "a strong em b i u s span br img small big sup sub font del ins mark abbr kbd cite q label button input var samp tt",
    "heading": "h1 h2 h3 h4 h5 h6", "item": "li", "list": "ul ol menu", "pre": "pre nowiki", "math": "math", "syntaxhighlight": "syntaxhighlight source", "ref": "ref references gallery noinclude includeonly", "code": "code",
    "script": "script style comment",
}.items():
    _TAG_KIND |= dict.fromkeys(_names.split(), _kind)
SYNTAX = [
    "hash", "mixed", "dash", "num", "eq", "quote", "percent", "table", "cells", "setext", "fence", "verbatim", "equation", "display", "bracket", "paren", "dollar", "tick",
    "image", "link", "wlink", "elink", "template", "quotes", "strong", "emph", "command", "bare", "item", "section", "env", *(f"tag_{k}" for k in TAG_KINDS),
]
_IX = {s: i for i, s in enumerate(SYNTAX)}
#: Kinds that tell a language by themselves, for the counts of what else a text holds.
EVIDENCE = {
    "html": [_IX[f"tag_{k}"] for k in ("block", "inline", "heading", "item", "list", "pre", "script")],
    "markdown": [_IX[k] for k in ("fence", "link", "image", "setext", "strong", "emph", "tick", "display", "dash", "num", "cells", "quote")],
    "wiki": [_IX[k] for k in ("eq", "wlink", "elink", "template", "quotes", "table", "tag_math", "tag_syntaxhighlight", "tag_ref")],
    "latex": [_IX[k] for k in ("command", "item", "section", "env", "verbatim", "equation", "bracket", "paren", "percent")],
}


#: The languages that have a kind of node at all.
POSSIBLE = np.zeros((len(SYNTAX), len(LANGUAGES)), bool)
POSSIBLE[:, NONE] = True
for _kind, _i in _IX.items():
    if _kind.startswith("tag_"):
        POSSIBLE[_i, [HTML, WIKI]] = True
    elif _kind in ("hash", "mixed"):
        POSSIBLE[_i, [MARKDOWN, WIKI]] = True
    elif _kind in ("display", "dollar"):
        POSSIBLE[_i, [MARKDOWN, LATEX]] = True
    elif _kind in ("eq", "table", "wlink", "elink", "template", "quotes"):
        POSSIBLE[_i, WIKI] = True
    elif _kind in ("percent", "verbatim", "equation", "bracket", "paren", "command", "bare", "item", "section", "env"):
        POSSIBLE[_i, LATEX] = True
    else:
        POSSIBLE[_i, MARKDOWN] = True


@dataclass(slots=True)
class Node:
    start: int
    end: int
    inner: tuple[int, int]
    syntax: str
    name: str = ""
    attributes: int = 0
    opaque: bool = False
    tokens: str = ""  # of a tag's attributes
    children: list = field(default_factory=list)
    depth: int = 0
    language: int = NONE


def _lines(text: str, offset: int, out: list[Node]) -> None:
    for m in LINE.finditer(text):
        for kind in ("hash", "mixed", "dash", "num", "eq"):
            if m[kind] is not None:
                end = m.end(kind + "_in")
                if kind in ("mixed", "dash", "num"):
                    while (more := GOES_ON.match(text, end)) and len(more["ind"].expandtabs(4)) > len(m["ind"].expandtabs(4)) + 1:
                        end = more.end()
                out.append(Node(m.start(kind) + offset, max(m.end(), end) + offset, (m.start(kind + "_in") + offset, end + offset), kind, m[kind], len(m["ind"])))
                break
        else:
            for group, kind in (("quote_in", "quote"), ("percent", "percent"), ("table", "table"), ("cells", "cells")):
                if m[group] is not None:
                    out.append(Node(m.end("ind") + offset, m.end() + offset, (m.start(group) + offset, m.end(group) + offset), kind))
                    break


def _elements(text: str, out: list[Node]) -> None:
    """Elements of tags; missing end tags are supplied, end tags without a start are dropped."""
    stack: list[tuple[str, re.Match]] = []

    def close(upto: int, at: int) -> None:
        while len(stack) > upto:
            name, m = stack.pop()
            out.append(Node(m.start(), at, (m.end(), at), "tag_" + _TAG_KIND.get(name, "other"), name, m["attr"].count("="), False, m["attr"]))

    for m in TAG.finditer(text):
        name = m["name"].lower()
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i + 1, m.start())
                    _, s = stack.pop()
                    out.append(Node(s.start(), m.end(), (s.end(), m.start()), "tag_" + _TAG_KIND.get(name, "other"), name, s["attr"].count("="), False, s["attr"]))
                    break
            continue
        if name in VOID or m["self"]:
            out.append(Node(m.start(), m.end(), (m.end(), m.end()), "tag_" + _TAG_KIND.get(name, "other"), name, m["attr"].count("="), False, m["attr"]))
            continue
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in ("ul", "ol", "table", "div", "blockquote") and name == "li":
                break
            if name in CLOSED_BY.get(stack[i][0], ()):
                close(i, m.start())
                break
        stack.append((name, m))
    close(0, len(text))


def _commands(text: str, out: list[Node]) -> None:
    opened: list[tuple[str, int, int]] = []
    items: list[tuple[int, int, int]] = []  # start, end of \item, level

    def end_items(level: int, at: int) -> None:
        while items and items[-1][2] >= level:
            s, e, _ = items.pop()
            out.append(Node(s, at, (e, at), "item", "item"))

    for m in COMMAND.finditer(text):
        name = m["name"]
        if name == "begin" and m["arg"]:
            opened.append((m["arg"], m.start(), m.end()))
        elif name == "end" and m["arg"]:
            if opened and opened[-1][0].startswith(m["arg"]):
                end_items(len(opened), m.start())
                _, s, e = opened.pop()
                out.append(Node(s, m.end(), (e, m.start()), "env", m["arg"][1:-1]))
        elif name == "item":
            end_items(len(opened), m.start())
            items.append((m.start(), m.end("opt"), len(opened)))
        elif name in HEADINGS and m["arg"]:
            out.append(Node(m.start(), m.end(), (m.start("arg") + 1, m.start("arg") + _arg_end(m["arg"])), "section", name))
        else:
            out.append(Node(m.start(), m.end(), (m.end(), m.end()), "command" if m["arg"] else "bare", name))
    end_items(0, len(text))


def _arg_end(arg: str) -> int:
    depth = 0
    for i, c in enumerate(arg):
        depth += (c == "{") - (c == "}")
        if not depth:
            return i
    return len(arg)


def parse(text: str) -> list[Node]:
    """All candidate nodes, parents before children; children and depth are set."""
    found: list[Node] = []
    masked, at = [], 0
    for m in OPAQUE.finditer(text):
        g = m.lastgroup
        if m["env"] is not None:
            kind, name, inner = ("verbatim" if re.fullmatch(_VERBATIM, m["env"]) else "equation"), m["env"], m.span("env_in")
        elif m["tag"] is not None:
            name = m["tag"].lower()
            kind, inner = "tag_" + _TAG_KIND[name], m.span("tag_in")
        elif m["comment"] is not None:
            kind, name, inner = "tag_script", "comment", m.span("comment")
        elif m["fence"] is not None:
            kind, name, inner = "fence", "fence", m.span("fence_in")
        elif m["tick"] is not None:
            kind, name, inner = "tick", "tick", m.span("tick_in")
        elif m["code"] is not None:
            kind, name, inner = "tag_code", "code", m.span("code_in")
        else:
            kind, name, inner = g, g, m.span(g)
        node = Node(m.start(), m.end(), inner, kind, name, 0, True)
        found.append(node)
        if kind in ("fence", "verbatim", "tag_pre", "tag_syntaxhighlight"):
            _lines(text[inner[0] : inner[1]], inner[0], found)
        masked += [text[at : m.start()], re.sub(r"[^\n]", "\0", m[0])]
        at = m.end()
    clear = "".join(masked) + text[at:] if masked else text
    _lines(clear, 0, found)
    for m in SETEXT.finditer(clear):
        found.append(Node(m.start(), m.end(), m.span("t"), "setext", m["u"][0]))
    if "<" in clear:
        _elements(clear, found)
    if "\\" in clear:
        _commands(clear, found)
    for m in INLINE.finditer(clear):
        found.append(Node(m.start(), m.end(), m.span(), m.lastgroup, m.lastgroup))
    found.sort(key=lambda n: (n.start, -n.end))
    stack: list[Node] = []
    for n in found:
        while stack and stack[-1].end <= n.start:
            stack.pop()
        for p in reversed(stack):
            if p.end >= n.end:
                p.children.append(n)
                break
        n.depth = len(stack)
        stack.append(n)
    return found


#: Attribute tokens are counted in so many hashed places.
TOKEN_PLACES = 12
N_FEATURES = len(SYNTAX) + 4 + 17 + TOKEN_PLACES + 1


def features(text: str, nodes: list[Node]) -> np.ndarray:
    """One row a node: kind, evidence for each language in the rest of the text, and the node's own figures."""
    x = np.zeros((len(nodes), N_FEATURES), np.float32)
    if not nodes:
        return x
    k = np.array([_IX[n.syntax] for n in nodes])
    x[np.arange(len(nodes)), k] = 1
    inside: set[int] = set()
    for n in nodes:
        if n.opaque:
            inside.update(id(c) for c in n.children)
    free = np.array([id(n) not in inside for n in nodes])
    counts = np.bincount(k[free], minlength=len(SYNTAX))
    base = len(SYNTAX)
    for j, own in enumerate(EVIDENCE.values()):
        x[:, base + j] = np.log1p(counts[own].sum())
    same = counts[k]
    total, marks = max(1, len(text)), len(nodes)
    seen: dict[int, int] = {}
    begins, ends = {(n.syntax, n.start) for n in nodes}, {(n.syntax, n.end) for n in nodes}
    beside = lambda n: (n.syntax, n.end + 1) in begins or (n.syntax, n.start - 1) in ends
    # numbered items of wiki text come in a row, headings of Markdown alone
    x[:, -1] = sum(1 for n, f in zip(nodes, free, strict=True) if n.syntax == "hash" and f and not beside(n))
    for i, n in enumerate(nodes):
        near = beside(n)
        size, inner = n.end - n.start, n.inner[1] - n.inner[0]
        seen[k[i]] = seen.get(k[i], 0) + 1
        nested = sum(c.end - c.start for c in n.children)
        if n.tokens:
            for token in re.findall(r"[A-Za-z]+", n.tokens.lower()):
                x[i, base + 21 + zlib.crc32(token.encode()) % TOKEN_PLACES] += 1
        x[i, base + 4 : base + 21] = (
            n.depth, n.attributes, inner / max(1, size), nested / max(1, size), len(n.children), math.log1p(size), same[i], seen[k[i]], not free[i], len(n.name),
            size / total, marks, n.end == len(text), n.inner[0] == n.inner[1], text[n.inner[0] : n.inner[0] + 1].isalpha(), any(c in text[n.inner[0] : n.inner[1]] for c in "\\^_{}=") if n.syntax == "dollar" else 0, near,
        )
    return x


@lru_cache(2)
def model(texts: int = TRAINING_TEXTS, seed: int = SEED) -> Boosted:
    from siltstone.llm.markup_samples import labelled

    x, y = [], []
    for text, labels in labelled(texts, seed):
        nodes = parse(text)
        x.append(features(text, nodes))
        y += [labels[n.start] for n in nodes]
    return Boosted(len(LANGUAGES)).fit(np.concatenate(x), np.array(y))


#: How much likelier a mixture of two of Markdown, wiki and LaTeX must be than either alone (natural logarithm).
MIXTURE = 30.0


def decode(nodes: list[Node], odds: np.ndarray) -> None:
    """Sets each node's language: the likeliest joint choice in which nothing inside chosen code, a formula or a
    script is markup, and in which Markdown, wiki and LaTeX only mix where the nodes insist."""
    best = _decode(nodes, odds)
    used = {n.language for n in nodes} & {MARKDOWN, WIKI, LATEX}
    if len(used) > 1:
        alone = []
        for k in sorted(used):
            only = odds.copy()
            only[:, sorted(used - {k})] = -1e6
            alone.append((_decode(nodes, only), only))
        score, only = max(alone, key=lambda x: x[0])
        _decode(nodes, only if score + MIXTURE > best else odds)


def _decode(nodes: list[Node], odds: np.ndarray) -> float:
    """Sets the languages and returns the choice's log-odds."""
    at = {id(n): i for i, n in enumerate(nodes)}
    none_below: dict[int, float] = {}
    free: dict[int, float] = {}
    for n in reversed(nodes):  # children before parents
        i = at[id(n)]
        none_below[i] = sum(none_below[at[id(c)]] + odds[at[id(c)], NONE] for c in n.children)
        below = sum(free[at[id(c)]] for c in n.children)
        best = max(odds[i, 1:]) + (none_below[i] if n.opaque else below)
        free[i] = max(odds[i, NONE] + below, best)
    barred: set[int] = set()
    for n in nodes:
        i = at[id(n)]
        if i in barred:
            n.language = NONE
            barred.update(at[id(c)] for c in n.children)
            continue
        below = sum(free[at[id(c)]] for c in n.children)
        best = max(odds[i, 1:]) + (none_below[i] if n.opaque else below)
        n.language = NONE if odds[i, NONE] + below >= best else int(odds[i, 1:].argmax()) + 1
        if n.opaque and n.language != NONE:
            barred.update(at[id(c)] for c in n.children)
    inside = {id(c) for n in nodes for c in n.children}
    return sum(free[at[id(n)]] for n in nodes if id(n) not in inside)


# What a reader sees

_REFERENCE = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
_ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303"}
_SYMBOLS = {
    "textless": "<", "textgreater": ">", "textbackslash": "\\", "textasciitilde": "~", "textasciicircum": "^", "textbar": "|", "textunderscore": "_", "ldots": "…", "dots": "…",
    "ss": "ß", "ae": "æ", "oe": "œ", "o": "ø", "aa": "å", "LaTeX": "LaTeX", "TeX": "TeX", "quad": " ", "qquad": " ", "newline": " ", "linebreak": " ", "par": " ", "S": "§", "textdegree": "°", "euro": "€",
}
_SILENT = frozenset("cite citep citet label ref eqref pageref footnote footnotemark index vspace hspace includegraphics noindent centering nocite bibliography input include thanks todo marginpar".split())


def unescape(s: str) -> str:
    return _REFERENCE.sub(lambda m: html.unescape(m[0]), s)


def squeeze(s: str) -> str:
    return " ".join(s.split())


def _see_latex(s: str) -> str:
    s = re.sub(r"(?<!\\)%[^\n]*", "", s)

    def command(m: re.Match) -> str:
        name, arg = m["name"], m["arg"]
        if name in _SILENT:
            return ""
        if name in _SYMBOLS:
            return _SYMBOLS[name]
        parts, at = [], 0
        while at < len(arg):
            e = _arg_end(arg[at:])
            parts.append(arg[at + 1 : at + e])
            at += e + 1
        if not parts:
            return ""
        return _see_latex(parts[-1] if name in ("href", "textcolor", "colorbox", "hyperref") else parts[0])

    s = s.replace("\\\\", "\n")
    keep: list[str] = []

    def hold(m: re.Match) -> str:
        keep.append(m[0])
        return f"\x01{len(keep) - 1}\x02"

    s = re.sub(r"(?<!\\)\$[^$]+\$|\\\(.+?\\\)", hold, s)
    s = COMMAND.sub(command, s)
    s = re.sub(r"\\(['`^\"~])\{?([A-Za-z])\}?", lambda m: unicodedata.normalize("NFC", m[2] + _ACCENTS[m[1]]), s)
    s = re.sub(r"(?<!\\)~", " ", s)
    s = re.sub(r"(?<!\\)[{}]", "", s)
    s = s.replace("``", "“").replace("''", "”")
    s = re.sub(r"\\([&%$#_{}~^ ,;!])", lambda m: " " if m[1] in " ,;!" else m[1], s)
    return re.sub("\x01(\\d+)\x02", lambda m: re.sub(r"^\$|\$$|^\\\(|\\\)$", "", keep[int(m[1])]), s)


def _see_tags(s: str) -> str:
    s = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>", "", s, flags=_S | _I)
    s = re.sub(r"<br\s*/?>|</?(?:p|div|tr|td|th|ul|ol|li|table|h[1-6])\b[^<>]*>", " ", s, flags=_I)
    return TAG.sub("", s)


def _see_markdown(s: str) -> str:
    keep: list[str] = []

    def hold(t: str) -> str:
        keep.append(t)
        return f"\x01{len(keep) - 1}\x02"

    s = re.sub(r"(`+)(.+?)\1", lambda m: hold(m[2].strip(" ") if m[2].strip() else m[2]), s)
    s = re.sub(r"\$([^$\s](?:[^$\n]*[^$\s])?)\$(?!\d)", lambda m: hold(m[1]), s)
    s = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: hold(m[1]), s)
    s = re.sub(r"!\[([^\]]*)\]\([^()]*\)", r"\1", s)
    s = re.sub(r"\[\^[^\]]+\]", "", s)
    s = re.sub(r"\[([^\[\]]+)\]\((?:[^()]|\([^()]*\))*\)", r"\1", s)
    s = re.sub(r"\[([^\[\]]+)\]\[[^\[\]]*\]", r"\1", s)
    s = re.sub(r"<((?:https?|mailto):[^<>\s]+|[^<>\s@]+@[^<>\s]+)>", r"\1", s)
    s = _see_tags(s)
    for mark in (r"\*\*\*", r"\*\*", r"(?<!\w)__", r"~~", r"\*", r"(?<!\w)_"):
        end = mark.replace(r"(?<!\w)", "") + (r"(?!\w)" if "_" in mark else "")
        s = re.sub(rf"{mark}(?=\S)(.+?)(?<=\S){end}", r"\1", s)
    s = unescape(s)
    while "\x01" in s:
        s = re.sub("\x01(\\d+)\x02", lambda m: keep[int(m[1])], s)
    return s


def _see_wiki(s: str) -> str:
    s = re.sub(r"<!--.*?-->|<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref\s*>", "", s, flags=_S | _I)
    s = re.sub(r"\{\{[^{}]*\}\}", "", s)
    s = re.sub(r"\[\[(?:File|Image|Category|Datei|Bild|Kategorie):[^\[\]]*\]\]", "", s, flags=_I)
    s = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", r"\1", s)
    s = re.sub(r"\[(?:https?:|ftp:|mailto:|//)[^\s\]]+(?: ([^\]]*))?\]", lambda m: m[1] or "", s)
    s = re.sub(r"'{2,5}", "", s)
    return unescape(_see_tags(s))


def visible(s: str, language: int) -> str:
    """Marked-up source to what a reader sees."""
    if language == HTML:
        return squeeze(unescape(_see_tags(s)))
    return squeeze({MARKDOWN: _see_markdown, WIKI: _see_wiki, LATEX: _see_latex}.get(language, str)(s))


ROLES = {
    "eq": "heading", "setext": "heading", "section": "heading", "tag_heading": "heading",
    "mixed": "list_item", "dash": "list_item", "num": "list_item", "item": "list_item", "tag_item": "list_item",
    "fence": "code_block", "verbatim": "code_block", "tag_pre": "code_block", "tag_syntaxhighlight": "code_block",
    "equation": "formula", "display": "formula", "bracket": "formula", "paren": "formula", "dollar": "formula", "tag_math": "formula",
}
_LISTS = frozenset({"tag_list", "env"})


def role(n: Node) -> str | None:
    if n.language == NONE or n.name == "nowiki":
        return None
    if n.syntax == "hash":
        return "list_item" if n.language == WIKI else "heading"
    return ROLES.get(n.syntax)


def shown(text: str, n: Node, kind: str) -> str:
    s, e = n.inner
    if kind in ("code_block", "formula"):
        body = text[s:e]
        if n.syntax == "tag_pre":
            body = unescape(re.sub(r"</?(?:code|span|b|i|em|strong|a|font|tt)\b[^<>]*>", "", body, flags=_I))
        elif n.syntax == "tag_math":
            body = unescape(body)
        return squeeze(body)
    parts, at = [], s
    for c in n.children:  # a list inside an item is not the item's own text
        if kind == "list_item" and c.syntax in _LISTS and c.start >= s and c.language != NONE:
            parts.append(text[at : c.start])
            at = max(at, c.end)
    body = "".join(parts) + text[at:e]
    if n.syntax == "hash" and n.language == MARKDOWN:
        body = re.sub(r"(?:^|[ \t]+)#+[ \t]*$", "", body)
    return visible(body, n.language)


#: A text without any of these holds no node.
_MAY = re.compile(r"[<\\$`*_#={\[|~+]|^[ \t]*(?:\d{1,9}[.)]|[-+>%])|^-{2,}[ \t]*$", _M)


def read(texts: list[str], trees: Boosted | None = None) -> list[list[Node]]:
    """Decoded nodes of each text."""
    trees = trees or model()
    parsed = [parse(t) if _MAY.search(t) else [] for t in texts]
    some = [i for i, p in enumerate(parsed) if p]
    if some:
        x = np.concatenate([features(texts[i], parsed[i]) for i in some])
        odds = np.where(POSSIBLE[x[:, : len(SYNTAX)].argmax(1)], trees.log_odds(x), -1e6)
        at = 0
        for i in some:
            decode(parsed[i], odds[at : at + len(parsed[i])])
            at += len(parsed[i])
    return parsed


def parts(text: str, nodes: list[Node]) -> list[tuple[str, str]]:
    """(part_kind, shown_text) of a decoded text, in order: markup languages first."""
    out = [("markup", LANGUAGES[k]) for k in sorted({n.language for n in nodes} - {NONE})]
    for n in nodes:
        if (kind := role(n)) and (said := shown(text, n, kind)):
            out.append((kind, said))
    return out


def clean(text: str | None, trees: Boosted | None = None) -> str | None:
    """Text without markup; headings, list items, code blocks and formulas stay, each in one plain form.

    Headings are lines of ``# text``, items ``- text``, code stands between lines of three backticks, formulas
    between dollar signs.  Null stays null.
    """
    if not text:
        return text
    given, text = text, one_line_end(text)
    nodes = read([text], trees)[0]
    if not any(n.language for n in nodes):
        return given
    languages = [n.language for n in nodes if n.language]
    main = max(set(languages), key=languages.count)
    out, at = [], 0
    for n in nodes:
        kind = role(n)
        drop = n.language != NONE and (n.syntax in ("tag_script", "percent") or n.syntax == "template")
        if not (kind or drop) or n.start < at:
            continue
        out.append(_plain_lines(text[at : n.start], main))
        if kind == "heading":
            out.append(f"\n# {shown(text, n, kind)}\n")
        elif kind == "list_item":
            inner = [c for c in n.children if c.syntax in _LISTS]
            out.append(f"\n- {shown(text, n, kind)}\n")
            if inner:  # the nested list's own items follow
                at = inner[0].start
                continue
        elif kind == "code_block":
            body = text[n.inner[0] : n.inner[1]]
            if n.syntax == "tag_pre":
                body = unescape(TAG.sub("", body))
            body = body.strip("\n")
            out.append(f"\n```\n{body}\n```\n")
        elif kind == "formula":
            out.append(f"${shown(text, n, kind)}$")
        at = n.end
    out.append(_plain_lines(text[at:], main))
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()


def _plain_lines(s: str, language: int) -> str:
    if language == LATEX:
        s = re.sub(r"\\(?:begin|end)\{[^}]*\}", "", s)
    if language == HTML:
        s = re.sub(r"</?(?:p|div|ul|ol|li|table|tr|section|article|blockquote)\b[^<>]*>", "\n\n", s, flags=_I)
    lead, tail = s[: len(s) - len(s.lstrip())], s[len(s.rstrip()) :] if s.strip() else ""
    body = "\n\n".join(visible(p, language) for p in re.split(r"\n\s*\n", s.strip()))
    return ("\n\n" if lead.count("\n") > 1 else "\n" if "\n" in lead else " " if lead else "") + body + ("\n\n" if tail.count("\n") > 1 else "\n" if "\n" in tail else " " if tail else "")


def one_line_end(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def without_title(text: str, title: str | None) -> str:
    """A chunk's text after the title line or ``[title]`` that was put before it."""
    first, _, rest = text.partition("\n")
    if re.fullmatch(r"\[[^\[\]]*\]", first) and (not rest or rest[0] == "\n"):
        return rest
    if title and first.strip() == title.strip():
        return rest
    return text


def find(df: DataFrame, item: str, text: str, in_field: str, title: str | None = None, texts: int = TRAINING_TEXTS, seed: int = SEED) -> DataFrame:
    """in_field, item_id, part_kind, shown_text: what each row's text holds, repeated parts of a row once.

    Null, empty and unmarked texts have no row.  ``title`` names the column of a title put before the text.
    Repeated rows give repeated parts.  The trees are fitted once a session to ``texts`` made-up texts.
    """
    trees = model(texts, seed)
    rows = df.select(F.col(item).cast("string").alias("item_id"), F.col(text).alias("text"), (F.col(title) if title else F.lit(None).cast("string")).alias("title"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                c = b.slice(lo, 1000)
                texts_ = [one_line_end(t or "") for t in c.column(1).to_pylist()]
                own = [without_title(t, h) if title else t for t, h in zip(texts_, c.column(2).to_pylist(), strict=True)]
                ids, kinds, said = [], [], []
                for i, t, nodes in zip(c.column(0).to_pylist(), own, read(own, trees), strict=True):
                    if nodes:
                        for k, s in dict.fromkeys(parts(t, nodes)):
                            ids.append(i)
                            kinds.append(k)
                            said.append(s)
                yield pa.record_batch([pa.array([in_field] * len(ids), pa.string()), pa.array(ids, pa.string()), pa.array(kinds, pa.string()), pa.array(said, pa.string())], ["in_field", "item_id", "part_kind", "shown_text"])

    return rows.mapInArrow(run, "in_field string, item_id string, part_kind string, shown_text string")


def cleaned(df: DataFrame, item: str, text: str, in_field: str, title: str | None = None, texts: int = TRAINING_TEXTS, seed: int = SEED) -> DataFrame:
    """in_field, item_id, clean_text: every row with its text in the form of ``clean``; null stays null.  A title put
    before the text stays as it is."""
    trees = model(texts, seed)
    rows = df.select(F.col(item).cast("string").alias("item_id"), F.col(text).alias("text"), (F.col(title) if title else F.lit(None).cast("string")).alias("title"))

    def one(t: str | None, h: str | None) -> str | None:
        if not t:
            return t
        whole = one_line_end(t)
        own = without_title(whole, h) if title else whole
        head = whole[: len(whole) - len(own)]
        new = clean(own, trees) or ""
        return t if new == own else head.rstrip("\n") + ("\n\n" if head else "") + new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [one(t, h) for t, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([pa.array([in_field] * b.num_rows, pa.string()), b.column(0), pa.array(out, pa.string())], ["in_field", "item_id", "clean_text"])

    return rows.mapInArrow(run, "in_field string, item_id string, clean_text string")


def clean_column(df: DataFrame, text: str, texts: int = TRAINING_TEXTS, seed: int = SEED) -> DataFrame:
    """df with ``text`` replaced by ``clean`` of it; all rows and columns stay."""
    trees = model(texts, seed)

    @F.pandas_udf("string")
    def run(s):
        return s.map(lambda t: clean(t, trees) if isinstance(t, str) else None)

    return df.withColumn(text, run(text))
