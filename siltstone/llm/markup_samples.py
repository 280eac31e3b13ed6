"""Made-up marked-up texts for training, with the language of every character."""

from __future__ import annotations

import html
import random
from collections.abc import Iterator

from siltstone.llm.markup import HTML, LATEX, MARKDOWN, NONE, WIKI

_WORDS = "harvest ledger window paper bright copper silent river morning table engine garden letter signal mirror pocket thunder velvet orange winter listen follow under beyond between quickly rather almost never about".split()
_NAMES = "Anta Borel Cindra Dorvik Elmar Fostin Gralla Hemmel".split()


class _Maker:
    def __init__(self, r: random.Random) -> None:
        self.r, self.out = r, []

    def put(self, text: str, language: int = NONE) -> None:
        self.out.append((text, language))

    def words(self, lo: int = 2, hi: int = 6) -> str:
        w = self.r.choices(_WORDS, k=self.r.randint(lo, hi))
        return " ".join([w[0].capitalize(), *w[1:]])

    def sentence(self) -> str:
        return f"{self.words(5, 14)} {self.r.choice(_NAMES)} {self.r.randint(1, 999)}."

    def decoy(self) -> str:
        n = self.r.randint(2, 90)
        return self.r.choice([
            f"Prices run from ${n} to ${n + 4}, and {{rate}} is added.", f"That is ${n} for {n} * 3 of them, or ${n / 7:.2f} each.", f"Set limit_per_row == {n} if a & b hold.",
            f"From {n} -> {n + 1}; {n}% remain.", f"Case #{n} and case #{n + 1} are one.", "See D:\\work\\next\\draft for it.", f"If {n} < {n + 5} and {n} > 1, stop.",
            f"Reply came from <user{n}@mail.invalid> twice.", f"https://site.example/{n}/page_two_of_three", "#12 was first.", f"[note {n}] was added.", f"x_{n} and y_{n} differ; 3 * 4 * 5 = 60.",
            f"Reply from <user{n} [at] mail [dot] invalid>.", f"The value = {n} holds.", f"Q{n}: yes; {n}/2 no.",
        ])

    def code(self) -> str:
        a, b = self.r.choices(_WORDS, k=2)
        return self.r.choice([
            f"def {a}({b}):\n    # first\n    return {b}[0]", f"SELECT {a}, max(x)\nFROM {b}\nWHERE y < 4 AND z <> 'q';", f"* {a} == 1\n* {b} != 2", f"# {a}\necho \"$HOME\" > {b}.txt",
            f"<section class=\"{a}\">\n  <p>{b} &amp; 3</p>\n</section>", f"[[{a}]]\nkind = \"{b}\"\nn = 4", f"for i in $(cat {a}); do\n  echo \"# $i\"\ndone", f"## {a}\n- {b}\n- $x = 4", f"int {a} = *{b};\nx = a_b_c;",
        ])

    def math(self) -> str:
        a, b = self.r.choices("abcdkmnpqrstuvwxyz", k=2)
        n = self.r.randint(2, 99)
        return self.r.choice([f"{a}_{{{n}}} = {n} - \\mu^{{{b}}}", f"\\frac{{{a} + {n}}}{{{b}}}", f"\\sum_{{{a}=1}}^{{{n}}} {b}_{a}", f"O({a} \\log {b})", f"{a}^2 + {b}^2 \\ge {n}", f"{a} \\times {n}", f"{a} < {b}", f"\\sqrt{{{a}}}", f"f({a}) = {n}"])

    def inline(self, language: int, formulas: bool = True) -> None:
        w, r = self.words(1, 3), self.r
        n = r.randint(1, 99)
        if language == HTML:
            forms = [f"<b>{w}</b>", f"<em class='k'>{w}</em>", f"<a href=\"https://h.example/?a={n}&amp;b=2\">{w}</a>", f"<code>{w.lower().replace(' ', '_')}()</code>", f"<strong>{w}</strong>", f"<span id=\"s{n}\">{w}</span>", f"{w}<br/>", f"<sup>{n}</sup>"]
        elif language == MARKDOWN:
            forms = [f"**{w}**", f"*{w}*", f"_{w}_", f"__{w}__", f"`{w.lower().replace(' ', '_')}()`", f"[{w}](https://h.example/{n})"] + [f"${self.math()}$"] * (2 * formulas)
        elif language == WIKI:
            forms = [f"'''{w}'''", f"''{w}''", f"[[{w}|other {w}]]", f"[https://h.example/{n} {w}]", f"<code>{w.lower().replace(' ', '_')}()</code>", f"[[{w}]]"] + [f"<math>{self.math()}</math>", f"<ref>{w}</ref>"] * formulas
        else:
            forms = [f"\\textbf{{{w}}}", f"\\emph{{{w}}}", f"\\texttt{{{w.lower().replace(' ', chr(92) + '_')}}}", f"\\href{{https://h.example/{n}}}{{{w}}}", f"~\\cite{{r{n}}}"] + [f"${self.math()}$", f"\\({self.math()}\\)"] * formulas
        self.put(r.choice(forms), language)

    def paragraph(self, language: int, marks: bool) -> None:
        r = self.r
        if language == HTML:
            self.put("<P>" if r.random() < 0.1 else "<p>" if r.random() < 0.9 else "<p align=\"right\">", HTML)
        if language == MARKDOWN and r.random() < 0.08:
            self.put("> ", MARKDOWN)
        for i in range(r.randint(1, 4)):
            self.put((" " if i else "") + (self.decoy() if r.random() < 0.12 and language in (NONE, MARKDOWN) else self.sentence()))
            if marks and language != NONE and r.random() < 0.8:
                self.put(" ")
                self.inline(language)
        if language == HTML and r.random() < 0.85:
            self.put("</p>", HTML)
        if language == LATEX and r.random() < 0.1:
            self.put("\n")
            self.put("% later: look", LATEX)

    def line_text(self, language: int) -> None:
        self.put(self.words())
        if self.r.random() < 0.4:
            self.put(" ")
            self.inline(language, False)
            if self.r.random() < 0.4:
                self.put(self.r.choice({HTML: [" &amp; ", " &lt; "], LATEX: [" \\& ", " \\textless{} "]}.get(language, [" & ", " and "])), LATEX if language == LATEX else NONE)
                self.put(self.words(1, 2))

    def heading(self, language: int) -> None:
        r, n = self.r, self.r.randint(1, 4)
        if language == HTML:
            self.put(f"<h{n}>" if r.random() < 0.5 else f"<h{n} id=\"s{n}\">", HTML)
            self.line_text(HTML)
            self.put(f"</h{n}>", HTML)
        elif language == MARKDOWN and r.random() < 0.2:
            t = self.words()
            self.put(f"{t}\n{r.choice('=-') * max(3, len(t))}", MARKDOWN)
        elif language == MARKDOWN:
            self.put("#" * n + " ", MARKDOWN)
            self.line_text(MARKDOWN)
            if r.random() < 0.2:
                self.put(" " + "#" * n, MARKDOWN)
        elif language == WIKI:
            e, gap = "=" * (n + 1), r.choice(["", " "])
            self.put(e + gap, WIKI)
            self.line_text(WIKI)
            self.put(gap + e, WIKI)
        else:
            self.put("\\" + r.choice(["section", "subsection", "subsubsection", "paragraph"]) + r.choice(["", "*"]) + "{" + self.words() + "}" + (f"\\label{{s:{n}}}" if r.random() < 0.3 else ""), LATEX)

    def items(self, language: int) -> None:
        r = self.r
        n, ordered = r.randint(2, 5), r.random() < 0.35
        if language == HTML:
            tag = "ol" if ordered else "ul"
            self.put(f"<{tag}>", HTML)
            for _ in range(n):
                self.put("<li>", HTML)
                self.line_text(HTML)
                if r.random() < 0.8:
                    self.put("</li>", HTML)
            self.put(f"</{tag}>", HTML)
        elif language == LATEX:
            env = "enumerate" if ordered else "itemize"
            self.put(f"\\begin{{{env}}}\n", LATEX)
            for _ in range(n):
                self.put("\\item ", LATEX)
                self.line_text(LATEX)
                self.put("\n")
            self.put(f"\\end{{{env}}}", LATEX)
        else:
            mark, dot = r.choice("*-+" if language == MARKDOWN else "*"), r.choice(".)")
            for i in range(n):
                deep = i > 0 and r.random() < 0.2
                if language == WIKI:
                    m = ("#" if ordered else "*") * (2 if deep else 1) + " "
                else:
                    m = ("   " if deep else "") + (f"{i + 1}{dot} " if ordered else f"{mark} ")
                self.put(m, language)
                self.line_text(language)
                if language == MARKDOWN and r.random() < 0.1:
                    self.put("\n" + " " * (len(m) + r.randint(0, 2)) + self.words().lower())
                self.put("\n" if i < n - 1 else "")

    def block_code(self, language: int) -> None:
        r, c = self.r, self.code()
        if language == HTML:
            self.put("<pre><code>", HTML)
            self.put(html.escape(c, False))
            self.put("</code></pre>", HTML)
        elif language == MARKDOWN:
            f = r.choice(["```", "~~~"])
            self.put(f + r.choice(["", "python", "text"]) + "\n", MARKDOWN)
            self.put(c + "\n")
            self.put(f, MARKDOWN)
        elif language == WIKI:
            self.put(r.choice(["<syntaxhighlight lang=\"text\">\n", "<syntaxhighlight>\n"]), WIKI)
            self.put(c + "\n")
            self.put("</syntaxhighlight>", WIKI)
        else:
            env = r.choice(["verbatim", "lstlisting"])
            self.put(f"\\begin{{{env}}}\n", LATEX)
            self.put(c + "\n")
            self.put(f"\\end{{{env}}}", LATEX)

    def block_math(self, language: int) -> None:
        m = self.math()
        if language == MARKDOWN:
            self.put(self.r.choice([f"$$\n{m}\n$$", f"$${m}$$"]), MARKDOWN)
        elif language == WIKI:
            self.put(f"<math>{m}</math>", WIKI)
        elif language == LATEX:
            self.put(self.r.choice([f"\\[ {m} \\]", f"\\begin{{equation}}\n{m}\n\\end{{equation}}"]), LATEX)

    def extra(self, language: int) -> None:
        w = self.words(1, 2)
        if language == HTML:
            self.put(self.r.choice(["<!-- made -->", "<style>.a{color:red}</style>", "<script>go('1');</script>", "<hr/>"]), HTML)
        elif language == MARKDOWN:
            form, lang = self.r.choice([(f"![{w}](pics/1.png)", MARKDOWN), (f"<p align=\"left\">{self.sentence()}</p>", HTML), (f"<details><summary>{w}</summary>{self.sentence()}</details>", HTML)])
            self.put(form, lang)
        elif language == WIKI:
            self.put(self.r.choice([f"{{{{Box|name={w}|n=3}}}}", f"[[Category:{w}]]"]), WIKI)
        elif language == LATEX:
            self.put("% note: later", LATEX)

    def text(self) -> None:
        r = self.r
        language = r.choices([NONE, HTML, MARKDOWN, WIKI, LATEX], [3, 2, 3, 3, 2])[0]
        if language == MARKDOWN and r.random() < 0.15:  # a heading right before a list
            self.put("#" * r.randint(1, 2) + " " + self.words(1, 3), MARKDOWN)
            self.put(r.choice(["\n", "\n\n"]))
            self.items(MARKDOWN)
            if r.random() < 0.5:
                return
            self.put("\n\n")
        if language == HTML and r.random() < 0.3:
            self.put("<div class=\"c\">", HTML)
        gap = r.choice(["\n", "", "\n\n"]) if language == HTML else "\n" if language in (MARKDOWN, WIKI) and r.random() < 0.25 else "\n\n"
        for i in range(r.choice([1, 1, 2, 3, 5, 8])):
            if i:
                self.put(gap)
            if language == NONE:
                self.paragraph(NONE, False)
                continue
            r.choices([lambda k: self.paragraph(k, True), self.heading, self.items, self.block_code, self.block_math, self.extra], [5, 3, 3, 2, 2, 1])[0](language)


def labelled(n: int, seed: int) -> Iterator[tuple[str, list[int]]]:
    """Texts with the language of each character; the texts are the same for the same arguments."""
    r = random.Random(seed)
    for _ in range(n):
        m = _Maker(r)
        m.text()
        text = "".join(t for t, _ in m.out)
        marks = [k for t, k in m.out for _ in t]
        yield text, [*marks, NONE]
