"""Problem 6: personal information inside free text.

``find`` marks mentions of e-mail addresses, phone numbers, identity numbers, postal addresses and people.
``replace`` puts surrogates for them: replacements made with a secret key that keep type, format, script and a
given name's gender.  Names are replaced part by part, and an initial by that of its part's surrogate, so one person
stays one person however the name is written.  A surrogate that two different originals would share, or that occurs in
the texts itself, is made anew, longer after a while, until all are distinct.  With ``placeholders=True`` typed
placeholders with a stable number come instead.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import cut

KINDS = ("email", "phone", "id_number", "address", "person")



def _ranges(fits: Callable[[str], bool]) -> str:
    """The inside of a character class: all characters below U+10000 that fit."""
    out, at = [], 0
    while at < 0x10000:
        if fits(chr(at)):
            first = at
            while at < 0x10000 and fits(chr(at)):
                at += 1
            out.append(re.escape(chr(first)) + (f"-{re.escape(chr(at - 1))}" if at - first > 1 else ""))
        at += 1
    return "".join(out)


_UP, _LOW = _ranges(str.isupper), _ranges(lambda c: c.islower() and c.isalpha())
_CAP = f"[{_UP}][{_LOW}]+"
_NAME = rf"(?:{_CAP}(?:[-'’]{_CAP})*|[{_UP}]{{2,}}(?:-[{_UP}]{{2,}})*)"
_NOT_IN = r"(?<![\w@.+-])"

EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9_][\w.+%-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w@])")
EMAIL_SPELT = re.compile(
    r"(?<![\w.+-])[A-Za-z0-9_][\w.+%-]* ?[\[({](?:at|AT)[\])}] ?[A-Za-z0-9-]+(?:(?: ?[\[({](?:dot|DOT)[\])}] ?|\.)[A-Za-z0-9-]+)+"
)
PHONE = re.compile(
    r"(?<![\w.+/-])(?:"
    r"(?:\+|00)[1-9]\d{0,2}[ .-]?(?:\(0?\d{1,5}\)|\d{1,5})(?:[ ./-]?\d{2,8}){1,4}"  # international
    r"|\(\d{2,5}\)[ -]?\d{3,8}(?:[ .-]\d{2,5}){0,2}"  # area code in brackets
    r"|\d{3}([.-])\d{3}\1\d{4}"  # three, three, four
    r"|0\d{1,4}[ /]\d{3,4}[ ]?\d{4}|0\d{1,4}/\d{3,8}"  # trunk zero
    r")(?![\w/]|[.-]\d)"
)
IDENTITY = re.compile(
    r"(?<![\w.+/-])(?:\d{3}([ -])\d{2}\1\d{4}"  # 3-2-4
    r"|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]"  # two letters, six digits, a letter
    r"|\d{2} \d{3} \d{3} \d{3}"  # 2-3-3-3
    r"|[A-Z]\d[A-Z]\d{2}[A-Z]\d{3}"
    r")(?![\w/]|[.-]\d)"
)
#: Also a number right after a word for such numbers.
LABELLED = re.compile(
    r"(?:\bID|SSN|[Pp]assport(?: or card)?(?: no\.?| number)?|[Tt]ax (?:number|ID)|[Ii]dentity (?:number|card)|[Ss]ocial security(?: number)?|[Nn]ational insurance(?: number)?)(?: no\.?)?:? "
    r"(?=[A-Z0-9 -]*\d)([A-Z0-9](?:[A-Z0-9]|[ -](?=[A-Z]?\d)){5,16}[A-Z0-9](?: [A-D](?![\w.]))?)(?![\w-])"
)
_CITY = rf"(?:(?:Upper|Lower|New|Old|Port|Saint|St\.|Mount|East|West|North|South|Great|Little|Fort|Lake|Bad|San|Santa) )?{_CAP}(?:-{_CAP})*(?: (?:City|Falls|Springs|Heights|Beach|Hills|Park|Bay|Junction|Valley|Harbou?r|Bridge|Green|Cross|Town|Ferry|Mills|Point)\b)?"
_STREET = r"(?:Street|St\.?|Road|Rd\.?|Row|Terrace|Way|Lane|Ln\.?|Avenue|Ave\.?|Close|Court|Ct\.?|Boulevard|Blvd\.?|Drive|Dr\.?|Square|Sq\.?|Quay|Crescent|Place|Pl\.?|Hill|Gardens|Walk|Parade|Highway|Hwy\.?|Circle|Cir\.?|Parkway|Pkwy\.?|Alley|Mews|Grove)"
_POST = r"(?: [A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}\b|,? [A-Z]{2},? \d{4,5}(?:-\d{4})?\b|,? \d{5}(?:-\d{4})?\b)?"
ADDRESS = re.compile(
    rf"(?<![\w.,-])\d{{1,5}}[A-Za-z]?,? (?:[NSEW]\.? )?(?:{_CAP} ){{1,4}}?{_STREET},(?: (?:Apt|Apartment|Unit|Suite|Flat|Floor)\.? \w{{1,5}},)? {_CITY}{_POST}"
    rf"|(?<!\w)\d{{1,4}}(?: ?bis| ?ter)?,? (?i:rue|avenue|boulevard|place|chemin|allée|quai|impasse)(?: (?:de la|de l'|du|des|de|d'))? ?{_CAP}(?:[ -]{_CAP})*, \d{{5}} {_CITY}"
)
ADDRESS_BOX = re.compile(rf"\b(?:PO|P\.O\.|Post Office) Box \d+, {_CITY}{_POST}")
ADDRESS_NUMBER_LAST = re.compile(
    rf"\b(?:(?:Am|An der|An den|Im|In der|Zum|Zur|Auf dem|Auf der|Alte|Alter|Altes|Neue|Neuer|Große|Kleine|Obere|Untere|Hinter der|Unter den) )?{_CAP}(?:-{_CAP})*(?:tr\.|\.)?(?: (?:Straße|Strasse|Str\.|Platz|Weg|Allee|Gasse|Ufer|Ring|Damm))? \d{{1,4}} ?[a-z]?, (?:D-)?\d{{5}} {_CITY}"
)
_FIVE_CITY = re.compile(rf", (?:D-)?\d{{5}} [{_UP}]")
#: Account and card numbers, which count if their check digits are right.
IBAN = re.compile(r"(?<![\w.+/-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
CARD = re.compile(r"(?<![\w.+/-])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|3\d{3}([ -])\d{6}\2\d{5})(?![\w/]|[.-]\d)")


def iban_ok(said: str) -> bool:
    s = said.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def card_ok(said: str) -> bool:
    digits = [int(c) for c in said if c.isdigit()]
    return sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0


#: Words that lead to a person's name, and words that are no part of one though they begin a sentence.
LEADS = ["by", "cc", "to", "from", "with", "owe", "Reviewer:", "Author:", "Attendees:", "Contact:", "Assignee:", "Dear", "ask", "asked", "told", "met", "per", "for", "and", "thanks"]
TITLES = r"(?:Dr|Mr|Mrs|Ms|Mx|Prof|Herr|Frau|Mme|Sir)\.?"
_FOLLOW_WORDS = tuple(f" {w}" for w in "will said says wrote agreed replied thinks noted signed".split())
FOLLOWS = rf"(?=(?:{'|'.join(_FOLLOW_WORDS)})\b)"
NO_NAME = frozenset(
    "a after all an and any are as at be before between but by call can cc checksum contact could dr each every fax for from he her his how i if in is it its "
    "item lane left left met minutes moved mr mrs ms my no nobody not of on once only or order our parcels passport pin ping please range reviewer rows see send she since "
    "so spoke ssn tax tel thanks that the their then there these they this those ticket tkt to two until use was we were what when where which while who whoever "
    "why will with without write you your id invoice build according bounced address".split()
)


def _either_case(names: Iterable[str]) -> str:
    both = {n for x in names if x for n in (x, x.upper())}
    return "|".join(re.escape(n) for n in sorted(both, key=lambda n: (-len(n), n))) or r"(?!)"


class Finder:
    """Finds mentions with a lexicon of given and family names; people outside it are found where words point to them."""

    def __init__(self, given: Iterable[str], family: Iterable[str]) -> None:
        given, self.family = sorted(set(given)), {f.lower() for f in family if f}
        self.given = {g.lower() for g in given if g}
        g = _either_case(given)
        self.first_last = re.compile(rf"{_NOT_IN}(?:{g})(?: [{_UP}]\.)? (?P<f>{_NAME})(?!\w)")
        self.last_first = re.compile(rf"{_NOT_IN}(?P<f>{_NAME}), (?:{g})(?![\w-])")
        self.initial = re.compile(rf"{_NOT_IN}[{_UP}]\. (?P<f>{_NAME})(?!\w)")
        shape = rf"{_NAME}(?: [{_UP}]\.)? {_NAME}|{_NAME}, {_NAME}|[{_UP}]\. {_NAME}"
        lead = "|".join(re.escape(x) for x in LEADS)
        self.led = re.compile(rf"(?:(?<!\w)(?:{lead}) (?:{TITLES} )?|(?<!\w){TITLES} )(?P<n>{shape})(?!\w)")
        self.followed = re.compile(rf"{_NOT_IN}(?P<n>{shape})(?!\w){FOLLOWS}")
        self.parts = re.compile(_NAME)

    def _plausible(self, text: str) -> bool:
        words_ = self.parts.findall(text)
        return not any(w.lower() in NO_NAME for w in words_) and len({w.isupper() for w in words_}) < 2

    def people(self, text: str) -> list[tuple[int, int]]:
        got: list[tuple[int, int, int]] = []  # rank, start, end: lower ranks win overlaps
        ends_lead = {m.start("n"): m.end("n") for m in self.led.finditer(text) if self._plausible(m["n"])}
        for m in self.first_last.finditer(text):
            if self._plausible(m[0]):
                got.append((0 if m["f"].lower() in self.family else 2, m.start(), m.end()))
        for m in self.last_first.finditer(text):
            if self._plausible(m[0]):
                known = m["f"].lower() in self.family
                if known or m.start() in ends_lead or FOLLOW.match(text, m.end()):
                    got.append((0 if known else 1, m.start(), m.end()))
        for m in self.initial.finditer(text):
            if self._plausible(m["f"]) and (m["f"].lower() in self.family or m.start() in ends_lead or FOLLOW.match(text, m.end())):
                got.append((3, m.start(), m.end()))
        for start, end in ends_lead.items():  # neither part need be known, but one must be, or a title or the sentence must tell
            n = text[start:end]
            parts = [p.lower() for p in self.parts.findall(n)]
            titled = re.search(rf"{TITLES} $", text[max(0, start - 6) : start])
            if titled or any(p in self.family or p in self.given for p in parts) and len(parts) == 2:
                got.append((4, start, end))
        for m in self.followed.finditer(text) if any(x in text for x in _FOLLOW_WORDS) else ():
            parts = [p.lower() for p in self.parts.findall(m["n"])]
            if self._plausible(m["n"]) and any(p in self.family or p in self.given for p in parts):
                got.append((4, m.start("n"), m.end("n")))
        out: list[tuple[int, int]] = []
        for _, s, e in sorted(got, key=lambda x: (x[0], x[1] - x[2], x[1])):
            if all(e <= a or s >= b for a, b in out):
                out.append((s, e))
        return out

    def __call__(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind) of each mention, in order, without overlaps; runs of blanks count as one blank."""
        if not text:
            return []
        if _WIDE.search(text):
            at, parts, last = [], [], 0
            for m in _WIDE.finditer(text):
                parts += [text[last : m.start()], " "]
                at += [*range(last, m.start()), m.start()]
                last = m.end()
            at += range(last, len(text) + 1)
            found = self._search("".join(parts) + text[last:])
            return [(at[s], at[e - 1] + 1, kind) for s, e, kind in found]
        return self._search(text)

    def _search(self, text: str) -> list[tuple[int, int, str]]:
        spans: list[tuple[int, int, str]] = []

        def add(kind: str, found: Iterable[tuple[int, int]]) -> None:
            for s, e in found:
                if all(e <= a or s >= b for a, b, _ in spans):
                    spans.append((s, e, kind))

        digits = any(c.isdigit() for c in text)
        if "@" in text:
            add("email", (m.span() for m in EMAIL.finditer(text)))
        if any(x in text for x in ("at]", "at)", "at}", "AT]", "AT)", "AT}")):
            add("email", (m.span() for m in EMAIL_SPELT.finditer(text)))
        if digits:
            add("address", (m.span() for m in ADDRESS.finditer(text)))
            if "Box " in text:
                add("address", (m.span() for m in ADDRESS_BOX.finditer(text)))
            if _FIVE_CITY.search(text):
                add("address", (m.span() for m in ADDRESS_NUMBER_LAST.finditer(text)))
            add("id_number", (m.span() for m in IBAN.finditer(text) if iban_ok(m[0])))
            add("id_number", (m.span() for m in CARD.finditer(text) if card_ok(m[0])))
            add("id_number", (m.span() for m in IDENTITY.finditer(text)))
            if any(x in text for x in ("ID", "SSN", "assport", "ax number", "dentity", "ocial sec", "ational ins")):
                add("id_number", (m.span(1) for m in LABELLED.finditer(text)))
            add("phone", (m.span() for m in PHONE.finditer(text) if 7 <= sum(c.isdigit() for c in m[0]) <= 15))
        add("person", self.people(text))
        return sorted(spans)


FOLLOW = re.compile(FOLLOWS)
_WIDE = re.compile(r"[ \t\xa0\u2000-\u200a\u202f]{2,}|[\t\xa0\u2000-\u200a\u202f]")


def lexicon(people: DataFrame) -> tuple[list[str], list[str]]:
    """Given and family names; ``people`` is the store's own list, which its users keep, not the texts."""
    rows = people.select("given_name", "family_name").distinct().toLocalIterator()
    pairs_ = [(r[0], r[1]) for r in rows]
    return sorted({g for g, _ in pairs_ if g}), sorted({f for _, f in pairs_ if f})


def find(df: DataFrame, people: DataFrame, key: str = "rowid", text: str = "content") -> DataFrame:
    """key, start, end, pii_kind, found_text: a row per mention, offsets in code points.

    Null and empty texts have none.  Repeated rows are searched each.  Other columns are ignored.
    """
    given, family = lexicon(people)
    made: list[Finder] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Finder(given, family))
        for b in batches:
            keys, at, until, kind, said = [], [], [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for s, e, what in made[0](t):
                    keys.append(k)
                    at.append(s)
                    until.append(e)
                    kind.append(what)
                    said.append(t[s:e])
            yield pa.record_batch(
                [pa.array(keys, b.column(0).type), pa.array(at, pa.int32()), pa.array(until, pa.int32()), pa.array(kind, pa.string()), pa.array(said, pa.string())],
                [key, "start", "end", "pii_kind", "found_text"],
            )

    rows = df.select(key, text)
    return rows.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, start int, end int, pii_kind string, found_text string")


# Surrogates

#: Syllables of made-up names and their endings, by script: beginnings, vowels, ends of men's and of women's names.
SYLLABLES = {
    "LATIN": ("b br d dr f g gr h j k l m n p r s t tr v z".split(), "a e i o u".split(), "l m n r s".split(), "a e".split()),
    "CYRILLIC": ("б бр в г гр д др ж з к л м н п р с т тр ф х".split(), "а е и о у".split(), "л м н р с".split(), "а я".split()),
    "GREEK": ("β γ δ ζ θ κ λ μ ν π ρ σ τ φ χ".split(), "α ε ι ο υ".split(), "ν ρ ς".split(), "α η".split()),
}
ALPHABETS = {"LATIN": "abcdefghijklmnopqrstuvwxyz", "CYRILLIC": "абвгдежзийклмнопрстуфхцчшщэюя", "GREEK": "αβγδεζηθικλμνξοπρστυφχψω"}
_WOMEN = {"LATIN": "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüý", "CYRILLIC": "аяеэиіїюь", "GREEK": "αηωίάή"}
#: Rounds after which surrogates of a fixed format get longer.
GROW = 4


def _number(secret: bytes, *parts: str) -> int:
    return int.from_bytes(hmac.new(secret, "\x1f".join(parts).encode("utf-8", "surrogatepass"), hashlib.sha256).digest(), "big")


def script_of(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0].split("-")[0]


@lru_cache(256)
def _letters_like(c: str) -> str:
    """Letters of the character's script and kind that stand near it in Unicode."""
    page = ord(c) & ~0xFF
    own = [chr(o) for o in range(page, page + 0x100) if unicodedata.category(chr(o)) == unicodedata.category(c) and script_of(chr(o)) == script_of(c)]
    return "".join(own) or c


@lru_cache(4096)
def _letter(secret: bytes, c: str) -> str:
    """Another letter of the same script and case: a keyed permutation of the alphabet, by the letter without accents."""
    low = unicodedata.normalize("NFD", c.lower())[:1]
    own = ALPHABETS.get(script_of(low), "")
    if low not in own:
        own, low = _letters_like(c.lower()[:1]), c.lower()[:1]
    order = sorted(own, key=lambda x: _number(secret, "letter", x))
    if order.index(low) == own.index(low) and len(own) > 1:  # no letter stays, for one that does would be read
        order = order[1:] + order[:1]
    to = order[own.index(low)] if order[own.index(low)] != low else order[own.index(low) - 1]
    return to.upper() if c.isupper() else to


def _syllables(secret: bytes, n: int, *parts: str, script: str = "LATIN", end: int = 2) -> str:
    x, out = _number(secret, *parts), ""
    onsets, nuclei, *ends = SYLLABLES[script]
    for _ in range(n):
        x, a = divmod(x, len(onsets))
        x, b = divmod(x, len(nuclei))
        out += onsets[a] + nuclei[b]
    last = ends[end - 2]
    return out + last[x % len(last)]


PIECES = re.compile(r"([^\s,.'’-]+)")


def piece_surrogate(secret: bytes, piece: str, role: str, gender: str | None, attempt: int) -> str:
    """The surrogate, in small letters, of one piece (in small letters) of a given or family name."""
    script = script_of(piece[0])
    if script not in SYLLABLES:  # letter by letter within the script; longer with each few attempts
        x, out = _number(secret, role, piece, str(attempt)), []
        for c in piece[1:] + piece[-1] * (attempt // GROW):
            near = _letters_like(c)
            x, at = divmod(x, len(near))
            out.append(near[at])
        return _letter(secret, piece[0]) + "".join(out)
    female = gender == "f" if gender else piece[-1] in _WOMEN[script]
    body = _syllables(secret, (1 if role == "given" else 2) + attempt // 2, role, piece, str(attempt), script=script, end=3 if role == "given" and female else 2)
    nuclei = SYLLABLES[script][1]
    at = next(i for i, c in enumerate(body) if c in nuclei)
    first = _letter(secret, piece[0])
    return first + (body[at + 1 :] if first in nuclei else body[at:])


def person_pieces(said: str) -> list[tuple[str, str]]:
    """(role, piece in small letters) of a mention's name pieces in order; initials have the role ``initial``."""
    family_first = "," in said
    out, parts_ = [], re.split(r"(,? )", said)
    words_ = parts_[::2]
    for i, w in enumerate(words_):
        role = ("family" if i == 0 else "given") if family_first else "family" if i == len(words_) - 1 and len(words_) > 1 else "given"
        for p in PIECES.findall(w):
            out.append(("initial" if len(p) == 1 else role, p.lower()))
    return out


def person_surrogate(secret: bytes, said: str, to: list[str | None]) -> str:
    """The mention with its pieces replaced, letter case and punctuation as in the original."""
    new = iter(to)

    def one(m: re.Match) -> str:
        p, s = m[0], next(new)
        if len(p) == 1:
            return _letter(secret, p)
        return s.upper() if p.isupper() else s.capitalize() if p[0].isupper() else s

    return PIECES.sub(one, said)


def canonical(kind: str, said: str) -> str:
    """One spelling per entity: letter case, order and punctuation of a mention do not matter."""
    if kind == "person":
        m = re.fullmatch(r"(?P<f>[^,]+), (?P<g>.+)", said) or re.fullmatch(r"(?P<g>.+) (?P<f>\S+)", said)
        return f"{m['g'].split(' ')[0]} {m['f']}".lower() if m else said.lower()
    if kind == "email":
        return re.sub(r" ?[\[({]dot[\])}] ?", ".", re.sub(r" ?[\[({]at[\])}] ?", "@", said.lower()))
    if kind == "phone":
        return re.sub(r"^00", "+", re.sub(r"[^\d+]", "", said))
    if kind == "id_number":
        return re.sub(r"\W", "", said).upper()
    return re.sub(r"\s+", " ", said).lower()


def surrogate(secret: bytes, kind: str, said: str, attempt: int = 0) -> str:
    """A replacement, for other kinds than people, of the same type and format; all forms of an entity get the same."""
    stream = _number(secret, kind, canonical(kind, said), str(attempt))
    digits = f"{stream:078d}" * (1 + len(said) // 78)
    more = "" if attempt < GROW else "-" + digits[-2 * (attempt - GROW + 1) :]
    if kind == "email":
        m = re.fullmatch(r"(.+?)( ?[\[({](?:at|AT)[\])}] ?|@)(.+)", said)
        return f"{_syllables(secret, 2 + attempt, 'mail', canonical(kind, said), str(attempt))}{m[2]}mail{digits[:6]}.example" if m else said
    if kind == "phone":
        # country code and area code stay readable, the subscriber's digits are new
        at = [i for i, c in enumerate(said) if c.isdigit()]
        new = f"{_number(secret, kind, canonical(kind, said)[-7:], str(attempt)):078d}"[-7:]
        out = list(said)
        for i, c in zip(at[-7:], new, strict=False):
            out[i] = c
        return "".join(out) + more
    if kind == "id_number":
        out, letters = [], _number(secret, kind, "letters", canonical(kind, said), str(attempt))
        n = 0
        for c in said:
            if c.isdigit():
                out.append(digits[n])
                n += 1
            elif c.isalpha():
                letters, x = divmod(letters, 20)
                new = "ABCDEFGHJKLMNPRSTVWZ"[x]
                out.append(new if c.isupper() else new.lower())
            else:
                out.append(c)
        return "".join(out) + more
    out, skip = [], {"street", "st", "road", "rd", "row", "terrace", "way", "lane", "avenue", "ave", "close", "court", "ct", "blvd", "drive", "apt", "po", "box", "am", "alte", "straße", "str", "rue", "de", "la"}
    for i, piece in enumerate(re.split(r"(\w+)", said)):
        if piece.isdigit():
            out.append("".join(digits[(i * 7 + j) % len(digits)] for j in range(len(piece))).replace("0", "1", 1))
        elif re.fullmatch(_CAP, piece) and piece.lower() not in skip:
            script = script_of(piece[0])
            out.append(_syllables(secret, 2 + attempt // 2, "place", piece.lower(), str(attempt), script=script if script in SYLLABLES else "LATIN").capitalize())
        else:
            out.append(piece)
    return "".join(out)


def _settle(left: DataFrame, make: Callable[[int], DataFrame], owner: str, group: str, real: DataFrame) -> DataFrame:
    """Rows of ``make`` (owner, group, surrogate and others) whose surrogates no other owner of the group has and that
    are not ``real`` (group, surrogate): owners of others are tried again until there are none.

    Spaces of surrogates grow with the attempts, so it ends; of equal ones the smallest owner keeps the surrogate.
    """
    done, attempt = None, 0
    while True:
        tried = cut(make(left, attempt))
        first = tried.groupBy(group, "surrogate").agg(F.min(owner).alias("_first"))
        if done is not None:
            first = first.join(done.select(group, "surrogate", F.lit(True).alias("_taken")).distinct(), [group, "surrogate"], "left")
        else:
            first = first.withColumn("_taken", F.lit(None).cast("boolean"))
        first = first.join(real.select(group, "surrogate", F.lit(True).alias("_real")).distinct(), [group, "surrogate"], "left")
        bad = tried.join(first, [group, "surrogate"]).filter((F.col(owner) != F.col("_first")) | F.col("_taken") | F.col("_real")).select(group, owner).distinct()
        bad = cut(bad)
        good = tried.join(bad, [group, owner], "left_anti")
        done = cut(good if done is None else done.unionByName(good))
        if bad.isEmpty():
            return done
        if attempt > 200:
            raise RuntimeError("surrogates still collide after 200 attempts")
        left, attempt = cut(left.join(bad, [group, owner], "left_semi")), attempt + 1


def surrogates(mentions: DataFrame, secret: bytes, genders: dict[str, str] | None = None) -> DataFrame:
    """pii_kind, found_text, surrogate: of all mentions, with distinct surrogates for distinct entities.

    People are replaced piece by piece of their names, others as wholes.  No surrogate is a piece or a mention that
    the texts have.  ``genders``: f or m of given names in small letters; of others the usual ending tells.
    """
    every = cut(mentions.select("pii_kind", "found_text").distinct())
    genders = genders or {}

    # people
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(said, i, role, p) for said in b.column(0).to_pylist() for i, (role, p) in enumerate(person_pieces(said))]
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string()))], ["found_text", "i", "role", "piece"])

    named = cut(every.filter("pii_kind = 'person'").select("found_text").mapInArrow(split, "found_text string, i int, role string, piece string"))

    def make_pieces(left: DataFrame, attempt: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                new = [piece_surrogate(secret, p, r, genders.get(p), attempt) for r, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                yield pa.record_batch([*b.columns, pa.array(new, pa.string())], ["role", "piece", "surrogate"])

        return left.select("role", "piece").mapInArrow(run, "role string, piece string, surrogate string")

    pieces_ = cut(named.filter("role <> 'initial'").select("role", "piece").distinct())
    roles = F.explode(F.array(F.lit("given"), F.lit("family"))).alias("role")
    known = _settle(pieces_, make_pieces, "piece", "role", pieces_.select(F.col("piece").alias("surrogate"), roles))
    per = named.join(known, ["role", "piece"], "left").groupBy("found_text").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "surrogate"))), lambda x: x["surrogate"]).alias("to"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = b.column(0).to_pylist()
            new = [person_surrogate(secret, s, t) for s, t in zip(said, b.column(1).to_pylist(), strict=True)]
            yield pa.record_batch([pa.array(["person"] * len(said), pa.string()), b.column(0), pa.array(new, pa.string())], ["pii_kind", "found_text", "surrogate"])

    people = per.mapInArrow(join, "pii_kind string, found_text string, surrogate string")

    # the other kinds
    def make(left: DataFrame, attempt: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                kinds, said = b.column(0).to_pylist(), b.column(1).to_pylist()
                new = [surrogate(secret, k, s, attempt) for k, s in zip(kinds, said, strict=True)]
                yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(new, pa.string())], ["pii_kind", "found_text", "entity", "surrogate"])

        return left.select("pii_kind", "found_text", "entity").mapInArrow(run, "pii_kind string, found_text string, entity string, surrogate string")

    def entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = [canonical(k, s) for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(e, pa.string())], ["pii_kind", "found_text", "entity"])

    others = cut(every.filter("pii_kind <> 'person'").mapInArrow(entities, "pii_kind string, found_text string, entity string"))
    done = _settle(others, make, "entity", "pii_kind", others.select("pii_kind", F.col("found_text").alias("surrogate")))
    return people.unionByName(done.select("pii_kind", "found_text", "surrogate"))


def replace(df: DataFrame, people: DataFrame, secret: bytes, key: str = "rowid", text: str = "content", placeholders: bool = False) -> DataFrame:
    """key, text with every mention replaced; texts without a mention stay, null stays null.

    ``key`` must be unique.  A row's mentions are put together by its key, so a group is one text's.  ``people`` may
    have a gender (f or m); else a given name's usual ending tells.
    """
    mentions = cut(find(df, people, key, text))
    if placeholders:

        def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n = [f"[{k.upper()}_{_number(secret, k, canonical(k, s)):078d}"[: len(k) + 14] + "]" for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.string())], ["pii_kind", "found_text", "surrogate"])

        table = mentions.select("pii_kind", "found_text").distinct().mapInArrow(label, "pii_kind string, found_text string, surrogate string")
    else:
        known = people.select(F.lower("given_name"), F.lower(F.substring("gender", 1, 1))).toLocalIterator() if "gender" in people.columns else []
        table = surrogates(mentions, secret, {g: x for g, x in known if g and x in ("f", "m")})
    own = mentions.join(table, ["pii_kind", "found_text"]).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end", "surrogate"))).alias("m"))
    rows = df.select(key, text).join(own, key, "left")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if t is not None and m:
                    parts, at = [], 0
                    for x in m:
                        parts += [t[at : x["start"]], x["surrogate"]]
                        at = x["end"]
                    t = "".join(parts) + t[at:]
                out.append(t)
            yield pa.record_batch([b.column(0), pa.array(out, pa.string())], [key, text])

    return rows.mapInArrow(rewrite, f"{key} {dict(df.dtypes)[key]}, {text} string")
