"""Problem 2: time texts of many forms, precisions and zones to one instant each.

Every text becomes the array of all its valid readings: both date orders, the source's zone and UTC, all meanings of
a zone's abbreviation, both folds of a daylight-saving change.  The source's settings are evidence: a reading
against them costs CONTRADICTED.  A Viterbi path over the source's record order picks one reading of each text, at a
cost for switching the date order and for jumping back in time.

The path is exact although no task holds a whole source: where all readings of a record continue the same reading
of the one before, what stands before is settled, and each partition of the ordered records sends the driver only
the costs between its first and last readings (at most six by six numbers a partition and source), from
which the readings at the partitions' edges follow.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import cut, width

EPOCH = datetime(1970, 1, 1)
#: Zone abbreviations with one usual meaning, in minutes east of UTC.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720,
    "NZDT": 780, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480,
    "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
#: Other zones that use such an abbreviation, in minutes east of UTC.
OTHER_MEANINGS = {"IST": [120, 60], "CST": [480, -300], "BST": [360], "EST": [600], "AST": [180], "PST": [480], "MST": [480], "ADT": [240]}
MONTHS = {m: i % 12 + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec january february march april may june july august september october november december".split())}
MONTHS["sept"] = 9

_TIME = r"(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d+))?)?(?: ?(?P<ap>[AaPp])\.?[Mm]\.?(?![A-Za-z]))?"
_ZONE = r"(?: ?(?P<off>[+-]\d{2}(?::?\d{2})?(?::\d{2})?))?(?: ?\(?(?P<ab>[A-Za-z]{1,5})(?![A-Za-z/_])\)?)?(?: ?\[?(?P<zone>[A-Za-z]+(?:[/_+-][A-Za-z0-9]+)+|UTC|GMT)\]?)?"
_TAIL = rf"(?:(?:[Tt]|,? |, ?){_TIME}{_ZONE})?"
SHAPES = [
    ("unix", re.compile(r"\d{1,17}")),
    ("ymd", re.compile(rf"(?P<Y>\d{{4}})[-/.](?P<m>\d{{1,2}})[-/.](?P<d>\d{{1,2}}){_TAIL}")),
    ("ymd", re.compile(rf"(?P<Y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})[Tt](?P<H>\d{{2}})(?P<M>\d{{2}})(?:(?P<S>\d{{2}})(?:[.,](?P<f>\d+))?)?(?P<ap>)?{_ZONE}")),
    ("num", re.compile(rf"(?P<d>\d{{1,2}})[-/.](?P<m>\d{{1,2}})[-/.](?P<Y>\d{{4}}){_TAIL}")),
    ("text", re.compile(rf"(?:[A-Za-z]{{2,9}}\.?,? )?(?P<d>\d{{1,2}})(?:st|nd|rd|th)?[ -](?P<mon>[A-Za-z]{{3,9}})\.?,?[ -](?P<Y>\d{{4}}){_TAIL}")),
    ("text", re.compile(rf"(?:[A-Za-z]{{2,9}}\.?,? )?(?P<mon>[A-Za-z]{{3,9}})\.? (?P<d>\d{{1,2}})(?:st|nd|rd|th)?,? (?P<Y>\d{{4}}){_TAIL}")),
]
_BLANKS = re.compile(r"\s+")
SWITCH_COST, BACK_COST = 4.0, 1.0
#: Cost of a reading against the source's settings or a usual meaning: more than any two steps of a path can cost, for
#: instants are at most 3.7 million days apart and a step at most SWITCH_COST + BACK_COST + log(3.7 million) = 20.2.
CONTRADICTED = 100.0
#: Records that a task of the path is meant for.
ROWS = 200_000


@lru_cache(512)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


def _us(t: datetime) -> int:
    d = t - EPOCH
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


def _instants(t: datetime, zone: ZoneInfo, day: bool) -> list[int]:
    """Instants of a local time: none in a gap, two in an overlap; of a whole day its first moment."""
    a, b = t.replace(tzinfo=zone).utcoffset(), t.replace(tzinfo=zone, fold=1).utcoffset()
    if a == b or day:
        return [_us(t - a)]
    return [_us(t - a), _us(t - b)] if a > b else []


def _supported(own: list[tuple[int, bool]], fmt: str, penalty: float, found: dict[int, tuple[str, float]]) -> None:
    for us, backed in own:
        cost = penalty + (0.0 if backed else CONTRADICTED)
        if us not in found or cost < found[us][1]:
            found[us] = fmt, cost


def readings(text: str | None, zone: str | None, order: str | None) -> tuple[list[tuple[int, str, float]], bool]:
    """All valid (microseconds, format, cost) readings by instant, and whether exactly one is certain.

    Cost is zero for what the text and the source's settings say and CONTRADICTED for what speaks against them: the
    date order that was not declared, UTC for local times of a declared zone, unusual meanings of an abbreviation
    (usual is what the declared zone calls itself at that time, else the first).  Null, blank and unreadable texts,
    impossible dates and local times that never occur have no reading.  Without a declared zone, local times are read
    as UTC and are not certain; without a declared date order, numeric dates have both orders at no cost.
    """
    s = _BLANKS.sub(" ", (text or "").replace("−", "-")).strip()
    if not s:
        return [], False
    for kind, shape in SHAPES:
        if m := shape.fullmatch(s):
            break
    else:
        return [], False
    if kind == "unix":
        scale = 1_000_000 if len(s) <= 11 else 1000 if len(s) <= 14 else 1
        return [(int(s) * scale, "unix", 0.0)], True
    g = m.groupdict()
    if "mon" in g:
        month = MONTHS.get(g["mon"].lower())
        days = [(month, int(g["d"]), "text", 0.0)] if month else []
    elif kind == "num":
        a, b = int(g["d"]), int(g["m"])
        days = [(x, y, name, CONTRADICTED if order in ("dmy", "mdy") and name != order else 0.0) for x, y, name in ((b, a, "dmy"), (a, b, "mdy"))]
    else:
        days = [(int(g["m"]), int(g["d"]), "ymd", 0.0)]
    hour, minute, second = int(g["H"] or 0), int(g["M"] or 0), int(g["S"] or 0)
    if g.get("ap"):
        if not 1 <= hour <= 12:
            return [], False
        hour = hour % 12 + 12 * (g["ap"].lower() == "p")
    micro = int((g["f"] or "")[:6].ljust(6, "0") or 0)
    fixed = own = named = None
    if off := g["off"]:
        digits = off[1:].replace(":", "").ljust(6, "0")
        h, mi, se = int(digits[:2]), int(digits[2:4]), int(digits[4:])
        if h > 18 or mi > 59 or se > 59:
            return [], False
        fixed = timedelta(hours=h, minutes=mi, seconds=se) * (-1 if off[0] == "-" else 1)
    if g["ab"]:
        named = g["ab"].upper()
        if named not in ABBREVIATIONS:
            return [], False
    if g["zone"] and (own := _zone(g["zone"])) is None:
        return [], False
    declared = _zone(zone) if zone else None
    found: dict[int, tuple[str, float]] = {}
    sure = True
    for month, day, name, penalty in days:
        try:
            t = datetime(int(g["Y"]), month, day, hour, minute, second, micro)
            if fixed is not None:
                options = [(_us(t - fixed), True)]
            elif named:
                offsets = [ABBREVIATIONS[named], *OTHER_MEANINGS.get(named, [])]
                local = t.replace(tzinfo=declared) if declared else None
                called = {f.utcoffset() // timedelta(minutes=1) for f in (local, local.replace(fold=1)) if f.tzname() == named} if local else set()
                usual = called & set(offsets) or {offsets[0]}
                options = [(_us(t - timedelta(minutes=x)), x in usual) for x in offsets]
            elif own is not None:
                options = [(u, True) for u in _instants(t, own, g["H"] is None)]
            elif declared is None:
                sure, options = False, [(_us(t), True)]
            else:
                options = [(u, True) for u in _instants(t, declared, g["H"] is None)]
                options += [(_us(t), False)] if options else []
        except (ValueError, OverflowError):
            continue
        _supported(options, name, penalty, found)
    return [(u, *found[u]) for u in sorted(found)], sure and sum(c == 0 for _, c in found.values()) == 1


NODE = "key bigint, stamp_field string, source string, seq bigint, us array<bigint>, fmt array<string>, cost array<double>, exact boolean"


def _read_all(zones: dict[str, tuple[str | None, str | None]], fields: Sequence[str]):
    schema = pa.schema(
        [("key", pa.int64()), ("stamp_field", pa.string()), ("source", pa.string()), ("seq", pa.int64()), ("us", pa.list_(pa.int64())), ("fmt", pa.list_(pa.string())), ("cost", pa.list_(pa.float64())), ("exact", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[tuple[str, str], tuple] = {}
        for b in batches:
            key, source, seq = (b.column(i).to_pylist() for i in range(3))
            for i, field in enumerate(fields):
                out = []
                for k, s, q, text in zip(key, source, seq, b.column(3 + i).to_pylist(), strict=True):
                    if text is None:
                        continue
                    got = cache.get((text, s))
                    if got is None:
                        if len(cache) > 100_000:
                            cache.clear()
                        r, sure = readings(text, *zones.get(s, (None, None)))
                        got = cache[text, s] = (*([x[n] for x in r] for n in range(3)), sure)
                    if got[0]:
                        out.append((k, field, s, q, *got))
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return run


def _step(a: tuple, b: tuple) -> float:
    """Cost of b after a, without b's own cost."""
    cost = 0.0
    if a[1] != b[1] and (a[1] == "dmy" or a[1] == "mdy") and (b[1] == "dmy" or b[1] == "mdy"):
        cost = SWITCH_COST
    if b[0] < a[0]:
        cost += BACK_COST + math.log1p((a[0] - b[0]) / 86_400_000_000)
    return cost


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(source, field), nodes (key, readings, exact) of each run of equal groups; the nodes stream."""
    from itertools import groupby

    def rows():
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    for group, own in groupby(rows(), key=lambda r: (r[2], r[1])):
        yield group, ((r[0], list(zip(r[4], r[5], r[6], strict=True)), r[7]) for r in own)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition and group: readings of the first and last node, and the least cost of a path between each two."""
    from pyspark import TaskContext

    out = []
    for n, (group, nodes) in enumerate(_segments(batches)):
        _, first, _ = next(nodes)
        last, cost = first, [[first[i][2] if i == j else math.inf for j in range(len(first))] for i in range(len(first))]
        for _, now, _ in nodes:
            steps = [[_step(p, x) + x[2] for p in last] for x in now]
            cost = [[min(map(float.__add__, c, s)) for s in steps] for c in cost]
            last = now
        out.append((TaskContext.get().partitionId(), n, *group, *list(zip(*first, strict=True))[:2], *list(zip(*last, strict=True))[:2], cost))
    types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.list_(pa.float64()))]
    names = ["part", "n", "source", "stamp_field", "first_us", "first_fmt", "last_us", "last_fmt", "cost"]
    yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)


EDGE_SCHEMA = "part int, n int, source string, stamp_field string, first_us array<bigint>, first_fmt array<string>, last_us array<bigint>, last_fmt array<string>, cost array<array<double>>"


def _stitch(edges: list) -> dict[tuple[int, str | None, str], tuple[int, int]]:
    """(partition, source, field) to the index of its chosen first and last reading."""
    groups: dict[tuple, list] = {}
    for e in sorted(edges, key=lambda e: e["part"]):
        groups.setdefault((e["source"], e["stamp_field"]), []).append(e)
    chosen = {}
    for group, own in groups.items():
        back, best, prev = [], None, None
        for e in own:
            first = list(zip(e["first_us"], e["first_fmt"], strict=True))
            if best is None:
                enter, came = [0.0] * len(first), [None] * len(first)
            else:
                enter, came = zip(*(min((best[j] + _step(p, x), j) for j, p in enumerate(prev)) for x in first), strict=True)
            best, start = zip(*(min((enter[i] + e["cost"][i][j], i) for i in range(len(first))) for j in range(len(e["last_us"]))), strict=True)
            prev = list(zip(e["last_us"], e["last_fmt"], strict=True))
            back.append((came, start))
        j = min(range(len(best)), key=lambda i: (best[i], i))
        for e, (came, start) in zip(reversed(own), reversed(back), strict=True):
            chosen[e["part"], *group] = (start[j], j)
            j = came[start[j]]
    return chosen


PICK = "key bigint, stamp_field string, epoch_us bigint, format string, readings int, exact boolean"


def _choose(chosen: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out = TaskContext.get().partitionId(), []

        def settle(pending: list, end: int) -> None:
            """Follows the path back from reading ``end`` of the last pending node."""
            for key, now, exact, came in reversed(pending):
                us, fmt, cost = now[end]
                out.append((key, group[1], us, fmt, len(now), exact and cost == 0))
                end = came[end] if came else 0

        for group, nodes in _segments(batches):
            first_ix, last_ix = chosen[part, *group]
            pending, prev, best = [], None, None
            for key, now, exact in nodes:
                came = None
                if prev is None:
                    best = [0.0 if i == first_ix else math.inf for i in range(len(now))]
                else:
                    steps = [min((best[j] + _step(p, x), j) for j, p in enumerate(prev)) for x in now]
                    best, came = [c + x[2] for (c, _), x in zip(steps, now, strict=True)], [j for _, j in steps]
                    if came.count(came[0]) == len(came):  # all paths meet in the node before
                        settle(pending, came[0])
                        pending, came = [], None
                        low = min(best)
                        best = [c - low for c in best]
                pending.append((key, now, exact, came))
                prev = now
                if len(out) > 5000:
                    yield batch(out)
                    out.clear()
            settle(pending, last_ix)
        yield batch(out)

    def batch(out: list) -> pa.RecordBatch:
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.bool_()]
        return pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["key", "stamp_field", "epoch_us", "format", "readings", "exact"])

    return run


def normalise(df: DataFrame, sources: DataFrame, fields: Sequence[str], key: str = "rowid", source: str = "source_type", order: str = "load_seq") -> DataFrame:
    """key, stamp_field, epoch_us, format, readings, exact: one row per text that has a reading.

    ``sources`` (source_type, tz, date_order) is read on the driver: one row per source, of which a store has
    few.  ``epoch_us`` is the Viterbi choice among ``readings`` readings; ``exact``: it is the one instant that the
    text denotes by itself and the source's settings.  Rows without a reading (null, blank, no date, impossible date,
    local time in a daylight-saving gap) do not come out.  A null order sorts first; equal orders by key.
    """
    zones = {r["source_type"]: (r["tz"], r["date_order"]) for r in sources.select("source_type", "tz", "date_order").toLocalIterator()}
    read = cut(df.select(F.col(key).cast("bigint"), F.col(source), F.col(order).cast("bigint"), *fields).mapInArrow(_read_all(zones, fields), NODE))
    parts = max(width(df.sparkSession), -(-read.count() // ROWS))
    path = cut(read.repartitionByRange(parts, "source", "stamp_field", "seq", "key").sortWithinPartitions("source", "stamp_field", "seq", "key"))
    chosen = _stitch(path.mapInArrow(_edges, EDGE_SCHEMA).collect())  # a row a partition and the groups in it
    return path.mapInArrow(_choose(chosen), PICK).withColumnRenamed("key", key)
