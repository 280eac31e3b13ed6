import itertools
import random
from datetime import UTC, datetime

import pytest

from siltstone.operators import timestamps as ts


def us(*a):
    return int(datetime(*a, tzinfo=UTC).timestamp() * 1_000_000)


@pytest.mark.parametrize(
    ("text", "zone", "order", "want"),
    [
        ("2019-07-26T23:44:55Z", "Asia/Tokyo", "dmy", us(2019, 7, 26, 23, 44, 55)),
        ("2019-07-26T23:44:55.1234569Z", None, None, us(2019, 7, 26, 23, 44, 55, 123456)),
        ("2020-11-08T22:17:30,321+09:00", None, None, us(2020, 11, 8, 13, 17, 30, 321000)),
        ("  2022-06-07t22:09:18+01:00 ", None, None, us(2022, 6, 7, 21, 9, 18)),
        ("2024-09-23T18:01:22−07:00", None, None, us(2024, 9, 24, 1, 1, 22)),
        ("2022-01-05 05:30:45-05:00[America/New_York]", None, None, us(2022, 1, 5, 10, 30, 45)),
        ("2022-05-28T08:24:52 Europe/Berlin", "UTC", None, us(2022, 5, 28, 6, 24, 52)),
        ("2024-02-28 17:37:22 EST", None, None, us(2024, 2, 28, 22, 37, 22)),
        ("20200325T035009Z", None, None, us(2020, 3, 25, 3, 50, 9)),
        ("1732175866", None, None, 1732175866_000000),
        ("1715715675378", None, None, 1715715675378_000),
        ("1583176117708533", None, None, 1583176117708533),
        ("07/08/2023 13:09:21", "UTC", "mdy", us(2023, 7, 8, 13, 9, 21)),
        ("07/08/2023 13:09:21", "UTC", "dmy", us(2023, 8, 7, 13, 9, 21)),
        ("14.07.2023 04:14", "Europe/Berlin", "dmy", us(2023, 7, 14, 2, 14)),
        ("May 3, 2022 8:54 AM", "UTC", "mdy", us(2022, 5, 3, 8, 54)),
        ("12 May 2022, 12:21:26", "UTC", "dmy", us(2022, 5, 12, 12, 21, 26)),
        ("Thu, 8 Apr 2021 01:19:12 +1000", None, None, us(2021, 4, 7, 15, 19, 12)),
        ("2023-05-24", "America/New_York", None, us(2023, 5, 24, 4)),
    ],
)
def test_certain(text, zone, order, want):
    own, sure = ts.readings(text, zone, order)
    assert [u for u, _, cost in own if cost == 0] == [want] and sure
    assert all(cost == ts.CONTRADICTED for u, _, cost in own if u != want)


@pytest.mark.parametrize("text", [None, "", "  ", "unknown", "n/a", "-", "2021-06-31", "0000-00-00", "2022-13-01 08:00", "2023-02-30T10:00:00Z", "31/31/2020", "2020-01-01T25:00:00Z", "2020-01-01 13:00 PM", "x" * 100_000])
def test_no_date(text):
    assert ts.readings(text, "UTC", "dmy") == ([], False)


def test_daylight_saving():
    assert ts.readings("2023-03-26T02:30:00", "Europe/Berlin", None) == ([], False)
    twice, sure = ts.readings("2023-10-29T02:30:00", "Europe/Berlin", None)
    assert [t for t, _, c in twice if c == 0] == [us(2023, 10, 29, 0, 30), us(2023, 10, 29, 1, 30)] and not sure
    day, sure = ts.readings("2018-11-04", "America/Sao_Paulo", None)  # the day begins at one
    assert [x[0] for x in day if x[2] == 0] == [us(2018, 11, 4, 3)] and sure
    assert ts.readings("2023-10-29T02:30:00+02:00", "Europe/Berlin", None)[1]


def brute(nodes):
    return min(itertools.product(*nodes), key=lambda p: round(whole(p), 9))


def whole(path):
    return sum(x[2] for x in path) + sum(ts._step(a, b) for a, b in itertools.pairwise(path))


def test_viterbi_is_exact_over_partitions(spark):
    r = random.Random(3)
    src = [(i, "s", i, f"{r.randint(1, 12):02d}/{r.randint(1, 12):02d}/2020 10:00") for i in range(9)]
    df = spark.createDataFrame(src, "rowid bigint, source_type string, load_seq bigint, stamp string")
    none = spark.createDataFrame([("s", "UTC", None)], "source_type string, tz string, date_order string")
    got = {x["rowid"]: x["epoch_us"] for x in ts.normalise(df, none, ["stamp"]).collect()}
    nodes = [ts.readings(t, "UTC", None)[0] for *_, t in src]
    mine = [next(n for n in own if n[0] == got[i]) for i, own in enumerate(nodes)]
    assert whole(mine) == pytest.approx(whole(brute(nodes)))


def test_stitch_equals_one_partition():
    r = random.Random(5)
    nodes = [[(r.randint(0, 10**13), f, r.choice([0.0, 0.0, 3.0])) for f in r.sample(["dmy", "mdy"], r.choice([1, 2, 2, 2]))] for _ in range(10)]
    best = whole(brute(nodes))
    for cuts in ([4], [1, 2, 7], [9]):
        parts = [nodes[a:b] for a, b in itertools.pairwise([0, *cuts, 10])]
        edges = []
        for i, p in enumerate(parts):
            cost = [[p[0][a][2] if a == b else float("inf") for b in range(len(p[0]))] for a in range(len(p[0]))]
            for prev, now in itertools.pairwise(p):
                cost = [[min(c[j] + ts._step(prev[j], x) + x[2] for j in range(len(prev))) for x in now] for c in cost]
            edges.append({"part": i, "source": "s", "stamp_field": "f", "first_us": [x[0] for x in p[0]], "first_fmt": [x[1] for x in p[0]], "last_us": [x[0] for x in p[-1]], "last_fmt": [x[1] for x in p[-1]], "cost": cost})
        chosen = ts._stitch(edges)
        total = sum(edges[i]["cost"][chosen[i, "s", "f"][0]][chosen[i, "s", "f"][1]] for i in range(len(parts)))
        total += sum(ts._step(parts[i][-1][chosen[i, "s", "f"][1]], parts[i + 1][0][chosen[i + 1, "s", "f"][0]]) for i in range(len(parts) - 1))
        assert total == pytest.approx(best)


def test_nulls_and_empty(spark):
    schema = "rowid bigint, source_type string, load_seq bigint, created_at string, epoch_us string"
    so = spark.createDataFrame([("a", "UTC", "dmy")], "source_type string, tz string, date_order string")
    assert ts.normalise(spark.createDataFrame([], schema), so, ["created_at"]).collect() == []
    df = spark.createDataFrame([(1, None, None, "2020-01-01", "x"), (2, "a", 1, None, "x"), (3, "a", 1, "2020-01-01", "x")], schema)
    assert {(r["rowid"], r["exact"]) for r in ts.normalise(df, so, ["created_at"]).collect()} == {(1, False), (3, True)}


def test_the_path_decides_where_nothing_is_declared(spark):
    """The first, the last or the likeliest single reading would be wrong: only the record order tells the date order."""
    src = [(i, "s", i, f"{i % 28 + 1:02d}/{i // 28 + 3:02d}/2020 10:00") for i in range(168)]
    df = spark.createDataFrame(src, "rowid bigint, source_type string, load_seq bigint, stamp string")
    none = spark.createDataFrame([("s", "UTC", None)], "source_type string, tz string, date_order string")
    got = {x["rowid"]: x for x in ts.normalise(df, none, ["stamp"]).collect()}
    assert {x["format"] for x in got.values()} == {"dmy"}
    assert all(got[i]["epoch_us"] == us(2020, i // 28 + 3, i % 28 + 1, 10) for i in range(168))
    assert got[0]["readings"] == 2 and not got[0]["exact"] and got[20]["exact"]


def test_settings_outweigh_the_path(spark):
    src = [(i, "s", i, f"{d:02d}/{m:02d}/2020 10:00") for i, (d, m) in enumerate([(1, 2), (3, 1), (5, 4), (4, 1)])]
    df = spark.createDataFrame(src, "rowid bigint, source_type string, load_seq bigint, stamp string")
    so = spark.createDataFrame([("s", "Europe/Berlin", "mdy")], "source_type string, tz string, date_order string")
    got = sorted((x["rowid"], x["epoch_us"], x["exact"]) for x in ts.normalise(df, so, ["stamp"]).collect())
    assert got == [(0, us(2020, 1, 2, 9), True), (1, us(2020, 3, 1, 9), True), (2, us(2020, 5, 4, 8), True), (3, us(2020, 4, 1, 8), True)]
