import hashlib

import pytest
from pyspark.sql import functions as F

from siltstone.operators import incremental as inc

from conftest import rows

CH = "rowid bigint, load_seq bigint, id string, source_type string, source_key string, chunk_index int, content string, content_hash string, junk string"
CO = "run_id bigint, id string, content_hash string"
RU = "run_id bigint, status string"
SU = "source_type string, source_key string, summary string, doc_hash string, generated_at string"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_work_list(spark):
    chunks = [
        (1, 1, "a:k:section:0", "a", "k", 0, "old", h("old"), "x"),
        (2, 5, "a:k:section:0", "a", "k", 0, "new", "SHA256:" + h("new").upper() + " ", "x"),
        (3, 5, "a:k:section:0", "a", "k", 0, "new", h("new"), "x"),  # repeated arrival
        (4, 2, "a:k:section:1", "a", "k", 1, "two", None, "x"),
        (5, 3, "a:m:section:0", "a", "m", 0, "", "", "x"),  # blank hash: of the content
        (6, 3, None, "a", "m", 1, "no id", None, "x"),
        (7, 4, "a:n:section:0", "a", "n", 0, None, None, None),
    ]
    commits = [(1, "a:k:section:0", h("old")), (2, "a:k:section:0", h("new")), (3, "a:k:section:0", h("old")), (1, "a:k:section:1", h("two").upper()), (1, "a:m:section:0", None), (1, "gone", h("x")), (1, None, h("x"))]
    runs = [(1, "ok"), (2, "ok"), (3, "failed")]
    sums = [
        ("a", "k", "s", h("new\n\ntwo")[:32].upper(), "2025-01-02T00:00:00+00:00"), ("a", "k", "s", "0" * 32, "2025-01-01T00:00:00+00:00"), ("a", "m", "s", None, "2025-01-01T00:00:00+00:00"), ("z", "z", "s", "1" * 32, None),
    ]
    got = inc.work_list(spark.createDataFrame(chunks, CH), spark.createDataFrame(commits, CO), spark.createDataFrame(runs, RU), spark.createDataFrame(sums, SU), 8)
    assert rows(got) == [("chunk", "a:m:section:0"), ("chunk", "a:n:section:0"), ("summary", "a:m")]


def test_empty_tables(spark):
    e = lambda s: spark.createDataFrame([], s)
    assert rows(inc.work_list(e(CH), e(CO), e(RU), e(SU))) == []
    one = spark.createDataFrame([(1, 1, "a:k:section:0", "a", "k", 0, "t", None, None)], CH)
    assert rows(inc.work_list(one, e(CO), e(RU), e(SU))) == [("chunk", "a:k:section:0")]


def test_fingerprints_skip_equal_buckets(spark):
    a = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("v"))
    b = a.withColumn("v", F.when(F.col("id") == "7", "y").otherwise(F.col("v")))
    f = inc.fingerprints
    assert inc.changed_buckets(f(a, ["id"], ["v"], 64), f(b, ["id"], ["v"], 64)).count() == 1
    assert rows(inc.pending(b, a, ["id"], "v", 64)) == [("7", "y")]
    nulls = a.withColumn("v", F.when(F.col("id") == "9", None).otherwise(F.col("v")))
    assert rows(inc.pending(nulls, nulls, ["id"], "v", 64)) == [("9", None)]


def derive(rows_):
    return rows_.groupBy("id").agg(F.sum("v").alias("total"))


def test_table_follows_its_source(spark, tmp_path):
    t = inc.IncrementalTable(spark, str(tmp_path / "t"), ["id"], ["v"], 16)
    make = lambda d: spark.createDataFrame(list(d.items()), "id string, v bigint")
    state = {str(i): i for i in range(200)}
    assert t.refresh(make(state), derive) == 16
    assert t.refresh(make(state), derive) == 0
    state["5"] = 500
    assert t.refresh(make(state), derive) == 1
    del state["5"]
    state["new"] = 1
    assert 1 <= t.refresh(make(state), derive) <= 2
    assert {r["id"]: r["total"] for r in t.read().collect()} == state


def test_failed_run_is_repeated(spark, tmp_path):
    t = inc.IncrementalTable(spark, str(tmp_path / "t"), ["id"], ["v"], 4)
    make = lambda d: spark.createDataFrame(list(d.items()), "id string, v bigint")
    t.refresh(make({"a": 1}), derive)

    def fail():
        raise OSError("lost")

    with pytest.raises(OSError):
        t.refresh(make({"a": 2}), derive, fail)
    assert t.head() == 1
    assert t.refresh(make({"a": 2}), derive) == 1
    assert [(r["id"], r["total"]) for r in t.read().collect()] == [("a", 2)]


def test_a_source_that_goes_back_after_a_failed_run(spark, tmp_path):
    t = inc.IncrementalTable(spark, str(tmp_path / "t"), ["id"], ["v"], 4)
    make = lambda d: spark.createDataFrame(list(d.items()), "id string, v bigint")

    def fail():
        raise OSError("lost")

    a = {str(i): i for i in range(40)}
    t.refresh(make(a), derive)
    for _ in range(2):  # two runs die after the write
        with pytest.raises(OSError):
            t.refresh(make(a | {"0": 99, "new": 1}), derive, fail)
    assert t.refresh(make(a), derive) >= 1
    assert {r["id"]: r["total"] for r in t.read().collect()} == a
    assert t.refresh(make(a), derive) == 0  # nothing is repeated once a run is whole


def test_table_of_an_empty_source(spark, tmp_path):
    t = inc.IncrementalTable(spark, str(tmp_path / "t"), ["id"], ["v"], 4)
    assert t.refresh(spark.createDataFrame([], "id string, v bigint"), derive) == 0
    assert t.read().collect() == [] and "total" in t.read().columns
    t.refresh(spark.createDataFrame([("a", 1)], "id string, v bigint"), derive)
    assert [(r["id"], r["total"]) for r in t.read().collect()] == [("a", 1)]
