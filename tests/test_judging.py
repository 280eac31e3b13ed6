from pyspark.sql import functions as F

from siltstone.operators import evaluate, judging


def test_answer_and_judge(spark, tmp_path):
    ranked = spark.createDataFrame([(1, "c1", "k1"), (1, "c2", "k2")], "query_id bigint, id string, source_key string")
    chunks = spark.createDataFrame([("c1", "text one"), ("c2", "text two")], "id string, content string")
    q = judging.contexts(ranked, chunks).withColumn("query", F.lit("what?"))
    assert {c["source_key"] for c in q.first()["context"]} == {"k1", "k2"}
    a = judging.answer(q, lambda p: {"answer": "one", "cited_keys": ["k1", "unknown"]})
    assert (a.first()["answer"], a.first()["cited_keys"]) == ("one", ["k1"])
    ok = judging.judge(a, lambda p: {"faithfulness": {"passed": p["answer"] == "one"}}).first()["verdict"]
    assert (ok["faithfulness"], ok["citation"]) == (True, False)

    def broken(p):
        raise OSError

    assert not any(judging.judge(a, broken).first()["verdict"])
    cases = a.select("query", "answer", "cited_keys", "context", F.lit(True).alias("human_faithful"), F.lit(False).alias("adversarial"), F.lit("").alias("note"))
    judging.write_cases(cases, str(tmp_path / "cases"))
    assert judging.read_cases(spark, str(tmp_path / "cases")).first()["context"] == cases.first()["context"]


def test_costs_and_comparison(spark):
    u = spark.createDataFrame([(1_000_000, 1_000_000, 100_000)], "input_tokens bigint, cached_tokens bigint, output_tokens bigint")
    assert evaluate.realised_cost(u, 1.0, 5.0).first()[0] == 1.6
    q = spark.createDataFrame([(1, ["a"])], "query_id bigint, expected_keys array<string>")
    r = lambda k: spark.createDataFrame([(1, 1, k)], "query_id bigint, position int, source_key string")
    assert {x["config"]: x["recall"] for x in evaluate.compare(q, {"good": r("a"), "bad": r("b")}, 5).collect()} == {"good": 1.0, "bad": 0.0}
