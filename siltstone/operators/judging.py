"""Answers and their judging with pluggable clients, the cases for it, and reports as files."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.evaluate import verdict_column
from siltstone.operators.summaries import retry

AXES = ("faithfulness", "citation", "completeness")
CASES = "query string, answer string, cited_keys array<string>, context array<struct<source_key:string,text:string>>, human_faithful boolean, adversarial boolean, note string"


def seeded_order(seed: Column, key: Column) -> Column:
    """A sort key that shuffles ``key`` the same way for the same seed, so that a judge sees no rank order."""
    return F.sha2(F.concat_ws("\x1f", seed, key), 256)


def contexts(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, context: the whole texts of each query's hits, shuffled by the query's seed.  Hits a query are few."""
    rows = ranked.select("query_id", "id", "source_key").join(chunks.select("id", "content"), "id")
    entry = F.struct(seeded_order(F.col("query_id").cast("string"), F.col("id")).alias("o"), "source_key", F.col("content").alias("text"))
    own = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias("c"))
    return own.select("query_id", F.transform("c", lambda x: F.struct(x["source_key"].alias("source_key"), x["text"].alias("text"))).alias("context"))


def context_text(context: Column) -> Column:
    """A context as one text: a line with each entry's key before its text."""
    return F.array_join(F.transform(context, lambda x: F.concat(F.lit("[source_key: "), x["source_key"], F.lit("]\n"), F.coalesce(x["text"], F.lit("")))), "\n\n")


def _call(df: DataFrame, columns: Sequence[str], client: Callable[[dict], dict], to: str) -> DataFrame:
    """df with ``to``: the client's JSON answer for a row, of which it also gets context_text; null where it failed
    for good."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(payload: str) -> str | None:
            try:
                return retry(lambda: json.dumps(client(json.loads(payload))), tries=2, first=0.1)
            except Exception:
                return None

        for s in batches:
            yield s.map(one)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(to, F.pandas_udf(run, "string")(F.to_json(F.struct(*columns, *([context_text(F.col("context")).alias("context_text")] if "context" in columns else [])))))


def answer(questions: DataFrame, client: Callable[[dict], dict]) -> DataFrame:
    """questions (query, context) with answer and cited_keys, of which only keys of the context count."""
    got = _call(questions, ["query", "context"], client, "_a")
    parsed = F.from_json("_a", "struct<answer:string,cited_keys:array<string>>")  # any other shape is no answer
    known = F.transform("context", lambda c: c["source_key"])
    return got.withColumn("answer", parsed["answer"]).withColumn("cited_keys", F.array_intersect(F.coalesce(parsed["cited_keys"], F.array().cast("array<string>")), known)).drop("_a")


def judge(cases: DataFrame, client: Callable[[dict], dict], axes: Sequence[str] = AXES) -> DataFrame:
    """cases with verdict: a boolean for each axis; a failed call and a missing field are a fail."""
    got = _call(cases, ["query", "answer", "cited_keys", "context"], client, "_v")
    return got.withColumn("verdict", verdict_column(F.col("_v"), axes)).drop("_v")


def draft_cases(questions: DataFrame, client: Callable[[dict], dict]) -> DataFrame:
    """Answers to questions (query, context, note) as cases whose human verdict is still to be given."""
    made = answer(questions, client)
    note = F.col("note") if "note" in made.columns else F.lit("")
    return made.select("query", "answer", "cited_keys", "context", F.lit(None).cast("boolean").alias("human_faithful"), F.lit(False).alias("adversarial"), note.alias("note"))


def write_cases(cases: DataFrame, path: str) -> None:
    """Cases as JSON lines, to be labelled and read again by ``read_cases``."""
    cases.write.mode("overwrite").json(path)


def read_cases(spark, path: str) -> DataFrame:
    return spark.read.schema(CASES).json(path)
