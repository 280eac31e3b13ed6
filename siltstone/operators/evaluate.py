"""Evaluation as aggregations: retrieval quality, rater agreement, latency and cost."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score_queries(queries: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """query_id, recall, mrr, ndcg of each scored query: ``queries`` (query_id, expected_keys), ``ranked``
    (query_id, position, source_key).  Queries without expected keys are negative and not scored.  Expected keys
    count once, a key counts at its first position."""
    scored = queries.filter(F.size("expected_keys") > 0).withColumn("want", F.array_distinct("expected_keys"))
    keys = scored.select("query_id", F.explode("want").alias("source_key"))
    best = ranked.groupBy("query_id", "source_key").agg(F.min("position").alias("p")).join(keys, ["query_id", "source_key"], "left_semi")
    gain = F.when(F.col("p") <= k, 1 / F.log2(F.col("p") + 1.0)).otherwise(0.0)
    hit = best.groupBy("query_id").agg(F.min("p").alias("first"), F.sum(gain).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.size("want"), F.lit(k))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    j = scored.join(hit, "query_id", "left")
    return j.select(
        "query_id",
        F.when(F.col("first") <= k, 1.0).otherwise(0.0).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"),
    )


def summarise(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, n, recall, mrr, ndcg: macro averages; without rows n is 0 and all are 0."""
    avg = [F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("recall", "mrr", "ndcg")]
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *avg) if by else scores.agg(F.count(F.lit(1)).alias("n"), *avg)


def breakdown(scores: DataFrame, queries: DataFrame, tag: str = "source_type") -> DataFrame:
    own = queries.select("query_id", F.coalesce(tag, F.lit("(untagged)")).alias(tag))
    return summarise(scores.join(own, "query_id"), [tag])


def gate(summary: DataFrame, floors: Mapping[str, float]) -> DataFrame:
    """metric, value, floor, passed for each floor."""
    unknown = set(floors) - {"recall", "mrr", "ndcg"}
    if unknown:
        raise ValueError(f"no such metric: {', '.join(sorted(unknown))}")
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(float(f)).alias("floor")) for m, f in floors.items()])
    return summary.select(F.explode(each).alias("x")).select("x.*", (F.col("x.value") >= F.col("x.floor")).alias("passed"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement, kappa of two boolean raters; rows with a null rating are not rated.  No rows: null kappa."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    rated = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    s = rated.agg(F.count(F.lit(1)).alias("n"), F.avg((x == y).cast("double")).alias("agreement"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return s.select("n", "agreement", F.when(pe == 1.0, F.lit(1.0)).otherwise((F.col("agreement") - pe) / (1 - pe)).alias("kappa"))


def judge_report(cases: DataFrame, verdict: str = "judged_faithful") -> DataFrame:
    """kappa's columns with adversarial_total and adversarial_caught, over cases with a human verdict."""
    rated = cases.filter(F.col("human_faithful").isNotNull())
    bad = F.coalesce(F.col("adversarial"), F.lit(False))
    caught = rated.agg(F.sum(bad.cast("int")).alias("adversarial_total"), F.sum((bad & ~F.col(verdict)).cast("int")).alias("adversarial_caught"))
    one = F.lit(1).alias("_k")
    return kappa(rated, "human_faithful", verdict).withColumn("_k", one).join(caught.withColumn("_k", one), "_k").drop("_k")


def pass_rates(verdicts: DataFrame, axes: Sequence[str]) -> DataFrame:
    """axis, n, pass_rate; a missing verdict is a fail."""
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.coalesce(F.col(a), F.lit(False)).alias("ok")) for a in axes]))
    return verdicts.select(each.alias("x")).groupBy("x.axis").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("x.ok").cast("double")).alias("pass_rate"))


def verdict_column(payload: Column, axes: Sequence[str]) -> Column:
    """A judge's JSON answer to a struct of booleans; what is missing or unreadable fails."""
    parsed = F.from_json(payload, "struct<" + ",".join(f"{a}:struct<passed:boolean,reason:string>" for a in axes) + ">")
    return F.struct(*[F.coalesce(parsed[a]["passed"], F.lit(False)).alias(a) for a in axes])


def latency(samples: DataFrame, by: Sequence[str], value: str, scale: float = 1000.0) -> DataFrame:
    """by, n, mean, p50, p95, p99, min, max in milliseconds with two decimals; percentiles interpolate."""
    v = F.col(value)
    p = F.percentile(v, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    agg = samples.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), p.alias("p"), F.min(v).alias("min"), F.max(v).alias("max"))
    r = lambda c: F.round(F.coalesce(c, F.lit(0.0)) * scale, 2)
    return agg.select(*by, "n", r(F.col("mean")).alias("mean"), *[r(F.col("p")[i]).alias(n) for i, n in enumerate(("p50", "p95", "p99"))], r(F.col("min")).alias("min"), r(F.col("max")).alias("max"))


def compare(queries: DataFrame, ranked: Mapping[str, DataFrame], k: int) -> DataFrame:
    """config, n, recall, mrr, ndcg: one row per named ranking of the same queries."""
    out = None
    for name, r in ranked.items():
        one = summarise(score_queries(queries, r, k)).withColumn("config", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def throughput(samples: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, per_second: how many a second, one after another."""
    return samples.groupBy(*by).agg((F.count(value) / F.nullif(F.sum(value), F.lit(0.0))).alias("per_second"))


def realised_cost(usage: DataFrame, price_in: float, price_out: float, cached_share: float = 0.1) -> DataFrame:
    """cost of calls with input_tokens, cached_tokens and output_tokens; cached input costs a share of the price."""
    t = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return usage.agg(((t("input_tokens") * price_in + t("cached_tokens") * price_in * cached_share + t("output_tokens") * price_out) / 1e6).alias("cost"))


def rolling_tokens(calls: DataFrame, at: str = "ts", tokens: str = "tokens", seconds: int = 60, by: Sequence[str] = ()) -> DataFrame:
    """calls with spent: tokens of the last ``seconds`` up to and with each call."""
    w = Window.partitionBy(*by).orderBy(F.unix_seconds(F.col(at).cast("timestamp"))).rangeBetween(-seconds, 0)
    return calls.withColumn("spent", F.sum(tokens).over(w))
