"""Problem 3: one ranking from several differently-scaled scores, by leximin over percentiles.

Within its group each score becomes the share of the group's other items that are strictly worse.  An item's
percentiles, sorted ascending, are compared as arrays, so the weakest score decides first and no single score can
carry an item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Distinct values of one scorer in one group above which the group is ranked in value ranges by several tasks.
HOT_VALUES = 200_000
RANGES = 256


def _worse(values: DataFrame, keys: list[str], hot_values: int) -> DataFrame:
    """keys, value, n -> keys, value, worse: the rows of smaller value, however many one group has.

    A group with more than ``hot_values`` distinct values is cut at approximate quantiles into ranges; a range
    counts by itself and adds the total of the ranges before it.
    """
    hot = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > hot_values).select(*keys)
    at = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    cuts = values.join(hot, keys, "left_semi").groupBy(*keys).agg(F.percentile_approx("value", at, F.lit(10 * RANGES)).alias("cuts"))
    placed = values.join(cuts, keys, "left").withColumn(
        "part", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("value"))), F.lit(0))
    ).drop("cuts")
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*keys, "part").agg(F.sum("n").alias("n")).select(*keys, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*keys, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(starts, [*keys, "part"])
        .select(*keys, "value", (F.col("start") + F.col("inside")).alias("worse"))
    )


def rank(hits: DataFrame, scorers: DataFrame, group: str = "query_id", item: str = "rowid", scorer: str = "scorer", score: str = "distance", limit: int | None = None, hot_values: int = HOT_VALUES) -> DataFrame:
    """group, item, profile (percentiles, ascending), position from 1; with ``limit`` only the first positions.

    ``scorers`` has one row per scorer with ``better`` = low or high.  Null and NaN scores and scores that an item
    lacks are missing; a missing score counts like the worst of its group, percentile 0.  Repeated rows count
    once, of unequal scores of one item by one scorer the better counts.  Hits of a scorer that ``scorers`` lacks
    or with a null item or group are ignored, save that the item itself takes part.  Equal profiles come in the
    order of the item.  An empty table gives an empty one.
    """
    kinds = scorers.select(F.col(scorer).alias("scorer"), (F.lower("better") == "high").alias("high")).distinct()
    n_scorers = kinds.count()
    rows = hits.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(scorer).alias("scorer"), F.col(score).cast("double").alias("raw"))
    rows = rows.filter(F.col("g").isNotNull() & F.col("i").isNotNull()).join(kinds, "scorer", "left")
    value = F.when(F.isnan("raw"), None).when(F.col("high"), F.col("raw")).when(~F.col("high"), -F.col("raw"))
    once = rows.groupBy("g", "i", "scorer").agg(F.max(value).alias("value"))
    items = once.groupBy("g", "i").agg(F.count("value").alias("scores"))
    sizes = items.groupBy("g").agg(F.count(F.lit(1)).alias("items"))
    scored = once.filter(F.col("value").isNotNull()).withColumn("value", F.col("value") + F.lit(0.0))
    values = scored.groupBy("g", "scorer", "value").agg(F.count(F.lit(1)).alias("n"))
    present = values.groupBy("g", "scorer").agg(F.sum("n").alias("present")).join(sizes, "g")
    worse = F.when(F.col("worse") > 0, F.col("worse") + F.col("items") - F.col("present")).otherwise(F.lit(0))
    share = F.when(F.col("items") > 1, worse / (F.col("items") - 1)).otherwise(F.lit(1.0))
    pct = _worse(values, ["g", "scorer"], hot_values).join(present, ["g", "scorer"]).select("g", "scorer", "value", share.alias("pct"))
    own = scored.join(pct, ["g", "scorer", "value"]).groupBy("g", "i").agg(F.collect_list("pct").alias("p"))
    profile = F.sort_array(F.concat(F.coalesce("p", F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), F.lit(n_scorers) - F.coalesce(F.size("p"), F.lit(0)))))
    ranked = items.select("g", "i").join(own, ["g", "i"], "left").select("g", "i", profile.alias("profile"))
    ranked = ranked.withColumn("position", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("profile"), "i")))
    if limit is not None:
        ranked = ranked.filter(F.col("position") <= limit)
    return ranked.select(F.col("g").alias(group), F.col("i").alias(item), "profile", "position")
