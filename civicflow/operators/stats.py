"""Descriptive statistics and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicflow.functions.numbers import ratio
from civicflow.operators.ordering import keyed, met, quantiles, unkeyed


def volume(rows: DataFrame, by: str, top: int | None = None) -> DataFrame:
    """Rows of each value, nulls left out, the most frequent first."""
    counted = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"))
    return counted if top is None else counted.orderBy(F.desc("n"), by).limit(top)


def distribution(rows: DataFrame, by: str) -> DataFrame:
    """Count and percentage of each value, null among them."""
    counted = rows.groupBy(by).agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(counted.agg(F.sum("n").alias("_t"))), how="cross").select(by, "n", (100 * F.col("n") / F.col("_t")).alias("pct"))


def feature_rates(rows: DataFrame, features: list[str]) -> DataFrame:
    """feature, n and pct of each boolean column, in one pass."""
    sums = rows.agg(F.count("*").alias("_t"), *[F.count_if(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in features])
    return sums.select("_t", F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("n")) for f in features]))).select("feature", "n", (100 * ratio(F.col("n"), F.col("_t"))).alias("pct"))


def any_feature(rows: DataFrame, features: list[str]) -> DataFrame:
    some = F.coalesce(F.greatest(*[F.coalesce(F.col(f), F.lit(False)) for f in features]), F.lit(False))
    return rows.agg(F.count("*").alias("total"), F.count_if(some).alias("n")).withColumn("pct", 100 * ratio(F.col("n"), F.col("total")))


def crosstab(rows: DataFrame, a: str, b: str, values: list[str]) -> DataFrame:
    """Percentages of b's values in each row of a, with the row's total; values not listed are left out."""
    counts = rows.where(F.col(b).isin(values)).groupBy(a).agg(F.count("*").alias("total"), *[F.count_if(F.col(b) == v).alias(f"_{v}") for v in values])
    return counts.select(a, "total", *[(100 * F.col(f"_{v}") / F.col("total")).alias(str(v).lower()) for v in values])


def pivot_mean(rows: DataFrame, a: str, b: str, values: list[str], value: str, digits: int = 1) -> DataFrame:
    """Means of a value by two keys, one column for each of b's values, rounded half to even."""
    return rows.groupBy(a).pivot(b, values).agg(F.bround(F.avg(value), digits))


def share_of_total(rows: DataFrame, by: str, value: str) -> DataFrame:
    """count, sum and mean of a value by key, and its share of the grand total."""
    sums = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    grand = sums.agg(F.sum("total").alias("_g"))
    return sums.join(F.broadcast(grand), how="cross").select(by, "n", "total", "mean", ratio(F.col("total"), F.col("_g")).alias("share"))


def histogram(rows: DataFrame, value: str, edges: list[float], labels: list[str]) -> DataFrame:
    """Counts of right-closed bins (edges one more than labels), empty ones included."""
    v = F.col(value)
    hit = [F.count_if((v > a) & (v <= b)).alias(x) for a, b, x in zip(edges, edges[1:], labels, strict=False)]
    one = rows.agg(*hit)
    return one.select(F.inline(F.array(*[F.struct(F.lit(i).alias("no"), F.lit(x).alias("bin"), F.col(x).alias("n")) for i, x in enumerate(labels)])))


def percentiles(rows: DataFrame, value: str, at: list[float], by: list[str] | None = None) -> DataFrame:
    """n, mean, sample deviation (std), exact percentiles (p50 and so on) and maximum (largest); groups without values have nulls.

    Percentiles come from counts of values over ranges, so a group may be of any size.
    """
    by = by or []
    named = {f"p{round(100 * p)}": p for p in at}
    own, keys = keyed(rows, by, v=value)
    basic = own.groupBy(*keys).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.max("v").alias("largest"))
    found = met(basic, quantiles(own, keys, "v", named), keys, "left")
    return unkeyed(found.select(*keys, "n", "mean", "std", *named, "largest"), by)


def sweep(rows: DataFrame, score: str, item: str, grid: list[float]) -> DataFrame:
    """Rows and distinct items at or over each threshold, from each item's best score and a row count by thresholds reached."""
    reached = sum((F.when(F.col(score) >= t, 1).otherwise(0) for t in grid), F.lit(0))
    per = rows.groupBy(item).agg(F.max(score).alias("_best"))
    steps = [F.struct(F.lit(i).alias("no"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)]

    def over(hist: DataFrame, name: str) -> DataFrame:
        flat = hist.select("r", "n", F.inline(F.array(*steps)))
        return flat.groupBy("threshold").agg(F.sum(F.when(F.col("r") > F.col("no"), F.col("n")).otherwise(0)).alias(name))

    grid_sorted = sorted(grid)
    assert grid_sorted == list(grid), "thresholds must ascend"
    row_hist = rows.groupBy(reached.alias("r")).agg(F.count("*").alias("n"))
    item_hist = per.groupBy(sum((F.when(F.col("_best") >= t, 1).otherwise(0) for t in grid), F.lit(0)).alias("r")).agg(F.count("*").alias("n"))
    return over(row_hist, "pairs").join(over(item_hist, "items"), "threshold")


def topline(rows: DataFrame, item: str, group: str) -> DataFrame:
    """Rows, distinct items, groups, least, largest, mean and exact median group size."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("size"))
    per = sizes.agg(F.count("*").alias("groups"), F.min("size").alias("least"), F.max("size").alias("largest"), F.avg("size").alias("mean"), F.percentile("size", 0.5).alias("median"))
    return rows.agg(F.count("*").alias("n"), F.countDistinct(item).alias("items")).join(per, how="cross")


def first_by(rows: DataFrame, by: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """The first row of each group in an order, by one aggregation that combines before it shuffles."""
    kept = [c for c in keep if c not in by]
    best = F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *kept)).alias("_r")
    return rows.groupBy(*by).agg(best).select(*by, *[F.col(f"_r.{c}").alias(c) for c in kept])


def extremes(rows: DataFrame, value: str, tie: str, k: int) -> DataFrame:
    """The k largest and the k smallest rows, marked."""
    high = rows.orderBy(F.desc(value), tie).limit(k).withColumn("side", F.lit("high"))
    return high.unionByName(rows.orderBy(F.asc(value), tie).limit(k).withColumn("side", F.lit("low")))


def flag_rates(rows: DataFrame, by: str, flag: str) -> DataFrame:
    """(key, n, n_flag, rate) of a boolean column by the values of another; rows with a null flag don't count, a null key is a key."""
    per = rows.where(F.col(flag).isNotNull()).groupBy(F.col(by).alias("key")).agg(F.count("*").alias("n"), F.count_if(F.col(flag)).alias("n_flag"))
    return per.withColumn("rate", ratio(F.col("n_flag"), F.col("n")))


def ordered_rates(rows: DataFrame, by: str, flag: str, order: list[str]) -> DataFrame:
    """``flag_rates`` of the listed keys in their order (no), each with its share of all their rows in per cent; keys without rows have zeros."""
    keys = rows.sparkSession.createDataFrame([(i, x) for i, x in enumerate(order)], "no int, key string")
    per = keys.join(flag_rates(rows.where(F.col(by).isin(order)), by, flag), "key", "left").fillna(0)
    grand = per.agg(F.sum("n").alias("grand"))
    return per.join(F.broadcast(grand), how="cross").select("no", "key", "n", "n_flag", "rate", (100 * ratio(F.col("n"), F.col("grand"))).alias("pct"))


def status_totals(rows: DataFrame, status: str, statuses: list[str]) -> DataFrame:
    """One row: how many rows there should be (total), how many have one of the statuses (actual), and each status's number."""
    each = [F.count_if(F.col(status) == s).alias(s) for s in statuses]
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col(status).isin(statuses)).alias("actual"), *each)


def group_sizes(rows: DataFrame, by: str) -> DataFrame:
    """One row: the number of groups, and the exact median of their sizes, cut to a whole number; null keys form no group, 0 for none.

    Sizes are counted first, so the median is taken over as many values as there are different sizes.
    """
    sizes = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("times"))
    return sizes.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("groups"), F.coalesce(F.floor(F.expr("percentile(size, 0.5D, times)")), F.lit(0)).alias("median"))
