"""Evaluation metrics as aggregations."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicflow.functions.numbers import f1, ratio
from civicflow.operators.ordering import kendall, spearman

__all__ = ["kendall", "spearman"]  # with the other metrics


def confusion(rows: DataFrame, predicted: Column, actual: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and f1 of boolean columns."""
    p, a = F.coalesce(predicted, F.lit(False)), F.coalesce(actual, F.lit(False))
    counts = rows.groupBy(*(by or [])).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    rated = counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return rated.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def threshold_curve(rows: DataFrame, score: str, actual: Column, grid: list[float]) -> DataFrame:
    """Confusion counts at each threshold (score >= t), from one pass over the scores.

    Scores are counted by the number of thresholds that they reach, and the few counts summed up; rows
    are never multiplied by the grid.
    """
    grid = sorted(grid)
    reached = F.coalesce(sum((F.when(F.col(score) >= t, 1).otherwise(0) for t in grid), F.lit(0)), F.lit(0))
    hist = rows.groupBy(reached.alias("reached")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(actual, F.lit(False))).alias("pos"))
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("no"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)])).alias("step")
    met = hist.select("reached", "n", "pos", steps).select("reached", "n", "pos", "step.*")
    hit = F.col("reached") > F.col("no")
    sums = met.groupBy("threshold").agg(F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("n") - F.col("pos")).otherwise(0)).alias("fp"), F.sum(F.when(hit, 0).otherwise(F.col("pos"))).alias("fn"))
    rated = sums.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return rated.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def best_threshold(rows: DataFrame, score: str, actual: Column, step: float = 0.01) -> DataFrame:
    """The threshold of the best f1, the lowest on ties."""
    n = round(1 / step)
    curve = threshold_curve(rows, score, actual, [round(i * step, 6) for i in range(n + 1)])
    return curve.orderBy(F.desc(F.round("f1", 9)), "threshold").limit(1)


def weight_grid(rows: DataFrame, a: str, b: str, actual: Column, weights: list[float], thresholds: list[float]) -> DataFrame:
    """f1 of w x a + (1 - w) x b at each weight and threshold."""
    wide = rows.select(actual.alias("_y"), F.explode(F.array(*[F.struct(F.lit(w).alias("weight"), (w * F.col(a) + (1 - w) * F.col(b)).alias("mixed")) for w in weights])).alias("m")).select("_y", "m.*")
    counts = wide.groupBy("weight").agg(*[x for i, t in enumerate(thresholds) for x in (F.count_if((F.col("mixed") >= t) & F.col("_y")).alias(f"tp{i}"), F.count_if((F.col("mixed") >= t) & ~F.col("_y")).alias(f"fp{i}"))], F.count_if("_y").alias("pos"))
    flat = counts.select("weight", "pos", F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")) for i, t in enumerate(thresholds)])))
    return flat.withColumn("f1", f1(ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("pos"))))


def covered_items(pairs: DataFrame, by: list[str], item: str, label: str, good: str = "same") -> DataFrame:
    """by, item and whether any of its pairs has the good label."""
    return pairs.groupBy(*by, item).agg(F.max(F.coalesce(F.col(label) == good, F.lit(False))).alias("hit"))


def overton(pairs: DataFrame, by: list[str], group: str, item: str, label: str) -> DataFrame:
    """Share of generated items with a match, over all and as the mean over groups; null over nothing, and 0 in the parity column."""
    items = covered_items(pairs, [*by, group], item, label)
    groups = items.groupBy(*by, group).agg(F.count("*").alias("n"), F.count_if("hit").alias("m"))
    total = groups.groupBy(*by).agg(F.sum("n").alias("items"), F.sum("m").alias("matched"), F.avg(F.col("m") / F.col("n")).alias("per_group"), F.count("*").alias("groups"))
    return total.withColumn("overall", F.try_divide(F.col("matched").cast("double"), F.col("items"))).withColumn("parity", ratio(F.col("matched"), F.col("items")))


def set_scores(left: DataFrame, right: DataFrame, by: str, item: str) -> DataFrame:
    """Precision, recall and f1 of a set (left) against another (right) in each group."""
    a, b = left.select(by, item).distinct().withColumn("_l", F.lit(1)), right.select(by, item).distinct().withColumn("_r", F.lit(1))
    counts = a.join(b, [by, item], "full").groupBy(by).agg(F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("both"), F.count("_l").alias("n_left"), F.count("_r").alias("n_right"))
    rated = counts.withColumn("precision", ratio(F.col("both"), F.col("n_left"))).withColumn("recall", ratio(F.col("both"), F.col("n_right")))
    return rated.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def correlation(x: str, y: str) -> Column:
    """Pearson's coefficient; null for a constant side, where ``corr`` fails in ANSI mode."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def pearson(rows: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Null for a constant side."""
    return rows.groupBy(*(by or [])).agg(correlation(x, y).alias("pearson"))


def _divergence(p: Column, q: Column, eps: float) -> Column:
    m = (p + q) / 2
    part = lambda a: F.when(a > 0, a * F.log((a + eps) / (m + eps))).otherwise(0.0)
    return (part(p) + part(q)) / 2


def jensen_shannon(counts: DataFrame, by: list[str], category: str, a: str, b: str, eps: float = 1e-12, zero_side: float | None = 0.5) -> DataFrame:
    """Divergence (natural logarithm) of two count columns over categories; where a side is all zeros, ``zero_side``, or no row if that is None."""
    w = Window.partitionBy(*by)
    shares = counts.select(*by, category, F.sum(a).over(w).alias("sa"), F.sum(b).over(w).alias("sb"), F.col(a).alias("a"), F.col(b).alias("b"))
    p, q = F.try_divide(F.col("a").cast("double"), F.col("sa")), F.try_divide(F.col("b").cast("double"), F.col("sb"))
    out = shares.groupBy(*by).agg(F.sum(_divergence(p, q, eps)).alias("d"), F.min(F.least("sa", "sb")).alias("least"))
    value = F.when(F.col("least") > 0, F.greatest(F.col("d"), F.lit(0.0))).otherwise(F.lit(zero_side))
    found = out.select(*by, value.alias("jsd"))
    return found if zero_side is not None else found.where("jsd is not null")


def smoothed_jensen_shannon(counts: DataFrame, by: list[str], category: str, a: str, b: str, eps: float = 1e-12) -> DataFrame:
    """The same with eps added to every share and shares made to add to 1 again."""
    w = Window.partitionBy(*by)
    p0, q0 = ratio(F.col(a), F.sum(a).over(w)) + eps, ratio(F.col(b), F.sum(b).over(w)) + eps
    shares = counts.select(*by, category, p0.alias("p0"), q0.alias("q0"))
    unit = shares.select(*by, (F.col("p0") / F.sum("p0").over(w)).alias("p"), (F.col("q0") / F.sum("q0").over(w)).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    return unit.groupBy(*by).agg(F.sum((F.col("p") * F.log(F.col("p") / m) + F.col("q") * F.log(F.col("q") / m)) / 2).alias("jsd"))


def ndcg(rows: DataFrame, by: list[str], item: str, gain: str, score: str, k: int = 10) -> DataFrame:
    """Linear-gain NDCG@k of each group with at least two items and positive sums on both sides."""
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(gain), item))
    own = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), item))
    ranked = rows.select(*by, F.col(gain).alias("g"), F.col(score).alias("s"), best.alias("best"), own.alias("own"))
    part = lambda r: F.sum(F.when(F.col(r) <= k, F.col("g") / F.log2(F.col(r) + 1.0)).otherwise(0.0))
    sums = ranked.groupBy(*by).agg(part("own").alias("dcg"), part("best").alias("idcg"), F.count("*").alias("n"), F.sum("g").alias("sg"), F.sum("s").alias("ss"))
    return sums.where("n >= 2 and sg > 0 and ss > 0").select(*by, F.try_divide("dcg", "idcg").alias("ndcg"))


def match_rates(items: DataFrame, pairs: DataFrame, item: str, label: str) -> DataFrame:
    """Shares of all items, those without candidates included, with a ``same`` pair (strict) and a ``same`` or ``related`` one (loose)."""
    best = pairs.groupBy(item).agg(F.max(F.col(label) == "same").alias("strict"), F.max(F.col(label).isin("same", "related")).alias("loose"))
    met = items.select(item).distinct().join(best, item, "left")
    rate = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int"))
    return met.agg(F.count("*").alias("items"), rate("strict").alias("strict"), rate("loose").alias("loose"))


def within_budget(rows: DataFrame, asked: str, given: str, slack: float = 0.2) -> DataFrame:
    known = rows.where(f"{asked} > 0")
    return known.agg(F.count("*").alias("n"), F.avg(F.col(given).between(F.col(asked) * (1 - slack), F.col(asked) * (1 + slack)).cast("int")).alias("compliance"))


def poisson_steps() -> list[int]:
    """For a uniform number of 53 bits, the least ones at which a Poisson weight of mean 1 reaches 1, 2 and so on."""
    term, total, steps = exp(-1), 0.0, []
    for k in range(1, 19):
        total += term
        term /= k
        steps.append(int(total * (1 << 53)))
    return [s for s in steps if s < 1 << 53]


def mixed(row: np.ndarray, draw: np.ndarray, seed: int) -> np.ndarray:
    """A uniform number of 53 bits for each row and draw: a linear step and the splitmix64 finaliser, all modulo 2**64."""
    z = row.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (draw.astype(np.uint64)[None, :] + np.uint64(seed)) * np.uint64(0xD1B54A32D192ED03)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z ^ (z >> np.uint64(31))) >> np.uint64(11)


def bootstrap(rows: DataFrame, by: list[str], value: str, draws: int = 1000, seed: int = 42, row: str | None = None) -> DataFrame:
    """by, n, mean, low and high: 2.5 and 97.5 percentiles of resampled means.

    A resample gives each row a Poisson weight of mean 1, so it is a sum over rows: a task adds up what it
    has of each group, a vector of sums for all resamples, and the vectors add up. With ``row``, a column
    of whole numbers that tells rows apart, weights come from a hash of (row, draw), and rows of one number
    are drawn together. Without it each value takes part with its count, by a generator that the
    value seeds. Null values don't count.
    """
    v, keys = F.col(value).cast("double"), [f"k{i}" for i in range(len(by))]
    given = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], v.alias("v"), F.lit(1).cast("long").alias("n") if row is None else F.col(row).cast("long").alias("h")).where("v is not null")
    if row is None:
        given = given.groupBy(*keys, "v").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64(*keys, "v"))
    else:
        given = given.where("h is not null").withColumn("n", F.lit(1).cast("long"))
    steps, drawn = np.array(poisson_steps(), np.uint64), np.arange(draws)

    def weights(h: np.ndarray, n: np.ndarray) -> np.ndarray:
        if row is None:
            return np.stack([np.random.default_rng([seed, int(x) & (1 << 64) - 1]).poisson(k, draws) for x, k in zip(h, n)]).astype(float)
        return np.searchsorted(steps, mixed(h, drawn, seed), side="right").astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}  # of each group: weights and weighted values of the rows as they are and of each resample

        def flushed() -> Iterator[pa.RecordBatch]:
            if sums:
                columns = [pa.array([g[i] for g in sums], batch[k].type) for i, k in enumerate(keys)]
                lists = [pa.array([s[i].tolist() for s in sums.values()], pa.list_(pa.float64())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, *lists], [*keys, "weights", "totals"])
            sums.clear()

        for batch in batches:
            groups: dict[tuple, list[int]] = {}
            for j, g in enumerate(zip(*[batch[k].to_pylist() for k in keys]) if keys else [()] * batch.num_rows):
                groups.setdefault(g, []).append(j)
            v, h, n = (batch[c].to_numpy() for c in ("v", "h", "n"))
            for g, at in groups.items():
                own = sums.setdefault(g, np.zeros((2, draws + 1)))
                for a in range(0, len(at), 512):
                    some = np.array(at[a : a + 512])
                    w = weights(h[some], n[some])
                    own[:, 0] += n[some].sum(), (n[some] * v[some]).sum()
                    own[0, 1:] += w.sum(0)
                    own[1, 1:] += v[some] @ w
            if len(sums) > 256:
                yield from flushed()
        yield from flushed()

    kinds = "".join(f"{k} {given.schema[k].dataType.simpleString()}, " for k in keys)
    parts = given.mapInArrow(run, f"{kinds}weights array<double>, totals array<double>")
    each = parts.select(*keys, F.posexplode(F.arrays_zip("weights", "totals")).alias("draw", "p"))
    added = each.groupBy(*keys, "draw").agg(F.sum("p.weights").alias("w"), F.sum("p.totals").alias("t"))
    mean = F.when(F.col("w") > 0, F.col("t") / F.col("w"))
    resampled = F.when(F.col("draw") > 0, mean)
    out = added.groupBy(*keys).agg(
        F.max(F.when(F.col("draw") == 0, F.col("w"))).cast("long").alias("n"), F.max(F.when(F.col("draw") == 0, mean)).alias("mean"),
        F.percentile(resampled, 0.025).alias("low"), F.percentile(resampled, 0.975).alias("high"),  # of as many values as there are draws
    )
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], "n", "mean", "low", "high")
