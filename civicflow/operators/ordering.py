"""Ranks, quantiles and concordant pairs of groups of any size, from ranges of sorted values.

A group is never one task's. Values are counted, the counts are dealt to tasks by ranges of (group,
value), each task adds up its own, and what lies before a range comes from a table with a row for each
range and group. Ties are one row with a count, so a value that a third of all rows hold is no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicflow.storage import cut

PER_RANGE = 500_000  # rows of a range, about


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def keyed(rows: DataFrame, by: list[str], **columns: Column | str) -> tuple[DataFrame, list[str]]:
    """The columns of ``by`` under the names k0, k1 and so on, and others under names of one's choice."""
    keys = [f"k{i}" for i in range(len(by))]
    return rows.select(*[F.col(quoted(c)).alias(k) for c, k in zip(by, keys)], *[(F.col(quoted(c)) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]), keys


def unkeyed(rows: DataFrame, by: list[str]) -> DataFrame:
    """Back to the names of ``by``, which come first."""
    return rows.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(by)], *[c for c in rows.columns if c not in {f"k{i}" for i in range(len(by))}])


def met(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys are equal."""
    other = right.withColumnsRenamed({k: f"{k}_other" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_other"))
    return left.join(other, same, how).drop(*[f"{k}_other" for k in keys])


def _ranges(counted: DataFrame) -> int:
    return max(1, -(-counted.count() // PER_RANGE))


def with_before(counted: DataFrame, keys: list[str]) -> DataFrame:
    """counted (keys, v, n), a row for each value of each group, with before and total: the counts of the group's smaller values and of all its values.

    counted is read three times: hand in a table or the result of ``cut``.
    """
    dealt = counted.repartitionByRange(_ranges(counted), *keys, "v").withColumn("task", F.spark_partition_id())
    dealt = cut(dealt, "ranges")  # the same ranges for both readers
    at, group = [*keys, "task"], Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    sums = dealt.groupBy(*at).agg(F.sum("n").alias("own"))  # a row for each group and range
    earlier = F.coalesce(F.sum("own").over(group.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*at, earlier.alias("earlier"), F.sum("own").over(group).alias("total"))
    within = Window.partitionBy(*at).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)  # of one range, which is bounded
    placed = met(dealt, sums, at)
    return placed.select(*keys, "v", "n", (F.col("earlier") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("before"), "total")


def value_counts(rows: DataFrame, by: list[str], value: str) -> tuple[DataFrame, list[str]]:
    """A table (k0, ..., v, n): how often each value but null occurs in each group."""
    own, keys = keyed(rows.where(F.col(quoted(value)).isNotNull()), by, v=value)
    return cut(own.groupBy(*keys, "v").agg(F.count("*").alias("n")), "counted"), keys


def quantiles(rows: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """by and a column for each of ``at`` (name: share): the exact quantile, interpolated between neighbours. Groups without values have no row."""
    counted, keys = value_counts(rows, by, value)
    placed = with_before(counted, keys)
    out = []
    for name, p in at.items():
        place = (F.col("total") - 1) * F.lit(float(p))
        holds = lambda i: (F.col("before") <= i) & (i < F.col("before") + F.col("n"))
        low, high = F.floor(place), F.ceil(place)
        own = F.col("v").cast("double")
        # One of both if the place is a whole number, else a share of each neighbour.
        part = F.when(holds(low), own * F.when(low == high, 1.0).otherwise(high - place)).otherwise(0.0) + F.when(holds(high) & (low != high), own * (place - low)).otherwise(0.0)
        out.append(F.sum(part).alias(name))
    return unkeyed(placed.groupBy(*keys).agg(*out), by)


def average_ranks(counted: DataFrame, keys: list[str]) -> DataFrame:
    """counted (keys, v, n) with rank, the mean rank from 1 of a value's rows in its group, and total."""
    return with_before(counted, keys).select(*keys, "v", "n", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"), "total")


def pair_counts(rows: DataFrame, by: list[str], x: str, y: str) -> tuple[DataFrame, list[str]]:
    """A table (k0, ..., x, y, n): how often each pair of values, neither of them null, occurs in each group."""
    own, keys = keyed(rows.where(F.col(quoted(x)).isNotNull() & F.col(quoted(y)).isNotNull()), by, x=x, y=y)
    return cut(own.groupBy(*keys, "x", "y").agg(F.count("*").alias("n")), "cells"), keys


def spearman(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by and spearman: Pearson's coefficient of average ranks; rows with a null side don't count, and groups without others have no row."""
    pairs, keys = pair_counts(rows, by, x, y)
    cells = pairs
    for c in ("x", "y"):
        counted = cut(pairs.groupBy(*keys, F.col(c).alias("v")).agg(F.sum("n").alias("n")), "counted")
        ranks = average_ranks(counted, keys).select(*keys, F.col("v").alias(c), (F.col("rank") - (F.col("total") + 1) / 2).alias(f"r{c}"))
        cells = met(cells, ranks, [*keys, c])
    sums = cells.groupBy(*keys).agg(*[F.sum(F.col("n") * F.col(a) * F.col(b)).alias(n) for a, b, n in (("rx", "ry", "xy"), ("rx", "rx", "xx"), ("ry", "ry", "yy"))])
    return unkeyed(sums.select(*keys, F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy"))).alias("spearman")), by)


def signed_pairs(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The sum over pairs of rows with different x of the product of their weights: plus where y rises with x, minus where it falls.

    Rows are different and sorted by x, then y. Halves of growing size are merged by y, and each row of a
    right half is counted against its left half, all halves of a size at once.
    """
    n = len(x)
    at = np.arange(n)
    rank = np.unique(y, return_inverse=True)[1].astype(np.int64)
    span, total, own, step = int(rank.max(initial=0)) + 1, 0.0, w.astype(float), 1
    # Within one x, y rises: what these pairs add is taken off.
    begins = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if n else at
    if n:
        total -= float(((np.add.reduceat(own, begins) ** 2) - np.add.reduceat(own * own, begins)).sum() / 2)
    while step < n:
        block, right = at // (2 * step), at // step % 2 == 1
        key = block * span + rank
        left_key, left_sum = key[~right], np.concatenate([[0.0], np.cumsum(own[~right])])
        edge = lambda k, side: left_sum[np.searchsorted(left_key, k, side)]
        mine = block[right] * span
        smaller = edge(key[right], "left") - edge(mine, "left")
        larger = edge(mine + span, "left") - edge(key[right], "right")
        total += float((own[right] * (smaller - larger)).sum())
        order = np.argsort(key, kind="stable")
        rank, own, step = rank[order], own[order], 2 * step
    return total


def _within_tasks(dealt: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """dealt (keys, x, y, n), sorted by keys, x and y in each task: its rows as (keys, y, task, n), and a row with s, the signed pairs, for each group of a task."""
    kinds = [dealt.schema[k] for k in keys] + [T.StructField(y, dealt.schema[y].dataType)]
    schema = T.StructType([*kinds, T.StructField("task", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("s", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []  # the rows of the group that is open

        def closed() -> pa.RecordBatch:
            own = pa.Table.from_batches(held)
            columns = [own[c].to_numpy() for c in (x, y, "n")]
            s = signed_pairs(*columns)
            first = [held[0].column(k).slice(0, 1) for k in keys]
            return pa.RecordBatch.from_arrays([*first, pa.nulls(1, held[0].schema.field(y).type), pa.array([task], pa.int32()), pa.array([0], pa.int64()), pa.array([s])], [*keys, y, "task", "n", "s"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows - 1, bool)
            for k in keys:
                a, b = batch[k].slice(1), batch[k].slice(0, batch.num_rows - 1)
                new |= ~pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) & ~(a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False))
            begins = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for a, b in zip(begins, begins[1:]):
                part = batch.slice(a, b - a)
                if held and any(held[0].column(k)[0].as_py() != part.column(k)[0].as_py() for k in keys):
                    yield closed()
                    held = []
                held.append(part)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in keys], batch[y], pa.array(np.full(n, task, np.int32)), batch["n"], pa.nulls(n, pa.float64())], [*keys, y, "task", "n", "s"])
        if held:
            yield closed()

    return dealt.select(*keys, x, y, F.col("n").cast("long").alias("n")).mapInArrow(run, schema)


def kendall(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by and kendall: tau-b; rows with a null side don't count, and groups without others have no row.

    Pairs are counted without being made. Cells (x, y) are dealt by ranges of x: a task counts the pairs
    within its range. Then they are dealt by ranges of y, each with the number of its x range: a task
    counts the pairs of different x ranges within its own. All other pairs lie in different ranges of
    both, and follow from the numbers of rows by pairs of ranges. Each step moves each cell once.
    """
    cells, keys = pair_counts(rows, by, x, y)
    ranges = _ranges(cells)
    order = lambda df, a, b: df.repartitionByRange(ranges, *keys, a).sortWithinPartitions(*keys, a, b)
    by_x = cut(_within_tasks(order(cells, "x", "y"), keys, "x", "y"), "by_x")
    signed = [by_x.where("s is not null")]
    if ranges > 1:
        moved = by_x.where("s is null").withColumnRenamed("task", "x_range").groupBy(*keys, "y", "x_range").agg(F.sum("n").alias("n"))
        by_y = cut(_within_tasks(order(moved, "y", "x_range"), keys, "y", "x_range"), "by_y")
        coarse = by_y.where("s is null").withColumnRenamed("task", "y_range").groupBy(*keys, "x_range", "y_range").agg(F.sum("n").alias("n"))
        once = coarse.repartition(*keys) if keys else coarse.coalesce(1)  # a row for each pair of ranges of a group
        signed += [by_y.where("s is not null"), _within_tasks(once.sortWithinPartitions(*keys, "x_range", "y_range"), keys, "x_range", "y_range").where("s is not null")]
    zero = F.lit(0.0)
    parts = [s.select(*keys, "s", zero.alias("n"), zero.alias("tx"), zero.alias("ty")) for s in signed]
    for c, mine in (("x", "tx"), ("y", "ty")):
        n = F.col("n").cast("double")
        per = cells.groupBy(*keys, c).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(n).alias("n"), F.sum(n * (n - 1) / 2).alias(mine))
        parts.append(per.select(*keys, zero.alias("s"), (F.col("n") if c == "x" else zero).alias("n"), *[(F.col(t) if t == mine else zero).alias(t) for t in ("tx", "ty")]))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    sums = every.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("s", "n", "tx", "ty")])
    n0 = F.col("n") * (F.col("n") - 1) / 2
    found = sums if keys else sums.where("n > 0")
    return unkeyed(found.select(*keys, F.try_divide("s", F.sqrt((n0 - F.col("tx")) * (n0 - F.col("ty")))).alias("kendall")), by)
