"""Pairs of comments and responses: sampling, scores, thresholds, roll-ups, incremental merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_rank(c: Column, seed: str = "0") -> Column:
    """A draw that depends on the key and a seed only; any SQL engine can compute it."""
    return F.md5(F.concat(F.lit(seed), F.lit(":"), c.cast("string")).cast("binary"))


def hash_sample(rows: DataFrame, key: str, n: int, seed: str = "0") -> DataFrame:
    return rows.orderBy(hash_rank(F.col(key), seed), key).limit(n)


def stratified_sample(rows: DataFrame, score: str, key: str, n: int, bins: int = 10, seed: str = "0") -> DataFrame:
    """n rows: n div bins of each of equal-width score bins, then others to fill up, all in hash order."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    draw = hash_rank(F.col(key), seed)
    w = Window.partitionBy("_bin").orderBy("_draw", key)
    # Up to 1,000, the limit on row numbers reaches below the shuffle: each task sends its n first rows of a bin only.
    ranked = rows.withColumn("_bin", b).withColumn("_draw", draw).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    order = F.when(F.col("_rn") <= n // bins, 0).otherwise(1)
    return ranked.orderBy(order, "_draw", key).limit(n).drop("_bin", "_draw", "_rn")


def group_split(rows: DataFrame, group: str, test: float = 0.1, validation: float = 0.15, seed: str = "0") -> DataFrame:
    """rows with a column split: whole groups go to test, validation or train by their hash."""
    x = F.conv(F.substring(hash_rank(F.col(group), seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.withColumn("split", F.when(x < test, "test").when(x < test + validation, "validation").otherwise("train"))


def row_split(rows: DataFrame, label: str, key: str, test: float = 0.2, seed: str = "0") -> DataFrame:
    """rows with a column split: within each label the same share, by hash."""
    x = F.conv(F.substring(hash_rank(F.concat_ws(":", F.col(label).cast("string"), F.col(key).cast("string")), seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.withColumn("split", F.when(x < test, "test").otherwise("train"))


def assign_model(rows: DataFrame, key: str, models: list[str]) -> DataFrame:
    no = F.conv(F.substring(hash_rank(F.col(key), "model"), 1, 8), 16, 10).cast("bigint") % len(models)
    return rows.withColumn("model", F.element_at(F.array(*map(F.lit, models)), (no + 1).cast("int")))


def labelled(rows: DataFrame, score: str, threshold: Column) -> DataFrame:
    return rows.withColumn("final_label", F.when(F.col(score) >= threshold, "yes").otherwise("no"))


def per_agency(rows: DataFrame, config: DataFrame, agency: str, column: str, usual: float) -> DataFrame:
    """A configured value of each row's agency, or the usual one; the configuration is a small table."""
    return rows.join(config.select(agency, column), agency, "left").withColumn(column, F.coalesce(column, F.lit(usual)))


def _matched() -> Column:
    return F.col("final_label") == "yes"



def joined_set(value: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(value)), ";")


def response_matches(pairs: DataFrame) -> DataFrame:
    """One row a response: its matched documents and clusters. pairs: response_key, doc_id, cluster_uid, final_label, score."""
    m = lambda c: F.when(_matched(), F.col(c).cast("string"))
    return pairs.groupBy("response_key").agg(
        F.count("*").alias("n_pairs"), F.count_if(_matched()).alias("n_matched"), joined_set(m("doc_id")).alias("matched_docs"),
        F.countDistinct(m("cluster_uid")).alias("n_clusters"), F.max("score").alias("best_score"),
    )


def comment_labels(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("doc_id").agg(
        F.max(_matched()).alias("has_match"), joined_set(F.when(_matched(), F.col("response_key").cast("string"))).alias("responses"),
        F.count_if(_matched()).alias("n_matched"), F.max("score").alias("best_score"),
    )


def cluster_labels(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("cluster_uid").agg(
        F.countDistinct("doc_id").alias("n_docs"), F.max(_matched()).alias("has_match"), F.count_if(_matched()).alias("n_rows_matched"),
        F.countDistinct(F.when(_matched(), F.col("response_key"))).alias("n_responses_matched"), F.max("score").alias("best_score"),
    )


def agreement(first: DataFrame, second: DataFrame, keys: list[str], label: str) -> DataFrame:
    """How often two labellings agree, and each one's rate of yes."""
    met = first.select(*keys, F.col(label).alias("_a")).join(second.select(*keys, F.col(label).alias("_b")), keys)
    return met.agg(F.count("*").alias("n"), F.avg((F.col("_a") == F.col("_b")).cast("int")).alias("agreement"), F.avg((F.col("_a") == "yes").cast("int")).alias("first_yes"), F.avg((F.col("_b") == "yes").cast("int")).alias("second_yes"))


def append_new(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """old, and of the new rows those with an unknown key, the first of each; missing columns become null.

    One shuffle by key: the first row of each key in the order (old before new, then ``order``).
    """
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in both.columns if c != "_age"]
    best = both.groupBy(key).agg(F.min_by(F.struct(*[c for c in cols if c != key]), F.struct("_age", order)).alias("_r"))
    return best.select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in cols])


def resume(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def by_priority(rows: DataFrame, keys: list[str], priority: Column, tie: list[str]) -> DataFrame:
    """The row of least priority for each key."""
    cols = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*cols), F.struct(priority.alias("_p"), *tie)).alias("_r")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def cached_labels(pairs: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """pairs with the cached label where there is one; only the others need a scorer."""
    return pairs.join(cache.select(*keys, F.col("label").alias("cached")), keys, "left")


def hard_negatives(pairs: DataFrame, anchor: str, other: str, score: str, same: Column) -> DataFrame:
    """The most similar pair of each anchor that isn't a true one."""
    return pairs.where(~same).groupBy(anchor).agg(F.max_by(other, F.struct(F.round(score, 9), -F.col(other))).alias(other), F.max(score).alias(score))


def class_weight(rows: DataFrame, positive: Column) -> DataFrame:
    n = rows.agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    return n.withColumn("weight", F.when((F.col("pos") == 0) | (F.col("neg") == 0), 1.0).otherwise(F.col("neg") / F.col("pos")))


def query_pairs(queries: DataFrame, others: DataFrame, by: str, key: str, most: int = 2048) -> DataFrame:
    """Every pair of a query and another row of its group ``by``, as one row of both frames' columns.

    All pairs are asked for, so their number is that of queries times rows of a group. Queries are
    dealt into parts of about ``most`` by a hash of ``key``, and a part of a group meets the group's
    rows in a task of its own; the other rows are copied once a part. So a task's pairs grow with the
    other rows only, however few groups there are. Do what concerns one side before.
    """
    parts = max(1, -(-queries.count() // most))
    tasks, part = max(queries.sparkSession.sparkContext.defaultParallelism, 16 * parts), "_part"
    a = queries.withColumn(part, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).repartition(tasks, by, part)
    b = others.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(tasks, by, part)
    return a.hint("shuffle_hash").join(b, [by, part]).drop(part)
