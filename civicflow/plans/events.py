"""Windows over the events table, and joins of the lookup kind."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.plans import Plans, table
from civicflow.storage import shared_dir
from civicflow.streaming import events as E
from civicflow.streaming.versioned import VersionedTable

plans = Plans()


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _text(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c in names else F.col(c) for c in df.columns])


@plans.add("""
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4)::DOUBLE AS total FROM events GROUP BY 1, 2""")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.tumbling(_events(spark, sf_dir), "ts", "1 day", ["event_type"], "value")
    return _text(found.drop("end"), "start").withColumn("total", F.round("total", 4))


@plans.add("""
WITH w AS (SELECT date_trunc('hour', ts) - INTERVAL (h) HOUR AS start, event_type, value FROM events, range(0, 3) t(h))
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4)::DOUBLE AS total FROM w GROUP BY 1, 2""")
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.sliding(_events(spark, sf_dir), "ts", "3 hours", "1 hour", ["event_type"], "value")
    return _text(found.drop("end"), "start").withColumn("total", F.round("total", 4))


@plans.add("""
WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM o)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*)::BIGINT AS n FROM s GROUP BY user_id, no""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(E.sessions(_events(spark, sf_dir), "ts", "6 hours", ["user_id"]).drop("end"), "start")


@plans.add("""
WITH q AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS q, count(*) AS n FROM events GROUP BY 1), h AS (SELECT date_trunc('hour', q) AS h, sum(n) AS n FROM q GROUP BY 1), d AS (SELECT date_trunc('day', h) AS d, sum(n) AS n FROM h GROUP BY 1),
cap AS (SELECT max(n) * 0.9 AS day_cap, (SELECT max(n) FROM h) AS hour_most FROM d), c AS (SELECT 20 AS cap)
SELECT strftime(d, '%Y-%m-%d %H:%M:%S') AS start, 'day' AS width, n::BIGINT AS n, false AS over FROM d, c WHERE n <= cap UNION ALL
SELECT strftime(h, '%Y-%m-%d %H:%M:%S'), 'hour', n::BIGINT, false FROM h, c WHERE n <= cap AND date_trunc('day', h) IN (SELECT d FROM d, c WHERE n > cap) UNION ALL
SELECT strftime(q, '%Y-%m-%d %H:%M:%S'), 'quarter', n::BIGINT, n > cap FROM q, c WHERE date_trunc('hour', q) IN (SELECT h FROM h, c WHERE n > cap)""")
def shard_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(E.shard_plan(_events(spark, sf_dir), "ts", 20), "start")


@plans.add("""
SELECT user_id, event_id, (props->>'$.k')::INTEGER AS k FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.latest(_events(spark, sf_dir).select("user_id", "event_id", "props"), ["user_id"], F.col("event_id"))
    return found.select("user_id", "event_id", F.from_json("props", "struct<k:int>")["k"].alias("k"))


@plans.add("""
SELECT n_name AS nation, r_name AS region, count(c_custkey)::BIGINT AS customers, round(sum(c_acctbal), 2)::DOUBLE AS balance FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def lookup_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("balance"))
    met = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(per, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return met.select(F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.coalesce("customers", F.lit(0)).cast("long").alias("customers"), F.round("balance", 2).alias("balance"))


@plans.add("""
WITH RECURSIVE q AS (SELECT epoch(time_bucket(INTERVAL 15 MINUTE, ts))::BIGINT // 900 AS u, count(*) AS n FROM events GROUP BY 1),
e AS (SELECT min(u) AS lo, 2 ** ceil(log2(max(u) - min(u) + 1)) AS len FROM q),
cut(a, len, n) AS (SELECT lo, len::BIGINT, (SELECT sum(n) FROM q) FROM e UNION ALL
  SELECT h.a, h.len, (SELECT coalesce(sum(q.n), 0) FROM q WHERE q.u >= h.a AND q.u < h.a + h.len) FROM (SELECT unnest([cut.a, cut.a + cut.len // 2]) AS a, cut.len // 2 AS len FROM cut WHERE cut.n > 30 AND cut.len > 1) h)
SELECT strftime(to_timestamp(a * 900) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS start, (len * 900)::BIGINT AS seconds, n::BIGINT AS n, n > 30 AS over FROM cut WHERE n > 0 AND (n <= 30 OR len = 1)""")
def halved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole time halved until no part has more than 30 events."""
    return _text(E.halved_plan(_events(spark, sf_dir), "ts", 30), "start")


@plans.add("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 DESC, event_id DESC) = 1")
def versioned_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, from a table that takes all events in three batches and is compacted after the second."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    kept = VersionedTable(spark, f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}", ["user_id"], "event_id")
    for batch in range(3):
        kept.upsert(rows.where(F.col("event_id") % 3 == batch), f"batch {batch}")
        if batch == 1:
            kept.compact()
    return kept.read()
