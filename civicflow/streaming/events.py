"""Resumable and windowed work over arriving rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from civicflow.operators.matching import by_priority
from civicflow.sources.sinks import append_distinct
from civicflow.storage import cut


def stream_table(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def keep_distinct(stream: DataFrame, path: str, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's unknown rows to a table. A batch that runs again after a failure finds its rows there and adds nothing, so each row counts once."""
    return stream.writeStream.foreachBatch(lambda df, _: append_distinct(df, path, key, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_within(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """The first row of each key, for keys that repeat within a delay; state is bounded by it."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def tumbling(rows: DataFrame, ts: str, width: str, by: list[str], value: str, delay: str | None = None) -> DataFrame:
    """Count and sum of each window; on a stream with a delay, windows close behind the watermark."""
    held = rows.withWatermark(ts, delay) if delay else rows
    return held.groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sliding(rows: DataFrame, ts: str, width: str, step: str, by: list[str], value: str, delay: str | None = None) -> DataFrame:
    held = rows.withWatermark(ts, delay) if delay else rows
    return held.groupBy(F.window(ts, width, step), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sessions(rows: DataFrame, ts: str, gap: str, by: list[str], delay: str | None = None) -> DataFrame:
    held = rows.withWatermark(ts, delay) if delay else rows
    return held.groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def shard_plan(rows: DataFrame, ts: str, cap: int) -> DataFrame:
    """(start, width, n, over): days; hours for days of more than ``cap`` rows; quarters for such hours. Quarters of more than ``cap`` rows are marked as over. What a capped interface can give whole.

    Quarters are counted once, and hours and days are sums of quarters.
    """
    quarter = rows.groupBy(F.window(ts, "15 minutes")["start"].alias("q")).agg(F.count("*").alias("n"))
    hour = quarter.groupBy(F.date_trunc("hour", "q").alias("h")).agg(F.sum("n").alias("n"))
    day = hour.groupBy(F.date_trunc("day", "h").alias("d")).agg(F.sum("n").alias("n"))
    full_days, full_hours = day.where(F.col("n") > cap).select("d"), hour.where(F.col("n") > cap).select("h")
    days = day.where(F.col("n") <= cap).select(F.col("d").alias("start"), F.lit("day").alias("width"), "n")
    hours = hour.where(F.col("n") <= cap).join(full_days, F.date_trunc("day", "h") == F.col("d"), "left_semi").select(F.col("h").alias("start"), F.lit("hour").alias("width"), "n")
    quarters = quarter.join(full_hours, F.date_trunc("hour", "q") == F.col("h"), "left_semi").select(F.col("q").alias("start"), F.lit("quarter").alias("width"), "n")
    return days.unionByName(hours).unionByName(quarters).withColumn("over", F.col("n") > cap)


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last version of each key."""
    return by_priority(rows, keys, -order, [])


def halved_plan(rows: DataFrame, ts: str, cap: int, unit: int = 900) -> DataFrame:
    """(start, seconds, n, over): the whole time in halves, and halves of halves, until each has at most ``cap`` rows.

    The range from the first row's unit (a quarter of an hour) on is filled up to a power of two of
    units, so that halves are runs of units whose numbers agree in their upper bits, and one
    aggregation for each length counts them all. An interval of one unit that still has more is marked
    as over. Empty intervals are left out.
    """
    counted = rows.where(F.col(ts).isNotNull()).groupBy(F.floor(F.unix_timestamp(ts) / unit).cast("long").alias("u")).agg(F.count("*").alias("n"))
    units = cut(counted, "units")
    ends = units.agg(F.min("u").alias("first"), F.max("u").alias("last")).first()
    if ends["first"] is None:
        return units.select(F.lit("").cast("timestamp").alias("start"), F.lit(0).cast("long").alias("seconds"), "n", F.lit(False).alias("over"))
    levels = (ends["last"] - ends["first"]).bit_length()
    at = (F.col("u") - ends["first"]).alias("i")
    by_level = [units.select(at, "n").groupBy(F.shiftright("i", d).alias("i")).agg(F.sum("n").alias("n")).select(F.lit(d).alias("d"), "i", "n") for d in range(levels + 1)]
    every = reduce(DataFrame.unionByName, by_level)
    parent = every.select((F.col("d") - 1).alias("pd"), F.col("i").alias("pi"), F.col("n").alias("pn"))
    met = every.join(parent, (F.col("d") == F.col("pd")) & (F.shiftright("i", 1) == F.col("pi")), "left")
    split = F.col("pn").isNull() | (F.col("pn") > cap)
    kept = met.where(split & ((F.col("n") <= cap) | (F.col("d") == 0)))
    width = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("d"))
    return kept.select(F.timestamp_seconds((ends["first"] + F.col("i") * width) * unit).alias("start"), (width * unit).alias("seconds"), "n", (F.col("n") > cap).alias("over"))
