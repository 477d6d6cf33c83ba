"""Writers: partitioned tables, padded schemas, deduplicated appends, done-unit logs, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicflow.operators.matching import append_new
from civicflow.storage import exists


def padded(df: DataFrame, columns: list[str], **fixed: str) -> DataFrame:
    """Exactly these columns; missing ones are null, fixed ones have their value."""
    have = set(df.columns)
    return df.select(*[F.lit(fixed[c]).alias(c) if c in fixed else F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns])


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    """One folder for each value of the keys, decided row by row. Rows are dealt by key and a salt, so that a large key makes several files of bounded size."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(8)) if not any(isinstance(f.dataType, T.MapType) for f in df.schema) else F.lit(0)
    df.repartition(*by, salt).write.mode(mode).partitionBy(*by).option("maxRecordsPerFile", 5_000_000).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(header=True, quote='"', escape='"', compression="gzip").csv(path)


def write_both(df: DataFrame, path: str) -> None:
    """Parquet for reading back, and CSV for exchange from the Parquet, so that the frame runs once."""
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    write_csv(df.sparkSession.read.parquet(f"{path}/parquet"), f"{path}/csv")


def _table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table that may not be there yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def append_distinct(df: DataFrame, path: str, key: str, order: str) -> None:
    """Appends the rows whose key the table hasn't; existing rows win, the first of new ones."""
    old = _table(df.sparkSession, path, df.schema)
    fresh = append_new(df.limit(0), df, key, order).join(old.select(key), key, "left_anti")
    fresh.select(*df.columns).write.mode("append").parquet(path)


def done_units(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, T.StructType([T.StructField("unit", T.StringType())]))


def mark_done(units: DataFrame, path: str) -> None:
    units.select("unit").distinct().write.mode("append").parquet(path)


def log_run(spark: SparkSession, path: str, **values: str) -> None:
    """One row in a log table, with the time."""
    row = spark.range(1).select(F.current_timestamp().alias("logged_at"), *[F.lit(str(v)).alias(k) for k, v in values.items()])
    row.write.mode("append").parquet(path)


def report(metrics: DataFrame) -> str:
    """A one-row frame as a Markdown table."""
    row = metrics.first()
    return "| metric | value |\n|---|---|\n" + "".join(f"| {k} | {v} |\n" for k, v in (row.asDict() if row else {}).items())


def covered_spans(spans: DataFrame, by: str) -> DataFrame:
    """(by, start, end, level) of the stretches of equal highest level under spans (by, start, end, level), ends exclusive.

    Each span is split at the bounds within it, and the highest level of each piece stays; neighbours
    of one level are joined. All work is within one text, so its spans are gathered in one shuffle and
    the rest is done on arrays, row by row: no table of pieces is aggregated.
    """
    item = F.struct("start", "end", "level")
    gathered = spans.where(f"{by} is not null").groupBy(by).agg(F.array_sort(F.collect_set(item)).alias("own"))
    at = F.array_sort(F.array_distinct(F.concat(F.transform("own", lambda x: x["start"]), F.transform("own", lambda x: x["end"]))))
    bounded = gathered.select(by, "own", at.alias("at"))

    def piece(start: Column, end: Column) -> Column:
        over = F.filter("own", lambda x: (x["start"] <= start) & (x["end"] > start))
        return F.struct(start.alias("start"), end.alias("end"), F.array_max(F.transform(over, lambda x: x["level"])).alias("level"), (F.size(over) > 0).alias("covered"))

    pieces = F.filter(F.zip_with(F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(0))), F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(0))), piece), lambda x: x["covered"])
    kind = spans.select(F.array(item).alias("k")).schema["k"].dataType
    items = bounded.select(by, F.transform(pieces, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["level"].alias("level"))).cast(kind).alias("s"))

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        same = F.coalesce((last["end"] == x["start"]) & (last["level"] == x["level"]), F.lit(False))
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), x["end"].alias("end"), x["level"].alias("level"))))
        return F.when(same, grown).otherwise(F.concat(acc, F.array(x)))

    return items.select(by, F.inline(F.aggregate("s", F.array().cast(kind), step)))
