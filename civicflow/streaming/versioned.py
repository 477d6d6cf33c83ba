"""A table that several writers keep up to date: deltas by key, a log of commits, merging on reading.

A write puts its rows into a folder of its own and then one entry into the log, a file whose number no
other writer can take. Readers see what the log names, so a write is there as a whole or not at all, and
a folder without an entry, left by a crash, belongs to nothing. Writes don't depend on what they find, so
a writer whose number is taken goes on to the next one; the later entry wins. An entry's tag says which
batch it was, so a batch that comes again is left out.

Deltas are partitioned by a hash of the key: a lookup reads the buckets of its keys only. Compaction
merges all deltas of the moment into one, which takes the place of the last of them, so that writes that
were committed meanwhile still win.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicflow.storage import exists, put_if_absent, removed

LOG = "no long, tag string, folder string, place long, replaces array<string>, schema string"


@dataclass
class VersionedTable:
    """The table in a folder: one row for each key, of the last commit that has the key, and there the row of the greatest ``order``."""

    spark: SparkSession
    path: str
    keys: list[str]
    order: str
    buckets: int = 16

    def _log(self) -> list:
        path = f"{self.path}/log"
        return self.spark.read.schema(LOG).json(path).orderBy("no").collect() if exists(self.spark, path) else []

    @staticmethod
    def _live(log: list) -> list:
        gone = {f for e in log for f in e["replaces"]}
        return [e for e in log if e["folder"] and e["folder"] not in gone]

    def _commit(self, tag: str | None, folder: str | None, schema: str, of: Callable[[list], dict | None]) -> int | None:
        """Adds an entry, with what ``of`` makes of the log as it is when the number is free; none if that is None."""
        while True:
            log = self._log()
            more = None if tag is not None and any(e["tag"] == tag for e in log) else of(log)
            if more is None:
                if folder:
                    removed(self.spark, f"{self.path}/{folder}")
                return None
            no = log[-1]["no"] + 1 if log else 1
            entry = {"no": no, "tag": tag, "folder": folder, "place": no, "replaces": [], "schema": schema} | more
            if put_if_absent(self.spark, f"{self.path}/log/{no:012}.json", json.dumps(entry) + "\n"):
                return no

    def _first(self, rows: DataFrame, *order: str) -> DataFrame:
        """One row for each key: the greatest by ``order``, ties by all columns."""
        others = [c for c in rows.columns if c not in self.keys]
        best = F.max(F.struct(*order, *[c for c in others if c not in order])).alias("best")
        return rows.groupBy(*self.keys).agg(best).select(*self.keys, *[F.col("best")[c].alias(c) for c in others])

    def _written(self, rows: DataFrame) -> str:
        folder = f"delta-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows.withColumn("bucket_", bucket).write.partitionBy("bucket_").parquet(f"{self.path}/{folder}")
        return folder

    def upsert(self, rows: DataFrame, tag: str | None = None) -> int | None:
        """Adds rows, or takes the place of those with their keys; the commit's number, or None if the tag is known.

        All rows have the columns of the first write; ``order`` tells which of a key's rows of one write stays.
        """
        if tag is not None and any(e["tag"] == tag for e in self._log()):
            return None
        own = self._first(rows, self.order)
        return self._commit(tag, self._written(own), rows.schema.json(), lambda _: {})

    def foreach_batch(self) -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch: a batch of a query that is committed isn't added again."""

        def run(batch: DataFrame, no: int) -> None:
            query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
            self.upsert(batch, f"{query}:{no}")

        return run

    def _deltas(self, live: list, where=None) -> DataFrame:
        """The rows of all live deltas with place_, by which later ones win."""
        schema = T.StructType.fromJson(json.loads(live[0]["schema"]))
        own = schema.fieldNames()
        found = None
        for e in live:
            one = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket_", T.IntegerType())])).parquet(f"{self.path}/{e['folder']}")
            one = (one if where is None else one.where(where)).select(*own, F.lit(e["place"]).alias("place_"))
            found = one if found is None else found.unionByName(one)
        return found

    def read(self) -> DataFrame:
        """The table as of now."""
        live = self._live(self._log())
        if not live:
            raise FileNotFoundError(f"nothing is committed in {self.path}")
        return self._first(self._deltas(live), "place_", self.order).drop("place_")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys (a frame with the key columns); only their buckets are read."""
        live, wanted = self._live(self._log()), keys.select(*self.keys).distinct()
        buckets = [r[0] for r in wanted.select(F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")).distinct().collect()]
        own = self._deltas(live, F.col("bucket_").isin(buckets)).join(wanted, self.keys, "left_semi")
        return self._first(own, "place_", self.order).drop("place_")

    def compact(self) -> int | None:
        """Merges all deltas into one; None if there are fewer than two, or if another compaction came first."""
        live = self._live(self._log())
        if len(live) < 2:
            return None
        names = [e["folder"] for e in live]
        folder = self._written(self._first(self._deltas(live), "place_", self.order).drop("place_"))

        def still(log: list) -> dict | None:
            there = {e["folder"] for e in self._live(log)}
            return {"replaces": names, "place": max(e["place"] for e in live)} if there.issuperset(names) else None

        return self._commit(None, folder, live[0]["schema"], still)

    def vacuum(self) -> list[str]:
        """Removes the folders that compactions replaced, and returns their names. No reader of an older state may be at work."""
        log = self._log()
        names = [f for e in log for f in e["replaces"] if exists(self.spark, f"{self.path}/{f}")]
        for f in names:
            removed(self.spark, f"{self.path}/{f}")
        return names
