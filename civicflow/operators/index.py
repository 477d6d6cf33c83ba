"""A vector index that is built, loaded and added to: vectors dealt to cells around centroids, searched exactly.

Centroids are learned by k-means from a bounded sample; every vector goes to the cell of its nearest
centroid, in a table partitioned by cell. For each cell the index knows how near to and how far from the
centroid its vectors lie. By the triangle inequality no vector of a cell is nearer to a query than the
query's distance to the centroid less the farthest, or the nearest less that distance. A search first
reads the cells around each query, which gives it k neighbours and the score of the k-th; then it reads
the cells that can still hold a better one, and no others. So its result is that of a scan of
everything; what the index saves depends on how well the vectors cluster.

Queries and vectors meet in blocks: a cell's vectors, and the queries that read it, are each cut by a
hash into parts of bounded size, and each pair of parts is one group with one matrix of scores, taken
piece by piece. A cell that holds a third of all vectors makes many such groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.operators.postings import TextIndex
from civicflow.operators.retrieval import Best, pieces, top, unit_rows, unseen
from civicflow.storage import cut, exists

VECTORS = "id long, v array<double>, distance double, cell int"
BOUNDS = "cell int, n long, nearest double, farthest double"
MOST_CELLS = 4096
ITEMS, QUERIES = 16384, 4096  # of a group, about
SLACK = 1e-7  # of scores: distances are rounded


def centroids(rows: DataFrame, vector: str, cells: int, sample: int = 65_536, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Unit centroids from about ``sample`` vectors, drawn by a hash of the vector; fewer if there are not so many different ones."""
    n = rows.count()
    drawn = rows.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    if n > sample:
        drawn = drawn.where(F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    lists = drawn.orderBy(F.xxhash64("v")).toArrow()["v"].to_pylist()
    lists = [v for v in lists if v and len(v) == len(lists[0]) and None not in v]
    if not lists:
        return np.zeros((0, 0))
    x = unit_rows(np.array(lists, float))
    x = np.unique(x[np.isfinite(x).all(1)], axis=0)
    at = x[np.random.default_rng(seed).permutation(len(x))[:cells]]
    for _ in range(rounds):
        own = np.concatenate([(part @ at.T).argmax(1) for part in pieces(x, len(at))]) if len(x) else np.zeros(0, int)
        sums = np.zeros_like(at)
        np.add.at(sums, own, x)
        length = np.sqrt((sums * sums).sum(1))
        at = np.where(length[:, None] > 0, sums / np.maximum(length, 1e-300)[:, None], at)
    return at


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of a column of lists and the numbers of their rows; vectors of zeros, with missing or infinite numbers or of another length are left out."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    rows = np.flatnonzero(lengths == width)
    if not len(rows) or not width:
        return np.zeros((0, width)), rows[:0]
    unit = unit_rows(column.flatten().to_numpy(zero_copy_only=False)[starts[rows][:, None] + np.arange(width)])
    good = np.isfinite(unit).all(1)
    return unit[good], rows[good]


def _distances(unit: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(1 + (at * at).sum(1)[None, :] - 2 * (unit @ at.T), 0))


def _placed(rows: DataFrame, vector: str, at: np.ndarray) -> DataFrame:
    """(id, v, distance, cell) of each row (id, vector): its nearest centroid, and how far that is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, numbers = _matrix(batch["v"], at.shape[1])
            for part in pieces(np.arange(len(numbers)), len(at)):
                far = _distances(unit[part], at)
                cell, own = far.argmin(1), batch.take(pa.array(numbers[part]))
                yield pa.RecordBatch.from_arrays([own["id"], own["v"], pa.array(far[np.arange(len(part)), cell]), pa.array(cell, pa.int32())], ["id", "v", "distance", "cell"])

    given = rows.select(F.col("id").cast("long"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    return given.mapInArrow(run, VECTORS)


@dataclass
class VectorIndex:
    """The folder of an index: ``vectors`` partitioned by cell, ``centroids``, and ``bounds`` with a row for each cell and addition."""

    spark: SparkSession
    path: str

    @classmethod
    def build(cls, rows: DataFrame, path: str, vector: str = "v", cells: int | None = None, sample: int = 65_536) -> VectorIndex:
        """An index of rows (id, vector); of repeated ids the least vector. The sample only places the centroids.

        There are as many cells as the root of the number of rows, up to ``MOST_CELLS``.
        """
        own = cls(rows.sparkSession, path)
        own._learn(rows, vector, cells, sample)
        own.add(rows, vector)
        return own

    def _learn(self, rows: DataFrame, vector: str, cells: int | None, sample: int) -> np.ndarray:
        at = centroids(rows, vector, cells or min(MOST_CELLS, max(1, isqrt(rows.count()))), sample)
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(at)], "cell int, v array<double>").write.mode("overwrite").parquet(f"{self.path}/centroids")
        return at

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        if not exists(spark, f"{path}/centroids"):
            raise FileNotFoundError(f"no index in {path}")
        return cls(spark, path)

    def centroids(self) -> np.ndarray:
        rows = self.spark.read.schema("cell int, v array<double>").parquet(f"{self.path}/centroids").orderBy("cell").collect()
        return np.array([r["v"] for r in rows], float).reshape(len(rows), len(rows[0]["v"]) if rows else 0)

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def vectors(self) -> DataFrame:
        return self._table("vectors", VECTORS)

    def bounds(self) -> DataFrame:
        """(cell, n, nearest, farthest) of every cell with vectors: a row for each cell, of ``MOST_CELLS`` or the given number at most."""
        return self._table("bounds", BOUNDS).groupBy("cell").agg(F.sum("n").alias("n"), F.min("nearest").alias("nearest"), F.max("farthest").alias("farthest"))

    def add(self, rows: DataFrame, vector: str = "v") -> None:
        """Adds the rows whose id isn't in the index; of repeated ids one, the least vector.

        An index that was built of nothing learns its cells from the first rows that are added. Bounds are written first: if the vectors then aren't, bounds are wider than they need be.
        """
        first = rows.where("id is not null").groupBy(F.col("id").cast("long").alias("id")).agg(F.min(vector).alias("v"))
        at = self.centroids()
        if not len(at):
            at = self._learn(first, "v", None, 65_536)
        placed = cut(_placed(unseen(first, self.vectors(), ["id"]), "v", at), "placed")
        counted = cut(placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("distance").alias("nearest"), F.max("distance").alias("farthest")), "counted")
        counted.coalesce(1).write.mode("append").parquet(f"{self.path}/bounds")
        largest = counted.agg(F.max("n").alias("n")).first()["n"] or 0
        salt = F.pmod(F.xxhash64("id"), F.lit(max(1, largest // 1_000_000)))  # a large cell makes several files
        placed.repartition("cell", salt).write.mode("append").partitionBy("cell").parquet(f"{self.path}/vectors")

    def _read_by(self, asked: DataFrame, k: int, bounds: list, second: bool) -> DataFrame:
        """(query_id, v, cell): the cells that each query of asked (query_id, v[, kth]) reads first, or then.

        First those of the nearest centroids that together hold k vectors; then all others in which
        the triangle inequality allows a score of kth or more.
        """
        at, cells = self.centroids(), np.array([r["cell"] for r in bounds], np.int64)
        n, nearest, farthest = (np.array([r[c] for r in bounds], float) for c in ("n", "nearest", "farthest"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit, numbers = _matrix(batch["v"], at.shape[1])
                for part in pieces(np.arange(len(numbers)), max(1, len(cells))):
                    far = _distances(unit[part], at[cells])
                    order = np.argsort(far, axis=1, kind="stable")
                    before = np.cumsum(n[order], axis=1) - n[order]
                    reads = np.zeros(far.shape, bool)
                    np.put_along_axis(reads, order, before < k, axis=1)
                    if second:
                        kth = batch["kth"].to_numpy(zero_copy_only=False)[numbers[part]]
                        least = np.maximum(np.maximum(far - farthest, nearest - far), 0)
                        reads = ~reads & (1 - least * least / 2 >= kth[:, None] - SLACK)
                    row, cell = np.nonzero(reads)
                    own = batch.take(pa.array(numbers[part][row]))
                    yield pa.RecordBatch.from_arrays([own["query_id"], own["v"], pa.array(cells[cell], pa.int32())], ["query_id", "v", "cell"])

        return asked.mapInArrow(run, "query_id long, v array<double>, cell int")

    def _met(self, reads: DataFrame, items: DataFrame, k: int, skip_own: bool) -> DataFrame:
        """(query_id, id, score): the k best of each group of reads (query_id, v, cell) and items (id, v, cell)."""
        asking = {r["cell"]: r["n"] for r in reads.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each cell
        sizes = [(r["cell"], -(-r["n"] // ITEMS), -(-asking[r["cell"]] // QUERIES)) for r in self.bounds().where(F.col("cell").isin(list(asking))).collect()]
        parts = F.broadcast(self.spark.createDataFrame(sizes, "cell int, item_parts long, query_parts long"))
        of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
        left = reads.join(parts, "cell").select("query_id", "v", "cell", of("query_id", "query_parts").alias("q"), every("item_parts").alias("i"))
        right = items.where(F.col("cell").isin(list(asking))).join(parts, "cell").select("id", "v", "cell", of("id", "item_parts").alias("i"), every("query_parts").alias("q"))
        width = self.centroids().shape[1]
        schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

        def run(asked: pa.Table, given: pa.Table) -> pa.Table:
            found: list[pa.RecordBatch] = []
            if asked.num_rows and given.num_rows:
                unit, rows = _matrix(asked["v"].combine_chunks(), width)
                other, numbers = _matrix(given["v"].combine_chunks(), width)
                query_ids, ids = asked["query_id"].to_numpy()[rows], given["id"].to_numpy()[numbers]
                best = Best(len(rows), k)
                for part in pieces(np.arange(len(ids)), len(rows)):
                    best.offer_all(np.arange(len(rows)), unit @ other[part].T, ids[part], query_ids if skip_own else None)
                found = list(best.rows(pa.table({"query_id": query_ids}), []))
            return pa.Table.from_batches(found, schema)

        keys = ["cell", "i", "q"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, id long, score double")

    def search(self, queries: DataFrame, k: int, vector: str = "v", allowed: DataFrame | None = None, skip_own: bool = False, most_share: float = 0.95) -> DataFrame:
        """(query_id, id, score, rank): the k vectors nearest to each query of queries (query_id, vector) by cosine, ties by the least id.

        With allowed (id), only those are found; the filter is skipped if it would let at least
        ``most_share`` of the index through. A query of zeros, with missing numbers or of another length
        finds nothing; of queries that repeat an id the least vector asks.
        """
        items, bounds = self.vectors(), self.bounds().orderBy("cell").collect()
        if allowed is not None:
            allowed = allowed.select(F.col("id").cast("long").alias("id")).distinct()
            if allowed.count() < most_share * items.count():
                items = items.join(allowed, "id", "left_semi")
        asked = queries.where("query_id is not null").groupBy(F.col("query_id").cast("long").alias("query_id")).agg(F.min(F.col(vector).cast("array<double>")).alias("v"))
        asked = cut(asked.where("v is not null"), "asked")
        more = k + skip_own
        near = cut(self._met(cut(self._read_by(asked, more, bounds, second=False), "reads"), items, k, skip_own), "near")
        kth = top(near, ["query_id"], "score", "id", k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
        known = asked.join(kth, "query_id", "left").select("query_id", "v", F.coalesce("kth", F.lit(-2.0)).alias("kth"))
        rest = self._met(cut(self._read_by(known, more, bounds, second=True), "reads"), items, k, skip_own)
        return top(near.unionByName(rest), ["query_id"], "score", "id", k)

    def cells_read(self, queries: DataFrame, k: int, vector: str = "v") -> DataFrame:
        """(query_id, cells): how many cells a search for the k nearest of each query (query_id, vector) reads."""
        asked, bounds = queries.select(F.col("query_id").cast("long"), F.col(vector).cast("array<double>").alias("v")), self.bounds().orderBy("cell").collect()
        kth = self.search(queries, k, vector).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
        known = asked.join(kth, "query_id", "left").select("query_id", "v", F.coalesce("kth", F.lit(-2.0)).alias("kth"))
        both = self._read_by(asked, k, bounds, second=False).unionByName(self._read_by(known, k, bounds, second=True))
        return both.groupBy("query_id").agg(F.count("*").alias("cells"))


@dataclass
class IndexBundle:
    """The three indexes of a collection: its texts for BM25, its primary vectors, and those of a further distribution."""

    spark: SparkSession
    path: str

    @classmethod
    def build(cls, texts: DataFrame, primary: DataFrame, distribution: DataFrame, path: str, cells: int | None = None) -> IndexBundle:
        """texts (id, text), primary and distribution (id, v). Missing ids and blank texts are skipped."""
        TextIndex.build(texts.where("trim(text) <> ''"), f"{path}/texts")
        VectorIndex.build(primary, f"{path}/primary", cells=cells)
        VectorIndex.build(distribution, f"{path}/distribution", cells=cells)
        return cls(texts.sparkSession, path)

    def texts(self) -> TextIndex:
        return TextIndex.load(self.spark, f"{self.path}/texts")

    def bm25(self, queries: DataFrame, k: int) -> DataFrame:
        """queries (query_id, text)."""
        return self.texts().search(queries, k)

    def primary(self) -> VectorIndex:
        return VectorIndex.load(self.spark, f"{self.path}/primary")

    def distribution(self) -> VectorIndex:
        return VectorIndex.load(self.spark, f"{self.path}/distribution")
