"""A stored BM25 index: postings in blocks that know their best, searched without reading all of them.

A task indexes its documents in segments: for each term, the segment's postings are sorted by how much a
document gains from the term and cut into blocks. A block keeps its highest frequency and its shortest
document, which bound every score in it under any mean length. Nothing is shuffled, so a term that all
documents have is spread like the documents. Blocks lie in buckets by a hash of their term, and a search
reads the buckets of its terms only.

A search first scores the terms from which a query can gain most. The k-th of these scores is a floor.
Terms that all together can add a part of it only bring no new documents; of the others' blocks only
those are read whose bound, with what all other terms can add, reaches the floor; and of the documents in
them only those go on that can still reach the k-th best of them. These are then scored over all terms.
The result is that of scoring every document.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicflow.functions.text import tokens
from civicflow.operators.retrieval import split_words, top, unseen
from civicflow.storage import cut, exists

BLOCK = 256
SEGMENT = 2_000_000  # postings that a task holds
BUCKETS = 16
DOCUMENTS = -1  # the bucket of the blocks that tell a segment's documents and their lengths
POSTINGS = "term string, n int, ids array<long>, tfs array<int>, lengths array<int>, most_tf int, least_length int, bucket int"
SHARE = 0.25  # of the floor: what the terms that are left to the last step may add together; more would leave it more documents
SMALL = 1_000_000  # rows (query, document, term) that every task may hold; more are joined by a shuffle
FIRST = 1000  # postings of a query's best terms that set the floor, about
K1, B = 1.5, 0.75


def gain(tf, length, mean: float):
    """What a term of idf 1 adds; it grows with the frequency and falls with the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _bucket(term: Column) -> Column:
    return (F.crc32(term.cast("binary")) % BUCKETS).cast("int")


class Segment:
    """Postings of some documents, and their blocks."""

    def __init__(self) -> None:
        self.terms: dict[str, int] = {}
        self.term, self.id, self.tf, self.length = array("q"), array("q"), array("i"), array("i")
        self.documents, self.lengths = array("q"), array("i")

    def add(self, doc_id: int, words: list[str]) -> None:
        counts = Counter(words)
        self.term.extend([self.terms.setdefault(w, len(self.terms)) for w in counts])
        self.id.extend([doc_id] * len(counts))
        self.tf.extend(counts.values())
        self.length.extend([len(words)] * len(counts))
        self.documents.append(doc_id)
        self.lengths.append(len(words))

    def blocks(self) -> Iterator[pa.RecordBatch]:
        names = np.array([*self.terms], object)
        term, ids, tfs, lengths = (np.array(x) for x in (self.term, self.id, self.tf, self.length))
        mean = max(1.0, float(np.mean(self.lengths))) if len(self.lengths) else 1.0
        order = np.lexsort((ids, -gain(tfs, lengths, mean), term))
        places = np.arange(len(order)) - np.searchsorted(term[order], term[order])
        own = np.flatnonzero(places % BLOCK == 0)
        yield from self._made(own, names[term[order][own]], [zlib.crc32(w.encode()) % BUCKETS for w in names[term[order][own]]], ids[order], tfs[order], lengths[order])
        n = len(self.documents)
        every = np.arange(0, n, 65_536)
        yield from self._made(every, [None] * len(every), [DOCUMENTS] * len(every), np.array(self.documents), np.ones(n, np.int32), np.array(self.lengths))

    @staticmethod
    def _made(begins: np.ndarray, names: list, buckets: list[int], ids: np.ndarray, tfs: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.append(begins[1:], len(ids))
        for a in range(0, len(begins), 20_000):
            b = min(a + 20_000, len(begins))
            first, last = begins[a], ends[b - 1]
            at = begins[a:b] - first
            offsets = pa.array(np.append(at, last - first).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[first:last], k)) for x, k in ((ids, pa.int64()), (tfs, pa.int32()), (lengths, pa.int32()))]
            yield pa.RecordBatch.from_arrays([
                pa.array(names[a:b], pa.string()), pa.array((ends - begins)[a:b], pa.int32()), *lists, pa.array(np.maximum.reduceat(tfs[first:last], at), pa.int32()),
                pa.array(np.minimum.reduceat(lengths[first:last], at), pa.int32()), pa.array(buckets[a:b], pa.int32()),
            ], ["term", "n", "ids", "tfs", "lengths", "most_tf", "least_length", "bucket"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of rows (id, text)."""
    segment = Segment()
    for batch in batches:
        for i, text in zip(batch["id"].to_pylist(), batch["text"], strict=True):
            segment.add(i, split_words(text.as_py()))
            if len(segment.term) >= SEGMENT:
                yield from segment.blocks()
                segment = Segment()
    if segment.documents:
        yield from segment.blocks()


def _opened() -> Column:
    """(id, tf, length) of each posting of a block."""
    return F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("tfs").alias("tf"), F.col("lengths").alias("length")))


def _scored(rows: DataFrame, mean: float) -> DataFrame:
    """(query_id, id, score) of rows (query_id, idf, id, tf, length)."""
    return rows.groupBy("query_id", "id").agg(F.sum(F.col("idf") * gain(F.col("tf"), F.col("length"), mean)).alias("score"))


@dataclass
class TextIndex:
    """The folder of an index: blocks partitioned by bucket, those of the documents' lengths among them, so that an addition is one write."""

    spark: SparkSession
    path: str

    @classmethod
    def build(cls, rows: DataFrame, path: str) -> TextIndex:
        """An index of rows (id, text), over lower-case white-space tokens; of repeated ids the least text, and null texts are empty."""
        own = cls(rows.sparkSession, path)
        own.spark.createDataFrame([], POSTINGS).write.partitionBy("bucket").parquet(f"{path}/postings")
        own.add(rows)
        return own

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextIndex:
        if not exists(spark, f"{path}/postings"):
            raise FileNotFoundError(f"no index in {path}")
        return cls(spark, path)

    def postings(self) -> DataFrame:
        return self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")

    def documents(self) -> DataFrame:
        """(id, length) of every document."""
        return self.postings().where(F.col("bucket") == DOCUMENTS).select(F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("lengths").alias("length"))))

    def add(self, rows: DataFrame) -> None:
        """Adds the rows whose id isn't in the index. Texts are shuffled only if ids repeat."""
        given = rows.where("id is not null").select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
        repeated = cut(given.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated")
        if not repeated.isEmpty():
            given = given.join(repeated, "id", "left_anti").unionByName(given.join(repeated, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))
        new = unseen(given, self.documents(), ["id"]).select("id", F.lower("text").alias("text"))
        new.mapInArrow(_blocks, POSTINGS).write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/postings")

    def _narrowed(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame, float]:
        """The postings of the queries' terms; (query_id, term, idf, with_less, floor, ...) of each query's terms; the blocks to read, each with its query; the mean length."""
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode(tokens(F.lower("text"))).alias("term")).where("query_id is not null").distinct()
        asked = cut(asked.withColumn("bucket", _bucket(F.col("term"))), "asked")
        stats = self.documents().agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
        n, mean = stats["n"], stats["mean"] or 1.0
        buckets = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # BUCKETS at most
        wanted = asked.select("term").distinct()
        own = self.postings().where(F.col("bucket").isin(buckets)).join(wanted, "term", "left_semi")
        idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        known = own.groupBy("term").agg(F.sum("n").alias("df"), F.max("most_tf").alias("tf"), F.min("least_length").alias("length"))
        known = known.select("term", "df", idf.alias("idf"), (idf * gain(F.col("tf"), F.col("length"), mean)).alias("most"))
        of_query = Window.partitionBy("query_id")  # a row for each of a query's words
        up, down = of_query.orderBy("most", "term"), of_query.orderBy(F.desc("most"), F.desc("term"))
        terms = asked.join(known, "term").select(
            "query_id", "term", "idf", F.sum("most").over(of_query).alias("all"), "most", F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, 0)).alias("with_less"),
            F.coalesce(F.sum("df").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("read_before"),
        )
        terms = cut(terms, "terms")
        # The terms of most gain, until they have enough postings, set the floor.
        first = _scored(own.join(terms.where(F.col("read_before") < max(FIRST, 10 * k)), "term").select("query_id", "idf", _opened()), mean)
        floor = top(first, ["query_id"], "score", "id", k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
        rated = cut(terms.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - 2e-9), "rated")
        needed = rated.where(F.col("with_less") >= SHARE * F.col("floor"))
        block = F.col("idf") * gain(F.col("most_tf"), F.col("least_length"), mean)
        return own, rated, own.join(needed, "term").where(block + F.col("all") - F.col("most") >= F.col("floor")), mean

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score, rank): the k best documents with a positive score for each query of queries (query_id, text), ties by the least id."""
        own, rated, blocks, mean = self._narrowed(queries, k)
        others = rated.groupBy("query_id").agg(F.max(F.when(F.col("with_less") < SHARE * F.col("floor"), F.col("with_less")).otherwise(0.0)).alias("of_others"), F.max("floor").alias("floor"))
        # What a document has in blocks left out isn't counted here: such a document can't reach the floor.
        partial = _scored(blocks.select("query_id", "idf", _opened()), mean).join(others, "query_id")
        partial = cut(partial.where(F.col("score") + F.col("of_others") >= F.col("floor")).select("query_id", "id", "score", "of_others"), "partial")
        # The k-th of these scores is a higher floor.
        higher = top(partial, ["query_id"], "score", "id", k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score") - 2e-9).alias("higher"))
        reaching = partial.join(higher, "query_id").where(F.col("higher").isNull() | (F.col("score") + F.col("of_others") >= F.col("higher"))).select("query_id", "id")
        # Postings are opened once, and meet the terms of the documents that go on.
        asking = cut(reaching.join(rated.select("query_id", "term", "idf"), "query_id"), "asking")
        if asking.count() <= SMALL:
            asking = F.broadcast(asking)
        whole = _scored(own.select("term", _opened()).join(asking, ["term", "id"]), mean)
        return top(whole.where("score > 0"), ["query_id"], "score", "id", k)
