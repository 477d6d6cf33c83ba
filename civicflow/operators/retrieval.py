"""Sparse and dense retrieval: BM25, TF-IDF, exact vector search, fusion, recall.

Every ranking breaks ties by id. BM25, word overlap and vector search take a query set, cut into
parts of bounded size, against all rows; each task keeps the best of each query, so that what is
shuffled grows with tasks and queries, not with rows. A task scores as many rows at a time as make
``BLOCK`` scores with the queries of a part, so its memory is a part's queries, their best, and a block.
TF-IDF links meet on rare terms.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicflow.functions.batches import by_parts
from civicflow.functions.numbers import ratio
from civicflow.functions.text import tokens
from civicflow.storage import cut


BLOCK = 1 << 20  # scores that a task holds at a time
WAITING = 4096  # items whose scores it holds, as each item has arrays of its own

_words = re.compile("[^\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+").findall
_separators = re.compile("[\\x1c-\\x1f]").search


def split_words(text: str) -> list[str]:
    """What ``tokens`` splits at, for use in Python, which splits at four control characters more."""
    return _words(text) if _separators(text) else text.split()


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str, doc_text: str, query_id: str, query_text: str, k: int, k1: float = 1.5, b: float = 0.75, query_bytes: int = 16 << 20) -> DataFrame:
    """(query_id, id, score, rank): the k best documents of each query with a positive score, over lower-case white-space tokens.

    Queries are a stated set, read in parts of at most ``query_bytes`` of text. For each part, one pass
    counts documents and the frequencies of its terms; then each task scores its documents against all
    queries of the part and keeps the best of each, so postings never move. Ids are longs.
    """
    text = F.lower(F.coalesce(F.col(doc_text), F.lit("")))
    asked = cut(queries.select(F.col(query_id).cast("long").alias("query_id"), F.array_distinct(tokens(F.lower(F.col(query_text)))).alias("terms")).where("query_id is not null and size(terms) > 0"), "asked")
    size = asked.agg(F.sum(F.aggregate("terms", F.lit(64), lambda t, x: t + F.length(x) + 60)).alias("n")).first()["n"] or 0
    parts, found = max(1, -(-size // query_bytes)), None
    given = docs.select(F.col(doc_id).cast("long").alias("id"), text.alias("text"))
    for part in range(parts):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).orderBy("query_id").toArrow()
        counted = given.select("text").mapInArrow(_frequencies({t for x in own["terms"].to_pylist() for t in x}), "term string, df long, length long")
        df = {r["term"]: r for r in counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length")).collect()}  # this part's terms
        whole = df.pop(None, None)
        n, avgdl = (whole["df"], whole["length"] / whole["df"]) if whole else (0, None)
        idf = {t: float(np.log((n - r["df"] + 0.5) / (r["df"] + 0.5) + 1)) for t, r in df.items()}
        one = given.where("id is not null").mapInArrow(_bm25(own, idf, avgdl, k, k1, b), "query_id long, id long, score double")
        found = one if found is None else found.unionByName(one)
    best = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return top(best, ["query_id"], "score", "id", k)


def _frequencies(terms: set[str]):
    """In how many of a task's texts each term is, and, with a null term, the numbers of texts and of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, length = Counter(), 0, 0
        for batch in batches:
            for text in batch["text"]:
                own = split_words(text.as_py())
                n, length = n + 1, length + len(own)
                df.update(terms.intersection(own))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([*df, None], pa.string()), pa.array([*df.values(), n], pa.int64()), pa.array([0] * len(df) + [length], pa.int64())], ["term", "df", "length"])

    return run


def _bm25(asked: pa.Table, idf: dict[str, float], avgdl: float, k: int, k1: float, b: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = asked["terms"].to_pylist()
        posted: dict[str, list[int]] = {}
        for i, own in enumerate(lists):
            for t in own:
                if t in idf:
                    posted.setdefault(t, []).append(i)
        posts, best = {t: np.array(x) for t, x in posted.items()}, Best(len(lists), k)
        for batch in batches:
            for i, text in zip(batch["id"].to_pylist(), batch["text"], strict=True):
                own = split_words(text.as_py())
                norm, hits, weights = k1 * (1 - b + b * len(own) / avgdl) if avgdl else k1, [], []
                for t, tf in Counter(filter(posts.__contains__, own)).items():
                    hits.append(posts[t])
                    weights.append(np.full(len(posts[t]), idf[t] * tf * (k1 + 1) / (tf + norm)))
                if hits:
                    who, at = np.unique(np.concatenate(hits), return_inverse=True)
                    sums = np.bincount(at, np.concatenate(weights))
                    best.offer(who[sums > 0], i, sums[sums > 0])
        yield from best.rows(asked, [])

    return run


def top(rows: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each group with their rank from 1; scores count to nine places, so that equal ones tie on any engine."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.round(score, 9)), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_in_block(ranked: DataFrame, allowed: DataFrame, k: int) -> DataFrame:
    """A corpus-wide ranking, already cut, then restricted to pairs (query_id, id) of a block and cut again."""
    kept = ranked.drop("rank").join(allowed, ["query_id", "id"], "left_semi")
    return top(kept, ["query_id"], "score", "id", k)


def _tfidf_vectors(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts (side, block, id, k1, k2) and the unit vectors (side, block, k1, k2, term, w, from_here, after) of the different ones.

    k1 and k2 are hashes of a text's words. Terms are in ascending order of their frequency; from_here
    and after are the lengths of what a vector is from a term on, and behind it.
    """
    given = left.select(F.lit("l").alias("side"), "block", "id", "text").unionByName(right.select(F.lit("r").alias("side"), "block", "id", "text"))
    own = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^a-z0-9]+"), lambda w: F.length(w) >= 2)
    texts = given.where("block is not null and id is not null").select("side", "block", "id", own.alias("own"))
    texts = cut(texts.select("*", F.xxhash64("own").alias("k1"), F.xxhash64(F.lit("again"), "own").alias("k2")), "texts")
    key = ["side", "block", "k1", "k2"]
    different = texts.groupBy(*key).agg(F.count("*").alias("copies"), F.min("own").alias("own"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("own") - 1), lambda i: F.array_join(F.slice("own", i, 2), " "))
    every = F.when(F.size("own") > 1, F.concat("own", pairs)).otherwise(F.col("own"))
    terms = different.select(*key, "copies", F.explode(every).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"), F.min("copies").alias("copies"))
    df = terms.groupBy("block", "term").agg(F.sum("copies").alias("df"))
    n = texts.groupBy("block").agg(F.count("*").alias("n"))
    weighed = terms.join(df, ["block", "term"]).join(n, "block").withColumn("raw", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    whole = Window.partitionBy(*key)
    rest = whole.orderBy("df", "term").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    of_all, of_rest = F.sum(F.col("raw") * F.col("raw")).over(whole), F.sum(F.col("raw") * F.col("raw")).over(rest)
    square = F.col("raw") * F.col("raw") / F.col("all")
    unit = weighed.withColumns({"all": of_all, "rest": of_rest}).select(*key, "term", (F.col("raw") / F.sqrt("all")).alias("w"), F.sqrt(F.col("rest") / F.col("all")).alias("from_here"), F.sqrt(F.greatest(F.col("rest") / F.col("all") - square, F.lit(0.0))).alias("after"))
    return texts.drop("own"), cut(unit, "unit")


def _tfidf_candidates(unit: DataFrame, least: float) -> DataFrame:
    """(block, l1, l2, r1, r2): pairs of texts of both sides that can be as alike as ``least``.

    What a vector is behind its first terms may be shorter than ``least``; two vectors that have only
    such terms in common are less alike than that. So a pair meets in the rare terms before, if at all.
    Of a pair that meets, the products of what it shares there, and the lengths of what follows, bound
    its likeness.
    """
    rare = unit.where(F.col("from_here") >= least - 1e-9)
    a = rare.where("side = 'l'").select("block", "term", F.col("k1").alias("l1"), F.col("k2").alias("l2"), F.col("w").alias("wl"), F.col("after").alias("al"))
    b = rare.where("side = 'r'").select("block", "term", F.col("k1").alias("r1"), F.col("k2").alias("r2"), F.col("w").alias("wr"), F.col("after").alias("ar"))
    met = a.join(b, ["block", "term"]).groupBy("block", "l1", "l2", "r1", "r2").agg(F.sum(F.col("wl") * F.col("wr")).alias("shared"), F.min(F.col("al") * F.col("ar")).alias("rest"))
    return met.where(F.col("shared") + F.col("rest") >= least - 1e-9).drop("shared", "rest")


def tfidf_links(left: DataFrame, right: DataFrame, least: float = 0.6) -> DataFrame:
    """(block, left_id, right_id, score): the best match of each left row among right rows of its block, of those as alike as ``least``, which is positive.

    left and right have (block, id, text). Terms are words and pairs of neighbouring words; weights
    are tf x (ln((1 + n) / (1 + df)) + 1), vectors are normalised. Ties go to the least right id.
    Copies of a text count for frequencies and are compared once. Rows of one id with different texts
    are texts of their own. Rows without a block, id or word of two letters find nothing.
    """
    texts, unit = _tfidf_vectors(left, right)
    pairs = cut(_tfidf_candidates(unit, least), "candidates")
    a = unit.where("side = 'l'").select("block", F.col("k1").alias("l1"), F.col("k2").alias("l2"), "term", F.col("w").alias("wl"))
    b = unit.where("side = 'r'").select("block", F.col("k1").alias("r1"), F.col("k2").alias("r2"), "term", F.col("w").alias("wr"))
    scored = pairs.join(a, ["block", "l1", "l2"]).join(b, ["block", "r1", "r2", "term"]).groupBy("block", "l1", "l2", "r1", "r2").agg(F.sum(F.col("wl") * F.col("wr")).alias("score"))
    first = texts.where("side = 'r'").groupBy("block", F.col("k1").alias("r1"), F.col("k2").alias("r2")).agg(F.min("id").alias("right_id"))
    named = scored.where(F.col("score") >= least).join(first, ["block", "r1", "r2"])
    best = top(named, ["block", "l1", "l2"], "score", "right_id", 1).drop("rank", "r1", "r2")
    asking = texts.where("side = 'l'").select("block", F.col("id").alias("left_id"), F.col("k1").alias("l1"), F.col("k2").alias("l2"))
    found = asking.join(best, ["block", "l1", "l2"]).select("block", "left_id", "right_id", "score")
    return top(found, ["block", "left_id"], "score", "right_id", 1).drop("rank")


QUERY_BYTES = 64 << 20


def search(queries: DataFrame, items: DataFrame, vector: str, k: int, block: list[str] | None = None, above: float | None = None, skip_own: bool = True, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(block, query_id, id, score, rank): the k items nearest to each query, by cosine, of the same block if there are any.

    queries has (block, query_id, vector), items (block, id, vector); ids are longs. The queries are a
    stated set. They are read in parts of at most ``query_bytes``, each of which meets all items in
    one pass, and a pass's part is what the driver and a task hold. A vector of zeros, with nulls, or of
    another length isn't found, nor is an item with the query's own id, unless the two are ids of different things. Repeated ids count once, by their
    best score. No items or queries, no rows.
    """
    block = block or []
    keys = T.StructType([T.StructField(c, queries.schema[c].dataType) for c in block])
    schema = T.StructType([*keys.fields, T.StructField("query_id", T.LongType()), T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType())])
    asked = queries.select(*block, F.col("query_id").cast("long"), F.col(vector).cast("array<double>").alias("v")).where("query_id is not null and v is not null")
    given = items.select(*block, F.col("id").cast("long"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    size = asked.agg(F.sum(F.size("v") * 8 + 64).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // query_bytes))
    found = None
    for part in range(parts):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).orderBy("query_id").toArrow()
        one = given.mapInArrow(_nearest(own, block, k, above, skip_own), schema)
        found = one if found is None else found.unionByName(one)
    best = found.groupBy(*block, "query_id", "id").agg(F.max("score").alias("score"))
    return top(best, [*block, "query_id"], "score", "id", k)


def _nearest(asked: pa.Table, block: list[str], k: int, above: float | None, skip_own: bool):
    """A function of a task's items that gives the best of each query of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, dict[tuple, list[int]]] = {}  # rows of the queries of a block and length
        vectors, ids = asked["v"].to_pylist(), asked["query_id"].to_pylist()
        for i, at in enumerate(zip(*[asked[c].to_pylist() for c in block]) if block else [()] * len(ids)):
            groups.setdefault((at, len(vectors[i])), []).append(i)
        units = {key: unit_rows(np.array([vectors[i] for i in rows], float)) for key, rows in groups.items()}
        best, numbers = Best(len(ids), k), np.array(ids, np.int64)
        for batch in batches:
            lengths = batch["v"].value_lengths().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            flat, own = batch["v"].flatten().to_numpy(zero_copy_only=False), batch["id"].to_numpy()
            at = list(zip(*[batch[c].to_pylist() for c in block])) if block else [()] * len(own)
            by: dict[tuple, list[int]] = {}
            for j, n in enumerate(lengths.tolist()):
                if (at[j], n) in groups:
                    by.setdefault((at[j], n), []).append(j)
            for key, rows in by.items():
                asking, items = np.array(groups[key]), np.array(rows)
                for some in pieces(items, len(asking)):
                    x = unit_rows(flat[starts[some][:, None] + np.arange(key[1])])
                    best.offer_all(asking, units[key] @ x.T, own[some], numbers[asking] if skip_own else None, above)
        yield from best.rows(asked, block)

    return run


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths; a row of zeros, or with a missing number, becomes NaN."""
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        return v / np.sqrt((v * v).sum(1))[:, None]


def pieces(rows: np.ndarray, queries: int) -> Iterator[np.ndarray]:
    """Rows in parts that make at most ``BLOCK`` scores with so many queries, one row at least."""
    step = max(1, BLOCK // max(1, queries))
    return (rows[a : a + step] for a in range(0, len(rows), step))


class Best:
    """The k best items of each of n queries that a task has seen, by scores to nine places and then by the least id.

    An item that comes again counts once, by its best score.
    """

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self._waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._n = 0

    def offer(self, who: np.ndarray, item: int, scores: np.ndarray) -> None:
        """One item and its scores for some queries."""
        some = np.round(scores, 9) >= np.round(self.scores[who, -1], 9)
        if some.any():
            self._waiting.append((who[some], np.full(np.count_nonzero(some), item), scores[some]))
            self._n += np.count_nonzero(some)
            if self._n >= BLOCK or len(self._waiting) >= WAITING:
                self._merge()

    def offer_all(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray | None = None, above: float | None = None) -> None:
        """A block of scores, a row for each query; NaN doesn't count, nor does an item with the query's own id if these are given."""
        scores = np.where(np.isnan(scores), -np.inf, scores)
        if own is not None:
            scores[own[:, None] == ids[None, :]] = -np.inf
        if above is not None:
            scores[scores <= above] = -np.inf
        order = np.argsort(ids, kind="stable")
        different, begins = np.unique(ids[order], return_index=True)
        if len(different) < len(ids):
            ids, scores = different, np.maximum.reduceat(scores[:, order], begins, axis=1)
        rounded = np.round(scores, 9)
        least = np.round(self.scores[who, -1], 9)
        if len(ids) > self.k:  # an item below the block's own k-th can't be among the best
            least = np.maximum(least, -np.partition(-rounded, self.k - 1, axis=1)[:, self.k - 1])
        row, item = np.nonzero((rounded >= least[:, None]) & (scores > -np.inf))
        if len(row):
            self._waiting.append((who[row], ids[item], scores[row, item]))
            self._merge()

    def _merge(self) -> None:
        who, ids, scores = (np.concatenate(x) for x in zip(*self._waiting))
        self._waiting, self._n = [], 0
        rows, at = np.unique(who, return_inverse=True)
        at = np.concatenate([np.repeat(np.arange(len(rows)), self.k), at])
        ids, scores = np.concatenate([self.ids[rows].ravel(), ids]), np.concatenate([self.scores[rows].ravel(), scores])
        rounded = np.round(scores, 9)
        order = np.lexsort((-rounded, ids, at))
        at, ids, scores, rounded = at[order], ids[order], scores[order], rounded[order]
        first = np.concatenate([[True], (at[1:] != at[:-1]) | (ids[1:] != ids[:-1])])
        at, ids, scores, rounded = at[first], ids[first], scores[first], rounded[first]
        order = np.lexsort((ids, -rounded, at))
        at, ids, scores = at[order], ids[order], scores[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        kept = rank < self.k
        self.scores[rows], self.ids[rows] = -np.inf, np.iinfo(np.int64).max
        self.scores[rows[at[kept]], rank[kept]], self.ids[rows[at[kept]], rank[kept]] = scores[kept], ids[kept]

    def rows(self, asked: pa.Table, keys: list[str]) -> Iterator[pa.RecordBatch]:
        """The columns ``keys`` and query_id of the queries, each with id and score of its best items."""
        if self._waiting:
            self._merge()
        who, rank = np.nonzero(self.scores > -np.inf)
        if len(who):
            cols = [asked[c].combine_chunks().take(pa.array(who)) for c in (*keys, "query_id")]
            cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(self.ids[who, rank], pa.int64()), pa.array(self.scores[who, rank], pa.float64())], [*keys, "query_id", "id", "score"])


def overlap_search(queries: DataFrame, items: DataFrame, words: str, k: int, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, id, score, rank): the k items whose distinct words overlap most with each query's, by their share of the smaller set.

    queries has (query_id, words), items (id, words); words are arrays of distinct words. Queries are
    read in parts like those of ``search``. Rows without common words aren't found.
    """
    asked = queries.select(F.col("query_id").cast("long"), F.col(words).alias("w")).where(F.col("query_id").isNotNull() & (F.size("w") > 0))
    given = items.select(F.col("id").cast("long"), F.col(words).alias("w")).where(F.col("id").isNotNull() & (F.size("w") > 0))
    size = asked.agg(F.sum(F.aggregate("w", F.lit(64), lambda n, x: n + F.length(x) + 60)).alias("n")).first()["n"] or 0
    parts, found = max(1, -(-size // query_bytes)), None
    for part in range(parts):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).orderBy("query_id").toArrow()
        one = given.mapInArrow(_overlapping(own, k), "query_id long, id long, score double")
        found = one if found is None else found.unionByName(one)
    best = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return top(best, ["query_id"], "score", "id", k)


def _overlapping(asked: pa.Table, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posted: dict[str, list[int]] = {}
        lists = asked["w"].to_pylist()
        for i, own in enumerate(lists):
            for w in own:
                posted.setdefault(w, []).append(i)
        posts = {w: np.array(x) for w, x in posted.items()}
        sizes, best = np.array([len(x) for x in lists]), Best(len(lists), k)
        for batch in batches:
            for i, words in zip(batch["id"].to_pylist(), batch["w"], strict=True):
                own = words.as_py()
                hits = [posts[w] for w in own if w in posts]
                if hits:
                    who, shared = np.unique(np.concatenate(hits), return_counts=True)
                    best.offer(who, i, shared / np.minimum(sizes[who], len(own)))
        yield from best.rows(asked, [])

    return run


def hashed_words(text: Column, dims: int = 256) -> Column:
    """Counts of a text's lower-case white-space words by the first byte of their md5: a dense vector that any SQL engine can compute."""
    def counted(texts: pa.Array) -> pa.Array:
        rows = [np.bincount(np.fromiter(map(_first_byte, split_words(t or "")), np.int64), minlength=dims) for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows).astype(float)))

    return by_parts(counted, "array<double>")(F.lower(text))


@lru_cache(1 << 17)
def _first_byte(word: str) -> int:
    return hashlib.md5(word.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()[0]


def reciprocal_rank_fusion(*ranked: DataFrame, constant: int = 60) -> DataFrame:
    """(query_id, id, score, rank) of several rankings (query_id, id, rank from 1): sums of 1 / (constant + rank)."""
    every = ranked[0].select("query_id", "id", "rank")
    for r in ranked[1:]:
        every = every.unionByName(r.select("query_id", "id", "rank"))
    scored = every.groupBy("query_id", "id").agg(F.sum(1 / (constant + F.col("rank"))).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(w))


def dense_or_sparse(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """All dense hits, and sparse hits that dense retrieval missed with a dense score of 0. Dense hits are read twice, so they are written first: k a query."""
    dense = cut(dense.select("query_id", "id", "score"), "dense")
    only = sparse.select("query_id", "id").join(dense.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return dense.select("query_id", "id", F.col("score").alias("dense_score")).unionByName(only.withColumn("dense_score", F.lit(0.0)))


def recall_at(ranked: DataFrame, relevant: DataFrame, ks: list[int]) -> DataFrame:
    """(k, found, relevant, recall) of a ranking against relevant pairs (query_id, id)."""
    met = relevant.select("query_id", "id").join(ranked.select("query_id", "id", "rank"), ["query_id", "id"], "left")
    counts = met.agg(F.count("*").alias("relevant"), *[F.count_if(F.col("rank") <= k).alias(f"at{k}") for k in ks])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"at{k}").alias("found")) for k in ks])
    return counts.select("relevant", F.inline(rows)).withColumn("recall", ratio(F.col("found"), F.col("relevant")))


def unseen(items: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Items that an index hasn't: what an incremental build must add."""
    return items.join(index.select(*keys).distinct(), keys, "left_anti")


def once_per_text(rows: DataFrame, text: str, fn, result: str, kind: str) -> DataFrame:
    """Calls an expensive expression once for each distinct text and joins results back."""
    done = rows.select(text).distinct().withColumn(result, fn(F.col(text)).cast(kind))
    return rows.join(done, text, "left")


