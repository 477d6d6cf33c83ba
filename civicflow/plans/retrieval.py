"""Retrieval over benchmark passages, documents and embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.operators import metrics, retrieval as R
from civicflow.operators.index import VectorIndex
from civicflow.operators.postings import TextIndex
from civicflow.plans import Plans, table
from civicflow.storage import shared_dir

plans = Plans()

BM25_SQL = _BM25 = """
docs AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS tok FROM documents),
stats AS (SELECT count(*) AS n, avg(len(tok)) AS avgdl FROM docs),
tf AS (SELECT id, len(tok) AS dl, term, count(*) AS tf FROM (SELECT id, tok, unnest(tok) AS term FROM docs) GROUP BY id, len(tok), term),
asked AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM asked) GROUP BY term),
scored AS (SELECT query_id, id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term) JOIN asked USING (term), stats GROUP BY query_id, id),
ranked AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored WHERE score > 0)"""


def bm25_ranked(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return R.bm25(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", k)


@plans.add(f"WITH {_BM25} SELECT query_id, id, round(score, 6)::DOUBLE AS score, rank::INTEGER AS rank FROM ranked WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_ranked(spark, sf_dir, 10).withColumn("score", F.round("score", 6))


@plans.add(f"WITH {_BM25} SELECT query_id, id, round(score, 6)::DOUBLE AS score, rank::INTEGER AS rank FROM ranked WHERE rank <= 10")
def bm25_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents from a stored index: built from even ids, the others added."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    index = TextIndex.build(docs.where("id % 2 = 0"), f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}")
    index.add(docs)
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return TextIndex.load(spark, index.path).search(queries, 10).withColumn("score", F.round("score", 6))


@plans.add(f"""WITH {_BM25}, cut AS (SELECT query_id, r.id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, r.id) AS rn FROM ranked r JOIN documents d ON d.doc_id = r.id WHERE rank <= 30 AND d.lang = 'en')
SELECT query_id, id, round(score, 6)::DOUBLE AS score, rn::INTEGER AS rank FROM cut WHERE rn <= 10""")
def bm25_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = bm25_ranked(spark, sf_dir, 30)
    english = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"))
    allowed = ranked.select("query_id", "id").join(english, "id", "left_semi")
    return R.bm25_in_block(ranked, allowed, 10).withColumn("score", F.round("score", 6))


#: Vectors whose id is divisible by 100 are the queries; all others are searched, and their fellows.
_V = "list_transform(embedding, lambda x: x::DOUBLE)"
_COS = f"""
v AS (SELECT vec_id AS id, label, {_V} AS e FROM embeddings),
met AS (SELECT q.label, d.label AS other, q.id AS query_id, d.id, list_dot_product(q.e, d.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(d.e, d.e))) AS score
  FROM v q JOIN v d ON q.id <> d.id WHERE q.id % 100 = 0)"""
_RANK = "(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id))::INTEGER AS rank"


def _vectors(spark: SparkSession, sf_dir: str, *more: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 100 = 0").select(*more, F.col("vec_id").alias("query_id"), "embedding"), e.select(*more, F.col("vec_id").alias("id"), "embedding")


@plans.add(f"WITH {_COS} SELECT label, query_id, id, round(score, 6)::DOUBLE AS score, {_RANK} FROM met WHERE label = other QUALIFY rank <= 5")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.search(*_vectors(spark, sf_dir, "label"), "embedding", 5, block=["label"]).withColumn("score", F.round("score", 6))


@plans.add(f"WITH {_COS} SELECT label, query_id, id, round(score, 6)::DOUBLE AS score, {_RANK} FROM met WHERE label = other AND score > 0.3 QUALIFY rank <= 3")
def blocked_cosine_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.search(*_vectors(spark, sf_dir, "label"), "embedding", 3, block=["label"], above=0.3).withColumn("score", F.round("score", 6))


_PAIRED = f"""
v AS (SELECT vec_id AS id, label, vec_id % 2 AS half, {_V} AS e FROM embeddings),
met AS (SELECT q.label, q.half, q.id AS query_id, d.id, list_dot_product(q.e, d.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(d.e, d.e))) AS score
  FROM v q JOIN v d ON q.id <> d.id AND q.label = d.label AND q.half = d.half WHERE q.id % 100 = 0)"""


@plans.add(f"WITH {_PAIRED} SELECT label, half, query_id, id, round(score, 6)::DOUBLE AS score, {_RANK} FROM met QUALIFY rank <= 4")
def cosine_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest within a block of two columns, as a docket and a provision are."""
    e = table(spark, sf_dir, "embeddings").withColumn("half", F.col("vec_id") % 2)
    queries = e.where("vec_id % 100 = 0").select("label", "half", F.col("vec_id").alias("query_id"), "embedding")
    found = R.search(queries, e.select("label", "half", F.col("vec_id").alias("id"), "embedding"), "embedding", 4, block=["label", "half"])
    return found.withColumn("score", F.round("score", 6))


@plans.add(f"""WITH {_COS}, ranked AS (SELECT *, {_RANK} FROM met), rel AS (SELECT * FROM ranked WHERE label = other)
SELECT k::INTEGER AS k, count(*) FILTER (WHERE rank <= k)::BIGINT AS found, count(*)::BIGINT AS relevant, round(count(*) FILTER (WHERE rank <= k) / count(*), 6)::DOUBLE AS recall FROM rel, (SELECT unnest([10, 25, 50, 100, 200]) AS k) GROUP BY k""")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    relevant = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label").join(e.select(F.col("vec_id").alias("id"), "label"), "label").where("query_id <> id")
    return R.recall_at(R.search(*_vectors(spark, sf_dir), "embedding", 200), relevant, [10, 25, 50, 100, 200]).withColumn("recall", F.round("recall", 6))


def _index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """Built from the vectors of even ids; the others are added."""
    items = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    index = VectorIndex.build(items.where("id % 2 = 0"), f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    index.add(items)
    return index


@plans.add(f"WITH {_COS} SELECT query_id, id, round(score, 6)::DOUBLE AS score, {_RANK} FROM met QUALIFY rank <= 10")
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest from an index that is built, added to and loaded."""
    index = VectorIndex.load(spark, _index(spark, sf_dir).path)
    queries = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    return index.search(queries, 10, skip_own=True).withColumn("score", F.round("score", 6))


@plans.add(f"WITH {_COS} SELECT query_id, id, round(score, 6)::DOUBLE AS score, {_RANK} FROM met WHERE other % 2 = 1 QUALIFY rank <= 10")
def vector_index_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest among the vectors that a filter of ids allows."""
    e = table(spark, sf_dir, "embeddings")
    allowed = e.where("label % 2 = 1").select(F.col("vec_id").alias("id"))
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    return _index(spark, sf_dir).search(queries, 10, allowed=allowed, skip_own=True).withColumn("score", F.round("score", 6))


# A dense ranking of documents: counts of their words by the first byte of the word's md5.
_DENSE = f"""{_BM25},
hashed AS (SELECT 'd' AS kind, doc_id AS id, list_transform(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> ''), lambda w: ('0x' || substr(md5(w), 1, 2))::INTEGER) AS hs FROM documents
  UNION ALL SELECT 'q', item_id, list_transform(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> ''), lambda w: ('0x' || substr(md5(w), 1, 2))::INTEGER) FROM benchmark),
cells AS (SELECT kind, id, h, count(*) AS n FROM (SELECT kind, id, unnest(hs) AS h FROM hashed) GROUP BY ALL),
norms AS (SELECT kind, id, sqrt(sum(n * n)) AS norm FROM cells GROUP BY ALL),
dots AS (SELECT q.id AS query_id, d.id, sum(q.n * d.n) AS dot FROM cells q JOIN cells d ON q.h = d.h WHERE q.kind = 'q' AND d.kind = 'd' GROUP BY ALL),
dense AS (SELECT query_id, dots.id, dot / (a.norm * b.norm) AS score FROM dots JOIN norms a ON a.kind = 'q' AND a.id = query_id JOIN norms b ON b.kind = 'd' AND b.id = dots.id),
near AS (SELECT query_id, id, score, {_RANK} FROM dense QUALIFY rank <= 10)"""


def _dense(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return R.search(items.select(F.col("item_id").alias("query_id"), R.hashed_words(F.col("text")).alias("v")), docs.select(F.col("doc_id").alias("id"), R.hashed_words(F.col("text")).alias("v")), "v", k, skip_own=False)


@plans.add(f"""WITH {_DENSE}, a AS (SELECT query_id, id, rank FROM ranked WHERE rank <= 10 UNION ALL SELECT query_id, id, rank FROM near),
f AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score FROM a GROUP BY query_id, id)
SELECT query_id, id, round(score, 6)::DOUBLE AS score, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id))::INTEGER AS rank FROM f""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 and dense ranks fused."""
    return R.reciprocal_rank_fusion(bm25_ranked(spark, sf_dir, 10), _dense(spark, sf_dir, 10)).withColumn("score", F.round("score", 6))


@plans.add(f"""WITH {_DENSE}, s AS (SELECT query_id, id FROM ranked WHERE rank <= 10)
SELECT query_id, id, round(score, 6)::DOUBLE AS dense_score FROM near UNION ALL SELECT s.query_id, s.id, 0.0::DOUBLE FROM s ANTI JOIN near d ON s.query_id = d.query_id AND s.id = d.id""")
def dense_bm25_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dense_or_sparse(_dense(spark, sf_dir, 10), bm25_ranked(spark, sf_dir, 10)).withColumn("dense_score", F.round("dense_score", 6))


_TERMS = r"""
src AS (SELECT p_brand AS block, p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'l' ELSE 'r' END AS side, p_name || ' ' || p_type AS text FROM part),
own AS (SELECT block, id, side, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 2) AS ws FROM src),
terms AS (SELECT block, id, side, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM own),
tf AS (SELECT block, side, id, term, count(*) AS tf FROM terms GROUP BY ALL),
df AS (SELECT block, term, count(*) AS df FROM tf GROUP BY ALL), n AS (SELECT block, count(*) AS n FROM src GROUP BY block),
w AS (SELECT tf.block, side, id, tf.term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (block, term) JOIN n USING (block)),
u AS (SELECT block, side, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY block, side, id)) AS w FROM w),
s AS (SELECT a.block, a.id AS left_id, b.id AS right_id, sum(a.w * b.w) AS score FROM u a JOIN u b ON a.block = b.block AND a.term = b.term WHERE a.side = 'l' AND b.side = 'r' GROUP BY ALL)"""


@plans.add(f"WITH {_TERMS} SELECT block, left_id, right_id, round(score, 6)::DOUBLE AS score FROM s WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY block, left_id ORDER BY round(score, 9) DESC, right_id) = 1")
def tfidf_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("block"), F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return R.tfidf_links(part.where("id % 4 = 0"), part.where("id % 4 <> 0"), 0.6).withColumn("score", F.round("score", 6))


_SCORES = "s AS (SELECT doc_id, round(length(text) % 1000 / 1000.0, 6)::DOUBLE AS a, round((doc_id * 7919) % 1000 / 1000.0, 6)::DOUBLE AS b, quality = 1 AS y FROM documents JOIN labels USING (doc_id))"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return met.select("doc_id", (F.length("text") % 1000 / 1000.0).alias("a"), ((F.col("doc_id") * 7919) % 1000 / 1000.0).alias("b"), (F.col("quality") == 1).alias("y"))


_RATED = """r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS c FROM k),
f AS (SELECT *, CASE WHEN p + c = 0 THEN 0 ELSE 2 * p * c / (p + c) END AS f1 FROM r)"""


@plans.add(f"""WITH {_SCORES}, g AS (SELECT i / 100.0 AS threshold FROM range(101) t(i)),
k AS (SELECT threshold, count(*) FILTER (WHERE a >= threshold AND y) AS tp, count(*) FILTER (WHERE a >= threshold AND NOT y) AS fp, count(*) FILTER (WHERE a < threshold AND y) AS fn FROM s, g GROUP BY threshold), {_RATED}
SELECT threshold::DOUBLE AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(f1, 6)::DOUBLE AS f1 FROM f ORDER BY round(f1, 9) DESC, threshold LIMIT 1""")
def optimal_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_threshold(_scores(spark, sf_dir), "a", F.col("y")).select("threshold", "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


@plans.add(f"""WITH {_SCORES}, g AS (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS threshold),
k AS (SELECT threshold, count(*) FILTER (WHERE a >= threshold AND y) AS tp, count(*) FILTER (WHERE a >= threshold AND NOT y) AS fp, count(*) FILTER (WHERE a < threshold AND y) AS fn FROM s, g GROUP BY threshold), {_RATED}
SELECT threshold::DOUBLE AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(p, 6)::DOUBLE AS precision, round(c, 6)::DOUBLE AS recall, round(f1, 6)::DOUBLE AS f1 FROM f""")
def threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.threshold_curve(_scores(spark, sf_dir), "a", F.col("y"), [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
    return found.select("threshold", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@plans.add(f"""WITH {_SCORES}, g AS (SELECT w, t FROM (SELECT unnest([0.25, 0.5, 0.75]) AS w), (SELECT unnest([0.3, 0.5, 0.7]) AS t)),
k AS (SELECT w, t, count(*) FILTER (WHERE w * a + (1 - w) * b >= t AND y) AS tp, count(*) FILTER (WHERE w * a + (1 - w) * b >= t AND NOT y) AS fp, count(*) FILTER (WHERE w * a + (1 - w) * b < t AND y) AS fn FROM s, g GROUP BY w, t), {_RATED}
SELECT w::DOUBLE AS weight, t::DOUBLE AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(f1, 6)::DOUBLE AS f1 FROM f""")
def weight_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.weight_grid(_scores(spark, sf_dir), "a", "b", F.col("y"), [0.25, 0.5, 0.75], [0.3, 0.5, 0.7])
    return found.select("weight", "threshold", "tp", "fp", F.round("f1", 6).alias("f1"))
