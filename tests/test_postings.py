"""The stored BM25 index against scoring every document, and how much it reads."""

import random

import pytest

from civicflow.operators import postings as P
from civicflow.operators.retrieval import bm25

DOCS, QUERIES = "id long, text string", "query_id long, text string"


def corpus(n, seed=1):
    """Texts in which some words stand nearly everywhere and most are rare."""
    rng = random.Random(seed)
    return [(i, " ".join(f"w{int(1.6 ** rng.uniform(0, 17))}" for _ in range(rng.randrange(3, 60)))) for i in range(n)]


def found(df):
    return {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 8)) for r in df.collect()}


def test_search_equals_scoring_everything(spark, tmp_path):
    rows = corpus(900) + [(2000 + i, "copy of one text w1 w2") for i in range(40)] + [(3000, ""), (3001, None), (None, "w1"), (3002, "w5 " * 4000), (7, "w1 again"), (3003, "W1 W300")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS term", "2 AS bucket")
    index = P.TextIndex.build(docs.where("id % 3 = 0"), f"file://{tmp_path}/i")
    index.add(docs)
    index.add(docs)  # nothing is new
    queries = spark.createDataFrame([(1, "w1 w2 w3 w1"), (2, "w1"), (3, "w900 w40 w1 w2"), (4, "of one copy"), (5, "unknown"), (6, ""), (7, None), (None, "w1"), (8, "W5 w6 w7 w8 w9 w1 w2 w3")], QUERIES)
    # A repeated id holds its least text.
    plain = docs.where("id is not null").selectExpr("id", "coalesce(text, '') AS text").groupBy("id").agg({"text": "min"}).toDF("id", "text")
    for k in (1, 10, 2000):
        assert found(P.TextIndex.load(spark, index.path).search(queries, k)) == found(bm25(plain, queries, "id", "text", "query_id", "text", k))
    with pytest.raises(FileNotFoundError):
        P.TextIndex.load(spark, f"file://{tmp_path}/nothing")


def test_blocks_are_left_out(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "the " * rng.randrange(1, 4) + (f"rare{rng.randrange(60)} " * rng.randrange(1, 5)) + "filler " * rng.randrange(20)) for i in range(20_000)]
    index = P.TextIndex.build(spark.createDataFrame(rows, DOCS).repartition(4), f"file://{tmp_path}/i")
    queries = spark.createDataFrame([(q, f"the rare{q} rare{q + 20} filler") for q in range(20)], QUERIES)
    own, rated, blocks, _ = index._narrowed(queries, 10)
    every, read = own.join(rated.select("query_id", "term"), "term").count(), blocks.count()
    assert read < 0.15 * every
    assert found(index.search(queries, 10)) == found(bm25(spark.createDataFrame(rows, DOCS), queries, "id", "text", "query_id", "text", 10))


def test_an_empty_index(spark, tmp_path):
    index = P.TextIndex.build(spark.createDataFrame([], DOCS), f"file://{tmp_path}/i")
    asked = spark.createDataFrame([(1, "w1")], QUERIES)
    assert index.search(asked, 3).collect() == []
    index.add(spark.createDataFrame([(1, "w1")], DOCS))
    assert found(index.search(asked, 3)).keys() == {(1, 1)}
