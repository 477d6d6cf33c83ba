"""Exact vector search, with and without an index, against brute force."""

import tracemalloc
import uuid

import numpy as np
import pyarrow as pa
import pytest

from civicflow.operators import index as I
from civicflow.operators import retrieval as R

VECTORS = "id long, v array<double>"


def brute(items, queries, k, skip_own=False):
    """{query_id: [(id, score)]} of dictionaries of vectors."""
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    out = {}
    for q, v in queries.items():
        scored = [(-round(float(unit(v) @ unit(x)), 9), i) for i, x in items.items() if not (skip_own and i == q)]
        out[q] = [i for _, i in sorted(scored)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def clustered(n, clusters, dims, seed):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(clusters, dims))
    return {i: (at[i % clusters] + 0.05 * rng.normal(size=dims)).tolist() for i in range(n)}


def made(spark, items, tmp_path, **more):
    return I.VectorIndex.build(spark.createDataFrame(list(items.items()), VECTORS), f"file://{tmp_path}/{uuid.uuid4().hex}", **more)


def asked(spark, queries):
    return spark.createDataFrame(list(queries.items()), "query_id long, v array<double>")


def test_search_is_exact_and_skips_cells(spark, tmp_path):
    items = clustered(3000, 50, 16, 1)
    index = made(spark, items, tmp_path)
    queries = {i: items[i] for i in range(0, 3000, 100)}
    assert found(index.search(asked(spark, queries), 10, skip_own=True)) == brute(items, queries, 10, skip_own=True)
    cells, read = index.bounds().count(), [r["cells"] for r in index.cells_read(asked(spark, queries), 10).collect()]
    assert cells >= 40 and len(read) == len(queries) and np.mean(read) < 0.2 * cells


def test_vectors_without_clusters_are_found_as_well(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "ITEMS", 40)  # many groups a cell
    monkeypatch.setattr(I, "QUERIES", 5)
    rng = np.random.default_rng(2)
    items = {i: rng.normal(size=8).tolist() for i in range(600)}
    index = made(spark, dict(list(items.items())[:300]), tmp_path, cells=4)
    index.add(spark.createDataFrame([(i, v) for i, v in items.items() if i >= 250] + [(599, items[599])] * 3, VECTORS))
    assert index.vectors().count() == 600
    queries = {i: items[i] for i in range(0, 600, 20)}
    assert found(I.VectorIndex.load(spark, index.path).search(asked(spark, queries), 7)) == brute(items, queries, 7)
    allowed = spark.createDataFrame([(i,) for i in items if i % 3 == 0], "id long")
    assert found(index.search(asked(spark, queries), 5, allowed=allowed)) == brute({i: v for i, v in items.items() if i % 3 == 0}, queries, 5)


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [2.0, 0.0]), (None, [1.0, 1.0]), (7, [0.0, 1.0]), (7, [0.0, -1.0]), (8, [1.0, None])]
    index = I.VectorIndex.build(spark.createDataFrame(rows, VECTORS), f"file://{tmp_path}/odd")
    assert sorted(r["id"] for r in index.vectors().collect()) == [1, 6, 7]
    queries = spark.createDataFrame([(1, [3.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0])], "query_id long, v array<double>")
    assert found(index.search(queries, 2)) == {1: [1, 6]}  # equal scores go by id
    assert found(index.search(queries, 9)) == {1: [1, 6, 7]}  # fewer vectors than are asked for
    empty = I.VectorIndex.build(spark.createDataFrame([], VECTORS), f"file://{tmp_path}/empty")
    assert empty.search(queries, 2).collect() == []
    empty.add(spark.createDataFrame([(1, [1.0, 0.0])], VECTORS))
    assert found(empty.search(queries, 2)) == {1: [1]}
    with pytest.raises(FileNotFoundError):
        I.VectorIndex.load(spark, f"file://{tmp_path}/nothing")


def test_bundle(spark, tmp_path):
    items = clustered(60, 4, 4, 3)
    texts = spark.createDataFrame([(1, "clean water rule"), (2, "noise rule"), (3, "  "), (None, "water")], "id long, text string")
    vectors = spark.createDataFrame(list(items.items()), VECTORS)
    bundle = I.IndexBundle.build(texts, vectors, vectors.where("id < 10"), f"file://{tmp_path}/bundle")
    assert found(bundle.bm25(spark.createDataFrame([(9, "water")], "query_id long, text string"), 3)) == {9: [1]}
    queries = {0: items[0]}
    assert found(bundle.primary().search(asked(spark, queries), 3)) == brute(items, queries, 3)
    assert found(bundle.distribution().search(asked(spark, queries), 3)) == brute({i: items[i] for i in range(10)}, queries, 3)


def test_best_items_with_repeats_and_ties():
    rng = np.random.default_rng(4)
    best, every = R.Best(5, 3), {}
    for _ in range(40):
        ids, scores = rng.integers(0, 30, 12), rng.integers(0, 6, (5, 12)) / 5
        best.offer_all(np.arange(5), scores, ids)
        item, one = int(rng.integers(0, 30)), rng.integers(0, 6, 5) / 5
        best.offer(np.arange(5), item, one)
        for q in range(5):
            for i, s in [*zip(ids.tolist(), scores[q].tolist()), (item, one[q])]:
                every[q, i] = max(every.get((q, i), 0), s)
    rows = next(best.rows(pa.table({"query_id": range(5)}), [])).to_pylist()
    for q in range(5):
        want = sorted((-s, i) for (p, i), s in every.items() if p == q)[:3]
        assert sorted((-r["score"], r["id"]) for r in rows if r["query_id"] == q) == want


def test_memory_does_not_grow_with_rows_times_queries():
    rng = np.random.default_rng(5)
    queries, items = rng.normal(size=(50_000, 8)), rng.normal(size=(4000, 8))
    lists = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], np.int32), x.ravel())
    run = R._nearest(pa.table({"query_id": np.arange(len(queries)), "v": lists(queries)}), [], 2, None, False)
    batch = pa.record_batch([pa.array(np.arange(len(items))), lists(items)], ["id", "v"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 100_000 and peak < 400e6  # all scores would be 1.6 GB
