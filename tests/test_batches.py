"""Batches in parts, and the counts and least values of shingles, against plain versions."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from civicflow.functions.batches import cuts
from civicflow.operators import dedup as D
from civicflow.operators import retrieval as R
from civicflow.operators import scoring as S


def test_parts_are_bounded_and_whole():
    column = pa.array(["a" * 10] * 7 + [None, "b" * 100, ""])
    assert cuts(column, rows=3, size=1000) == [(0, 3), (3, 3), (6, 3), (9, 1)]
    assert cuts(column, rows=100, size=25) == [(0, 2), (2, 2), (4, 2), (6, 2), (8, 1), (9, 1)]
    assert cuts(column.slice(8, 2), size=25) == [(0, 1), (1, 1)] and cuts(column.slice(0, 0)) == []
    assert cuts(pa.array([[1] * 10, None, [2] * 30]), size=25) == [(0, 2), (2, 1)]


def test_a_backend_gets_bounded_parts(spark):
    """A batch of 10,000 texts was asked and held as a whole."""

    class Counting:  # here, so that it is pickled by value
        def extract(self, texts):
            return [f'["{len(texts)}"]'] * len(texts)

    docs = spark.range(3000).coalesce(1).select("id", F.lit("x").alias("text"))
    found = S.claims(docs, "text", Counting(), Counting())
    sizes = [int(r["parsed"][0]) for r in found.collect()]
    assert len(sizes) == 3000 and max(sizes) <= 512


def test_least_values_against_plain_modulo():
    rng = np.random.default_rng(1)
    for n in (1, 7, 256, 1000):
        own = np.concatenate([rng.integers(0, 1 << 60, n), [0, (1 << 60) - 1][: n % 3]]).astype(np.int64)
        want = [min((a * (int(h) >> 30) + b * (int(h) & (1 << 30) - 1) + c) % D.PRIME for h in own) for a, b, c in D.family()]
        assert D.least_values(own).tolist() == want
    for a, b, c in D.family()[:3]:  # the values next to a multiple
        own = [h for h in range(200_000) if (b * h + c) % D.PRIME in (0, 1, D.PRIME - 1)] or [0]
        assert D.least_values(np.array(own, np.int64)).tolist() == [min((x * (h >> 30) + y * (h & (1 << 30) - 1) + z) % D.PRIME for h in own) for x, y, z in D.family()]


def test_frequencies_of_hot_and_other_shingles(spark):
    """Counting takes tasks of so many shingles; one that all documents have is combined before."""
    sets = [("a", i, [7, 65543 + 7, 100 + i, 200 + i % 5]) for i in range(60)] + [("b", 100 + i, [7, i]) for i in range(8)] + [(None, 200, [7])]
    rows = spark.createDataFrame(sets, "block string, id long, hashes array<long>")
    want = Counter((b, h) for b, _, hs in sets for h in hs)
    for items in (8, 64, 1 << 21):
        got = D.document_frequency(rows, items)
        assert {(r["block"], r["shingle"]): r["df"] for r in got.collect()} == want and got.count() == len(want)
    n = Counter(b for b, _, _ in sets)
    kept = {(b, i): {h for h in hs if b is None or want[b, h] <= max(1, int(n[b] * 0.2))} for b, i, hs in sets}
    assert {(r["block"], r["id"]): set(r["hashes"]) for r in D.drop_common(rows).collect()} == {k: v for k, v in kept.items() if v}


def test_only_candidates_for_common_shingles_are_counted(spark):
    """Every shingle was counted by its bucket, and once more in full buckets."""
    rows = spark.createDataFrame([("a", i, [7, 8 + i % 2, *range(100 * i + 100, 100 * i + 150)]) for i in range(40)] + [("b", 90, [7, 5]), ("b", 91, [6, 5]), (None, 92, [7])], "block string, id long, hashes array<long>").coalesce(1)
    often = {tuple(r) for r in D._often(rows, 0.2).collect()}
    assert {s for b, s in often if b == "a"} == {7, 8, 9} and all(b for b, _ in often)
    want = {("a", i): set(range(100 * i + 100, 100 * i + 150)) for i in range(40)} | {("b", 90): {7}, ("b", 91): {6}, (None, 92): {7}}
    for dealt in (rows, rows.repartition(7)):
        for candidates in (D.CANDIDATES, 2, 0):
            assert {(r["block"], r["id"]): set(r["hashes"]) for r in D.drop_common(dealt, candidates=candidates).collect()} == want


def test_texts_are_split_once(spark):
    """The token gate and cleaning split texts in the engine, several times."""
    text = "".join(f"w{chr(c)}" for c in [*range(1, 0x180), 0x1680, 0x180E, *range(0x2000, 0x2070), 0x3000, 0xFEFF])
    for t in (text, text[:256], "a \x1c b\x0bc", "é  ü", ""):
        assert D._tokens(t) == [w.encode() for w in D.split_words(t)]
    docs = spark.createDataFrame([(1, "a b c"), (2, "é b"), (3, None)], "id long, text string")
    got = {r["id"]: (r["n_chars"], r["n_tokens"], r["hashes"] and set(r["hashes"])) for r in D.shingled(docs, "text", 2, 3).collect()}
    assert got == {1: (5, 3, set(D.shingle_hashes("a b c", 2).tolist())), 2: (3, 2, None), 3: (0, 0, None)}
    assert D.shingled(docs, "text", 2, 3).columns == ["id", "n_chars", "n_tokens", "hashes"]


def test_few_items_wait_for_a_merge():
    """A million scores could wait, each item's in arrays of its own."""
    best = R.Best(50, 3)
    for i in range(10_000):
        best.offer(np.array([i % 50]), i, np.array([float(i)]))
        assert len(best._waiting) < 4097
    got = next(iter(best.rows(pa.table({"query_id": list(range(50))}), []))).to_pydict()
    assert got["id"][:3] == [9950, 9900, 9850] and len(got["id"]) == 150


def test_words_are_hashed_once_a_worker(spark):
    """Each word was hashed by the engine, with a conversion through text."""
    docs = spark.createDataFrame([("A b\x1cc  b",), (None,), ("",), ("é　b" * 3,)], "t string")
    for r in docs.select("t", R.hashed_words(F.col("t")).alias("v")).collect():
        want = np.zeros(256)
        for w in R._words((r["t"] or "").lower()):
            want[int(hashlib.md5(w.encode()).hexdigest()[:2], 16)] += 1
        assert r["v"] == want.tolist()
    plan = docs.select(R.hashed_words(F.col("t")))._jdf.queryExecution().toString().lower()
    assert "conv(" not in plan
