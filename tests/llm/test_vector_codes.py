"""Vector codes against a plain k-means on Python integers."""

import hashlib
import math
import random

import numpy as np

from civicflow.llm import vector_codes as V

SF = "/root/testdata/sf0.01"


def plain(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error, digest) of rows (vec_id, embedding, label)."""
    kept = [(i, [math.floor(4096 * c) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(order[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[cut(v, p) for _, v, _ in order[:entries]] for p in range(parts)]
    nearest = lambda v, p: min((apart(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        own = [[[] for _ in books[p]] for p in range(parts)]
        for _, v, _ in kept:
            for p in range(parts):
                own[p][nearest(v, p)[1]].append(cut(v, p))
        books = [[[sum(c) // len(m) for c in zip(*m)] if m else e for m, e in zip(own[p], books[p])] for p in range(parts)]
    out, by_label = [], {}
    for i, v, label in kept:
        found = [nearest(v, p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
        by_label[label] = by_label.get(label, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, code, error, by_label[label], digest) for i, code, error, label in out]


def run(spark, tmp_path, rows, schema="vec_id long, embedding array<float>, label int"):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    return [tuple(r) for r in V.op11_vector_codes(spark, str(tmp_path)).collect()]


key = lambda r: tuple((x is None, str(x)) for x in r)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = [tuple(r) for r in V.op11_vector_codes(spark, SF).collect()]
    assert sorted(got, key=key) == sorted(plain(rows, rounds=6), key=key)


def test_odd_vectors(spark, tmp_path):
    rng = random.Random(3)
    vector = lambda: [rng.choice([-1.5, -0.00013, 0.0, 0.25, 2.0]) for _ in range(16)]
    rows = [(k, vector(), k % 3 if k % 4 else None) for k in range(40, 0, -1)]
    rows += [rows[0], rows[0], (None, vector(), 1), (None, vector(), None), (7, vector(), 2)]
    good = list(rows)
    rows += [(0, None, 1), (-1, [None] * 16, 1), (-2, [float("nan")] + [0.0] * 15, 1), (-3, [float("inf")] + [0.0] * 15, 1), (50, [1.0] * 8, 1), (51, [1.0] * 7, 1), (52, [], 1)]
    got = run(spark, tmp_path, rows)
    assert sorted(got, key=key) == sorted(plain(good), key=key)


def test_few_and_no_vectors(spark, tmp_path):
    few = [(2, [0.5] * 8, None), (1, [0.25] * 8, None)]
    got = run(spark, tmp_path / "a", few)
    assert sorted(got) == sorted(plain(few)) and {r[1] for r in got} == {"00" * 8, "01" * 8}
    assert run(spark, tmp_path / "b", []) == []
    assert run(spark, tmp_path / "c", [(1, None, 2)]) == []


def test_other_columns_and_huge_components(spark, tmp_path):
    rows = [(k, [3.0e9 * (k % 5) - k] * 8, 1, "x", 0) for k in range(30)]
    got = run(spark, tmp_path, rows, "vec_id long, embedding array<double>, label int, x string, c0 int")
    assert sorted(got) == sorted(plain([r[:3] for r in rows]))
    far = run(spark, tmp_path / "far", [(k, [(-1.0) ** k * 1e300] * 8, None) for k in range(40)], "vec_id long, embedding array<double>, label int")
    assert {r[2] for r in far} == {0}


def test_annuli_are_exact_and_prune():
    rng = np.random.default_rng(5)
    entries = rng.integers(-3, 4, (256, 4)) * rng.integers(1, 60, (256, 1))
    x = rng.integers(-150, 150, (500, 4))
    own = V.Annuli(entries)
    number, best = own.nearest(x)
    every = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (best == every.min(1)).all() and (number == every.argmin(1)).all()  # argmin takes the lowest number
    assert own.looked_at < 0.5 * every.size
    ties = V.Annuli(np.array([[0, 5], [5, 0], [3, 4], [0, 5]]))
    assert ties.nearest(np.array([[0, 0], [0, 9]]))[0].tolist() == [0, 0]


def test_decode(spark):
    x = V.integer_vectors(spark.read.parquet(f"{SF}/embeddings.parquet"))
    kept, books = V.train(x, rounds=1)
    for r in V.encode(kept, books).join(kept, "vec_id").limit(20).collect():
        assert int(((np.array(r["x"]) - books.decode(r["code"])) ** 2).sum()) == r["error"]
