"""Ranks, quantiles, concordant pairs and resamples against plain versions, with groups that span many ranges."""

import math
import random

import numpy as np
import pytest

from civicflow.operators import metrics, ordering, stats


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(ordering, "PER_RANGE", 30)


def data(n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        g = rng.choice(["a", "a", "a", "b", None])
        x = rng.choice([0, 0, 0, rng.randrange(200)])  # a value that over a third of all rows hold
        rows.append((g, x, x // 3 + rng.randrange(40) if g != "b" else -x))
    return rows + [("one", 1, 1), ("flat", 2, 1), ("flat", 2, 5), ("none", None, 1), ("none", 2, None), ("a", None, 3), ("a", 3, None)]


def by_group(rows):
    out = {}
    for g, x, y in rows:
        if x is not None and y is not None:
            out.setdefault(g, []).append((x, y))
    return out


def close(got, want):
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] is None if v is None else got[k] == pytest.approx(v, abs=1e-9), k


def plain_kendall(pairs):
    sign = lambda a, b: (a > b) - (a < b)
    s = sum(sign(a[0], b[0]) * sign(a[1], b[1]) for i, a in enumerate(pairs) for b in pairs[:i])
    n0 = len(pairs) * (len(pairs) - 1) / 2
    ties = [sum(c * (c - 1) / 2 for c in np.unique([p[i] for p in pairs], return_counts=True)[1]) for i in (0, 1)]
    under = math.sqrt((n0 - ties[0]) * (n0 - ties[1]))
    return s / under if under else None


def plain_spearman(pairs):
    ranks = [[sum(o < v for o in c) + (sum(o == v for o in c) + 1) / 2 for v in c] for c in zip(*pairs)]
    a, b = (np.array(r) - np.mean(r) for r in ranks)
    under = math.sqrt((a * a).sum() * (b * b).sum())
    return (a * b).sum() / under if under else None


@pytest.mark.parametrize("name", ["kendall", "spearman"])
def test_rank_correlations(spark, small_ranges, name):
    rows = data()
    df = spark.createDataFrame(rows, "`a.g` string, x long, y long")
    got = {r["a.g"]: r[name] for r in getattr(metrics, name)(df, "x", "y", ["a.g"]).collect()}
    close(got, {g: globals()[f"plain_{name}"](p) for g, p in by_group(rows).items()})


def test_rank_correlations_of_one_group_and_of_nothing(spark, small_ranges):
    rows = [(f"{x:03}", float(y)) for _, x, y in data(300, 2) if x is not None and y is not None]
    df = spark.createDataFrame(rows, "x string, y double")  # any type that has an order
    close({"": metrics.kendall(df, "x", "y", []).first()["kendall"]}, {"": plain_kendall(rows)})
    close({"": metrics.spearman(df, "x", "y", []).first()["spearman"]}, {"": plain_spearman(rows)})
    none = spark.createDataFrame([], "g string, x long, y long")
    assert metrics.kendall(none, "x", "y", ["g"]).collect() == [] == metrics.spearman(none, "x", "y", ["g"]).collect()


def test_signed_pairs():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 64, 130):
        cells = np.array(sorted({(int(a), int(b)) for a, b in rng.integers(0, 12, (n, 2))}))
        w = rng.integers(1, 5, len(cells))
        want = sum(w[i] * w[j] * np.sign(cells[i][1] - cells[j][1]) for i in range(len(cells)) for j in range(i) if cells[i][0] != cells[j][0])
        assert ordering.signed_pairs(cells[:, 0], cells[:, 1], w) == want


def test_every_cell_moves_once_a_step(spark, small_ranges):
    made = {}
    for n in (400, 4000):
        rng = random.Random(n)
        df = spark.createDataFrame([("g", rng.randrange(10**6), rng.randrange(10**6)) for _ in range(n)], "g string, x long, y long")
        cells, keys = ordering.pair_counts(df, ["g"], "x", "y")
        dealt = cells.repartitionByRange(8, *keys, "x").sortWithinPartitions(*keys, "x", "y")
        made[n] = ordering._within_tasks(dealt, keys, "x", "y").count()
    assert made[400] <= 400 + 8 and made[4000] <= 4000 + 8


def test_percentiles(spark, small_ranges):
    rows = [(g, x) for g, x, _ in data(500, 4)]
    df = spark.createDataFrame(rows, "g string, v long").selectExpr("*", "1 AS n", "2 AS k0", "3 AS before")
    at = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = {r["g"]: r for r in stats.percentiles(df, "v", at, ["g"]).collect()}
    for g in {g for g, _ in rows}:
        own = [v for h, v in rows if h == g and v is not None]
        assert got[g]["n"] == len(own) and got[g]["largest"] == max(own)
        assert [got[g][f"p{round(100 * p)}"] for p in at] == pytest.approx([np.percentile(own, 100 * p) for p in at])
    assert stats.percentiles(df.where("false"), "v", at).first()["p50"] is None
    assert stats.percentiles(df, "v", at).first()["p50"] == np.median([v for _, v in rows if v is not None])


def test_resamples_add_up_over_any_partitions(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), float(rng.random() < 0.3)) for i in range(2000)] + [(None, "a", 1.0), (3000, "a", None)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    one, two = ({r["g"]: r for r in metrics.bootstrap(d, ["g"], "v", row="id").collect()} for d in (df.coalesce(1), df.repartition(7)))
    assert one.keys() == two.keys() == {"a", "b"}
    for g, r in one.items():
        own = [v for i, h, v in rows if h == g and v is not None and i is not None]
        half = 1.96 * np.std(own) / math.sqrt(len(own))  # the normal interval is close at this size
        assert r["n"] == len(own) and r["mean"] == pytest.approx(np.mean(own))
        assert [r["low"], r["high"]] == pytest.approx([np.mean(own) - half, np.mean(own) + half], abs=0.2 * half)
        assert [two[g][c] for c in ("n", "mean", "low", "high")] == pytest.approx([r[c] for c in ("n", "mean", "low", "high")])
    assert metrics.bootstrap(df, [], "v", draws=50, row="id").count() == 1
    assert metrics.bootstrap(df.where("false"), ["g"], "v", row="id").collect() == []


def test_poisson_weights():
    w = np.searchsorted(metrics.poisson_steps(), metrics.mixed(np.arange(-500, 500), np.arange(200), 7), side="right")
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert abs(np.corrcoef(w[:-1].ravel(), w[1:].ravel())[0, 1]) < 0.01 and abs(np.corrcoef(w[:, :-1].ravel(), w[:, 1:].ravel())[0, 1]) < 0.01
