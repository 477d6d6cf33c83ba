from collections import Counter

import numpy as np
import pytest
import xxhash

from civicflow.llm import simhash
from civicflow.operators.components import components

SF = "/root/testdata/sf0.01"


def plain_fingerprint(text):
    words = []
    for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" "):
        if w:
            words.append("".join(c.lower() if "A" <= c <= "Z" else c for c in w))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_groups(ids, fps):
    fps = np.array(fps, np.uint64)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4) + i + 1:
            root[find(int(j))] = find(i)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in simhash.op7_simhash(spark, SF).collect()}
    fps = [plain_fingerprint(r["text"]) for r in docs]
    groups = plain_groups([r["doc_id"] for r in docs], fps)
    assert len(got) == len(docs)
    for r, f, g in zip(docs, fps, groups, strict=True):
        assert (got[r["doc_id"]]["fingerprint"], got[r["doc_id"]]["component_id"]) == (f"{f:016x}", g)


def test_nulls_ties_and_odd_texts(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "a b c d e", "z"), (5, "a b c d e", "z"), (5, "a b c d e", "z"), (7, "one", None), (8, "ONE\x0b", "q"), (None, "nothing like it at all here", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in simhash.near_groups(docs).collect())
    assert got == [(-1, -1), (-1, 5), (1, 1), (2, 1), (5, 5), (5, 5), (7, 7), (8, 7)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, -1, 1, 5, 5, 7]
    assert simhash.near_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("chunk, most_chunks", [(4, 512), (16, 512), (2048, 512), (4, 2), (4, 6)])
def test_dense_groups_in_chunks_and_by_centres(spark, chunk, most_chunks):
    rng = np.random.default_rng(3)
    fps = set()
    for base in rng.integers(0, 1 << 63, 5, np.uint64):
        for _ in range(60):
            flips = rng.choice(64, rng.integers(0, 8), replace=False)
            fps.add(int(base) ^ sum(1 << int(b) for b in flips))
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    root = {r["node"]: r["root"] for r in components(simhash.links(df, chunk=chunk, most_chunks=most_chunks)).collect()}
    order = sorted(fps)
    want = plain_groups(order, np.array(order, np.int64).view(np.uint64).tolist())
    assert [root.get(f, f) for f in order] == want


def test_centres_link_what_is_near_and_nothing_else(spark):
    """Every pair within the radius shares a centre, no other pair does, and rows grow with the bucket."""
    rng = np.random.default_rng(4)
    mask = (1 << 30) - 1
    fps = np.unique(np.array([7 | sum(1 << int(b) for b in rng.choice(np.arange(30, 64), rng.integers(0, 6), replace=False)) for _ in range(300)], np.uint64))
    assert len(simhash.flips(mask, 4)) == 1 + 34 + 34 * 33 // 2
    rows = spark.createDataFrame([(0, int(f)) for f in fps.view(np.int64)], "k0 long, fp long").repartition(3)
    got = [(r["a"], r["b"]) for r in simhash.linked_by_centres(rows, [mask], 4).collect()]
    assert got and all(0 < (np.uint64(a % 2**64) ^ np.uint64(b % 2**64)).bit_count() <= 4 for a, b in got)
    root = {r["node"]: r["root"] for r in components(spark.createDataFrame(got, "a long, b long")).collect()}
    order = sorted(fps.view(np.int64).tolist())
    assert [root.get(f, f) for f in order] == plain_groups(order, np.array(order, np.int64).view(np.uint64).tolist())


def test_masks_meet_every_near_pair():
    rng = np.random.default_rng(1)
    for n in (10, 10**6, 10**9, 10**12):
        masks = simhash.blocks_for(n)
        for _ in range(200):
            flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(flips & m == 0 for m in masks)


def test_pivot_table_bounds_distance():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 1 << 63, (2, 500), np.uint64)
    ref = simhash.pivots()
    bound = np.abs(simhash.pivot_table(a, ref) - simhash.pivot_table(b, ref)).max(1)
    assert (bound <= np.bitwise_count(a ^ b)).all()
    assert (bound > simhash.RADIUS).mean() > 0.99


def test_the_pivot_table_discards_pairs():
    """In buckets that meet by chance, few pairs are formed, and hardly one but the links is left to verify."""
    rng = np.random.default_rng(6)
    fps = rng.integers(0, 1 << 63, 4000, np.uint64)
    fps[1::40] = fps[::40] ^ np.uint64(5)
    fps = np.unique(fps)
    runs = np.sort(rng.integers(0, 40, len(fps)))
    runs[np.searchsorted(runs, 39) :] = 39
    counts = Counter()
    a, b = simhash.links_in_runs(runs, fps, 4, fps[rng.choice(len(fps), simhash.PIVOTS, replace=False)], counts)
    near = {(min(x, y), max(x, y)) for r in range(40) for own in [fps[runs == r].tolist()] for i, x in enumerate(own) for y in own[:i] if (x ^ y).bit_count() <= 4}
    assert {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())} == near
    assert counts["met"] == sum(n * (n - 1) // 2 for n in np.bincount(runs))
    assert counts["formed"] < 0.7 * counts["met"] and counts["left"] <= counts["links"] + 0.001 * counts["met"]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (2001, 2000)], "a long, b long")
    root = {r["node"]: r["root"] for r in components(edges).collect()}
    assert {root[i] for i in range(301)} == {0} and root[2001] == 2000
    assert components(edges.limit(0)).count() == 0
