"""Passages against plain searches: word for word, from their beginning on, and with planted edits."""

import random

import numpy as np
import pytest

from civicflow.operators import passages as P


def edits(a, b):
    """Levenshtein distance of two lists of words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def least_edits(passage, text):
    """The least distance of a passage to any stretch of a text."""
    cost = [0] * (len(text) + 1)
    for i, x in enumerate(passage, 1):
        before, cost[0] = cost[0], i
        for j, y in enumerate(text, 1):
            before, cost[j] = cost[j], min(cost[j] + 1, cost[j - 1] + 1, before + (x != y))
    return min(cost)


def test_alignment():
    rng = random.Random(1)
    for _ in range(200):
        window = [rng.randrange(6) for _ in range(rng.randrange(1, 25))]
        passage = [rng.randrange(6) for _ in range(rng.randrange(1, 10))]
        cost, start, end = P.aligned(np.array(passage), np.array(window))
        assert cost == least_edits(passage, window) and (cost == len(passage) or edits(passage, window[start:end]) == cost)


def planted(seed=2):
    """Documents, passages, and which passage was put where with how many edits."""
    rng = random.Random(seed)
    vocabulary = [f"word{k}" for k in range(400)] + ["the", "of", "a"] * 60
    docs = [[rng.choice(vocabulary) for _ in range(rng.randrange(30, 400))] for _ in range(60)]
    items, put = [], []
    for no in range(80):
        n = rng.choice([1, 2, 3, 4, 5, 7, 8, 12, 20, 40, 90])
        items.append([rng.choice(vocabulary) for _ in range(n)])
        changed = list(items[-1])
        for _ in range(rng.randrange(int(0.3 * n) + 1)):
            at = rng.randrange(len(changed))
            kind = rng.randrange(3)
            changed[at : at + (kind != 1)] = [] if kind == 0 and len(changed) > 1 else [f"new{rng.randrange(99)}"]
        doc = rng.randrange(len(docs))
        at = rng.randrange(len(docs[doc]) + 1)
        docs[doc][at:at] = changed
        put.append((doc, no))
    return docs, items, put


def test_every_likeness_of_seven_tenths_is_found(spark):
    docs, items, _ = planted()
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    p = spark.createDataFrame([(i, " ".join(t).upper()) for i, t in enumerate(items)], "item_id long, text string")  # in other letters, so never word for word
    found = {(r["doc_id"], r["item_id"]): r for r in P.find_passages(d, p).collect()}
    want = {(i, j): c for i, t in enumerate(docs) for j, x in enumerate(items) if (c := least_edits(x, t)) <= int(0.3 * len(x) + 1e-9)}
    assert found.keys() == want.keys() and len(want) > 80
    for (i, j), r in found.items():
        stretch = " ".join(docs[i])[r["start"] : r["end"]].split(" ")
        assert r["how"] == "similar" and edits(items[j], stretch) == want[i, j] and r["similarity"] == pytest.approx(1 - want[i, j] / len(items[j]))


def test_planted_passages_in_parts(spark):
    docs, items, put = planted(3)
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS start")
    p = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    whole, parts = ({tuple(r) for r in P.find_passages(d, p, query_bytes=n).collect()} for n in (1 << 22, 4000))
    assert whole == parts
    found = {(r[0], r[1]) for r in whole}
    # Some planted passages were cut in two by later ones.
    assert sum(x in found for x in put) >= 0.9 * len(put)


def test_beginnings(spark):
    text = "xalpha beta, and " + "gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron" + " end"
    long = "gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma"
    d = spark.createDataFrame([(1, text), (2, "short"), (3, None), (4, ""), (None, text), (5, long + " " + long[:60] + text)], "doc_id long, text string")
    p = spark.createDataFrame([(10, "alpha be"), (11, long), (12, ""), (13, None), (None, "short"), (14, "short"), (15, "short"), (16, "nothing like it")], "item_id long, text string")
    for least in (None, 0.7):
        got = {(r["doc_id"], r["item_id"]): (r["start"], r["end"], r["how"]) for r in P.find_passages(d, p, least).collect()}
        at = text.find(long[:60])
        assert got == {(1, 10): (1, 9, "exact"), (1, 11): (at, len(text), "prefix"), (2, 14): (0, 5, "exact"), (2, 15): (0, 5, "exact"), (5, 10): (len(long) + 62, len(long) + 70, "exact"), (5, 11): (0, len(long), "exact")}
    with pytest.raises(ValueError):
        P.find_passages(d, p, 0.5)
    assert P.find_passages(d, p.where("false")).collect() == [] == P.find_passages(d.where("false"), p).collect()


def test_repeated_words(spark):
    d = spark.createDataFrame([(1, "no " * 5000 + "yes"), (2, "yes yes yes")], "doc_id long, text string")
    p = spark.createDataFrame([(1, "No No No Yes"), (2, "YES"), (3, "Maybe")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["similarity"]) for r in P.find_passages(d, p).collect())
    assert got == [(1, 1, 1.0), (1, 2, 1.0), (2, 2, 1.0)]
