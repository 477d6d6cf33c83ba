"""The TF-IDF join against one that compares all pairs, and how many pairs it forms."""

import math
import random
import re
from collections import Counter

from civicflow.operators import retrieval as R

ROWS = "block string, id long, text string"


def plain(left, right, least):
    """{(block, left id): (right id, score)}."""
    terms = lambda t: (lambda w: w + [f"{a} {b}" for a, b in zip(w, w[1:])])([x for x in re.split("[^a-z0-9]+", (t or "").lower()) if len(x) >= 2])
    out = {}
    for block in {r[0] for r in left} - {None}:
        own = [(side, i, Counter(terms(t))) for side, rows in ((0, left), (1, right)) for b, i, t in rows if b == block and i is not None]
        df = Counter(t for _, _, c in own for t in c)
        unit = []
        for side, i, c in own:
            v = {t: tf * (math.log((1 + len(own)) / (1 + df[t])) + 1) for t, tf in c.items()}
            norm = math.sqrt(sum(w * w for w in v.values()))
            unit.append((side, i, {t: w / norm for t, w in v.items()}))
        for side, i, v in unit:
            if side == 0:
                scored = [(-round(sum(w * x.get(t, 0) for t, w in v.items()), 9), j) for s, j, x in unit if s == 1]
                good = sorted(p for p in scored if -p[0] >= least)
                if good and (block, i) not in out or good and (good[0][0], good[0][1]) < (-out[block, i][1], out[block, i][0]):
                    out[block, i] = (good[0][1], -good[0][0])
    return out


def titles(n, seed, start=0):
    rng = random.Random(seed)
    common, made = [f"common{k}" for k in range(20)], []
    for i in range(n):
        made.append((f"b{i % 2}", start + i, " ".join([*rng.choices(common, k=4), f"rare{rng.randrange(n)}x", f"name{rng.randrange(n)}y"])))
    return made


def got(spark, left, right, least):
    found = R.tfidf_links(spark.createDataFrame(left, ROWS), spark.createDataFrame(right, ROWS), least).collect()
    return {(r["block"], r["left_id"]): (r["right_id"], round(r["score"], 9)) for r in found}


def test_every_best_match_is_found(spark):
    left, right = titles(120, 1), titles(150, 2, 1000)
    rng = random.Random(3)
    right += [(b, 5000 + i, t + " " + rng.choice(["final", "draft"])) for b, i, t in left[::2]]
    left += [(b, 9000 + i, t) for b, i, t in left[:5]] + [("b0", 7000, ""), ("b0", 7001, None), (None, 7002, "rare1x"), ("b0", None, "rare1x"), ("b9", 7003, "alone here")]
    right += right[-3:] + [(b, i + 50, t) for b, i, t in right[-3:]] + [("b0", 8000, "a . !")]
    for least in (0.3, 0.6, 0.95):
        assert got(spark, left, right, least) == {k: (j, round(s, 9)) for k, (j, s) in plain(left, right, least).items()}
    assert got(spark, left, [], 0.6) == {} == got(spark, [], right, 0.6)


def test_pairs_formed_follow_the_results(spark):
    for n in (300, 3000):
        left = [("b", i, t) for _, i, t in titles(n, 4)]
        right = [("b", 100_000 + i, t + " final") for _, i, t in left]  # all share common words with all
        _, unit = R._tfidf_vectors(spark.createDataFrame(left, ROWS), spark.createDataFrame(right, ROWS))
        formed = R._tfidf_candidates(unit, 0.6).count()
        assert n <= formed < 4 * n


def test_copies_are_compared_once(spark):
    left = [("b", i, "the same title of a rule") for i in range(500)] + [("b", 600, "another one")]
    right = [("b", 1000 + i, "The same title, of a rule!") for i in range(500)]
    _, unit = R._tfidf_vectors(spark.createDataFrame(left, ROWS), spark.createDataFrame(right, ROWS))
    assert R._tfidf_candidates(unit, 0.6).count() == 1
    assert got(spark, left, right, 0.6) == {("b", i): (1000, 1.0) for i in range(500)}
