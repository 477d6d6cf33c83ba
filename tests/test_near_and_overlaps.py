"""Near-duplicates by class against pairs, and the greedy dedup of one document against its loop."""

import random
import re
import time

from civicflow.operators import validation as V
from civicflow.operators.chunking import kept_responses


def loop(texts, least=0.85):
    kept = []
    for t in texts:
        own = set(re.findall(r"\w+", t.lower()))
        for i, (old, words) in enumerate(kept):
            small = min(len(own), len(words))
            if small and len(own & words) / small >= least:
                if len(t) > len(old):
                    kept[i] = (t, own)
                break
        else:
            kept.append((t, own))
    return [t for t, _ in kept]


def test_overlaps_equal_the_loop():
    rng = random.Random(1)
    for n, words, least in ((60, 8, 0.85), (200, 30, 0.85), (200, 12, 0.5), (150, 20, 1.0)):
        texts = [" ".join(rng.choice(["the", "a", *[f"w{k}" for k in range(words)]]) for _ in range(rng.randrange(0, 12))) + "!" * rng.randrange(3) for _ in range(n)]
        texts += [t + " more words" for t in texts[:20]] + [" ".join(t.split()[:4]) for t in texts[:20]] + ["", "  ", "..."]
        rng.shuffle(texts)
        assert kept_responses(texts, least) == loop(texts, least)


def test_overlaps_of_many_lines():
    rng = random.Random(2)
    lines = [" ".join(["the", "of", "line", *(f"w{int(50_000 * rng.random())}" for _ in range(9))]) for _ in range(50_000)]
    lines += lines[:50_000]
    began = time.perf_counter()
    assert len(kept_responses(lines)) == 50_000
    assert time.perf_counter() - began < 60  # the loop would compare some billions of pairs


def test_classes_in_place_of_pairs(spark):
    rng = random.Random(3)
    near = [(rng.randrange(60), rng.randrange(60)) for _ in range(150)] + [(0, k) for k in range(100, 400)] + [(None, 1), (2, None)]
    near = [p for p in near if p[0] != p[1]]
    cited, matched = [0, 5, 9, 100, 399, 777, 778], [7, 150, 778]
    n = spark.createDataFrame(near, "target long, duplicate long")
    ids = lambda rows: spark.createDataFrame([(i,) for i in rows], "id long")
    pairs = {(r["via"], r["id"]) for r in V.expand_one_hop(ids(cited), n).collect()}
    classes = {}
    for r in V.duplicate_classes(n).collect():
        classes.setdefault(r["id"], set()).add(r["class"])
    members = {}
    for i, own in classes.items():
        for c in own:
            members.setdefault(c, set()).add(i)
    assert {(c, i) for c in cited for i in {c}.union(*(members[k] for k in classes.get(c, ())))} == {p for p in pairs if p[1] is not None}
    got = {r["id"]: (r["direct"], r["expanded"]) for r in V.found_by_class(ids([*cited, None, 5]), n, ids([*matched, None])).collect()}
    assert got == {c: (c in matched, any((c, m) in pairs for m in matched)) for c in cited}
    assert V.duplicate_classes(n).count() < 2 * len(near)
