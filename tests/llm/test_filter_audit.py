"""The audit against one that applies every order to every document."""

import re
from itertools import permutations

from civicflow.llm import filter_audit as A

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def plain(docs, labels):
    ids = {}
    for i, text, _ in docs:
        ids.setdefault(text or "", []).append(i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failing = []
    for i, text, lang in docs:
        t = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        others = [o for o in ids[t] if o is not None]
        copy = bool(others) if i is None else any(o < i for o in others)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": copy}
        failing.append((lang or "", i in good, i in toxic, {k for k in f if f[k]}))
    out = {}
    for part in {x[0] for x in failing}:
        own = [x for x in failing if x[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[3]]
                before, left = left, [d for d in left if x not in d[3]]
                shapley[x] += len(gone)
                redundant = sum(x in d[3] for d in own) - sum(x in d[3] for d in before)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(d[3] == {x} for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def check(spark, tmp_path, docs, labels, more=()):
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    for c in more:
        d, lab = d.selectExpr("*", f"1 AS `{c}`"), lab.selectExpr("*", f"'?' AS `{c}`")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    lab.write.parquet(f"{tmp_path}/labels.parquet")
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in A.op12_filter_audit(spark, str(tmp_path)).collect()}
    assert got == plain(docs, labels)
    return got


def test_odd_documents(spark, tmp_path):
    long = " ".join(f"w{k}" for k in range(120))
    docs = [
        (1, long, "en"), (2, long, "de"), (2, long, "de"), (3, None, None), (4, "", ""), (None, long, "en"), (None, "alone", "en"), (None, "alone", "en"), (5, "a b # c", "en"),
        (6, "SHOUT " * 130, "fr"), (7, " \t\v\f\r\n", "fr"), (8, "x y " * 120, "fr"), (9, long + " ABC" * 200, "en"), (10, "alone", "en"), (11, long.upper(), "en"), (12, "\U0001F600A" * 9, "en"),
        (13, long + " $", "en"), (13, "other text", "en"), (14, "z " * 60000 + long, "de"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (5, None, 1), (None, 1, 1), (9, 1, 1), (13, 1, 0), (99, 1, 1)]
    check(spark, tmp_path, docs, labels, more=("part", "mask", "text_hash", "good", "n", "of", "marked", "a.b"))


def test_no_documents(spark, tmp_path):
    assert check(spark, tmp_path, [], [(1, 1, 1)]) == {}


def test_no_labels(spark, tmp_path):
    assert len(check(spark, tmp_path, [(1, "a", "en")], [])) == 600


def test_orders_apply_to_documents(spark):
    rows = spark.createDataFrame([(1, 0b00011), (2, 0b10000), (3, 0)], "doc_id long, mask int")
    assert {r["doc_id"]: r["removed_by"] for r in A.apply_order(rows, "EBACD").collect()} == {1: "B", 2: "E", 3: None}
