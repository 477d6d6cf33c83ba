"""Checks of a matching run on small tables: odd inputs of reach, outcomes, rates, buckets and paths."""

import json

import pytest
from pyspark.sql import functions as F

from civicflow.functions import answers, names, text as X
from civicflow.operators import selection, stats, validation as V


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def test_validation_metrics_by_hand(spark):
    near = spark.createDataFrame([(1, 10), (1, 11), (20, 2), (20, 21), (None, 5), (30, 31)], "target long, duplicate long")
    cited = ids(spark, 1, 2, 2, 3, None)
    assert sorted(r["id"] for r in V.relevant_ids(cited, near).collect()) == [1, 2, 3, 10, 11, 20, 21]
    pairs = {r["id"] for r in V.expand_one_hop(cited.where("id is not null"), near.where("target is not null")).collect()}
    assert pairs == {1, 2, 3, 10, 11, 20, 21}
    got = V.validation_metrics(cited, near, ids(spark, 1, 2, 10, 20, 40, 40, None), ids(spark, 1, 10, 10, 50), ids(spark, 1, 20, 60)).first().asDict()
    assert (got["staged"], got["cited"], got["relevant"], got["retrieved"], got["matched"]) == (5, 3, 7, 3, 3)
    assert (got["cited_staged"], got["cited_reached"], got["cited_found"]) == (2, 1, 1)
    assert (got["relevant_staged"], got["relevant_reached"], got["relevant_found"]) == (4, 2, 2)
    assert (got["cited_reached_pct"], got["relevant_found_pct"], got["match_rate_floor"]) == (50.0, 50.0, 60.0)


def test_validation_metrics_of_nothing(spark):
    none = ids(spark)
    got = V.validation_metrics(none, spark.createDataFrame([], "target long, duplicate long"), none, none, none).first().asDict()
    assert set(got.values()) == {0}


def test_outcomes_are_exclusive_and_whole(spark):
    states = [(m, i, s, c, r) for m in (True, False) for i in (True, False, None) for s in (True, False) for c in (True, False) for r in (True, None)]
    rows = spark.createDataFrame(states, "m boolean, i boolean, s boolean, c boolean, r boolean")
    named = rows.select("*", V.outcome(*map(F.col, ["m", "i", "s", "c", "r"])).alias("o"))
    for row in named.collect():
        want = (
            "directly_matched" if row["m"] else "not_in_mapper" if not row["i"] else
            ("merged_recoverable" if row["c"] else "merged_rep_unmatched") if not row["s"] else
            "staged_recoverable" if row["c"] else "staged_below_threshold" if row["r"] else "staged_not_retrieved"
        )
        assert row["o"] == want
    counts = {r["reason"]: r["n"] for r in V.outcome_counts(named, "o").collect()}
    assert list(counts) == V.OUTCOMES and sum(counts.values()) == len(states)
    assert {r["n"] for r in V.outcome_counts(named.limit(0), "o").collect()} == {0}


def test_rates_and_totals(spark):
    rows = spark.createDataFrame([("a", True), ("a", None), ("a", False), ("c", True), (None, True)], "k string, f boolean")
    assert {r["key"]: (r["n"], r["n_flag"], r["rate"]) for r in stats.flag_rates(rows, "k", "f").collect()} == {"a": (2, 1, 0.5), "c": (1, 1, 1.0), None: (1, 1, 1.0)}
    got = [tuple(r) for r in stats.ordered_rates(rows, "k", "f", ["c", "b", "a"]).orderBy("no").collect()]
    assert [r[:5] for r in got] == [(0, "c", 1, 1, 1.0), (1, "b", 0, 0, 0.0), (2, "a", 2, 1, 0.5)] and [r[5] for r in got] == pytest.approx([100 / 3, 0, 200 / 3])
    assert [r["pct"] for r in stats.ordered_rates(rows.limit(0), "k", "f", ["x"]).collect()] == [0.0]
    assert tuple(stats.status_totals(rows, "k", ["a", "z"]).first()) == (5, 3, 3, 0)
    assert tuple(stats.group_sizes(rows, "k").first()) == (2, 2)  # sizes 3 and 1
    assert tuple(stats.group_sizes(rows.limit(0), "k").first()) == (0, 0)


def test_buckets_drop_what_they_do_not_know(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, "z")], "id long, org string")
    assert [(r["id"], r["b"]) for r in selection.bucketed(rows, "org", {"x": "one", "z": "two"}, "b").orderBy("id").collect()] == [(1, "one"), (4, "two")]
    assert selection.bucketed(rows, "org", {}, "b").count() == 0


def test_paths_into_answers(spark):
    said = [
        json.dumps({"a": {"b": 1, "c": {"d": "x"}}, "t": [1, 2]}), json.dumps([{"a": {"b": True}}, {"a": {"b": 9}}]), json.dumps({"a": "flat", "t": "kept"}),
        "[]", "{broken", "", None, json.dumps("text"), json.dumps({"a": {"b": None, "c": {}}}),
    ]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    got = [tuple(r)[1:] for r in rows.select("i", *answers.flattened(F.col("s"), {"b": ("a", "b"), "d": ("a", "c", "d"), "t": ("t",)})).orderBy("i").collect()]
    assert got == [("1", "x", "[1,2]"), ("true", None, None), (None, None, "kept")] + [(None, None, None)] * 6
    with pytest.raises(ValueError):
        answers.flattened(F.col("s"), {"p": ("a",), "q": ("a", "b")})
    with pytest.raises(ValueError):
        answers.flattened(F.col("s"), {"q": ("a", "b"), "p": ("a",)})


def test_first_object_of_lists_and_objects(spark):
    rows = spark.createDataFrame([('[{"k": 1}, {"k": 2}]',), ('{"k": 3}',), ("[]",), (None,)], "s string")
    assert [r[0] for r in rows.select(answers.first_object(F.col("s"), "struct<k:int>")["k"]).collect()] == [1, 3, None, None]


def test_reverification(spark):
    rows = spark.createDataFrame([("t <<PAGE 3>> <<PAGE 12>>", False), ("<<PAGE 3>>", False), ("plain", False), (" ", None), (None, False), ("plain", True)], "s string, part boolean")
    asked = lambda **k: [r[0] for r in rows.select(X.reverified(F.col("s"), F.col("part"), **k)).collect()]
    assert asked(least=10) == [True, False, False, True, True, True]
    assert asked(least=1) == [True] * 6 and asked() == [True] * 6 and asked(enabled=False) == [False] * 6


def test_first_names_take_the_better_way(spark):
    short, long = next(iter(names.NICKNAMES.items()))
    rows = spark.createDataFrame([(short, long, "TX", "TX"), (short, short, "", ""), (None, long, None, "TX"), (short, "zzz", "TX", "NY")], "a string, b string, s string, t string")
    got = [tuple(r) for r in rows.select(names.first_similarity(F.col("a"), F.col("b")), names.state_match(F.col("s"), F.col("t"))).collect()]
    assert got[0] == (1.0, 1.0) and got[1] == (1.0, 0.0) and got[2] == (0.0, 0.0) and got[3][0] < 0.7 and got[3][1] == 0.0
    pairs = spark.createDataFrame([("jonathan", "jon"), ("jon", "jonathan")] * 40, "a string, b string")
    assert len({r[0] for r in pairs.select(names.similarity(F.col("a"), F.col("b"))).collect()}) == 1
