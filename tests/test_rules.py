"""Rules of clustering, ranking and merging that a whole-table comparison may not reach."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from civicflow.functions import text as X
from civicflow.operators import crosswalk as C
from civicflow.operators import dedup as D
from civicflow.operators import matching as M
from civicflow.operators import metrics, retrieval, stats
from civicflow.operators.components import components


def words(seed, n=120):
    rng = random.Random(seed)
    return ["w" + str(rng.randrange(10**6)) for _ in range(n)]


def clusters(spark, texts, **more):
    df = spark.createDataFrame([(i, "d", t) for i, t in texts], "id long, docket string, text string").repartition(3)
    return {r["id"]: r for r in D.cluster(df, **more).collect()}


def test_small_docket_never_clusters(spark):
    base = words(1)
    got = clusters(spark, [(1, " ".join(base)), (2, " ".join(base).upper()), (3, " ".join(base).capitalize())])
    assert {r["reason"] for r in got.values()} == {"common"} and {r["cluster"] for r in got.values()} == {1, 2, 3}


def test_big_docket_clusters_copies_and_spares_others(spark):
    base = words(2)
    near = [" ".join(base[:-1] + [f"end{i}"]) for i in range(3)]
    texts = [(i, " ".join(words(100 + i))) for i in range(17)] + [(50 + i, t) for i, t in enumerate(near)] + [(90 + i, near[0]) for i in range(4)] + [(99, " ".join(words(7, 79)))]
    got = clusters(spark, texts)
    assert {got[i]["cluster"] for i in (50, 51, 52, 90, 91, 92, 93)} == {50}
    assert all(got[i]["reason"] == "alone" and got[i]["cluster"] == i for i in range(17)) and got[99]["reason"] == "short"
    ids = {r["id"]: r["cluster_id"] for r in D.mapper(spark.createDataFrame([(r["block"], r["id"], r["rep"], r["cluster"], r["reason"]) for r in got.values()], "block string, id long, rep long, cluster long, reason string")).collect()}
    assert ids[50] == 0 and sorted(set(ids.values())) == list(range(19))


def test_template_in_too_many_documents_is_erased(spark):
    base = words(3)
    texts = [(i, " ".join(words(300 + i))) for i in range(14)] + [(50 + i, " ".join(base[:-1] + [f"end{i}"])) for i in range(6)]
    got = clusters(spark, texts)
    assert len({got[i]["cluster"] for i in range(50, 56)}) == 6
    assert len({r["cluster"] for i, r in clusters(spark, texts, most_common=None).items() if i >= 50}) == 1


def test_unlike_member_is_ejected(spark):
    base = words(4, 200)
    other = base[:60] + words(5, 140)
    texts = [(i, " ".join(words(400 + i))) for i in range(16)] + [(50, " ".join(base)), (51, " ".join(other))]
    got = clusters(spark, texts, bands=64, rows=2)
    assert {got[50]["reason"], got[51]["reason"]} <= {"clustered", "ejected", "alone"}
    assert got[50]["cluster"] != got[51]["cluster"]


def md5_60(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def test_shingles_and_short_texts():
    assert set(D.shingle_hashes("a  b\tc")) == {md5_60("a b c"), md5_60("b c"), md5_60("c")} and D.shingle_hashes("").size == 0
    assert set(D.shingle_hashes("a b c d e f a b c d e f")) == {md5_60(" ".join(("abcdef" * 2)[i : i + 5])) for i in range(6)}


def test_shingles_split_where_tokens_do(spark):
    text = "".join(f"w{chr(c)}" for c in [*range(1, 0x180), 0x1680, 0x180E, *range(0x2000, 0x2070), 0x3000, 0xFEFF])
    assert retrieval.split_words(text) == spark.createDataFrame([(text,)], "t string").select(X.tokens(F.col("t")).alias("r")).first()["r"]


def test_least_values_against_big_numbers():
    rng = random.Random(3)
    hashes = [rng.randrange(1 << 60) for _ in range(3000)]
    want = [min((a * (h >> 30) + b * (h & (1 << 30) - 1) + c) % D.PRIME for h in hashes) for a, b, c in D.family()]
    assert D.least_values(np.array(hashes)).tolist() == want


def test_components_on_a_star_and_a_ring(spark):
    edges = [(0, i) for i in range(1, 500)] + [(1000 + i, 1000 + (i + 1) % 50) for i in range(50)]
    root = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {root[i] for i in range(500)} == {0} and {root[1000 + i] for i in range(50)} == {1000}


def test_ranking_ties_go_to_the_lower_id(spark):
    rows = spark.createDataFrame([("q", 3, 0.5), ("q", 1, 0.5), ("q", 2, 0.9)], "query_id string, id int, score double")
    assert [(r["id"], r["rank"]) for r in retrieval.top(rows, ["query_id"], "score", "id", 2).orderBy("rank").collect()] == [(2, 1), (1, 2)]


def test_sparse_only_hit_has_dense_score_zero(spark):
    dense = spark.createDataFrame([(1, 1, 0.7)], "query_id int, id int, score double")
    sparse = spark.createDataFrame([(1, 1, 3.0), (1, 2, 2.0)], "query_id int, id int, score double")
    assert sorted((r["id"], r["dense_score"]) for r in retrieval.dense_or_sparse(dense, sparse).collect()) == [(1, 0.7), (2, 0.0)]


def test_equal_f1_takes_the_lower_threshold(spark):
    rows = spark.createDataFrame([(0.9, True), (0.1, False)], "s double, y boolean")
    assert metrics.best_threshold(rows, "s", F.col("y")).first()["threshold"] == pytest.approx(0.11)


def test_ratios_over_nothing(spark):
    pairs = spark.createDataFrame([], "config string, docket string, item string, label string")
    assert metrics.overton(pairs, ["config"], "docket", "item", "label").count() == 0
    one = spark.createDataFrame([("c", "d", "i", None)], "config string, docket string, item string, label string")
    got = metrics.overton(one, ["config"], "docket", "item", "label").first()
    assert (got["items"], got["matched"], got["parity"]) == (1, 0, 0.0)


def test_divergence_of_an_empty_side(spark):
    rows = spark.createDataFrame([("a", "x", 0, 3), ("a", "y", 0, 1), ("b", "x", 1, 1)], "g string, c string, p int, q int")
    got = {r["g"]: r["jsd"] for r in metrics.jensen_shannon(rows, ["g"], "c", "p", "q").collect()}
    assert got == {"a": 0.5, "b": pytest.approx(0.0)}
    assert metrics.jensen_shannon(rows, ["g"], "c", "p", "q", zero_side=None).count() == 1


def test_correlation_of_a_constant_is_null(spark):
    assert metrics.pearson(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double"), "x", "y").first()["pearson"] is None


def test_bootstrap_is_repeatable_and_covers_the_mean(spark):
    rows = spark.createDataFrame([("a", float(i % 3 == 0)) for i in range(300)] + [("b", None)], "g string, v double")
    one, two = metrics.bootstrap(rows, ["g"], "v").collect(), metrics.bootstrap(rows.repartition(5), ["g"], "v").collect()
    assert one == two and len(one) == 1 and one[0]["low"] < one[0]["mean"] < one[0]["high"] and one[0]["n"] == 300


def test_crosswalk_prefers_register_numbers(spark):
    links = spark.createDataFrame([("o", "c", "rin", "1"), ("o", "c", "fr_number", "2")], "orphan_docket string, comment_docket string, method string, evidence string")
    assert C.best_links(links).first()["method"] == "fr_number"
    titles = spark.createDataFrame([("a", "o1", "Clean water standards rule")], "block string, id string, text string")
    others = spark.createDataFrame([("a", "c1", "Clean water standards rule for rivers"), ("b", "c2", "Clean water standards rule")], "block string, id string, text string")
    assert [r["comment_docket"] for r in C.linked_by_title(titles, others, 0.3).collect()] == ["c1"]


def test_first_row_and_appends_do_not_depend_on_order(spark):
    rows = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("l", 5, None)], "k string, o int, v string")
    got = sorted((r["k"], r["v"]) for r in stats.first_by(rows.repartition(3), ["k"], [F.col("o")], ["v"]).collect())
    assert got == [("k", "a"), ("l", None)]
    old = spark.createDataFrame([("k", 9, "old")], "k string, o int, v string")
    assert sorted((r["k"], r["v"]) for r in M.append_new(old, rows, "k", "o").collect()) == [("k", "old"), ("l", None)]


def test_expensive_function_runs_once_a_text(spark):
    rows = spark.createDataFrame([("a",), ("a",), (None,)], "t string")
    got = retrieval.once_per_text(rows, "t", lambda c: F.length(c), "n", "int")
    assert sorted((r["n"] or 0) for r in got.collect()) == [0, 1, 1]


def test_pairs_of_one_group_are_dealt_to_many_tasks(spark):
    """A group of very many pairs was one task's, as the smaller side was broadcast to one split of the other."""
    from civicflow.operators.matching import query_pairs

    a = spark.range(300).select(F.col("id").alias("a"), F.floor(F.col("id") / 1000).alias("g")).coalesce(1)
    b = spark.range(40).select(F.col("id").alias("b"), F.floor(F.col("id") / 1000).alias("g")).coalesce(1)
    met = query_pairs(a, b, "g", "a", most=10)
    assert sorted(map(tuple, met.select("a", "b").collect())) == [(i, j) for i in range(300) for j in range(40)]
    sizes = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 10 and max(sizes) < 300 * 40 / 4
    assert query_pairs(a.limit(0), b, "g", "a").count() == 0
