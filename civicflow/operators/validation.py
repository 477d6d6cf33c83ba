"""Checks against external citations: near-duplicate expansion, cluster recovery, reasons for misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicflow.functions.numbers import ratio
from civicflow.storage import cut


ITEMS = 1 << 21  # rows that a task makes distinct


def distinct_rows(rows: DataFrame, items: int = ITEMS) -> DataFrame:
    """rows without repeats, dealt by all their columns to tasks of about ``items``, so that a task's memory doesn't grow with the table."""
    return rows.repartition(1 + rows.count() // items, *rows.columns).distinct()


def expand_one_hop(cited: DataFrame, near: DataFrame) -> DataFrame:
    """(id, via) of the cited ids, their duplicates, the originals that they duplicate, and these originals' other duplicates."""
    own = cited.select("id").distinct()
    forward = own.join(near, own["id"] == near["target"]).select(F.col("id").alias("via"), F.col("duplicate").alias("id"))
    back = own.join(near, own["id"] == near["duplicate"]).select(F.col("id").alias("via"), F.col("target").alias("id"))
    siblings = back.alias("b").join(near.alias("n"), F.col("b.id") == F.col("n.target")).select(F.col("b.via").alias("via"), F.col("n.duplicate").alias("id"))
    return distinct_rows(cut(own.select(F.col("id").alias("via"), "id").unionByName(forward).unionByName(back).unionByName(siblings), "pairs"))


def duplicate_classes(near: DataFrame) -> DataFrame:
    """(id, class): the members of each original's class, itself and its duplicates, from near (target, duplicate).

    What ``expand_one_hop`` pairs with an id is the members of all classes that hold the id. A class of n
    members is n rows here, and n squared pairs there.
    """
    own = near.where("target is not null and duplicate is not null")
    return distinct_rows(own.select(F.explode(F.array("target", "duplicate")).alias("id"), F.col("target").alias("class")))


def cited_classes(cited: DataFrame, near: DataFrame) -> DataFrame:
    """(class, members, cited): the sizes of the classes with a cited member, and how many of them are cited."""
    marked = cited.select("id").where("id is not null").distinct().withColumn("is_cited", F.lit(1))
    sizes = duplicate_classes(near).join(marked, "id", "left").groupBy("class").agg(F.count("*").alias("members"), F.count("is_cited").alias("cited"))
    return sizes.where("cited > 0")


def found_by_class(cited: DataFrame, near: DataFrame, matched: DataFrame) -> DataFrame:
    """(id, direct, expanded): is a cited id matched, or any id that ``expand_one_hop`` pairs with it? Matches are told to classes, and classes to their members."""
    members = duplicate_classes(near)
    hit = matched.select("id").where("id is not null").distinct().withColumn("direct", F.lit(True))
    classes = members.join(hit, "id", "left_semi").select("class").distinct()
    through = members.join(classes, "class", "left_semi").select("id").distinct().withColumn("through", F.lit(True))
    own = cited.select("id").where("id is not null").distinct().join(hit, "id", "left").join(through, "id", "left")
    direct = F.coalesce("direct", F.lit(False))
    return own.select("id", direct.alias("direct"), (direct | F.coalesce("through", F.lit(False))).alias("expanded"))


def recovered_by_cluster(cited: DataFrame, members: DataFrame, matched: DataFrame) -> DataFrame:
    """id, direct and by_cluster: is the cited document matched, or some member of its cluster?"""
    hit = matched.select("id").distinct().withColumn("direct", F.lit(True))
    state = members.join(hit, "id", "left")
    per = state.groupBy("cluster").agg(F.max(F.coalesce("direct", F.lit(False))).alias("by_cluster"))
    own = cited.select("id").distinct().join(state, "id", "left").join(per, "cluster", "left")
    return own.select("id", F.coalesce("direct", F.lit(False)).alias("direct"), F.coalesce("by_cluster", F.lit(False)).alias("by_cluster"))


def recall_summary(cited: DataFrame, direct: Column, expanded: Column, staged: Column) -> DataFrame:
    return cited.agg(
        F.count("*").alias("cited"), F.count_if(staged).alias("staged"), F.count_if(direct).alias("found"), F.count_if(direct | expanded).alias("found_expanded"),
        ratio(F.count_if(direct), F.count("*")).alias("recall"), ratio(F.count_if(direct), F.count_if(staged)).alias("recall_staged"), ratio(F.count_if(direct | expanded), F.count("*")).alias("recall_expanded"),
    )


def miss_reason(in_mapper: Column, is_rep: Column, rep_matched: Column, retrieved: Column, scored: Column) -> Column:
    """Why a cited document has no match; the first reason that holds, so that reasons add up."""
    return (
        F.when(~in_mapper, "not_in_mapper").when(~is_rep & rep_matched, "recoverable").when(~is_rep, "rep_unmatched")
        .when(~retrieved, "retrieval_gap").when(~scored, "not_scored").otherwise("threshold")
    )


def relevant_ids(cited: DataFrame, near: DataFrame) -> DataFrame:
    """id: the cited ones and all members of their near-duplicate classes, which is what ``expand_one_hop`` finds, without its pairs."""
    own = cited.select("id").where("id is not null").distinct()
    members = duplicate_classes(near)
    classes = members.join(own, "id", "left_semi").select("class").distinct()
    return own.unionByName(members.join(classes, "class", "left_semi").select("id")).distinct()


def validation_metrics(cited: DataFrame, near: DataFrame, staged: DataFrame, retrieved: DataFrame, matched: DataFrame) -> DataFrame:
    """One row of counts and percentages for tables of ids, which may repeat; null ids don't count.

    Of the cited ids that are staged, and of the relevant ones (with near-duplicates): how many were
    retrieved (reach) and matched (recall). The floor is the number of matches against all staged.
    A percentage of nothing is 0. One shuffle by id beside those of the classes.
    """
    sets = {"cited": cited, "relevant": relevant_ids(cited, near), "staged": staged, "retrieved": retrieved, "matched": matched}
    rows = None
    for name, ids in sets.items():
        part = ids.where("id is not null").select("id", *[F.lit(name == other).alias(other) for other in sets])
        rows = part if rows is None else rows.unionByName(part)
    per = rows.groupBy("id").agg(*[F.max(name).alias(name) for name in sets])
    count = lambda *names: F.count_if(F.expr(" and ".join(names)))
    n = per.agg(
        count("staged").alias("staged"), count("cited").alias("cited"), count("relevant").alias("relevant"), count("retrieved").alias("retrieved"), count("matched").alias("matched"),
        *[count(kind, "staged", *more).alias(f"{kind}_{name}") for kind in ("cited", "relevant") for name, more in (("staged", ()), ("reached", ("retrieved",)), ("found", ("matched",)))],
    )
    pct = lambda a, b: (100 * ratio(F.col(a), F.col(b)))
    return n.select(
        *n.columns, *[pct(f"{kind}_{name}", f"{kind}_staged").alias(f"{kind}_{name}_pct") for kind in ("cited", "relevant") for name in ("reached", "found")],
        pct("matched", "staged").alias("match_rate_floor"),
    )


#: What can have become of a cited document, in the order in which it is asked.
OUTCOMES = ["directly_matched", "not_in_mapper", "merged_recoverable", "merged_rep_unmatched", "staged_recoverable", "staged_not_retrieved", "staged_below_threshold"]


def outcome(matched: Column, in_mapper: Column, staged: Column, by_cluster: Column, retrieved: Column) -> Column:
    """One of ``OUTCOMES``; an unknown state counts as false. Those of staged documents differ by whether a cluster mate matched."""
    known = lambda c: F.coalesce(c, F.lit(False))
    matched, in_mapper, staged, by_cluster, retrieved = map(known, (matched, in_mapper, staged, by_cluster, retrieved))
    tests = [matched, ~in_mapper, ~staged & by_cluster, ~staged, by_cluster, ~retrieved]
    out = F.when(tests[0], OUTCOMES[0])
    for test, name in zip(tests[1:], OUTCOMES[1:]):
        out = out.when(test, name)
    return out.otherwise(OUTCOMES[-1])


def outcome_counts(rows: DataFrame, column: str) -> DataFrame:
    """(reason, n, pct) of all outcomes, those without rows among them; n adds up to the rows with an outcome."""
    one = rows.where(F.col(column).isin(OUTCOMES)).agg(F.count("*").alias("total"), *[F.count_if(F.col(column) == name).alias(name) for name in OUTCOMES])
    return one.select("total", F.inline(F.array(*[F.struct(F.lit(name).alias("reason"), F.col(name).alias("n")) for name in OUTCOMES]))).select("reason", "n", (100 * ratio(F.col("n"), F.col("total"))).alias("pct"))
