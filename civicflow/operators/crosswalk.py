"""Links between dockets: shared register numbers, shared rule identifiers, back-references, similar titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicflow.functions.text import present
from civicflow.operators.matching import by_priority
from civicflow.operators.retrieval import tfidf_links

PRIORITY = ["fr_number", "rin", "comment_on_doc", "title_similarity"]


def orphans(rules: DataFrame, commented: DataFrame, docket: str = "docket_id") -> DataFrame:
    """Dockets with rules but without comments."""
    return rules.select(present(F.col(docket)).alias(docket)).where(f"{docket} is not null").distinct().join(commented.select(docket).distinct(), docket, "left_anti")


def linked_by(rows: DataFrame, key: Column, orphan_dockets: DataFrame, comment_dockets: DataFrame, method: str) -> DataFrame:
    """(orphan_docket, comment_docket, method, evidence) of dockets that share a key's value, an orphan on one side and comments on the other."""
    own = rows.select(present(F.col("docket_id")).alias("docket_id"), F.explode(key).alias("value")).where("docket_id is not null and value <> ''").distinct()
    left = own.join(orphan_dockets, "docket_id", "left_semi").select(F.col("docket_id").alias("orphan_docket"), "value")
    right = own.join(comment_dockets.select("docket_id"), "docket_id", "left_semi").select(F.col("docket_id").alias("comment_docket"), "value")
    met = left.join(right, "value").where("orphan_docket <> comment_docket")
    return met.groupBy("orphan_docket", "comment_docket").agg(F.lit(method).alias("method"), F.min("value").alias("evidence"))


def identifiers(c: Column) -> Column:
    """Values of a cell with several, split at commas, semicolons and white space."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[,;\s]+"), lambda x: ~F.lower(x).isin("", "nan", "none"))


def linked_by_reference(rows: DataFrame, documents: DataFrame, orphan_dockets: DataFrame, comment_dockets: DataFrame) -> DataFrame:
    """Links through the document that a row of an orphan docket refers back to."""
    own = rows.join(orphan_dockets, "docket_id", "left_semi").select(F.col("docket_id").alias("orphan_docket"), present(F.col("refers_to")).alias("document_id"))
    met = own.where("document_id is not null").join(documents.select("document_id", F.col("docket_id").alias("comment_docket")), "document_id")
    kept = met.where("orphan_docket <> comment_docket").join(comment_dockets.select(F.col("docket_id").alias("comment_docket")), "comment_docket", "left_semi")
    return kept.groupBy("orphan_docket", "comment_docket").agg(F.lit("comment_on_doc").alias("method"), F.min("document_id").alias("evidence"))


def linked_by_title(orphan_titles: DataFrame, comment_titles: DataFrame, least: float = 0.6) -> DataFrame:
    """Best title match of each orphan docket within its agency. Both tables: block, id (docket), text."""
    found = tfidf_links(orphan_titles, comment_titles, least)
    return found.select(F.col("left_id").alias("orphan_docket"), F.col("right_id").alias("comment_docket"), F.lit("title_similarity").alias("method"), F.round("score", 6).cast("string").alias("evidence"))


def best_links(*links: DataFrame) -> DataFrame:
    """One link for each pair of dockets, by the most trusted method."""
    every = links[0]
    for x in links[1:]:
        every = every.unionByName(x)
    order = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("method"))
    return by_priority(every, ["orphan_docket", "comment_docket"], order, ["evidence"])


def proposals_of(*links: DataFrame, comment_dockets: DataFrame) -> DataFrame:
    """One proposal docket for each rule docket, of links (rule_docket, proposal_docket, method, evidence), by the most trusted method, and whether it has comments.

    Shared register numbers come first, then shared rule identifiers, then a scorer's matches.
    """
    every = links[0]
    for x in links[1:]:
        every = every.unionByName(x)
    order = F.array_position(F.array(*map(F.lit, ["fr_number", "rin", "ce"])), F.col("method"))
    best = by_priority(every.where("rule_docket <> proposal_docket"), ["rule_docket"], order, ["proposal_docket", "evidence"])
    has = comment_dockets.select(F.col("docket_id").alias("commented")).where("commented is not null").distinct()
    met = best.join(has, F.col("proposal_docket") == F.col("commented"), "left")
    return met.select("rule_docket", "proposal_docket", "method", "evidence", F.col("commented").isNotNull().alias("proposal_has_comments"))


def training_pairs(rules: DataFrame, proposals: DataFrame, most: int = 3, seed: str = "0") -> DataFrame:
    """(rule_id, proposal_id, docket_id): rules and proposals (id, docket_id) of one docket, up to ``most`` pairs of each, by a hash.

    Both sides are cut to ``most`` rows of a docket before they meet, so a docket makes ``most`` squared pairs at most.
    """
    from civicflow.operators.selection import sample_each

    left = sample_each(rules, ["docket_id"], "id", most, seed).select("docket_id", F.col("id").alias("rule_id"))
    right = sample_each(proposals, ["docket_id"], "id", most, seed).select("docket_id", F.col("id").alias("proposal_id"))
    met = left.join(right, "docket_id").withColumn("pair", F.concat_ws(":", "rule_id", "proposal_id"))
    return sample_each(met, ["docket_id"], "pair", most, seed).select("rule_id", "proposal_id", "docket_id")
