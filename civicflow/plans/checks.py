"""Checks of a matching run: reach and recall, what became of cited documents, rates, totals, and answers taken apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.functions import answers, text as X
from civicflow.operators import matching as M, selection as L, stats, validation as V
from civicflow.plans import Plans, table
from civicflow.plans.matching import _CLASSES, _STATE, _near, _recovered

plans = Plans()

_COUNT = lambda name, *tests: f"count(*) FILTER (WHERE {' AND '.join(tests)})::BIGINT AS {name}"
_PCT = lambda name, a, b: f"(CASE WHEN {b} = 0 THEN 0 ELSE round(100.0 * {a} / {b}, 6) END)::DOUBLE AS {name}"


# The SQL finds the relevant ids by lookups of each id, Spark by classes.
@plans.add(f"""WITH {_CLASSES}, staged AS (SELECT doc_id AS id FROM documents), retrieved AS (SELECT doc_id AS id FROM documents WHERE n_chars % 2 = 0), matched AS (SELECT doc_id AS id FROM labels WHERE toxic = 1),
back AS (SELECT n.target AS id FROM cited c JOIN near n ON n.duplicate = c.id),
relevant AS (SELECT id FROM cited UNION SELECT n.duplicate FROM cited c JOIN near n ON n.target = c.id UNION SELECT id FROM back UNION SELECT n.duplicate FROM back b JOIN near n ON n.target = b.id),
every AS (SELECT id, id IN (FROM cited) AS c, id IN (FROM relevant) AS r, id IN (FROM staged) AS s, id IN (FROM retrieved) AS g, id IN (FROM matched) AS m FROM (FROM relevant UNION FROM staged UNION FROM matched)),
n AS (SELECT {_COUNT("staged", "s")}, {_COUNT("cited", "c")}, {_COUNT("relevant", "r")}, {_COUNT("retrieved", "g")}, {_COUNT("matched", "m")}, {_COUNT("cited_staged", "c", "s")}, {_COUNT("cited_reached", "c", "s", "g")}, {_COUNT("cited_found", "c", "s", "m")},
  {_COUNT("relevant_staged", "r", "s")}, {_COUNT("relevant_reached", "r", "s", "g")}, {_COUNT("relevant_found", "r", "s", "m")} FROM every)
SELECT *, {_PCT("cited_reached_pct", "cited_reached", "cited_staged")}, {_PCT("cited_found_pct", "cited_found", "cited_staged")}, {_PCT("relevant_reached_pct", "relevant_reached", "relevant_staged")}, {_PCT("relevant_found_pct", "relevant_found", "relevant_staged")},
  {_PCT("match_rate_floor", "matched", "staged")} FROM n""")
def validation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reach, recall and match-rate floor of cited ids and of those with their near-duplicates."""
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    matched = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    found = V.validation_metrics(*_near(spark, sf_dir), ids, ids.where("n_chars % 2 = 0"), matched)
    return found.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


@plans.add(f"""WITH {_STATE}, o AS (SELECT CASE WHEN direct THEN 'directly_matched' WHEN NOT staged THEN 'not_in_mapper' WHEN id % 3 = 0 AND by_cluster THEN 'merged_recoverable' WHEN id % 3 = 0 THEN 'merged_rep_unmatched'
  WHEN by_cluster THEN 'staged_recoverable' WHEN id % 5 = 0 THEN 'staged_not_retrieved' ELSE 'staged_below_threshold' END AS reason FROM rec), k AS (SELECT reason, count(*) AS n FROM o GROUP BY reason)
SELECT reason, coalesce(n, 0)::BIGINT AS n, round(100.0 * coalesce(n, 0) / (SELECT count(*) FROM rec), 6)::DOUBLE AS pct FROM (VALUES {", ".join(f"('{x}')" for x in V.OUTCOMES)}) t(reason) LEFT JOIN k USING (reason)""")
def error_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every cited document, in seven kinds that add up."""
    found, members = _recovered(spark, sf_dir)
    met = found.join(members.select("id", F.lit(True).alias("mapped")), "id", "left")
    reason = V.outcome(F.col("direct"), F.col("mapped"), F.col("id") % 3 != 0, F.col("by_cluster"), F.col("id") % 5 != 0)
    return V.outcome_counts(met.select(reason.alias("reason")), "reason").withColumn("pct", F.round("pct", 6))


_LENGTHS = ["very_short", "short", "medium", "long", "very_long", "endless"]


@plans.add(f"""WITH m AS (SELECT CASE WHEN n_chars < 300 THEN 'very_short' WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 2000 THEN 'medium' WHEN n_chars < 4000 THEN 'long' ELSE 'very_long' END AS key, quality = 1 AS f FROM documents JOIN labels USING (doc_id)),
k AS (SELECT key, count(*) AS n, count(*) FILTER (WHERE f) AS n_flag FROM m WHERE f IS NOT NULL GROUP BY key)
SELECT no::INTEGER AS no, key, coalesce(n, 0)::BIGINT AS n, coalesce(n_flag, 0)::BIGINT AS n_flag, round(coalesce(n_flag / n, 0), 6)::DOUBLE AS rate, round(100.0 * coalesce(n, 0) / (SELECT sum(n) FROM k), 6)::DOUBLE AS pct
FROM (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(_LENGTHS))}) t(no, key) LEFT JOIN k USING (key)""")
def length_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by length in the order of lengths, with shares of the corpus; no text is of the last kind."""
    met = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    kind = F.when(F.col("n_chars") < 300, "very_short").when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 2000, "medium").when(F.col("n_chars") < 4000, "long").otherwise("very_long")
    found = stats.ordered_rates(met.select(kind.alias("kind"), (F.col("quality") == 1).alias("f")), "kind", "f", _LENGTHS)
    return found.select("no", "key", "n", "n_flag", *[F.round(c, 6).alias(c) for c in ("rate", "pct")])


@plans.add("""
WITH m AS (SELECT source, n_chars % 6 AS score, CASE WHEN n_chars % 11 <> 0 THEN quality = 1 END AS f FROM documents JOIN labels USING (doc_id) WHERE n_chars % 10 <> 0)
SELECT kind, key, count(*)::BIGINT AS n, count(*) FILTER (WHERE f)::BIGINT AS n_flag, round(avg(f::INT), 6)::DOUBLE AS rate FROM (SELECT 'source' AS kind, source AS key, f FROM m UNION ALL SELECT 'score', score::VARCHAR, f FROM m) WHERE f IS NOT NULL GROUP BY kind, key""")
def specialist_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of a flag by source and by score, over parsed rows that have the flag."""
    met = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("n_chars % 10 <> 0")
    rows = met.select("source", (F.col("n_chars") % 6).cast("string").alias("score"), F.when(F.col("n_chars") % 11 != 0, F.col("quality") == 1).alias("f"))
    both = [stats.flag_rates(rows, by, "f").select(F.lit(by).alias("kind"), "key", "n", "n_flag", F.round("rate", 6).alias("rate")) for by in ("source", "score")]
    return both[0].unionByName(both[1])


@plans.add("SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE o_orderstatus IN ('F', 'O'))::BIGINT AS actual, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS \"O\" FROM orders")
def status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.status_totals(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O"])


@plans.add("SELECT count(*)::BIGINT AS groups, floor(median(n))::BIGINT AS median FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def claim_count_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many dockets have claims, and the median of their numbers."""
    return stats.group_sizes(table(spark, sf_dir, "orders"), "o_custkey")


@plans.add("""
WITH a AS (SELECT l_orderkey AS doc_id, l_partkey AS response, CASE WHEN max(l_quantity) > 25 THEN 'yes' ELSE 'no' END AS label FROM lineitem WHERE l_linenumber <= 5 GROUP BY 1, 2),
b AS (SELECT l_orderkey AS doc_id, l_partkey AS response, CASE WHEN max(l_discount) > 0.05 THEN 'yes' ELSE 'no' END AS label FROM lineitem WHERE l_linenumber >= 2 GROUP BY 1, 2)
SELECT count(*)::BIGINT AS n, round(avg((a.label = b.label)::INT), 6)::DOUBLE AS agreement, round(avg((a.label = 'yes')::INT), 6)::DOUBLE AS first_yes, round(avg((b.label = 'yes')::INT), 6)::DOUBLE AS second_yes FROM a JOIN b USING (doc_id, response)""")
def pair_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two labellings whose key is a document and a response."""
    rows, keys = table(spark, sf_dir, "lineitem"), [F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("response")]
    said = lambda part, value: part.groupBy(*keys).agg(F.when(value, "yes").otherwise("no").alias("label"))
    found = M.agreement(said(rows.where("l_linenumber <= 5"), F.max("l_quantity") > 25), said(rows.where("l_linenumber >= 2"), F.max("l_discount") > 0.05), ["doc_id", "response"], "label")
    return found.select("n", *[F.round(c, 6).alias(c) for c in ("agreement", "first_yes", "second_yes")])


_BUCKETS = {"src0": "business", "src1": "business", "src2": "government"}


@plans.add("WITH m(k, v) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _BUCKETS.items()) + ") SELECT doc_id, v AS bucket FROM documents JOIN m ON source = k")
def bucket_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their source's bucket; those of other sources are left out."""
    return L.bucketed(table(spark, sf_dir, "documents"), "source", _BUCKETS, "bucket").select("doc_id", "bucket")


@plans.add("""
SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN lang END AS org_type, CASE WHEN doc_id % 5 <> 0 AND doc_id % 3 = 0 THEN 'true' WHEN doc_id % 5 <> 0 THEN 'false' END AS is_form_letter,
  CASE WHEN doc_id % 5 NOT IN (0, 1) THEN n_chars::VARCHAR END AS n_issues, CASE WHEN doc_id % 5 = 2 THEN NULL WHEN doc_id % 5 <> 0 THEN source END AS tone FROM documents""")
def answer_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns from paths into answers: objects, lists of objects, objects without a part, and broken ones."""
    kind = F.col("doc_id") % 5
    person = F.struct(F.col("lang").alias("org_type"), F.struct((F.col("doc_id") % 3 == 0).alias("is_form_letter")).alias("format"))
    depth = F.when(kind != 1, F.struct(F.col("n_chars").alias("n_issues")))
    whole = F.struct(person.alias("commenter"), depth.alias("engagement"), F.when(kind != 2, F.col("source")).alias("tone"), F.lit("x").alias("unused"))
    said = F.when(kind == 0, '{"commenter": {"org').when(kind == 3, F.to_json(F.array(whole))).otherwise(F.to_json(whole))
    paths = {"org_type": ("commenter", "org_type"), "is_form_letter": ("commenter", "format", "is_form_letter"), "n_issues": ("engagement", "n_issues"), "tone": ("tone",)}
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").withColumn("said", said).select("doc_id", *answers.flattened(F.col("said"), paths))


@plans.add("""
SELECT doc_id, doc_id % 4 = 0 OR length(trim(text)) = 0 OR doc_id % 7 = 0 OR greatest(CASE WHEN doc_id % 3 = 0 THEN doc_id % 40 ELSE 1 END, 1) >= 12 AS again, doc_id % 4 = 0 OR length(trim(text)) >= 0 AS every_time FROM documents WHERE text IS NOT NULL""")
def reverify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stored texts are to be fetched again, by their page markers: a third has them, a seventh is missing."""
    k, page = F.col("doc_id"), lambda n: F.concat(F.lit("<<PAGE "), n.cast("string"), F.lit(">>\\n"))
    marked = F.when(k % 3 == 0, F.concat(page(F.lit(1)), "text", page(F.greatest(k % 40, F.lit(1))))).otherwise(F.col("text"))
    stored = F.when(k % 7 != 0, marked)
    rows = table(spark, sf_dir, "documents").where("text is not null")
    return rows.select("doc_id", X.reverified(stored, k % 4 == 0, 12).alias("again"), X.reverified(stored, k % 4 == 0).alias("every_time"))
