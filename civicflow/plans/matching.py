"""Pairs, samples, appends, crosswalks, validation, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.functions import names as N
from civicflow.operators import crosswalk as C, matching as M, stats, validation as V
from civicflow.plans import Plans, table
from civicflow.sources import sinks
from civicflow.storage import cut

plans = Plans()

_PAIRS = """pairs AS (SELECT l_orderkey AS response_key, l_partkey AS doc_id, 'c' || l_suppkey % 37 AS cluster_uid, l_discount * 10 AS score, CASE WHEN l_discount >= 0.05 THEN 'yes' ELSE 'no' END AS final_label FROM lineitem)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    own = rows.select(F.col("l_orderkey").alias("response_key"), F.col("l_partkey").alias("doc_id"), F.concat(F.lit("c"), (F.col("l_suppkey") % 37).cast("string")).alias("cluster_uid"), (F.col("l_discount") * 10).alias("score"), "l_discount")
    return M.labelled(own, "l_discount", F.lit(0.05)).drop("l_discount")


_YES = "final_label = 'yes'"


@plans.add(f"""WITH {_PAIRS} SELECT response_key, count(*)::BIGINT AS n_pairs, count(*) FILTER (WHERE {_YES})::BIGINT AS n_matched,
coalesce(string_agg(DISTINCT doc_id::VARCHAR, ';' ORDER BY doc_id::VARCHAR) FILTER (WHERE {_YES}), '') AS matched_docs, count(DISTINCT cluster_uid) FILTER (WHERE {_YES})::BIGINT AS n_clusters, round(max(score), 6)::DOUBLE AS best_score FROM pairs GROUP BY response_key""")
def response_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.response_matches(_pairs(spark, sf_dir)).withColumn("best_score", F.round("best_score", 6))


@plans.add(f"""WITH {_PAIRS} SELECT doc_id, bool_or({_YES}) AS has_match, coalesce(string_agg(DISTINCT response_key::VARCHAR, ';' ORDER BY response_key::VARCHAR) FILTER (WHERE {_YES}), '') AS responses,
count(*) FILTER (WHERE {_YES})::BIGINT AS n_matched, round(max(score), 6)::DOUBLE AS best_score FROM pairs GROUP BY doc_id""")
def comment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.comment_labels(_pairs(spark, sf_dir)).withColumn("best_score", F.round("best_score", 6))


@plans.add(f"""WITH {_PAIRS} SELECT cluster_uid, count(DISTINCT doc_id)::BIGINT AS n_docs, bool_or({_YES}) AS has_match, count(*) FILTER (WHERE {_YES})::BIGINT AS n_rows_matched,
count(DISTINCT response_key) FILTER (WHERE {_YES})::BIGINT AS n_responses_matched, round(max(score), 6)::DOUBLE AS best_score FROM pairs GROUP BY cluster_uid""")
def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cluster_labels(_pairs(spark, sf_dir)).withColumn("best_score", F.round("best_score", 6))


@plans.add("""
WITH s AS (SELECT event_id, value / (SELECT max(value) + 1 FROM events) AS score, md5('7:' || event_id) AS draw FROM events),
b AS (SELECT *, least(floor(score * 10), 9)::INT AS bin FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY draw, event_id) AS rn FROM b)
SELECT event_id, round(score, 6)::DOUBLE AS score FROM r WHERE rn <= 200 ORDER BY CASE WHEN rn <= 20 THEN 0 ELSE 1 END, draw, event_id LIMIT 200""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "value")
    most = rows.agg((F.max("value") + 1).alias("most"))
    scored = rows.join(F.broadcast(most), how="cross").select("event_id", (F.col("value") / F.col("most")).alias("score"))
    return M.stratified_sample(scored, "score", "event_id", 200, seed="7").withColumn("score", F.round("score", 6))


@plans.add("""
WITH x AS (SELECT doc_id, source, lang, ('0x' || substr(md5('3:' || source), 1, 8))::BIGINT / 4294967296.0 AS g, ('0x' || substr(md5('3:' || lang || ':' || doc_id), 1, 8))::BIGINT / 4294967296.0 AS r, ('0x' || substr(md5('model:' || doc_id), 1, 8))::BIGINT % 3 AS m FROM documents)
SELECT doc_id, CASE WHEN g < 0.1 THEN 'test' WHEN g < 0.25 THEN 'validation' ELSE 'train' END AS split, CASE WHEN r < 0.2 THEN 'test' ELSE 'train' END AS row_split, CASE m WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS model FROM x""")
def docket_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    grouped = M.group_split(rows, "source", seed="3")
    both = M.row_split(grouped.withColumnRenamed("split", "own"), "lang", "doc_id", seed="3").withColumnRenamed("split", "row_split").withColumnRenamed("own", "split")
    return M.assign_model(both, "doc_id", ["a", "b", "c"]).select("doc_id", "split", "row_split", "model")


@plans.add("SELECT doc_id FROM documents ORDER BY md5('5:' || doc_id), doc_id LIMIT 50")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.hash_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50, "5")


@plans.add("""
WITH a AS (SELECT doc_id, 'old' AS origin, lang FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, 'new' AS origin, NULL AS lang FROM documents WHERE doc_id % 2 = 0)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)""")
def incremental_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    old = d.where("doc_id % 3 <> 0").select("doc_id", F.lit("old").alias("origin"), "lang")
    new = d.where("doc_id % 2 = 0").select("doc_id", F.lit("new").alias("origin"))
    return M.append_new(old, new, "doc_id", "origin")


@plans.add("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.resume(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


@plans.add("""
WITH u AS (SELECT doc_id, 'label' AS origin, 1 AS p, quality AS v FROM labels UNION ALL SELECT doc_id, 'guess', 2, 1 FROM documents)
SELECT doc_id, origin, v FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p, origin) AS rn FROM u) WHERE rn = 1""")
def priority_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "labels").select("doc_id", F.lit("label").alias("origin"), F.col("quality").alias("v"))
    b = table(spark, sf_dir, "documents").select("doc_id", F.lit("guess").alias("origin"), F.lit(1).alias("v"))
    return M.by_priority(a.unionByName(b), ["doc_id"], F.when(F.col("origin") == "label", 1).otherwise(2), ["origin"])


@plans.add("""
WITH c AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END AS label FROM labels), d AS (SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN 'yes' ELSE 'no' END AS label FROM documents)
SELECT count(*)::BIGINT AS n, round(avg((c.label = d.label)::INT), 6)::DOUBLE AS agreement, round(avg((c.label = 'yes')::INT), 6)::DOUBLE AS first_yes, round(avg((d.label = 'yes')::INT), 6)::DOUBLE AS second_yes FROM c JOIN d USING (doc_id)""")
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "yes").otherwise("no").alias("label"))
    b = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") % 2 == 0, "yes").otherwise("no").alias("label"))
    found = M.agreement(a, b, ["doc_id"], "label")
    return found.select("n", *[F.round(c, 6).alias(c) for c in ("agreement", "first_yes", "second_yes")])


@plans.add("""
WITH p AS (SELECT doc_id, n_chars, source FROM documents), t AS (SELECT source, 0.1 * (length(source) - 3) AS threshold FROM (SELECT DISTINCT source FROM documents) WHERE source <> 'src0')
SELECT doc_id, CASE WHEN n_chars % 100 / 100.0 >= coalesce(threshold, 0.5) THEN 'yes' ELSE 'no' END AS final_label, l.toxic AS cached FROM p LEFT JOIN t USING (source) LEFT JOIN labels l USING (doc_id)""")
def per_agency_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("n_chars") % 100 / 100.0).alias("s"))
    config = docs.select("source").distinct().where("source <> 'src0'").withColumn("threshold", 0.1 * (F.length("source") - 3))
    rated = M.labelled(M.per_agency(docs, config, "source", "threshold", 0.5), "s", F.col("threshold"))
    return M.cached_labels(rated, table(spark, sf_dir, "labels").withColumnRenamed("toxic", "label"), ["doc_id"]).select("doc_id", "final_label", "cached")


@plans.add("SELECT count(*) FILTER (WHERE toxic = 1)::BIGINT AS pos, count(*) FILTER (WHERE toxic <> 1)::BIGINT AS neg, round(count(*) FILTER (WHERE toxic <> 1) / count(*) FILTER (WHERE toxic = 1), 6)::DOUBLE AS weight FROM labels")
def class_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.class_weight(table(spark, sf_dir, "labels"), F.col("toxic") == 1).withColumn("weight", F.round("weight", 6))


_ROWS = """r AS (SELECT 'D' || l_suppkey % 60 AS docket_id, CASE WHEN l_linenumber = 1 THEN 'fr' || l_partkey % 400 ELSE 'nan' END AS fr, CASE WHEN l_linenumber = 2 THEN 'r' || l_partkey % 300 || '; r' || l_orderkey % 300 END AS rins, CASE WHEN l_linenumber = 3 THEN 'doc' || l_partkey % 100 END AS refers_to, l_linenumber FROM lineitem),
cd AS (SELECT DISTINCT docket_id FROM r WHERE right(docket_id, 1) IN ('1', '2', '3')), od AS (SELECT DISTINCT docket_id FROM r EXCEPT SELECT docket_id FROM cd),
fr AS (SELECT DISTINCT docket_id, fr AS v FROM r WHERE fr <> 'nan'), rn AS (SELECT DISTINCT docket_id, unnest(list_filter(regexp_split_to_array(rins, '[,;\\s]+'), lambda x: x <> '')) AS v FROM r WHERE rins IS NOT NULL),
dd AS (SELECT 'doc' || n AS document_id, 'D' || n % 60 AS docket_id FROM range(100) t(n)),
l1 AS (SELECT a.docket_id AS o, b.docket_id AS c, 'fr_number' AS method, min(a.v) AS evidence FROM fr a JOIN fr b ON a.v = b.v WHERE a.docket_id IN (FROM od) AND b.docket_id IN (FROM cd) GROUP BY 1, 2),
l2 AS (SELECT a.docket_id AS o, b.docket_id AS c, 'rin' AS method, min(a.v) AS evidence FROM rn a JOIN rn b ON a.v = b.v WHERE a.docket_id IN (FROM od) AND b.docket_id IN (FROM cd) GROUP BY 1, 2),
l3 AS (SELECT r.docket_id AS o, dd.docket_id AS c, 'comment_on_doc' AS method, min(refers_to) AS evidence FROM r JOIN dd ON dd.document_id = refers_to WHERE r.docket_id IN (FROM od) AND dd.docket_id IN (FROM cd) GROUP BY 1, 2),
every AS (SELECT *, 0 AS p FROM l1 UNION ALL SELECT *, 1 FROM l2 UNION ALL SELECT *, 2 FROM l3)"""


def _links(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    t = table(spark, sf_dir, "lineitem")
    n, no = lambda c, k: (F.col(c) % k).cast("string"), F.col("l_linenumber")
    rows = t.select(
        F.concat(F.lit("D"), n("l_suppkey", 60)).alias("docket_id"), F.when(no == 1, F.concat(F.lit("fr"), n("l_partkey", 400))).otherwise("nan").alias("fr"),
        F.when(no == 2, F.concat(F.lit("r"), n("l_partkey", 300), F.lit("; r"), n("l_orderkey", 300))).alias("rins"), F.when(no == 3, F.concat(F.lit("doc"), n("l_partkey", 100))).alias("refers_to"),
    )
    commented = rows.where(F.right("docket_id", F.lit(1)).isin("1", "2", "3")).select("docket_id").distinct()
    lone = C.orphans(rows, commented)
    docs = spark.range(100).select(F.concat(F.lit("doc"), F.col("id").cast("string")).alias("document_id"), F.concat(F.lit("D"), (F.col("id") % 60).cast("string")).alias("docket_id"))
    return [
        C.linked_by(rows, F.filter(F.array("fr"), lambda x: x != "nan"), lone, commented, "fr_number"),
        C.linked_by(rows, C.identifiers(F.col("rins")), lone, commented, "rin"),
        C.linked_by_reference(rows, docs, lone, commented),
    ]


@plans.add(f"WITH {_ROWS} SELECT o AS orphan_docket, c AS comment_docket, method, evidence FROM every")
def crosswalk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = _links(spark, sf_dir)
    return a.unionByName(b).unionByName(c)


@plans.add(f"WITH {_ROWS} SELECT o AS orphan_docket, c AS comment_docket, method, evidence FROM every QUALIFY row_number() OVER (PARTITION BY o, c ORDER BY p, evidence) = 1")
def crosswalk_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.best_links(*_links(spark, sf_dir))


_TITLES = r"""
tt AS (SELECT DISTINCT p_brand AS block, 'D' || p_partkey % 60 AS docket, p_name || ' ' || p_type AS text FROM part),
tn AS (SELECT row_number() OVER () AS node, block, docket, docket IN (FROM od) AS lone, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 2) AS ws FROM tt WHERE docket IN (FROM od) OR docket IN (FROM cd)),
tf AS (SELECT node, block, term, count(*) AS tf FROM (SELECT node, block, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM tn) GROUP BY ALL),
df AS (SELECT block, term, count(*) AS df FROM tf GROUP BY ALL), nn AS (SELECT block, count(*) AS n FROM tn GROUP BY block),
tw AS (SELECT node, block, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (block, term) JOIN nn USING (block)),
tu AS (SELECT node, block, term, w / sqrt(sum(w * w) OVER (PARTITION BY node)) AS w FROM tw),
ts AS (SELECT a.node, b.node AS other, sum(x.w * y.w) AS score FROM tn a JOIN tu x ON x.node = a.node JOIN tu y ON y.block = x.block AND y.term = x.term JOIN tn b ON b.node = y.node WHERE a.lone AND NOT b.lone GROUP BY ALL),
l4 AS (SELECT a.docket AS o, b.docket AS c, 'title_similarity' AS method, round(score, 6)::VARCHAR AS evidence FROM ts JOIN tn a ON a.node = ts.node JOIN tn b ON b.node = other WHERE score >= 0.6
  QUALIFY row_number() OVER (PARTITION BY a.block, a.docket ORDER BY round(score, 9) DESC, b.docket) = 1)"""


@plans.add(f"WITH {_ROWS}, {_TITLES}, four AS (SELECT * FROM every UNION ALL SELECT *, 3 FROM l4) SELECT o AS orphan_docket, c AS comment_docket, method, evidence FROM four QUALIFY row_number() OVER (PARTITION BY o, c ORDER BY p, evidence) = 1")
def crosswalk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by all four methods: the three by keys, and similar titles within an agency."""
    commented = F.right("id", F.lit(1)).isin("1", "2", "3")
    titles = table(spark, sf_dir, "part").select(F.col("p_brand").alias("block"), F.concat(F.lit("D"), (F.col("p_partkey") % 60).cast("string")).alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text")).distinct()
    known = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("D"), (F.col("l_suppkey") % 60).cast("string")).alias("id")).distinct()
    titles = titles.join(known, "id", "left_semi")
    return C.best_links(*_links(spark, sf_dir), C.linked_by_title(titles.where(~commented), titles.where(commented)))


_NEAR = "near AS (SELECT DISTINCT l_orderkey AS target, l_partkey AS duplicate FROM lineitem WHERE l_orderkey <> l_partkey), cited AS (SELECT DISTINCT o_custkey AS id FROM orders)"


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    near = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("target"), F.col("l_partkey").alias("duplicate")).where("target <> duplicate")
    near = cut(V.distinct_rows(near), "near")
    cited = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct()
    return cited, near


@plans.add(f"""WITH {_NEAR}, back AS (SELECT c.id AS via, n.target AS id FROM cited c JOIN near n ON n.duplicate = c.id)
SELECT id AS via, id FROM cited UNION SELECT c.id, n.duplicate FROM cited c JOIN near n ON n.target = c.id UNION SELECT via, id FROM back UNION SELECT b.via, n.duplicate FROM back b JOIN near n ON n.target = b.id""")
def neardup_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.expand_one_hop(*_near(spark, sf_dir))


_CLASSES = f"{_NEAR}, classes AS (SELECT target AS id, target AS class FROM near UNION SELECT duplicate, target FROM near)"


@plans.add(f"WITH {_CLASSES} SELECT class, count(*)::BIGINT AS members, count(c.id)::BIGINT AS cited FROM classes m LEFT JOIN cited c USING (id) GROUP BY class HAVING count(c.id) > 0")
def neardup_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicates with cited members, in place of pairs."""
    return V.cited_classes(*_near(spark, sf_dir))


# The SQL goes through the pairs.
@plans.add(f"""WITH {_NEAR}, matched AS (SELECT doc_id AS id FROM labels WHERE toxic = 1), back AS (SELECT c.id AS via, n.target AS id FROM cited c JOIN near n ON n.duplicate = c.id),
pairs AS (SELECT id AS via, id FROM cited UNION SELECT c.id, n.duplicate FROM cited c JOIN near n ON n.target = c.id UNION SELECT via, id FROM back UNION SELECT b.via, n.duplicate FROM back b JOIN near n ON n.target = b.id)
SELECT via AS id, bool_or(id = via AND id IN (FROM matched)) AS direct, bool_or(id IN (FROM matched)) AS expanded FROM pairs GROUP BY via""")
def neardup_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which cited ids are matched themselves or through near-duplicates."""
    matched = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return V.found_by_class(*_near(spark, sf_dir), matched)


_STATE = f"""{_NEAR}, members AS (SELECT doc_id AS id, lang || n_chars % 20 AS cluster FROM documents), matched AS (SELECT doc_id AS id FROM labels WHERE toxic = 1),
st AS (SELECT m.id, cluster, t.id IS NOT NULL AS direct FROM members m LEFT JOIN matched t USING (id)), per AS (SELECT cluster, bool_or(direct) AS by_cluster FROM st GROUP BY cluster),
rec AS (SELECT c.id, coalesce(direct, false) AS direct, coalesce(by_cluster, false) AS by_cluster, cluster IS NOT NULL AS staged FROM cited c LEFT JOIN st USING (id) LEFT JOIN per USING (cluster))"""


def _recovered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    members = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat("lang", (F.col("n_chars") % 20).cast("string")).alias("cluster"))
    matched = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return V.recovered_by_cluster(_near(spark, sf_dir)[0], members, matched), members


@plans.add(f"WITH {_STATE} SELECT id, direct, by_cluster FROM rec")
def cluster_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recovered(spark, sf_dir)[0]


@plans.add(f"""WITH {_STATE} SELECT count(*)::BIGINT AS cited, count(*) FILTER (WHERE staged)::BIGINT AS staged, count(*) FILTER (WHERE direct)::BIGINT AS found, count(*) FILTER (WHERE direct OR by_cluster)::BIGINT AS found_expanded,
round(count(*) FILTER (WHERE direct) / count(*), 6)::DOUBLE AS recall, round(count(*) FILTER (WHERE direct) / count(*) FILTER (WHERE staged), 6)::DOUBLE AS recall_staged, round(count(*) FILTER (WHERE direct OR by_cluster) / count(*), 6)::DOUBLE AS recall_expanded FROM rec""")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, members = _recovered(spark, sf_dir)
    met = found.join(members.select("id", F.lit(True).alias("staged")), "id", "left").withColumn("staged", F.coalesce("staged", F.lit(False)))
    out = V.recall_summary(met, F.col("direct"), F.col("by_cluster"), F.col("staged"))
    return out.select("cited", "staged", "found", "found_expanded", *[F.round(c, 6).alias(c) for c in ("recall", "recall_staged", "recall_expanded")])


@plans.add(f"""WITH {_STATE}, m AS (SELECT CASE WHEN NOT staged THEN 'not_in_mapper' WHEN id % 2 = 1 AND by_cluster THEN 'recoverable' WHEN id % 2 = 1 THEN 'rep_unmatched' WHEN id % 3 = 0 THEN 'retrieval_gap' WHEN id % 5 = 0 THEN 'not_scored' ELSE 'threshold' END AS reason FROM rec WHERE NOT direct)
SELECT reason, count(*)::BIGINT AS n FROM m GROUP BY reason""")
def error_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, members = _recovered(spark, sf_dir)
    met = found.where("not direct").join(members.select("id", F.lit(True).alias("staged")), "id", "left")
    reason = V.miss_reason(F.coalesce("staged", F.lit(False)), F.col("id") % 2 == 0, F.col("by_cluster"), F.col("id") % 3 != 0, F.col("id") % 5 != 0)
    return stats.volume(met.select(reason.alias("reason")), "reason")


# People made up from both tables: a nickname or first name, a last name, and the nation as the state.
# Customers whose key is divisible by 100 are the query set; all suppliers of their nation are compared.
_SHORT, _LONG = list(N.NICKNAMES), sorted(set(N.NICKNAMES.values()))
_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_NAMES = f"""nick AS (SELECT unnest({_LIST(N.NICKNAMES)}) AS short, unnest({_LIST(N.NICKNAMES.values())}) AS long),
c AS (SELECT c_custkey AS a, ({_LIST(_SHORT)})[c_custkey // 100 % {len(_SHORT)} + 1] AS fa, 'mac' || ({_LIST(_LONG)})[c_custkey // 100 % {len(_LONG)} + 1] AS la, c_nationkey AS na, c_nationkey % 5 AS sa FROM customer WHERE c_custkey % 100 = 0),
s AS (SELECT s_suppkey AS b, ({_LIST(_LONG)})[s_suppkey % {len(_LONG)} + 1] AS fb, 'mac' || ({_LIST(_LONG)})[s_suppkey * 7 % {len(_LONG)} + 1] AS lb, s_nationkey AS nb, s_nationkey % 3 AS sb FROM supplier),
n AS (SELECT a, b, fa AS ra, fb AS rb, coalesce(x.long, fa) AS fa, la, sa, coalesce(y.long, fb) AS fb, lb, sb FROM c JOIN s ON na = nb LEFT JOIN nick x ON x.short = fa LEFT JOIN nick y ON y.short = fb)"""


def _people(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The query set (a, fa, la, nation, sa) and the others (b, fb, lb, nation, sb): keys, first names, last names, nations and states."""
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))
    c = table(spark, sf_dir, "customer").where("c_custkey % 100 = 0").withColumn("i", F.floor(F.col("c_custkey") / 100))
    c = c.select(F.col("c_custkey").alias("a"), pick(_SHORT, F.col("i")).alias("fa"), F.concat(F.lit("mac"), pick(_LONG, F.col("i"))).alias("la"), F.col("c_nationkey").alias("nation"), (F.col("c_nationkey") % 5).cast("string").alias("sa"))
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k.alias("b"), pick(_LONG, k).alias("fb"), F.concat(F.lit("mac"), pick(_LONG, k * 7)).alias("lb"), F.col("s_nationkey").alias("nation"), (F.col("s_nationkey") % 3).cast("string").alias("sb"))
    return c, s


@plans.add(f"""WITH {_NAMES}, j AS (SELECT a, b, greatest(jaro_winkler_similarity(ra, rb), jaro_winkler_similarity(fa, fb)) AS first, jaro_winkler_similarity(la, lb) AS last, (sa = sb AND sa <> 0)::INT AS state FROM n)
SELECT a, b, round(first, 6)::DOUBLE AS first, round(last, 6)::DOUBLE AS last, round(0.35 * first + 0.40 * last + 0.25 * state, 6)::DOUBLE AS score FROM j""")
def jw_field_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First names as written or with nicknames written out, last names and states (0: none) of a query set of people, against all others of the nation."""
    c, s = _people(spark, sf_dir)
    met = M.query_pairs(c, s, "nation", "a")
    state = lambda c: F.when(F.col(c) != "0", F.col(c)).otherwise("")
    rated = met.select("a", "b", N.first_similarity(F.col("fa"), F.col("fb")).alias("first"), N.similarity(F.col("la"), F.col("lb")).alias("last"), N.state_match(state("sa"), state("sb")).alias("state"))
    return rated.select("a", "b", F.round("first", 6).alias("first"), F.round("last", 6).alias("last"), F.round(N.field_score(F.col("first"), F.col("last"), F.col("state")), 6).alias("score"))


@plans.add(f"WITH {_NAMES} SELECT a, b, CASE WHEN fa = fb AND la = lb AND sa = sb THEN 5 WHEN fa = fb AND la = lb THEN 4 WHEN la = lb THEN 1 ELSE 0 END AS tier FROM n")
def rule_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of names that are first written in two orders, with accents and capitals, and then parsed."""
    c, s = _people(spark, sf_dir)
    x = N.surname_last(N.plain_name(F.concat_ws("  ", F.initcap("fa"), F.replace(F.initcap("la"), F.lit("Mac"), F.lit("Mác")))))
    y = N.surname_first(F.concat(F.upper("lb"), F.lit(", "), F.initcap("fb"), F.lit(" Q.")))
    own = c.select("nation", "a", "sa", x.alias("x")).select("nation", "a", "sa", "x.*").withColumn("full", N.full_first(F.col("first")))
    other = s.select("nation", "b", "sb", y.alias("y")).select("nation", "b", "sb", N.plain_name(F.col("y.first")).alias("first_b"), N.plain_name(F.col("y.last")).alias("last_b")).withColumn("full_b", N.full_first(F.col("first_b")))
    met = M.query_pairs(own, other, "nation", "a")
    return met.select("a", "b", N.rule_tier(*map(F.col, ("first", "last", "sa", "first_b", "last_b", "sb", "full", "full_b"))).alias("tier"))


@plans.add("""
WITH s AS (SELECT l_orderkey AS k, l_linenumber * 3 AS a, l_linenumber * 3 + 5 + l_quantity::INT % 4 AS b, l_linenumber % 3 AS level  FROM lineitem),
p AS (SELECT k, x AS pos, max(level) AS level FROM (SELECT k, level, unnest(range(a, b)) AS x FROM s) GROUP BY k, x),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY k, level ORDER BY pos) AS run FROM p)
SELECT k, min(pos)::INTEGER AS start, (max(pos) + 1)::INTEGER AS "end", level FROM g GROUP BY k, level, run""")
def span_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    spans = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (n * 3).alias("start"), (n * 3 + 5 + F.rint("l_quantity").cast("int") % 4).alias("end"), (n % 3).alias("level"))
    return sinks.covered_spans(spans, "k")
