"""Further joins, roll-ups and model-call plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicflow.functions import text as X
from civicflow.operators import matching as M, retrieval as R, scoring as S, stats
from civicflow.operators.passages import find_passages
from civicflow.plans import Plans, table
from civicflow.plans.retrieval import BM25_SQL as _BM25, bm25_ranked
from civicflow.session import spread
from civicflow.sources import connectors, geometry, sinks
from civicflow.storage import cut

plans = Plans()


@plans.add("""
WITH m AS (SELECT doc_id, lang || '::' || doc_id % 50 AS cluster_uid FROM documents WHERE doc_id % 7 <> 0)
SELECT coalesce(m.cluster_uid, d.doc_id::VARCHAR) AS cluster_uid, arg_max(d.doc_id, (length(d.text), -d.doc_id)) AS representative, count(*)::BIGINT AS n FROM documents d LEFT JOIN m USING (doc_id) GROUP BY 1""")
def claims_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts joined to the mapper; unmapped ones stand for themselves; the longest of each cluster."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    mapper = docs.where("doc_id % 7 <> 0").select("doc_id", F.concat_ws("::", "lang", (F.col("doc_id") % 50).cast("string")).alias("cluster_uid"))
    met = docs.join(mapper, "doc_id", "left").withColumn("cluster_uid", F.coalesce("cluster_uid", F.col("doc_id").cast("string")))
    best = F.max_by("doc_id", F.struct(F.length("text"), -F.col("doc_id"))).alias("representative")
    return met.groupBy("cluster_uid").agg(best, F.count("*").alias("n"))


@plans.add("""
WITH o AS (SELECT doc_id, 'o' || doc_id % 90 AS old_uid FROM documents), n AS (SELECT doc_id, 'n' || doc_id % 60 AS new_uid FROM documents), s AS (SELECT old_uid FROM o GROUP BY old_uid HAVING count(*) <= 12)
SELECT new_uid, min(old_uid) AS bridged_from FROM n JOIN o USING (doc_id) JOIN s USING (old_uid) GROUP BY new_uid""")
def mapper_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each new cluster, a small old one that shares a member."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    old = docs.withColumn("old_uid", F.concat(F.lit("o"), (F.col("doc_id") % 90).cast("string")))
    new = docs.withColumn("new_uid", F.concat(F.lit("n"), (F.col("doc_id") % 60).cast("string")))
    small = old.groupBy("old_uid").count().where("count <= 12").select("old_uid")
    return new.join(old.join(small, "old_uid", "left_semi"), "doc_id").groupBy("new_uid").agg(F.min("old_uid").alias("bridged_from"))


@plans.add("""
WITH p AS (SELECT c_nationkey AS docket, c_custkey AS response_id FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('r:' || c_custkey), c_custkey) <= 5),
q AS (SELECT s_nationkey AS docket, s_suppkey AS claim_id FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY md5('c:' || s_suppkey), s_suppkey) <= 3)
SELECT docket, response_id, claim_id FROM p JOIN q USING (docket)""")
def capped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a capped draw from both sides of each docket: the label set of a recall benchmark."""

    def drawn(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
        w = Window.partitionBy("docket").orderBy(M.hash_rank(F.col(key), seed), key)
        return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")

    left = drawn(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("docket"), F.col("c_custkey").alias("response_id")), "response_id", "r", 5)
    right = drawn(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("docket"), F.col("s_suppkey").alias("claim_id")), "claim_id", "c", 3)
    return left.join(right, "docket")


@plans.add("""
WITH u AS (SELECT l_orderkey AS docket, l_partkey AS unit_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS provision FROM lineitem)
SELECT docket, count(*)::BIGINT AS units, sum(provision * (unit_id % 10))::BIGINT AS weighted FROM u GROUP BY docket""")
def provision_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units numbered from 1 within their docket, by an ordered array, not a window."""
    units = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("docket")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("units"))
    flat = units.select("docket", F.posexplode("units").alias("no", "u"))
    return flat.groupBy("docket").agg(F.count("*").alias("units"), F.sum((F.col("no") + 1) * (F.col("u.l_partkey") % 10)).alias("weighted"))


@plans.add("""
SELECT lang AS docket, string_agg(DISTINCT lower(source), ',' ORDER BY lower(source)) AS items, count(*)::BIGINT AS n, count(DISTINCT doc_id % 3)::BIGINT AS kinds FROM documents GROUP BY lang""")
def docket_item_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.col("lang").alias("docket")).agg(F.array_join(F.array_sort(F.collect_set(F.lower("source"))), ",").alias("items"), F.count("*").alias("n"), F.countDistinct(F.col("doc_id") % 3).alias("kinds"))


@plans.add("""
SELECT source, sum(n_chars)::BIGINT AS total, count(*)::BIGINT AS n, round(avg((lang = 'en')::INT), 6)::DOUBLE AS share FROM documents GROUP BY source HAVING sum(n_chars) >= 50000 AND count(*) >= 5 AND avg((lang = 'en')::INT) >= 0.5""")
def having_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("total"), F.count("*").alias("n"), F.avg((F.col("lang") == "en").cast("int")).alias("share"))
    return per.where("total >= 50000 and n >= 5 and share >= 0.5").withColumn("share", F.round("share", 6))


@plans.add("""
WITH c AS (SELECT o_custkey AS docket, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey AS docket, least(coalesce(n, 25), 200)::BIGINT AS budget, greatest(1, round_even(least(coalesce(n, 25), 200) * 0.35, 0))::INTEGER AS persona FROM customer LEFT JOIN c ON docket = c_custkey""")
def claim_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civicflow.functions.numbers import budget, share_of_budget

    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("docket")).agg(F.count("*").alias("n"))
    met = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("docket")).join(counts, "docket", "left")
    own = met.select("docket", budget(F.col("n")).cast("long").alias("budget"))
    return own.withColumn("persona", share_of_budget(F.col("budget"), F.lit(0.35)))


_FRAMES = {"src0": "health", "src1": "health", "src2": "safety", "src3": "safety", "src4": "procedural"}


@plans.add("WITH m(k, v) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _FRAMES.items()) + ") SELECT doc_id, coalesce(v, source) AS frame, CASE WHEN v IN ('health', 'safety') THEN v ELSE 'other' END AS bucket FROM documents LEFT JOIN m ON source = k")
def enum_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases brought to one name by a literal map; other values stay, and go to ``other`` in the bucket."""
    alias = F.create_map(*[F.lit(x) for kv in _FRAMES.items() for x in kv])[F.col("source")]
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(alias, F.col("source")).alias("frame"), F.when(alias.isin("health", "safety"), alias).otherwise("other").alias("bucket"))


@plans.add("""
SELECT d.doc_id, substr(text, 1, 1500) || CASE WHEN length(text) > 1500 THEN '...' ELSE '' END AS example, l.toxic AS bucket FROM documents d JOIN labels l USING (doc_id) WHERE length(text) > 500 AND length(text) < 3000 AND d.doc_id NOT IN (SELECT item_id FROM benchmark)
QUALIFY row_number() OVER (PARTITION BY l.toxic ORDER BY d.doc_id) <= 2""")
def few_shot_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Example texts of fitting length that aren't benchmark items, two of each bucket."""
    t = F.col("text")
    pool = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id", "left_anti")
    fit = pool.where((F.length(t) > 500) & (F.length(t) < 3000)).join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("bucket")), "doc_id")
    short = F.concat(F.substring(t, 1, 1500), F.when(F.length(t) > 1500, "...").otherwise(""))
    first = fit.withColumn("rn", F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id"))).where("rn <= 2")
    return first.select("doc_id", short.alias("example"), "bucket")


# Benchmark passages are a stated query set; they meet all documents.
def _located(spark: SparkSession, sf_dir: str, least: float | None) -> DataFrame:
    return find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least)


@plans.add("""
WITH m AS (SELECT doc_id, item_id, position(b.text IN d.text) AS p, CASE WHEN length(b.text) >= 60 THEN position(substr(b.text, 1, 60) IN d.text) ELSE 0 END AS q, length(d.text) AS n, length(b.text) AS k FROM documents d, benchmark b)
SELECT doc_id, item_id, (CASE WHEN p > 0 THEN p ELSE q END - 1)::INTEGER AS start, least(n, CASE WHEN p > 0 THEN p ELSE q END - 1 + k)::INTEGER AS "end", CASE WHEN p > 0 THEN 'exact' ELSE 'prefix' END AS how FROM m WHERE p > 0 OR q > 0""")
def span_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where benchmark passages stand in documents, whole or from their first sixty characters on."""
    return _located(spark, sf_dir, None).drop("similarity")


@plans.add()
def span_reworded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where benchmark passages stand in documents, asked for without every sixth of their words."""
    words = F.split("text", " ")
    fewer = F.array_join(F.filter(words, lambda _, i: i % 6 != 5), " ")
    items = table(spark, sf_dir, "benchmark").select("item_id", fewer.alias("text"))
    return find_passages(table(spark, sf_dir, "documents"), items, 0.7).withColumn("similarity", F.round("similarity", 6))


@plans.add()
def span_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where benchmark passages stand in documents in changed wording, with at most three of ten words edited."""
    return _located(spark, sf_dir, 0.7).where("how = 'similar'").withColumn("similarity", F.round("similarity", 6))


@plans.add("""
WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS a FROM documents), q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS b FROM benchmark),
m AS (SELECT item_id, doc_id, len(list_intersect(a, b)) / least(len(a), len(b)) AS score FROM w, q WHERE len(a) > 0 AND len(b) > 0)
SELECT item_id, doc_id, round(score, 6)::DOUBLE AS score, (row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id))::INTEGER AS rank FROM m WHERE score > 0 QUALIFY rank <= 10""")
def word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents of greatest word overlap with each benchmark passage."""
    words = lambda: F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("words")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), words())
    found = R.overlap_search(queries, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), words()), "words", 10)
    return found.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@plans.add("""
WITH p AS (SELECT l_orderkey AS a, l_partkey AS b, l_discount AS s, l_returnflag = 'R' AS same FROM lineitem)
SELECT a, arg_max(b, (round(s, 9), -b)) AS b, max(s)::DOUBLE AS s FROM p WHERE NOT same GROUP BY a""")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_discount").alias("s"), (F.col("l_returnflag") == "R").alias("same"))
    return M.hard_negatives(rows, "a", "b", "s", F.col("same"))


@plans.add("""
SELECT 'usace_' || s_suppkey AS comment_id, 'usace' AS source, 'USACE' AS agency_id, s_nationkey::VARCHAR AS docket_id, s_name AS submitter_name FROM supplier""")
def connector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("docket"), F.col("s_name").alias("name"))
    found = sinks.padded(connectors.CONNECTORS["usace"](rows), connectors.COLUMNS)
    return found.select("comment_id", "source", "agency_id", "docket_id", "submitter_name")


@plans.add("""
SELECT o_custkey AS custkey, count(*) FILTER (WHERE o_totalprice > 150000)::BIGINT AS large, bool_or(o_orderpriority = '1-URGENT') AS urgent, (min_by(o_orderstatus, o_orderkey)) AS first_status FROM orders GROUP BY 1""")
def claim_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("custkey")).agg(F.count_if(F.col("o_totalprice") > 150000).alias("large"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.min_by("o_orderstatus", "o_orderkey").alias("first_status"))


@plans.add("""
SELECT count(*) FILTER (WHERE l.doc_id IS NOT NULL)::BIGINT AS labelled, count(*) FILTER (WHERE toxic = 1)::BIGINT AS yes, round(count(*) FILTER (WHERE toxic = 1) / count(*) FILTER (WHERE l.doc_id IS NOT NULL), 6)::DOUBLE AS rate FROM documents d LEFT JOIN labels l USING (doc_id)""")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n = met.agg(F.count("toxic").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("yes"))
    return n.withColumn("rate", F.round(F.col("yes") / F.col("labelled"), 6))


@plans.add("""
WITH d AS (SELECT doc_id, abs(n_chars % 1000 / 1000.0 - 0.5) AS gap FROM documents) SELECT doc_id, round(gap, 6)::DOUBLE AS gap FROM d ORDER BY gap, doc_id LIMIT 10""")
def near_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", F.abs(F.col("n_chars") % 1000 / 1000.0 - 0.5).alias("gap"))
    return own.orderBy("gap", "doc_id").limit(10).withColumn("gap", F.round("gap", 6))


@plans.add("""
WITH s AS (SELECT user_id, count(*) AS n, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS hits FROM events GROUP BY user_id)
SELECT n::BIGINT AS n, hits::BIGINT AS hits, bround_rate AS rate FROM (SELECT user_id, n, hits, round_even(hits / n, 4)::DOUBLE AS bround_rate FROM s)""")
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("hits"))
    return per.select("n", "hits", F.bround(F.col("hits") / F.col("n"), 4).alias("rate"))


@plans.add(f"""WITH {_BM25}, p AS (SELECT query_id, r.id, d.text AS a, b.text AS b FROM ranked r JOIN documents d ON d.doc_id = r.id JOIN benchmark b ON b.item_id = query_id WHERE rank <= 5),
w AS (SELECT id, b, list_distinct(regexp_extract_all(lower(a), '[\\pL\\pN_]+')) AS x, list_distinct(regexp_extract_all(lower(b), '[\\pL\\pN_]+')) AS y FROM p)
SELECT md5(id || '||' || substr(b, 1, 200)) AS pair, CASE WHEN id % 2 = 0 THEN -1.0 WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE round(len(list_intersect(x, y)) / least(len(x), len(y)), 6) END::DOUBLE AS score FROM w""")
def rerank_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25's first five documents of each passage, scored again; scores that are known (here of documents with even ids) are kept."""
    met = bm25_ranked(spark, sf_dir, 5).select(F.col("id").alias("doc_id"), F.col("query_id").alias("item_id"))
    pairs = met.join(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("comment")), "doc_id").join(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("response")), "item_id")
    known = pairs.where("doc_id % 2 = 0").select(X.pair_key(F.col("doc_id"), F.col("response")).alias("pair"), F.lit(-1.0).alias("score")).dropDuplicates(["pair"])
    return S.rescored(pairs, known, "comment", "response", "doc_id", S.WordScorer()).select(F.md5(F.col("pair").cast("binary")).alias("pair"), F.round("score", 6).alias("score"))


@plans.add()
def extract_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.claims(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", S.PatternExtractor(r"(?i)\b(the|de|la|die)\b"), S.PatternExtractor("."))
    return found.select("doc_id", "parse_ok", F.size("parsed").alias("n_claims"))


@plans.add()
def generate_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    dockets = table(spark, sf_dir, "benchmark").select("item_id", F.slice(F.split("text", r"(?<=\.)\s+"), 1, 5).alias("provisions"))
    asked = S.generated(dockets, "provisions", S.TemplateGenerator())
    return asked.select("item_id", F.inline(X.claim_tags(F.col("answer"), F.size("provisions"))))


@plans.add("SELECT bin, no::INTEGER AS no, (SELECT count(*) FROM lineitem WHERE l_quantity > lo AND l_quantity <= hi)::BIGINT AS n FROM (VALUES (0, '1-10', 0, 10), (1, '11-25', 10, 25), (2, '26-50', 25, 50), (3, 'more', 50, 1e9)) t(no, bin, lo, hi)")
def length_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", [0, 10, 25, 50, 1e9], ["1-10", "11-25", "26-50", "more"])


def _geojson(kind: str, *polygons: list[list[tuple]]):
    """A collection of one feature, written from columns; a point is given as a ring of its own."""
    ring = lambda points: F.concat(F.lit("["), F.concat_ws(",", *[F.concat(F.lit("["), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]")) for x, y in points]), F.lit("]"))
    whole = [F.concat(F.lit("["), F.concat_ws(",", *map(ring, rings)), F.lit("]")) for rings in polygons]
    text = {"Point": lambda: F.regexp_replace(whole[0], r"^\[\[|\]\]$", ""), "Polygon": lambda: whole[0], "MultiPolygon": lambda: F.concat(F.lit("["), F.concat_ws(",", *whole), F.lit("]"))}[kind]()
    key = F.concat(F.lit('{"features":[{"properties":{"key":"'), F.col("p_partkey").cast("string"), F.lit(f'"}},"geometry":{{"type":"{kind}","coordinates":'))
    return F.concat(key, text, F.lit("}}]}"))


@plans.add("""
WITH s AS (SELECT p_partkey, p_partkey % 3 AS k, (p_partkey * 7 % 340 - 170)::DOUBLE AS x, (p_partkey * 11 % 140 - 70)::DOUBLE AS y, (2 + p_partkey % 5)::DOUBLE AS w, (2 + p_partkey % 7)::DOUBLE AS h FROM part),
c AS (SELECT c_custkey * 37 % 360 - 180 + 0.237::DOUBLE AS px, c_custkey * 13 % 150 - 75 + 0.419::DOUBLE AS py, count(*) AS n FROM customer GROUP BY 1, 2),
m AS (SELECT p_partkey, sum(n)::BIGINT AS n FROM s JOIN c ON px > x AND py > y AND py < y + h AND CASE k
  WHEN 0 THEN px < x + w AND NOT (px > x + w / 4 AND px < x + w * 3 / 4 AND py > y + h / 4 AND py < y + h * 3 / 4)
  WHEN 1 THEN px < x + w * (1 - (py - y) / h) OR (px > x + w + 1 AND px < x + w + 1 + w * (1 - (py - y) / h))
  ELSE false END GROUP BY p_partkey)
SELECT p_partkey, CASE k WHEN 0 THEN 'Polygon' WHEN 1 THEN 'MultiPolygon' ELSE 'Point' END AS kind, round(CASE k WHEN 0 THEN w * h * 0.75 WHEN 1 THEN w * h ELSE 0 END, 6) AS area,
  round(CASE k WHEN 0 THEN x + w / 2 WHEN 1 THEN x + w / 3 + (w + 1) / 2 ELSE x END, 6) AS cx, round(CASE k WHEN 0 THEN y + h / 2 WHEN 1 THEN y + h / 3 ELSE y END, 6) AS cy,
  coalesce(n, 0)::BIGINT AS n_points FROM s LEFT JOIN m USING (p_partkey)""")
def shape_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes made from parts, as GeoJSON: a box with a hole, two triangles, or a point; their area, centroid and the customers within."""
    key = F.col("p_partkey")
    x, y = (key * 7 % 340 - 170).cast("double"), (key * 11 % 140 - 70).cast("double")
    w, h = (key % 5 + 2).cast("double"), (key % 7 + 2).cast("double")
    box = lambda a, b: [(x + w * a, y + h * a), (x + w * b, y + h * a), (x + w * b, y + h * b), (x + w * a, y + h * b), (x + w * a, y + h * a)]
    triangle = lambda d: [(x + d, y), (x + w + d, y), (x + d, y + h), (x + d, y)]
    json = F.when(key % 3 == 0, _geojson("Polygon", [box(0, 1), box(0.25, 0.75)])).when(key % 3 == 1, _geojson("MultiPolygon", [triangle(F.lit(0))], [triangle(w + 1)])).otherwise(_geojson("Point", [[(x, y)]]))
    features = geometry.shape_features(spread(table(spark, sf_dir, "part")).select(json.alias("json")))
    shapes = cut(features.select(F.col("properties")["key"].cast("long").alias("p_partkey"), "kind", "polygons", "vertices"), "shapes")
    customers = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 37 % 360 - 180 + F.lit(0.237)).alias("x"), (F.col("c_custkey") * 13 % 150 - 75 + F.lit(0.419)).alias("y"))
    inside = geometry.points_in_shapes(shapes.drop("kind"), customers.groupBy("x", "y").agg(F.count("*").alias("n")))
    counts = inside.groupBy(F.col("shape.p_partkey").alias("p_partkey")).agg(F.sum("point.n").alias("n"))
    rounded = [F.round(c, 6).alias(c) for c in ("area", "cx", "cy")]
    return geometry.measured(shapes).join(counts.hint("merge"), "p_partkey", "left").select("p_partkey", "kind", *rounded, F.coalesce("n", F.lit(0)).cast("long").alias("n_points"))
