"""Choosing rows and columns, negatives, crosswalks of rules, silver labels, over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.functions import text as X
from civicflow.operators import crosswalk as C, scoring as S, selection as L
from civicflow.plans import Plans, table

plans = Plans()


@plans.add("""
WITH e AS (SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'furniture'), s AS (SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'furn' OR (upper(c_mktsegment) LIKE 'FURN%' AND NOT EXISTS (SELECT 1 FROM customer WHERE lower(c_mktsegment) = 'furn')))
SELECT c_custkey AS custkey, 'equal' AS way FROM e UNION ALL SELECT c_custkey, 'prefix' FROM s""")
def equal_or_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a segment by its name, and by a prefix where no name is equal."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), "c_mktsegment")
    one = L.equal_or_prefixed(c, "c_mktsegment", "c_mktsegment", "Furniture").select("custkey", F.lit("equal").alias("way"))
    return one.unionByName(L.equal_or_prefixed(c, "c_mktsegment", "c_mktsegment", "furn").select("custkey", F.lit("prefix").alias("way")))


@plans.add("""
WITH r AS (SELECT l_orderkey AS docket, CASE WHEN l_linenumber = 2 THEN 'x-frdoc-' ELSE 'doc-' END || l_partkey AS id FROM lineitem), k AS (SELECT * FROM r WHERE NOT contains(upper(id), 'FRDOC'))
SELECT docket, id FROM k WHERE docket IN (SELECT docket FROM k GROUP BY docket HAVING count(*) <= 3)""")
def notice_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that aren't register notices, of dockets with three of them at most."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("docket"), F.concat(F.when(F.col("l_linenumber") == 2, "x-frdoc-").otherwise("doc-"), F.col("l_partkey").cast("string")).alias("id"))
    return L.without_notices(rows, "id", "docket", 3)


@plans.add("""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'nan' WHEN doc_id % 3 = 1 THEN source END AS content, lang AS fallback, source FROM documents)
SELECT doc_id, CASE WHEN content IS NULL OR content = 'nan' THEN fallback ELSE content END AS body, CASE WHEN content IS NULL OR content = 'nan' THEN '' ELSE content || chr(10) || chr(10) END || 'x' AS inline_text, source || '_y' AS agency,
  'a__' || doc_id AS before_last, '7' AS last, '7' AS third, doc_id AS number FROM d""")
def candidate_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidate column with a value, inline comments, the agency, and the parts of ids."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "nan").when(F.col("doc_id") % 3 == 1, F.col("source")).alias("Content"), F.col("lang").alias("fallback"), "source")
    own = d.select("doc_id", L.first_present(d, ["text", "Content", "fallback"]).alias("body"), "source", "Content")
    named = own.select("doc_id", "body", F.col("Content").alias("Comment 1"), F.lit(" x ").alias("comment_2"), F.lit("no").alias("Comment On Document ID"), F.lit(None).cast("string").alias("_agency"), F.concat("source", F.lit("_y")).alias("agency_id"))
    parts = L.id_parts(F.concat(F.lit("a__"), F.col("doc_id").cast("string"), F.lit("__7")))
    found = named.select("doc_id", "body", L.inline_comments(named).alias("inline_text"), L.agency_of(named).alias("agency"), parts.alias("p"), L.id_parts(F.concat(F.col("doc_id").cast("string"), F.lit("_z"))).alias("q"))
    return found.select("doc_id", "body", "inline_text", "agency", "p.before_last", "p.last", "p.third", "q.number")


@plans.add("""
WITH p AS (SELECT l_orderkey AS k, l_partkey AS id, l_discount AS s FROM lineitem), b AS (SELECT k, arg_max(id, (s, -id)) AS id, max(s) AS s FROM p GROUP BY k)
SELECT o_orderkey AS k, b.id AS id, b.s::DOUBLE AS s FROM orders LEFT JOIN b ON k = o_orderkey""")
def best_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with its best line, or none."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("id"), F.col("l_discount").alias("s"))
    return L.best_pair(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), pairs, "k", "s", "id")


@plans.add("""
WITH k AS (SELECT c_custkey AS docket_id FROM customer), d AS (SELECT o_custkey AS docket_id, o_orderkey AS doc_id FROM orders), l AS (SELECT c_custkey AS docket_id, c_custkey // 2 AS linked FROM customer)
SELECT k.docket_id, d.doc_id, k.docket_id AS via FROM k JOIN d USING (docket_id) UNION ALL
SELECT k.docket_id, d.doc_id, l.linked FROM k JOIN l USING (docket_id) JOIN d ON d.docket_id = l.linked WHERE k.docket_id NOT IN (SELECT docket_id FROM d)""")
def linked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A docket's documents, or those of the docket that it is linked with."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("docket_id"))
    docs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("docket_id"), F.col("o_orderkey").alias("doc_id"))
    return L.or_linked(keys, docs, keys.select("docket_id", F.floor(F.col("docket_id") / 2).alias("linked")))


@plans.add("""
SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 4 = 0 THEN 'own' END, s.note) AS note, s.text AS first_text FROM documents d LEFT JOIN
  (SELECT conv_id, arg_min(role, turn) AS note, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id) s ON s.conv_id = d.doc_id""")
def source_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents filled up from the first row of their key in a source table."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "own").alias("note"))
    source = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("note"), F.col("text").alias("first_text"), "turn")
    return L.with_source_row(rows, source, "doc_id", "turn").drop("turn")


@plans.add("""
WITH m AS (SELECT doc_id, map_from_entries([('a', quality::DOUBLE), ('b', toxic::DOUBLE), ('c', 1.0::DOUBLE * (doc_id % 2))]) AS w FROM labels)
SELECT doc_id, (SELECT k FROM (SELECT unnest(map_keys(w)) AS k, unnest(map_values(w)) AS v) ORDER BY v DESC, k LIMIT 1) AS persona, array_to_string(list_sort(list_distinct(map_values(w))), ',') AS kinds, 'individual' AS nobody FROM m""")
def map_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of a map's largest value, its distinct values, and the usual key of an empty one."""
    rows = table(spark, sf_dir, "labels").select("doc_id", F.create_map(F.lit("a"), F.col("quality").cast("double"), F.lit("b"), F.col("toxic").cast("double"), F.lit("c"), (F.col("doc_id") % 2).cast("double")).alias("w"))
    none = F.map_filter("w", lambda k, v: F.lit(False))
    return rows.select("doc_id", L.top_key(F.col("w")).alias("persona"), F.array_join(F.transform(L.distinct_values(F.col("w")), lambda v: v.cast("string")), ",").alias("kinds"), L.top_key(none).alias("nobody"))


@plans.add("""
WITH p AS (SELECT o_orderkey AS docket, l_partkey AS item, CASE l_linenumber % 3 WHEN 0 THEN 'claim' WHEN 1 THEN 'framing' ELSE 'structure' END AS dim, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS stakeholder, CASE WHEN l_discount > 0.05 THEN 'same' ELSE 'related' END AS label FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT coalesce(stakeholder, 'vanilla') AS stakeholder, dim, count(*) FILTER (WHERE label = 'same' AND stakeholder IS NOT NULL)::BIGINT AS matches, count(*)::BIGINT AS total FROM p GROUP BY 1, 2""")
def steerable_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    dim = F.element_at(F.array(*map(F.lit, ["claim", "framing", "structure"])), F.col("l_linenumber") % 3 + 1)
    rows = met.select(dim.alias("dim"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("stakeholder"), F.when(F.col("l_discount") > 0.05, "same").otherwise("related").alias("label"))
    return L.steerable(rows, "stakeholder", "dim", "label")


@plans.add("""
SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels) GROUP BY conv_id""")
def uncached_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first text of each key that hasn't been worked on."""
    return L.uncached(table(spark, sf_dir, "conversations"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id")), "conv_id", "text", "turn")


@plans.add("""
SELECT source, arg_max(doc_id, (length(text), -doc_id)) AS doc_id, max(length(text))::INTEGER AS n FROM documents GROUP BY source HAVING max(length(text)) > 100""")
def longest_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.longest_text(table(spark, sf_dir, "documents"), "source", "text", "doc_id").select("source", "doc_id", F.length("text").alias("n"))


@plans.add(r"""
WITH t AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS tok FROM documents)
SELECT doc_id, md5(CASE WHEN len(tok) <= greatest(120 - doc_id % 200, 0) THEN text ELSE array_to_string(list_slice(tok, 1, greatest(120 - doc_id % 200, 0)), ' ') END) AS digest FROM t""")
def budget_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut to what a token budget leaves beside a fixed part."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(L.fitted(F.col("text"), F.col("doc_id") % 200, 120).cast("binary")).alias("digest"))


@plans.add("""
SELECT event_type, count(*)::BIGINT AS n FROM events WHERE ts::DATE BETWEEN (SELECT min(ts)::DATE FROM events) + 2 AND (SELECT min(ts)::DATE FROM events) + 5 GROUP BY 1""")
def inclusive_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of four whole days, the last one included."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first = e.agg(F.date_add(F.min("ts").cast("date"), 2).cast("string").alias("a"), F.date_add(F.min("ts").cast("date"), 5).cast("string").alias("b")).first()
    return e.where(L.inclusive(F.col("ts"), first["a"], first["b"])).groupBy("event_type").agg(F.count("*").alias("n"))


_RULES = """links AS (SELECT l_orderkey AS rule_docket, l_partkey AS proposal_docket, CASE l_linenumber % 3 WHEN 0 THEN 'fr_number' WHEN 1 THEN 'rin' ELSE 'ce' END AS method, l_suppkey::VARCHAR AS evidence FROM lineitem WHERE l_orderkey <> l_partkey)"""


@plans.add(f"""WITH {_RULES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY rule_docket ORDER BY CASE method WHEN 'fr_number' THEN 0 WHEN 'rin' THEN 1 ELSE 2 END, proposal_docket, evidence) AS rn FROM links)
SELECT rule_docket, proposal_docket, method, evidence, proposal_docket IN (SELECT o_custkey FROM orders) AS proposal_has_comments FROM ranked WHERE rn = 1""")
def rule_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One proposal for each rule docket by the most trusted method, and whether it has comments."""
    names = F.element_at(F.array(*map(F.lit, ["fr_number", "rin", "ce"])), F.col("l_linenumber") % 3 + 1)
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rule_docket"), F.col("l_partkey").alias("proposal_docket"), names.alias("method"), F.col("l_suppkey").cast("string").alias("evidence"))
    parts = [links.where(F.col("method") == m) for m in ("rin", "ce", "fr_number")]
    return C.proposals_of(*parts, comment_dockets=table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("docket_id")))


@plans.add("""
WITH r AS (SELECT s_nationkey AS docket_id, s_suppkey AS id FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY md5('0:' || s_suppkey), s_suppkey) <= 3),
p AS (SELECT c_nationkey AS docket_id, c_custkey AS id FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('0:' || c_custkey), c_custkey) <= 3),
m AS (SELECT docket_id, r.id AS rule_id, p.id AS proposal_id FROM r JOIN p USING (docket_id))
SELECT rule_id, proposal_id, docket_id FROM m QUALIFY row_number() OVER (PARTITION BY docket_id ORDER BY md5('0:' || rule_id || ':' || proposal_id), rule_id || ':' || proposal_id) <= 3""")
def rule_training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three pairs of rules and proposals of each docket."""
    rules = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("docket_id"))
    return C.training_pairs(rules, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("docket_id")))


@plans.add()
def rule_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard and easy negatives, as many as there are positives."""
    rules = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("rule_id"), F.col("s_nationkey").alias("docket_id"))
    positives = rule_training_pairs(spark, sf_dir)
    ranked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("proposal_id"), F.col("l_suppkey").alias("rule_id"))
    return L.negatives(positives, ranked, rules)


_STOP = ", ".join(f"'{w}'" for w in L.STOP_WORDS)


@plans.add(rf"""
WITH t AS (SELECT l.doc_id, l.quality AS label, CASE WHEN l.quality = 0 THEN 'hard_negative' ELSE 'positive' END AS source, d.text AS a, b.text AS b FROM labels l JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = l.doc_id % (SELECT count(*) FROM benchmark)),
w AS (SELECT doc_id, label, source, list_filter(list_distinct(regexp_extract_all(lower(substr(a, 1, 300)), '[\pL\pM\pN_]+')), lambda x: x NOT IN ({_STOP})) AS x, list_filter(list_distinct(regexp_extract_all(lower(substr(b, 1, 300)), '[\pL\pM\pN_]+')), lambda x: x NOT IN ({_STOP})) AS y FROM t),
o AS (SELECT *, CASE WHEN least(len(x), len(y)) = 0 THEN 0 ELSE len(list_intersect(x, y)) / least(len(x), len(y)) END AS o FROM w)
SELECT doc_id, CASE WHEN source = 'hard_negative' AND o >= 0.05 THEN 1 ELSE label END AS label, CASE WHEN source = 'hard_negative' AND o >= 0.05 THEN 'silver_positive' ELSE source END AS source FROM o""")
def silver_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives that share many words, asked about and made positive where the answer is yes. The offline backend says yes to all that it is asked."""
    n = table(spark, sf_dir, "benchmark").count()
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("a")), "doc_id").join(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("b")), F.col("doc_id") % n == F.col("item_id"))
    pairs = rows.select("doc_id", F.col("quality").alias("label"), F.when(F.col("quality") == 0, "hard_negative").otherwise("positive").alias("source"), L.rule_overlap(F.col("a"), F.col("b")).alias("overlap"))
    asked = pairs.where("source = 'hard_negative' and overlap >= 0.05").select("doc_id", F.lit("Are both about one rulemaking?").alias("prompt"))
    answers = S.zero_shot(asked, "prompt", ["yes", "no"], S.Always("yes")).select("doc_id", F.col("label").alias("answer"))
    return L.flipped(pairs.select("doc_id", "label", "source"), answers, "doc_id")


@plans.add("""
SELECT conv_id, string_agg(turn::VARCHAR || '/' || role, ',' ORDER BY turn) AS found, count(*)::INTEGER AS n, CASE WHEN conv_id % 2 = 0 THEN 'id' || conv_id ELSE 'folder' END AS document FROM conversations GROUP BY conv_id""")
def html_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated records read out of HTML, and a document's id out of its metadata."""
    cell = F.concat(F.lit('<tr id="r'), F.col("turn").cast("string"), F.lit('">\n<td>'), F.col("role"), F.lit("</td></tr>"))
    page = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", cell.alias("v")))), lambda x: x["v"]), "\n").alias("html"))
    got = X.records(F.col("html"), r'(?s)<tr id="r(\d+)">\s*<td>(.*?)</td>', 2)
    meta = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit('{"doc_id": " ", "DocumentID": "id'), F.col("conv_id").cast("string"), F.lit('"}'))).otherwise("no json")
    return page.select("conv_id", F.array_join(F.transform(got, lambda r: F.array_join(r, "/")), ",").alias("found"), F.size(got).alias("n"), L.document_id(meta, F.lit("folder")).alias("document"))
