"""Metrics, statistics and roll-ups over labels, documents, orders, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.functions import numbers as N
from civicflow.operators import metrics as M, stats
from civicflow.plans import Plans, table

plans = Plans()

_PAIRS = """pairs AS (SELECT o_orderpriority AS config, o_custkey AS docket, o_orderkey AS item,
  CASE WHEN l_linenumber % 4 = 0 THEN 'same' WHEN l_linenumber % 4 = 1 THEN 'related' WHEN l_linenumber % 4 = 2 THEN 'opposing' ELSE 'different' END AS label
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    names = F.array(*map(F.lit, ["same", "related", "opposing", "different"]))
    return met.select(F.col("o_orderpriority").alias("config"), F.col("o_custkey").alias("docket"), F.col("o_orderkey").alias("item"), F.element_at(names, F.col("l_linenumber") % 4 + 1).alias("label"))


@plans.add(f"""WITH {_PAIRS}, i AS (SELECT config, docket, item, bool_or(label = 'same') AS hit FROM pairs GROUP BY ALL),
g AS (SELECT config, docket, count(*) AS n, count(*) FILTER (WHERE hit) AS m FROM i GROUP BY ALL)
SELECT config, sum(n)::BIGINT AS items, sum(m)::BIGINT AS matched, round(avg(m / n), 6)::DOUBLE AS per_group, count(*)::BIGINT AS groups, round(sum(m) / sum(n), 6)::DOUBLE AS overall, round(sum(m) / sum(n), 6)::DOUBLE AS parity FROM g GROUP BY config""")
def overton_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.overton(_pairs(spark, sf_dir), ["config"], "docket", "item", "label")
    return found.select("config", "items", "matched", F.round("per_group", 6).alias("per_group"), "groups", F.round("overall", 6).alias("overall"), F.round("parity", 6).alias("parity"))


@plans.add(f"""WITH {_PAIRS} SELECT label, count(*)::BIGINT AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS pct FROM pairs GROUP BY label""")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distribution(_pairs(spark, sf_dir), "label").withColumn("pct", F.round("pct", 6))


@plans.add(f"""WITH {_PAIRS}, b AS (SELECT item, bool_or(label = 'same') AS s, bool_or(label IN ('same', 'related')) AS l FROM pairs GROUP BY item)
SELECT count(*)::BIGINT AS items, round(avg(coalesce(s, false)::INT), 6)::DOUBLE AS strict, round(avg(coalesce(l, false)::INT), 6)::DOUBLE AS loose FROM (SELECT DISTINCT o_orderkey AS item FROM orders) o LEFT JOIN b USING (item)""")
def strict_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"))
    return M.match_rates(items, _pairs(spark, sf_dir), "item", "label").select("items", F.round("strict", 6).alias("strict"), F.round("loose", 6).alias("loose"))


@plans.add("""
WITH l AS (SELECT DISTINCT l_shipdate::DATE AS day, l_partkey AS unit FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT DISTINCT l_shipdate::DATE AS day, l_partkey AS unit FROM lineitem WHERE l_returnflag <> 'A'),
c AS (SELECT coalesce(l.day, r.day) AS day, count(*) FILTER (WHERE l.day IS NOT NULL AND r.day IS NOT NULL) AS b, count(l.day) AS nl, count(r.day) AS nr FROM l FULL JOIN r ON l.day = r.day AND l.unit = r.unit GROUP BY 1),
s AS (SELECT day, b, nl, nr, CASE WHEN nl = 0 THEN 0 ELSE b / nl END AS p, CASE WHEN nr = 0 THEN 0 ELSE b / nr END AS c FROM c)
SELECT strftime(day, '%Y-%m-%d') AS day, b::BIGINT AS both, nl::BIGINT AS n_left, nr::BIGINT AS n_right, round(p, 6)::DOUBLE AS precision, round(c, 6)::DOUBLE AS recall, round(CASE WHEN p + c = 0 THEN 0 ELSE 2 * p * c / (p + c) END, 6)::DOUBLE AS f1 FROM s""")
def axis_a_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), F.col("l_partkey").alias("unit"), (F.col("l_returnflag") == "A").alias("a"))
    found = M.set_scores(rows.where("a"), rows.where("not a"), "day", "unit")
    return found.select("day", "both", "n_left", "n_right", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@plans.add("SELECT l_returnflag AS flag, round(corr(l_quantity, l_extendedprice), 6)::DOUBLE AS pearson FROM lineitem GROUP BY 1")
def attention_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.pearson(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return found.select(F.col("l_returnflag").alias("flag"), F.round("pearson", 6).alias("pearson"))


@plans.add("""
WITH d AS (SELECT p_brand AS brand, p_size AS x, round(p_retailprice) % 50 AS y FROM part),
k AS (SELECT brand, rank() OVER (PARTITION BY brand ORDER BY x) + (count(*) OVER (PARTITION BY brand, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY brand ORDER BY y) + (count(*) OVER (PARTITION BY brand, y) - 1) / 2 AS ry FROM d)
SELECT brand, round(corr(rx, ry), 6)::DOUBLE AS spearman FROM k GROUP BY brand""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("x"), (F.round("p_retailprice") % 50).alias("y"))
    return M.spearman(rows, "x", "y", ["brand"]).withColumn("spearman", F.round("spearman", 6))


@plans.add("""
WITH d AS (SELECT row_number() OVER () AS id, p_brand AS brand, p_size AS x, round(p_retailprice) % 50 AS y FROM part),
s AS (SELECT a.brand, sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s FROM d a JOIN d b ON a.brand = b.brand AND a.id < b.id GROUP BY a.brand),
n AS (SELECT brand, count(*) * (count(*) - 1) / 2 AS n0 FROM d GROUP BY brand),
tx AS (SELECT brand, sum(c * (c - 1) / 2) AS t FROM (SELECT brand, x, count(*) AS c FROM d GROUP BY ALL) GROUP BY brand), ty AS (SELECT brand, sum(c * (c - 1) / 2) AS t FROM (SELECT brand, y, count(*) AS c FROM d GROUP BY ALL) GROUP BY brand)
SELECT brand, round(s / sqrt((n0 - tx.t) * (n0 - ty.t)), 6)::DOUBLE AS kendall FROM s JOIN n USING (brand) JOIN tx USING (brand) JOIN ty USING (brand)""")
def kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("x"), (F.round("p_retailprice") % 50).alias("y"))
    return M.kendall(rows, "x", "y", ["brand"]).withColumn("kendall", F.round("kendall", 6))


_FRAMES = "c AS (SELECT source, lang, count(*) FILTER (WHERE n_chars > 1500) AS a, count(*) FILTER (WHERE n_chars <= 1500) AS b FROM documents GROUP BY ALL)"


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count_if(F.col("n_chars") > 1500).alias("a"), F.count_if(F.col("n_chars") <= 1500).alias("b"))


_KL = "CASE WHEN {0} > 0 THEN {0} * ln(({0} + 1e-12) / ((p + q) / 2 + 1e-12)) ELSE 0 END"


@plans.add(f"""WITH {_FRAMES}, s AS (SELECT source, sum(a) AS sa, sum(b) AS sb FROM c GROUP BY source),
u AS (SELECT source, sa, sb, CASE WHEN sa = 0 THEN NULL ELSE a / sa END AS p, CASE WHEN sb = 0 THEN NULL ELSE b / sb END AS q FROM c JOIN s USING (source))
SELECT source, round(CASE WHEN min(least(sa, sb)) > 0 THEN greatest(sum(({_KL.format('p')} + {_KL.format('q')}) / 2), 0) ELSE 0.5 END, 6)::DOUBLE AS jsd FROM u GROUP BY source""")
def jsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.jensen_shannon(_frames(spark, sf_dir), ["source"], "lang", "a", "b").withColumn("jsd", F.round("jsd", 6))


@plans.add(f"""WITH {_FRAMES}, s AS (SELECT source, sum(a) AS sa, sum(b) AS sb FROM c GROUP BY source),
u0 AS (SELECT source, CASE WHEN sa = 0 THEN 0 ELSE a / sa END + 1e-12 AS p, CASE WHEN sb = 0 THEN 0 ELSE b / sb END + 1e-12 AS q FROM c JOIN s USING (source)),
u AS (SELECT source, p / sum(p) OVER (PARTITION BY source) AS p, q / sum(q) OVER (PARTITION BY source) AS q FROM u0)
SELECT source, round(sum((p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2), 6)::DOUBLE AS jsd FROM u GROUP BY source""")
def frame_jsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.smoothed_jensen_shannon(_frames(spark, sf_dir), ["source"], "lang", "a", "b").withColumn("jsd", F.round("jsd", 6))


@plans.add("""
WITH d AS (SELECT user_id, event_id, value, (event_id * 7919) % 1000 AS s FROM events),
r AS (SELECT user_id, value, s, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS best, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_id) AS own FROM d),
g AS (SELECT user_id, sum(CASE WHEN own <= 10 THEN value / log2(own + 1) ELSE 0 END) AS dcg, sum(CASE WHEN best <= 10 THEN value / log2(best + 1) ELSE 0 END) AS idcg, count(*) AS n, sum(value) AS sg, sum(s) AS ss FROM r GROUP BY user_id)
SELECT user_id, round(dcg / idcg, 5)::DOUBLE AS ndcg FROM g WHERE n >= 2 AND sg > 0 AND ss > 0""")
def ndcg10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("s", (F.col("event_id") * 7919) % 1000)
    return M.ndcg(rows, ["user_id"], "event_id", "value", "s").withColumn("ndcg", F.round("ndcg", 5))


@plans.add("SELECT count(*)::BIGINT AS n, round(avg((l_extendedprice BETWEEN l_quantity * 1000 * 0.8 AND l_quantity * 1000 * 1.2)::INT), 6)::DOUBLE AS compliance FROM lineitem WHERE l_quantity > 0")
def budget_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("asked", F.col("l_quantity") * 1000)
    return M.within_budget(rows, "asked", "l_extendedprice").withColumn("compliance", F.round("compliance", 6))


@plans.add("""
WITH c AS (SELECT toxic = 1 AS y, quality = 0 AS p FROM labels), k AS (SELECT count(*) FILTER (WHERE p AND y) AS tp, count(*) FILTER (WHERE p AND NOT y) AS fp, count(*) FILTER (WHERE NOT p AND y) AS fn, count(*) FILTER (WHERE NOT p AND NOT y) AS tn FROM c),
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS c FROM k)
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(p, 6)::DOUBLE AS precision, round(c, 6)::DOUBLE AS recall, round(CASE WHEN p + c = 0 THEN 0 ELSE 2 * p * c / (p + c) END, 6)::DOUBLE AS f1 FROM r""")
def confusion_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.confusion(table(spark, sf_dir, "labels"), F.col("quality") == 0, F.col("toxic") == 1)
    return found.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


# Each (row, draw) has the Poisson weight that its hash gives; arithmetic is modulo 2 ** 64.
_MOD = "18446744073709551616"
_STEP = lambda z, shift, factor: f"((xor({z}, {z} >> {shift})::UHUGEINT * {factor}) % {_MOD})::UBIGINT"


@plans.add(f"""
WITH met AS (SELECT lang, doc_id, toxic::DOUBLE AS v FROM labels JOIN documents USING (doc_id) WHERE toxic IS NOT NULL),
z0 AS (SELECT lang, v, draw, (((doc_id::UHUGEINT * {0x9E3779B97F4A7C15}) % {_MOD} + ((draw + 42)::UHUGEINT * {0xD1B54A32D192ED03}) % {_MOD}) % {_MOD})::UBIGINT AS z FROM met, (SELECT unnest(range(1000)) AS draw)),
z1 AS (SELECT lang, v, draw, {_STEP('z', 30, 0xBF58476D1CE4E5B9)} AS z FROM z0), z2 AS (SELECT lang, v, draw, {_STEP('z', 27, 0x94D049BB133111EB)} AS z FROM z1),
w AS (SELECT lang, v, draw, len(list_filter({M.poisson_steps()}::UBIGINT[], lambda s: s <= xor(z, z >> 31) >> 11)) AS w FROM z2),
means AS (SELECT lang, draw, sum(w * v) / sum(w) AS m FROM w GROUP BY lang, draw HAVING sum(w) > 0)
SELECT lang, any_value(n)::BIGINT AS n, round(any_value(mean), 6)::DOUBLE AS mean, round(quantile_cont(m, 0.025), 6)::DOUBLE AS low, round(quantile_cont(m, 0.975), 6)::DOUBLE AS high
FROM means JOIN (SELECT lang, count(*) AS n, avg(v) AS mean FROM met GROUP BY lang) USING (lang) GROUP BY lang""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    found = M.bootstrap(met, ["lang"], "toxic", row="doc_id")
    return found.select("lang", "n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@plans.add("""
WITH s AS (SELECT source, count(*) AS size FROM documents GROUP BY source)
SELECT (SELECT count(*) FROM documents)::BIGINT AS n, (SELECT count(DISTINCT lang) FROM documents)::BIGINT AS items, count(*)::BIGINT AS groups, min(size)::BIGINT AS least, max(size)::BIGINT AS largest, round(avg(size), 6)::DOUBLE AS mean, quantile_cont(size, 0.5)::DOUBLE AS median FROM s""")
def topline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.topline(table(spark, sf_dir, "documents"), "lang", "source").withColumn("mean", F.round("mean", 6))


@plans.add("SELECT source, count(*)::BIGINT AS n FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY n DESC, source LIMIT 5")
def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.volume(table(spark, sf_dir, "documents"), "source", 5)


_FLAGS = {"has_table": "text LIKE '%|%'", "has_link": "text LIKE '%http%'", "has_mail": "text LIKE '%@%'", "has_number": "regexp_matches(text, '[0-9]{4}')"}


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(t.contains("|").alias("has_table"), t.contains("http").alias("has_link"), t.contains("@").alias("has_mail"), t.rlike("[0-9]{4}").alias("has_number"))


@plans.add(" UNION ALL ".join(f"SELECT '{k}' AS feature, count(*) FILTER (WHERE {v})::BIGINT AS n, round(100.0 * count(*) FILTER (WHERE {v}) / count(*), 6)::DOUBLE AS pct FROM documents" for k, v in _FLAGS.items()))
def feature_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.feature_rates(_flags(spark, sf_dir), list(_FLAGS)).withColumn("pct", F.round("pct", 6))


@plans.add(f"SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE {' OR '.join(_FLAGS.values())})::BIGINT AS n, round(100.0 * count(*) FILTER (WHERE {' OR '.join(_FLAGS.values())}) / count(*), 6)::DOUBLE AS pct FROM documents")
def union_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.any_feature(_flags(spark, sf_dir), list(_FLAGS)).withColumn("pct", F.round("pct", 6))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@plans.add("SELECT source, count(*)::BIGINT AS total, " + ", ".join(f"round(100.0 * count(*) FILTER (WHERE lang = '{x}') / count(*), 6)::DOUBLE AS {x}" for x in ("de", "en", "fr")) + " FROM documents WHERE lang IN ('de', 'en', 'fr') GROUP BY source")
def crosstab_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.crosstab(table(spark, sf_dir, "documents"), "source", "lang", ["de", "en", "fr"])
    return found.select("source", "total", *[F.round(c, 6).alias(c) for c in ("de", "en", "fr")])


@plans.add("SELECT o_orderstatus AS status, " + ", ".join(f"round_even(avg(o_orderkey % 97) FILTER (WHERE o_orderpriority = '{p}'), 1)::DOUBLE AS p{p[0]}" for p in _PRIORITIES) + " FROM orders GROUP BY 1")
def mean_by_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("v", F.col("o_orderkey") % 97)
    found = stats.pivot_mean(rows, "o_orderstatus", "o_orderpriority", _PRIORITIES, "v")
    return found.select(F.col("o_orderstatus").alias("status"), *[F.col(f"`{p}`").cast("double").alias(f"p{p[0]}") for p in _PRIORITIES])


@plans.add("SELECT l_shipmode_ AS mode, count(*)::BIGINT AS n, sum(q)::DOUBLE AS total, round(avg(q), 6)::DOUBLE AS mean, round(sum(q) / sum(sum(q)) OVER (), 6)::DOUBLE AS share FROM (SELECT l_linestatus || l_returnflag AS l_shipmode_, l_quantity AS q FROM lineitem) GROUP BY 1")
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_linestatus", "l_returnflag").alias("mode"), "l_quantity")
    found = stats.share_of_total(rows, "mode", "l_quantity")
    return found.select("mode", "n", "total", F.round("mean", 6).alias("mean"), F.round("share", 6).alias("share"))


@plans.add("""
SELECT no::INTEGER AS no, bin, (SELECT count(*) FROM documents WHERE n_chars > lo AND n_chars <= hi)::BIGINT AS n
FROM (VALUES (0, 'short', 0, 500), (1, 'medium', 500, 2000), (2, 'long', 2000, 10000), (3, 'huge', 10000, 1000000)) t(no, bin, lo, hi)""")
def hist_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(table(spark, sf_dir, "documents"), "n_chars", [0, 500, 2000, 10000, 1000000], ["short", "medium", "long", "huge"])


@plans.add("""
SELECT lang, count(n_chars)::BIGINT AS n, round(avg(n_chars), 4)::DOUBLE AS mean, round(stddev_samp(n_chars), 4)::DOUBLE AS std, round(quantile_cont(n_chars, 0.1), 4)::DOUBLE AS p10, round(quantile_cont(n_chars, 0.5), 4)::DOUBLE AS p50, round(quantile_cont(n_chars, 0.95), 4)::DOUBLE AS p95, max(n_chars)::BIGINT AS largest FROM documents GROUP BY lang""")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.percentiles(table(spark, sf_dir, "documents"), "n_chars", [0.1, 0.5, 0.95], ["lang"])
    return found.select("lang", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "p10", "p50", "p95")], "largest")


@plans.add("""
WITH g AS (SELECT unnest([100.0, 200.0, 300.0, 400.0]) AS threshold)
SELECT threshold::DOUBLE AS threshold, count(*) FILTER (WHERE value >= threshold)::BIGINT AS pairs, count(DISTINCT CASE WHEN value >= threshold THEN user_id END)::BIGINT AS items FROM events, g GROUP BY threshold""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sweep(table(spark, sf_dir, "events"), "value", "user_id", [100.0, 200.0, 300.0, 400.0])


@plans.add("""
SELECT * FROM (SELECT event_id, value, 'high' AS side FROM events ORDER BY value DESC, event_id LIMIT 25) UNION ALL SELECT * FROM (SELECT event_id, value, 'low' AS side FROM events ORDER BY value, event_id LIMIT 25)""")
def extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.extremes(table(spark, sf_dir, "events").select("event_id", "value"), "value", "event_id", 25)


@plans.add("""
SELECT o_custkey AS custkey, arg_min(o_orderkey, (-epoch(o_orderdate), o_orderkey)) AS orderkey FROM orders GROUP BY 1""")
def distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    day = -F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    found = stats.first_by(rows, ["o_custkey"], [day, F.col("o_orderkey")], ["o_orderkey"])
    return found.select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"))


@plans.add("SELECT doc_id, round(0.3 * coalesce(quality, 0.5) + 0.6 * coalesce(toxic, 0.5), 6)::DOUBLE AS fused, least(coalesce(n_chars, 25), 200)::BIGINT AS budget FROM documents LEFT JOIN labels USING (doc_id)")
def score_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return met.select("doc_id", F.round(N.fused(F.col("quality").cast("double"), F.col("toxic").cast("double")), 6).alias("fused"), N.budget(F.col("n_chars")).cast("long").alias("budget"))
