"""Near-duplicate clustering over documents, with language as the block and source as the agency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.functions import text as X
from civicflow.operators import dedup as D
from civicflow.operators import stats
from civicflow.operators.components import components
from civicflow.plans import Plans, table
from civicflow.storage import cut

plans = Plans()

#: Lower-cased text with white space collapsed: an edit chain that all regex dialects agree on.
_CLEAN = r"lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))"
_BASE = rf"""
docs AS (SELECT lang AS block, min(doc_id) AS id, {_CLEAN} AS clean FROM documents GROUP BY lang, text),
toks AS (SELECT block, id, clean, list_filter(string_split(clean, ' '), lambda x: x <> '') AS tok FROM docs),
gated AS (SELECT * FROM toks WHERE len(tok) >= 80),
runs AS (SELECT block, id, list_distinct(list_transform(range(1, len(tok) - 3), lambda i: array_to_string(list_slice(tok, i, i + 4), ' '))) AS runs FROM gated),
rows_ AS (SELECT DISTINCT block, id, ('0x' || substr(md5(s), 1, 15))::BIGINT AS shingle FROM (SELECT block, id, unnest(runs) AS s FROM runs)),
sizes AS (SELECT block, count(*) AS n FROM gated GROUP BY block),
dfs AS (SELECT block, shingle, count(*) AS df FROM rows_ GROUP BY block, shingle),
kept AS (SELECT r.* FROM rows_ r JOIN dfs USING (block, shingle) JOIN sizes USING (block) WHERE df <= greatest(1, floor(n * 0.2)))
"""
_FAMILY = "fam AS (SELECT unnest([" + ", ".join(str(i) for i in range(D.PERMUTATIONS)) + "]) AS no, unnest([" + ", ".join(str(a) for a, _, _ in D.family()) + "]) AS a, unnest([" + ", ".join(str(b) for _, b, _ in D.family()) + "]) AS b, unnest([" + ", ".join(str(c) for _, _, c in D.family()) + "]) AS c)"
_SIGNED = f"""{_BASE}, {_FAMILY},
mins AS (SELECT block, id, no, min((a::BIGINT * (shingle >> 30) + b * (shingle & 1073741823) + c) % 2147483647) AS m FROM kept, fam GROUP BY block, id, no),
signed AS (SELECT block, id, list(m ORDER BY no) AS sig FROM mins GROUP BY block, id)"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")


def _clean(c):
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of each block's different texts over the token gate. Cleaning changes white space and case only, and tokens don't depend on how much white space there is."""
    reps = _docs(spark, sf_dir).groupBy("lang", "text").agg(F.min("doc_id").alias("id")).select("lang", "id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    return cut(D.shingle_arrays(reps, "lang", "id", "text", least=D.MIN_TOKENS), "shingles", packed=False)


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(D.signatures(D.drop_common(_arrays(spark, sf_dir))), "signed")


@plans.add("""
WITH g AS (SELECT lang AS block, min(doc_id) AS rep, count(*) AS copies FROM documents GROUP BY lang, text)
SELECT block, count(*)::BIGINT AS texts, sum(copies)::BIGINT AS docs, max(copies)::BIGINT AS most, sum(rep)::BIGINT AS reps,
       round(1 - count(*) / sum(copies), 6)::DOUBLE AS reduction FROM g GROUP BY block""")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = D.exact_groups(_docs(spark, sf_dir), "lang", "doc_id", "text")
    return groups.groupBy(F.col("lang").alias("block")).agg(
        F.count("*").alias("texts"), F.sum("copies").alias("docs"), F.max("copies").alias("most"), F.sum("rep").alias("reps"),
        F.round(1 - F.count("*") / F.sum("copies"), 6).alias("reduction"),
    )


@plans.add(rf"""
SELECT doc_id, len(list_filter(string_split({_CLEAN}, ' '), lambda x: x <> ''))::BIGINT AS n_tokens,
       len(list_filter(string_split({_CLEAN}, ' '), lambda x: x <> '')) >= 80 AS eligible FROM documents""")
def token_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = X.token_count(_clean(F.col("text"))).cast("long")
    return _docs(spark, sf_dir).select("doc_id", n.alias("n_tokens"), (n >= D.MIN_TOKENS).alias("eligible"))


@plans.add(f"WITH {_BASE} SELECT block, shingle, df::BIGINT AS df FROM dfs WHERE df > 1")
def shingle_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.document_frequency(_arrays(spark, sf_dir)).where("df > 1")


@plans.add(f"WITH {_BASE} SELECT block, id, count(*)::BIGINT AS n, sum(shingle % 1000003)::BIGINT AS total FROM kept GROUP BY block, id")
def shingle_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = D.drop_common(_arrays(spark, sf_dir))
    return kept.select("block", "id", F.size("hashes").cast("long").alias("n"), F.aggregate("hashes", F.lit(0).cast("long"), lambda t, h: t + h % 1000003).alias("total"))


@plans.add(f"WITH {_SIGNED} SELECT block, id, array_to_string(sig, ',') AS signature FROM signed")
def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signed(spark, sf_dir).select("block", "id", F.array_join("signature", ",").alias("signature"))


#: Bands and rows: the usual ones, and ones under which more texts share a bucket.
_USUAL, _LOOSE = (D.BANDS, D.ROWS), (32, 4)


def _linked(bands: int, rows: int) -> str:
    return f"""{_SIGNED},
bands AS (SELECT block, id, k AS band, list_slice(sig, k * {rows} + 1, k * {rows} + {rows}) AS key FROM signed, (SELECT unnest(range(0, {bands})) AS k)),
firsts AS (SELECT block, band, key, min(id) AS b FROM bands GROUP BY block, band, key HAVING count(*) > 1),
pairs AS (SELECT DISTINCT block, id AS a, b FROM bands JOIN firsts USING (block, band, key) WHERE id <> b)"""


@plans.add(f"""WITH {_linked(*_LOOSE)} SELECT p.block, a, b, round(len(list_filter(range(1, 129), lambda i: x.sig[i] = y.sig[i])) / 128.0, 6)::DOUBLE AS likeness
FROM pairs p JOIN signed x ON x.id = a JOIN signed y ON y.id = b""")
def lsh_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bucket's members with its least member, and their likeness."""
    signed = _signed(spark, sf_dir)
    sig = signed.select("id", "signature")
    met = D.bucket_links(signed, *_LOOSE).join(signed.select("block", F.col("id").alias("a"), F.col("signature").alias("sa")), "a").join(sig.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b")
    return met.select("block", "a", "b", F.round(D.likeness(F.col("sa"), F.col("sb")), 6).alias("likeness"))


@plans.add(f"""WITH RECURSIVE {_linked(*_LOOSE)},
links AS (SELECT a AS u, b AS v FROM pairs UNION SELECT b, a FROM pairs),
reach(u, v) AS (SELECT u, u FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v)
SELECT u AS node, min(v) AS root FROM reach GROUP BY u""")
def dedup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(D.bucket_links(_signed(spark, sf_dir), *_LOOSE))


def _clustered(bands: int, rows: int) -> str:
    return f"""{_linked(bands, rows)},
links AS (SELECT a AS u, b AS v FROM pairs UNION SELECT b, a FROM pairs),
reach(u, v) AS (SELECT u, u FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
roots AS (SELECT u AS id, min(v) AS root FROM reach GROUP BY u),
best AS (SELECT root, arg_max(id, (length(clean), -id)) AS rep FROM roots JOIN docs USING (id) GROUP BY root),
judged AS (SELECT r.id, r.root, len(list_filter(range(1, 129), lambda i: s.sig[i] = t.sig[i])) / 128.0 >= 0.5 AS stays
  FROM roots r JOIN best USING (root) JOIN signed s ON s.id = r.id JOIN signed t ON t.id = rep),
placed AS (SELECT t.id, CASE WHEN j.stays THEN 'clustered' WHEN NOT j.stays THEN 'ejected' WHEN len(tok) < 80 THEN 'short' WHEN s.id IS NULL THEN 'common' ELSE 'alone' END AS reason,
  CASE WHEN j.stays THEN j.root ELSE t.id END AS grp FROM toks t LEFT JOIN judged j ON j.id = t.id LEFT JOIN signed s ON s.id = t.id),
named AS (SELECT id AS rep, reason, min(id) OVER (PARTITION BY grp, reason = 'clustered') AS cluster FROM placed),
every AS (SELECT d.lang AS block, d.doc_id AS id, n.rep, n.cluster, n.reason FROM (SELECT lang, doc_id, min(doc_id) OVER (PARTITION BY lang, text) AS rep FROM documents) d JOIN named n ON n.rep = d.rep)"""


_CLUSTERED = _clustered(*_USUAL)


def _cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.cluster(_docs(spark, sf_dir), "lang", "doc_id", "text", cleaner=_clean)


@plans.add(f"WITH RECURSIVE {_CLUSTERED} SELECT block, id, rep, cluster, reason FROM every")
def dedup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cluster(spark, sf_dir)


@plans.add(f"WITH RECURSIVE {_clustered(*_LOOSE)} SELECT block, id, rep, cluster, reason FROM every")
def dedup_clusters_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.cluster(_docs(spark, sf_dir), "lang", "doc_id", "text", cleaner=_clean, bands=_LOOSE[0], rows=_LOOSE[1])


@plans.add(f"""WITH RECURSIVE {_CLUSTERED} SELECT block, id, cluster, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY block, cluster ORDER BY CASE WHEN id = cluster THEN 0 ELSE 1 END, md5(id::VARCHAR), id) AS place FROM every) WHERE place <= 3""")
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three members of each cluster, its representative among them."""
    return D.sampled_members(_cluster(spark, sf_dir), 3).select("block", "id", "cluster", "place")


@plans.add("SELECT lang AS block, doc_id AS id, CASE WHEN n_chars % 7 = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY lang, n_chars % 7 = 0, n_chars) END AS cluster FROM documents")
def shared_id_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of documents with one key, here their length; some have none."""
    rows = table(spark, sf_dir, "documents").select("lang", "doc_id", F.when(F.col("n_chars") % 7 != 0, F.col("n_chars")).alias("key"))
    return D.by_shared_id(rows, "lang", "key", "doc_id")


@plans.add(f"""WITH RECURSIVE {_CLUSTERED},
sized AS (SELECT block, cluster, count(*) AS size FROM every GROUP BY block, cluster),
numbered AS (SELECT block, cluster, (row_number() OVER (PARTITION BY block ORDER BY CASE WHEN size > 1 THEN 0 ELSE 1 END, cluster) - 1)::INTEGER AS cluster_id FROM sized)
SELECT block, id, cluster_id, block || '::' || cluster_id AS cluster_uid, reason FROM every JOIN numbered USING (block, cluster)""")
def dedup_mapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.mapper(_cluster(spark, sf_dir))


@plans.add(f"""WITH RECURSIVE {_CLUSTERED},
sized AS (SELECT block, cluster, count(*) AS size FROM every GROUP BY block, cluster)
SELECT sum(size)::BIGINT AS documents, count(*)::BIGINT AS clusters, count(*) FILTER (WHERE size > 1)::BIGINT AS shared, max(size)::BIGINT AS largest,
       list_sort(list(size))[count(*) // 2 + 1]::BIGINT AS upper_median, round(1 - count(*) / sum(size), 6)::DOUBLE AS reduction FROM sized""")
def dedup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.summary(_cluster(spark, sf_dir))


@plans.add("""
SELECT lang || ':' || source AS grp, arg_max(doc_id, (length(text), -doc_id)) AS longest, min(doc_id) AS first_id, count(*)::BIGINT AS size FROM documents GROUP BY 1""")
def cluster_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _docs(spark, sf_dir).withColumn("grp", F.concat_ws(":", "lang", "source"))
    longest = D.representatives(own, "grp", "doc_id", "text", "longest").select("grp", F.col("doc_id").alias("longest"))
    first = D.representatives(own, "grp", "doc_id", "text", "first_id").select("grp", F.col("doc_id").alias("first_id"), "size")
    return longest.join(first, "grp")


@plans.add("""
WITH g AS (SELECT lang, text, count(*) AS n FROM documents GROUP BY lang, text)
SELECT no::INTEGER AS no, bin, (SELECT count(*) FROM g WHERE n > lo AND n <= hi)::BIGINT AS n
FROM (VALUES (0, '1', 0, 1), (1, '2', 1, 2), (2, '3-5', 2, 5), (3, '6-20', 5, 20), (4, 'over 20', 20, 1e18)) t(no, bin, lo, hi)""")
def cluster_size_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = D.exact_groups(_docs(spark, sf_dir), "lang", "doc_id", "text")
    return stats.histogram(groups, "copies", [0, 1, 2, 5, 20, 1e18], ["1", "2", "3-5", "6-20", "over 20"])
