"""Text functions over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.functions import answers, text as X
from civicflow.operators import chunking
from civicflow.plans import Plans, table

plans = Plans()

_CLEAN_SQL = "coalesce(text, '')"
for _p, _b in X.COMMENT_EDITS:
    _flags = "g" + ("i" if "i" in _p[: _p.find(")")] and _p.startswith("(?") and not _p.startswith("(?:") else "") + ("s" if _p.startswith("(?is)") else "") + ("m" if _p.startswith(("(?m)", "(?im)")) else "")
    _body = _p[_p.find(")") + 1 :] if _p.startswith(("(?i)", "(?m)", "(?im)", "(?is)")) else _p
    _prefix = {"(?i)": "(?i)", "(?m)": "(?m)", "(?im)": "(?im)", "(?is)": "(?is)"}.get(_p[: _p.find(")") + 1], "") if _p.startswith("(?") and not _p.startswith("(?:") else ""
    _CLEAN_SQL = "regexp_replace({}, '{}', '{}', 'g')".format(_CLEAN_SQL, (_prefix + _body).replace("'", "''"), _b)


@plans.add(f"SELECT doc_id, md5(lower(trim({_CLEAN_SQL}))) AS digest FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.clean_comment(F.col("text")).cast("binary")).alias("digest"))


@plans.add(r"""
WITH e AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '<<COMMENT \d+>>\s*', '', 'g'), '(?m)^\s*(true|false)\s*$', '', 'g'), '(?m)^\s*\d+\s*$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t, text FROM documents)
SELECT doc_id, CASE WHEN lower(trim(coalesce(text, ''))) IN ('', 'nan', 'none') THEN '' ELSE regexp_replace(t, '^\s+|\s+$', '', 'g') END AS cleaned FROM e""")
def register_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_register(F.col("text")).alias("cleaned"))


@plans.add("""
WITH p AS (SELECT conv_id, list(text ORDER BY turn) AS ts FROM conversations GROUP BY conv_id),
k AS (SELECT conv_id, list_filter(ts, lambda t: t IS NOT NULL AND trim(t) <> '') AS ts FROM p)
SELECT conv_id, md5(array_to_string(list_transform(range(1, len(ts) + 1), lambda i: '<<COMMENT ' || i || '>>' || chr(10) || ts[i]), chr(10))) AS digest, len(ts)::INTEGER AS pieces FROM k""")
def assemble_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("ts"))
    kept = F.size(F.filter("ts", lambda t: F.trim(t) != ""))
    return turns.select("conv_id", F.md5(X.assemble(F.col("ts")).cast("binary")).alias("digest"), kept.alias("pieces"))


@plans.add(r"""
WITH w AS (SELECT doc_id, text, regexp_extract(text, '^([^\n]*)', 1) AS stub FROM documents)
SELECT doc_id, md5(CASE WHEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) > len(list_filter(regexp_split_to_array(stub, '\s+'), lambda x: x <> '')) THEN text ELSE stub END) AS digest,
       len(list_filter(regexp_split_to_array(stub, '\s+'), lambda x: x <> '')) < 20 AS is_stub FROM w""")
def stub_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_extract("text", r"^([^\n]*)", 1).alias("stub"))
    n, m = X.token_count(F.col("text")), X.token_count(F.col("stub"))
    return own.select("doc_id", F.md5(F.when(n > m, F.col("text")).otherwise(F.col("stub")).cast("binary")).alias("digest"), (m < 20).alias("is_stub"))


_STRIPPED = r"regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'), '(?s)<[^>]*>', chr(10), 'g')"
_ENTITIES = f"replace(replace(replace(replace(replace(replace({_STRIPPED}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


@plans.add(rf"""
WITH s AS (SELECT page_id, regexp_replace({_ENTITIES}, '[ \t]*\n[ \t]*', chr(10), 'g') AS t FROM pages)
SELECT page_id, md5(trim(regexp_replace(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g'))) AS digest FROM s""")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.html_text(F.col("html")).cast("binary")).alias("digest"))


@plans.add(r"""
SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, substr(sha256(url), 1, 16) AS short_hash,
       regexp_replace(url, '(\.(txt|html?|pdf))+$', '') AS stem, lower(trim(substr(url, 1, 200))) AS prefix_key,
       len(list_filter(regexp_split_to_array(url || ';ftp://x, http://y', '[|\n,;\s]+'), lambda x: regexp_matches(x, '^https?://')))::INTEGER AS n_urls FROM pages""")
def page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", X.slug(u).alias("slug"), X.short_hash(u).alias("short_hash"), X.without_suffixes(u).alias("stem"), X.prefix_key(u).alias("prefix_key"), X.url_count(F.concat(u, F.lit(";ftp://x, http://y"))).alias("n_urls"))


# Answers as a model might give them, made of a conversation's turns.
_TURNS = "t AS (SELECT conv_id, turn, role, regexp_extract(coalesce(text, ''), '^([^\\n]*)', 1) AS line, coalesce(text, '') AS text FROM conversations)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.regexp_extract(t, r"^([^\n]*)", 1).alias("line"), t.alias("text"))


def _joined(rows: DataFrame, value, by: str) -> DataFrame:
    """(conv_id, answer): a value of each turn, in order."""
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", value.alias("v")))), lambda x: x["v"]), by).alias("answer"))


@plans.add(f"WITH {_TURNS} SELECT conv_id, turn::INTEGER AS provision, trim(line) AS claim FROM t WHERE turn BETWEEN 1 AND 3 AND trim(line) <> ''")
def parse_claim_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged claims read back out of an answer; only numbers from 1 to 3 are provisions."""
    tag = F.concat(F.lit("Claim follows.\n [P"), F.col("turn").cast("string"), F.lit("] "), F.col("line"))
    answers_ = _joined(_turns(spark, sf_dir), tag, "\n")
    return answers_.select("conv_id", F.inline(X.claim_tags(F.col("answer"), F.lit(3))))


@plans.add(rf"""
WITH {_TURNS}, w AS (SELECT conv_id, list(CASE role WHEN 'user' THEN 'same' WHEN 'assistant' THEN 'related' END ORDER BY turn) FILTER (WHERE role IN ('user', 'assistant')) AS ws, count(*) AS n, min_by(text, turn) AS first,
  sum(len(regexp_extract_all('[P' || turn || '] ' || text, '(?m)^\s*\[P\d+\]'))) AS marks FROM t GROUP BY conv_id)
SELECT conv_id, array_to_string(list_slice(list_concat(ws, list_transform(range(n + 2), lambda i: 'error')), 1, n), ',') AS labels,
       CASE WHEN starts_with(regexp_extract(lower(trim(first)), '^[^a-z]*([a-z]+)', 1), 'yes') THEN 'yes' WHEN starts_with(regexp_extract(lower(trim(first)), '^[^a-z]*([a-z]+)', 1), 'no') THEN 'no' ELSE '' END AS answer,
       marks::INTEGER AS claim_lines FROM w""")
def parse_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in a batch answer, padded where turns have none; yes or no; and lines that look like claims."""
    turns = _turns(spark, sf_dir)
    label = F.when(F.col("role") == "user", "Same,").when(F.col("role") == "assistant", '"related";').otherwise("banana")
    labels = _joined(turns, label, "\n").withColumnRenamed("answer", "labels")
    first = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"), F.count("*").cast("int").alias("n"))
    claims = _joined(turns, F.concat(F.lit("[P"), F.col("turn").cast("string"), F.lit("] "), F.col("text")), "\n")
    met = labels.join(first, "conv_id").join(claims, "conv_id")
    return met.select("conv_id", F.array_join(X.batch_labels(F.col("labels"), F.col("n")), ",").alias("labels"), X.yes_no(F.col("first")).alias("answer"), X.claim_lines(F.col("answer")).alias("claim_lines"))


@plans.add(f"""
WITH {_TURNS}, l AS (SELECT conv_id, list(text ORDER BY turn) AS ts FROM t GROUP BY conv_id)
SELECT conv_id, md5(array_to_string(ts, chr(1))) AS last, md5(array_to_string(ts, chr(1))) AS first, md5(array_to_string(ts, chr(1))) AS loose, ts[1] AS field FROM l""")
def answer_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists and objects read out of answers with thoughts, code fences, trailing commas and prose around them."""
    turns = _turns(spark, sf_dir).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("ts"))
    json = F.to_json("ts")
    commas = F.regexp_replace(json, r"\]$", ",]")
    digest = lambda c: F.md5(F.array_join(c, "\u0001").cast("binary"))
    last = answers.answer_list(F.concat(F.lit('[] <think>["no"]</think> Here: []\n'), json, F.lit("\nDone.")))
    fenced = answers.answer_objects(F.concat(F.lit("```json\n"), commas, F.lit("\n```")))
    field = answers.answer_object(F.concat(F.lit("```json\n"), F.to_json(F.struct(F.get("ts", 0).alias("x"))), F.lit("\n```")), "struct<x:string>")
    return turns.select("conv_id", digest(last).alias("last"), digest(fenced).alias("first"), digest(answers.listed(json)).alias("loose"), field["x"].alias("field"))


@plans.add("""
SELECT doc_id, CASE WHEN text IS NOT NULL AND lower(trim(text)) NOT IN ('', 'nan', 'none') AND (doc_id % 3 = 0 OR doc_id % 5 = 0) THEN 'text_plus_attachment'
  WHEN text IS NOT NULL AND lower(trim(text)) NOT IN ('', 'nan', 'none') THEN 'text_only' WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN 'attachment_only' ELSE 'unknown' END AS mode FROM documents""")
def submission_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    content, attached = F.when(F.col("doc_id") % 3 == 0, "https://a/x.pdf").otherwise("nan"), F.when(F.col("doc_id") % 5 == 0, "https://a/y.pdf")
    return table(spark, sf_dir, "documents").select("doc_id", X.submission_mode(F.col("text"), content, attached).alias("mode"))


@plans.add(r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS tok, text FROM documents)
SELECT doc_id, md5(CASE WHEN len(tok) > 60 THEN array_to_string(list_slice(tok, 1, 40), ' ') || ' [...] ' || array_to_string(list_slice(tok, len(tok) - 19, len(tok)), ' ') ELSE array_to_string(tok, ' ') END) AS digest,
       doc_id || '||' || substr(text, 1, 200) AS pair_key, TRY_CAST(regexp_extract(text, '\b(\d{4})\b', 1) AS INTEGER) AS year FROM t""")
def truncation_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.head_and_tail(t, 40, 20).cast("binary")).alias("digest"), X.pair_key(F.col("doc_id"), t).alias("pair_key"), X.first_year(t).alias("year"))


@plans.add()
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunking.chunk_rows(own, "doc_id", "text", 200, 40).select("doc_id", "chunk_no", F.md5(F.col("chunk").cast("binary")).alias("digest"), X.token_count(F.col("chunk")).alias("n_tokens"))


@plans.add()
def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    return lines.select("doc_id", F.size("lines").alias("n_lines"), F.size(chunking.without_overlaps(F.col("lines"))).alias("n_kept"))
