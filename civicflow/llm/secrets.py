"""Secret scans with an incremental blob ledger.

Every version of a text is a blob, named by its SHA-256. The ledger holds, for each pair of blob and
rule version, the spans found in it. A scan reads only blobs whose pair isn't in the ledger, each once
however many paths or versions hold it, and joins findings back to all of them. New rules get a new
version, under which old blobs count as unseen.

A lasting ledger is a Parquet folder that the session names in ``LEDGER``; runs append what they
scanned to it. It has a folder for each rules version and beginning of a blob's name, and a run reads
only those that its own blobs have. Without the setting a run begins with an empty ledger.

Copies are dropped twice: within a task before texts move, so that a text that stands in a third of
all rows moves as one row a task, and again where all copies of a blob meet, next to the ledger's
entry for it if there is one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.llm.base import cut, documents, fresh, quoted
from civicflow.storage import exists

#: The base kinds come first; spans that start together stand in this order.
KINDS = ("assign", "access", "hex", "pem", "jwt", "forge", "chat")
BASE = KINDS[:3]
RULES = "1"
PREFIX = 2  # hexadecimal digits of a blob that name its folder in a ledger
SPANS = "array<struct<kind:string,start:int,end:int>>"
ENTRIES = f"blob string, rules string, spans {SPANS}"
LEDGER = "civicflow.secrets.ledger"
MARK = "[SECRET]"

_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


class _Span:
    def __init__(self, start: int, end: int):
        self.start, self.end = lambda: start, lambda: end


class _Jwt:
    """Finds what ``pattern`` does, in linear time: a pattern that starts anew at each ``eyJ`` of a long run would take quadratic time."""

    pattern = r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
    chains = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++){2,}")

    def finditer(self, text: str) -> Iterator[_Span]:
        for m in self.chains.finditer(text):
            parts, at, i = m[0].split("."), m.start(), 0
            starts = [at := at + (len(parts[k - 1]) + 1 if k else 0) for k in range(len(parts))]
            while i + 2 < len(parts):
                first = parts[i].find("eyJ")
                if first >= 0 and len(parts[i]) - first >= 11 and parts[i + 1].startswith("eyJ") and len(parts[i + 1]) >= 11 and len(parts[i + 2]) >= 8:
                    yield _Span(starts[i] + first, starts[i + 2] + len(parts[i + 2]))
                    i += 3
                else:
                    i += 1


@cache
def _patterns() -> dict[str, re.Pattern | _Jwt]:
    return {
        "assign": re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        "access": re.compile(r"AKIA[A-Z0-9]{16,}"),
        "hex": re.compile(r"[0-9a-f]{24,}"),
        "pem": re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[^-]*(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?"),
        "jwt": _Jwt(),
        "forge": re.compile(r"gh[opsur]_[A-Za-z0-9]{36,}"),
        "chat": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    }


#: A text without the literal has no match, so most texts skip most patterns.
_NEEDS = {"access": "AKIA", "pem": "-----BEGIN ", "jwt": "eyJ", "forge": "gh", "chat": "xox"}


def scan_text(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each secret, in code points, by start and then kind. Base spans stay whatever else overlaps them."""
    found = []
    low = text.lower()
    for no, (kind, pattern) in enumerate(_patterns().items()):
        if kind == "assign":
            if any(k in low for k in _KEYWORDS):
                found += [(m.start(), no, m.end()) for m in pattern.finditer(text) if len(m[1]) >= 6]
        elif _NEEDS.get(kind, "") in text:
            found += [(m.start(), no, m.end()) for m in pattern.finditer(text)]
    return [(KINDS[no], a, b) for a, no, b in sorted(found)]


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the task whose blob comes for the first time."""
    seen: set[str] = set()
    for batch in batches:
        blobs = batch["blob"].to_pylist()
        fresh = [not (b in seen or seen.add(b)) for b in blobs]
        yield batch if all(fresh) else batch.filter(pa.array(fresh, pa.bool_()))


def _scanned(rules: str):
    """Entries for the blobs that aren't seen. Rows come sorted, a seen one before the others of its blob."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        last = None
        for batch in batches:
            blobs = batch["blob"].to_pylist()
            first = [b != a for a, b in zip([last, *blobs], blobs)]
            last = blobs[-1] if blobs else last
            new = batch.filter(pa.array([f and not s for f, s in zip(first, batch["seen"].to_pylist(), strict=True)], pa.bool_()))
            if new.num_rows:
                spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scan_text(t or "")] for t in new["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([new["blob"], pa.array([rules] * new.num_rows), pa.array(spans, kind)], ["blob", "rules", "spans"])

    return run


def read_ledger(spark: SparkSession, path: str, rules: str = RULES, blobs: DataFrame | None = None) -> DataFrame:
    """A ledger's entries under these rules, none where there is no folder yet; with blobs (blob, each once) given, only theirs.

    For given blobs only the folders of their prefixes are read, and Catalyst broadcasts them where
    their size allows, so that the history isn't shuffled. A pair that two runs have scanned at the
    same time has one entry.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], ENTRIES)
    found = spark.read.schema(f"{ENTRIES}, prefix string").parquet(path).where(F.col("rules") == rules)
    if blobs is not None:
        prefixes = [r["prefix"] for r in blobs.select(_prefix().alias("prefix")).distinct().collect()]  # 16 ** PREFIX at most
        found = found.where(F.col("prefix").isin(prefixes)).join(blobs.select("blob"), "blob", "left_semi")
    return found.select("blob", "rules", "spans").dropDuplicates(["blob", "rules"])


def append_ledger(entries: DataFrame, path: str) -> None:
    """Adds entries to a ledger, one file for each rules version and prefix that occurs."""
    entries.withColumn("prefix", _prefix()).repartition("rules", "prefix").write.mode("append").partitionBy("rules", "prefix").parquet(path)


def _prefix() -> Column:
    return F.substring("blob", 1, PREFIX)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: str = RULES) -> DataFrame:
    """New ledger entries (blob, rules, spans) for the texts of versions (text) that the ledger hasn't under these rules.

    Append them to the ledger. A blob without findings gets an entry with no spans. A null text is
    the empty blob. Texts and known blobs meet in one shuffle by blob.
    """
    blobs = versions.select(blob_of(F.col("text")).alias("blob"), "text").mapInArrow(_firsts, "blob string, text string")
    rows = blobs.withColumn("seen", F.lit(False))
    if ledger is not None:
        known = ledger.where(F.col("rules") == rules).select("blob", F.lit(None).cast("string").alias("text"), F.lit(True).alias("seen"))
        rows = known.unionByName(rows)
    return rows.repartition("blob").sortWithinPartitions("blob", F.desc("seen")).mapInArrow(_scanned(rules), ENTRIES)


def findings(versions: DataFrame, keys: list[str], ledger: DataFrame, rules: str = RULES) -> DataFrame:
    """keys and spans for every row of versions, from a ledger that covers them; no spans for a blob without findings."""
    blob, known, spans = (fresh([*keys, "spans"], c) for c in ("blob", "known", "found"))
    own = versions.select(*[F.col(quoted(k)) for k in keys], blob_of(F.col("text")).alias(blob))
    entries = ledger.where((F.col("rules") == rules) & (F.size("spans") > 0)).select(F.col("blob").alias(known), F.col("spans").alias(spans))
    met = own.join(entries, F.col(blob) == F.col(known), "left")
    return met.select(*[F.col(quoted(k)) for k in keys], F.coalesce(spans, F.array().cast(SPANS)).alias("spans"))


def entries_for(versions: DataFrame, ledger: str | None = None, rules: str = RULES) -> DataFrame:
    """Ledger entries for every blob of versions (text). What the ledger lacks is scanned and appended to it; without one, everything is scanned."""
    if ledger is None:
        return cut(scan_unseen(versions, None, rules), "ledger")
    spark = versions.sparkSession
    blobs = cut(versions.select(blob_of(F.col("text")).alias("blob")).distinct(), "blobs")
    append_ledger(cut(scan_unseen(versions, read_ledger(spark, ledger, rules, blobs), rules), "ledger"), ledger)
    return read_ledger(spark, ledger, rules, blobs)


def scan(versions: DataFrame, keys: list[str] | None = None, ledger: str | None = None, rules: str = RULES) -> DataFrame:
    """The keys (doc_id, say, or path and version) and spans of every row of versions (keys, text); ledger is the folder of a lasting ledger."""
    return findings(versions, keys or ["doc_id"], entries_for(versions, ledger, rules), rules)


def redacted(text: str, spans: list[tuple[int, int]], mark: str = MARK) -> str:
    """The text with a mark in place of each span; spans that overlap become one mark. Linear in the text and the spans."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = MARK, rules: str = RULES, ledger: str | None = None) -> DataFrame:
    """docs with every secret in the column text replaced by a mark; overlapping spans become one mark. All rows and columns stay.

    ledger is the folder of a lasting ledger, whose blobs aren't scanned again.
    """
    own = docs.columns
    blob, known, spans = (fresh(own, c) for c in ("blob", "known", "found"))
    entries = entries_for(docs, ledger, rules).where(F.size("spans") > 0).select(F.col("blob").alias(known), written(F.col("spans")).alias(spans))

    @F.pandas_udf("string")
    def clean(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None else redacted(t, [tuple(map(int, x.split(":")[1:])) for x in s.split(",")], mark) for t, s in zip(texts, found, strict=True)], dtype=object)

    met = docs.select(*[F.col(quoted(c)) for c in own], blob_of(F.col("text")).alias(blob)).join(entries, F.col(blob) == F.col(known), "left")
    secret = F.when(F.col(spans).isNotNull(), F.col("text"))  # other texts don't go to Python
    return met.select(*[F.coalesce(clean(secret, F.col(spans)), F.col("text")).alias(c) if c == "text" else F.col(quoted(c)) for c in own])


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of base findings, their digest, and all spans, for every document.

    Blobs that the ledger named in the session's ``LEDGER`` holds aren't scanned again. A null text is
    an empty one, without findings; a very long one is scanned whole, in linear time. Rows that
    repeat, and equal texts, have equal findings; a null id stays null. Spans that start together
    stand in the order of their kinds. No documents, no rows. Other columns aren't read.
    """
    found = scan(documents(spark, sf_dir), ledger=spark.conf.get(LEDGER, None))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    count = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = of(*BASE)
    return found.select("doc_id", *count, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))



def _sql() -> str:
    """Matches with their places: a match stands behind all pieces between matches and all matches before it."""
    value = """["\'\']?\\x20*[:=]\\x20*["\'\']?([A-Za-z0-9+/_.=-]+)"""
    word = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key"))
    kinds = [("assign", f"({word}){value}", "length(regexp_extract(hit, pat, 2)) >= 6"), *[(k, p.pattern, "true") for k, p in _patterns().items() if k != "assign"]]
    finds = " UNION ALL ".join(f"SELECT doc_id, {no} AS no, '{k}' AS kind, '{p}' AS pat, regexp_extract_all(t, '{p}') AS hits, regexp_split_to_array(t, '{p}') AS gaps FROM d" for no, (k, p, _) in enumerate(kinds))
    keep = " OR ".join(f"(kind = '{k}' AND {c})" for k, _, c in kinds)
    base = "kind IN (" + ", ".join(f"'{k}'" for k in BASE) + ")"
    span = "kind || ':' || a || ':' || b"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({finds}),
p AS (SELECT doc_id, no, kind, pat, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
s AS (SELECT doc_id, no, kind, pat, hits[i] AS hit, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a FROM p),
f AS (SELECT doc_id, no, kind, a, a + length(hit) AS b FROM s WHERE {keep})
SELECT d.doc_id, {', '.join(f"count(*) FILTER (WHERE kind = '{k}')::BIGINT AS n_{k}" for k in BASE)},
  sha256(coalesce(string_agg({span}, ',' ORDER BY a, no) FILTER (WHERE {base}), '')) AS base_sha256, coalesce(string_agg({span}, ',' ORDER BY a, no), '') AS spans
FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id"""


OP5_SQL = _sql()
