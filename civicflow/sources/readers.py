"""Readers with explicit schemas. Paths are handed to Spark, so any store that Spark can read will do."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicflow.functions.text import copy_unescaped, html_text
from civicflow.storage import cut

RAW_COLUMNS = ["document_id", "docket_id", "agency_id", "document_type", "posted_date", "title", "comment", "content_files", "attachment_files", "fr_number", "related_rins", "comment_on_document_id"]


def strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def csv_table(spark: SparkSession, path: str | list[str], schema: T.StructType, keep_blanks: bool = False) -> DataFrame:
    """CSV (also gzip) with a header and quoted texts over several lines. With ``keep_blanks`` missing values are empty texts, not null."""
    reader = spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
    df = reader.csv(path)
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if keep_blanks and k == "string" else F.col(c) for c, k in df.dtypes])


def csv_some(spark: SparkSession, path: str | list[str], schema: T.StructType, wanted: list[str]) -> DataFrame:
    """The wanted columns that the schema has; the scan reads no others."""
    return csv_table(spark, path, schema).select(*[c for c in wanted if c in schema.names])


def preferred_files(paths: list[str]) -> list[str]:
    """Of ``x.csv`` and ``x.csv.gz`` in one folder, the compressed one only."""
    packed = {p.removesuffix(".gz") for p in paths if p.endswith(".csv.gz")}
    return sorted(p for p in paths if p.endswith(".csv.gz") or (p.endswith(".csv") and p not in packed))


def base_files(paths: list[str]) -> list[str]:
    """Files that aren't the output of a later step."""
    return [p for p in paths if not re.search(r"(_1|_all_text)\.csv|__|_chunked|_labels|_matches|_score_", p.rsplit("/", 1)[-1])]


def origin(path: Column) -> Column:
    """agency, period and document type of ``…/agency_y_y/type.csv``."""
    folder = F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1)
    agency = F.regexp_extract(folder, r"^([a-z]+)_(\d{4}_\d{4})$", 1)
    kind = F.regexp_replace(F.regexp_extract(path, r"/([^/]+)$", 1), r"(_all_text)?\.csv(\.gz)?$", "")
    return F.struct(F.when(agency != "", agency).otherwise(folder).alias("agency"), F.regexp_extract(folder, r"^([a-z]+)_(\d{4}_\d{4})$", 2).alias("period"), kind.alias("doc_type"))


def all_documents(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """All CSV files in one scan, with agency, period and doc_type taken from each file's path."""
    return csv_table(spark, paths, schema).withColumn("_o", origin(F.input_file_name())).select("*", "_o.*").drop("_o")


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; malformed lines are left out."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    held = T.StructType([*kind.fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.text(path).select(F.from_json("value", held, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return rows.where("r is not null and r._bad is null").select(*[F.col(f"r.{f.name}") for f in kind.fields])


def jsonl_with(spark: SparkSession, path: str, schema: str, needle: str) -> DataFrame:
    """JSON lines that contain a literal; others are dropped before they are parsed."""
    lines = spark.read.text(path).where(F.col("value").contains(needle))
    return lines.select(F.from_json("value", schema).alias("r")).where("r is not null").select("r.*")


_COPY = re.compile(r"^COPY (?:\w+\.)?\"?(\w+)\"? \(([^)]*)\) FROM stdin;$")


def copy_blocks(spark: SparkSession, path: str, tables: dict[str, list[str]], unescape: bool = True) -> dict[str, DataFrame]:
    """The ``COPY … FROM stdin`` blocks of database dumps as one frame of strings a table.

    A dump is read in splits, by as many tasks. Lines that look like a block's header or end are
    found first, with the file and the split that they are in; in order, they say which block is open
    where each split begins. These lines are few, and all that the driver gets. Then each split is
    parsed from there on, once for all tables, into shared storage. A line within a block that looks like a
    header is a row, as only ``\\.`` ends a block. Rows with a wrong number of fields are left out.
    """
    wanted = {t: list(cols) for t, cols in tables.items()}
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    numbered = lines.withColumn("no", F.monotonically_increasing_id())
    marks = numbered.where((F.col("value") == "\\.") | F.col("value").rlike(_COPY.pattern)).orderBy("file", "split", "no").collect()
    opened: dict[str, list[tuple[int, tuple | None]]] = {}  # for each file, the state behind each split with a mark
    last, state = None, None
    for m in marks:
        if m["file"] != last:
            last, state = m["file"], None
        state = _next_state(state, m["value"])
        opened.setdefault(m["file"], []).append((m["split"], state))

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for pdf in batches:
            out = []
            for file, split, line in zip(pdf["file"], pdf["split"], pdf["value"], strict=True):
                if (file, split) != at:
                    at = (file, split)
                    state = next((s for k, s in reversed(opened.get(file, [])) if k < split), None)
                before, state = state, _next_state(state, line)
                if before is not None and state is before and before[0] in wanted:
                    fields = line.split("\t")
                    if len(fields) == len(before[1]):
                        own = dict(zip(before[1], fields, strict=True))
                        out.append((before[0], [own.get(c) for c in wanted[before[0]]]))
            yield pd.DataFrame(out, columns=["table", "fields"])

    rows = cut(lines.mapInPandas(parsed, "table string, fields array<string>"), "dump")
    value = copy_unescaped if unescape else (lambda c: F.when(c != "\\N", c))
    return {t: rows.where(F.col("table") == t).select(*[value(F.get("fields", i)).alias(c) for i, c in enumerate(cols)]) for t, cols in wanted.items()}


def _next_state(state: tuple | None, line: str) -> tuple | None:
    """The open block (table, columns) behind a line."""
    if state is not None:
        return None if line == "\\." else state
    m = _COPY.match(line)
    return (m[1], [c.strip().strip('"') for c in m[2].split(",")]) if m else None


def html_documents(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), html_text(F.col("value")).alias("text"))
    return files


def extracted(spark: SparkSession, path: str, extractor: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, text, error) of binary files: pages from a pluggable extractor, with page markers between them. A file that fails has an error and no text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    pages = extractor(bytes(data))
                    out.append((p, "\n".join(f"<<PAGE {i}>>\n{t}" for i, t in enumerate(pages, 1)), None))
                except Exception as e:  # an extractor may fail in any way; the file is reported, not lost
                    out.append((p, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "text", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string, error string")


def years(text: str) -> list[int]:
    """``2017-2020`` or ``2017,2019`` as a list of years, in order."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        a, _, b = part.partition("-")
        first, last = int(a), int(b or a)
        if first > last:
            raise ValueError(f"{part}: the first year is after the last")
        out.update(range(first, last + 1))
    return sorted(out)
