"""Removal of repeated passages by overlapping windows of three lines.

Every three consecutive lines of a text make a window, known by 128 bits of hash. Of all places where
a window occurs in the corpus, in order of document id (then text hash, then line), the first stays;
the lines under every later one go. Overlapping windows merge, since a line goes if any window over
it does. DataFrame functions only.

Windows are hashed once and their places written. They are counted with partial aggregation of
numbers only, so a window that stands in a third of all documents meets itself as one row a task.
Only places of repeated windows are looked at further. The joins read both sides from written tables
or shuffles of their own, which adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.llm.base import cut, documents, quoted
from civicflow.storage import dropped

WINDOW = 3


def _key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes of a text."""
    return [F.xxhash64(text), F.xxhash64(F.lit("again"), text)]


def window_places(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, t1, t2, pos, w1, w2): each window of each text, with the hash of its text and the number of its first line.

    Windows of blank lines only don't count. A text of fewer lines has none.
    """
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    lines = texts.select("id", *[k.alias(f"t{i}") for i, k in enumerate(_key(F.col("text")), 1)], F.split("text", "\n").alias("lines"))
    lines = lines.where(F.size("lines") >= window)
    starts = F.sequence(F.lit(0), F.size("lines") - F.lit(window))
    at = [lambda i, j=j: F.element_at("lines", i + F.lit(j + 1)) for j in range(window)]

    def hashed(i: Column) -> Column:
        own = [a(i) for a in at]
        # The parts' lengths keep windows apart that would concatenate alike.
        blank = F.length(F.trim(F.translate(F.concat(*own), "\t\r", "  "))) == 0
        return F.struct(i.alias("pos"), blank.alias("blank"), F.xxhash64(*own).alias("w1"), F.xxhash64(F.lit("again"), *own).alias("w2"))

    return lines.select("id", "t1", "t2", F.inline(F.transform(starts, hashed))).where(~F.col("blank")).drop("blank")


def repeated_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, t1, t2, gone): for each text with lines to remove, the numbers of their windows' first lines."""
    places = cut(window_places(docs, window), "places")
    often = cut(places.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "often")
    again = cut(places.join(often, ["w1", "w2"], "left_semi"), "again")
    dropped(places, often)
    # A repeated row is the same document, so the first of its places is among the later ones, but not beyond itself.
    first = cut(again.groupBy("w1", "w2").agg(F.min(F.struct("id", "t1", "t2", "pos")).alias("first")), "firsts")
    later = again.join(first, ["w1", "w2"]).where(F.struct("id", "t1", "t2", "pos") > F.col("first"))
    return later.groupBy("id", "t1", "t2").agg(F.collect_set("pos").alias("gone"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the column text cleaned, and the columns n_lines and n_removed added to their end.

    A text without repeats stays as it is, null included (n_lines 0 for null, 1 for an empty text).
    A text whose lines all go becomes empty. Rows that repeat, with the same id and text, are one
    document: all of them keep what that document keeps. Rows of one id with different texts are
    different documents, in order of their text's hash; null ids come first. Every row and every
    other column stays; columns of docs called n_lines or n_removed are replaced.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    left = docs.select(F.struct(*[F.col(quoted(c)) for c in own]).alias("row"), F.col("doc_id").alias("id"), *[k.alias(f"t{i}") for i, k in enumerate(_key(F.coalesce("text", F.lit(""))), 1)])
    right = repeated_lines(docs, window).select(F.col("id").alias("rid"), F.col("t1").alias("r1"), F.col("t2").alias("r2"), "gone")
    met = left.join(right, (F.col("t1") == F.col("r1")) & (F.col("t2") == F.col("r2")) & F.col("id").eqNullSafe(F.col("rid")), "left")
    # The lines are a column: a lambda would split the text again for every line that it looks up.
    met = met.select("row", "gone", F.split("row.text", "\n").alias("lines"))
    text, lines = F.col("row.text"), F.col("lines")
    # Line i goes if a removed window starts at i or up to window - 1 lines before.
    gone = F.array_distinct(F.flatten(F.transform("gone", lambda p: F.sequence(p, p + F.lit(window - 1)))))
    flags = F.transform(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: i)
    kept = F.array_join(F.transform(F.array_except(flags, gone), lambda i: F.element_at(lines, i + 1)), "\n")
    cleaned = F.when(F.col("gone").isNull(), text).otherwise(kept)
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size(gone)).cast("long")
    out = [cleaned.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in own]
    return met.select(*out, n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the lines that came before, with its number of lines and of those removed.

    A null text stays null, with no lines; an empty one has one line; a very long one is read whole.
    Rows that repeat keep what their document keeps; documents of one id go in the order of their
    text's hash, and null ids come first. No documents, no rows. Other columns aren't read.
    """
    return remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), places AS (
  SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS pos FROM lines WHERE len(ls) >= 3
), windows AS (
  SELECT doc_id, pos, [ls[pos + 1], ls[pos + 2], ls[pos + 3]] AS w FROM places
  WHERE trim(replace(replace(ls[pos + 1] || ls[pos + 2] || ls[pos + 3], chr(9), ' '), chr(13), ' ')) <> ''
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS rn FROM windows
), gone AS (
  SELECT DISTINCT doc_id, pos + k AS line FROM ranked, (SELECT unnest([0, 1, 2]) AS k) WHERE rn > 1
), every AS (
  SELECT doc_id, unnest(ls) AS line_text, unnest(range(0, len(ls))) AS line FROM lines
), kept AS (
  SELECT e.doc_id, string_agg(e.line_text, chr(10) ORDER BY e.line) FILTER (WHERE g.line IS NULL) AS joined,
         count(g.line) AS n_removed, count(*) AS n_lines
  FROM every e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.line = g.line GROUP BY e.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.joined, '') END AS text,
       CASE WHEN d.text IS NULL THEN 0 ELSE k.n_lines END AS n_lines, k.n_removed AS n_removed
FROM documents d JOIN kept k ON d.doc_id = k.doc_id
"""
