"""How document filters overlap: what each removes in every order in which they can be applied.

Native expressions build a mask for each document, with a bit for each filter that it fails. Whether
an equal text has a smaller id comes from a group-by of texts (by SHA-256), which supplies each text's
least id. Documents are then counted by part and mask: 2^n cells a part for n filters, and all that is
asked about an order follows from the cells. An order matters to a step only by the set of filters
applied before, so a part's cells are summed once for each set and filter (80 for five filters), and
the sums are dealt to the orders (120) that agree.

Texts don't leave their scan: what is shuffled is a hash, an id, a mask and two flags for each document.
Copies collapse by partial aggregation, and the join that marks first copies has the id in its key, so
a text that a third of all documents hold is no hot key.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.llm.base import cut, documents, fresh, labels

LETTERS = "ABCDE"
COUNTS = ("n", "good", "toxic")


def words(text: Column) -> Column:
    """The text's maximal runs of characters other than space and tab to carriage return."""
    return F.filter(F.split(text, "[ \\x09-\\x0D]+"), lambda w: w != "")


def text_failures(text: Column, own_words: Column) -> list[Column]:
    """The filters of a text by itself: few words, few distinct words, many capitals, odd characters."""
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [
        F.size(own_words) < 100,
        F.size(F.array_distinct(own_words)) * 100 < F.size(own_words) * 80,
        capitals * 100 > F.length(text) * 10,
        text.rlike("[#$%&*|]"),
    ]


def bits(failures: Sequence[Column]) -> Column:
    """A mask: bit i is set where failure i is true; null is no failure."""
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failures)), F.lit(0))


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, text_hash, mask) of docs (doc_id, text, lang), with the bits of the filters A to D."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    split = texts.select("doc_id", "part", "text", words(F.col("text")).alias("words"))
    return split.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("text_hash"), bits(text_failures(F.col("text"), F.col("words"))).alias("mask"))


def with_copies(rows: DataFrame, bit: int = 4) -> DataFrame:
    """rows (doc_id, text_hash, mask, ...) with the bit set where a smaller id has the text. Null ids come behind all others.

    Rows of one id and text aren't copies of one another. rows is read twice: hand in a table or the
    result of ``cut``.
    """
    of, least_id = fresh(rows.columns, "of"), fresh(rows.columns, "least_id")
    least = rows.groupBy(F.col("text_hash").alias(of)).agg(F.min("doc_id").alias(least_id))
    met = rows.join(least, (F.col("text_hash") == F.col(of)) & F.col("doc_id").eqNullSafe(F.col(least_id)), "left")
    return met.withColumn("mask", F.when(F.col(of).isNull(), F.col("mask") + (1 << bit)).otherwise(F.col("mask"))).drop(of, least_id)


def with_outcomes(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """rows with good and toxic (0 or 1): whether any row of marks (doc_id, quality, toxic) of its id has a 1 there."""
    any_one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marked = fresh(rows.columns, "marked")
    own = marks.groupBy(F.col("doc_id").alias(marked)).agg(any_one("quality").alias("good"), any_one("toxic").alias("toxic"))
    met = rows.drop("good", "toxic").join(own, F.col("doc_id") == F.col(marked), "left").drop(marked)
    return met.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})


def mask_histogram(rows: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those with either outcome, by part and mask."""
    sums = [F.count("*").alias("n"), *[F.sum(c).cast("long").alias(c) for c in COUNTS[1:]]]
    return rows.groupBy("part", "mask").agg(*sums)


def _steps(letters: str) -> Column:
    """(before, filter, step, orders): each set of filters as bits, each filter outside it, and the orders that begin with the set, then the filter."""
    found = []
    for size in range(len(letters)):
        for before in combinations(letters, size):
            for own in letters:
                if own not in before:
                    after = [x for x in letters if x not in before and x != own]
                    orders = ["".join((*a, own, *b)) for a in permutations(before) for b in permutations(after)]
                    found.append(F.struct(
                        F.lit(sum(1 << letters.index(x) for x in before)).alias("before"), F.lit(1 << letters.index(own)).alias("filter"),
                        F.lit(size + 1).alias("step"), F.array(*map(F.lit, orders)).alias("orders"),
                    ))
    return F.array(*found)


def interactions(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """What every order's every step does in every part, from cells (part, mask, n, good, toxic); bit i is the filter letters[i].

    filter_order and step name the step; kept are the documents left after it, removed those that its
    filter takes out there, redundant those that fail it but went before, unique_fails those that fail
    it alone, good_lost and toxic_lost the removed ones with an outcome. shapley is removed, summed over
    all orders: a document that fails m filters falls to each of them first in one order of m.
    """
    orders = 1
    for k in range(2, len(letters) + 1):
        orders *= k
    gathered = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))
    rows = gathered.select("part", "cells", F.inline(_steps(letters)))

    def total(test, value=lambda c: c["n"]) -> Column:
        return F.aggregate(F.filter("cells", test), F.lit(0).cast("long"), lambda a, c: a + value(c))

    before, own = F.col("before"), F.col("filter")
    fails = lambda c: c["mask"].bitwiseAND(own) != 0
    here = lambda c: c["mask"].bitwiseAND(before) == 0
    first = lambda c: fails(c) & here(c)
    counted = rows.select(
        "part", "orders", F.col("step").cast("int").alias("step"),
        total(lambda c: here(c) & ~fails(c)).alias("kept"), total(first).alias("removed"), total(lambda c: fails(c) & ~here(c)).alias("redundant"),
        total(lambda c: c["mask"] == own).alias("unique_fails"), total(first, lambda c: c["good"]).alias("good_lost"), total(first, lambda c: c["toxic"]).alias("toxic_lost"),
        total(fails, lambda c: (c["n"] * orders / F.bit_count(c["mask"])).cast("long")).alias("shapley"),
    )
    return counted.select("part", F.explode("orders").alias("filter_order"), *[c for c in counted.columns if c not in ("part", "orders")])


def apply_order(rows: DataFrame, order: str, letters: str = LETTERS) -> DataFrame:
    """rows (..., mask) with removed_by: the first filter of the order that a document fails, null if none."""
    first = F.coalesce(*[F.when(F.col("mask").bitwiseAND(1 << letters.index(x)) != 0, F.lit(x)) for x in order])
    return rows.withColumn("removed_by", first)


def audited(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, part, mask, good, toxic) of docs (doc_id, text, lang) under the five filters."""
    rows = cut(masked(docs), "masks")
    return with_outcomes(with_copies(rows), marks).select("doc_id", "part", "mask", "good", "toxic")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the five filters removes at each step of each of their 120 orders, for each language.

    A null text is an empty one: it fails A, and E if an empty text has a smaller id. Null ids come
    behind all others and have no labels; rows of one id and text aren't copies of one another, and
    count as often as they come. Ids labelled more than once have an outcome if any of their labels has
    it. Very long texts are read whole. A language that is null is the part ''. No documents, no rows.
    Other columns of either table aren't read.
    """
    return interactions(mask_histogram(audited(documents(spark, sf_dir), labels(spark, sf_dir))))


OP12_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), flags AS (
  SELECT doc_id, part, {'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words),
         'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
         'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), min(doc_id) OVER (PARTITION BY text) IS NOT NULL)} AS f
  FROM texts
), marks AS (
  SELECT doc_id, bool_or(coalesce(quality, 0) = 1) AS good, bool_or(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id
), docs AS (
  SELECT part, f.A AS a, f.B AS b, f.C AS c, f.D AS d, f.E AS e, count(*) AS n, count(*) FILTER (WHERE m.good) AS good, count(*) FILTER (WHERE m.toxic) AS toxic
  FROM flags LEFT JOIN marks m USING (doc_id) GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), runs AS (
  SELECT part, filter_order, n, good, toxic,
         list_transform(string_split(filter_order, ''), lambda x: CASE x WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) AS fails
  FROM docs, orders
), firsts AS (
  SELECT *, coalesce(list_position(fails, true), 6) AS gone, len(list_filter(fails, lambda x: x)) AS failed FROM runs
), steps AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter,
         sum(CASE WHEN gone > step THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN fails[step] AND gone < step THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails[step] AND failed = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN gone = step THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN gone = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM firsts, (SELECT unnest(range(1, 6))::INTEGER AS step) GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM steps
"""
