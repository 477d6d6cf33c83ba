"""Compression of vectors to codes: each part of a vector becomes the number of its nearest codebook entry.

Components become integers, vectors are cut into equal parts, and each part has a codebook that k-means
refines for a fixed number of rounds. All arithmetic is on integers, so results don't depend on how
rows are dealt.

The nearest entry is found by annular pruning. A codebook's entries are sorted by norm. An entry whose
norm differs from the vector's by more than the best distance so far can't be nearer (triangle
inequality), so a binary search in the norms gives the interval of entries still allowed; they are
looked at from the middle outward, exactly, and each better distance narrows the interval. Its ends
belong to it, since an entry at the same distance wins if its number is lower.

A round is one pass over the written integers: a task adds up its vectors by part and entry, a group-by
adds up the tasks' sums, and the driver gets one row for each part and entry, of a number that the
parameters bound. A pass that is lost with an executor is done again from the written table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.llm.base import cut, quoted
from civicflow.session import spread

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LIMIT = 1 << 53  # components beyond are taken as this
_SAFE = 1 << 24  # up to here, distances of parts of up to 2,048 components fit into 64 bits
_MOST = (1 << 63) - 1


class Annuli:
    """One part's entries (a row of integers each), sorted by norm."""

    def __init__(self, entries: np.ndarray):
        self.wide = entries.size > 0 and int(abs(entries).max()) > _SAFE
        squares = (entries.astype(object) ** 2).sum(1) if self.wide else (entries * entries).sum(1)
        self.number = np.argsort(squares.astype(float), kind="stable")
        self.entries = entries[self.number]
        self.norms = np.sqrt(squares[self.number].astype(float))
        self.looked_at = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of and squared distance to the nearest entry for each row of x, ties to the lower number."""
        if self.wide or (x.size and int(np.abs(x).max()) > _SAFE):
            x, entries = x.astype(object), self.entries.astype(object)
        else:
            entries = self.entries
        norms = np.sqrt((x * x).sum(1).astype(float))

        def distances(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            self.looked_at += len(rows)
            apart = x[rows] - entries[at]
            return (apart * apart).sum(1)

        def limits(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            # Roots are rounded: the interval is wider by more than that, which can only let entries in.
            far = np.sqrt(best[rows].astype(float))
            slack = 1e-9 * (norms[rows] + far) + 1e-9
            return np.searchsorted(self.norms, norms[rows] - far - slack, "left"), np.searchsorted(self.norms, norms[rows] + far + slack, "right") - 1

        every = np.arange(len(x))
        middle = np.minimum(np.searchsorted(self.norms, norms), len(entries) - 1)
        best, number = distances(every, middle), self.number[middle]
        for step in (1, -1):
            rows, at = every, middle + step
            while True:
                low, high = limits(rows)
                inside = (at >= low) & (at <= high)
                rows, at = rows[inside], at[inside]
                if not len(rows):
                    break
                apart = distances(rows, at)
                better = (apart < best[rows]) | ((apart == best[rows]) & (self.number[at] < number[rows]))
                best[rows[better]], number[rows[better]] = apart[better], self.number[at[better]]
                at = at + step
        return number, best


@dataclass(frozen=True)
class Codebooks:
    """Entries by part, number and place: an array of three dimensions."""

    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> np.ndarray:
        """The vector of integers that a code stands for."""
        digits = len(code) // len(self.entries)
        return np.concatenate([own[int(code[i * digits : (i + 1) * digits], 16)] for i, own in enumerate(self.entries)])


def integer_vectors(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, scale: int = SCALE, keep: tuple[str, ...] = ("vec_id", "label")) -> DataFrame:
    """The columns ``keep``, and ``x``: floor(scale * component) as whole numbers, up to ``LIMIT`` in size.

    Rows go whose vector is null, holds null, NaN or infinite components, or has a length that isn't a
    positive multiple of ``parts``.
    """
    v = F.col(quoted(vector))
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    whole = F.transform(v, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))))
    fits = (F.size(v) > 0) & (F.size(v) % parts == 0)
    return vectors.where(v.isNotNull() & fits & finite).select(*[F.col(quoted(c)).alias(c) for c in keep], whole.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def _assigned(x: np.ndarray, annuli: list[Annuli]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each part: its columns of x, the numbers of the nearest entries, and the squared distances."""
    width = x.shape[1] // len(annuli)
    for i, own in enumerate(annuli):
        part = x[:, i * width : (i + 1) * width]
        yield part, *own.nearest(part)


def train(x: DataFrame, id_column: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """x (ids, x) without vectors of another length than the first one's, and the codebooks after all rounds.

    The codebooks start as the parts of the vectors of the least ids (then of the least components; null
    ids come last); fewer vectors make fewer entries, and none makes none. x is read once a round: hand
    in a table or the result of ``cut``.
    """
    order = [F.col(quoted(id_column)).asc_nulls_last(), F.col("x")]
    first = x.orderBy(*order).first()
    width = len(first["x"]) if first else 0
    x = x.where(F.size("x") == width)
    start = [r["x"] for r in x.orderBy(*order).limit(entries).select("x").collect()]
    books = np.array(start, np.int64).reshape(len(start), parts, width // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds if start else 0):
        sums = _sums(x, books)
        for r in sums.collect():  # parts x entries rows at most
            total, n = [int(s) for s in r["sums"]], r["n"]
            books[r["part"], r["entry"]] = [s // n for s in total]
    return x, Codebooks(books)


def _sums(x: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, n, sums): how many parts each entry is nearest to, and the sums of their components."""
    n_parts, n_entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = [Annuli(b) for b in books]
        sums, counts = np.zeros((n_parts, n_entries, width), object), np.zeros((n_parts, n_entries), np.int64)
        for batch in batches:
            if batch.num_rows:
                for i, (part, number, _) in enumerate(_assigned(_matrix(batch["x"]), annuli)):
                    counts[i] += np.bincount(number.astype(np.int64), minlength=n_entries)
                    by_entry = np.argsort(number, kind="stable")
                    found, begins = np.unique(number[by_entry].astype(np.int64), return_index=True)
                    exact = part.astype(object) if int(np.abs(part).max()) > _SAFE else part
                    sums[i, found] += np.add.reduceat(exact[by_entry], begins, axis=0).astype(object)
        p, e = np.nonzero(counts)
        cells = [[Decimal(int(s)) for s in sums[i, j]] for i, j in zip(p, e)]
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(cells, pa.list_(pa.decimal128(38, 0)))], ["part", "entry", "n", "sums"])

    mine = x.select("x").mapInArrow(run, "part int, entry int, n long, sums array<decimal(38,0)>")
    added = [F.sum(F.col("sums")[i]) for i in range(width)]
    return mine.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*added).alias("sums"))


def encode(x: DataFrame, books: Codebooks, keep: tuple[str, ...] = ("vec_id", "label")) -> DataFrame:
    """The columns ``keep`` of x, with code (two or more hexadecimal digits for each part) and error, the summed squared distance.

    An error beyond 64 bits is given as the greatest such number.
    """
    digits = max(2, len(f"{max(books.entries.shape[1] - 1, 0):x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = [Annuli(b) for b in books.entries]
        names = np.array([f"{i:0{digits}x}" for i in range(books.entries.shape[1])], object)
        for batch in batches:
            if batch.num_rows:
                code, error = np.full(batch.num_rows, "", object), np.zeros(batch.num_rows, object)
                for _, number, apart in _assigned(_matrix(batch["x"]), annuli):
                    code = code + names[number.astype(np.int64)]
                    error = error + apart.astype(object)
                columns = [batch.column(f"c{i}") for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(code, pa.string()), pa.array([min(e, _MOST) for e in error.tolist()], pa.int64())], [*(f"c{i}" for i in range(len(keep))), "code", "error"])

    named = x.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(keep)], "x")
    fields = ", ".join(f"c{i} {named.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(keep)))
    return named.mapInArrow(run, f"{fields}, code string, error long").toDF(*keep, "code", "error")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code and error of every embedding, its label's summed error, and the digest of the codebooks.

    Null vectors and those with null, NaN or infinite components go; so do those whose length isn't a
    multiple of eight or isn't that of the kept vector of the least id. Null ids stay and come last.
    Rows that repeat are vectors of their own. Components beyond 2**53 in size are taken as 2**53, and
    errors beyond 64 bits as the greatest such number. No vectors, no rows. Null labels are one label.
    Other columns of embeddings aren't read.
    """
    x = cut(integer_vectors(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))), "vectors")
    x, books = train(x)
    codes = cut(encode(x, books), "codes")
    by_label = codes.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(Decimal(_MOST))).cast("long").alias("label_error"))
    met = codes.join(by_label.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    steps = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * {scale})::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), places AS (SELECT r, unnest(x) AS c, unnest(range(len(x))) AS i, len(x) // {parts} AS w FROM kept
), pieces AS MATERIALIZED (SELECT r, i // w AS part, i % w AS place, c FROM places
), book0 AS MATERIALIZED (SELECT part, r - 1 AS entry, place, c FROM pieces WHERE r <= {entries})"""]  # fmt: skip
    for k in range(rounds + 1):
        steps.append(f"""apart{k} AS (SELECT p.r, p.part, b.entry, sum((p.c - b.c) * (p.c - b.c))::BIGINT AS d FROM pieces p JOIN book{k} b ON p.part = b.part AND p.place = b.place GROUP BY ALL
), near{k} AS MATERIALIZED (SELECT r, part, entry, d FROM apart{k} QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY d, entry) = 1)""")  # fmt: skip
        if k < rounds:
            steps.append(f"""means{k} AS (SELECT n.part, n.entry, p.place, sum(p.c)::BIGINT AS s, count(*) AS n FROM near{k} n JOIN pieces p ON p.r = n.r AND p.part = n.part GROUP BY ALL
), book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.place, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, b.c) AS c FROM book{k} b LEFT JOIN means{k} m USING (part, entry, place))""")  # fmt: skip
    steps.append(f"""codes AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY r
), labelled AS (SELECT kept.vec_id, code, error, label FROM codes JOIN kept USING (r)
), digest AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM book{rounds})""")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM labelled, digest"


OP11_SQL = _sql()
