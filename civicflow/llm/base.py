"""What the operators of this subpackage share: reading, shared storage, hashing of ids, Arrow helpers.

Conventions that hold for every operator here:

* Only the columns that an operator names are read; any other column of the input, whatever it is
  called, neither reaches the work nor clashes with it.
* A null text counts as an empty one. A null ``doc_id`` is carried through as null and is never
  used for learning. Rows that repeat are kept as often as they come.
* An empty input gives an empty result of the same schema.
* A text of any length is read whole. Batches are worked through in parts of bounded size, a long
  text alone, so memory grows with the longest text and not with the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.session import spread
from civicflow.storage import cut, shared_dir

__all__ = ["cut", "shared_dir"]  # the operators take these from here


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table, dealt to all cores if it has fewer splits than that."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quoted(name: str) -> str:
    """A column name as Spark reads it, whatever letters are in it."""
    return "`" + name.replace("`", "``") + "`"


def fresh(columns: list[str], name: str) -> str:
    """A name like this one that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo a divisor; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(divisor)


def sample_hash(doc_id: Column, seed: int) -> Column:
    """A uniform number from 0 to 1 that depends on the id and a seed only."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings of an Arrow column, empty for null."""
    return [x or "" for x in column.to_pylist()]


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with a function of one record batch; empty batches are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points in one array, and each text's number of them."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, "<u4"), lengths


def spans_of(texts: list, chars: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Cuts a list of texts into consecutive parts of about so many characters, a longer text alone; bounds a batch's arrays."""
    first = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > chars:
            yield first, i
            first, total = i, 0
        total += len(t)
    if first < len(texts):
        yield first, len(texts)
