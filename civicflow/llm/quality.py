"""Quality classifier: a generalised additive model with pairwise interactions.

A text becomes a row of measures (``FEATURES``). Each measure is binned at quantiles, and the model
holds one lookup table a measure and one for each of a few pairs of measures. The tables are learned
by boosting: in turn, over and over, each measure gets a tree of a few leaves fitted to the current
gradients, whose leaves are added to its table; then the pairs that explain most of what is left get
four-leaf trees likewise. A score is the sum of the looked-up values, so scoring is binning and
vectorised additions, and every table can be read as the effect of its measure.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.llm.base import documents, id_remainder, labels
from civicflow.llm.toxicity import labelled_sample

FEATURES = (
    "log_bytes", "log_words", "word_length", "distinct_words", "top_word", "twin_words", "short_words", "long_words",
    "upper", "digits", "stops", "commas", "exclamations", "symbols", "bars", "brackets", "other_marks", "wide_bytes",
    "line_length", "twin_lines", "blank_lines", "capital_words", "marked_words", "links",
)
BINS = 32
COARSE = 8


def _classes() -> np.ndarray:
    """For each byte, its class: upper-case letter, digit, kinds of mark, byte of a longer character."""
    kind = np.zeros(256, np.int64)
    kind[65:91], kind[48:58], kind[128:] = 1, 2, 9
    for no, chars in ((3, ".?"), (4, ",;:"), (5, "!"), (6, "#$%&*+=@^~"), (7, "|"), (8, "()[]{}<>"), (10, "\"'-/\\_`")):
        kind[[ord(c) for c in chars]] = no
    return kind


def measures(text: str) -> list[float]:
    """The features of a text; all 0 where a share has nothing to be taken of."""
    data = text.encode("utf-8", "surrogatepass")
    size = max(1, len(data))
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    by_class = np.bincount(_CLASS, weights=by_byte, minlength=11) / size
    words = text.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    counts = Counter(words)
    lines = text.split("\n")
    full = [x for x in lines if x.strip()]
    top = max(counts.values(), default=0)
    return [
        np.log1p(len(data)), np.log1p(len(words)), float(lengths.sum()) / n, len(counts) / n, top / n,
        sum(map(eq, words, words[1:])) / n, float((lengths <= 3).sum()) / n, float((lengths > 15).sum()) / n,
        by_class[1], by_class[2], by_class[3], by_class[4], by_class[5], by_class[6], by_class[7], by_class[8], by_class[10], by_class[9],
        np.log1p(len(data) / max(1, len(full))), 1 - len(set(full)) / max(1, len(full)), 1 - len(full) / len(lines),
        sum(map(str.isupper, words)) / n, (n - sum(map(str.isalnum, words))) / n, (text.count("http") + text.count("www.")) / n,
    ]


_CLASS = _classes()


@dataclass
class AdditiveModel:
    edges: list[np.ndarray]
    tables: np.ndarray  # a row for each feature
    pairs: list[tuple[int, int]]
    coarse: list[np.ndarray]
    grids: np.ndarray
    intercept: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for f, edge in enumerate(self.edges):
            z += self.tables[f, np.searchsorted(edge, x[:, f], side="right")]
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            z += grid[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Values of a tree over ordered bins: the split with most gain, again until there are so many leaves."""
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    bounds = [0, len(grad)]
    part = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    while len(bounds) <= leaves:
        best = (1e-9, None)
        for a, b in zip(bounds, bounds[1:]):
            if b - a > 1:
                at = np.arange(a + 1, b)
                gain = part(a, at) + part(at, b) - part(a, b)
                best = max(best, (float(gain.max()), int(at[gain.argmax()])), key=lambda x: x[0])
        if best[1] is None:
            break
        bounds = sorted([*bounds, best[1]])
    values = np.zeros(len(grad))
    for a, b in zip(bounds, bounds[1:]):
        values[a:b] = -(g[b] - g[a]) / (h[b] - h[a] + ridge)
    return values


def _quarters(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts each side of a grid once."""
    g, h = np.zeros((grad.shape[0] + 1, grad.shape[1] + 1)), np.zeros((grad.shape[0] + 1, grad.shape[1] + 1))
    g[1:, 1:], h[1:, 1:] = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    best, cut = 0.0, None
    for i in range(1, grad.shape[0]):
        for j in range(1, grad.shape[1]):
            gain = sum((g[b, d] - g[a, d] - g[b, c] + g[a, c]) ** 2 / (h[b, d] - h[a, d] - h[b, c] + h[a, c] + ridge) for a, b in ((0, i), (i, -1)) for c, d in ((0, j), (j, -1)))
            if gain > best:
                best, cut = gain, (i, j)
    values = np.zeros(grad.shape)
    if cut:
        i, j = cut
        for a in (slice(None, i), slice(i, None)):
            for b in (slice(None, j), slice(j, None)):
                values[a, b] = -grad[a, b].sum() / (hess[a, b].sum() + ridge)
    return best - g[-1, -1] ** 2 / (h[-1, -1] + ridge), values


def train(x: np.ndarray, y: np.ndarray, rounds: int = 150, leaves: int = 3, n_pairs: int = 6, pair_rounds: int = 40, rate: float = 0.1, ridge: float = 2.0) -> AdditiveModel:
    """Learns from measures x and labels y of 0 and 1, of which both must occur."""
    y = np.asarray(y, float)
    n = len(y)
    edges = [_cuts(c, BINS) for c in x.T]
    binned = [np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T, strict=True)]
    tables = np.zeros((x.shape[1], BINS))
    intercept = float(np.log(y.mean() / (1 - y.mean())))
    z = np.full(n, intercept)
    slope = lambda: (lambda p: (p - y, np.maximum(p * (1 - p), 1e-6)))(1 / (1 + np.exp(-z)))
    for _ in range(rounds):
        for f, b in enumerate(binned):
            grad, hess = slope()
            step = rate * _tree(np.bincount(b, grad, BINS), np.bincount(b, hess, BINS), leaves, ridge)
            tables[f] += step
            z += step[b]
    coarse = [_cuts(c, COARSE) for c in x.T]
    few = [np.searchsorted(e, c, side="right") for e, c in zip(coarse, x.T, strict=True)]

    def grid(i: int, j: int):
        grad, hess = slope()
        at = few[i] * COARSE + few[j]
        return _quarters(np.bincount(at, grad, COARSE**2).reshape(COARSE, COARSE), np.bincount(at, hess, COARSE**2).reshape(COARSE, COARSE), ridge)

    gains = sorted(((grid(i, j)[0], (i, j)) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)
    pairs = [p for gain, p in gains[:n_pairs] if gain > 0]
    grids = np.zeros((len(pairs), COARSE, COARSE))
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(pairs):
            step = rate * grid(i, j)[1]
            grids[k] += step
            z += step[few[i], few[j]]
    return AdditiveModel(edges, tables, pairs, coarse, grids, intercept)


_MEASURED = ", ".join(f"{f} double" for f in FEATURES)


def measured(rows: DataFrame, keys: str) -> DataFrame:
    """The key columns, named with their types, and the measures of the column text."""
    names = [k.split()[0] for k in keys.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([measures(t or "") for t in batch["text"].to_pylist()])
                yield pa.RecordBatch.from_arrays([*[batch[k] for k in names], *[pa.array(c) for c in x.T]], [*names, *FEATURES])

    return rows.select(*names, "text").mapInArrow(run, f"{keys}, {_MEASURED}")


def fit(docs: DataFrame, marks: DataFrame, per_class: int = 5000) -> AdditiveModel | None:
    """Learns from the labels quality of marks (doc_id, quality); None unless both classes have examples.

    The driver gets the measures, not the texts, of at most about 2 x ``per_class`` documents, sorted
    so that the model doesn't depend on the order of rows.
    """
    sample = labelled_sample(docs, marks, "quality", per_class, 2)
    rows = measured(sample.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id long, label int").toArrow()
    rows = rows.sort_by([(c, "ascending") for c in rows.column_names])
    y = rows["label"].to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    return train(np.stack([rows[f].to_numpy() for f in FEATURES], 1), y)


def scored(docs: DataFrame, model: AdditiveModel | None) -> DataFrame:
    """(doc_id, score) for each row of docs (doc_id, text): how likely its label is 1. A null text scores as an empty one; without a model, all score 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([measures(t or "") for t in batch["text"].to_pylist()])
                score = model.score(x) if model else np.full(len(x), 0.5)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(score)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality.

    A null or empty text has measures of 0; a very long one is measured whole. Rows that repeat, and
    equal texts, have equal scores; a null id stays null, isn't held out and isn't learned from. Equal
    gains go to the pair that is later in order. No documents, no rows. Other columns aren't read.
    """
    docs = documents(spark, sf_dir)
    found = scored(docs, fit(docs, labels(spark, sf_dir)))
    held = F.coalesce(id_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
