"""Toxicity from bags of subwords: embeddings averaged into a linear softmax.

A word is the average of the vectors of its character n-grams and of the whole word, all hashed into
one table; a misspelt or inflected word shares most of them with words seen in training. A window of
``window`` words is the average of its words, and a linear softmax tells toxic windows from others.
Every word is read; of one that a window says over and over, ``repeats`` count, or one odd word would
fill the window.
Table and softmax are trained jointly by minibatch gradient steps in numpy. A text scores as its most
toxic window, calibrated on a part of the sample that training didn't see.

Toxic documents teach with all their windows. In further rounds, if asked for, they teach only with
those that the round before finds toxic, and at least one each. ``compare`` tries settings by learning
from one part of the rows that may be learned from and scoring the rest of them; held-out rows take
no part in it.

The model is linear behind the averages, so scoring needs one number a table row: a word's worth is
the mean of its rows' numbers, and it is kept for words seen before.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.llm.base import documents, id_remainder, labels, sample_hash

GRAMS = (3, 4)
LONGEST = 40  # a longer word becomes overlapping pieces
LOG2_ROWS = 17
DIM = 8
WORD = re.compile(r"\w+").findall


@dataclass(frozen=True)
class Settings:
    window: int = 16
    stride: int = 8
    padded: int = 10  # a window of fewer words is averaged as if it had so many
    repeats: int = 2  # of one word in a window
    rounds: int = 1
    work: int = 300_000  # windows that a round of training takes


SETTINGS = Settings()


def subwords(word: str) -> list[int]:
    """Table rows of a word: itself and its character n-grams, with marks at its ends."""
    marked = f"<{word}>"
    parts = [marked, *[marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]]
    mask = (1 << LOG2_ROWS) - 1
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) & mask for p in parts]


def pieces_of(word: str) -> list[str]:
    """A word of up to ``LONGEST`` characters as it is, a longer one as consecutive pieces that overlap so far that each n-gram is in one."""
    step = LONGEST - max(GRAMS) + 1
    return [word[i : i + LONGEST] for i in range(0, max(1, len(word) - max(GRAMS) + 1), step)]


def words_of(text: str) -> list[str]:
    """Lower-case words, long ones in pieces."""
    words = WORD(text.lower())
    if max(map(len, words), default=0) > LONGEST:
        words = [p for w in words for p in pieces_of(w)]
    return words


def counted(windows: np.ndarray, repeats: int) -> np.ndarray:
    """Rows of word numbers (-1: none) in which a number stays in its first ``repeats`` places and becomes -1 in others."""
    order = np.argsort(windows, axis=1, kind="stable")
    ranked = np.take_along_axis(windows, order, 1)
    ranked[:, repeats:][ranked[:, repeats:] == np.take_along_axis(windows, order[:, :-repeats], 1)] = -1
    out = np.empty_like(windows)
    np.put_along_axis(out, order, ranked, 1)
    return out


def windows_of(numbers: np.ndarray, window: int, stride: int) -> np.ndarray:
    """Overlapping windows of a text's word numbers as rows, filled up with -1; a text without words has one of -1 alone."""
    starts = np.arange(0, max(1, len(numbers) - window + stride), stride)
    filled = np.concatenate([numbers, np.full(window, -1, numbers.dtype)])
    return filled[starts[:, None] + np.arange(window)]


@dataclass
class ToxicityModel:
    worth: np.ndarray  # for each table row, what it adds to the logit
    bias: float
    scale: float
    shift: float
    settings: Settings = SETTINGS
    most_words: int = 300_000
    known: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def values(self, words: list[str]) -> np.ndarray:
        new = {w for w in words if w not in self.known}
        if new:
            if len(self.known) + len(new) > self.most_words:
                self.known.clear()
                new = set(words)
            rows = [subwords(w) for w in new]
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            flat = self.worth[np.fromiter((r for x in rows for r in x), np.int64, int(sizes.sum()))]
            means = np.add.reduceat(flat, np.concatenate([[0], np.cumsum(sizes)[:-1]])) / sizes
            self.known.update(zip(new, means.tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))

    def window_logits(self, text: str) -> np.ndarray:
        number: dict[str, int] = {}
        own = [number.setdefault(w, len(number)) for w in words_of(text)]
        worth = np.append(self.values(list(number)), 0.0)
        rows, out = windows_of(np.array(own, np.int32), self.settings.window, self.settings.stride), []
        for at in range(0, len(rows), 1 << 14):
            part = counted(rows[at : at + (1 << 14)], self.settings.repeats)
            out.append(worth[part].sum(1) / np.maximum((part >= 0).sum(1), self.settings.padded))
        return np.concatenate(out) + self.bias

    def score(self, text: str) -> float:
        z = self.scale * float(self.window_logits(text).max()) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


class _Bags:
    """Windows of the sample's texts as rows of word numbers, and words as rows of table numbers."""

    def __init__(self, texts: list[str], settings: Settings):
        self.number: dict[str, int] = {}
        rows = [windows_of(np.array([self.number.setdefault(w, len(self.number)) for w in words_of(t)], np.int32), settings.window, settings.window) for t in texts]
        self.owner = np.repeat(np.arange(len(texts)), list(map(len, rows)))
        self.windows = counted(np.concatenate(rows), settings.repeats)
        self.sizes = np.maximum((self.windows >= 0).sum(1), settings.padded)
        rows = [subwords(w) for w in self.number]
        self.row_sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        self.row_starts = np.concatenate([[0], np.cumsum(self.row_sizes)])
        self.rows = np.fromiter((r for x in rows for r in x), np.int32, int(self.row_sizes.sum()))


def _pooled(bags: _Bags, table: np.ndarray, chosen: np.ndarray):
    """Vectors of the chosen windows, with what the gradient needs to go back."""
    words, place = np.unique(bags.windows[chosen], return_inverse=True)
    place = place.reshape(len(chosen), -1)
    real = words[words >= 0]
    sizes = bags.row_sizes[real]
    index = np.repeat(bags.row_starts[real] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    rows = bags.rows[index]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    vectors = np.zeros((len(words), table.shape[1]), np.float32)
    if len(real):
        vectors[words >= 0] = np.add.reduceat(table[rows], starts) / sizes[:, None]
    n = bags.sizes[chosen]
    return vectors[place].sum(1) / n[:, None], (words, place, rows, sizes, n)


def train(texts: list[str], toxic: np.ndarray, settings: Settings = SETTINGS, least_epochs: int = 3, batch: int = 256, rate: float = 0.5, seed: int = 10) -> ToxicityModel:
    """Learns from a sample that fits the driver; toxic holds 0 and 1.

    A small sample is gone through more often: each round takes about ``settings.work`` windows, and all
    windows ``least_epochs`` times at least.
    """
    rng = np.random.default_rng(seed)
    toxic = np.asarray(toxic, bool)
    bags = _Bags(texts, settings)
    spare = rng.random(len(texts)) < 0.2 if min(toxic.sum(), (~toxic).sum()) >= 20 else np.zeros(len(texts), bool)
    learn = ~spare[bags.owner]
    target = toxic[bags.owner]

    def logits(chosen: np.ndarray) -> np.ndarray:
        out = np.empty(len(chosen))
        for a in range(0, len(chosen), 4096):
            pooled, _ = _pooled(bags, table, chosen[a : a + 4096])
            z = pooled @ softmax + bias
            out[a : a + 4096] = z[:, 1] - z[:, 0]
        return out

    table = rng.normal(0, 0.1, (1 << LOG2_ROWS, DIM)).astype(np.float32)
    softmax = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    g_table, g_softmax, g_bias = np.full(len(table), 1e-6, np.float32), np.full_like(softmax, 1e-6), np.full_like(bias, 1e-6)
    every = np.arange(len(target))
    for turn in range(settings.rounds):
        use = learn.copy()
        if turn:
            z = logits(every)
            best = np.full(len(texts), -np.inf)
            np.maximum.at(best, bags.owner, z)
            use &= ~target | (z > 0) | (z >= best[bags.owner])
        chosen = np.flatnonzero(use)
        y = target[chosen]
        weight = np.where(y, len(y) / max(1, 2 * y.sum()), len(y) / max(1, 2 * (~y).sum())).astype(np.float32)
        for _ in range(min(60, max(least_epochs, round(settings.work / max(1, len(chosen)))))):
            order = rng.permutation(len(chosen))
            for a in range(0, len(order), batch):
                part = order[a : a + batch]
                pooled, (words, place, rows, sizes, n) = _pooled(bags, table, chosen[part])
                z = pooled @ softmax + bias
                p = 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -30, 30)))
                err = ((p - y[part]) * weight[part] / len(part)).astype(np.float32)
                d_z = np.stack([-err, err], 1)
                d_pooled = (d_z @ softmax.T) / n[:, None].astype(np.float32)
                d_softmax, d_bias = pooled.T @ d_z + 1e-5 * softmax, d_z.sum(0)
                flat = place.ravel()
                by_word = np.argsort(flat, kind="stable")
                firsts = np.searchsorted(flat[by_word], np.arange(len(words)))
                d_words = np.add.reduceat(np.repeat(d_pooled, settings.window, 0)[by_word], firsts)[words >= 0]
                by_row = np.argsort(rows, kind="stable")
                own, firsts = np.unique(rows[by_row], return_index=True)
                d_rows = np.add.reduceat(np.repeat(d_words / sizes[:, None].astype(np.float32), sizes, 0)[by_row], firsts) if len(rows) else np.zeros((0, DIM), np.float32)
                g_table[own] += (d_rows**2).mean(1)
                table[own] -= rate * d_rows / np.sqrt(g_table[own])[:, None]
                g_softmax += d_softmax**2
                softmax -= 0.1 * d_softmax / np.sqrt(g_softmax)
                g_bias += d_bias**2
                bias -= 0.1 * d_bias / np.sqrt(g_bias)
    model = ToxicityModel((table @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0]), 1.0, 0.0, settings)
    held = np.flatnonzero(spare) if spare.any() else np.arange(len(texts))
    peak = np.array([model.window_logits(texts[i]).max() for i in held])
    model.scale, model.shift = _calibrate(peak, toxic[held])
    return model


def _calibrate(z: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Scale and shift of a logistic curve, by Newton steps with a little ridge; classes weigh alike."""
    weight = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum())) * len(y)
    x = np.stack([z, np.ones_like(z)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + 0.05 * (w - [1.0, 0.0])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(w[0]), 0.05), float(w[1])


def labelled_sample(docs: DataFrame, marks: DataFrame, label: str, per_class: int, seed: int, longest: int | None = None) -> DataFrame:
    """(doc_id, text, label) of at most about ``per_class`` documents of each class that may be learned from.

    Left out: ids with crc32 mod 3 equal to 1, null ids, null labels, ids with labels that contradict
    one another, and texts of more than ``longest`` characters. Rows that repeat count once; of an
    id's different texts the least is learned from. The chosen label rows are broadcast; their number
    is bounded by the parameter.
    """
    known = marks.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.where(id_remainder(F.col("doc_id"), 3) != 1).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    rates = [min(1.0, per_class / sizes[k]) if sizes.get(k) else 0.0 for k in (0, 1)]
    chosen = known.where(sample_hash(F.col("doc_id"), seed) < F.when(F.col("label") == 1, rates[1]).otherwise(rates[0]))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if longest is not None:
        texts = texts.where(F.length("text") <= longest)
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def fit(docs: DataFrame, marks: DataFrame, per_class: int = 1200, longest: int = 50_000) -> ToxicityModel | None:
    """Learns from the labels toxic of marks (doc_id, toxic); None unless both classes have examples.

    The sample of at most about 2 x ``per_class`` texts of up to ``longest`` characters is what the
    driver gets. It is sorted, so the model doesn't depend on the order of rows.
    """
    rows = labelled_sample(docs, marks, "toxic", per_class, 10, longest).toArrow().sort_by([("doc_id", "ascending")])
    toxic = rows["label"].to_numpy()
    if len(set(toxic.tolist())) < 2:
        return None
    return train(rows["text"].to_pylist(), toxic)


def compare(texts: list[str], toxic: np.ndarray, choices: list[Settings], parts: int = 3, seed: int = 3) -> list[dict]:
    """How well each of the settings does on texts that may be learned from, by cross-validation.

    texts and toxic are a sample as ``fit`` takes it. Each part is scored by a model that learned from
    the others. Gives recall and false positives at 0.7, and the share of pairs of a toxic text and
    another that are in the right order.
    """
    toxic = np.asarray(toxic, bool)
    part = np.random.default_rng(seed).integers(0, parts, len(texts))
    out = []
    for settings in choices:
        score = np.empty(len(texts))
        for k in range(parts):
            model = train([texts[i] for i in np.flatnonzero(part != k)], toxic[part != k], settings)
            for i in np.flatnonzero(part == k):
                score[i] = model.score(texts[i])
        others = np.sort(score[~toxic])
        right = np.searchsorted(others, score[toxic], "left") + np.searchsorted(others, score[toxic], "right")
        out.append({"settings": settings, "recall": float((score[toxic] >= 0.7).mean()), "false": float((others >= 0.7).mean()), "order": float(right.mean() / 2 / len(others))})
    return out


def scored(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """(doc_id, score) for each row of docs (doc_id, text), from 0 to 1. Null and empty texts score as a text without words; without a model, all score 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [model.score(t or "") if model else 0.0 for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(score, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity.

    A null or empty text scores as one without words; a very long one is read whole, window by
    window. Rows that repeat, and equal texts, have equal scores; a null id stays null, isn't held
    out and isn't learned from. No documents, no rows. Other columns aren't read.
    """
    docs = documents(spark, sf_dir)
    found = scored(docs, fit(docs, labels(spark, sf_dir)))
    held = F.coalesce(id_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
