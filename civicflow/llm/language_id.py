"""Language identification with bit-sliced Bloom filters over character n-grams.

One table of slots serves up to 64 languages: bit l of a slot says that some n-gram of language l
falls there; more languages have further tables of the same slots. The AND of an n-gram's slots is
therefore the set of all languages that contain it, up to false positives. A text's votes per
language are the popcounts of these sets, less the number that the language's fill rate makes false;
the language with most votes wins.

The filters are learned from a sample of at most about ``per_language`` documents of each language
(drawn by a hash of the id; the bound is the documented parameter of the fit). An n-gram enters a
language's filter if it came at least ``least`` times there (once, in a language of few examples) and
at a rate of at least ``share`` of its highest rate in any language, so that n-grams borrowed from
another language don't count. The sample's bound bounds the n-grams of a language, and so the fill of
its bits.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.llm.base import code_points, cut, documents, id_remainder, map_batches, quoted, sample_hash, spans_of, texts_of

GRAM_SIZES = (2, 3, 4)
HASHES = 2
UNKNOWN = "und"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_STEP = np.uint64(0x100000001B3)


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: itself in lower case, or a space unless it is a letter or mark; and whether it is a letter."""
    fold = np.full(0x110000, 32, np.uint32)
    letter = np.zeros(0x110000, bool)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            low = chr(c).lower()
            fold[c] = ord(low) if len(low) == 1 else c
            letter[c] = kind == "L"
    return fold, letter


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters of all texts with one space between words and around each text; lengths; numbers of letters."""
    fold, letter = _letters()
    points, lengths = code_points([f" {t} " for t in texts])
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    n_letters = np.add.reduceat(letter[points], starts, dtype=np.int64) if len(points) else np.zeros(0, np.int64)
    points = fold[points]
    keep = points != 32
    keep[1:] |= points[:-1] != 32
    keep[starts] = True
    kept = np.add.reduceat(keep, starts, dtype=np.int64) if len(points) else lengths
    return points[keep], kept, n_letters


def gram_hashes(points: np.ndarray) -> dict[int, np.ndarray]:
    """For each size, a hash of the n-gram that starts at each place."""
    wide = points.astype(np.uint64) + np.uint64(1)
    found, h = {}, wide
    for n in range(2, max(GRAM_SIZES) + 1):
        h = h[: len(h) - 1] * _STEP + wide[n - 1 :] if len(h) else h
        if n in GRAM_SIZES:
            found[n] = h
    return found


def slots_of(h: np.ndarray, log2_slots: int) -> list[np.ndarray]:
    return [(h * m) >> np.uint64(64 - log2_slots) for m in _MIX[:HASHES]]


@dataclass
class LanguageModel:
    languages: list[str]
    tables: dict[int, np.ndarray]  # for each size, the slots of the first 64 languages
    fill: dict[int, np.ndarray]
    log2_slots: int
    usual: int = 0
    further: dict[int, list[np.ndarray]] = field(default_factory=dict)  # for each size, a table for each next 64 languages

    def votes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Votes of each text for each language, the number of n-grams, and the number of letters."""
        points, lengths, n_letters = folded(texts)
        ends = np.cumsum(lengths)
        total, grams = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        owner = np.repeat(np.arange(len(texts)), lengths)
        for n, h in gram_hashes(points).items():
            first, second = slots_of(h, self.log2_slots)
            cross = (ends[:-1, None] - np.arange(1, n)).ravel()  # these n-grams run into the next text
            count = np.maximum(lengths - n + 1, 0)
            hits = np.empty_like(total)
            for word, table in enumerate([self.tables[n], *self.further.get(n, [])]):
                sets = table[first] & table[second]
                sets[cross[(cross >= 0) & (cross < len(sets))]] = 0
                own = range(64 * word, min(64 * word + 64, len(self.languages)))
                if table.dtype == np.uint8:
                    by_set = np.bincount(owner[: len(sets)] * 256 + sets, minlength=len(texts) * 256).reshape(-1, 256)
                    for b in own:
                        hits[:, b] = by_set[:, (np.arange(256) >> b) & 1 == 1].sum(1)
                else:
                    for b in own:
                        bit = (sets >> np.uint64(b - 64 * word)) & np.uint64(1)
                        hits[:, b] = np.bincount(owner[: len(sets)], weights=bit, minlength=len(texts))
            false = self.fill[n] ** HASHES
            total += np.maximum(0, (hits - count[:, None] * false) / np.maximum(1 - false, 1e-6))
            grams += count
        return total, grams, n_letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, share of the votes, and share of the text's n-grams that the language knows."""
        if not texts:
            return [], np.zeros(0), np.zeros(0)
        votes, grams, n_letters = (np.concatenate(x) for x in zip(*(self.votes(texts[a:b]) for a, b in spans_of(texts)), strict=True))
        rows, best = np.arange(len(texts)), votes.argmax(1)
        most, every = votes[rows, best], votes.sum(1)
        best = np.where(most > 0, best, self.usual)
        none = n_letters == 0
        score = np.where(none | (every == 0), 0.0, most / np.maximum(every, 1e-9))
        known = np.where(none, 0.0, np.minimum(1.0, most / np.maximum(grams, 1)))
        return [UNKNOWN if x else self.languages[b] for x, b in zip(none, best, strict=True)], score, known


def fit(
    docs: DataFrame,
    per_language: int = 3000,
    log2_slots: int = 20,
    least: int = 3,
    share: float = 0.25,
    exclude_remainder: tuple[int, int] | None = (4, 2),
    seed: int = 9,
    most_languages: int = 10_000,
) -> LanguageModel | None:
    """Learns the filters from (doc_id, text, lang).

    Rows with a null id, text or lang are not learned from, nor those whose id hash has the excluded
    remainder. All languages are learned. None if there is nothing to learn from. What reaches the
    driver is bounded by the filters' size, which grows with the number of languages by 64. A column
    of more than ``most_languages`` values holds something else than languages and is an error.
    """
    known = docs.select("doc_id", "text", "lang").where("doc_id is not null and lang is not null and text is not null")
    if exclude_remainder:
        known = known.where(id_remainder(F.col("doc_id"), exclude_remainder[0]) != exclude_remainder[1])
    counted = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages + 1).collect()
    if len(counted) > most_languages:
        raise ValueError(f"the column lang has more than {most_languages} values")
    if not counted:
        return None
    languages = sorted(r["lang"] for r in counted)
    rate = F.create_map(*[F.lit(x) for r in counted for x in (r["lang"], min(1.0, per_language / r["count"]))])
    sample = known.where(sample_hash(F.col("doc_id"), seed) < rate[F.col("lang")])
    index = {x: i for i, x in enumerate(languages)}

    def grams(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, langs = texts_of(batch["text"]), batch["lang"].to_pylist()
        out: list[tuple] = []
        for lang in set(langs):
            own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            for a, b in spans_of(own):
                points, lengths, _ = folded(own[a:b])
                for n, h in gram_hashes(points).items():
                    cross = (np.cumsum(lengths)[:-1, None] - np.arange(1, n)).ravel()
                    value, count = np.unique(np.delete(h, cross[(cross >= 0) & (cross < len(h))]), return_counts=True)
                    out.append((np.full(len(value), index[lang]), np.full(len(value), n), value.view(np.int64), count))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["lang_no", "n", "gram", "times"])

    counts = map_batches(sample.select("text", "lang"), grams, "lang_no long, n long, gram long, times long")
    counts = cut(counts.groupBy("n", "gram", "lang_no").agg(F.sum("times").alias("times")), "grams")
    sums = {(r["n"], r["lang_no"]): r["total"] for r in counts.groupBy("n", "lang_no").agg(F.sum("times").alias("total")).collect()}
    weight = F.create_map(*[F.lit(x) for k, v in sums.items() for x in (k[1] * 8 + k[0], 1.0 / v)]) if sums else None
    words = range((len(languages) + 63) // 64)
    tables = {n: [np.zeros(1 << log2_slots, np.uint64) for _ in words] for n in GRAM_SIZES}
    if sums:
        rated = counts.withColumn("rate", F.col("times") * weight[F.col("lang_no") * 8 + F.col("n")])
        per_gram = rated.groupBy("n", "gram").agg(F.collect_list(F.struct("lang_no", "times", "rate")).alias("seen"), F.max("rate").alias("most"))
        examples = {r["lang"]: r["count"] for r in counted}
        needed = F.array(*[F.lit(least if examples[x] >= 10 * least else 1) for x in languages])
        member = F.filter("seen", lambda x: (x["times"] >= F.element_at(needed, (x["lang_no"] + 1).cast("int"))) & (x["rate"] >= share * F.col("most")))
        bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), (x["lang_no"] % 64).cast("int"))
        mask = lambda w: F.aggregate(F.filter("kept", lambda x: F.floor(x["lang_no"] / 64) == w), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(bit(x)))
        masks = F.inline(F.array(*[F.struct(F.lit(w).cast("long").alias("word"), mask(w).alias("mask")) for w in words]))
        kept = per_gram.select("n", "gram", member.alias("kept")).select("n", "gram", masks).where("mask != 0")

        def place(batch: pa.RecordBatch) -> pa.RecordBatch:
            h = batch["gram"].to_numpy(zero_copy_only=False).view(np.uint64)
            parts = slots_of(h, log2_slots)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.tile(batch["n"].to_numpy(), HASHES)), pa.array(np.tile(batch["word"].to_numpy(), HASHES)), pa.array(np.concatenate(parts).astype(np.int64)), pa.array(np.tile(batch["mask"].to_numpy(), HASHES))],
                ["n", "word", "slot", "mask"],
            )

        placed = map_batches(kept, place, "n long, word long, slot long, mask long").groupBy("n", "word", "slot").agg(F.bit_or("mask").alias("mask"))
        if len(words) > 1:
            placed = cut(placed, "filters")
        for word in words:
            got = placed.where(F.col("word") == word).toArrow()  # at most sizes x slots rows
            n, at, bits = (got[c].to_numpy() for c in ("n", "slot", "mask"))
            for size in GRAM_SIZES:
                own = n == size
                tables[size][word][at[own]] = bits[own].view(np.uint64)
    fill = {n: np.array([((t[b // 64] >> np.uint64(b % 64)) & np.uint64(1)).mean() for b in range(len(languages))]) for n, t in tables.items()}
    own = {n: t[0].astype(np.uint8) if len(languages) <= 8 else t[0] for n, t in tables.items()}
    return LanguageModel(languages, own, fill, log2_slots, index[counted[0]["lang"]], {n: t[1:] for n, t in tables.items()})


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, lang_pred, score, known) for each row of docs (doc_id, text).

    ``und`` with score 0 for texts without a letter, nulls among them, and for all texts if there is
    no model. Ties go to the language first in order; a text without any known n-gram gets the
    commonest language with score 0. Repeated rows and equal texts get equal answers.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch["text"])
        lang, score, known = model.predict(texts) if model else ([UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)))
        return pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score), pa.array(known)], ["doc_id", "lang_pred", "score", "known"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, known double")


def keep_identified(docs: DataFrame, model: LanguageModel | None, least_known: float = 0.05) -> DataFrame:
    """The rows of docs whose text is in a learned language, with all their columns.

    A text without letters goes, and one of whose n-grams under ``least_known`` belong to the
    language found. Without a model, everything goes.
    """

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            if model is None:
                continue
            lang, _, known = model.predict(texts_of(batch["text"]))
            yield batch.filter(pa.array([x != UNKNOWN and k >= least_known for x, k in zip(lang, known, strict=True)], pa.bool_()))

    every = docs.select(*[F.col(quoted(c)).alias(f"c{i}" if c != "text" else "text") for i, c in enumerate(docs.columns)])
    return every.mapInArrow(run, every.schema).toDF(*docs.columns)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, and the shares of its votes and of its known n-grams.

    A null text, an empty one, or one without a letter is ``und`` with score 0; a very long one is read
    whole. Ties go to the language first in order. Rows that repeat, and equal texts, get equal
    answers; a null id stays null and isn't learned from. No documents, no rows. Of the columns of
    documents, doc_id, text and, in learning, lang are read.
    """
    docs = documents(spark, sf_dir)
    found = identify(docs, fit(docs))
    held = F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "known")
