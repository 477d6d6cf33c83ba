"""Where passages of a stated set stand in documents: word for word, from their beginning on, or in changed wording.

Each document is read once against all passages of a part, and nothing of it is shuffled.

* Beginnings (the first 60 characters, or all of a shorter passage) are found by an automaton of all of
  them, at any place in a word; a passage that goes on as it should is ``exact``, else it's a ``prefix``.
* Changed wording is a stretch of words into which the passage turns with at most d of its n words
  replaced, left out or added, where d = (1 - least) x n. An edit breaks two pairs of neighbouring words
  at most, so of any 2d + 1 pairs one is whole: each passage is known by its 2d + 1 rarest pairs, and a
  document's pairs are looked up among those. Hits of a passage on neighbouring diagonals (place in the
  document less place in the passage) make a window; a window with fewer than n - 1 - 2d of the
  passage's pairs can't hold it; the others are aligned, and the best one stays. No stretch of the
  asked-for likeness, which is 0.7 or more, is lost.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGINNING = 60
word_places = re.compile(r"\w+").finditer
words_of = re.compile(r"\w+").findall

FOUND = "doc_id long, item_id long, start int, end int, how string, similarity double"


def aligned(passage: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """The least number of edits that turn all of a passage into a stretch of a window, and where the first such stretch to end begins and ends.

    One row of costs is held, and for each place the beginning of the stretch that has this cost.
    """
    at = np.arange(len(window) + 1)
    cost, begin = np.zeros(len(at), np.int64), at
    for i, word in enumerate(passage, 1):
        across = cost[:-1] + (window != word)
        row, start = cost + 1, begin.copy()
        better = across <= row[1:]
        row[1:][better], start[1:][better] = across[better], begin[:-1][better]
        row[0] = i
        # A word of the window that the passage lacks: the cost of some place before, and one for each word since.
        least = np.minimum.accumulate(row - at)
        source = np.maximum.accumulate(np.where(row - at == least, at, 0))
        cost, begin = least + at, start[source]
    end = int(cost.argmin())
    return int(cost[end]), int(begin[end]), end


class Passages:
    """A part of the passages, ready to be found."""

    def __init__(self, texts: list[str], least: float | None):
        self.texts, self.least = texts, least
        self.beginnings = ahocorasick.Automaton()
        by_beginning: dict[str, list[int]] = {}
        for no, t in enumerate(texts):
            if t:
                by_beginning.setdefault(t[:BEGINNING], []).append(no)
        for beginning, numbers in by_beginning.items():
            self.beginnings.add_word(beginning, (len(beginning), numbers))
        if by_beginning:
            self.beginnings.make_automaton()
        if least is not None:
            self._seeds()

    def _seeds(self) -> None:
        split = [[w.lower() for w in words_of(t)] for t in self.texts]
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for own in split for w in own))}
        self.words = [np.array([self.vocabulary[w] for w in own], np.int64) for own in split]
        self.edits = [int((1 - self.least) * len(own) + 1e-9) for own in split]
        self.single: dict[int, list[int]] = {}  # passages of one word
        self.codes = [self.pairs(own) for own in self.words]
        often = Counter(c for own in self.codes for c in own.tolist())
        seeds = []
        for no, own in enumerate(self.codes):
            if len(self.words[no]) == 1:
                self.single.setdefault(int(self.words[no][0]), []).append(no)
            order = sorted(range(len(own)), key=lambda i: (often[int(own[i])], int(own[i]), i))
            seeds += [(int(own[i]), no, i) for i in order[: 2 * self.edits[no] + 1]]
        seeds.sort()
        self.seed_codes, self.seed_items, self.seed_places = (np.array(x, np.int64) for x in zip(*seeds)) if seeds else (np.zeros(0, np.int64),) * 3

    def pairs(self, words: np.ndarray) -> np.ndarray:
        """A number for each pair of neighbouring words; -1 if one of them is in no passage."""
        a, b = words[:-1], words[1:]
        return np.where((a >= 0) & (b >= 0), a * len(self.vocabulary) + b, -1)

    def begun(self, text: str) -> dict[int, tuple[int, int, str, float]]:
        """By passage: start, end, how and likeness, for those that stand in the text or begin there."""
        found: dict[int, tuple[int, int, str, float]] = {}
        if not len(self.beginnings):
            return found
        for last, (length, numbers) in self.beginnings.iter(text):
            at = last - length + 1
            for no in numbers:
                if no not in found or found[no][2] == "prefix":
                    whole = self.texts[no]
                    if text.startswith(whole, at):
                        found[no] = (at, at + len(whole), "exact", 1.0)
                    elif no not in found:
                        found[no] = (at, min(len(text), at + len(whole)), "prefix", length / len(whole))
        return found

    def reworded(self, text: str, known: set[int]) -> Iterator[tuple[int, int, int, float]]:
        """(passage, start, end, likeness) of those that stand in the text in changed wording, but for the known ones."""
        get = self.vocabulary.get
        words = np.array([get(w.lower(), -1) for w in words_of(text)], np.int64)
        codes = self.pairs(words)
        low, high = np.searchsorted(self.seed_codes, codes, "left"), np.searchsorted(self.seed_codes, codes, "right")
        hits = np.flatnonzero((high > low) & (codes >= 0))
        windows: dict[int, list[tuple[int, int]]] = {}
        if len(hits):
            times = high[hits] - low[hits]
            seed = np.repeat(low[hits] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            item, diagonal = self.seed_items[seed], np.repeat(hits, times) - self.seed_places[seed]
            order = np.lexsort((diagonal, item))
            item, diagonal = item[order], diagonal[order]
            allowed = np.array(self.edits)[item]
            new = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > 2 * allowed[1:])]))
            for a, b in zip(new, [*new[1:], len(item)]):
                no = int(item[a])
                if no not in known:
                    windows.setdefault(no, []).append((max(0, int(diagonal[a]) - self.edits[no]), int(diagonal[b - 1]) + len(self.words[no]) + self.edits[no]))
        for w in np.flatnonzero(np.isin(words, list(self.single))).tolist() if self.single else []:
            for no in self.single[int(words[w])]:
                if no not in known:
                    windows.setdefault(no, []).append((w, w + 1))
        places = None
        for no, own in windows.items():
            n, most = len(self.words[no]), self.edits[no]
            best = (most + 1, 0, 0)
            for a, b in own:
                if np.isin(self.codes[no], codes[a : max(a, b - 1)]).sum() >= n - 1 - 2 * most:
                    edits, start, end = aligned(self.words[no], words[a:b])
                    best = min(best, (edits, a + start, a + end))
            if best[0] <= most and best[2] > best[1]:
                places = places or list(word_places(text))
                yield no, places[best[1]].start(), places[best[2] - 1].end(), 1 - best[0] / n


def find_passages(docs: DataFrame, items: DataFrame, least: float | None = 0.7, query_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, item_id, start, end, how, similarity): for each row of docs (doc_id, text) and of items (item_id, text), where the item stands in the document.

    Places are numbers of characters, ends exclusive. The first exact place goes before the first
    beginning, that before the best place in changed wording (the least edits of words in any case, then
    the first). With ``least`` None only the first two are looked for. Passages are a stated set, read
    in parts of at most ``query_bytes``; a part is what the driver and a task hold. Null or empty
    passages and documents, and rows without an id, aren't found.
    """
    if least is not None and least < 0.7:
        raise ValueError("so many edits could break every pair of words")
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text <> ''")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text <> ''")
    size = asked.agg(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"] or 0
    parts, found = max(1, -(-size // query_bytes)), None
    for part in range(parts):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").toArrow()
        one = given.mapInArrow(_finding(own, least), FOUND)
        found = one if found is None else found.unionByName(one)
    return found


def _finding(asked: pa.Table, least: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = asked["item_id"].to_pylist()
        passages = Passages(asked["text"].to_pylist(), least) if ids else None
        for batch in batches if passages else []:
            out: list[tuple] = []
            for doc_id, cell in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                text = cell.as_py()
                begun = passages.begun(text)
                out += [(doc_id, ids[no], *at) for no, at in begun.items()]
                if least is not None:
                    out += [(doc_id, ids[no], start, end, "similar", likeness) for no, start, end, likeness in passages.reworded(text, set(begun))]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "item_id", "start", "end", "how", "similarity"])

    return run
