"""BPE encoding and decoding, word by word, with contiguous rank arrays.

A short word is held as two arrays in step: its parts, one between each two boundaries, and the ranks
of adjacent parts, one a boundary. The least rank is found by a scan, its boundary is deleted so that
the two parts become the one that the rank makes, and the two neighbouring ranks are looked up anew,
until nothing merges. Both arrays are a few dozen numbers in a row, so scanning beats any heap. A
longer word, for which scans would take quadratic time, uses a heap over linked parts with the same
result. Words seen before come from a bounded cache. Decoding reads nothing but the ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from civicflow.llm.base import documents
from civicflow.llm.packing import Encoder

SHORT = 192
_NEVER = 1 << 60


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {c: chr(c) for c in printing} | {c: chr(256 + i) for i, c in enumerate(c for c in range(256) if c not in printing)}


class WordBpe:
    """Encodes and decodes with a tokenizer file that has NFC, white space and lower-case normalisers, a split pattern, byte-level letters and a word-end mark.

    Normalising and splitting are done here for texts of characters on which every Unicode version
    agrees; the file's own normaliser and splitter handle the others. Merging is always done here.
    """

    def __init__(self, path: str, most_words: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path) as f:
            kind = json.load(f)
        model = kind["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {self.ids[a] << 32 | self.ids[b]: i for i, (a, b) in enumerate(merges)}
        self.made = [self.ids[a + b] for a, b in merges]  # the part that each rank makes
        self.special = {t["content"]: t["id"] for t in kind["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.written = {i: str(i) for i in self.tokens}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None
        self.own = Tokenizer.from_file(path)
        self.plain = re.compile(Encoder.PLAIN).fullmatch
        self.split = regex.compile(kind["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.letters = byte_letters()
        self.most_words = most_words
        self.known: dict[str, tuple[int, ...]] = {}
        self.known_letters: dict[str, tuple[int, ...]] = {}

    def parts(self, letters: str) -> list[int]:
        """The ids of a word in byte letters. A letter that the vocabulary lacks has none."""
        part = [self.ids.get(c) for c in (*letters[:-1], letters[-1] + self.end)]
        if None in part:
            part = [p for p in part if p is not None]
        if len(part) > SHORT:
            return self._long(part)
        rank, made = self.ranks.get, self.made
        ranks = [rank(a << 32 | b, _NEVER) for a, b in zip(part, part[1:])]
        while ranks and (least := min(ranks)) != _NEVER:
            i = ranks.index(least)
            part[i] = made[least]
            del part[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(part[i] << 32 | part[i + 1], _NEVER)
            if i:
                ranks[i - 1] = rank(part[i - 1] << 32 | part[i], _NEVER)
        return part

    def _long(self, part: list[int | None]) -> list[int]:
        """The same for a long word."""
        rank = self.ranks.get
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(len(part) - 1) if (r := rank(part[i] << 32 | part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            least, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= len(part) or part[j] != b:
                continue  # one of the two has merged since
            part[i], part[j], after[i] = self.made[least], None, after[j]
            if after[i] < len(part):
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < len(part) and (r := rank(part[left] << 32 | part[right])) is not None:
                    heapq.heappush(heap, (r, left, part[left], part[right]))
        return [p for p in part if p is not None]

    def _words(self, text: str) -> list[tuple[int, ...]]:
        """The ids of each word of a text without special tokens."""
        if self.plain(text):
            words = self.split(text.replace("Σ", "σ").lower())
            try:
                return [self.known[w] for w in words]
            except KeyError:
                new = {w for w in words if w not in self.known}
                if len(self.known) + len(new) > self.most_words:
                    self.known.clear()
                    new = set(words)
                for w in new:
                    self.known[w] = tuple(self.parts(w.encode().decode("latin-1").translate(self.letters)))
                return [self.known[w] for w in words]
        out = []
        for letters, _ in self.own.pre_tokenizer.pre_tokenize_str(self.own.normalizer.normalize_str(text)):
            if (found := self.known_letters.get(letters)) is None:
                if len(self.known_letters) >= self.most_words // 4:
                    self.known_letters.clear()
                found = self.known_letters[letters] = tuple(self.parts(letters))
            out.append(found)
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        if self.cut and any(x in text for x in self.special):
            return list(chain.from_iterable(chain.from_iterable([(self.special[p],)] if p in self.special else self._words(p) for p in self.cut(text) if p)))
        return list(chain.from_iterable(self._words(text)))

    def decode(self, ids: list[int]) -> str:
        """Tokens of the ids, joined by spaces, as a file without a decoder says; an unknown id is left out."""
        return " ".join(filter(None, map(self.tokens.get, ids)))

    def digits(self, ids: list[int]) -> str:
        """Known ids as decimal numbers, joined by spaces."""
        return " ".join(map(self.written.__getitem__, ids))


@lru_cache(2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


_KINDS = {"n_tokens": (pa.int64(), "long"), "ids": (pa.list_(pa.int32()), "array<int>"), "decoded": (pa.string(), "string"), "ids_sha256": (pa.string(), "string"), "decoded_sha256": (pa.string(), "string")}


def encoded(docs: DataFrame, columns: tuple[str, ...] = ("ids",), vocabulary: str | None = None) -> DataFrame:
    """doc_id and the chosen columns for each row of docs (doc_id, text): ids, decoded, their number and digests.

    A null text is an empty one: no ids, decoded to an empty text. Repeated rows give equal rows.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in columns}
            for text in batch["text"].to_pylist():
                ids = bpe.encode(text or "")
                row = {"n_tokens": len(ids), "ids": ids}
                if "ids_sha256" in columns:
                    row["ids_sha256"] = hashlib.sha256(bpe.digits(ids).encode()).hexdigest()
                if "decoded" in columns or "decoded_sha256" in columns:
                    row["decoded"] = bpe.decode(ids)
                    row["decoded_sha256"] = hashlib.sha256(row["decoded"].encode()).hexdigest()
                for c in columns:
                    out[c].append(row[c])
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), *[pa.array(out[c], _KINDS[c][0]) for c in columns]], ["doc_id", *columns])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} {_KINDS[c][1]}" for c in columns))


def decoded(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, decoded) for rows of (doc_id, ids). Null ids are none."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            texts = [bpe.decode(i or []) for i in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and digests of each document's ids, and the digest of the text that the ids decode to.

    A null or empty text has no ids and decodes to an empty text; a very long one is encoded whole,
    and a very long word by a heap. Equal texts and rows that repeat give equal rows; a null id stays
    null. Ranks have no ties; of equal pairs the first merges first. No documents, no rows. Other
    columns aren't read.
    """
    return encoded(documents(spark, sf_dir), ("n_tokens", "ids_sha256", "decoded_sha256"))
