"""Best-fit packing of tokenised documents into training sequences.

A document's ids, with an end id behind them, become one piece if they fit into a sequence; a longer
document is cut into full pieces, behind a first one that may be shorter. Full pieces are sequences of
their own. The others are packed by bounded-space best fit: a task takes pieces one by one and puts
each into the fullest open sequence with room for it. Open sequences are kept by their free space, and
a bitset of the free spaces in use finds the best fit with two bit operations. At most ``open_bins``
stay open; beyond that the fullest closes first.

Pieces arrive in the order of a hash. A task looks ``AHEAD`` pieces ahead: it takes so many, packs
them in descending length, and goes on with the next ones, while the open sequences stay open. So
memory is bounded by the two parameters, however many pieces a task has. Only lengths, not ids, are
moved to the packing tasks. The number of tasks follows the number of pieces, and each leaves some
``open_bins`` sequences at most that more pieces could have filled.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from civicflow.llm.base import cut, documents, quoted

CAPACITY = 1024
END_ID = 2
OPEN_BINS = 1024
AHEAD = 2048
PIECES_PER_TASK = 200_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of a byte-level BPE tokenizer file, as little-endian unsigned 32-bit numbers.

    Plain texts are encoded by a faster engine from the same file's vocabulary. That is exact if the
    file's merges come in the order of their ids, which is looked up, and if both engines split the
    text alike: texts with a special token's string in them, or with characters outside ``PLAIN``,
    on whose class the engines' patterns may differ, go to the tokenizer itself.
    """

    #: Fixed value: the split pattern of byte-level BPE.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    PLAIN = r"[\t\n\r -~¡-ɏͰ-ͳΑ-ϿЀ-ҁҊ-ԯ‐-‧‰-⁞€ぁ-ゖァ-ヺ一-龥가-힣]*"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the only parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.plain = re.compile(self.PLAIN).fullmatch
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self._fast(path)

    def _fast(self, path: str) -> tiktoken.Encoding | None:
        with open(path) as f:
            kind = json.load(f)
        pre, model = kind["pre_tokenizer"], kind["model"]
        if kind["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
            return None
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])):
            return None
        # Byte-level vocabularies write the bytes that don't print as the code points from 256 on.
        printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
        as_byte = {chr(c): c for c in printing} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in printing)}
        ranks = {bytes(as_byte[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
        return tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is not None and self.plain(text) and not any(s in text for s in self.special):
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) for each piece of each row of docs (doc_id, text).

    A null text is empty and so one piece of the end id. Repeated rows give repeated pieces.
    """
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            ids: list[bytes] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                data = own.encode(text or "") + tail
                total = len(data) // 4
                first = (total - 1) % capacity + 1
                for no, (a, b) in enumerate(zip([0, *range(first, total, capacity)], range(first, total + 1, capacity), strict=True)):
                    part = data[4 * a : 4 * b]
                    out.append((doc_id, no, a, b - a, zlib.crc32(part)))
                    if keep_ids:
                        ids.append(part)
            cols = list(zip(*out, strict=True)) or [()] * 5
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


class BestFit:
    """Bounded-space online best fit over one stream of lengths."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.used = 0  # bit f: some open sequence has f free places
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = self.opened = self.closed = 0

    def put(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of the next piece."""
        fitting = self.used >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            sequence = self.by_free[free].pop()
            if not self.by_free[free]:
                self.used ^= 1 << free
            self.n_open -= 1
        else:
            free, sequence = self.capacity, self.opened
            self.opened += 1
        rest = free - length
        if rest:
            if self.n_open == self.open_bins:
                self._close_fullest()
            self.by_free[rest].append(sequence)
            self.used |= 1 << rest
            self.n_open += 1
        return sequence, self.capacity - free

    def _close_fullest(self) -> None:
        free = (self.used & -self.used).bit_length() - 1
        self.by_free[free].pop()
        if not self.by_free[free]:
            self.used ^= 1 << free
        self.n_open -= 1
        self.closed += 1

    def put_all(self, lengths: list[int], ahead: int) -> tuple[list[int], list[int]]:
        """Sequences and offsets of some pieces, taken ``ahead`` at a time in descending length, equal ones in order."""
        sequences, offsets = [0] * len(lengths), [0] * len(lengths)
        for a in range(0, len(lengths), ahead):
            for i in sorted(range(a, min(a + ahead, len(lengths))), key=lengths.__getitem__, reverse=True):
                sequences[i], offsets[i] = self.put(lengths[i])
        return sequences, offsets


def pack(parts: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, per_task: int = PIECES_PER_TASK, ahead: int = AHEAD) -> DataFrame:
    """parts (with a column length from 1 to capacity, and others) with sequence_id and offset added.

    Pieces are taken in the order of a hash of their columns, and then of the columns, so a repeated
    task packs alike; rows that repeat are pieces of their own. Columns called sequence_id or offset
    are replaced. parts is counted and read again: hand in a table or the result of ``cut``.
    """
    parts = parts.drop("sequence_id", "offset")
    tasks = max(1, -(-parts.count() // per_task))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        bins = BestFit(capacity, open_bins)
        for batch in batches:
            sequences, offsets = bins.put_all(batch["length"].to_pylist(), ahead)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([base + s for s in sequences], pa.int64()), pa.array(offsets, pa.int64())], [*batch.schema.names, "sequence_id", "offset"])

    own = parts.columns
    parts = parts.select(*[F.col(quoted(c)).alias(c if c == "length" else f"c{i}") for i, c in enumerate(own)])  # names without dots
    others = [F.col(c) for c, kind in parts.dtypes if "map<" not in kind and "variant" not in kind]
    dealt = parts.repartition(tasks).sortWithinPartitions(F.xxhash64(*others), *others)
    placed = dealt.mapInArrow(run, T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    return placed.toDF(*own, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The pieces of docs (doc_id, text) with their places in sequences; with ``keep_ids`` their ids as well."""
    return pack(cut(pieces(docs, tokenizer or default_tokenizer(), capacity, keep_ids=keep_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids) of packed pieces that hold their ids: the training rows, each of bounded size."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return rows.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places.

    A null or empty text is one piece of the end id; a very long one is as many pieces as it takes.
    Rows that repeat give pieces of their own. A null id stays null. Ties of length go by hash and
    then by the columns. No documents, no pieces. Other columns of documents aren't read.
    """
    return pack_documents(documents(spark, sf_dir))
