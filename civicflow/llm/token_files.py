"""Token ids in Arrow files: batches of fixed-size lists that are read without copying.

A file is in Arrow's IPC file format, the stream format with a footer of batch positions. Its columns:

* ``ids``: fixed-size list of ``LENGTH`` unsigned ids, 16 bits wide if the vocabulary fits, else 32;
* ``mask``: fixed-size list of as many bits: set for an id, not for what fills up the file's last sequence;
* ``last``: fixed-size list of as many bits: set for the last id of a document;
* ``ended``: the ids of the documents that end in the sequence, in order.

Every batch but the last has ``BATCH`` sequences, so sequence i is row i % BATCH of batch i // BATCH,
and where the file is mapped into memory its arrays are views of the mapping. Documents follow
one another in ascending order and cross sequences freely; none crosses files.

Documents are dealt to tasks by ranges of their ids, so texts are shuffled once; a task encodes its
range and writes files as it goes, holding one batch of sequences and one of texts. The rows that
tell of a file come from the attempt of the task that ended, and names are unique, so a file left by
a lost executor belongs to nothing. Where a file's ids start among all is a running sum over files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicflow.llm.base import cut, shared_dir
from civicflow.llm.packing import END_ID, default_tokenizer, encoder

LENGTH = 1024
BATCH = 256
FILE_SEQUENCES = 1 << 16
FILES = "task int, roll int, path string, n_docs long, n_ids long, n_sequences long"


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or of a plain path."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class SequenceWriter:
    """Writes one file; ids beyond whole batches wait for more."""

    def __init__(self, uri: str, length: int = LENGTH, batch: int = BATCH, wide: bool = False):
        self.length, self.batch, self.kind = length, batch, np.dtype("<u4" if wide else "<u2")
        self.schema = pa.schema([
            ("ids", pa.list_(pa.uint32() if wide else pa.uint16(), length)),
            ("mask", pa.list_(pa.bool_(), length)),
            ("last", pa.list_(pa.bool_(), length)),
            ("ended", pa.list_(pa.int64())),
        ], {"batch": str(batch)})
        system, path = located(uri)
        self._out = system.open_output_stream(path)
        self._file = pa.ipc.new_file(self._out, self.schema)
        self._ids, self._last = np.empty(0, self.kind), np.empty(0, bool)
        self._ended: list[int | None] = []  # of the documents that end in what waits
        self.n_docs = self.n_ids = self.n_sequences = 0

    def add(self, doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Appends documents: their ids end to end, and how many each has (at least one)."""
        last = np.zeros(len(ids), bool)
        last[np.cumsum(sizes) - 1] = True
        self._ids = np.concatenate([self._ids, ids.astype(self.kind)])
        self._last = np.concatenate([self._last, last])
        self._ended += doc_ids
        self.n_docs += len(doc_ids)
        self.n_ids += len(ids)
        whole = len(self._ids) // (self.length * self.batch)
        for _ in range(whole):
            self._write(self.batch)

    def _write(self, rows: int) -> None:
        size = rows * self.length
        n = min(size, len(self._ids))  # the file's last sequence is filled up
        ids, mask, last = np.zeros(size, self.kind), np.arange(size) < n, np.zeros(size, bool)
        ids[:n], last[:n] = self._ids[:n], self._last[:n]
        self._ids, self._last = self._ids[n:], self._last[n:]
        ends = np.concatenate([[0], np.cumsum(last.reshape(rows, self.length).sum(1))]).astype(np.int32)
        ended, self._ended = self._ended[: ends[-1]], self._ended[ends[-1] :]
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask, last)]
        self._file.write_batch(pa.record_batch([*lists, pa.ListArray.from_arrays(pa.array(ends), pa.array(ended, pa.int64()))], schema=self.schema))
        self.n_sequences += rows

    def close(self) -> None:
        if len(self._ids):
            self._write(-(-len(self._ids) // self.length))
        self._file.close()
        self._out.close()


class SequenceFile:
    """A file's sequences by number. On a local file system batches are views of the mapped file, and so are arrays of ids."""

    def __init__(self, uri: str):
        system, path = located(uri)
        self._source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
        self._file = pa.ipc.open_file(self._source)
        self.length = self._file.schema.field("ids").type.list_size
        self._batch = int(self._file.schema.metadata[b"batch"])
        self.batches = self._file.num_record_batches

    def __len__(self) -> int:
        return (self.batches - 1) * self._batch + self._file.get_batch(self.batches - 1).num_rows if self.batches else 0

    def batch(self, i: int) -> pa.RecordBatch:
        return self._file.get_batch(i)

    def ids(self, i: int) -> np.ndarray:
        """The ids of a batch, a row for each sequence."""
        return self.batch(i)["ids"].values.to_numpy(zero_copy_only=True).reshape(-1, self.length)

    def bits(self, i: int, column: str = "mask") -> np.ndarray:
        """The bits of a batch's mask or last ids as booleans, a row for each sequence."""
        return self.batch(i)[column].values.to_numpy(zero_copy_only=False).reshape(-1, self.length)

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """A sequence's ids and its mask."""
        b, row = divmod(i, self._batch)
        return self.ids(b)[row], self.batch(b)["mask"].values.slice(row * self.length, self.length)

    def documents(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
        """For each batch: starts in the file, sizes and checksums of the documents that end in it, and their ids."""
        at, carried, crc = 0, 0, 0  # ids before the batch; of the document that is open, how many and their checksum
        for i in range(self.batches):
            flat = self.ids(i).reshape(-1).astype("<u4", copy=False)
            stops = np.flatnonzero(self.bits(i, "last")) + 1
            begins = np.concatenate([[0], stops])
            crcs = np.empty(len(stops), np.int64)
            for n, (a, b) in enumerate(zip(begins, stops)):
                crcs[n] = zlib.crc32(memoryview(flat[a:b]).cast("B"), crc if n == 0 else 0)
            sizes = np.diff(begins)
            starts = at + begins[:-1]
            if len(stops):
                sizes[0] += carried
                starts[0] -= carried
                carried = crc = 0
            yield starts, sizes, crcs, self.batch(i)["ended"].values
            rest = flat[begins[-1] : np.count_nonzero(self.bits(i))]
            carried += len(rest)
            crc = zlib.crc32(memoryview(rest).cast("B"), crc)
            at += len(flat)


def write_sequences(docs: DataFrame, folder: str, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, batch: int = BATCH, file_sequences: int = FILE_SEQUENCES) -> DataFrame:
    """Writes the ids of docs (doc_id, text), each with the end id behind it, into files below folder; returns a row for each file.

    Files are in the order of (task, roll). A null text is an empty one. Null ids come first, texts of
    one id come by their hash, and rows that repeat are written as often as they come. A file is closed
    behind the document with which it reaches ``file_sequences`` sequences.
    """
    path = tokenizer or default_tokenizer()
    system, root = located(folder)
    system.create_dir(root, recursive=True)

    tail = np.array([end_id], "<u4").tobytes()

    def encoded(rows: pa.RecordBatch) -> Iterator[tuple[list[int | None], list[bytes]]]:
        """Document ids and their ids' bytes, in parts of about a batch of sequences."""
        own, doc_ids, parts, size = encoder(path), [], [], 0
        for doc_id, text in zip(rows["doc_id"].to_pylist(), rows["text"], strict=True):
            doc_ids.append(doc_id)
            parts.append(own.encode(text.as_py() or "") + tail)
            size += len(parts[-1])
            if size >= 4 * length * batch:
                yield doc_ids, parts
                doc_ids, parts, size = [], [], 0
        if parts:
            yield doc_ids, parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, out, name = TaskContext.get().partitionId(), [], None, ""
        wide = max(encoder(path).tokenizer.get_vocab_size(), end_id + 1) > 1 << 16
        for doc_ids, parts in (part for rows in batches for part in encoded(rows)):
            if out is None:
                name = f"{folder}/{task:06}-{len(done):04}-{uuid.uuid4().hex}.arrow"
                out = SequenceWriter(name, length, batch, wide)
            out.add(doc_ids, np.frombuffer(b"".join(parts), "<u4"), np.array([len(p) // 4 for p in parts]))
            if out.n_ids >= file_sequences * length:
                out.close()
                done.append((task, len(done), name, out.n_docs, out.n_ids, out.n_sequences))
                out = None
        if out is not None:
            out.close()
            done.append((task, len(done), name, out.n_docs, out.n_ids, out.n_sequences))
        if done:
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], ["task", "roll", "path", "n_docs", "n_ids", "n_sequences"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    # The row's number lets copies of one row, however many, lie in several ranges.
    dealt = rows.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "text")
    return cut(dealt.mapInArrow(run, FILES), "files")


def with_starts(files: DataFrame, block: int = 1024) -> DataFrame:
    """files with the column start, the ids in all files before: a running sum within blocks of tasks, and one over the blocks' sums."""
    blocks = files.withColumn("block", F.floor(F.col("task") / block))
    sums = blocks.groupBy("block").agg(F.sum("n_ids").alias("of_block"))
    before = F.coalesce(F.sum("of_block").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.coalesce(F.sum("n_ids").over(Window.partitionBy("block").orderBy("task", "roll").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = blocks.withColumn("inner", inner).join(sums.select("block", before.alias("before")), "block")
    return met.select(*files.columns, (F.col("before") + F.col("inner")).cast("long").alias("start"))


def documents_in(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, as the files have them; a task reads whole files, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for path, start in zip(rows["path"].to_pylist(), rows["start"].to_pylist(), strict=True):
                for starts, sizes, crcs, ids in SequenceFile(path).documents():
                    if len(ids):
                        yield pa.RecordBatch.from_arrays([ids, pa.array(starts + start, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = with_starts(files).select("path", "start").repartition(max(1, files.count()))
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def sequences_in(files: DataFrame) -> DataFrame:
    """(path, sequence, ids, mask) of every sequence: training rows of equal length, numbered within their file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for path in rows["path"].to_pylist():
                file, at = SequenceFile(path), 0
                for i in range(file.batches):
                    ids, n = file.ids(i), file.batch(i).num_rows
                    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * file.length)
                    lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(ids.reshape(-1).astype(np.int32)), file.batch(i)["mask"].values)]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(at, at + n)), *lists], ["path", "sequence", "ids", "mask"])
                    at += n

    return files.select("path").repartition(max(1, files.count())).mapInArrow(run, "path string, sequence long, ids array<int>, mask array<boolean>")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the token files, its number of ids and their checksum, read back from the files.

    A null or empty text is the end id alone; a very long one crosses as many sequences as it takes.
    Null ids come first; documents of one id come in the order of their text's hash, and rows that
    repeat are written as often as they come. No documents, no files and no rows. Other columns of
    documents aren't read.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return documents_in(write_sequences(docs, f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"))
