"""SimHash near-duplicates with pivot distance tables.

A text's fingerprint has 64 bits, the majority of its word shingles' hashes. Fingerprints that differ
in at most ``RADIUS`` bits are linked, and linked documents form groups. Each fingerprint has a row in
a pivot table: its Hamming distances to ``PIVOTS`` reference fingerprints, which are drawn from the
corpus. By the triangle inequality no coordinate of two linked fingerprints differs by more than the
radius. Within a bucket, fingerprints are sorted by the coordinate that spreads most there, and only
those within a radius of each other along it become pairs; of these, a pair with a larger difference
in any other coordinate is dropped, and survivors are verified bit by bit.

Distances of 64-bit fingerprints to a pivot crowd around 32, so ranges of a few coordinates don't
split a corpus: alone, the table would leave nearly all pairs to be looked at. Buckets come from
agreeing bit blocks: the bits are cut into m blocks, and of two linked fingerprints at least
m - RADIUS blocks are equal, so that each pair meets under some choice of m - RADIUS blocks. m grows
with the logarithm of the number of fingerprints, to keep what meets by chance at a few a bucket.
Neither step loses a link.

Equal fingerprints are one row before pairs are sought. A bucket never becomes a list of its pairs:
its links come out as a spanning forest. A bucket beyond ``CHUNK`` fingerprints is cut into chunks
that meet two by two, as tasks of their own. Beyond ``MOST_CHUNKS`` chunks a fingerprint would be
copied more often than it has centres, so such a bucket is linked through these: all values within
half the radius of a fingerprint, by flips of bits that the bucket doesn't fix. Two fingerprints have
a centre in common if and only if they are within the radius, so every link is found, work grows with
the bucket and not with its square, and no centre has more fingerprints than a fingerprint centres.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.llm.base import cut, documents, fresh, map_batches
from civicflow.operators.components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
PIVOTS = 24
CHUNK = 2048
MOST_CHUNKS = 512


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text: A-Z lower-cased, words split at ASCII white space, shingles with repeats.

    A text of fewer words is one shingle; one without words has fingerprint 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for each row; fp is the unsigned fingerprint's bits as a long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch["text"].cast(pa.binary()).to_pylist()
        found = np.fromiter((fingerprint(t or b"", shingle) for t in texts), np.uint64, len(texts))
        return pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, spread by a fixed generator."""
    return np.random.default_rng(64).integers(0, 1 << 64, n, np.uint64, endpoint=False)


def corpus_pivots(distinct: DataFrame, n: int = PIVOTS) -> np.ndarray:
    """The n fingerprints of a corpus (fp) that are first by a hash; made-up ones behind them if there are fewer."""
    rows = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(n).collect()
    return np.concatenate([np.array([r["fp"] for r in rows], np.int64).view(np.uint64), pivots(n)])[:n]


def pivot_table(fps: np.ndarray, references: np.ndarray) -> np.ndarray:
    """A row of Hamming distances to the reference fingerprints for each fingerprint."""
    return np.bitwise_count(fps[:, None] ^ references[None, :]).astype(np.int8)


def blocks_for(n: int, radius: int = RADIUS, most: int = 4) -> list[int]:
    """Bit masks, one for each choice of blocks, of which any two fingerprints within the radius agree on one.

    The number of blocks is the least for which n fingerprints meet at most ``most`` others by chance.
    """
    for m in range(radius + 1, 2 * radius + 3):
        edges = [64 * i // m for i in range(m + 1)]
        blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
        masks = [sum(c) for c in combinations(blocks, m - radius)]
        if n / 2 ** min(x.bit_count() for x in masks) <= most:
            break
    return masks


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of rows after the links (a, b): each row's label is the least row that it is linked with."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, short := new[new]):
            new = short
        if np.array_equal(new, label):
            return label
        label = new


def links_in_runs(runs: np.ndarray, fps: np.ndarray, radius: int, references: np.ndarray, counts: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among rows of the same run; runs are consecutive.

    counts gets the numbers of pairs that meet, are formed, are left by the pivot table, and are links.
    """
    counts = Counter() if counts is None else counts
    n = len(fps)
    starts = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
    sizes = np.diff(np.concatenate([starts, [n]]))
    wide = np.repeat(sizes > 1, sizes)
    fps, sizes = fps[wide], sizes[sizes > 1]
    if not len(fps):
        return fps, fps
    counts["met"] += int((sizes * (sizes - 1) // 2).sum())
    table = pivot_table(fps, references)
    run, begin = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    total = np.add.reduceat(table, begin, dtype=np.int64)
    spread = np.add.reduceat(np.square(table, dtype=np.int64), begin) * sizes[:, None] - total**2
    along = table[np.arange(len(fps)), spread.argmax(1)[run]]  # each run's most telling coordinate
    order = np.lexsort((fps, along, run))
    fps, table, along = fps[order], table[order], along[order]
    after = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(fps)) - 1  # rows of the run behind each row
    label, live = np.arange(len(fps)), np.arange(len(fps))
    for step in range(1, int(sizes.max(initial=1))):
        live = live[after[live] >= step]
        live = live[along[live + step] - along[live] <= radius]  # those further on are further off
        if not len(live):
            break
        a, b = live, live + step
        counts["formed"] += len(live)
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        for part in range(0, len(references), 8):  # most pairs by chance go at the first coordinates
            near = (np.abs(table[a, part : part + 8] - table[b, part : part + 8]) <= radius).all(1)
            a, b = a[near], b[near]
        counts["left"] += len(a)
        true = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        counts["links"] += int(true.sum())
        if true.any():
            label = _settle(label, a[true], b[true])
    child = np.flatnonzero((label != np.arange(len(fps))) & (fps != fps[label]))
    return fps[child], fps[label[child]]


def _linked(rows: DataFrame, keys: list[str], chunk: int, radius: int, references: np.ndarray) -> DataFrame:
    """Links (a, b) among the fingerprints of each key; runs over ``chunk`` come out as (keys, chunk_no, a) instead.

    rows: keys and fp, dealt by the keys and sorted by them.
    """
    kept = [f"k{i}" for i in range(len(keys))]

    def whole(now: np.ndarray, done: dict) -> Iterator[pa.RecordBatch]:
        """Links of runs that have ended; what is left of, or is itself, a long run goes into chunks."""
        if not now.shape[1]:
            return
        new = np.concatenate([[True], (now[:-1, 1:] != now[:-1, :-1]).any(0)])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.concatenate([starts, [now.shape[1]]]))
        short = np.ones(len(sizes), bool)
        for i in np.flatnonzero(sizes > chunk) if chunk and not done else range(len(sizes)) if done else ():
            at = tuple(now[:-1, starts[i]].tolist())
            if at in done or sizes[i] > chunk:
                short[i] = False
                number = done.pop(at, 0)
                for k in range(starts[i], starts[i] + sizes[i], chunk):
                    yield chunked(now[:, k : min(k + chunk, starts[i] + sizes[i])], number)
                    number += 1
        rows_in = np.repeat(short, sizes)
        a, b = links_in_runs(np.repeat(np.arange(len(sizes)), sizes)[rows_in], now[-1, rows_in].view(np.uint64), radius, references)
        if len(a):
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), *[none] * (len(kept) + 1)], ["a", "b", *kept, "chunk_no"])

    def chunked(now: np.ndarray, number: int) -> pa.RecordBatch:
        n = now.shape[1]
        cols = [pa.array(now[-1].copy()), pa.nulls(n, pa.int64()), *[pa.array(x.copy()) for x in now[:-1]], pa.array(np.full(n, number))]
        return pa.RecordBatch.from_arrays(cols, ["a", "b", *kept, "chunk_no"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(keys) + 1, 0), np.int64)  # the run that may go on in the next batch
        done: dict = {}  # chunks that this run has given so far
        for batch in batches:
            if not batch.num_rows:
                continue
            now = np.concatenate([held, np.stack([batch[c].to_numpy() for c in (*keys, "fp")])], axis=1)
            edge = int(np.flatnonzero(np.concatenate([[True], (now[:-1, 1:] != now[:-1, :-1]).any(0)]))[-1])
            yield from whole(now[:, :edge], done)
            held, at = now[:, edge:], tuple(now[:-1, edge].tolist())
            while chunk and held.shape[1] > chunk:
                yield chunked(held[:, :chunk], number := done.get(at, 0))
                held, done[at] = held[:, chunk:], number + 1
        yield from whole(held, done)

    return rows.mapInArrow(run, f"a long, b long, {', '.join(f'{k} long' for k in kept)}, chunk_no long")


def flips(mask: int, radius: int) -> np.ndarray:
    """All words of at most half the radius of bits, none of them in the mask; the radius is even."""
    free = [1 << i for i in range(64) if not mask >> i & 1]
    return np.array([sum(bits) for n in range(radius // 2 + 1) for bits in combinations(free, n)], np.uint64).view(np.int64)


def linked_by_centres(rows: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Links (a, b) of rows (k0, fp) that have a centre in common; k0 is the number of the mask that their buckets come from.

    Flips leave the mask's bits as they are, so fingerprints of different buckets share no centre.
    """

    def centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, fp = batch["k0"].to_numpy(), batch["fp"].to_numpy()
            for k in np.unique(table).tolist():
                own, by = fp[table == k], flips(masks[k], radius)
                for at in range(0, len(own), 256):
                    part = own[at : at + 256]
                    n = len(part) * len(by)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k)), pa.array((part[:, None] ^ by[None, :]).ravel()), pa.array(np.repeat(part, len(by)))], ["k0", "centre", "fp"])

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # mask, centre and first fingerprint of the run that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            table, centre, fp = (batch[c].to_numpy() for c in ("k0", "centre", "fp"))
            new = np.concatenate([[last is None or last[:2] != (table[0], centre[0])], (table[1:] != table[:-1]) | (centre[1:] != centre[:-1])])
            firsts = np.concatenate([[last[2] if last else 0], fp[new]])[np.cumsum(new)]
            last = (table[-1], centre[-1], firsts[-1])
            linked = fp != firsts
            yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(firsts[linked])], ["a", "b"])

    met = rows.select("k0", "fp").mapInArrow(centres, "k0 long, centre long, fp long")
    return met.repartition("k0", "centre").sortWithinPartitions("k0", "centre", "fp").mapInArrow(stars, "a long, b long").distinct()


def links(distinct: DataFrame, radius: int = RADIUS, chunk: int = CHUNK, most_chunks: int = MOST_CHUNKS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp), enough of them to connect all that are within the radius of one another.

    Buckets of over ``most_chunks`` chunks are linked by centres; with an odd radius, by chunks like others.
    """
    masks, references = blocks_for(distinct.count(), radius), corpus_pivots(distinct)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = distinct.select("fp", F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)])))
    met = keyed.repartition("table", "bits").sortWithinPartitions("table", "bits", "fp")
    first = cut(_linked(met, ["table", "bits"], chunk, radius, references), "links")
    long = first.where("chunk_no is not null").select("k0", "k1", "chunk_no", F.col("a").alias("fp"))
    if long.isEmpty():
        return first.select("a", "b")
    most = long.groupBy("k0", "k1").agg(F.max("chunk_no").alias("most"))
    sized = long.join(most, ["k0", "k1"]).select("k0", "k1", "chunk_no", "fp", "most")
    wide = (F.col("most") >= most_chunks) if radius % 2 == 0 else F.lit(False)
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("most", F.lit(1))))
    pairs = sized.where(~wide).select("k0", "k1", "chunk_no", "fp", others.alias("other")).where("chunk_no <> other")
    pairs = pairs.select("k0", "k1", F.least("chunk_no", "other").alias("k2"), F.greatest("chunk_no", "other").alias("k3"), "fp")
    keys = ["k0", "k1", "k2", "k3"]
    second = _linked(pairs.repartition(*keys).sortWithinPartitions(*keys, "fp"), keys, 0, radius, references)
    found = first.where("chunk_no is null").select("a", "b").unionByName(second.select("a", "b"))
    if not most.where(wide).isEmpty():
        found = found.unionByName(linked_by_centres(sized.where(wide), masks, radius))
    return found


def near_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs (doc_id, text).

    component_id is the smallest id of the documents that the row's one is linked with, directly or
    through others, itself included; null ids don't count, so it is null where no linked row has an
    id. Null texts are empty; texts without words have fingerprint 0 and link like any other.
    """
    own = cut(fingerprints(docs, shingle), "fingerprints")
    distinct = cut(own.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("least")), "distinct")
    root = cut(components(links(distinct.select(F.col("node").alias("fp")), radius)), "roots")
    return own.join(group_names(distinct, root), F.col("fp") == F.col("node"), "left").select("doc_id", "fp", "component_id")


def group_names(distinct: DataFrame, root: DataFrame) -> DataFrame:
    """(node, component_id) for each node of distinct (node, least): the least of all that share its root, or its own.

    Written between joins, so that those on a root or node with very many rows read shuffles that can be split.
    """
    linked = root.join(distinct.withColumnRenamed("node", "n"), F.col("node") == F.col("n")).select("node", "root", "least")
    first = cut(linked.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id")), "groups")
    named = linked.join(first, F.col("root") == F.col("r")).select(F.col("node").alias("n"), "component_id")
    every = distinct.join(named, F.col("node") == F.col("n"), "left")
    return cut(every.select("node", F.when(F.col("n").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")), "names")


def without_later(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without the documents whose group, by found (doc_id, component_id), has one of a smaller id. Rows without an id stay, as no group can name them."""
    gone = fresh(docs.columns, "gone")
    later = found.where("doc_id is not null").groupBy(F.col("doc_id").alias(gone)).agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    return docs.join(later.where("not stays").select(gone), F.col("doc_id") == F.col(gone), "left_anti")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs without the documents whose group has one of a smaller id."""
    return without_later(docs, near_groups(docs, shingle, radius))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest id that it is linked with.

    Null and empty texts, and others without words, have fingerprint 0 and link like any other; a very
    long text is read whole. A bit that half of the hashes have is 0. Rows that repeat have equal
    rows; a null id stays null and names no group. No documents, no rows. Other columns aren't read.
    """
    found = near_groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
