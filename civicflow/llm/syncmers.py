"""Document fingerprints from closed syncmers.

Of a text's k-mers (k code points), the closed syncmers are those whose least inner s-mer, by hash,
is the first or the last one. Whether a k-mer is one depends on nothing around it, so a shared
passage has the same anchors in every text that holds it, at the same distances: anchors of two texts
can be matched by hash and lined up by position. One in (k - s + 1) / 2 places or so is an anchor, and
no two neighbours are further apart than k - s.

A fingerprint holds all anchors of a text with their places, and so grows with it. Two fingerprints
are matched by hash, repeated hashes in their order, and a match counts if the one before or behind it
lies at the same shift: words that two texts share by chance don't line up, passages do. The likeness
is the share of anchors that count among those of both texts. Texts of under ``FINE_UNDER`` code
points have few anchors, so they carry a second level of finer ones, by which they are compared with
one another.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.llm.base import code_points, cut, documents, map_batches, spans_of, texts_of

K, S = 16, 5
FINE_K, FINE_S, FINE_UNDER = 6, 2, 256
_BASE = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _rolled(points: np.ndarray, n: int) -> np.ndarray:
    """A polynomial hash of each n-mer, built from those of half its length."""
    done, h, total = 0, np.zeros(0, np.uint64), np.uint64(0)
    power, width = points.astype(np.uint64) + np.uint64(1), 1
    while n:
        if n & 1:
            if done:
                shift = np.uint64(pow(_BASE, width, 1 << 64))
                m = min(len(h) - width, len(power))
                h = h[:m] * shift + power[done : done + m] if m > 0 else np.zeros(0, np.uint64)
                # h covers the first ``done`` points, the power part those behind them
                h = h[: max(0, len(points) - done - width + 1)]
            else:
                h = power
            done += width
        n >>= 1
        if n:
            m = len(power) - width
            power = power[:m] * np.uint64(pow(_BASE, width, 1 << 64)) + power[width : width + m] if m > 0 else np.zeros(0, np.uint64)
            width *= 2
    return h


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:]) if len(out) > have else out[:0]
        have *= 2
    rest = width - have
    return out if not rest else np.minimum(out[:-rest], out[rest:]) if len(out) > rest else out[:0]


def anchors(texts: list[str], k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, place and 64-bit hash of each anchor of some texts.

    A text of fewer than k code points has itself as its one anchor, an empty one none. A longer one
    without a syncmer, as can be under 2k, has its k-mer of least hash.
    """
    points, lengths = code_points(texts)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    owner = np.repeat(np.arange(len(texts)), lengths)
    whole = _mixed(_rolled(points, k))
    inner = _mixed(_rolled(points, s))
    least = _least(inner, k - s + 1)[: len(whole)]
    chosen = (inner[: len(whole)] == least) | (inner[k - s :][: len(whole)] == least)
    if len(whole):
        chosen &= owner[: len(whole)] == owner[k - 1 :]
    at = np.flatnonzero(chosen)
    who, where, value = owner[at], at - starts[owner[at]], whole[at]
    bare = np.setdiff1d(np.flatnonzero(lengths), who)
    if len(bare):
        more = []
        for d in bare:
            a, n = int(starts[d]), int(lengths[d])
            if n < k:
                more.append((d, 0, int.from_bytes(hashlib.blake2b(texts[d].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")))
            else:
                own = whole[a : a + n - k + 1]
                more.append((d, int(own.argmin()), int(own.min())))
        who = np.concatenate([who, [m[0] for m in more]])
        where = np.concatenate([where, [m[1] for m in more]])
        value = np.concatenate([value, np.array([m[2] for m in more], np.uint64)])
    return who, where, value


class Level(NamedTuple):
    """Anchors of a text in order: places and 32-bit hashes."""

    places: np.ndarray
    hashes: np.ndarray


Fingerprint = tuple[Level, ...]


def _levels(texts: list[str], k: int, s: int) -> list[Level]:
    who, where, value = anchors(texts, k, s)
    order = np.lexsort((where, who))
    bounds = np.searchsorted(who[order], np.arange(len(texts) + 1))
    where, value = where[order], (value[order] >> np.uint64(32)).astype(np.uint32)
    return [Level(where[x:y], value[x:y]) for x, y in zip(bounds, bounds[1:])]


def fingerprints_of(texts: list[str]) -> list[Fingerprint]:
    """For each text its anchors, and if it is short its finer ones as well."""
    out: list[Fingerprint] = []
    for a, b in spans_of(texts):
        part = texts[a:b]
        fine = iter(_levels([t for t in part if len(t) < FINE_UNDER], FINE_K, FINE_S))
        out += [(level, next(fine)) if len(t) < FINE_UNDER else (level,) for t, level in zip(part, _levels(part, K, S), strict=True)]
    return out


def _numbered(hashes: np.ndarray) -> np.ndarray:
    """For each hash, itself and how many like it came before, in one number."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    number = np.empty(len(hashes), np.uint64)
    number[order] = np.arange(len(hashes)) - np.repeat(first, np.diff(np.concatenate([first, [len(hashes)]])))
    return hashes.astype(np.uint64) << np.uint64(32) | number


def aligned(a: Level, b: Level) -> int:
    """How many anchors match at the shift of a match next to them. Of texts with one or two anchors, all matches count."""
    _, i, j = np.intersect1d(_numbered(a.hashes), _numbered(b.hashes), assume_unique=True, return_indices=True)
    if min(len(a.hashes), len(b.hashes)) < 3 or not len(i):
        return len(i)
    order = np.argsort(i)
    shift = b.places[j[order]] - a.places[i[order]]
    same = shift[1:] == shift[:-1]
    return int((np.concatenate([[False], same]) | np.concatenate([same, [False]])).sum())


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Share of the anchors of both that line up, by the finest level that both have; 1 for equal and for two empty ones."""
    x, y = (a[1], b[1]) if len(a) == len(b) == 2 else (a[0], b[0])
    if np.array_equal(x.hashes, y.hashes) and np.array_equal(x.places, y.places):
        return 1.0
    n = aligned(x, y)
    return n / (len(x.hashes) + len(y.hashes) - n)


def written(fingerprint: Fingerprint) -> str:
    """For each level, base64 of the gaps between places (a byte each) and of the hashes (four bytes each, the lowest first)."""
    parts = []
    for places, hashes in fingerprint:
        gaps = np.diff(places, prepend=0).astype(np.uint8)
        parts.append(base64.b64encode(gaps.tobytes()).decode() + "." + base64.b64encode(hashes.astype("<u4").tobytes()).decode())
    return "|".join(parts)


def read_fingerprint(text: str) -> Fingerprint:
    """What ``written`` wrote."""
    levels = []
    for part in text.split("|"):
        gaps, hashes = (base64.b64decode(x) for x in part.split("."))
        levels.append(Level(np.cumsum(np.frombuffer(gaps, np.uint8), dtype=np.int64), np.frombuffer(hashes, "<u4")))
    return tuple(levels)


def anchor_table(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """(doc_id, place, anchor) for each anchor of each row of docs (doc_id, text). Null texts are empty and have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = texts_of(batch["text"]), batch["doc_id"].cast(pa.int64())
            for a, b in spans_of(texts):
                who, where, value = anchors(texts[a:b], k, s)
                order = np.lexsort((where, who))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).take(pa.array(who[order])), pa.array(where[order]), pa.array(value[order].view(np.int64))], ["doc_id", "place", "anchor"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, place long, anchor long")


def common_places(table: DataFrame, least: int = 2) -> DataFrame:
    """(doc_id, with_id, shift, n) of an anchor table: n anchors of a document stand in another one, so far further on. A shared passage is one shift with many.

    An anchor's first place, by id and then place, stands for all: each other place is matched with it
    and not with one another, so an anchor of a third of all documents makes a row a place. Documents
    that share a passage meet in the one of the least id that has it. Matches within a document, and
    shifts of under ``least`` anchors, are left out, null ids too.
    """
    known = table.where("doc_id is not null")
    first = cut(known.groupBy("anchor").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.max("doc_id").alias("last")).where("last > first.doc_id").select("anchor", F.col("first.doc_id").alias("with_id"), F.col("first.place").alias("at")), "firsts")
    met = known.join(first, "anchor").where("doc_id <> with_id")
    return met.groupBy("doc_id", "with_id", (F.col("at") - F.col("place")).alias("shift")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) for each row of docs (doc_id, text), as ``written``. Null and empty texts have no anchors."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [written(f) for f in fingerprints_of(texts_of(batch["text"]))]
        return pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last half, rounded down, replaced by as many code points (or all) of another's start."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _bucket(key: Column, bounds: list[tuple[int, int]]) -> Column:
    """How many of the ascending bounds are under the key, a struct of two longs, by bisection."""
    if not bounds:
        return F.lit(0)
    table = F.array(*[F.struct(F.lit(k).cast("long").alias("key"), F.lit(t).cast("long").alias("tie")) for k, t in bounds])
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        more = (acc["lo"] < acc["hi"]) & (F.try_element_at(table, mid + 1) < key)
        less = (acc["lo"] < acc["hi"]) & ~(F.try_element_at(table, mid + 1) < key)
        return F.struct(F.when(more, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(less, mid).otherwise(acc["hi"]).alias("hi"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), halve)["lo"]


def _part_bounds(rows: DataFrame, parts: int) -> list[tuple[int, int]]:
    """Ascending bounds (key, tie) that cut rows (key, tie) into about so many parts of like size. The rows of a key that alone would fill several are cut by their ties, which are hashes."""
    found = rows.agg(F.count("*").alias("n"), F.percentile_approx("key", [i / parts for i in range(1, parts)] or [0.5], max(10_000, 4 * parts)).alias("at")).first()
    if parts < 2 or not found["n"]:
        return []
    keys = set(found["at"])
    share = max(1, found["n"] // parts)
    many = rows.where(F.col("key").isin(*keys)).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 2 * share).collect() if len(keys) < parts - 1 else []
    cuts = {(k, (1 << 63) - 1) for k in keys}
    for r in many:
        pieces = -(-r["n"] // share)
        cuts |= {(r["key"], (i << 64) // pieces - (1 << 63)) for i in range(pieces)}
    return sorted(cuts)


PART_BYTES, MOST_PARTS = 64 << 20, 10_000


def with_followers(docs: DataFrame, run, schema: str, parts: int | None = None) -> DataFrame:
    """Deals docs (doc_id, text) out in descending order of doc_id and calls ``run`` on each part's batches.

    A batch has the columns doc_id, text and extra; behind a part's own rows come those with extra,
    the first of which is the first row of the next part (after the last part: of the first). So each
    row's follower is in its part. Texts move once. Null ids come last; rows of one id go by the hash
    of their text, and are dealt to several parts if they are many. The number of parts follows the
    size of the texts, and what the driver gets is bounded by it, ``MOST_PARTS`` at most; a part is
    streamed, so it may be larger than memory.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("key"), F.xxhash64("text").alias("tie"))
    if parts is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = min(MOST_PARTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES)))
    bounds = _part_bounds(rows.select("key", "tie"), parts)
    at = F.struct("key", "tie")
    placed = rows.withColumn("part", _bucket(at, bounds).cast("int"))
    tops = {r["part"]: r["top"] for r in placed.groupBy("part").agg(F.max(at).alias("top")).collect()}
    used = sorted(tops)
    upper = {p: used[(i + 1) % len(used)] for i, p in enumerate(used)}  # the part whose last row is followed by this part's first
    lookup = lambda d: F.try_element_at(F.array(*[F.lit(d.get(i)).cast("long") for i in range(len(bounds) + 1)]), F.col("part") + 1)
    own = F.struct(F.col("part").alias("to"), F.lit(False).alias("extra"))
    copy = F.struct(lookup(upper).cast("int").alias("to"), F.lit(True).alias("extra"))
    top = (F.col("key") == lookup({p: t["key"] for p, t in tops.items()})) & (F.col("tie") == lookup({p: t["tie"] for p, t in tops.items()}))
    dealt = placed.select("doc_id", "text", "key", "tie", F.inline(F.when(top, F.array(own, copy)).otherwise(F.array(own))))
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("to")).sortWithinPartitions("to", "extra", F.desc("key"), F.desc("tie"))
    return dealt.select("doc_id", "text", "extra").mapInArrow(run, schema)


def compared(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): its fingerprint, that of its edited text, and how like it they and the follower's are.

    Null texts are empty. A lone row follows itself.
    """
    kinds = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def made(ids: list, texts: list[str], prints: list[Fingerprint]) -> pa.RecordBatch:
        """All rows but the last, which only follows."""
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        new = fingerprints_of(changed)
        cols = [
            ids[:-1], [len(t) for t in texts[:-1]], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
            [written(p) for p in prints[:-1]], [written(p) for p in new],
            [likeness(a, b) for a, b in zip(prints, new)], [likeness(a, b) for a, b in zip(prints, prints[1:])],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True)], [n for n, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, prints = [], [], []  # the last row so far, whose follower is to come
        ended = False
        for batch in batches:
            if not batch.num_rows or ended:
                continue
            extra = batch["extra"].to_pylist()
            own = extra.index(True) + 1 if True in extra else len(extra)  # the first extra row is the last follower
            ended = own <= len(extra) and True in extra
            every = texts_of(batch["text"].slice(0, own))
            numbers = batch["doc_id"].slice(0, own).to_pylist()
            for a, b in spans_of(every):
                ids, texts, prints = ids + numbers[a:b], texts + every[a:b], prints + fingerprints_of(every[a:b])
                if len(ids) > 1:
                    yield made(ids, texts, prints)
                ids, texts, prints = ids[-1:], texts[-1:], prints[-1:]

    return with_followers(docs, run, schema)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness and the follower's.

    Null and empty texts have no anchors, and two of them are alike; a very long text has all its
    anchors in its fingerprint. Equal texts have equal fingerprints. Rows of one id go by the hash of
    their text, and null ids come last. A lone document follows itself. No documents, no rows. Other
    columns aren't read.
    """
    return compared(documents(spark, sf_dir))
