"""Near-duplicate clusters of comments within blocks (dockets).

exact groups -> cleaned texts -> token gate -> word shingles -> frequent shingles dropped -> MinHash ->
banded LSH -> connected components -> check against the representative -> mapper of every document.

Shuffles: one by (block, digest) for exact groups, without texts; one by id that brings the texts of
representatives; one by (block, shingle) that counts shingles, which combine before they move; one by
(block, band) for buckets; and two a round for components, on link rows only. A document's shingles
stay an array in its row from the text to the signature. A bucket's members are linked to its least
member, never to one another, so a bucket of n texts makes n - 1 links. Joins on a block, root or
digest that may hold very many rows read shuffles that adaptive execution can split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicflow.functions.batches import by_parts, cuts, lists, rows_of
from civicflow.operators.components import components
from civicflow.operators.retrieval import split_words
from civicflow.storage import cut

try:  # for short texts nearly twice as fast as OpenSSL's
    from _md5 import md5
except ImportError:
    from hashlib import md5

PERMUTATIONS, BANDS, ROWS = 128, 9, 13
PRIME = (1 << 31) - 1
HALF = 30  # bits of the lower part of a shingle's hash, of 60 in all
MIN_TOKENS, SHINGLE, MOST_COMMON, LEAST_LIKE = 80, 5, 0.2, 0.5
BUCKETS, ITEMS = 1 << 16, 1 << 21  # of shingles of a block; shingles that a task counts
PART_ROWS, PART = 1 << 14, 1 << 20  # documents and shingles that Python counts at a time
CANDIDATES = 4096  # of a block, that may be common


def exact_groups(docs: DataFrame, block: str, doc_id: str, text: str) -> DataFrame:
    """(block, rep, copies) for each distinct text of a block; rep is the least id."""
    key = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("digest")
    return docs.groupBy(block, key).agg(F.min(doc_id).alias("rep"), F.count("*").alias("copies"))


def shingle_hashes(text: str, k: int = SHINGLE) -> np.ndarray:
    """60 bits of the md5 of each distinct run of k tokens, which any SQL engine can compute; a text of fewer tokens has its token suffixes."""
    return run_hashes(_tokens(text), k)


_wide_spaces = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search


def _tokens(text: str) -> list[bytes]:
    """What ``split_words`` gives, in UTF-8; bytes split at the same ASCII characters, twice as fast."""
    if text.isascii() or not _wide_spaces(text):
        return text.encode("utf-8", "surrogatepass").split()
    return [w.encode("utf-8", "surrogatepass") for w in split_words(text)]


def run_hashes(own: list[bytes], k: int = SHINGLE) -> np.ndarray:
    n = len(own)
    runs = set(map(b" ".join, zip(*[own[i:] for i in range(k)]))) if n >= k else {b" ".join(own[i:]) for i in range(n)}
    digests = b"".join([md5(r).digest() for r in runs])
    return (np.frombuffer(digests, ">u8")[::2] >> np.uint64(4)).astype(np.int64)


def shingled(rows: DataFrame, text: str, k: int = SHINGLE, least: int = 0) -> DataFrame:
    """rows with n_chars, n_tokens and hashes in place of a text: the hashes of its distinct shingles, null if it has fewer than ``least`` tokens. No row moves.

    In Arrow batches: a text is split once for its count and its shingles, without an object of the
    engine for each token.
    """
    kept = [f for f in rows.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField("n_chars", T.IntegerType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("hashes", T.ArrayType(T.LongType()))])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in cuts(batch[text]):
                part = batch.slice(at, n)
                texts = [t or "" for t in part[text].to_pylist()]
                tokens = [_tokens(t) for t in texts]
                hashes = lists([run_hashes(w, k) if len(w) >= least else None for w in tokens])
                counts = [pa.array(list(map(len, x)), pa.int32()) for x in (texts, tokens)]
                yield pa.RecordBatch.from_arrays([*[part[f.name] for f in kept], *counts, hashes], names)

    return rows.mapInArrow(run, schema)


def shingle_arrays(docs: DataFrame, block: str, doc_id: str, text: str, k: int = SHINGLE, least: int = 0) -> DataFrame:
    """(block, id, hashes): the hashes of each document's distinct shingles; documents of fewer than ``least`` tokens are left out."""
    own = docs.select(F.col(block).alias("block"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return shingled(own, "text", k, least).where("hashes is not null").select("block", "id", "hashes")


def _bucketed(rows: DataFrame) -> DataFrame:
    """(block, shingle, bucket) of rows (block, id, hashes): a row for each shingle of each document."""
    return rows.select("block", F.explode("hashes").alias("shingle")).withColumn("bucket", F.col("shingle").bitwiseAND(F.lit(BUCKETS - 1)))


def _loads(rows: DataFrame) -> DataFrame:
    """(block, bucket, load): a shingle is in no more documents than its bucket's load. A task counts ``BUCKETS`` a block at most."""
    return _bucketed(rows).groupBy("block", "bucket").agg(F.count("*").alias("load"))


def document_frequency(rows: DataFrame, items: int = ITEMS) -> DataFrame:
    """(block, shingle, df) of rows (block, id, hashes).

    Shingles are dealt to tasks of about ``items`` rows, so that a task's memory doesn't grow with the
    table. Those of buckets with very many rows are combined before they move, as one of them may be
    very frequent. rows is read several times: hand in a table or the result of ``cut``.
    """
    loads = cut(_loads(rows), "loads")
    n = loads.agg(F.sum("load").alias("n"), F.avg("load").alias("mean")).first()
    hot = cut(loads.where(F.col("load") > max(items // 8, 4 * (n["mean"] or 0))).select("block", "bucket"), "hot")
    count, every = F.count("*").alias("df"), _bucketed(rows)
    rest = every.join(hot, ["block", "bucket"], "left_anti").select("block", "shingle").repartition(1 + (n["n"] or 0) // items, "block", "shingle").groupBy("block", "shingle").agg(count)
    return rest if hot.isEmpty() else rest.unionByName(every.join(hot, ["block", "bucket"]).groupBy("block", "shingle").agg(count))


def _often(rows: DataFrame, most: float) -> DataFrame:
    """(block, shingle): shingles that are in more than this share of a block's documents in some part of a task's rows. A shingle that is in more of all of the block's documents is in more of some part's."""
    schema = T.StructType([T.StructField("block", rows.schema["block"].dataType), T.StructField("shingle", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in cuts(batch["hashes"], PART_ROWS, PART):
                part = batch.slice(at, n)
                block = pc.dictionary_encode(part["block"], null_encoding="encode")
                of, hashes = block.indices.to_numpy(zero_copy_only=False), list(rows_of(part["hashes"]))
                for i in range(len(block.dictionary)):
                    own = [hashes[j] for j in np.flatnonzero(of == i)]
                    values, df = np.unique(np.concatenate(own), return_counts=True)
                    values = values[df > most * len(own)]
                    yield pa.RecordBatch.from_arrays([block.dictionary.take(pa.array(np.full(len(values), i))), pa.array(values)], ["block", "shingle"])

    return rows.where("block is not null").select("block", "hashes").mapInArrow(run, schema).distinct()


def drop_common(rows: DataFrame, most: float | None = MOST_COMMON, candidates: int = CANDIDATES) -> DataFrame:
    """rows (block, id, hashes) without the shingles that are in more than max(1, int(most x n)) of the block's n documents, and without rows that are left with none.

    A block's common shingles are few, at most 1 / most times a document's average number (in a
    block of under 2 / most documents, half of all its shingles at most), so they come to the rows as an
    array. Only shingles that are common in some part of the rows can be common: where a block has no
    more than ``candidates`` of these, they come to the rows likewise and are counted; blocks of few
    documents a part may have more, and there all shingles are counted. rows is read several times:
    hand in a table or the result of ``cut``.
    """
    if most is not None:
        sizes = rows.groupBy("block").agg(F.count("*").alias("n"))
        limits = cut(sizes.select("block", F.greatest(F.lit(1), F.floor(F.col("n") * most).cast("int")).alias("limit")), "limits")
        often = cut(_often(rows, most), "often")
        numbers = cut(often.groupBy("block").agg(F.count("*").alias("number")), "numbers")
        few = often.join(numbers.where(F.col("number") <= candidates), "block").groupBy("block").agg(F.collect_list("shingle").alias("often"))
        found = rows.join(cut(few, "few"), "block").select("block", F.explode(F.array_intersect("hashes", "often")).alias("shingle"))
        many = numbers.where(F.col("number") > candidates).select("block")
        if not many.isEmpty():
            found = found.unionByName(rows.join(many, "block").select("block", F.explode("hashes").alias("shingle")))
        counted = found.groupBy("block", "shingle").agg(F.count("*").alias("df"))
        frequent = counted.join(limits, "block").where(F.col("df") > F.col("limit"))
        common = cut(frequent.groupBy(F.col("block").alias("b")).agg(F.collect_list("shingle").alias("common")), "common")
        met = rows.join(common, F.col("block").eqNullSafe(F.col("b")), "left")
        rows = met.select("block", "id", F.when(F.col("common").isNull(), F.col("hashes")).otherwise(F.array_except("hashes", "common")).alias("hashes"))
    return rows.where(F.size("hashes") > 0)


def family(n: int = PERMUTATIONS) -> list[tuple[int, int, int]]:
    """The numbers (a, b, c) of the hash functions h -> (a x upper half + b x lower half + c) mod 2^31 - 1, from a small generator."""
    out, x = [], 20240229
    for _ in range(n):
        own = []
        for _ in range(3):
            x = (x * 48271) % PRIME
            own.append(x)
        out.append(tuple(own))
    return out


@cache
def _multipliers() -> np.ndarray:
    """A row for each function: what a unit of each 15-bit piece of a hash, from the lower half's low one up, adds to value / PRIME modulo 1, and c with half a step of 1 / PRIME more."""
    return np.array([[b / PRIME, (b << 15) % PRIME / PRIME, a / PRIME, (a << 15) % PRIME / PRIME, (c + 0.5) / PRIME] for a, b, c in family()])


def least_values(hashes: np.ndarray) -> np.ndarray:
    """The least value of each function over some hashes, in parts of bounded size.

    (a x upper + b x lower + c) / PRIME modulo 1 is the fraction of a product of matrices, as hashes
    are cut into pieces of 15 bits. Sums are under 2^17, so doubles are off by less than 2^-34 in all;
    the half step of 2^-32 by which c is larger keeps that from reaching another multiple of 1 / PRIME.
    The order is that of the values.
    """
    by, found = _multipliers(), np.ones(PERMUTATIONS)
    for i in range(0, hashes.size, 256):
        h = hashes[i : i + 256]
        pieces = np.ones((5, h.size))
        for k in range(4):
            pieces[k] = (h >> (15 * k)) & 0x7FFF
        v = by @ pieces
        v -= np.floor(v)
        np.minimum(found, v.min(1), out=found)
    return (found * PRIME).astype(np.int64)


def _signature(c: str) -> Column:
    return by_parts(lambda rows: lists([least_values(h) for h in rows_of(rows)]), "array<bigint>")(c)


def signatures(rows: DataFrame) -> DataFrame:
    """(block, id, signature) of rows (block, id, hashes), none of them empty: the least value of each function over a document's shingles."""
    return rows.select("block", "id", _signature("hashes").alias("signature"))


def band_keys(signed: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(block, id, band, key, key2): 128 bits of hashes of each band's values."""
    own = [F.slice("signature", b * rows + 1, rows) for b in range(bands)]
    parts = F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(v).alias("key"), F.xxhash64(F.lit("again"), v).alias("key2")) for b, v in enumerate(own)])
    return signed.select("block", "id", F.inline(parts))


def bucket_links(signed: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Links (a, b) of each bucket's members to its least one."""
    keys, bucket = band_keys(signed, bands, rows), ["block", "band", "key", "key2"]
    least = keys.groupBy(*bucket).agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keys.join(least, bucket).where("id <> b").select(F.col("id").alias("a"), "b").distinct()


def likeness(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / F.lit(float(PERMUTATIONS))


def cluster(docs: DataFrame, block: str = "docket", doc_id: str = "id", text: str = "text", cleaner=None, min_tokens: int = MIN_TOKENS, most_common: float | None = MOST_COMMON, bands: int = BANDS, rows: int = ROWS, least_like: float = LEAST_LIKE) -> DataFrame:
    """(block, id, rep, cluster, reason) for every document: the cluster is named by its least member.

    reason says why a document stands where it does: ``clustered``, ``ejected`` (unlike its
    representative), ``alone``, ``short`` (under the token gate) or ``common`` (only frequent
    shingles). Ids must be longs. The representative of a cluster has the longest cleaned text, the
    least id on ties.
    """
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    own = docs.select(F.col(block).alias("block"), F.col(doc_id).alias("id"), digest.alias("digest"))
    first = own.groupBy("block", "digest").agg(F.min("id").alias("id"))
    texts = docs.select(F.col(doc_id).alias("own_id"), F.col(text).alias("text"))
    clean = cleaner(F.col("text")) if cleaner else F.lower(F.coalesce("text", F.lit("")))
    reps = first.join(texts.hint("merge"), F.col("id") == F.col("own_id")).select("block", "digest", "id", clean.alias("clean"))
    reps = cut(shingled(reps, "clean", least=min_tokens), "reps", packed=False)
    gated = reps.where("hashes is not null")
    signed = cut(signatures(drop_common(gated.select("block", "id", "hashes"), most_common)), "signatures")
    roots = cut(components(bucket_links(signed, bands, rows)).select(F.col("node").alias("id"), "root"), "roots")
    member = cut(roots.join(signed.select("id", "signature"), "id").join(gated.select("id", F.col("n_chars").alias("len")), "id"), "members")
    best = cut(member.groupBy("root").agg(F.max_by("signature", F.struct("len", -F.col("id"))).alias("best")), "best")
    judged = member.join(best, "root").select("id", "root", (likeness(F.col("signature"), F.col("best")) >= least_like).alias("stays"))
    state = reps.select("block", "digest", "id", "n_tokens").join(judged, "id", "left").join(signed.select("id", F.lit(True).alias("signed")), "id", "left")
    reason = F.when(F.col("stays"), "clustered").when(F.col("stays").isNotNull(), "ejected").when(F.col("n_tokens") < min_tokens, "short").when(F.col("signed").isNull(), "common").otherwise("alone")
    group = F.when(F.col("stays"), F.col("root")).otherwise(F.col("id"))
    placed = state.select("block", "digest", F.col("id").alias("rep"), group.alias("group"), reason.alias("reason"))
    # A cluster is named by its least member that stays.
    placed = cut(placed.withColumn("kept", F.col("reason") == "clustered"), "placed")
    names = cut(placed.groupBy("group", "kept").agg(F.min("rep").alias("cluster")), "names")
    named = cut(placed.join(names, ["group", "kept"]).select(F.col("block").alias("b"), F.col("digest").alias("d"), "rep", "cluster", "reason"), "named")
    return own.join(named, (F.col("digest") == F.col("d")) & F.col("block").eqNullSafe(F.col("b"))).select("block", "id", "rep", "cluster", "reason")


def mapper(clustered: DataFrame) -> DataFrame:
    """(block, id, cluster_id, cluster_uid, reason): ids dense within a block, clusters before singletons.

    Clusters are numbered within ranges of the order, and the sizes of the ranges before are added, so
    that no task sorts a whole block.
    """
    sizes = clustered.groupBy("block", "cluster").agg(F.count("*").alias("size"))
    order = ["block", "single", "cluster"]
    dealt = sizes.select("block", F.when(F.col("size") > 1, 0).otherwise(1).alias("single"), "cluster")
    dealt = cut(dealt.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "numbered")
    counts = dealt.groupBy("block", "range").agg(F.count("*").alias("n"))
    before = counts.select("block", "range", (F.sum("n").over(Window.partitionBy("block").orderBy("range")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("block", "range").orderBy("single", "cluster"))
    numbered = dealt.withColumn("no", within).join(before, ["block", "range"]).select("block", "cluster", (F.col("no") - 1 + F.col("before")).cast("int").alias("cluster_id"))
    numbered = cut(numbered, "ids")
    uid = F.concat_ws("::", F.col("block").cast("string"), F.col("cluster_id").cast("string"))
    return clustered.join(numbered, ["block", "cluster"]).select("block", "id", "cluster_id", uid.alias("cluster_uid"), "reason")


def sampled_members(clustered: DataFrame, n: int) -> DataFrame:
    """Up to n documents of each cluster (block, id, rep, cluster): its representative first, and then others by a hash of their id."""
    order = Window.partitionBy("block", "cluster").orderBy(F.when(F.col("id") == F.col("cluster"), 0).otherwise(1), F.md5(F.col("id").cast("string").cast("binary")), "id")
    return clustered.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def representatives_and_singletons(clustered: DataFrame, n: int, seed: str = "0") -> DataFrame:
    """The representative of each cluster of several documents, and n singletons by a hash."""
    from civicflow.operators.matching import hash_sample

    sizes = clustered.groupBy("block", "cluster").agg(F.count("*").alias("size"), F.min("id").alias("id"))
    one = hash_sample(sizes.where("size = 1"), "id", n, seed)
    return sizes.where("size > 1").unionByName(one).select("block", "id", "cluster", "size")


def by_shared_id(rows: DataFrame, block: str, key: str, doc_id: str) -> DataFrame:
    """(block, id, cluster): documents that share a key, clustered under the least of them; one without a key stands alone."""
    least = rows.where(F.col(key).isNotNull()).groupBy(F.col(block).alias("b"), F.col(key).alias("k")).agg(F.min(doc_id).alias("least"))
    met = rows.join(least, F.col(block).eqNullSafe(F.col("b")) & (F.col(key) == F.col("k")), "left")
    return met.select(F.col(block).alias("block"), F.col(doc_id).alias("id"), F.coalesce("least", F.col(doc_id)).alias("cluster"))


def representatives(docs: DataFrame, group: str, doc_id: str, text: str, strategy: str = "longest") -> DataFrame:
    """(group, id) by one of three rules: the longest text, the longest cleaned text (hand in that column), or the first id."""
    if strategy == "first_id":
        return docs.groupBy(group).agg(F.min(doc_id).alias(doc_id), F.count("*").alias("size"))
    best = F.max_by(doc_id, F.struct(F.length(text), -F.col(doc_id)))
    return docs.groupBy(group).agg(best.alias(doc_id), F.count("*").alias("size"))


def summary(clustered: DataFrame) -> DataFrame:
    """Documents, clusters, those of several documents, the largest one's size, the upper median of sizes, and the reduction."""
    sizes = clustered.groupBy("block", "cluster").agg(F.count("*").alias("size"))
    hist = sizes.groupBy("size").agg(F.count("*").alias("n"))
    total = hist.agg(F.sum(F.col("size") * F.col("n")).alias("documents"), F.sum("n").alias("clusters"), F.sum(F.when(F.col("size") > 1, F.col("n")).otherwise(0)).alias("shared"), F.max("size").alias("largest"))
    # There are at most about the root of twice the documents' number of different sizes.
    upto = hist.select("size", F.sum("n").over(Window.orderBy("size")).alias("upto"))
    middle = upto.join(total.select("clusters"), how="cross").where(F.col("upto") > F.floor(F.col("clusters") / 2)).agg(F.min("size").alias("upper_median"))
    return total.join(middle, how="cross").select("documents", "clusters", "shared", "largest", "upper_median", F.round(1 - F.col("clusters") / F.col("documents"), 6).alias("reduction"))
