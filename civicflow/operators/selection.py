"""Choosing rows and columns: filters with a second way, candidate columns, lookups, negatives, draws.

Helper columns get names that the input doesn't have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicflow.functions.text import nonempty, present, tokens
from civicflow.operators.matching import hash_rank

#: The keys under which a download's metadata may hold the document's id.
ID_KEYS = ["Document ID", "DocumentId", "document_id", "doc_id", "DocumentID"]
#: Words that don't count in the overlap of a rule and a proposal.
STOP_WORDS = ["the", "of", "and", "to", "a", "in", "for", "is", "on", "that", "by", "this", "with", "from", "or", "an", "be", "as", "at", "are", "was"]


def spare(rows: DataFrame, name: str) -> str:
    """A column name like this one that the frame doesn't have."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def equal_or_prefixed(rows: DataFrame, equal: str, prefixed: str, value: str) -> DataFrame:
    """Rows whose column equals a value in any case; if there are none, those whose other column begins with it. One pass finds out which."""
    same = F.coalesce(F.lower(equal) == value.lower(), F.lit(False))
    begins = F.coalesce(F.upper(prefixed).startswith(value.upper()), F.lit(False))
    some = rows.agg(F.max(same).alias("some")).first()["some"]
    return rows.where(same if some else begins)


def without_notices(rows: DataFrame, doc_id: str, docket: str, most: int = 20) -> DataFrame:
    """Rows whose id isn't a register notice's, of dockets with at most ``most`` of them. A row without an id counts as no notice."""
    kept = rows.where(~F.coalesce(F.upper(doc_id).contains("FRDOC"), F.lit(False)))
    small = kept.groupBy(docket).agg(F.count("*").alias("n")).where(F.col("n") <= most).select(F.col(docket).alias(key := spare(rows, "docket_key")))
    return kept.join(small, F.col(docket).eqNullSafe(F.col(key)), "left_semi")


def shard(items: list[str], k: int, n: int) -> list[str]:
    """Every n-th of the sorted items, from the k-th (from 1) on."""
    if not 1 <= k <= n:
        raise ValueError(f"shard {k} of {n}")
    return sorted(items)[k - 1 :: n]


def first_present(rows: DataFrame, names: list[str]) -> Column:
    """The first non-empty value of the candidate columns that the frame has, in their order; null if it has none."""
    have = [present(F.col(f"`{n}`")) for n in names if n in rows.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def inline_comments(rows: DataFrame) -> Column:
    """The non-blank values of all columns that are called a comment, but not a comment on something, with blank lines between them."""
    names = [c for c in rows.columns if "comment" in c.lower() and "comment on" not in c.lower()]
    return F.array_join(F.filter(F.array(*[F.trim(F.col(f"`{c}`").cast("string")) for c in names], F.lit("")), lambda x: nonempty(x)), "\n\n")


def agency_of(rows: DataFrame) -> Column:
    """The agency: as set before, the agency id, or what stands before the first ``_`` of the source folder, of the columns that there are."""
    has = lambda c: c in rows.columns
    known = [F.col("_agency")] * has("_agency") + [F.lower("agency_id")] * has("agency_id")
    known += [F.element_at(F.split(c, "_"), 1) for c in ("source_dir", "_source_dir") if has(c)]
    return F.coalesce(*known) if known else F.lit(None).cast("string")


def id_parts(c: Column) -> Column:
    """first, before_last and last of an id's parts around ``__``, its third part, and the number before its first ``_`` (null if that is no number)."""
    parts = F.split(c, "__")
    number = F.regexp_extract(c, r"^(\d+)(_|$)", 1)
    return F.struct(
        F.get(parts, 0).alias("first"), F.when(F.size(parts) > 1, F.regexp_extract(c, r"(?s)^(.*)__", 1)).otherwise(c).alias("before_last"), F.when(F.size(parts) > 1, F.element_at(parts, -1)).alias("last"),
        F.get(parts, 2).alias("third"), F.when(number != "", number.try_cast("bigint")).alias("number"),
    )


def document_id(metadata: Column, folder: Column, keys: list[str] = ID_KEYS) -> Column:
    """The id in a download's JSON metadata, under the first key with a value, else the folder's name."""
    found = F.from_json(metadata, "map<string,string>")
    value = lambda k: F.trim(F.get(F.map_values(F.map_filter(found, lambda name, _: name == k)), 0))
    return F.coalesce(*[F.when(value(k) != "", value(k)) for k in keys], folder)


def top_key(c: Column, usual: str = "individual") -> Column:
    """The key of a map's largest value, the first in order on ties; the usual one for an empty or null map."""
    best = F.reduce(F.map_entries(c), F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("value")), lambda a, e: F.when(a["value"].isNull() | (e["value"].cast("double") > a["value"]) | ((e["value"].cast("double") == a["value"]) & (e["key"] < a["key"])), F.struct(e["key"].alias("key"), e["value"].cast("double").alias("value"))).otherwise(a))
    return F.coalesce(best["key"], F.lit(usual))


def distinct_values(c: Column) -> Column:
    """The distinct values of a map, in order."""
    return F.array_sort(F.array_distinct(F.map_values(c)))


def unwrapped(single: Column, several: Column) -> Column:
    """A list from an envelope that holds one item, or several, or neither."""
    return F.coalesce(several, F.when(single.isNotNull(), F.array(single)), F.slice(F.array(single), 1, 0))


def best_pair(left: DataFrame, pairs: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """left with its best pair's columns, the lowest tie first on equal scores; null where there is none."""
    others = [c for c in pairs.columns if c != key]
    order = F.struct((-F.round(score, 9)).alias("s"), F.col(tie).alias("t"))
    best = pairs.where(F.col(score).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*others), order).alias(held := spare(left, "best")))
    return left.join(best, key, "left").select(*left.columns, *[F.col(f"{held}.{c}").alias(c) for c in others])


def or_linked(dockets: DataFrame, docs: DataFrame, links: DataFrame) -> DataFrame:
    """(docket_id, doc_id, via) of each docket's documents; of a docket without any, those of the docket that it is linked with.

    dockets (docket_id), docs (docket_id, doc_id), links (docket_id, linked). via is the docket that the documents are of.
    """
    own = dockets.select("docket_id").distinct().join(docs.select("docket_id", "doc_id"), "docket_id", "left")
    bare = own.where("doc_id is null").select("docket_id").join(links.select("docket_id", "linked").distinct(), "docket_id")
    other = bare.join(docs.select(F.col("docket_id").alias("linked"), "doc_id"), "linked").select("docket_id", "doc_id", F.col("linked").alias("via"))
    return own.where("doc_id is not null").select("docket_id", "doc_id", F.col("docket_id").alias("via")).unionByName(other)


def with_source_row(rows: DataFrame, source: DataFrame, key: str, order: str) -> DataFrame:
    """rows with the columns of the first source row of their key; a column that both have keeps its own value where there is one."""
    cols = [c for c in source.columns if c != key]
    first = source.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias(held := spare(rows, "source")))
    both = rows.join(first, key, "left")
    own = [F.coalesce(F.col(c), F.col(f"{held}.{c}")).alias(c) if c in cols else F.col(c) for c in rows.columns]
    return both.select(*own, *[F.col(f"{held}.{c}").alias(c) for c in cols if c not in rows.columns])


def negatives(positives: DataFrame, ranked: DataFrame, rules: DataFrame, seed: str = "0") -> DataFrame:
    """(rule_id, proposal_id, docket_id, source): one hard negative for each proposal, and easy ones until there are as many negatives as positives.

    positives (rule_id, proposal_id, docket_id); ranked (proposal_id, rule_id) are retrieved rules;
    rules (rule_id, docket_id). A hard one is drawn by hash from the retrieved rules of other dockets.
    Rules are dealt by hash to cells, each of which offers its first rules of two dockets; a positive's
    own hash picks a cell, and so an easy negative of another docket. Positives come in hash order until
    there are enough. No draw depends on the order of rows.
    """
    proposals = positives.groupBy("proposal_id").agg(F.min("docket_id").alias("docket_id"))
    other = ranked.join(rules.select("rule_id", F.col("docket_id").alias("rule_docket")), "rule_id").join(proposals, "proposal_id").where("rule_docket <> docket_id")
    hard = other.groupBy("proposal_id", "docket_id").agg(F.min_by("rule_id", F.struct(hash_rank(F.concat_ws(":", "proposal_id", "rule_id"), seed), "rule_id")).alias("rule_id"))
    hard = hard.select("rule_id", "proposal_id", "docket_id", F.lit("hard_negative").alias("source"))
    cells = max(1, min(4096, rules.count() // 8))
    cell = lambda c: (F.conv(F.substring(c, 1, 8), 16, 10).cast("bigint") % cells).cast("int")
    at = hash_rank(F.col("rule_id"), seed)
    dealt = rules.groupBy(cell(at).alias("cell"), "docket_id").agg(F.min_by("rule_id", F.struct(at, "rule_id")).alias("rule_id"))
    two = dealt.withColumn("no", F.row_number().over(Window.partitionBy("cell").orderBy(hash_rank(F.col("rule_id"), seed), "rule_id"))).where("no <= 2")
    two = two.select("cell", F.col("rule_id").alias("drawn"), F.col("docket_id").alias("drawn_docket"), "no")
    point = positives.withColumn("draw", hash_rank(F.concat_ws(":", "proposal_id", "rule_id"), seed + "easy"))
    met = point.withColumn("cell", cell(F.col("draw"))).join(two, "cell").where("drawn_docket <> docket_id")
    easy = met.groupBy("proposal_id", "docket_id", "rule_id", "draw").agg(F.min_by("drawn", "no").alias("drawn"))
    wanted = positives.agg(F.count("*").alias("p")).join(hard.agg(F.count("*").alias("h")), how="cross").first()
    easy = easy.orderBy("draw", "proposal_id", "rule_id").limit(max(0, wanted["p"] - wanted["h"])).select(F.col("drawn").alias("rule_id"), "proposal_id", "docket_id", F.lit("easy_negative").alias("source"))
    return hard.unionByName(easy)


def sample_each(rows: DataFrame, by: list[str], key: str, n: int, seed: str = "0") -> DataFrame:
    """n rows of each group, by a hash of their key."""
    place = spare(rows, "place")
    order = Window.partitionBy(*by).orderBy(hash_rank(F.col(key), seed), key)
    return rows.withColumn(place, F.row_number().over(order)).where(F.col(place) <= n).drop(place)


def steerable(pairs: DataFrame, stakeholder: str, dim: str, label: str) -> DataFrame:
    """(stakeholder, dim, matches, total): a pair without a stakeholder counts to the total of ``vanilla``, and its match nowhere."""
    s = F.col(stakeholder)
    return pairs.groupBy(F.coalesce(s, F.lit("vanilla")).alias("stakeholder"), F.col(dim).alias("dim")).agg(F.count_if(s.isNotNull() & (F.col(label) == "same")).alias("matches"), F.count("*").alias("total"))


def uncached(rows: DataFrame, cache: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """(key, text): the first text of each key that the cache hasn't."""
    first = rows.groupBy(key).agg(F.min_by(text, order).alias(text))
    return first.join(cache.select(key).distinct(), key, "left_anti")


def longest_text(rows: DataFrame, by: str, text: str, doc_id: str, over: int = 100) -> DataFrame:
    """The longest text of each group if it has more than ``over`` characters; the least id on ties."""
    best = rows.groupBy(by).agg(F.max_by(F.struct(doc_id, text), F.struct(F.length(text), -F.col(doc_id))).alias("best"))
    return best.select(by, "best.*").where(F.length(text) > over)


def rule_overlap(a: Column, b: Column, chars: int = 300) -> Column:
    """Share of the smaller of two word sets that is in the other; of the texts' first characters, without the commonest words."""
    words = lambda c: F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(F.substring(F.coalesce(c, F.lit("")), 1, chars)), F.lit(r"(?U)(\w+)"), 1)), F.array(*map(F.lit, STOP_WORDS)))
    x, y = words(a), words(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.least(F.size(x), F.size(y))), F.lit(0.0))


def flipped(pairs: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Training pairs (key, label, source) with those hard negatives made positive that an answer (key, answer) confirms."""
    yes = answers.where(F.lower(F.trim("answer")).startswith("yes")).select(F.col(key).alias(own := spare(pairs, "confirmed"))).distinct()
    met = pairs.join(yes, F.col(key) == F.col(own), "left")
    hit = F.col(own).isNotNull() & (F.col("source") == "hard_negative")
    label, source = F.when(hit, 1).otherwise(F.col("label")).alias("label"), F.when(hit, "silver_positive").otherwise(F.col("source")).alias("source")
    return met.select(*[label if c == "label" else source if c == "source" else F.col(c) for c in pairs.columns])


def fitted(text: Column, fixed_tokens: Column, budget: int) -> Column:
    """The longest token prefix of a text that fits into a budget beside fixed tokens; the whole text, as it is, if it fits."""
    own, room = tokens(text), F.greatest(F.lit(budget) - fixed_tokens, F.lit(0))
    return F.when(F.size(own) <= room, text).otherwise(F.array_join(F.slice(own, F.lit(1), room), " "))


def inclusive(ts: Column, first: str, last: str) -> Column:
    """Whether a time is within whole days, the last one included."""
    return (ts >= F.lit(first).cast("date")) & (ts < F.date_add(F.lit(last).cast("date"), 1))


def bucketed(rows: DataFrame, key: str, buckets: dict[str, str], into: str) -> DataFrame:
    """rows with the bucket of their key in a new column; rows whose key is in no bucket, or null, are left out."""
    table = F.create_map(*[F.lit(x) for pair in buckets.items() for x in pair]) if buckets else F.lit(None).cast("map<string,string>")
    return rows.withColumn(into, table[F.col(key)]).where(F.col(into).isNotNull())
