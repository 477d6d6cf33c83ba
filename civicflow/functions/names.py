"""Matching personal names: Jaro-Winkler, nicknames, field scores, rule tiers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Nicknames and the names they stand for.
NICKNAMES = {
    "bob": "robert", "rob": "robert", "bill": "william", "will": "william", "jim": "james", "jimmy": "james",
    "dick": "richard", "rick": "richard", "mike": "michael", "tom": "thomas", "joe": "joseph", "dan": "daniel",
    "dave": "david", "steve": "steven", "ed": "edward", "ted": "theodore", "tony": "anthony", "al": "albert",
    "alex": "alexander", "andy": "andrew", "ben": "benjamin", "charlie": "charles", "chuck": "charles",
    "chris": "christopher", "don": "donald", "doug": "douglas", "frank": "francis", "fred": "frederick",
    "jerry": "gerald", "hank": "henry", "jack": "john", "johnny": "john", "jake": "jacob", "jeff": "jeffrey",
    "ken": "kenneth", "larry": "lawrence", "matt": "matthew", "nick": "nicholas", "pete": "peter", "phil": "philip",
    "ray": "raymond", "ron": "ronald", "sam": "samuel", "tim": "timothy", "walt": "walter", "liz": "elizabeth",
    "beth": "elizabeth", "betty": "elizabeth", "sue": "susan", "pat": "patricia", "peg": "margaret",
    "maggie": "margaret", "kate": "katherine", "kathy": "katherine", "jenny": "jennifer", "jen": "jennifer",
    "sally": "sarah", "sandy": "sandra", "barb": "barbara", "deb": "deborah", "debbie": "deborah", "pam": "pamela",
    "connie": "constance", "cindy": "cynthia", "vicky": "victoria", "nate": "nathaniel",
}


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    """Similarity from 0 to 1; up to four equal first letters add to it where it is over 0.7."""
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, own = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                own.append(c)
                break
    if not own:
        return 0.0
    other = [c for c, t in zip(b, taken, strict=True) if t]
    moved = sum(x != y for x, y in zip(own, other, strict=True)) // 2
    m = len(own)
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + same * weight * (1 - jaro) if jaro > 0.7 else jaro


def similarity(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = list(zip(a.fillna(""), b.fillna(""), strict=True))
        known = {p: jaro_winkler(*p) for p in set(pairs)}
        return pd.Series([known[p] for p in pairs])

    return run(a, b)


def first_similarity(a: Column, b: Column) -> Column:
    """The larger of the likenesses of first names as written and with nicknames written out."""
    return F.greatest(similarity(a, b), similarity(full_first(a), full_first(b)))


def state_match(a: Column, b: Column) -> Column:
    """1 if both states are there and equal, else 0."""
    return F.coalesce((a == b) & (a != ""), F.lit(False)).cast("double")


def normalised(x: str | None) -> str:
    """Accents stripped, lower case, letters, hyphens and single spaces only."""
    kept = "".join(c for c in unicodedata.normalize("NFKD", x or "").lower() if "a" <= c <= "z" or c.isspace() or c == "-")
    return " ".join(kept.split())


def plain_name(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(normalised)

    return run(c)


def surname_first(c: Column) -> Column:
    """first and last of ``Last, First M``."""
    parts = F.split(c, ",", 2)
    return F.struct(F.coalesce(F.get(F.split(F.trim(F.get(parts, 1)), r"\s+"), 0), F.lit("")).alias("first"), F.trim(F.get(parts, 0)).alias("last"))


def surname_last(c: Column) -> Column:
    """first and last of ``First … Last``."""
    parts = F.split(F.trim(c), r"\s+")
    return F.struct(F.get(parts, 0).alias("first"), F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise("").alias("last"))


def full_first(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in NICKNAMES.items() for x in pair])
    return F.coalesce(table[c], c)


def field_score(first: Column, last: Column, state: Column) -> Column:
    return 0.35 * first + 0.40 * last + 0.25 * state


def rule_tier(first_a: Column, last_a: Column, state_a: Column, first_b: Column, last_b: Column, state_b: Column, full_a: Column | None = None, full_b: Column | None = None) -> Column:
    """5 for name and state, 4 for the name, 1 for the last name, else 0. A nickname counts as its name, so tiers 3 and 2 don't occur.

    full_a and full_b are ``full_first`` of the first names, where it was computed once a person and not once a pair.
    """
    full_a, full_b = full_first(first_a) if full_a is None else full_a, full_first(first_b) if full_b is None else full_b
    first = (first_a == first_b) | (full_a == full_b)
    last, state = last_a == last_b, (state_a == state_b) & (state_a != "")
    return F.when(first & last & state, 5).when(first & last, 4).when(last, 1).otherwise(0)
