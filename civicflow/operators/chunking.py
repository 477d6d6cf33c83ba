"""Splitting long documents by a token budget, and dropping overlapping extractions. Both are order-dependent within one document."""

from __future__ import annotations

import re
from collections import Counter
from heapq import nsmallest
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

words_of = re.compile(r"\w+").findall


def chunk_text(text: str, budget: int, overlap: int) -> list[str]:
    """Consecutive paragraphs up to a budget of white-space tokens.

    A chunk begins with the last paragraphs of the one before, up to ``overlap`` tokens of them; a
    paragraph over the budget is cut into pieces of its own, without overlap.
    """
    if len(text.split()) <= budget:
        return [text]
    chunks: list[str] = []
    held: list[tuple[str, int]] = []
    for para in re.split(r"\n\n+", text):
        n = len(para.split())
        if n > budget:
            if held:
                chunks.append("\n\n".join(p for p, _ in held))
            own = para.split()
            chunks += [" ".join(own[i : i + budget]) for i in range(0, n, budget)]
            held = []
            continue
        if sum(m for _, m in held) + n > budget:
            chunks.append("\n\n".join(p for p, _ in held))
            tail: list[tuple[str, int]] = []
            for p, m in reversed(held):
                if sum(x for _, x in tail) + m > overlap:
                    break
                tail.insert(0, (p, m))
            held = tail if sum(x for _, x in tail) + n <= budget else []
        held.append((para, n))
    return chunks + (["\n\n".join(p for p, _ in held)] if held else [])


def chunks(c: Column, budget: int = 4000, overlap: int = 500) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: chunk_text(t or "", budget, overlap))

    return run(c)


def chunk_rows(docs: DataFrame, doc_id: str, text: str, budget: int = 4000, overlap: int = 500) -> DataFrame:
    return docs.select(doc_id, F.posexplode(chunks(F.col(text), budget, overlap)).alias("chunk_no", "chunk"))


def kept_responses(texts: list[str], least: float = 0.85) -> list[str]:
    """Texts without those whose words overlap an earlier kept one; of the two the longer stays, in the earlier's place.

    If at least ``least`` of the smaller set's n words are common, one of its n - ceil(least x n) + 1 rarest
    words is. So a text looks for its rare words among all words of kept texts, and for all its words
    among the rare ones of kept texts; rare words have few texts, and only those found are compared.
    """
    sets = [set(words_of(t.lower())) for t in texts]
    often = Counter(w for own in sets for w in own)

    def rare(own: set[str]) -> list[str]:
        n = len(own) - ceil(least * len(own) - 1e-9) + 1
        return nsmallest(n, own, key=lambda w: (often[w], w)) if own else []

    kept: list[tuple[str, set[str]]] = []
    with_word: dict[str, list[int]] = {}
    with_rare: dict[str, list[int]] = {}

    def index(i: int, own: set[str], rarest: list[str]) -> None:
        for found, mine in ((with_word, own), (with_rare, rarest)):
            for w in mine:
                found.setdefault(w, []).append(i)

    for t, own in zip(texts, sets, strict=True):
        rarest = rare(own)
        near = {i for w in rarest for i in with_word.get(w, ())} | {i for w in own for i in with_rare.get(w, ())}
        for i in sorted(near):
            old, words = kept[i]
            small = min(len(own), len(words))
            if small and len(own & words) / small >= least:
                if len(t) > len(old):
                    kept[i] = (t, own)
                    index(i, own - words, rarest)
                break
        else:
            index(len(kept), own, rarest)
            kept.append((t, own))
    return [t for t, _ in kept]


def without_overlaps(c: Column, least: float = 0.85) -> Column:
    """For a document's ordered list of texts."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: kept_responses(list(x) if x is not None else [], least))

    return run(c)
