"""Where a passage stands in a long text, exactly or nearly; and noise for training titles."""

from __future__ import annotations

import difflib
import hashlib
import random
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def locate_passage(text: str, passage: str, section: str | None = None, least: float = 0.7, step: int = 20) -> tuple[int, int, str] | None:
    """start, end and how it was found: exact, by the first 60 characters, under its section's heading, or by similarity.

    Similarity compares windows of the passage's length every ``step`` characters, and takes the best
    one of at least ``least``.
    """
    if not passage or not text:
        return None
    if (at := text.find(passage)) >= 0:
        return at, at + len(passage), "exact"
    if len(passage) >= 60 and (at := text.find(passage[:60])) >= 0:
        return at, min(len(text), at + len(passage)), "prefix"
    if section and (m := re.search(re.escape(section), text)):
        return m.start(), min(len(text), m.start() + len(passage)), "section"
    best, where = 0.0, -1
    matcher = difflib.SequenceMatcher(autojunk=False)
    matcher.set_seq2(passage)
    for at in range(0, max(1, len(text) - len(passage) + 1), step):
        matcher.set_seq1(text[at : at + len(passage)])
        if matcher.real_quick_ratio() > best and matcher.quick_ratio() > best and (r := matcher.ratio()) > best:
            best, where = r, at
    return (where, min(len(text), where + len(passage)), "similar") if best >= least else None


def located(text: Column, passage: Column, section: Column) -> Column:
    """Struct of start, end and how; null where nothing is near enough."""

    @F.pandas_udf("struct<start:int,end:int,how:string>")
    def run(t: pd.Series, p: pd.Series, s: pd.Series) -> pd.DataFrame:
        found = [locate_passage(a or "", b or "", c) for a, b, c in zip(t, p, s, strict=True)]
        return pd.DataFrame([f or (None, None, None) for f in found], columns=["start", "end", "how"]).astype({"start": "Int32", "end": "Int32"})

    return run(text, passage, section)


def noised_title(title: str, seed: int = 0) -> str:
    """A title with a part of its words dropped, and two swapped or all shuffled; the same for the same title and seed."""
    rng = random.Random(int(hashlib.md5(f"{seed}:{title}".encode()).hexdigest()[:12], 16))
    words = title.split()
    if len(words) < 3:
        return title
    kept = [w for w in words if rng.random() >= rng.uniform(0.3, 0.6)] or words[:1]
    if rng.random() < 0.5 and len(kept) > 1:
        i = rng.randrange(len(kept) - 1)
        kept[i], kept[i + 1] = kept[i + 1], kept[i]
    elif rng.random() < 0.3:
        rng.shuffle(kept)
    return " ".join(kept)


def noised(title: Column, seed: int = 0) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: noised_title(x or "", seed))

    return run(title)
