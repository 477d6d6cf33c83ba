"""Model calls as table operators: scorers, extractors and generators behind small interfaces.

A backend is any object with the one method named below; it is pickled to the executors and called
with Arrow-sized batches. ``WordScorer``, ``PatternExtractor`` and ``TemplateGenerator`` work without
a network and give the same answer every time, so that every pipeline runs and can be tested.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicflow.functions import answers
from civicflow.functions.batches import cuts
from civicflow.functions.text import numbered, pair_key
from civicflow.operators.retrieval import unseen
from civicflow.storage import cut


def fresh_name(rows: DataFrame, name: str) -> str:
    """A column name like this one that the frame doesn't have."""
    while name in rows.columns:
        name += "_"
    return name


class Scorer(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class Extractor(Protocol):
    def extract(self, texts: list[str]) -> list[str]: ...


class WordScorer:
    """Share of the shorter text's words that are in the other."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for a, b in pairs:
            x, y = set(re.findall(r"\w+", a.lower())), set(re.findall(r"\w+", b.lower()))
            out.append(len(x & y) / min(len(x), len(y)) if x and y else 0.0)
        return out


class PatternExtractor:
    """The sentences that match a pattern, as a JSON list."""

    def __init__(self, pattern: str):
        self.pattern = pattern

    def extract(self, texts: list[str]) -> list[str]:
        import json

        return [json.dumps([s.strip() for s in re.split(r"(?<=[.!?])\s+", t) if re.search(self.pattern, s)]) for t in texts]


class Always:
    """The same answer to everything."""

    def __init__(self, answer: str):
        self.answer = answer

    def extract(self, texts: list[str]) -> list[str]:
        return [self.answer] * len(texts)


class TemplateGenerator:
    """One tagged claim for each numbered provision of a prompt."""

    def extract(self, texts: list[str]) -> list[str]:
        return ["\n".join(f"[P{n}] I object to {t.strip()}" for n, t in re.findall(r"(?m)^(\d+)\. (.*)$", x)) for x in texts]


def scored_pairs(pairs: DataFrame, left: str, right: str, scorer: Scorer, batch: int = 256, name: str = "score") -> DataFrame:
    """pairs with a score. A batch that runs out of memory is halved, down to single pairs."""

    def call(items: list[tuple[str, str]]) -> list[float]:
        try:
            return list(scorer.score(items))
        except MemoryError:
            if len(items) == 1:
                raise
            half = len(items) // 2
            return call(items[:half]) + call(items[half:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            items = list(zip(pdf[left].fillna(""), pdf[right].fillna(""), strict=True))
            found = [s for i in range(0, len(items), batch) for s in call(items[i : i + batch])]
            yield pdf.assign(**{name: pd.Series(found, index=pdf.index, dtype=float)})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInPandas(run, f"{kinds}, `{name}` double")


def rescored(pairs: DataFrame, known: DataFrame, left: str, right: str, doc_id: str, scorer: Scorer) -> DataFrame:
    """(pair, score) for all pairs: known scores are kept, only unseen pairs are scored, each once."""
    keyed = pairs.select(pair_key(F.col(doc_id), F.col(right)).alias("pair"), left, right)
    fresh = unseen(keyed.dropDuplicates(["pair"]), known, ["pair"])
    return known.select("pair", "score").unionByName(scored_pairs(fresh, left, right, scorer).select("pair", "score"))


def _asked(rows: DataFrame, text: str, backend: Extractor, name: str) -> DataFrame:
    """rows with the backend's answers. A batch is asked, and given on, in parts of bounded size; other columns stay in Arrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in cuts(batch[text]):
                part = batch.slice(at, n)
                answers = pa.array(list(backend.extract([x or "" for x in part[text].to_pylist()])), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, answers], [*part.schema.names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, `{name}` string")


def asked_until(rows: DataFrame, text: str, backend: Extractor, name: str, good: Callable[[Column], Column], attempts: int = 1) -> DataFrame:
    """rows with an answer; those whose answer isn't good are asked again, ``attempts`` times in all.

    Each round's answers are written before they are looked at, so that no row is asked twice for one answer.
    """
    done, todo = None, rows
    for left in range(attempts, 0, -1):
        now = cut(_asked(todo, text, backend, name), "answers")
        fine = F.coalesce(good(F.col(name)), F.lit(False))
        part = now if left == 1 else now.where(fine)
        done = part if done is None else done.unionByName(part)
        if left > 1:
            todo = now.where(~fine).drop(name)
            if todo.isEmpty():
                break
    return done


def claims(docs: DataFrame, text: str, backend: Extractor, repair: Extractor | None = None, attempts: int = 1) -> DataFrame:
    """docs with raw answer, parsed list and whether it parsed. What doesn't parse is asked again, and a second backend gets the answers that still don't."""
    first = asked_until(docs, text, backend, "raw", lambda c: answers.answer_list(c).isNotNull(), attempts).withColumn("parsed", answers.answer_list(F.col("raw")))
    if repair is None:
        return first.withColumn("parse_ok", F.col("parsed").isNotNull())
    bad = cut(_asked(first.where("parsed is null"), "raw", repair, "fixed"), "fixed").withColumn("parsed", answers.answer_list(F.col("fixed")))
    return first.where("parsed is not null").withColumn("fixed", F.lit(None).cast("string")).unionByName(bad).withColumn("parse_ok", F.col("parsed").isNotNull())


def zero_shot(rows: DataFrame, text: str, labels: list[str], backend: Extractor, attempts: int = 2, cap: int = 20_000) -> DataFrame:
    """rows with a label of a closed list, or null if no answer names one; the first named counts.

    The prompt has the labels and the text's first ``cap`` characters, which is what the prompt's form allows.
    """
    prompt = fresh_name(rows, "prompt")
    named = F.concat(F.lit("Choose one of: " + ", ".join(labels) + ".\n\n"), F.substring(F.coalesce(text, F.lit("")), 1, cap))
    pick = lambda c: F.get(F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z_]+)"), 1), lambda w: w.isin(*labels)), 0)
    got = asked_until(rows.withColumn(prompt, named), prompt, backend, "answer", lambda c: pick(c).isNotNull(), attempts)
    return got.withColumn("label", pick(F.col("answer"))).drop(prompt, "answer")


def prompt_of(provisions: Column, persona: Column | None = None, examples: Column | None = None, evidence: Column | None = None) -> Column:
    """A prompt of numbered provisions: plain, in a persona's voice, with examples before it, with evidence behind it, or all of these. Missing parts are left out."""
    parts = []
    if persona is not None:
        parts.append(F.concat(F.lit("You are "), persona, F.lit(".")))
    if examples is not None:
        parts.append(F.when(F.size(examples) > 0, F.concat(F.lit("Examples:\n"), F.array_join(examples, "\n---\n"))))
    parts.append(numbered(provisions))
    if evidence is not None:
        parts.append(F.when(F.size(evidence) > 0, F.concat(F.lit("Evidence:\n"), F.array_join(evidence, "\n"))))
    return F.concat_ws("\n\n", *parts)


def evidence_lines(hits: DataFrame, key: str, text: str, most: int = 15) -> DataFrame:
    """(key, evidence): the first ``most`` of the distinct texts found for each key, in order."""
    ranked = hits.select(key, text).where(F.col(text).isNotNull()).distinct()
    first = ranked.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(text))).where(F.col("rn") <= most)
    return first.groupBy(key).agg(F.array_sort(F.collect_list(text)).alias("evidence"))


def generated(dockets: DataFrame, provisions: str, backend: Extractor, persona: Column | None = None, examples: Column | None = None, evidence: Column | None = None) -> DataFrame:
    """dockets with a prompt of their provisions and the backend's answer."""
    return _asked(dockets.withColumn("prompt", prompt_of(F.col(provisions), persona, examples, evidence)), "prompt", backend, "answer")


def tool_loop(rows: DataFrame, prompt: str, backend: Extractor, tool: Callable[[DataFrame], DataFrame], most_rounds: int = 3) -> DataFrame:
    """rows with a final answer and the number of rounds. An answer that begins with ``SEARCH:`` is a question to a tool.

    The tool takes (question) and returns (question, result); the result is added to the prompt and
    the backend asked again, up to ``most_rounds`` times. An answer that still asks then is final.
    """
    now, done = rows.withColumn("said", F.col(prompt)), None
    for no in range(1, most_rounds + 1):
        got = cut(_asked(now, "said", backend, "answer").withColumn("rounds", F.lit(no)), "tool")
        question = F.trim(F.regexp_extract("answer", r"^\s*SEARCH:\s*([^\n]+)", 1))
        asks = question != ""
        part = got if no == most_rounds else got.where(~asks)
        done = part if done is None else done.unionByName(part)
        if no < most_rounds:
            open_ = got.where(asks).withColumn("question", question)
            if open_.isEmpty():
                break
            found = tool(open_.select("question").distinct()).select("question", F.col("result").cast("string").alias("result"))
            now = open_.join(found, "question", "left").withColumn("said", F.concat_ws("\n\n", "said", "answer", F.concat(F.lit("RESULT: "), F.coalesce("result", F.lit("none"))))).select(*rows.columns, "said")
    return done.drop("said")
