"""Inputs that go beyond a word of bits or the length of a word."""

import random

import numpy as np
import pytest

from civicflow.llm import language_id, toxicity


def test_every_character_of_a_long_run_is_read():
    rng = random.Random(5)
    for n in (1, 39, 40, 41, 77, 78, 400):
        run = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
        parts = toxicity.words_of(run)
        assert all(len(p) <= 40 for p in parts) and (n > 40 or parts == [run])
        assert {run[i : i + 4] for i in range(n)} - {run[n - k :] for k in (1, 2, 3)} <= {p[i : i + 4] for p in parts for i in range(len(p))}


def test_a_toxic_part_behind_the_fortieth_character():
    rng = random.Random(6)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(6))
    bad = [word("qxzjkv") for _ in range(20)]
    texts = [" ".join(word("aeiourst") for _ in range(12)) for _ in range(200)]
    texts += [" ".join([*(word("aeiourst") for _ in range(6)), *rng.choices(bad, k=6)]) for _ in range(200)]
    model = toxicity.train(texts, np.array([0] * 200 + [1] * 200))
    clean = "_".join(word("aeiourst") for _ in range(30))
    assert model.score(clean) < 0.5 < model.score(clean + "_" + "_".join(bad))


def test_more_languages_than_a_word_has_bits(spark):
    rng = random.Random(7)
    letters = [chr(0x4E00 + i) for i in range(70 * 12)]  # an alphabet of its own for each of 70 languages
    rows = []
    for lang in range(70):
        own = letters[lang * 12 : lang * 12 + 12]
        for k in range(12 if lang < 64 else 6):
            rows.append((len(rows), " ".join("".join(rng.choices(own, k=5)) for _ in range(20)), f"l{lang:02}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, exclude_remainder=None)
    assert len(model.languages) == 70
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, model).collect()}
    assert all(got[i] == lang for i, _, lang in rows)
    assert language_id.keep_identified(docs, model).count() == len(rows)
    with pytest.raises(ValueError, match="69"):
        language_id.fit(docs, exclude_remainder=None, most_languages=69)
