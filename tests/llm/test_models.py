"""Quality, toxicity, audio, and the pipeline."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from civicflow.llm import media, packing, quality, secrets, toxicity

from . import plain

SF, LARGE, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.1", "/root/testdata/sf0.001"
ODD = [(1, None, "a"), (2, "", "b"), (None, "word", "c"), (3, "\n\n \t", "d"), (3, "\n\n \t", "d"), (4, "x " * 50000, None)]


def odd(spark, extra):
    return spark.createDataFrame(ODD, f"doc_id long, text string, {extra} string")


def test_quality_of_held_out_documents(spark):
    got = quality.op2_quality(spark, LARGE).join(spark.read.parquet(f"{LARGE}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 1000 and np.mean([r["predicted"] == r["quality"] for r in held]) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_quality_of_odd_rows(spark):
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (99, None)], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, "Good words in a row." if i % 2 else "!!! !!! !!!") for i in range(60)], "doc_id long, text string")
    model = quality.fit(docs, marks)
    got = quality.scored(odd(spark, "score"), model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.fit(docs.limit(0), marks) is None and {r["score"] for r in quality.scored(docs, None).collect()} == {0.5}
    assert quality.scored(docs.limit(0), model).count() == 0


def test_additive_model_is_a_sum_of_tables():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    model = quality.train(x, y)
    assert (0, 1) in model.pairs
    assert ((model.score(x) >= 0.5) == y).mean() > 0.8


def test_quality_against_a_plain_version(spark):
    """Scores of a whole small table, looked up one measure at a time."""
    docs, marks = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), marks)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality.scored(docs, model).collect():
        x = quality.measures(texts[r["doc_id"]] or "")
        z = model.intercept + sum(model.tables[f][sum(c <= x[f] for c in edge)] for f, edge in enumerate(model.edges))
        for (i, j), grid in zip(model.pairs, model.grids, strict=True):
            z += grid[sum(c <= x[i] for c in model.coarse[i])][sum(c <= x[j] for c in model.coarse[j])]
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)))


def test_labels_that_repeat_or_contradict(spark):
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)] * 30 + [(0, 1), (2, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, f"text {k % 3} of {i}") for i in range(60) for k in range(20)] + [(5, "x" * 100)], "doc_id long, text string")
    got = toxicity.labelled_sample(docs, marks, "toxic", 1000, 1, longest=50).collect()
    want = {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1} - {0, 2}
    assert sorted(r["doc_id"] for r in got) == sorted(want) and all(r["text"] == f"text 0 of {r['doc_id']}" and r["label"] == r["doc_id"] % 2 for r in got)


def test_toxicity_against_a_plain_version(spark):
    """Scores of a whole small table: every window's words averaged one by one."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.scored(docs, model).collect():
        words = toxicity.words_of(texts[r["doc_id"]] or "")
        own = [float(np.mean(model.worth[toxicity.subwords(w)])) for w in words]
        s, windows = model.settings, []
        for a in range(0, max(1, len(own) - s.window + s.stride), s.stride):
            part = words[a : a + s.window]
            windows.append([own[a + i] for i, w in enumerate(part) if part[:i].count(w) < s.repeats])
        z = max(sum(w) / max(len(w), s.padded) for w in windows) + model.bias
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-(model.scale * z + model.shift))), abs=1e-6)


def test_toxicity_of_held_out_documents(spark):
    got = toxicity.op10_toxicity(spark, LARGE).join(spark.read.parquet(f"{LARGE}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    toxic = [r["predicted"] for r in held if r["toxic"]]
    clean = [r["predicted"] for r in held if not r["toxic"]]
    # About 300 toxic examples to learn from; with the 1,200 that the sample may hold, 0.98 are found.
    assert np.mean(toxic) > 0.75 and np.mean(clean) < 0.04


def test_unseen_misspellings_share_vectors():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    texts, y = [], []
    for i in range(400):
        own = list(rng.choice(words, 30))
        if i % 2:
            own[5] = rng.choice(["zorgle", "zorgles", "zorgler"])
        texts.append(" ".join(own))
        y.append(i % 2)
    model = toxicity.train(texts, np.array(y))
    base = list(rng.choice(words, 30))
    score = lambda w: model.score(" ".join([*base[:10], w, *base[10:]]))
    assert score("zorgled") > max(0.7, score("abcdee"))


def test_words_said_over_and_over():
    rng = np.random.default_rng(8)
    for repeats in (1, 2, 5):
        rows = rng.integers(-1, 4, (50, 16), np.int32)
        want = [[w if list(r[:i]).count(w) < repeats else -1 for i, w in enumerate(r)] for r in rows]
        assert toxicity.counted(rows, repeats).tolist() == want
    assert toxicity.words_of("no no No") == ["no"] * 3
    assert toxicity.windows_of(np.arange(20, dtype=np.int32), 16, 8)[1].tolist() == [*range(8, 20), -1, -1, -1, -1]


def test_toxicity_of_odd_rows(spark):
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (99, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, "you zorgle of a man" if i % 2 else "a fine day by the sea") for i in range(60)], "doc_id long, text string")
    model = toxicity.fit(docs, marks)
    got = toxicity.scored(odd(spark, "score"), model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.fit(docs.limit(0), marks) is None and {r["score"] for r in toxicity.scored(docs, None).collect()} == {0.0}


def test_media_on_the_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = media.op3_media(spark, SF).collect()
    assert len(rows) == len(texts)
    formats = set()
    for r in rows:
        data = texts[r["doc_id"]].encode()
        payload = data + b" " * ((192 - len(data) % 192) % 192 if data else 192)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        tag = media.format_for(payload)
        stored = media.wave(media.chunk_of(tag, payload), tag)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        formats.add(r["feature"].split(";")[0])
    assert formats == {"mulaw", "alaw", "ima"}


def test_media_of_odd_rows(spark):
    stored = media.stored_audio(odd(spark, "media"))
    got = media.decoded_audio(stored, ("payload", "pcm", "feature")).collect()
    assert len(got) == len(ODD) and bytes(got[0]["payload"]) == b" " * 192 == bytes(got[1]["payload"])
    assert got[3]["feature"] == got[4]["feature"]
    tag, rate, _, data = media.read_wave(bytes(got[0]["pcm"]))
    assert (tag, rate) == (media.PCM, media.TARGET)
    assert media.decoded_audio(stored.limit(0)).count() == 0
    nothing = media.decoded_audio(spark.createDataFrame([(1, None)], "doc_id long, media binary")).first()
    assert nothing["pcm"] is None and nothing["feature"] is None


def test_companding_tables():
    mu, a = media.mulaw_table(), media.alaw_table()
    assert mu[0xFF] == mu[0x7F] == 0 and mu[0x80] == 32124 and mu[0x00] == -32124
    assert a[0xD5] == 8 and a[0x55] == -8 and a[0xAA] == 32256 and a[0x2A] == -32256
    assert (np.diff(mu[0x80:].astype(int)) < 0).all()


def scalar_ima(block):
    value, index = struct.unpack("<hB", block[:3])
    out = [value]
    for byte in block[4:]:
        for n in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            change = step >> 3
            change += step if n & 4 else 0
            change += step >> 1 if n & 2 else 0
            change += step >> 2 if n & 1 else 0
            value = max(-32768, min(32767, value - change if n & 8 else value + change))
            index = max(0, min(88, index + int(media.CHANGES[n])))
            out.append(value)
    return out


def test_adpcm_against_a_scalar_decoder():
    rng = np.random.default_rng(5)
    blocks = rng.integers(0, 256, (20, 40), np.uint8)
    blocks[:, 2] %= 89
    assert media.decode_ima(blocks).tolist() == [scalar_ima(bytes(b)) for b in blocks]
    assert len(media.STEPS) == 89


@pytest.mark.parametrize(("rate", "target"), [(8000, 16000), (8000, 6000), (8000, 11025), (16000, 8000)])
def test_resampling_keeps_a_tone(rate, target):
    t = np.arange(rate) / rate
    tone = (8000 * np.sin(2 * np.pi * 440 * t)).astype(np.int16)
    got = media.resample(tone, rate, target)
    assert len(got) == -(-len(tone) * target // rate)
    want = 8000 * np.sin(2 * np.pi * 440 * np.arange(len(got)) / target)
    assert np.abs(got[200:-200] - want[200:-200]).max() < 200
    assert len(media.resample(tone[:0], rate, target)) == 0 and media.resample(tone, rate, rate) is tone


def test_bad_files_are_refused():
    with pytest.raises(ValueError):
        media.read_wave(b"no file")
    with pytest.raises(ValueError):
        media.decode_many([(2, b"")])
    with pytest.raises(ValueError):
        media.read_wave(b"RIFF\0\0\0\0WAVE")


def test_pipeline_against_a_plain_version(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    docs = [d for d in docs if any(c.isalpha() for c in d[1] or "")]
    cleaned = plain.lines_kept(docs)
    docs = sorted((i, t) for i, (t, gone) in cleaned.items() if not gone or t)
    named = plain.near_groups(docs)
    docs = [d for d, (i, least) in zip(docs, named, strict=True) if i == least]
    t = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for i, text in docs:
        at, out = 0, ""
        for _, a, b in secrets.scan_text(text):
            if a >= at:
                out += text[at:a] + secrets.MARK
            at = max(at, b)
        want += [(i, *p) for p in plain.pieces(t, out + text[at:])]
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)


def test_pipeline_stages_keep_columns_and_odd_rows(spark):
    train = [(i, "the cat and the dog sat on the mat " + "abcdefghij"[i % 10] * 9, "en", "s", 40) for i in range(10, 40)]
    rows = [*train, (1, None, None, None, None), (2, "", "en", "s", 0), (None, "the dog and the cat", "en", None, 19), (3, "the cat sat token=abcdef9 on", "en", "s", 28), (3, "the cat sat token=abcdef9 on", "en", "s", 28)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("gone", F.lit("g"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    texts = [r["text"] for r in docs.collect()]
    assert sum("[SECRET]" in t for t in texts) == 2 and all(texts)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == len(texts)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0, name
