"""Token files against the tokenizers library, and their format."""

import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from civicflow.llm import token_files as T
from civicflow.llm.packing import default_tokenizer

SF = "/root/testdata/sf0.001"


def plain(rows):
    """(doc_id, start, n_tokens, ids_crc32) of rows in order."""
    own, at, out = Tokenizer.from_file(default_tokenizer()), 0, []
    for i, text in rows:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = T.op13_token_files(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows)


def test_odd_rows_in_small_files(spark, tmp_path):
    rows = [(None, "no id"), (1, "a</s>b"), (2, None), (3, ""), (4, "word " * 3000), (5, "same"), (5, "same"), (5, "same"), (6, "x")] + [(k, f"text {k}") for k in range(7, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS path", "2 AS h", "3 AS row", "4 AS `a.b`")
    files = T.write_sequences(docs.repartition(5), f"file://{tmp_path}/out", length=8, batch=2, file_sequences=6)
    assert sorted(((r[0] or 0), *r[1:]) for r in map(tuple, T.documents_in(files).collect())) == sorted((i or 0, *x) for i, *x in plain(rows))
    made = files.orderBy("task", "roll").collect()
    assert len(made) > 10 and sum(r["n_docs"] for r in made) == len(rows)
    for r in made:
        file = T.SequenceFile(r["path"])
        assert len(file) == r["n_sequences"] == -(-r["n_ids"] // 8)
        ids, mask = zip(*(file[i] for i in range(len(file))))
        flat = np.concatenate([m.to_numpy(zero_copy_only=False) for m in mask])
        assert sum(file.bits(i, "last").sum() for i in range(file.batches)) == r["n_docs"] and flat.sum() == r["n_ids"] and not np.concatenate(ids)[~flat].any()
    whole = T.sequences_in(files).collect()
    assert sorted((r["path"], r["sequence"]) for r in whole) == sorted((r["path"], i) for r in made for i in range(r["n_sequences"]))
    assert all(r["ids"] == T.SequenceFile(r["path"])[r["sequence"]][0].tolist() for r in whole[:50])


def test_starts_across_blocks(spark):
    files = spark.createDataFrame([(t, k, f"{t}-{k}", 1, 10 * t + k, 1) for t in range(9) for k in range(3)], T.FILES)
    got = {(r["task"], r["roll"]): r["start"] for r in T.with_starts(files, block=2).collect()}
    at = 0
    for t in range(9):
        for k in range(3):
            assert got[t, k] == at
            at += 10 * t + k


def test_views_of_the_mapped_file(tmp_path):
    out = T.SequenceWriter(f"{tmp_path}/one.arrow", length=4, batch=2)
    out.add([9, 8], np.arange(1, 12, dtype="<u4"), np.array([3, 8]))
    out.close()
    before = pa.total_allocated_bytes()
    file = T.SequenceFile(f"{tmp_path}/one.arrow")
    batch, ids = file.batch(0), file.ids(0)
    assert pa.total_allocated_bytes() - before < 64 and not ids.flags.owndata and ids.dtype == np.uint16
    assert file[2][0].tolist() == [9, 10, 11, 0] and file[2][1].to_pylist() == [True, True, True, False]
    assert batch["ended"].to_pylist() == [[9], []] and file.bits(1, "last").tolist() == [[False, False, True, False]]
    assert [(s.tolist(), n.tolist(), i.to_pylist()) for s, n, _, i in file.documents()] == [([0], [3], [9]), ([3], [8], [8])]


def test_wide_vocabularies_and_no_rows(spark, tmp_path):
    out = T.SequenceWriter(f"{tmp_path}/wide.arrow", length=2, batch=1, wide=True)
    out.add([1], np.array([70000, 2, 5], "<u4"), np.array([3]))
    out.close()
    assert T.SequenceFile(f"{tmp_path}/wide.arrow")[0][0].tolist() == [70000, 2]
    files = T.write_sequences(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/none")
    assert files.count() == 0 and T.documents_in(files).collect() == []
