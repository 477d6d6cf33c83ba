"""Requests, archives, file names and claims."""

import io
import zipfile

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from civicflow.sources import fetching as S


def test_attempts_and_waits():
    waits, answers = [], iter([(503, b""), OSError("gone"), (200, b"x")])

    def get(url):
        if isinstance(found := next(answers), Exception):
            raise found
        return found

    assert S.attempted("u", get, 5, 0.5, waits.append) == (200, b"x", 3, None) and waits == [0.5, 1.0]
    waits.clear()
    assert S.attempted("u", lambda u: (404, b"no"), 5, 1, waits.append) == (404, None, 1, "status 404") and not waits
    assert S.attempted("u", lambda u: (429, b""), 3, 1, waits.append) == (429, None, 3, "status 429") and waits == [1, 2]


def test_fetched(spark):
    def get(url):
        if url == "bad":
            raise ValueError(url)
        return (200, url.encode() * 3) if url != "lost" else (410, b"")

    urls = spark.createDataFrame([(u,) for u in ["a", "b", "a", "bad", "lost", None]], "url string")
    got = {r["url"]: r for r in S.fetched(urls, get, attempts=2, wait=0.0, workers=2, most_bytes=4).collect()}
    assert set(got) == {"a", "b", "bad", "lost"} and bytes(got["a"]["body"]) == b"aaa" and got["a"]["attempts"] == 1
    assert got["bad"]["status"] is None and got["bad"]["error"] == "ValueError: bad" and got["bad"]["attempts"] == 2
    assert got["lost"]["status"] == 410 and got["lost"]["body"] is None and got["lost"]["attempts"] == 1
    assert S.fetched(urls.limit(0), get).count() == 0


def test_unzipped(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a/one.csv", "x")
        z.writestr("two.txt", "y")
        z.writestr("a/long.csv", "z" * 100)
        z.writestr("empty/", "")
    (tmp_path / "p.zip").write_bytes(data.getvalue())
    (tmp_path / "q.zip").write_bytes(b"no archive")
    got = {r["member"]: r for r in S.unzipped(spark, str(tmp_path), r".*\.csv", longest=99).collect()}
    assert set(got) == {"a/one.csv", "a/long.csv", None} and bytes(got["a/one.csv"]["content"]) == b"x"
    assert got["a/long.csv"]["content"] is None and got["a/long.csv"]["error"] == "over 99 bytes" and got[None]["error"].startswith("BadZipFile")


def test_names(spark, tmp_path):
    rows = spark.createDataFrame([(1, "r.csv"), (2, "r.csv"), (3, "n"), (4, "n"), (5, "r.csv"), (6, ".env"), (7, ".env"), (8, "a.b.gz")], "id int, name string")
    got = [r["unique_name"] for r in S.unique_names(rows, "name", "id").orderBy("id").collect()]
    assert got == ["r.csv", "r_1.csv", "n", "n_1", "r_2.csv", ".env", ".env_1", "a.b.gz"]
    assert S.without_numbered(["a/r.csv.gz", "a/r_1.csv.gz", "a_1/r.csv.gz"]) == ["a/r.csv.gz", "a_1/r.csv.gz"]
    (tmp_path / "x" / "y").mkdir(parents=True)
    for p in ("x/rule.csv", "x/y/rule.csv", "x/y/other.csv"):
        (tmp_path / p).write_text("1")
    assert sorted(r["path"].rsplit("x", 1)[-1] for r in S.files_below(spark, str(tmp_path), ["rule.csv"]).collect()) == ["/rule.csv", "/y/rule.csv"]


def test_work_order_keeps_all_units(spark):
    assert S.work_order(spark.range(100), "id").agg(F.sum("id")).first()[0] == 4950


def test_claims(spark, tmp_path):
    folder = tmp_path.as_uri()
    assert S.claim(spark, folder, "epa/2020 a") and not S.claim(spark, folder, "epa/2020 a") and S.claim(spark, folder, "epa/2020 b")
    S.release(spark, folder, "epa/2020 a")
    assert S.claim(spark, folder, "epa/2020 a")
    (tmp_path / "file").write_text("")
    with pytest.raises(Py4JJavaError):
        S.claim(spark, folder + "/file", "x")
