"""Several writers, crashes, batches that come again, compaction."""

import threading

import pytest
from pyspark.sql import functions as F

from civicflow.storage import put_if_absent
from civicflow.streaming.versioned import VersionedTable

ROWS = "k string, n long, v string"


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/t", ["k"], "n", buckets=4)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), ROWS)


def rows(df):
    return sorted((r["k"] or "", r["n"], r["v"]) for r in df.collect())


def test_later_commits_win(spark, table):
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.upsert(frame(spark, ("a", 5, "old"), ("a", 6, "newer"), ("b", 1, "x"), (None, 1, "null key"))) == 1
    assert table.upsert(frame(spark, ("a", 2, "later"), ("c", 1, None))) == 2
    want = [("", 1, "null key"), ("a", 2, "later"), ("b", 1, "x"), ("c", 1, None)]
    assert rows(table.read()) == want
    assert rows(table.lookup(frame(spark, ("a", 0, ""), ("z", 0, "")))) == [("a", 2, "later")]
    assert table.compact() == 3 and rows(table.read()) == want and table.compact() is None
    assert len(table.vacuum()) == 2 and rows(table.read()) == want
    assert table.upsert(frame(spark, ("c", 1, "again"))) == 4 and ("c", 1, "again") in rows(table.read())


def test_a_batch_that_comes_again(spark, table):
    assert table.upsert(frame(spark, ("a", 1, "x")), "q:0") == 1
    assert table.upsert(frame(spark, ("a", 2, "y")), "q:1") == 2
    assert table.upsert(frame(spark, ("a", 1, "x")), "q:0") is None
    assert table.compact() == 3 and table.upsert(frame(spark, ("a", 1, "x")), "q:0") is None
    assert rows(table.read()) == [("a", 2, "y")]


def test_a_crash_between_data_and_entry(spark, table, monkeypatch):
    table.upsert(frame(spark, ("a", 1, "x")))
    monkeypatch.setattr(table, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.upsert(frame(spark, ("a", 2, "y")), "q:1")
    monkeypatch.undo()
    assert rows(table.read()) == [("a", 1, "x")]
    assert table.upsert(frame(spark, ("a", 2, "y")), "q:1") == 2 and rows(table.read()) == [("a", 2, "y")]


def test_writers_at_once(spark, table):
    table.upsert(frame(spark, ("all", 0, "first")))
    numbers, failed = [], []

    def write(who):
        try:
            numbers.append(table.upsert(frame(spark, (f"own{who}", 1, "x"), ("all", who, f"by {who}")), f"writer {who}"))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in range(1, 7)]
    threads += [threading.Thread(target=table.compact)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and len(set(numbers)) == 6
    log = {e["no"]: e for e in table._log()}
    last = max(numbers)
    assert sorted(log) == list(range(1, len(log) + 1))
    found = dict((k, v) for k, _, v in rows(table.read()))
    assert {f"own{w}" for w in range(1, 7)} < found.keys() and found["all"] == "by " + log[last]["tag"].split()[1]


def test_a_compaction_that_another_overtakes(spark, table, monkeypatch):
    for n in range(3):
        table.upsert(frame(spark, ("a", n, f"v{n}")))
    write = VersionedTable._written

    def meanwhile(self, df):
        monkeypatch.undo()
        folder = write(self, df)
        assert table.upsert(frame(spark, ("a", 0, "meanwhile"), ("b", 0, "new"))) == 4
        assert table.compact() == 5
        return folder

    monkeypatch.setattr(VersionedTable, "_written", meanwhile)
    assert table.compact() is None
    assert rows(table.read()) == [("a", 0, "meanwhile"), ("b", 0, "new")]


def test_a_write_during_compaction_wins(spark, table, monkeypatch):
    for n in range(2):
        table.upsert(frame(spark, ("a", n, f"v{n}")))
    write = VersionedTable._written

    def meanwhile(self, df):
        monkeypatch.undo()
        folder = write(self, df)
        table.upsert(frame(spark, ("a", 0, "meanwhile")))
        return folder

    monkeypatch.setattr(VersionedTable, "_written", meanwhile)
    assert table.compact() == 4 and rows(table.read()) == [("a", 0, "meanwhile")]


def test_stream_batches(spark, table, tmp_path):
    def run():
        stream = spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in")
        stream.writeStream.foreachBatch(table.foreach_batch()).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)

    frame(spark, ("a", 1, "x"), ("b", 1, "y")).write.parquet(f"{tmp_path}/in")
    run()
    frame(spark, ("b", 0, "z")).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert rows(table.read()) == [("a", 1, "x"), ("b", 0, "z")] and [e["no"] for e in table._log()] == [1, 2]
    for name in ("1", ".1.crc"):  # the driver was lost between the commit here and the stream's own
        (tmp_path / "c" / "commits" / name).unlink()
    run()
    assert rows(table.read()) == [("a", 1, "x"), ("b", 0, "z")] and [e["no"] for e in table._log()] == [1, 2]


def test_one_of_many_creates_a_file(spark, tmp_path):
    path, made = f"file://{tmp_path}/one.json", []
    threads = [threading.Thread(target=lambda n=n: made.append(put_if_absent(spark, path, f"by {n}"))) for n in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(made) == [False] * 7 + [True] and spark.read.text(path).agg(F.count("*")).first()[0] == 1
