"""Readers, connectors, sinks and streams on small files."""

import json

from pyspark.sql import functions as F

from civicflow.sources import connectors, readers, sinks
from civicflow.streaming import events as E


def test_csv_with_lines_and_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"two\nlines, ""quoted"""\n2,\n')
    schema = readers.strings(["id", "text"])
    got = readers.csv_table(spark, str(tmp_path / "a.csv"), schema).orderBy("id").collect()
    assert got[0]["text"] == 'two\nlines, "quoted"' and got[1]["text"] is None
    assert readers.csv_table(spark, str(tmp_path / "a.csv"), schema, keep_blanks=True).where("id = '2'").first()["text"] == ""
    assert readers.csv_some(spark, str(tmp_path / "a.csv"), schema, ["text", "missing"]).columns == ["text"]


def test_paths():
    assert readers.preferred_files(["a/x.csv", "a/x.csv.gz", "b/y.csv"]) == ["a/x.csv.gz", "b/y.csv"]
    assert readers.base_files(["a/x.csv", "a/x_all_text.csv", "a/x__claims.csv"]) == ["a/x.csv"]
    assert readers.years("2017-2019,2021") == [2017, 2018, 2019, 2021]


def test_all_documents_knows_origin(spark, tmp_path):
    folder = tmp_path / "epa" / "epa_2020_2021"
    folder.mkdir(parents=True)
    (folder / "rule_all_text.csv").write_text("id\n7\n")
    got = readers.all_documents(spark, [str(folder / "rule_all_text.csv")], readers.strings(["id"])).first()
    assert (got["agency"], got["period"], got["doc_type"]) == ("epa", "2020_2021", "rule")


def test_jsonl_skips_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "x"}\nbroken\n{"a": 2}\n')
    assert sorted(r["a"] for r in readers.jsonl(spark, str(tmp_path / "a.jsonl"), "a int, b string").collect()) == [1, 2]
    assert readers.jsonl_with(spark, str(tmp_path / "a.jsonl"), "a int, b string", '"a": 2').count() == 1


def test_copy_blocks(spark, tmp_path):
    (tmp_path / "d.sql").write_text("SET x;\nCOPY public.docs (id, body) FROM stdin;\n1\tone\\ttab\n2\t\\N\n3\n\\.\nCOPY other (a) FROM stdin;\n9\n\\.\n")
    got = readers.copy_blocks(spark, str(tmp_path / "d.sql"), {"docs": ["id", "body"], "other": ["a"]})
    assert sorted((r["id"], r["body"]) for r in got["docs"].collect()) == [("1", "one\ttab"), ("2", None)]
    assert got["other"].first()["a"] == "9"


def test_extractor_failures_are_reported(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"ok")
    (tmp_path / "b.bin").write_bytes(b"bad")

    def pages(data):
        if data == b"bad":
            raise ValueError("broken")
        return ["one", "two"]

    got = {r["path"][-5:]: r for r in readers.extracted(spark, str(tmp_path), pages).collect()}
    assert got["a.bin"]["text"] == "<<PAGE 1>>\none\n<<PAGE 2>>\ntwo" and "broken" in got["b.bin"]["error"]


def test_connectors_share_one_schema(spark):
    filing = spark.createDataFrame([("5", [("F",)], [("17-108",), ("18-1",)], [("u",)], "2020", None, "hello")], "id_submission string, filers array<struct<name:string>>, proceedings array<struct<name:string>>, documents array<struct<src:string>>, date_received string, date_submission string, text_data string")
    got = connectors.ecfs(filing)
    assert got.columns == connectors.COLUMNS and got.first()["docket_id"] == "17-108;18-1"
    fec = spark.createDataFrame([("REG 1", "9", ["Doe, Jane", "Org Inc"], "01/02/2020", "u")], "reg_number string, docid string, commenters array<string>, date string, url string")
    row = connectors.fec(fec).first()
    assert (row["comment_id"], row["submitter_name"], row["submitter_org"]) == ("REG_1_doc9", "Doe, Jane", "Org Inc")
    letters = spark.createDataFrame([("R", "a", "d", "<b>x</b>", "<a href='l'>y</a>")], "recipient string, agsinvolved string, datefiled string, specificissue string, copyofletter string")
    assert connectors.attorney_letters(letters).first()["attachment_urls"] == "l"
    subs = spark.createDataFrame([("1", "c1", "2020"), ("2", None, None)], "submission_id string, comment_id string, date_received string")
    texts, filers = spark.createDataFrame([("c1", "t")], "comment_id string, comment_text string"), spark.createDataFrame([("1", "B"), ("1", "A")], "submission_id string, name string")
    dump = {r["comment_id"]: r for r in connectors.dump_filings(subs, texts, filers, "17-108", "dump").collect()}
    assert dump["dump_1"]["submitter_name"] == "A; B" and dump["dump_2"]["comment_text"] == ""
    assert connectors.CONNECTORS["ferc"](spark.createDataFrame([("1", "t")], "id string, text string")).first()["comment_id"] == "ferc_1"
    shape = {"features": [{"properties": {"n": "1"}, "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}}]}
    assert connectors.point_features(spark.createDataFrame([(json.dumps(shape),)], "json string")).first()["lat"] == 2.0


def test_append_distinct_keeps_old_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, "id string, v int")
    sinks.append_distinct(make([("a", 1), ("a", 2), ("b", 3)]), path, "id", "v")
    sinks.append_distinct(make([("b", 9), ("c", 4)]), path, "id", "v")
    assert sorted((r["id"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3), ("c", 4)]


def test_done_units_and_partitions(spark, tmp_path):
    log = str(tmp_path / "log")
    assert sinks.done_units(spark, log).count() == 0
    sinks.mark_done(spark.createDataFrame([("u1",)], "unit string"), log)
    assert sinks.done_units(spark, log).first()["unit"] == "u1"
    out = str(tmp_path / "p")
    sinks.write_partitioned(spark.createDataFrame([("a", 1), ("b", 2)], "agency string, v int"), out, ["agency"])
    assert (tmp_path / "p" / "agency=a").is_dir()
    assert sinks.padded(spark.createDataFrame([(1,)], "x int"), ["x", "y", "source"], source="s").first().asDict() == {"x": 1, "y": None, "source": "s"}
    assert "| x | 1 |" in sinks.report(spark.createDataFrame([(1,)], "x int"))


def test_stream_appends_each_row_once(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "id string, v int")
    rows.write.parquet(src)
    for _ in range(2):
        E.keep_distinct(E.stream_table(spark, src, rows.schema), out, "id", "v", str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["a", "b"]
    rows.write.mode("append").parquet(src)
    E.keep_distinct(E.stream_table(spark, src, rows.schema), out, "id", "v", str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(out).count() == 2


def test_windows_run_on_streams(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.createDataFrame([("2024-01-01 00:01:00", "x", 1.0), ("2024-01-01 00:02:00", "x", 2.0), ("2024-01-02 00:00:00", "x", 3.0)], "t string, k string, v double").select(F.to_timestamp("t").alias("ts"), "k", "v").write.parquet(src)
    stream = E.stream_table(spark, src, spark.read.parquet(src).schema)
    q = E.tumbling(stream, "ts", "1 hour", ["k"], "v", delay="10 minutes").writeStream.format("memory").queryName("tumbled").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert spark.table("tumbled").first()["n"] == 2
    assert E.first_within(stream, "k", "ts", "1 hour").isStreaming
