"""Small functions that no query runs: portal mappings, writers, envelopes, tool rounds, noise and shards."""

import pytest
from pyspark.sql import functions as F

from civicflow.functions import spans, text as X
from civicflow.operators import dedup, scoring, selection
from civicflow.sources import connectors, readers, sinks


def test_tool_rounds(spark):
    class Searcher:
        """Asks a tool until its prompt holds a result; the word ``stubborn`` makes it ask for ever."""

        def extract(self, texts):
            return ["SEARCH: rules of " + t.split()[0] if "RESULT:" not in t or "stubborn" in t else "found " + t.rsplit("RESULT: ", 1)[1] for t in texts]

    rows = spark.createDataFrame([(1, "air"), (2, "stubborn"), (3, "water")], "id long, prompt string")
    tool = lambda q: q.select("question", F.when(F.col("question").contains("air"), "clean air act").alias("result"))
    got = {r["id"]: (r["answer"], r["rounds"]) for r in scoring.tool_loop(rows, "prompt", Searcher(), tool).collect()}
    assert got == {1: ("found clean air act", 2), 2: ("SEARCH: rules of stubborn", 3), 3: ("found none", 2)}


def test_claims_are_asked_again_only_where_they_fail(spark, tmp_path):
    class OnSecondTry:
        """Answers with no list to a text that it sees for the first time, unless it is easy."""

        def __init__(self, folder):
            self.folder = folder

        def extract(self, texts):
            import os

            out = []
            for t in texts:
                mark = f"{self.folder}/{t}"
                out.append('["claim"]' if os.path.exists(mark) or t == "easy" else "no list")
                open(mark, "a").close()
            return out

    rows = spark.createDataFrame([("easy",), ("hard",)], "t string")
    for name in "ab":
        (tmp_path / name).mkdir()
    once = {r["t"]: r["parse_ok"] for r in scoring.claims(rows, "t", OnSecondTry(str(tmp_path / "a"))).collect()}
    twice = {r["t"]: r["parsed"] for r in scoring.claims(rows, "t", OnSecondTry(str(tmp_path / "b")), attempts=2).collect()}
    assert once == {"easy": True, "hard": False} and twice == {"easy": ["claim"], "hard": ["claim"]}


def test_evidence_lines(spark):
    hits = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", "a"), ("k", None), ("k", "c"), ("m", None)], "key string, text string")
    assert [tuple(r) for r in scoring.evidence_lines(hits, "key", "text", 2).collect()] == [("k", ["a", "b"])]


def test_representatives_and_singletons(spark):
    rows = spark.createDataFrame([("d", 1, "x"), ("d", 2, "x"), ("d", 3, "y"), ("d", 4, "z"), ("e", 5, "x")], "block string, id long, cluster string")
    got = dedup.representatives_and_singletons(rows, 2).collect()
    assert [(r["id"], r["size"]) for r in got if r["size"] > 1] == [(1, 2)] and len(got) == 3 and {r["id"] for r in got if r["size"] == 1} <= {3, 4, 5}


def test_shards_cover_all_items_once():
    items = ["c", "a", "b", "e", "d"]
    assert sorted(x for k in (1, 2) for x in selection.shard(items, k, 2)) == sorted(items) and selection.shard(items, 1, 2) == ["a", "c", "e"]
    for k in (0, 3):
        with pytest.raises(ValueError):
            selection.shard(items, k, 2)


def test_envelopes(spark):
    rows = spark.createDataFrame([("x", None), (None, ["y", "z"]), (None, None), ("x", [])], "one string, many array<string>")
    assert [r[0] for r in rows.select(selection.unwrapped(F.col("one"), F.col("many"))).collect()] == [["x"], ["y", "z"], [], []]


def test_cells_flags_and_surrogates(spark):
    rows = spark.createDataFrame([(" a, ,b ", "Yes", r"x😀y\ud83dz\ude00w"), (None, None, None), ("", "0", "plain"), ("a", " t ", r"\uDC00")], "cell string, flag string, s string")
    got = rows.select(X.split_cell(F.col("cell")), X.to_bool(F.col("flag")), X.without_surrogates(F.col("s"))).collect()
    assert [r[0] for r in got] == [["a", "b"], [], [], ["a"]] and [r[1] for r in got] == [True, False, False, True]
    assert [r[2] for r in got] == [r"x😀yzw", None, "plain", ""]


def test_noise_repeats_itself_and_keeps_words(spark):
    titles = ["National Emission Standards for Hazardous Air Pollutants from Lime Plants", "Two words", "", None]
    rows = spark.createDataFrame([(t,) for t in titles], "t string")
    first, again = ([r[0] for r in rows.select(spans.noised(F.col("t"), 3)).collect()] for _ in range(2))
    assert first == again and first[1:] == ["Two words", "", ""]
    assert first[0] and set(first[0].split()) <= set(titles[0].split()) and len(first[0].split()) < len(titles[0].split())


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "b"\nc'), ("2", None)], "id string, t string")
    sinks.write_both(df, str(tmp_path / "both"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "both/parquet")).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    back = readers.csv_table(spark, str(tmp_path / "both/csv"), readers.strings(["id", "t"]))
    assert {r["id"]: r["t"] for r in back.collect()} == {"1": 'a "b"\nc', "2": None}
    for n in (1, 2):
        sinks.log_run(spark, str(tmp_path / "log"), rows=n, note="x")
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.where("logged_at is not null").count() == 2 and {r["rows"] for r in log.collect()} == {"1", "2"}


def test_html_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<html><script>no</script><p>One</p><p>Two</p></html>")
    row = readers.html_documents(spark, str(tmp_path / "*.html")).first()
    assert row["path"].endswith("a.html") and row["text"].split() == ["One", "Two"]


def test_more_portals(spark):
    sec = connectors.sec(spark.createDataFrame([("S7-1", "u", "Ann", "2024-01-02"), ("S7-1", None, "Bo", None)], "file_number string, pdf_url string, submitter string, posted_date string"))
    assert sec.columns == connectors.COLUMNS
    rows = sec.orderBy("submitter_name").collect()
    assert rows[0]["agency_id"] == "SEC" and rows[0]["docket_id"] == "S7-1" and rows[0]["comment_id"].startswith("sec_") and rows[0]["comment_id"] != rows[1]["comment_id"]
    fdic = connectors.fdic(spark.createDataFrame([("3064-A", "u", "Ann")], "rin string, pdf_url string, submitter string")).first()
    assert (fdic["agency_id"], fdic["docket_id"], fdic["attachment_urls"]) == ("FDIC", "3064-A", "u")
    fed = connectors.federal_reserve(spark.createDataFrame([("9", "R-1", "Bank of X, Ann Lee (PDF)", "2024", "u")], "letter_id string, docket string, display string, posted_date string, pdf_url string")).first()
    assert (fed["comment_id"], fed["submitter_org"], fed["submitter_name"]) == ("fed_9", "Bank of X", "Ann Lee")
    kinds = "letter_id string, project_id string, author string, organization string, date_submitted string, download_url string, detail_url string, attachments array<string>"
    cara = connectors.cara(spark.createDataFrame([("4", "77", "Ann", None, "2024", "a", "", ["b", None]), ("5", "77", None, "Org", None, None, None, None)], kinds)).orderBy("comment_id").collect()
    assert [(r["comment_id"], r["docket_id"], r["attachment_urls"]) for r in cara] == [("cara_4", "cara_project_77", "a;b"), ("cara_5", "cara_project_77", "")]


def test_covered_spans_take_one_shuffle(spark):
    """Pieces were a table that was aggregated twice and joined, with all bounds of a text in each row."""
    from civicflow.sources.sinks import covered_spans

    rows = [(1, 0, 10, 1), (1, 4, 6, 2), (1, 6, 8, 1), (1, 20, 20, 5), (1, 12, 15, 1), (1, 15, 18, 1), (2, 3, 5, 0), (2, 3, 5, 0), (3, 9, 2, 1), (4, None, 3, 1), (None, 1, 2, 1)]
    df = spark.createDataFrame(rows, "k int, start int, end int, level int")
    got = covered_spans(df, "k")
    assert sorted(map(tuple, got.collect())) == [(1, 0, 4, 1), (1, 4, 6, 2), (1, 6, 10, 1), (1, 12, 18, 1), (2, 3, 5, 0)]
    assert got._jdf.queryExecution().sparkPlan().toString().count("Aggregate") <= 2 and "Join" not in got._jdf.queryExecution().sparkPlan().toString()


def test_classes_are_made_distinct_in_bounded_tasks(spark, monkeypatch):
    """Tasks took as many rows as a split or a fixed number of partitions gave them, so their memory grew with the table."""
    from civicflow.operators import validation as V

    rows = spark.range(3000).selectExpr("id % 1000 as a", "id % 500 as b")
    got = V.distinct_rows(rows, items=10)
    assert got.rdd.getNumPartitions() >= 300 and got.count() == 1000
    assert max(map(len, got.rdd.glom().collect())) < 30
    assert V.distinct_rows(rows.limit(0)).count() == 0
