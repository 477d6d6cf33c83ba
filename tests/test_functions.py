"""Edge cases of text, number, name and answer functions, and of chunking."""

import pytest
from pyspark.sql import functions as F

from civicflow.functions import answers, names, numbers as N, text as X
from civicflow.operators import chunking


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(fn(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(("value", "want"), [(None, False), ("", False), (" NaN ", False), ("None", False), ("x", True), ("0", True)])
def test_nonempty(spark, value, want):
    assert one(spark, value, X.nonempty) is want


@pytest.mark.parametrize(
    ("value", "want"),
    [
        (None, ""),
        ("Thank you for reading this.", ""),
        ("I object.\nSincerely,\nA. Person", "i object."),
        ("Dear Secretary,\nPlease re-\nconsider.", "please reconsider."),
        ("<<COMMENT 1>>\nSee attached\nMore text", "more text"),
        ("See https://x.org/a?b 12 Fed. Reg. 345 now", "see now"),
        ("Subject: hello\nBody text", "body text"),
    ],
)
def test_clean_comment(spark, value, want):
    assert one(spark, value, X.clean_comment) == want


def test_structured_notice(spark):
    body = "AGENCY: A\n\nACTION: Final rule.\n\nSUMMARY: We change\nthings.\n\nDATES: now"
    got = spark.createDataFrame([("T", body), (None, None)], "t string, b string").select(X.structured_notice(F.col("t"), F.col("b")).alias("r")).collect()
    assert [r["r"] for r in got] == ["T\nWe change\nthings.\nFinal rule.", ""]


def test_pages_urls_and_copy_fields(spark):
    assert one(spark, "<<PAGE 3>> a <<PAGE 12>>", X.last_page) == 12
    assert one(spark, "text", X.last_page) == 1 and one(spark, None, X.last_page) == 0
    assert one(spark, "http://a|https://b, c;\nhttp://d", X.url_count) == 3
    assert one(spark, "\\N", X.copy_unescaped) is None
    assert one(spark, r"a\tb\\n\n", X.copy_unescaped) == "a\tb\\n\n"


def test_display_name(spark):
    got = one(spark, "Bank of X, et. al., Jane Doe (PDF)", X.display_name)
    assert got["format"] == "PDF" and got["name"].endswith("Jane Doe")


def test_cosine_of_zero_vector_is_null(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert df.select(N.cosine(F.col("a"), F.col("b")).alias("r")).first()["r"] is None


@pytest.mark.parametrize(
    ("text", "last", "first"),
    [
        ('[] then <think>["no"]</think> ["a"]', ["a"], []),
        ('```json\n["x", "y",]\n```', ["x", "y"], ["x", "y"]),
        ('text ["a]b"] and ["c"]', ["c"], ["a]b"]),
        ("none", None, None),
        (None, None, None),
    ],
)
def test_lists_in_answers(text, last, first):
    assert answers.last_list(text) == last and answers.first_list(text) == first


def test_loose_list():
    assert answers.loose_list("['a', 'b']") == ["a", "b"] and answers.loose_list('"x"') == ["x"] and answers.loose_list(None) == []


def test_jaro_winkler():
    assert names.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert names.jaro_winkler("dwayne", "duane") == pytest.approx(0.84, abs=1e-6)
    assert names.jaro_winkler("", "a") == 0.0 and names.jaro_winkler("", "") == 0.0


def test_chunks_keep_budget_and_overlap():
    paras = [f"p{i} " + "w " * 9 for i in range(10)]
    got = chunking.chunk_text("\n\n".join(p.strip() for p in paras), 30, 10)
    assert all(len(c.split()) <= 30 for c in got)
    assert {f"p{i}" for i in range(10)} <= set(" ".join(got).split())
    assert got[1].startswith("p2")  # the last paragraph of the first chunk again
    assert [len(c.split()) for c in chunking.chunk_text("x " * 75, 30, 10)] == [30, 30, 15]
    assert chunking.chunk_text("", 30, 10) == [""]


def test_kept_responses_prefers_longer():
    assert chunking.kept_responses(["a b c d", "a b c d e f", "x y"]) == ["a b c d e f", "x y"]
    assert chunking.kept_responses([]) == []


def test_passages_are_located(spark):
    from civicflow.functions import spans

    text = "x" * 100 + "The agency shall publish a notice within thirty days of receipt." + "y" * 100
    assert spans.locate_passage(text, "The agency shall publish a notice")[2] == "exact"
    assert spans.locate_passage(text, "The agency shall publish a notice within thirty days of receipt, always and again")[2] == "prefix"
    near = spans.locate_passage(text, "The agency must publish the notice within thirty days from receipt.", step=5)
    assert near[2] == "similar" and abs(near[0] - 100) <= 10
    assert spans.locate_passage(text, "nothing like it, at all, ever") is None and spans.locate_passage("", "a") is None
    got = spark.createDataFrame([(text, "The agency", None), (None, "x", None)], "t string, p string, s string").select(spans.located(F.col("t"), F.col("p"), F.col("s")).alias("r")).collect()
    assert got[0]["r"]["start"] == 100 and got[1]["r"]["start"] is None
    title = "Proposed rule on the labelling of imported goods"
    assert spans.noised_title(title) == spans.noised_title(title) and set(spans.noised_title(title).split()) < set(title.split())


def test_scorers_and_extractors(spark):
    from civicflow.operators import scoring

    class Small(scoring.WordScorer):
        def score(self, pairs):
            if len(pairs) > 1:
                raise MemoryError
            return super().score(pairs)

    pairs = spark.createDataFrame([("a b", "b c"), ("x", None)], "l string, r string")
    assert sorted(r["score"] for r in scoring.scored_pairs(pairs, "l", "r", Small()).collect()) == [0.0, 0.5]
    docs = spark.createDataFrame([(1, "We object. Fine."), (2, None)], "id int, text string")
    got = {r["id"]: r for r in scoring.claims(docs, "text", scoring.PatternExtractor("object")).collect()}
    assert got[1]["parsed"] == ["We object."] and got[2]["parsed"] == [] and got[1]["parse_ok"]
