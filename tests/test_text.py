"""Scalar functions on the edge rows of FIXTURES.md."""

import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annotary.functions import candidates as C
from annotary.functions import text as X
from annotary.functions import tokenizer


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("x")).head()["x"]


@pytest.mark.parametrize(
    ("languages", "pubdate", "want"),
    [("eng", "1980", False), ("eng", "1981", True), ("eng", None, False), ("fre", "2000", False), ("eng; fre", "2000", False), (None, "2000", False),
     ("eng", "1999", True), ("eng", " 1999 ", True), ("eng", "1999.5", False), ("eng", "x", False)],
)
def test_eligible(spark, languages, pubdate, want):
    df = spark.createDataFrame([(languages, pubdate)], "l string, p string")
    assert df.select(X.eligible(F.col("l"), F.col("p")).alias("x")).head()["x"] is want


@pytest.mark.parametrize(("title", "abstract", "want"), [("T", "A", "T A"), (None, "A", "A"), (None, None, ""), (" T", "A\n", "T A"), ("", "", ""), ("T", None, "T")])
def test_tiab(spark, title, abstract, want):
    df = spark.createDataFrame([(title, abstract)], "t string, a string")
    assert df.select(X.tiab(F.col("t"), F.col("a")).alias("x")).head()["x"] == want


@pytest.mark.parametrize(("date", "want"), [("2001-05-03", 2001), ("2001", 2001), ("", None), ("x-1", None), (None, None)])
def test_year(spark, date, want):
    assert one(spark, date, X.year_of) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("ANSWER: G2P00001", "G2P00001"), ("ANSWER: a\nANSWER:\nG2P1;G2P2 ", "G2P1;G2P2"), ("thinking", None), ("", None), (None, None), ("ANSWER: \n", ""),
     ("answer: G2P1", None), ("ANSWER: NO MATCH", "NO MATCH"), ("ANSWER: a\rb", "a\rb")],
)
def test_last_answer(spark, text, want):
    assert one(spark, text, X.last_answer) == want


@pytest.mark.parametrize(("s", "want"), [("G2P1;;\"G2P2\"", ["G2P1", "G2P2"]), ("G2P1;' G2P2'", ["G2P1", " G2P2"]), (None, []), ("", []), (" ; ", []), ("a;a", ["a", "a"])])
def test_id_tokens(spark, s, want):
    assert one(spark, s, X.id_tokens) == want


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="aG2P '\"\t", max_size=8))
def test_clean_token_settles(spark, s):
    once = one(spark, s, X.clean_token)
    assert not once or (once[0] not in "'\"" and once[-1] not in "'\"")


@pytest.mark.parametrize(("s", "want"), [("7157", 7157), ("7157;672", 7157), (" 7157 ", 7157), ("12.0", 12), ("12.5", None), ("x", None), ("", None), (None, None)])
def test_first_number(spark, s, want):
    assert one(spark, s, X.first_number) == want


@pytest.mark.parametrize(("a", "b", "want"), [(["A"], ["A", "B"], True), (["A", "C"], ["A", "B"], False), ([], ["A"], False), (["A"], None, False), (None, ["A"], False), (["a"], ["A"], False), (["nan"], ["nan"], True)])
def test_subset(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(X.subset(F.col("a"), F.col("b")).alias("x")).head()["x"] is want


def test_max_score_leaves_nan_out(spark):
    kind = "array<struct<label:string,score:double>>"
    assert one(spark, [("a", float("nan")), ("b", 0.5)], X.max_score, kind) == 0.5
    assert one(spark, [("a", float("nan"))], X.max_score, kind) is None
    assert one(spark, [], X.max_score, kind) is None
    assert one(spark, None, X.max_score, kind) is None


def test_labels_drop_blanks_before_the_cut(spark):
    kind = "array<struct<label:string,score:double>>"
    assert one(spark, [(" ", 1.0), (None, 1.0)] + [(f" l{i} ", 1.0) for i in range(6)], C.labels, kind) == ["l0", "l1", "l2", "l3", "l4"]
    assert one(spark, None, C.labels, kind) == []


@pytest.mark.parametrize(
    ("raw", "want"),
    [('[{"label": "a", "score": 1}, {"label": " "}]', ["a"]), ('["a", "b"]', ["a", "b"]), ('[["a", 0.5]]', ["a"]), ("[('a', 0.5), ('b', 1)]", ["a", "b"]),
     ("[{'label': 'x'}]", ["x"]), ("[broken", []), (None, []), ('{"label": "a"}', []), ("[]", [])],
)
def test_labels_of_text_forms(spark, raw, want):
    assert one(spark, raw, C.any_labels) == want


@pytest.mark.parametrize(("path", "want"), [("/a/b/x.xml.gz", "x"), ("x.xml.gz", "x"), ("file:/q/pubmed24n0001.xml.gz", "pubmed24n0001"), ("x", "x")])
def test_stem(spark, path, want):
    assert one(spark, path, X.stem) == want


def test_prompt_and_lines(spark):
    df = spark.createDataFrame([(None, ["a", "b"])], "t string, l array<string>")
    assert df.select(X.candidate_lines(F.col("l")).alias("x")).head()["x"] == "1) a\n2) b"
    assert df.select(X.prompt(F.col("t"), F.col("l"), ("<", "|", ">")).alias("x")).head()["x"] == "<|1) a\n2) b>"


@pytest.mark.skipif(not os.path.exists(tokenizer.VOCABULARY), reason="no vocabulary here")
def test_token_ids(spark):
    vocabulary = tokenizer.read_vocabulary(spark)
    texts = ["A gene variant, c.77G>A; and more.", "", None, "é 漢字 " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["ids"] for r in df.select("i", tokenizer.token_ids(F.col("t"), vocabulary).alias("ids")).collect()}
    c = tokenizer.coder(vocabulary)
    assert c.decode(got[0]) == texts[0] and got[1] == got[2] == [] and len(got[3]) == 512 and got[3] == c.encode_ordinary(texts[3])[:512]


def test_padding_by_batch():
    lists = [[1] * n for n in (3, 9, 8, 1, 17)]
    got = list(tokenizer.padded_batches(lists, size=2, multiple=8))
    assert [[len(x) for x in b] for b in got] == [[16, 16], [8, 8], [24]] and got[0][0] == [1, 1, 1, *[0] * 13]
