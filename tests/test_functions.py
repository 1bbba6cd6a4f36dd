import math

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import core as N
from weftgraph.functions.htmltext import main_text
from weftgraph.operators.chunking import group_sentences
from weftgraph.schemas import STOP_WORDS


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("tnf-alpha factor", "Tnf-Alpha Factor"), ("IL6 receptor", "Il6 Receptor"), ("", ""), (None, None)],
)
def test_title_case(spark, text, want):
    assert one(spark, N.title_case(F.col("t")), t=text) == want


@pytest.mark.parametrize(("key", "want"), [("birth date", "birthDate"), ("  Two  Words here ", "twoWordsHere"), ("ONE", "one"), (" ", " ")])
def test_camel_key(spark, key, want):
    assert one(spark, N.camel_key(F.col("k")), k=key) == want


@pytest.mark.parametrize(("text", "want"), [("does not bind", True), ("Not bound", True), ("nothing binds", False), ("lacks it", False), ("a lack of it", True), (None, False)])
def test_has_negation(spark, text, want):
    assert one(spark, N.has_negation(F.col("t")), t=text) is want


def test_snippet(spark):
    assert one(spark, N.snippet(F.col("t")), t="short ") == "short"
    assert one(spark, N.snippet(F.col("t")), t="") is None
    long = "word " * 100
    assert one(spark, N.snippet(F.col("t")), t=long) == "word " * 42 + "word" + "…"


def test_search_terms(spark):
    assert one(spark, N.search_terms(F.col("t")), t="The TNF-alpha and the tnf-alpha of an IL6 ab") == ["TNF-alpha", "IL6"]
    assert len(STOP_WORDS) == len(set(STOP_WORDS))


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r.x for r in df.select(N.cosine(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [pytest.approx(1 / math.sqrt(2)), 0.0]


def test_parse_ts_and_unfence(spark):
    assert str(one(spark, N.parse_ts(F.col("t")), t="2024-05-06T07:08:09Z")) == "2024-05-06 07:08:09"
    assert str(one(spark, N.parse_ts(F.col("t")), t="never")) == "1970-01-01 00:00:00"
    assert one(spark, N.unfence(F.col("t")), t='```json\n{"a": 1}\n```') == '{"a": 1}'


def test_weighted_mean_skips_absent(spark):
    df = spark.createDataFrame([(0.5, None), (None, None), (1.0, 0.0)], "a double, b double")
    got = [r.x for r in df.select(N.weighted_mean([(F.col("a"), 0.2), (F.col("b"), 0.3)]).alias("x")).collect()]
    assert got == [0.5, None, pytest.approx(0.4)]


def test_annotate_replaces(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"},), (None,)], "m map<string,string>")
    got = [r.x for r in df.select(N.annotate(F.col("m"), a=F.lit("9")).alias("x")).collect()]
    assert got == [{"a": "9", "b": "2"}, {"a": "9"}]


def test_resolve_url(spark):
    df = spark.createDataFrame([("http://a.b/c/d", "../e?q=1"), ("http://a.b", None)], "u string, h string")
    assert [r.x for r in df.select(N.resolve_url("u", "h").alias("x")).collect()] == ["http://a.b/e?q=1", None]


def test_main_text():
    page = "<html><head><title> T </title><style>x{}</style></head><body><nav>menu</nav><p>before</p><main><h1>A</h1> b<script>no</script></main><footer>f</footer></body></html>"
    assert main_text(page) == ("T", "A b")
    assert main_text("<p>only &amp; text</p>") == ("", "only & text")
    assert main_text("") == ("", "")


def test_group_sentences():
    import numpy as np

    a, b = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    assert group_sentences(np.array([a, a, b, b]), [40, 40, 40, 40], 512, 30, 0.5) == [[0, 1], [2, 3]]
    assert group_sentences(np.array([a, a]), [300, 300], 512, 30, 0.5) == [[0], [1]]
    assert group_sentences(np.array([a, b]), [5, 40], 512, 30, 0.5) == [[0, 1]]
