import pytest
from pyspark.sql import functions as F

from prosescan.functions import numbers as N
from prosescan.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "lang"), [("这是一段中文文本，用来测试语言检测。", "zh"), ("This is an English sentence used to test detection.", "en"), ("", "unknown"), ("12345 !!! ...", "unknown"), ("中文 mixed with a lot of English words here", "unknown")])
def test_language(spark, text, lang):
    assert one(spark, T.language(F.lit(text))) == lang


def test_tokens_and_sentences(spark):
    assert one(spark, T.tokens(F.lit("中文测试"))) == list("中文测试")
    assert one(spark, T.tokens(F.lit("Hello, World!"))) == ["hello", "world"]
    assert one(spark, T.sentences(F.lit("One. Two! Three?"))) == ["One.", "Two!", "Three?"]
    assert one(spark, T.sentences(F.lit("One.\n\n\nTwo."))) == ["One.", "Two."]
    assert one(spark, T.spaced_sentences(F.lit("Alpha.Bravo."))) == ["Alpha.Bravo."]
    assert one(spark, T.spaced_sentences(F.lit("Dr. Smith arrived."))) == ["Dr.", "Smith arrived."]
    assert one(spark, T.spaced_sentences(F.lit("   "))) == []
    assert one(spark, T.normalized(F.lit("“x” 「y」 \"z\""))) == '"x" "y" "z"'


def test_spans_and_moments(spark):
    got = one(spark, T.spans(F.lit("ab foo cd foo"), "foo"))
    assert [(x.start, x.end, x.text) for x in got] == [(3, 6, "foo"), (10, 13, "foo")]
    assert one(spark, T.spans(F.lit(""), "foo")) == []
    m = T.moments(F.array(*[F.lit(float(v)) for v in (2, 4, 4, 4, 5, 5, 7, 9)]))
    assert one(spark, T.mean(m)) == 5 and one(spark, T.spread(m)) == 2
    assert one(spark, T.spread(T.moments(F.array().cast("array<double>")))) is None


@pytest.mark.parametrize(("values", "median"), [([1, 2, 3], 2), ([1, 2, 3, 4], 2.5), ([], 0)])
def test_distribution(spark, values, median):
    got = one(spark, T.distribution(F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")))
    assert got.median == median and got.sample_count == len(values)


@pytest.mark.parametrize(("value", "want"), [(0, 1), (9, 5), (3.4, 3), (float("nan"), 3), (None, 3)])
def test_severity(spark, value, want):
    assert one(spark, N.clamp_severity(F.lit(value).cast("double"))) == want


def test_scores_and_rates(spark):
    assert one(spark, N.clamp_score(F.lit(1.7))) == 1 and one(spark, N.clamp_score(F.lit(float("nan")))) == 0 and one(spark, N.clamp_score(F.lit(None).cast("double"))) is None
    assert one(spark, N.tolerance_score(F.lit(3.0), F.lit(1.0))) == pytest.approx(1 / 3)
    a, b = F.create_map(F.lit("x"), F.lit(1.0)), F.create_map(F.lit("y"), F.lit(1.0))
    assert one(spark, N.rate_distance(a, b)) == 1 and one(spark, N.rate_distance(a, a)) == 0
    assert one(spark, N.blend_rates(a, b, F.lit(0.25))) == {"x": 0.25, "y": 0.75}
    assert one(spark, N.punctuation_score(a, a)) == 1
