import math
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.config import Settings
from termloom.functions import ngrams, tags, text

from . import brute


def column(spark, values, expr):
    """Values of a column expression over a one-column table."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_normalize_examples(spark):
    given_ = ["  Café & Bar!  ", "A\tB\n c", "pre-fab / 4k", "ﬁne ½ pint™", "Ünïcödé", "&", "日本", "'"]
    want = ["cafe and bar", "a b c", "pre-fab / 4k", "fine 12 pinttm", "unicode", "and", "", ""]
    assert column(spark, given_, text.normalize_text) == want


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=12), min_size=40, max_size=60))
def test_fold_equals_compatibility_decomposition(spark, values):
    values = [v.encode("utf-8", "ignore").decode() for v in values]
    want = [unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode() for v in values]
    assert column(spark, values, text.fold_ascii) == want


def test_slug(spark):
    values = ["Best CRM / Tools", "--", "x" * 90, "é-è"]
    assert column(spark, values, text.stable_slug) == ["best-crm-tools", "cluster", "x" * 80, "e-e"]


def test_numbers(spark):
    cases = {
        "1,900": 1900.0, "12,100": 12100.0, "34%": 34.0, "3.4": 3.4, "£1 200": 1200.0,
        " $5 ": 5.0, "1e3": 1000.0, "+7": 7.0, ".5": 0.5, "5.": 5.0, "-3": -3.0,
        "n/a": None, "-": None, "--": None, "": None, "none": None, "NULL": None, "1d": None,
        "1f": None, "inf": None, "nan": None, "1e999": None, "abc": None, " 1 ": 1.0,
    }
    assert column(spark, list(cases), text.clean_numeric) == list(cases.values())


def test_numeric_columns_lose_only_what_is_not_finite(spark):
    df = spark.createDataFrame([(1.5,), (math.nan,), (math.inf,), (None,)], "x double")
    cleaned = df.select(text.clean_numeric(F.col("x"), df.schema["x"].dataType)).collect()
    assert [r[0] for r in cleaned] == [1.5, None, None, None]
    assert [r[0] for r in text.json_safe(df).collect()] == [1.5, None, None, None]


def test_round_or_null(spark):
    values = ["3.14159", "NaN", "Infinity", "x", None]
    assert column(spark, values, lambda c: text.round_or_null(c, 2)) == [3.14, None, None, None, None]


def test_urls(spark):
    values = ["\thttp://pier.example/boats?b=1 ", None, "-", "N/A", "nan"]
    assert column(spark, values, text.clean_url) == ["http://pier.example/boats?b=1", "", "", "", ""]


def test_title_case_is_pythons(spark):
    values = ["pre-fab 4k tv", "a/b c", "how 2 do", "x1y2", ""]
    assert column(spark, values, text.title_case) == [v.title() for v in values]


def test_formula_guard(spark):
    values = ["=1+1", "+a", "-b", "@c", "plain", ""]
    assert column(spark, values, text.formula_guard) == ["'=1+1", "'+a", "'-b", "'@c", "plain", ""]


def test_intent_precedence(spark):
    values = ["best price", "best login", "login page", "what is crm", "alternative to x", "bestow"]
    want = ["transactional", "commercial", "navigational", "informational", "commercial",
            "informational"]
    assert column(spark, values, tags.tag_intent) == want


def test_modifiers_keep_their_order(spark):
    values = ["how to compare top prices", "review price best", "alternatives", "nothing"]
    want = ["best+compare+learn", "best+review+pricing", "alternatives", "core"]
    assert column(spark, values, tags.tag_modifiers) == want


def test_page_type(spark):
    values = ["how to buy", "best guide", "guide to x", "x"]
    got = column(spark, values, lambda c: tags.tag_page_type(c, tags.tag_intent(c)))
    assert got == ["money-page", "comparison", "guide", "article"]


def test_brand_matches_inside_words_and_escapes(spark):
    values = ["acmeware login", "a.c tools", "abc tools", "other"]
    got = column(spark, values, lambda c: tags.tag_brand(c, ("ACME", " ", "a/c+")))
    assert got == [True, False, False, False]
    assert column(spark, values, lambda c: tags.tag_brand(c, ())) == [False] * 4


def test_topic_root(spark):
    values = ["best crm software for small teams in europe", "how to", "the"]
    assert column(spark, values, tags.topic_root) == ["crm software small teams", "how to", "the"]


def test_ngrams_equal_brute_force(spark):
    values = ["a b", "best crm-software 4k", "x", "how to use ai", "aa", "", "one two three four"]
    assert column(spark, values, ngrams.word_ngrams) == [brute.grams(v)["word"] for v in values]
    assert column(spark, values, ngrams.char_wb_ngrams) == [brute.grams(v)["char"] for v in values]


def test_rule_lists_are_parameters(spark):
    custom = Settings(transactional_words=("rent",), commercial_words=())
    values = ["rent a car", "buy a car", "best car"]
    got = column(spark, values, lambda c: tags.tag_intent(c, custom))
    assert got == ["transactional", "informational", "informational"]
