import pytest
from hypothesis import given
from hypothesis import strategies as st

from termloom.functions import chars, hangul
from termloom.operators import product, rules, search, segment
from termloom.operators.rules import AnalyzerOptions, Dictionaries

DICTS = Dictionaries(unit={"CM", "MM", "GB", "GHZ", "V", "MA"})
# input: index mode, query mode (None: the same)
CASES = {
    "1b-12345": ("1b 12345 1b-12345", None),
    "b1/a2s": ("b1 a 2 s a2s b1/a2s", None),
    "c9-123567": ("c9 123567 9123567 c9-123567", "c9 123567 c9-123567"),
    "d8-1": ("d8 1 81 d8-1", "d8 1 d8-1"),
    "1b/a2s": ("1b a ba 2 s a2s 1b/a2s", "1b a 2 s a2s 1b/a2s"),
    "9c-abcdef": ("9c abcdef cabcdef 9c-abcdef", "9c abcdef 9c-abcdef"),
    "8a/b": ("8a b ab 8a/b", "8a b 8a/b"),
    "1A-B2C3D4": ("1A B AB 2 C 3 D 4 B2C3D4 1A-B2C3D4", "1A B 2 C 3 D 4 B2C3D4 1A-B2C3D4"),
    "AKSO-1X": ("AKSO 1X AKSO-1X", None),
    "120x60cm": ("120 60 60cm", "120 60cm"),
}


def terms(text, dicts=DICTS, **options):
    found = rules.terms(text, dicts, AnalyzerOptions(**options))
    return sorted([r[0] for r in found] + [e[0] for r in found for e in r[7]])


@pytest.mark.parametrize("text", CASES)
def test_model_names(text):
    index, query = CASES[text]
    assert terms(text) == sorted(index.split())
    assert terms(text, use_for_query=True) == sorted((query or index).split())


def test_stopwords_and_synonyms():
    dicts = Dictionaries(stop={"THE"}, synonym={"COLD": ["icy"]}, unit=DICTS.unit)
    assert terms("the cold", dicts, use_for_query=True) == ["cold"]
    assert rules.terms("cold", dicts, AnalyzerOptions.filter_defaults())[0][6] == ["icy"]
    tree = product.query_of("cold", dicts)
    assert search.explain(tree) == {"AND": [{"OR": ["cold", "icy"]}]}
    assert search.terms_of(tree) == ["cold", "icy"]


@given(st.text(max_size=60))
def test_any_text_is_segmented_in_order(text):
    at = 0
    for start, end, _, _ in segment.segment_text(text, lambda w: None):
        assert at <= start < end <= len(text)
        at = end
    rules.terms(text, DICTS, AnalyzerOptions())


@given(st.integers(hangul.BASE, hangul.LAST))
def test_syllables_join_again(code):
    assert hangul.combine(*hangul.split(chr(code))) == chr(code)


def test_types_agree_with_columns(spark):
    words = ["abc", "12", "a1", "a-1", "-a", "가나", "ㄱ", "カナ", "漢字", "", "a b", "±"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select("w", chars.term_type(df.w).alias("t")).collect():
        assert r.t == chars.term_type_of(r.w), r.w


def test_empty_and_null_names(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, "x" * 5000)], "doc_id long, text string")
    found = product.analyse(df, DICTS)
    assert {r.doc_id for r in found.select("doc_id").distinct().collect()} == {4}
    assert product.analyse(df.limit(0), DICTS).count() == 0
