import pytest

from termloom.operators import dictionary, large, product
from termloom.operators.rules import AnalyzerOptions
from termloom.plans import catalog

ROWS = catalog.SOURCE_ROWS + [
    ("SYNONYM", "노트북", "랩탑 컴퓨터,notebook", None), ("UNIT_SYNONYM", None, "cm,센티", None), ("USER", "ab12", None, None), ("STOP", "가방", None, None),
    ("COMPOUND", "widget", "w,idget", None), ("COMPOUND", "컴퓨터", "컴,퓨터", None), ("SPACE", "삼성노 트북", None, None),
]
NAMES = [*catalog.NAMES, "노트북 120cmx60cm 가방", "삼성노트북15인치", "wid get widget cold", "c9-123567 1,024GB", "가방", "ab12", " ", "", None, "노트북 12345", "Brand13 " * 40]


@pytest.mark.parametrize("lexicon", [False, True])
@pytest.mark.parametrize("query", [False, True])
def test_join_equals_snapshot(spark, lexicon, query):
    rows = spark.createDataFrame(ROWS, dictionary.SOURCE)
    words = [("노트북", "N", -8.0), ("노트", "N", -9.0), ("북", "N", -16.0), ("삼성", "N", -8.0), ("컴퓨터", "N", -8.0), ("랩탑", "N", -9.0), ("삼성", "V", -9.0)]
    lex = spark.createDataFrame(words, "key string, tag string, prob double") if lexicon else None
    names = spark.createDataFrame([(i // 2, n, "x") for i, n in enumerate(NAMES + NAMES)], "doc_id long, text string, rows string")
    options = AnalyzerOptions(use_for_query=query, use_full_string=True)
    wanted = product.analyse(names, dictionary.snapshot(rows, lex), options)
    found = large.analyse(names, rows, lex, options)
    assert found.schema == wanted.schema
    assert sorted(map(repr, found.collect())) == sorted(map(repr, wanted.collect()))
    assert wanted.where("size(synonyms) > 0").count() == 0 or query


def test_empty_tables(spark):
    rows = spark.createDataFrame([], dictionary.SOURCE)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert large.analyse(none, rows).count() == 0
    some = spark.createDataFrame([(1, "a-1 b")], "doc_id long, text string")
    assert large.analyse(some, rows).collect() == product.analyse(some, dictionary.snapshot(rows)).collect()


def test_size_picks_the_way(spark, monkeypatch):
    rows = spark.createDataFrame(ROWS, dictionary.SOURCE)
    names = spark.createDataFrame([(1, "cold widget 12cm")], "doc_id long, text string")
    small = large.analyse_tables(names, rows).collect()
    monkeypatch.setattr(dictionary, "SNAPSHOT_ROWS", 3)
    with pytest.raises(ValueError):
        dictionary.snapshot(rows)
    assert sorted(map(repr, large.analyse_tables(names, rows).collect())) == sorted(map(repr, small))
