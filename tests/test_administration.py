import json

import pytest
from pyspark.sql import functions as F

from termloom.operators import administration, dictionary, morph, product, search, segment
from termloom.plans import catalog


def test_configuration():
    text = json.dumps({"basePath": "/d", "dictionary": [{"name": "a", "type": "synonym", "tokenType": "HIGH", "seq": 2}, {"name": "b", "ignoreCase": False, "filePath": "x/b.txt", "label": "B"}]})
    assert administration.load_config(text) == [("a", "SYNONYM", "HIGH", True, "/d/dict/a.dict", 2, None), ("b", "SET", None, False, "/d/x/b.txt", 0, "B")]
    assert administration.load_config("{}") == []


def test_word_files_and_export(spark, tmp_path):
    (tmp_path / "s.dict").write_text("티비\t텔레비전,TV\n노트북,랩탑\n\n")
    rows = administration.word_file(spark, str(tmp_path / "s.dict"), "SYNONYM")
    assert {tuple(r)[1:3] for r in rows.collect()} == {("티비", "텔레비전,TV"), (None, "노트북,랩탑")}
    config = spark.createDataFrame([("synonym", "SYNONYM", None, True, "", 1, None), ("other", "SET", None, True, "", 2, None)], administration.CONFIG)
    lines = administration.compiled(rows, config, ["SYNONYM"])
    assert {r.line for r in lines.collect()} == {"티비\t텔레비전,TV", "노트북,랩탑"}
    administration.export(lines, str(tmp_path / "out"))
    again = administration.word_file(spark, str(tmp_path / "out/name=synonym"), "SYNONYM")
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))
    assert administration.compiled(rows, config, ["none"]).count() == 0


def test_token_types_reach_the_lexicon(spark):
    lex = spark.createDataFrame([("물", "N", -16.0)], "key string, tag string, prob double")
    rows = spark.createDataFrame([("BRAND", "lg", None, None), ("SYN", None, "물,워터", None), ("PLAIN", "x", None, None)], dictionary.SOURCE)
    config = spark.createDataFrame([("brand", "SET", "MAX", True, "", 1, None), ("syn", "SYNONYM", "HIGH", True, "", 2, None), ("plain", "SET", None, True, "", 3, None)], administration.CONFIG)
    found = {tuple(r) for r in administration.loaded_lexicon(lex, rows, config).collect()}
    assert found == {("LG", "N", -5.0), ("물", "N", -8.0), ("워터", "N", -8.0)}


def test_maps_and_customs(spark):
    rows = spark.createDataFrame([("M", "a", "b,c", None), ("M", "A ", "d", "7"), ("M", "z", None, None)], dictionary.SOURCE)
    assert {r.key: r.words for r in administration.maps(rows).collect()} == {"A": ["b", "c", "d"]}
    assert {r.key: r.words for r in administration.customs(rows).collect()} == {"A": ["7"], "Z": []}


def test_two_way_groups_are_cliques(spark):
    pairs = [("a", "b"), ("b", "a"), ("a", "c"), ("c", "a"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "c"), ("e", "f"), ("x", "x")]
    found = {}
    for r in administration.two_way(spark.createDataFrame(pairs, "a string, b string")).collect():
        found.setdefault(r.main, set()).add(r.word)
    # Of c's candidates a, b and d, d and a do not list each other: only c itself is listed by all, and one is no group.
    assert found == {"a": {"a", "b", "c"}, "b": {"a", "b", "c"}, "d": {"c", "d"}}
    assert administration.two_way(spark.createDataFrame([], "a string, b string")).count() == 0


def test_pages_of_every_size_have_numbers(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7).repartition(5)
    order = search.parse_sort(["k", {"id": "desc"}])
    rows = search.page(df, order, 990, -1).collect()
    wanted = sorted(((i % 7, -i) for i in range(1000)))[990:]
    assert sorted((r._rownum, r.k, -r.id) for r in rows) == [(990 + n, k, i) for n, (k, i) in enumerate(wanted)]
    assert search.page(df, order, 990, 20).columns == search.page(df, order, 990, -1).columns
    assert search.page(df.limit(0), order, 0, -1).count() == 0


def test_strict_expressions(spark):
    df = spark.createDataFrame([("a/NNG/*+b/J/x",)], "e string")
    assert [tuple(x) for x in df.select(morph.parse_expression(F.col("e"), True).alias("p")).first().p] == [("a", "NNG", None), ("b", "J", "x")]
    with pytest.raises(Exception, match="not an expression"):
        spark.createDataFrame([("a/NNG",)], "e string").select(morph.parse_expression(F.col("e"), True)).collect()
    assert morph.lowered(spark.createDataFrame([("AbC",)], "text string")).first().text == "abc"


def test_searches_that_are_given_up_are_flagged():
    lex = {a * n: [("N", -9.0)] for a in "가나" for n in (1, 2, 3)} | {"가나": [("N", -9.0)], "나가": [("N", -9.0)]}
    words, given_up = segment.search_run("가나" * 3, lex.get)
    free, never = segment.search_run("가나" * 3, lex.get, most=None)
    assert not never and sum(b - a for a, b, *_ in free) == 6 and (given_up or words == free)
    assert segment.search_run("가나" * 3, lex.get, most=2)[1]


def test_synonyms_of_whole_keywords(spark):
    syn = dictionary.synonyms(spark.createDataFrame(catalog.SYNONYMS, dictionary.SOURCE))
    df = spark.createDataFrame([(1, " cold "), (2, "none"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.synonyms for r in product.with_synonyms(df, syn).collect()} == {1: ["frosty", "icy"], 2: None, 3: None}
