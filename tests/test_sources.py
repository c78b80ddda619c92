import base64
import json

from pyspark.sql import functions as F

from termloom.operators import dictionary, search
from termloom.plans import catalog
from termloom.sources import tagged
from termloom.streaming import analyse


def test_tagged_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "삼성\t노트북"), ("2", "a [b] c"), ("3", None)], "ID string, NAME string")
    tagged.write(df.coalesce(1), str(tmp_path / "out"))
    found = tagged.read(spark, str(tmp_path / "out"), "UTF-8").select(F.col("record")["ID"], F.col("record")["NAME"]).collect()
    assert sorted(map(tuple, found)) == [("1", "삼성 노트북"), ("2", "a [b] c"), ("3", "")]


def test_tagged_charset_and_untagged(spark, tmp_path):
    (tmp_path / "a").write_bytes("[%ID%]1[%N%]노트북\nplain\n".encode("euc-kr"))
    (tmp_path / "b").write_bytes(b"plain first\n[%ID%]2\n")
    found = tagged.read(spark, f"{tmp_path}/a,{tmp_path}/b").collect()
    assert {((r.record or {}).get("N"), r.untagged) for r in found} == {("노트북", None), (None, "plain")}
    assert len(found) == 2


def test_snapshot_and_restore(spark):
    dicts = dictionary.snapshot(spark.createDataFrame(catalog.SOURCE_ROWS, dictionary.SOURCE))
    again = dictionary.snapshot(dictionary.restore(dicts, spark))
    assert (again.stop, again.unit, again.space, again.compound.keys()) == (dicts.stop, dicts.unit, dicts.space, dicts.compound.keys())
    assert {k: sorted(w.upper() for w in v) for k, v in again.synonym.items()} == {k: sorted(w.upper() for w in v) for k, v in dicts.synonym.items()}


def test_dsl(spark):
    df = spark.createDataFrame([(1, "cold widget"), (2, "hot widget"), (3, None)], "id int, t string")
    ids = lambda q: [r.id for r in df.where(search.parse_dsl(q)).orderBy("id").collect()]
    wrapped = base64.b64encode(json.dumps({"match": {"t": "cold"}}).encode()).decode()
    assert ids({"wrapper": {"query": wrapped}}) == [1]
    assert ids({"match_phrase": {"t": "hot widget"}}) == [2]
    assert ids({"query_string": {"query": "cold OR hot", "fields": ["t"]}}) == [1, 2]
    assert ids({"query_string": {"query": "widget -hot", "fields": ["t"]}}) == [1]
    assert ids({"terms_set": {"t": {"terms": ["cold", "widget"]}}}) == [1]
    assert ids({"function_score": {"query": {"range": {"id": {"gt": 1, "lte": 2}}}}}) == [2]
    assert ids({"bool": {"must_not": [{"match": {"t": "cold"}}]}}) == [2, 3]
    assert search.fields_with_boosts("a^2,b,c^x") == {"a": 2.0, "b": 1.0, "c": 1.0}


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "cold 12cm")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    dicts = dictionary.snapshot(spark.createDataFrame(catalog.SOURCE_ROWS, dictionary.SOURCE))
    q = analyse.terms(stream, dicts).writeStream.format("memory").queryName("terms").start()
    q.processAllAvailable()
    q.stop()
    assert {r.term for r in spark.sql("SELECT term FROM terms").collect()} >= {"cold", "12cm"}
