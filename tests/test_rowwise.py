import pytest
from pyspark.sql import functions as F

from termloom.operators import product, rowwise, segment
from termloom.operators.rules import AnalyzerOptions, Dictionaries

NAMES = ["1A-B2C3D4 cold", "120cmx60cm", " ", None, "노트북 12345", "cold ßtraße"]


def busy(df):
    """How many partitions have rows."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


@pytest.fixture()
def names(spark):
    """One partition, as a file of one row group is read."""
    listed = F.array(*[F.lit(n) for n in NAMES])
    return spark.range(0, 600, 1, 1).select(F.col("id").alias("doc_id"), F.get(listed, (F.col("id") % len(NAMES)).cast("int")).alias("text"))


@pytest.mark.parametrize("query", [False, True])
def test_names_of_one_partition_are_dealt_to_all_cores(spark, names, query):
    dicts = Dictionaries(unit={"CM"}, synonym={"COLD": ["icy"]})
    found = product.analyse(names, dicts, AnalyzerOptions(use_for_query=query))
    assert busy(found) >= spark.sparkContext.defaultParallelism
    alone = product.analyse(names.where("doc_id < 6"), dicts, AnalyzerOptions(use_for_query=query))
    fields = found.columns[1:]
    again = alone.crossJoin(spark.range(100).withColumnRenamed("id", "k")).select((F.col("doc_id") + F.col("k") * 6).alias("doc_id"), *fields)
    assert found.count() == again.count() and not found.exceptAll(again).count()
    assert {r.doc_id % 6 for r in found.select("doc_id").distinct().collect()} == {0, 1, 4, 5}


def test_expanded_keywords_are_dealt_to_all_cores(spark, names):
    found = product.expand(names, Dictionaries(synonym={"COLD": ["icy"]}))
    assert busy(found) >= spark.sparkContext.defaultParallelism
    assert {(r.doc_id % 6, r.term, *r.words) for r in found.where("term = 'cold'").collect()} == {(0, "cold", "icy"), (5, "cold", "icy")}


def test_a_text_of_a_batch_is_worked_on_once(spark):
    df = spark.range(0, 40, 1, 1).select((F.col("id") % 2).cast("string").alias("t"))
    counted = []

    def emit(text):
        counted.append(text)
        return [len(counted)]

    assert {r.n[0] for r in df.select(rowwise.per_text(emit, "array<int>")("t").alias("n")).collect()} == {1, 2}


def test_labelled_sets_analyse_each_name_once(names):
    terms = product.analyse(names, Dictionaries(unit={"CM"}, synonym={"COLD": ["icy"]}), AnalyzerOptions(use_for_query=True))
    sets = product.labelled_sets(terms)
    assert sets._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert {(r.set_name, *r.words) for r in sets.where("doc_id = 0").collect()} == {
        ("MODEL_NAME", "1A-B2C3D4"), ("WORD", "cold"), ("SYNONYM", "icy"),
        ("EXTRA", "1A", "2", "3", "4", "B", "B2C3D4", "C", "D"), ("FINAL", "1A", "1A-B2C3D4", "2", "3", "4", "B", "B2C3D4", "C", "D", "cold", "icy"),
    }


def test_segmented_texts_are_dealt_to_all_cores(spark, names):
    found = segment.segmented(names, {"COLD": [("N", -9.0)]})
    assert busy(found) >= spark.sparkContext.defaultParallelism
    assert [(r.at, r.word, r.tag) for r in found.where("doc_id = 0").orderBy("at").collect()][-1] == (9, "cold", "N")
    assert {r.doc_id % 6 for r in found.select("doc_id").distinct().collect()} == {0, 1, 4, 5}
