"""Rows with a null or repeated doc_id in SimHash, and long texts in the toxicity sample."""

from termloom.llm import simhash, toxicity


def test_simhash_with_null_and_shared_ids(spark):
    rows = [(None, "a text that no other row has at all"), (4, "one two three four five six"), (2, "one two three four five six"), (None, "one two three four five six"), (9, "seven eight nine ten eleven"), (9, "quite another text of many other words"), (8, "quite another text of many other words"), (3, "nothing like the rest of these here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert found == sorted([(None, None), (None, 2), (2, 2), (4, 2), (3, 3), (8, 8), (9, 8), (9, 8)], key=str)


def test_a_long_text_does_not_end_the_toxicity_sample(spark, monkeypatch):
    rows = [(i, f"text number {i}" * (4000 if i % 7 == 0 else 1)) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: sorted(texts))
    learned = docs.where(~toxicity.held_out(docs.doc_id)).where("doc_id % 7 <> 0")
    assert toxicity.train(docs, labels, chars=30_000) == sorted(r.text for r in learned.collect())
