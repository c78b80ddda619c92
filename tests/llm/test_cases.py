"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator that the other files leave out."""

import hashlib

import pytest

import __spark_entry__
import corpus_pipeline
from oracle import SMALL
from termloom.llm import exact, packing, pieces, quality, queries, sharding, similar, simhash, token_counts

COLUMNS = "doc_id long, text string, lang string, _id long, _sha string, row string, id long, sha string, n long, kept string, node string, fp string, n_chars long"
LONG = "the cat and the dog of an old house " * 6000
TEXTS = [(1, "one two three"), (2, None), (3, ""), (4, "one two three"), (4, "one two three"), (None, "one two three"), (5, LONG), (None, None), (6, "one two three")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "en", 7, "s", "r", 8, "h", 9, "k", "d", "f", len(t or "")) for i, t in TEXTS], COLUMNS)


def test_exact_and_near_dedup_keep_the_columns(spark, edge):
    for stage, ids in ((exact.keep_last, {6, 5, 3}), (lambda d: similar.keep_first(d, 5, 8, 120, 42), {None, 5})):
        left = stage(edge)
        assert left.schema.simpleString() == edge.schema.simpleString()
        rows = left.collect()
        assert {r.doc_id for r in rows} == ids, [r.doc_id for r in rows]
        assert {(r._id, r._sha, r.row, r.node) for r in rows} == {(7, "s", "r", "d")}
        assert stage(edge.limit(0)).count() == 0


def test_quality(spark, edge):
    rows = {(r.doc_id, r.n_words): r for r in quality.judge(edge).collect()}
    long = rows[5, 54000]
    assert long.n_repeat_words == 54000 and long.base_failed and not long.kept
    assert rows[2, 0].base_failed and rows[3, 0].word_chars == 0 and rows[1, 3].n_symbols == 0
    assert quality.judge(edge).count() == len(TEXTS) and quality.judge(edge.limit(0)).count() == 0


def test_stored_references_do_not_change_with_the_batch(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang", "text")
    refs = quality.references(quality.features(docs))
    whole = {r.doc_id: r for r in quality.judge(docs).collect()}
    some = quality.judge(docs.where("doc_id % 3 = 0"), refs).collect()
    assert some and all(r == whole[r.doc_id] for r in some)
    twice = quality.combined(refs.unionByName(refs)).collect()
    assert len(twice) == refs.count() and {r.lang: [2 * x for x in r.ref_words] for r in refs.collect()} == {r.lang: r.ref_words for r in twice}
    junk = spark.createDataFrame([(1, "en", " ".join(["zq xv"] * 3 + [f"w{i} q{i}" for i in range(200)]))], "doc_id long, lang string, text string")
    assert quality.judge(junk).head().kept and not quality.judge(junk, refs).head().kept
    short = spark.createDataFrame([(1, "en", " ".join(f"w{i} q{i}" for i in range(55)))], "doc_id long, lang string, text string")
    judged = quality.judge(short, refs).head()
    assert judged.word_distance is not None and not judged.base_failed and not judged.kept  # 110 words, none of them common
    none = quality.judge(junk, refs.limit(0)).head()
    assert none.kept and none.char_distance is None


def test_sharding(spark, edge):
    placed = sharding.assign_shards(edge.select("doc_id"), "doc_id")
    rows = placed.collect()
    assert len(rows) == len(TEXTS) and len({r.shard for r in rows if r.doc_id == 4}) == 1 and all(r.shard is not None for r in rows)
    assert sharding.assign_shards(edge.select("doc_id").limit(0), "doc_id").count() == 0


def test_empty_tables(spark, edge):
    none = edge.limit(0)
    assert packing.pack(none, queries.tokenizer_file("byte_bpe_50k.json")).count() == 0
    assert pieces.digests(none, queries.tokenizer_file("piece_bpe_32k.model")).count() == 0
    assert token_counts.token_counts(none, [("a", -1.0)]).count() == 0
    assert simhash.near_duplicates(none).count() == 0


def test_long_and_repeated_texts(edge):
    rows = pieces.digests(edge, queries.tokenizer_file("piece_bpe_32k.model")).collect()
    assert len(rows) == len(TEXTS)
    empty = [r for r in rows if r.doc_id in (2, 3)]
    assert {r.n_tokens for r in empty} == {1} and {r.decoded_sha256 for r in empty} == {hashlib.sha256(b"").hexdigest()}
    found = exact.duplicates(edge).collect()
    assert len(found) == len(TEXTS) and sum(r.kept for r in found) == 3 and {r.group_size for r in found} == {5, 3, 1}


def test_all_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_pipeline_on_the_edge_cases(spark, tmp_path):
    source = spark.read.parquet(f"{SMALL}/documents.parquet")
    cases = spark.createDataFrame([(i, t, None, None, None) for i, t in TEXTS], source.schema)
    for rows, name in ((cases, "cases"), (cases.limit(0), "none")):
        folder = tmp_path / name
        rows.write.parquet(str(folder / "documents.parquet"))
        spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(str(folder / "labels.parquet"))
        packed = corpus_pipeline.run(spark, str(folder)).collect()
        # No row is taught here, so none is toxic; what is left are one text without words, one of three words and the long one.
        assert len({r.sequence_id for r in packed}) >= (2 if name == "cases" else 0) and bool(packed) == (name == "cases")
