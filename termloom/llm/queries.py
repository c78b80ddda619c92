"""The registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import exact, packing, pieces, pii, quality, sharding, simhash, token_counts, toxicity, urls

#: Where the public tokenizers' files are; another folder may be set.
TOKENIZERS: str | None = None
#: The secret of the surrogates in the registered query; a deployment sets its own.
PII_KEY = "registered-query"


def tokenizer_file(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), token_counts.vocabulary(tokenizer_file("piece_bpe_32k.model")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(_table(spark, sf_dir, "documents"), PII_KEY, count=True).select("doc_id", "text", "n_entities")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op7_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(_table(spark, sf_dir, "documents"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), urls.default_model(spark))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), radius=4, size=4, seeds=(42,))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sharding, op2_packing, op3_token_counts, op4_quality, op5_pii, op6_pieces, op7_exact, op8_urls, op9_simhash, op10_toxicity)
}
