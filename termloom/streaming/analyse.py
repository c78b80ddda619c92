"""Analysis of streams: stateless, so any source and any sink will do.

A stream takes a snapshot of the dictionaries when it starts; ``refreshing``
takes a new one for each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termloom.operators import product, tokens
from termloom.operators.rules import AnalyzerOptions, Dictionaries


def terms(stream: DataFrame, dicts: Dictionaries, options: AnalyzerOptions = AnalyzerOptions(), key: str = "doc_id", text: str = "text") -> DataFrame:
    return product.analyse(stream, dicts, options, key, text)


def windowed_counts(stream: DataFrame, time: str, text: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(window, term, n) with a watermark: state is bounded by the lateness."""
    rows = stream.withWatermark(time, late).select(time, F.explode(tokens.runs(F.col(text))).alias("term"))
    return rows.groupBy(F.window(time, window), "term").agg(F.count("*").alias("n"))


def refreshing(stream: DataFrame, load: Callable[[], Dictionaries], path: str, checkpoint: str, key: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Terms of each batch by the dictionaries as they are then, as Parquet under ``path``; a batch done again replaces its own."""

    def one(batch: DataFrame, number: int) -> None:
        product.analyse(batch, load(), key=key, text=text).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
