"""Tagged text: one record a line, ``[%KEY%]value[%KEY2%]value``; a reader and a writer.

A file whose first line has no tag is left out whole. A later line without one
is a record whose only key is null. The charset is a parameter (EUC-KR unless set).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TAG = r"\[%([a-zA-Z0-9_-]+)%\]"


def fields(line: Column) -> Column:
    """Map of a line's keys to its values; the last of a repeated key stays, empty keys cannot occur."""
    keys = F.regexp_extract_all(line, F.lit(_TAG), F.lit(1))
    values = F.slice(F.split(line, _TAG), 2, F.greatest(F.size(keys), F.lit(1)))
    entries = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(F.transform(entries, lambda e, i: F.struct(e["k"].alias("k"), e["v"].alias("v"), i.alias("i"))), lambda e: ~F.array_contains(F.slice(keys, e["i"] + 2, F.greatest(F.size(keys) - e["i"] - 1, F.lit(0))), e["k"]))
    return F.map_from_arrays(F.transform(last, lambda e: e["k"]), F.transform(last, lambda e: e["v"]))


def coerced(record: Column, date_key: str = "REGISTERDATE") -> Column:
    """The date of a record (yyyyMMdd); null where it is none."""
    return F.to_date(F.try_to_timestamp(F.get(F.array(record[date_key]), F.lit(0)), F.lit("yyyyMMdd")))


def read(spark: SparkSession, paths: str, charset: str = "EUC-KR") -> DataFrame:
    """(record, untagged) of files and folders, a comma list, subfolders included."""
    found = [p.strip() for p in paths.split(",") if p.strip()]
    lines = spark.read.option("recursiveFileLookup", "true").text(found)
    line = F.col("value")
    if charset.upper().replace("-", "") != "UTF8":  # the JVM side knows Unicode charsets only; these keep line ends as single bytes
        line = F.udf(lambda b: b.decode(charset, "replace"), "string", useArrow=True)(line.cast("binary"))
    lines = lines.withColumn("line", F.rtrim(line, F.lit("\r")))
    raw = lines.select("line", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    tagged = F.col("line").rlike(_TAG)
    first = raw.groupBy("file").agg(F.min_by(tagged, F.struct("block", "at")).alias("_ok")).where("_ok").select("file")
    kept = raw.join(first, "file", "left_semi")
    return kept.select(F.when(tagged, fields(F.col("line"))).alias("record"), F.when(~tagged, F.col("line")).alias("untagged"))


def line_of(df: DataFrame, columns: list[str]) -> Column:
    """A row as a tagged line; tab, line ends and NUL are spaces, null is empty."""
    one = lambda c: F.concat(F.lit(f"[%{c}%]"), F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n\x00]", " "))
    return F.concat(*[one(c) for c in columns])


def write(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Rows as tagged lines with CRLF, in UTF-8."""
    df.select(line_of(df, columns or df.columns).alias("value")).write.option("lineSep", "\r\n").text(path)
