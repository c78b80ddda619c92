"""Life of dictionaries: configuration, word files, loading, compiling, apply records, information and two-way closure.

Everything but the configuration is a DataFrame operation over source rows
(``dict_type, keyword, value, id``) and apply records (``APPLY``).
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import chars
from termloom.operators import dictionary
from termloom.operators.stored import stored

CONFIG = "name string, type string, token_type string, ignore_case boolean, file_path string, seq int, label string"
APPLY = "id string, count int, appliedTime string, updatedTime string"


def load_config(text: str) -> list[tuple]:
    """Rows of ``CONFIG`` from a configuration text: YAML where a YAML package is at hand, else JSON.

    Without a path a dictionary is at ``dict/<name>.dict`` below ``basePath``; case is ignored unless told otherwise.
    """
    try:
        import yaml

        config = yaml.safe_load(text)
    except ImportError:
        config = json.loads(text)
    base, out = Path(config.get("basePath") or "."), []
    for entry in config.get("dictionary") or []:
        path = entry.get("filePath") or f"dict/{entry['name']}.dict"
        out.append((entry["name"], str(entry.get("type", "SET")).upper(), entry.get("tokenType"), bool(entry.get("ignoreCase", True)), str(base / path), int(entry.get("seq", 0)), entry.get("label")))
    return out


def word_file(spark: SparkSession, path: str, dict_type: str) -> DataFrame:
    """Source rows of a UTF-8 file with one entry a line: ``keyword TAB value``, or a keyword alone."""
    line = F.trim("value")
    rows = spark.read.text(path).where(line != "")
    tab = F.instr(line, "\t")
    keyword = F.when(tab > 0, F.trim(F.substr(line, F.lit(1), tab - 1))).otherwise(line)
    value = F.when(tab > 0, F.trim(F.substr(line, tab + 1)))
    if dict_type.startswith("SYNONYM"):  # a line without a tab is a two-way list
        keyword, value = F.when(tab > 0, keyword), F.coalesce(value, line)
    return rows.select(F.lit(dict_type).alias("dict_type"), keyword.alias("keyword"), value.alias("value"), F.lit(None).cast("string").alias("id"))


def line_of(kind: Column) -> Column:
    """The line that a source row of a dictionary of ``kind`` is compiled from."""
    id_, keyword, value = (F.trim(F.coalesce(c, F.lit(""))) for c in ("id", "keyword", "value"))
    pair = lambda a, b, alone: F.when(a != "", F.concat_ws("\t", keyword, b)).otherwise(alone)
    return F.when(kind.startswith("SYNONYM"), pair(keyword, value, value)).when(kind == "CUSTOM", pair(id_, id_, keyword)).otherwise(pair(value, value, keyword))


def compiled(rows: DataFrame, config: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(name, type, line) of the dictionaries in ``config`` (or of ``names``, whatever their case): what an export writes."""
    wanted = config if names is None else config.where(F.lower("name").isin([n.lower() for n in names]))
    kinds = wanted.select(F.upper("name").alias("dict_type"), "name", "type")  # one row a dictionary
    return rows.join(F.broadcast(kinds), "dict_type").select("name", "type", line_of(F.col("type")).alias("line"))


def export(lines: DataFrame, folder: str) -> None:
    """Compiled lines as text, a folder for each dictionary."""
    lines.select("name", F.col("line").alias("value")).write.partitionBy("name").text(folder)


def applied(lines: DataFrame, time: str) -> DataFrame:
    """The apply records of a compilation (``APPLY`` without updatedTime)."""
    return lines.groupBy(F.lower("name").alias("id")).agg(F.count("*").cast("int").alias("count")).withColumn("appliedTime", F.lit(time))


def upserted(records: DataFrame, new: DataFrame) -> DataFrame:
    """``records`` (``APPLY``) with those of ``new``; fields that ``new`` lacks stay."""
    more = new.select("id", F.col("count").alias("_c"), F.col("appliedTime").alias("_a"))
    return records.join(more, "id", "full_outer").select("id", F.coalesce("_c", "count").alias("count"), F.coalesce("_a", "appliedTime").alias("appliedTime"), "updatedTime")


def info(rows: DataFrame, config: DataFrame, records: DataFrame) -> DataFrame:
    """One row a dictionary of ``config``: its settings, what was applied and when, and how many rows it has now."""
    now = rows.groupBy("dict_type").agg(F.count("*").alias("index_count"))
    own = config.select(F.upper("name").alias("dict_type"), F.lower("name").alias("id"), "type", "ignore_case", F.coalesce("token_type", F.lit("NONE")).alias("token_type"), "label", "seq")
    told = own.join(now, "dict_type", "left").join(records, "id", "left")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return told.select("dict_type", "id", "type", "ignore_case", "token_type", "label", "seq", text("appliedTime"), text("updatedTime"), F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("index_count", F.lit(0)).alias("index_count"))


def loaded_lexicon(lexicon: DataFrame, rows: DataFrame, config: DataFrame) -> DataFrame:
    """The system lexicon with the words of every dictionary that has a token type, as nouns of its score."""
    for entry in config.where("token_type is not null").orderBy("seq", "name").collect():  # a row a dictionary
        own = rows.where(F.col("dict_type") == entry["name"].upper())
        both = F.concat(dictionary.listed(F.col("keyword")), dictionary.listed(F.col("value"))) if entry["type"].startswith("SYNONYM") else F.array(F.trim("keyword"))
        words = own.select(F.explode(both).alias("word")).where("word is not null and word <> ''").distinct()
        lexicon = dictionary.with_words(lexicon, words, entry["token_type"])
    return lexicon


def maps(rows: DataFrame) -> DataFrame:
    """MAP rows: (key, words) from keyword to its values."""
    return rows.select(chars.fold(F.trim("keyword")).alias("key"), F.explode(dictionary.listed(F.col("value"))).alias("w")).groupBy("key").agg(F.sort_array(F.collect_set("w")).alias("words"))


def customs(rows: DataFrame) -> DataFrame:
    """CUSTOM rows: (key, words) from keyword to its ids; a keyword without id has none."""
    own = rows.select(chars.fold(F.trim("keyword")).alias("key"), F.nullif(F.trim("id"), F.lit("")).alias("i"))
    return own.groupBy("key").agg(F.sort_array(F.collect_set("i")).alias("words"))


def two_way(pairs: DataFrame, rounds: int = 20) -> DataFrame:
    """(main, word): of every word ``a`` of the pairs (a lists b) its two-way group, itself included where it is in it.

    The group grows from the word over what its members list, by those that list the word itself; then only those
    stay that all others of the group list. Words without a group of two have no rows. Each round adds a step; one
    that adds nothing ends it, and more than ``rounds`` is an error.
    """
    lists = stored(pairs.select("a", "b").where("a <> b").distinct())
    back = lists.select(F.col("b").alias("main"), F.col("a").alias("word"))  # word lists main
    following = lists.select(F.col("a").alias("word"), F.col("b").alias("next"))
    edge = stored(lists.select(F.col("a").alias("main"), F.col("b").alias("word")).join(back, ["main", "word"], "left_semi"))
    found = edge
    for _ in range(rounds):
        step = edge.join(following, "word").select("main", F.col("next").alias("word")).where("main <> word").distinct()
        edge = stored(step.join(back, ["main", "word"], "left_semi").join(found, ["main", "word"], "left_anti"))
        if edge.isEmpty():
            break
        found = found.unionByName(edge)
    else:
        raise ValueError(f"a two-way group takes more than {rounds} steps")
    group = stored(found.unionByName(found.select("main", F.col("main").alias("word")).distinct()))
    size = group.groupBy("main").agg(F.count("*").alias("size"))
    told = group.select("main", F.col("word").alias("by")).join(lists.select(F.col("a").alias("by"), F.col("b").alias("word")), "by")
    told = told.groupBy("main", "word").agg(F.count("*").alias("n"))
    kept = stored(group.join(told, ["main", "word"]).join(size, "main").where("n = size - 1").select("main", "word"))
    several = kept.groupBy("main").agg(F.count("*").alias("n")).where("n > 1").select("main")
    return kept.join(several, "main", "left_semi")

