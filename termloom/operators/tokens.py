"""Lexicon-free tokens: a text as its runs of one character type (native).

Everything is an expression over one row; only counts shuffle, and they are
combined on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import chars

_LISTED = "".join(chars.CLASSES[k] for k in (chars.HANGUL, chars.HANGUL_JAMO, chars.JAPANESE, chars.CHINESE))
_RUNS = "|".join(
    [f"[{cls}]+" for kind, cls in chars.CLASSES.items() if kind != chars.WHITESPACE]
    + [rf"[\p{{Lo}}&&[^{_LISTED}]]+", rf"[^\p{{P}}\p{{S}}\p{{Lu}}\p{{Ll}}\p{{Nd}}\p{{Lo}}{chars.SPACE_CLASS}]+"]
)


def runs(text: Column) -> Column:
    """Array of the maximal runs of one type, without white space; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_RUNS), F.lit(0))


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token_no, term, type): one row per run."""
    rows = df.select(key, F.posexplode(runs(F.col(text))).alias("token_no", "term"))
    return rows.withColumn("type", chars.char_type(F.col("term")))


def words(text: Column) -> Column:
    """Array of the words between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


#: What the runs of one type are made of.
_OF = {kind: f"[{cls}]+" for kind, cls in chars.CLASSES.items()} | {"UNCATEGORIZED": _RUNS.rpartition("|")[2]}


def term_counts(df: DataFrame, text: str, *kinds: str) -> DataFrame:
    """(term, type, n) of all runs, or of those of some ``kinds``, which alone are then taken from the text.

    Say kinds here and not in a filter on the type: that would be moved below the count and type every token.
    """
    pattern = "|".join(_OF[k] for k in kinds) if kinds else _RUNS
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    found = df.select(F.explode(found).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    if len(kinds) == 1:
        return found.select("term", F.lit(kinds[0]).alias("type"), "n")
    return found.select("term", chars.char_type(F.col("term")).alias("type"), "n")


def type_counts(df: DataFrame, text: str) -> DataFrame:
    """(type, n_tokens, n_terms)."""
    return term_counts(df, text).groupBy("type").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_terms"))


def top_terms(df: DataFrame, text: str, k: int) -> DataFrame:
    """The k most frequent terms; ties by the term."""
    return term_counts(df, text).orderBy(F.desc("n"), "term").limit(k)


def grams(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, at, gram): n consecutive words written together, as synonym keys are looked up; no shuffle."""
    w = df.select(key, words(F.col(text)).alias("_w"))
    joined = F.transform(F.sequence(F.lit(0), F.size("_w") - n), lambda i: F.concat(*[F.get("_w", i + k) for k in range(n)]))
    return w.where(F.size("_w") >= n).select(key, F.posexplode(joined).alias("at", "gram"))


def unit_numbers(text: Column, units: list[str]) -> Column:
    """Array of (number, unit): each run of digits with the unit (one of ``units``, whatever its case) that is the next run."""
    found = runs(text)
    met = lambda p: p["number"].rlike(r"^\p{Nd}+$") & F.upper(p["unit"]).isin(*[u.upper() for u in units])
    return F.filter(F.transform(found, lambda t, i: F.struct(t.alias("number"), F.get(found, i + 1).alias("unit"))), met)


def retyped(term: Column, kind: Column) -> Column:
    """Final types: a NUMBER of five digits and more is a MODEL_NAME, null is UNCATEGORIZED."""
    return F.when((kind == "NUMBER") & (F.length(term) >= 5), "MODEL_NAME").when(kind == "UNIT_ALPHA", "UNIT").when(kind == "NUMBER_TRANS", "NUMBER").otherwise(F.coalesce(kind, F.lit("UNCATEGORIZED")))


def positions(df: DataFrame, key: str, by: str = "token_no") -> DataFrame:
    """Tokens with ``position``: the running sum of their increments."""
    return df.withColumn("position", F.sum("pos_incr").over(Window.partitionBy(key).orderBy(by)) - 1)
