"""Product names to search terms over tables: analysis, labelled sets, expansions and synonym lists.

The rules keep state along a name, so they run as one Arrow function over
names that are dealt to all cores; the snapshot of the dictionaries is
broadcast once, after its size was checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators import rowwise, rules, search
from termloom.operators.rules import AnalyzerOptions, Dictionaries

ROW = "struct<term: string, type: string, pos_incr: int, start_off: int, end_off: int, is_stop: boolean, synonyms: array<string>, extras: array<struct<term: string, type: string, synonyms: array<string>>>>"


def analyse(df: DataFrame, dicts: Dictionaries, options: AnalyzerOptions = AnalyzerOptions(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, token_no, term, type, ...) of every name; a null or blank one has no rows."""
    shared = df.sparkSession.sparkContext.broadcast(dicts)
    memo: dict[str, str] = {}  # empty when it is sent; each worker then keeps its own

    def emit(name: str) -> list[tuple]:
        return rules.terms(name, shared.value, options, memo) if name.strip() else []

    found = rowwise.per_text(emit, f"array<{ROW}>")
    names = rowwise.spread(df.select(key, F.col(text).alias("_name")))
    return names.select(key, F.posexplode(found("_name")).alias("token_no", "t")).select(key, "token_no", "t.*")


def labelled_sets(terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, set_name, words): the named sets of an analysis that ran in query mode, which is done once for all of them."""
    named = F.when(F.col("is_stop"), "STOPWORD").when(F.col("type") == "MODEL_NAME", "MODEL_NAME").when(F.col("type") == "UNIT", "UNIT").when(F.col("type") == "COMPOUND", "COMPOUND").otherwise("WORD")
    own = F.array(F.struct(named.alias("set_name"), F.col("term").alias("word")))
    in_set = lambda name, words: F.coalesce(F.transform(words, lambda w: F.struct(F.lit(name).alias("set_name"), w.alias("word"))), F.array())
    every = F.concat(own, in_set("SYNONYM", F.col("synonyms")), in_set("EXTRA", F.col("extras.term")), in_set("FINAL", F.concat(F.array("term"), "synonyms", "extras.term")))
    rows = terms.select(key, F.explode(every).alias("s")).select(key, "s.*")
    return rows.groupBy(key, "set_name").agg(F.sort_array(F.collect_set("word")).alias("words"))


def query_of(text: str, dicts: Dictionaries) -> search.And:
    """The boolean query of a search text."""
    return search.build(rules.terms(text, dicts, AnalyzerOptions.filter_defaults()))


def expansions(text: str, dicts: Dictionaries) -> dict[str, list[str]]:
    """Each term of a keyword, and each two and three of them together, with their synonyms."""
    rows = rules.terms(text, dicts, AnalyzerOptions(use_for_query=True))
    words = [r[0] for r in rows]
    out = {r[0]: list(dict.fromkeys([*r[6], *(e[0] for e in r[7])])) for r in rows}
    for n in (2, 3):
        for at in range(len(words) - n + 1):
            joined = "".join(words[at : at + n])
            if found := dicts.synonym.get(rules.chars.folded(joined)):
                out[joined] = [rules.reanalysed(s, dicts) for s in found]
    return out


def synonym_list(text: str, dicts: Dictionaries) -> list[str]:
    """Synonyms of a keyword as a whole."""
    return list(dict.fromkeys(dicts.synonym.get(rules.chars.folded(text.strip()), [])))


def expand(df: DataFrame, dicts: Dictionaries, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, words) of every keyword of a table: ``expansions``, without terms that have none."""
    shared = df.sparkSession.sparkContext.broadcast(dicts)

    def emit(name: str) -> list[tuple]:
        return [(t, w) for t, w in expansions(name, shared.value).items() if w] if name.strip() else []

    found = rowwise.per_text(emit, "array<struct<term: string, words: array<string>>>")
    names = rowwise.spread(df.select(key, F.col(text).alias("_name")))
    return names.select(key, F.explode(found("_name")).alias("e")).select(key, "e.*")


def with_synonyms(df: DataFrame, synonyms: DataFrame, text: str = "text") -> DataFrame:
    """The rows of a table with ``synonyms``, those of the keyword as a whole; a join by the folded keyword."""
    keyed = df.withColumn("key", F.upper(F.trim(F.coalesce(text, F.lit("")))))
    return keyed.join(synonyms.select("key", F.col("words").alias("synonyms")), "key", "left").drop("key")
