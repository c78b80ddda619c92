"""Product analysis with dictionaries of any size: entries come to the names by join, not by broadcast.

The rules run on a name with the entries that are known for it, noting each
key they ask for; the keys that are not known yet are joined with the
dictionaries, and the rules run again. A name whose every question was
answered is done, and its rows are those of a snapshot of all dictionaries.
Each round answers something new, and finished names leave the rounds.

Names are analysed once for each distinct text. Nothing but the number of
names still asking comes to the driver. A text's answers stand in one row:
about twenty substrings for each of its characters.

Defined cases: a null or blank name has no rows; repeated rows and keys each
keep theirs; of several entries for one key of a compound or a forced split
the greatest counts, as in a snapshot; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators import dictionary, product, rules
from termloom.operators.rules import AnalyzerOptions, Dictionaries
from termloom.operators.stored import stored

TAGS = "array<struct<tag: string, prob: double>>"
KEY = "struct<kind: string, key: string>"
#: Rounds before a name is said to ask without end; four or five are usual.
MOST_ROUNDS = 50


class Asked(dict):
    """A dictionary of one kind as far as it is known for a text; a key that is not known is noted and counts as absent.

    ``known`` maps a key to its entry, or to None where the tables have none.
    """

    def __init__(self, kind: str, known: dict, filled: bool, notes: set[tuple[str, str]]) -> None:
        super().__init__()
        self.kind, self.known, self.filled, self.notes = kind, known, filled, notes

    def get(self, key, default=None):
        if key not in self.known:
            self.notes.add((self.kind, key))
        found = self.known.get(key)
        return default if found is None else found

    def __contains__(self, key) -> bool:
        return self.get(key) is not None

    def __getitem__(self, key):
        return self.get(key)

    def __bool__(self) -> bool:
        return self.filled


def _asking(known: list | None, lexicon: bool, notes: set[tuple[str, str]]) -> Dictionaries:
    """Dictionaries of the answers (kind, key, words, tags) to one text's questions."""
    kinds = {k: {} for k in dictionary.KINDS}
    for a in known or ():
        value = [(t["tag"], t["prob"]) for t in a["tags"]] if a["tags"] is not None else a["words"]
        kinds[a["kind"]][a["key"]] = None if value is None else list(value)
    return Dictionaries(**{name: Asked(kind, kinds[kind], lexicon if kind == "SYSTEM" else True, notes) for kind, name in dictionary.KINDS.items()})


def analyse(df: DataFrame, rows: DataFrame, lex: DataFrame | None = None, options: AnalyzerOptions = AnalyzerOptions(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """What ``product.analyse`` gives with a snapshot of ``rows`` and ``lex``, without one."""
    answers = stored(dictionary.entries(rows, lex))
    lexicon = lex is not None and not lex.isEmpty()

    def run(name: str, known: list | None) -> tuple:
        notes: set[tuple[str, str]] = set()
        found = rules.terms(name, _asking(known, lexicon, notes), options)
        return (sorted(notes), None) if notes else ([], found)

    ask = F.udf(run, f"struct<asked: array<{KEY}>, rows: array<{product.ROW}>>", useArrow=True)
    named = df.select(F.col(key), F.col(text).alias("_name"))
    names = named.where("trim(_name) <> ''").select("_name").distinct()
    open_ = names.withColumn("_known", F.lit(None).cast(f"array<struct<kind: string, key: string, words: array<string>, tags: {TAGS}>>"))
    done = []
    for _ in range(MOST_ROUNDS):
        told = stored(open_.withColumn("_t", ask("_name", "_known")).select("_name", "_known", "_t.*"))
        done.append(told.where("size(asked) = 0").select("_name", "rows"))
        told = told.where("size(asked) > 0")
        if told.isEmpty():
            break
        each = told.select("_name", F.explode("asked").alias("a")).select("_name", "a.*")
        more = each.join(answers, ["kind", "key"], "left").groupBy("_name").agg(F.collect_list(F.struct("kind", "key", "words", "tags")).alias("_more"))
        before = F.coalesce("_known", F.array().cast(told.schema["_known"].dataType))
        open_ = told.join(more, "_name").select("_name", F.concat(before, F.col("_more").cast(told.schema["_known"].dataType)).alias("_known"))
    else:
        raise ValueError(f"names still ask after {MOST_ROUNDS} rounds")
    found = done[0]
    for one in done[1:]:
        found = found.unionByName(one)
    return named.join(found, "_name").select(key, F.posexplode("rows").alias("token_no", "t")).select(key, "token_no", "t.*")


def analyse_tables(df: DataFrame, rows: DataFrame, lex: DataFrame | None = None, options: AnalyzerOptions = AnalyzerOptions(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Analysis with dictionaries in tables: by a broadcast snapshot where they were counted to be small, else by join; the rows are the same."""
    if dictionary.fits(rows, lex):
        return product.analyse(df, dictionary.snapshot(rows, lex), options, key, text)
    return analyse(df, rows, lex, options, key, text)
