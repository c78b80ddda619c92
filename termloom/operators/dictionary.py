"""Dictionaries: source rows to typed content, lexicon, closure, counts, lookup and snapshots.

Source rows are ``dict_type, keyword, value, id``. Everything but the snapshot
is a DataFrame operation; a snapshot is what Arrow functions look words up in,
so its size is checked before it goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions import chars
from termloom.operators import rules, segment

SOURCE = "dict_type string, keyword string, value string, id string"
#: Most source rows of a snapshot; more are met by join (``large``).
SNAPSHOT_ROWS = 2_000_000
# Part-of-speech prefixes of lexicon lines, first match wins.
TAG_PREFIXES = ("N", "V", "M", "IC", "J", "E", "XPN")


def listed(value: Column) -> Column:
    """``a, b,c`` as an array of trimmed, distinct, non-empty words."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda w: F.trim(w)), lambda w: w != ""))


def synonyms(rows: DataFrame) -> DataFrame:
    """(key, words): with a keyword one way, without one each word to all others; spaced keys also without spaces."""
    words = listed(F.col("value"))
    one = rows.where("keyword is not null and trim(keyword) <> ''").select(F.trim("keyword").alias("key"), F.explode(words).alias("word"))
    both = rows.where("keyword is null or trim(keyword) = ''").select(words.alias("w"))
    two = both.select(F.explode("w").alias("key"), "w").select("key", F.explode("w").alias("word")).where("key <> word")
    pairs = one.unionByName(two)
    keys = F.array_distinct(F.array(chars.fold(F.col("key")), chars.without_spaces(chars.fold(F.col("key")))))
    return pairs.select(F.explode(keys).alias("key"), "word").groupBy("key").agg(F.sort_array(F.collect_set("word")).alias("words"))


def parts(rows: DataFrame) -> DataFrame:
    """COMPOUND rows: (key, words)."""
    return rows.select(chars.fold(F.trim("keyword")).alias("key"), listed(F.col("value")).alias("words"))


def forced_splits(rows: DataFrame) -> DataFrame:
    """SPACE rows: the keyword without spaces, and its parts."""
    split = F.filter(F.split("keyword", " "), lambda w: w != "")
    return rows.select(chars.fold(chars.without_spaces(F.col("keyword"))).alias("key"), split.alias("words"))


def inverted(rows: DataFrame) -> DataFrame:
    """INVERT_MAP rows: each value leads to its keywords."""
    pairs = rows.select(F.explode(listed(F.col("value"))).alias("v"), "keyword")
    return pairs.groupBy(chars.fold(F.col("v")).alias("key")).agg(F.sort_array(F.collect_set("keyword")).alias("words"))


def lexicon(lines: DataFrame) -> DataFrame:
    """``word TAB tag TAB prob`` lines (column value) -> (key, tag, prob): the best of each word and tag.

    Comments and lines of another shape go. Of single characters nouns keep
    the least score, others go.
    """
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").rlike("^(#|//)") & (F.size(f) == 3)).select(
        chars.fold(F.trim(f[0])).alias("key"), F.trim(f[1]).alias("raw"), F.expr("try_cast(trim(split(value, '\t')[2]) as double)").alias("prob"))
    tag = F.coalesce(*[F.when(F.col("raw").startswith(p), p) for p in TAG_PREFIXES])
    single = F.length("key") == 1
    rows = rows.select("key", tag.alias("tag"), F.when(single & (F.col("prob") > segment.MID), segment.MIN).otherwise(F.col("prob")).alias("prob"))
    rows = rows.where("tag is not null and prob is not null and key <> ''").where(~(F.length("key") == 1) | (F.col("tag") == "N"))
    return rows.groupBy("key", "tag").agg(F.max("prob").alias("prob"))


def with_words(lex: DataFrame, words: DataFrame, token_type: str | None) -> DataFrame:
    """The lexicon with a dictionary's words as nouns of a score; the greater score stays, no type adds nothing."""
    if token_type not in ("MAX", "HIGH", "MID", "MIN"):
        return lex
    more = words.select(chars.fold(F.col("word")).alias("key"), F.lit("N").alias("tag"), F.lit(segment.level(token_type)).alias("prob"))
    return lex.unionByName(more).groupBy("key", "tag").agg(F.max("prob").alias("prob"))


def mutual(pairs: DataFrame) -> DataFrame:
    """(a, b) where each lists the other, a < b: one count by both words, without a join; repeated pairs need not be removed before."""
    way = F.when(F.col("a") < F.col("b"), 1).otherwise(2).alias("_way")
    ways = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), way)
    return ways.groupBy("a", "b").agg(F.bit_or("_way").alias("_ways")).where("_ways = 3").select("a", "b")


def counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("dict_type").agg(F.count("*").alias("n"))


def info(rows: DataFrame) -> DataFrame:
    """Entries and distinct words of each dictionary."""
    words = rows.select("dict_type", F.explode(F.concat(listed(F.col("value")), listed(F.col("keyword")))).alias("word")).groupBy("dict_type").agg(F.countDistinct("word").alias("words"))
    return counts(rows).join(words, "dict_type", "left").select("dict_type", "n", F.coalesce("words", F.lit(0)).alias("words"))


def find(rows: DataFrame, lex: DataFrame, word: str) -> DataFrame:
    """Lexicon hits and the rows whose keyword or value is the word."""
    hits = lex.where(F.col("key") == chars.folded(word)).select(F.lit("SYSTEM").alias("dict_type"), F.col("key").alias("keyword"), F.col("tag").alias("value"))
    return hits.unionByName(rows.where((F.col("keyword") == word) | (F.col("value") == word)).select("dict_type", "keyword", "value"))


def restore(dicts: rules.Dictionaries, spark) -> DataFrame:
    """A snapshot as source rows; synonyms that list each other are one two-way row."""
    out = [("USER", w, None, None) for w in sorted(dicts.user)] + [("STOP", w, None, None) for w in sorted(dicts.stop)] + [("UNIT", w, None, None) for w in sorted(dicts.unit)]
    out += [("SPACE", " ".join(v), None, None) for _, v in sorted(dicts.space.items())] + [("COMPOUND", k, ",".join(v), None) for k, v in sorted(dicts.compound.items())]
    done = set()
    for key, words in sorted(dicts.synonym.items()):
        both = [w for w in words if key in {chars.folded(x) for x in dicts.synonym.get(chars.folded(w), [])}]
        group = tuple(sorted({key, *map(chars.folded, both)}))
        if both and group not in done:
            done.add(group)
            out.append(("SYNONYM", None, ",".join(group), None))
        if rest := [w for w in words if w not in both]:
            out.append(("SYNONYM", key, ",".join(rest), None))
    return spark.createDataFrame(out, SOURCE)


# Dictionary types and the fields of a snapshot.
KINDS = {"SYSTEM": "lexicon", "USER": "user", "STOP": "stop", "UNIT": "unit", "SYNONYM": "synonym", "UNIT_SYNONYM": "unit_synonym", "COMPOUND": "compound", "SPACE": "space"}


def entries(rows: DataFrame, lex: DataFrame | None = None) -> DataFrame:
    """(kind, key, words, tags): one row for each key of each dictionary; tags for the lexicon, words for all others.

    Keywords have no words of their own. Of several word lists for one key of a compound or a forced split the greatest stays.
    """
    of = lambda kind: rows.where(F.col("dict_type") == kind)
    tags = F.lit(None).cast("array<struct<tag: string, prob: double>>").alias("tags")
    none = F.array().cast("array<string>").alias("words")
    found = rows.where(F.col("dict_type").isin("USER", "STOP", "UNIT") & F.col("keyword").isNotNull())
    found = found.select(F.col("dict_type").alias("kind"), chars.fold(F.col("keyword")).alias("key")).distinct().select("kind", "key", none, tags)
    for kind, df in (("SYNONYM", synonyms(of("SYNONYM"))), ("UNIT_SYNONYM", synonyms(of("UNIT_SYNONYM"))), ("COMPOUND", parts(of("COMPOUND"))), ("SPACE", forced_splits(of("SPACE")))):
        one = df if kind.endswith("SYNONYM") else df.groupBy("key").agg(F.max("words").alias("words"))
        found = found.unionByName(one.where("key is not null").select(F.lit(kind).alias("kind"), "key", "words", tags))
    if lex is not None:
        each = lex.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("tag", "prob"))).alias("tags"))
        found = found.unionByName(each.select(F.lit("SYSTEM").alias("kind"), "key", F.lit(None).cast("array<string>").alias("words"), "tags"))
    return found


def fits(rows: DataFrame, lex: DataFrame | None = None) -> bool:
    """Whether a snapshot may be made: no table has more than SNAPSHOT_ROWS rows."""
    return all(df.limit(SNAPSHOT_ROWS + 1).count() <= SNAPSHOT_ROWS for df in (rows, lex) if df is not None)


def snapshot(rows: DataFrame, lex: DataFrame | None = None) -> rules.Dictionaries:
    """All dictionaries as one object for the Arrow functions; refused beyond SNAPSHOT_ROWS."""
    if not fits(rows, lex):
        raise ValueError(f"more than {SNAPSHOT_ROWS} dictionary rows: large.analyse takes them by join")
    kinds: dict[str, dict] = {k: {} for k in KINDS}
    for r in entries(rows, lex).collect():
        kinds[r["kind"]][r["key"]] = [(t["tag"], t["prob"]) for t in r["tags"]] if r["tags"] is not None else list(r["words"])
    return rules.Dictionaries(**{name: set(kinds[kind]) if kind in ("USER", "STOP", "UNIT") else kinds[kind] for kind, name in KINDS.items()})
