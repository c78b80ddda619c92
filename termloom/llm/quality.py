"""Operator 4: quality rules by distribution divergence (native).

Base rules count words, symbols, repeated lines and repeated three-word
windows of each whole text. The method then compares two histograms of the
document with the reference of its language, by Jensen-Shannon distance (0 to
1): how its characters divide over classes, and how its words divide over the
language's commonest words and the rest. References are the sums over all
documents of the language, or stored ones of another corpus. A histogram made of too few characters or words is
not judged, nor is a document of a language without reference.

Everything is computed inside the row, in one scan; what is aggregated is one
small row for each language with a word list (four), which bounds the
broadcast. No text is shuffled.

Windows are compared by a 64-bit hash within one document.

Defined cases: a null or empty text has no words and fails the base rules; texts of any
length are read whole; a
null or unknown language is judged by the base rules alone; rows may repeat;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.store import materialise

LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
#: Guards: the least characters and words that make a histogram worth judging. What the base rules pass has
#: words enough, since the limit below allows for the chance of few.
LEAST_CHARS, LEAST_HISTOGRAM_WORDS = 400, LEAST_WORDS
#: Largest Jensen-Shannon distances of a document that is kept; that of words
#: has an allowance for chance, divided by the root of the number of words.
MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE, CHANCE = 0.30, 0.20, 1.6

# The commonest words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o".split(),
}
#: Word list slots: the longest list, and one for all other words.
SLOTS = max(map(len, COMMON_WORDS.values()))
SPACE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"


def _among(listed: list[str]):
    return lambda w: w.isin(*listed)


def _repeat_words(hashes: Column) -> tuple[Column, Column]:
    """From the sorted (hash, place) of the windows: the places of those found twice, and how many words they cover."""
    same = lambda x, k: F.coalesce(F.get(hashes, k)["h"] == x["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter(hashes, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
    return places, F.when(F.size("_places") == 0, F.lit(0)).otherwise(
        F.aggregate(
            F.col("_places"),
            F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
            lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n")),
            lambda s: s["n"],
        )
    ).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts and the two histograms of every whole text."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split("_t", f"[{SPACE}]+"), lambda w: w != "")
    base = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), text.alias("_t")).withColumn("_w", words)

    windows = F.when(
        F.size("_w") > 2,
        F.sort_array(F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.struct(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h: bigint, i: int>>"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    # Classes are disjoint: the two that fill a text go first, so that the others are counted in the short rest.
    without = lambda held, cls: F.regexp_replace(held, f"[{cls}]+", "")
    count = lambda held, cls: F.length(held) - F.length(without(held, cls))
    common = F.lit(None)
    for lang, listed in COMMON_WORDS.items():
        joined = F.concat(F.lit(" "), F.array_join(F.filter("_low", _among(listed)), "  "), F.lit(" "))
        common = F.when(F.col("lang") == lang, joined).otherwise(common)
    step = base.withColumns({"_h": windows, "_lines": lines, "_low": F.transform("_w", lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?")))), "n_chars_all": F.length("_t").cast("long")})
    places, covered = _repeat_words(F.col("_h"))
    step = step.withColumns({"_places": places, "_common": common})
    step = step.withColumn("_not_lower", without("_t", "a-z")).withColumn("_rest", without("_not_lower", SPACE))
    lower, space = F.length("_t") - F.length("_not_lower"), F.length("_not_lower") - F.length("_rest")
    upper, digit, marks, symbol = (count("_rest", c) for c in ("A-Z", "0-9", r".,;:!?'\"()\-", SYMBOLS))
    step = step.select(
        "doc_id", "lang", F.size("_w").cast("long").alias("n_words"), "n_chars_all", "_common", "_places",
        F.array(*[c.cast("long") for c in (lower, upper, digit, space, marks, symbol)]).alias("_classes"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    slot = F.lit(None)
    for lang, listed in COMMON_WORDS.items():
        one = lambda w: ((F.length("_common") - F.length(F.replace("_common", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long")
        counts = F.array(*[one(w) for w in listed], *[F.lit(0).cast("long")] * (SLOTS - len(listed)))
        slot = F.when(F.col("lang") == lang, counts).otherwise(slot)
    out = step.select(
        "doc_id", "lang", "n_words", (F.col("n_chars_all") - F.get("_classes", F.lit(3))).alias("word_chars"),
        F.get("_classes", F.lit(5)).alias("n_symbols"), "n_dup_lines", covered.alias("n_repeat_words"),
        F.concat("_classes", F.array(F.col("n_chars_all") - F.aggregate("_classes", F.lit(0).cast("long"), lambda a, b: a + b))).alias("char_counts"),
        slot.alias("_slots"),
    )
    rest = F.array(F.col("n_words") - F.aggregate("_slots", F.lit(0).cast("long"), lambda a, b: a + b))
    return out.withColumn("word_counts", F.concat("_slots", rest)).drop("_slots")


def references(feats: DataFrame) -> DataFrame:
    """lang, ref_chars, ref_words: sums over all documents; one row for each language with a word list.

    A table to store and give to ``judge``, so that verdicts do not change with the batch.
    """
    return _summed(feats, "char_counts", "word_counts")


def combined(refs: DataFrame) -> DataFrame:
    """References of several corpora as one: those of one language add up; a language without a word list goes."""
    return _summed(refs, "ref_chars", "ref_words")


def _summed(counts: DataFrame, chars: str, words: str) -> DataFrame:
    classes, slots = 7, SLOTS + 1
    sums = [F.sum(F.get(chars, F.lit(k))).alias(f"c{k}") for k in range(classes)] + [F.sum(F.get(words, F.lit(k))).alias(f"w{k}") for k in range(slots)]
    found = counts.where(F.col("lang").isin(*COMMON_WORDS)).groupBy("lang").agg(*sums)
    return found.select("lang", F.array(*[f"c{k}" for k in range(classes)]).alias("ref_chars"), F.array(*[f"w{k}" for k in range(slots)]).alias("ref_words"))


def distance(p: Column, q: Column, np_: Column, nq: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two count arrays with totals ``np_`` and ``nq``."""

    def part(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0) + F.when(y > 0, y * F.log2(y / m)).otherwise(0.0)

    parts = F.zip_with(p, q, lambda a, b: part(a / np_, b / nq))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) / 2))


def judge(docs: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, both distances (null where not judged) and kept.

    ``refs`` are stored ``references``; without them those of ``docs`` itself are taken.
    """
    feats = features(docs) if refs is not None else materialise(features(docs), "quality")
    refs = F.broadcast(combined(refs) if refs is not None else references(feats))  # one row a language with a word list
    total = lambda c: F.aggregate(F.col(c), F.lit(0).cast("long"), lambda a, b: a + b)
    both = feats.join(refs, "lang", "left").withColumns({c: total(x) for c, x in (("_pc", "char_counts"), ("_qc", "ref_chars"), ("_pw", "word_counts"), ("_qw", "ref_words"))})
    chars = F.when((F.col("_pc") >= LEAST_CHARS) & (F.col("_qc") > 0), distance(F.col("char_counts"), F.col("ref_chars"), F.col("_pc"), F.col("_qc")))
    words = F.when((F.col("_pw") >= LEAST_HISTOGRAM_WORDS) & (F.col("_qw") > 0), distance(F.col("word_counts"), F.col("ref_words"), F.col("_pw"), F.col("_qw")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    judged = both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), chars.alias("char_distance"), words.alias("word_distance"))
    far = (F.coalesce("char_distance", F.lit(0.0)) > MOST_CHAR_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MOST_WORD_DISTANCE + CHANCE / F.sqrt(F.greatest("n_words", F.lit(1))))
    return judged.withColumn("kept", ~F.col("base_failed") & ~far)
