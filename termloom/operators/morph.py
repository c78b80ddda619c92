"""Morphemes to search tokens: phrase groups and the three tokenization modes.

Input is a table of morphemes (see ``MORPHEME``); a tagger is not part of this
library. Offsets and groups are windows over one document, the tokens of a
phrase are expressions over the array of its units: all of it runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MORPHEME = "doc_id long, seq int, surface string, tag string, sem string, kind string, start_tag string, end_tag string, expr string, space_len int"
TOKEN = "doc_id long, token_no int, term string, type string, pos string, sem string, pos_incr int, pos_len int, start_off int, end_off int"
NEVER = 9999

# Part-of-speech tags and their numbers.
TAGS = {
    "UNKNOWN": 0, "COMPOUND": 1, "INFLECT": 2, "PREANALYSIS": 3, "E": 100, "IC": 110, "J": 120, "MAG": 130, "MAJ": 131, "MM": 140,
    "NNG": 150, "NNP": 151, "NNB": 152, "NNBC": 153, "NP": 154, "NR": 155, "SF": 160, "SH": 161, "SL": 162, "SN": 163, "SP": 164,
    "SSC": 165, "SSO": 166, "SC": 167, "SY": 168, "SE": 169, "VA": 170, "VCN": 171, "VCP": 172, "VV": 173, "VX": 174, "XPN": 181,
    "XR": 182, "XSA": 183, "XSN": 184, "XSV": 185, "EOJEOL": 900,
}
# Which tag may follow which inside a phrase, as "left tags > right tags".
FOLLOWS = {
    "standard": [
        "E XR VV VA VX VCP VCN XSV XSA > E",
        "NNG NNP NNB NNBC NP NR COMPOUND MAG XR UNKNOWN > XSV XSA",
        "NNG NNP NNB NNBC NP NR COMPOUND XSN UNKNOWN > VCP",
        "NNG NNP NNB NNBC NP NR COMPOUND UNKNOWN XSN E MAG J SL SH > J",
        "XPN > NNG NR NP",
    ],
    "similarity": ["XPN > NNG NNP NNB NNBC NP NR COMPOUND UNKNOWN", "NNG NNP NNB NNBC NP NR COMPOUND UNKNOWN > XSN", "SL > SN SY", "SN > SL SY", "SY > SL SN"],
    "keyword": ["E VV VA VX > E", "NNG NNP NNB NNBC NP NR COMPOUND UNKNOWN > XSN", "XPN > NNG NNP NNB NNBC NP NR COMPOUND UNKNOWN"],
}
# Prefixes that stay words of their own.
INDEPENDENT_PREFIXES = frozenset("건 고 급 날 냉 대 맞 맨 맹 명 민 반 범 본 생 성 신 온 왕 원 재 주 참 총 친 탈 통 폐 풋 한 항 헛".split())
KEPT_ALONE = "COMPOUND SL SH SN XR NNG NNP NNBC NR".split()
ABSOLUTE = frozenset("NNG NNP NNB NNBC NP NR COMPOUND MAG MM XR SH SL SN UNKNOWN XPN XSN".split())


def tag_of(tag: Column) -> Column:
    """A tagger's tag as one of ``TAGS``: J* and E* are one each, others that are not listed UNKNOWN."""
    up = F.upper(tag)
    return F.when(up.startswith("J"), "J").when(up.rlike("^E[^J]"), "E").when(up.isin(*TAGS), up).otherwise("UNKNOWN")


def tag_id(tag: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv]), tag)


def tag_from_id(number: Column) -> Column:
    known = F.element_at(F.create_map(*[F.lit(x) for k, v in TAGS.items() for x in (v, k)]), number)
    return F.coalesce(known, F.when(number.between(200, 299), "INFLECT").otherwise("UNKNOWN"))


def tag_between(tag: Column, first: str, last: str) -> Column:
    return tag_id(tag).between(TAGS[first], TAGS[last])


def pairs(mode: str) -> list[tuple[str, str]]:
    return [(a, b) for rule in FOLLOWS[mode] for a in rule.partition(">")[0].split() for b in rule.partition(">")[2].split()]


def lowered(df: DataFrame, text: str = "text") -> DataFrame:
    """Documents as a tagger reads them: in lower case."""
    return df.withColumn(text, F.lower(text))


def parse_expression(expr: Column, strict: bool = False) -> Column:
    """``term/tag/sem+...`` as an array of (surface, tag, sem); ``*`` is null. ``strict`` refuses an item of fewer than three parts."""
    if strict:
        short = F.exists(F.split(expr, r"\+"), lambda x: F.size(F.split(x, "/")) < 3)
        expr = F.when(short, F.raise_error(F.concat(F.lit("not an expression: "), expr)).cast("string")).otherwise(expr)
    return F.transform(
        F.split(expr, r"\+"),
        lambda x: F.struct(F.get(F.split(x, "/"), F.lit(0)).alias("surface"), F.get(F.split(x, "/"), F.lit(1)).alias("tag"), F.nullif(F.get(F.split(x, "/"), F.lit(2)), F.lit("*")).alias("sem")),
    )


def _units(morphemes: DataFrame, min_len: int) -> DataFrame:
    """One row per unit of a phrase: PREANALYSIS and long enough COMPOUND morphemes as their parts, with offsets."""
    doc = Window.partitionBy("doc_id").orderBy("seq")
    kind = F.upper(F.col("kind"))
    own = F.when(kind.isin("COMPOUND", "INFLECT", "PREANALYSIS"), kind).otherwise(tag_of(F.col("tag")))
    rows = morphemes.select(
        "doc_id", "seq", "surface", F.col("tag").alias("raw"), "sem", own.alias("type"), "start_tag", "end_tag", "expr", F.coalesce("space_len", F.lit(0)).alias("space"),
    ).withColumn("start", (F.sum(F.col("space") + F.length("surface")).over(doc) - F.length("surface")).cast("int"))
    parts = parse_expression(F.col("expr"))
    many = F.size(F.split("expr", r"\+")) > 1
    pre = (F.col("type") == "PREANALYSIS") & many
    compound = (F.col("type") == "COMPOUND") & many & (F.length("surface") >= min_len)
    inner = F.col("type").isin("INFLECT", "PREANALYSIS")
    whole = F.struct(
        "surface", "raw", F.col("sem"), F.col("type"),
        F.when(inner, tag_of(F.col("start_tag"))).when(F.col("type") == "COMPOUND", "NNG").otherwise(F.col("type")).alias("first"),
        F.when(inner, tag_of(F.col("end_tag"))).when(F.col("type") == "COMPOUND", "NNG").otherwise(F.col("type")).alias("last"),
        F.when(F.col("type") == "COMPOUND", F.coalesce(F.size(F.split("expr", r"\+")), F.lit(1))).otherwise(1).alias("len"),
        F.col("start"), (F.col("space") > 0).alias("spaced"), F.col("expr"),
    )
    before = lambda i: F.aggregate(F.slice("_p", F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x["surface"]))
    each = F.transform(
        F.col("_p"),
        lambda x, i: F.struct(
            x["surface"].alias("surface"), x["tag"].alias("raw"), x["sem"].alias("sem"), tag_of(x["tag"]).alias("type"), tag_of(x["tag"]).alias("first"), tag_of(x["tag"]).alias("last"),
            F.lit(1).alias("len"), (F.col("start") + before(i)).alias("start"), (compound & (i == 0) & (F.col("space") > 0)).alias("spaced"), F.lit(None).cast("string").alias("expr"),
        ),
    )
    # A morpheme that is split counts as decompounded for its phrase when it is a compound.
    split = rows.withColumn("_p", parts).select(
        "doc_id", "seq", F.coalesce((F.col("type") == "COMPOUND") & (F.length("surface") >= min_len), F.lit(False)).alias("decompounded"), compound.alias("_c"),
        F.when(pre | compound, each).otherwise(F.array(whole)).alias("_u"),
    )
    return split.select("doc_id", "seq", "decompounded", F.coalesce("_c", F.lit(False)).alias("inner"), F.posexplode("_u").alias("part", "u")).select("doc_id", "seq", "part", "decompounded", "inner", "u.*")


def eojeols(morphemes: DataFrame, mode: str = "standard", min_len: int = 3) -> DataFrame:
    """Units with the number of their phrase (``eojeol``): gaps and islands over the adjacency pairs."""
    units = _units(morphemes, min_len)
    doc = Window.partitionBy("doc_id").orderBy("seq", "part")
    joint = F.concat_ws(">", F.lag("last").over(doc), F.col("first")).isin(*[f"{a}>{b}" for a, b in pairs(mode)])
    if mode == "keyword":
        stem = F.lag("type").over(doc).eqNullSafe("INFLECT") & ~F.coalesce(F.lag("first").over(doc).isin("VA", "VV"), F.lit(False))
        joint = joint & ~stem
    # The later parts of one compound belong together whatever their tags.
    follows = (F.col("inner") & (F.col("part") > 0)) | (F.coalesce(joint, F.lit(False)) & ~F.col("spaced"))
    return units.withColumn("_new", F.when(follows, 0).otherwise(1)).withColumn("eojeol", F.sum("_new").over(doc).cast("int")).drop("_new")


def _groups(units: DataFrame) -> DataFrame:
    unit = F.struct("seq", "part", "surface", "raw", "sem", "type", "first", "len", "start", "expr")
    return units.groupBy("doc_id", "eojeol").agg(F.sort_array(F.collect_list(unit)).alias("units"), F.max("decompounded").alias("decompounded"))


def _kept(mode: str) -> Column:
    """Whether a phrase is kept; only those of one unit may go."""
    one = F.get("units", F.lit(0))
    if mode == "standard":
        gone = (one["type"] == "SF") | tag_between(one["type"], "SP", "SE")
    elif mode == "similarity":
        gone = ~one["type"].isin(*KEPT_ALONE)
    else:
        stem = (one["type"] == "INFLECT") & one["first"].isin("VA", "VV")
        gone = ~(one["type"].isin(*KEPT_ALONE, "NNB", "NP") | stem)
    return (F.size("units") > 1) | ~gone


def _token(first: Column, second: int, surface: Column, kind: Column, pos: Column, sem: Column, incr: Column, length: Column, start: Column) -> Column:
    """A token with its place (first, second) in the order of its phrase."""
    term = F.when(kind.isin("VV", "VA"), F.concat_ws("/", surface, kind)).otherwise(surface)
    fields = {"first": first.cast("int"), "second": F.lit(second), "term": term, "type": kind, "pos": pos.cast("string"), "sem": sem.cast("string"),
              "pos_incr": incr.cast("int"), "pos_len": length.cast("int"), "start_off": start.cast("int"), "end_off": (start + F.length(surface)).cast("int")}
    return F.struct(*[c.alias(name) for name, c in fields.items()])


def _joined(units: Column) -> Column:
    return F.array_join(F.transform(units, lambda u: u["surface"]), "")


def standard_tokens(groups: DataFrame, use_original_form: bool = True) -> DataFrame:
    """``groups`` with ``tokens``: those of each phrase in standard mode, in output order.

    A phrase's tokens are spans over its units, each with its place in the
    order. Decompounded: of the leading units that are words of their own, each
    one, each two neighbours (before the later of them), all of them, and the
    phrase; the last two stand after the first unit. Otherwise: the phrase,
    then its words, each with the stem that an inflected one stands for.
    """
    none, zero, one = F.lit(None), F.lit(0), F.lit(1)
    absolute = sorted(ABSOLUTE | {"VA", "VV"} if use_original_form else ABSOLUTE)
    a, b = F.get("units", zero), F.get("units", one)
    prefixed = F.coalesce((a["type"] == "XPN") & b["type"].isin("NNG", "NR", "NP"), F.lit(False))
    apart = prefixed & a["surface"].isin(*sorted(INDEPENDENT_PREFIXES))
    slim = lambda u: F.struct(u["surface"].alias("surface"), u["raw"].alias("raw"), u["sem"].alias("sem"), u["type"].alias("type"), u["len"].cast("int").alias("len"), u["start"].cast("int").alias("start"), u["expr"].alias("expr"))
    noun = F.struct(F.concat(a["surface"], b["surface"]).alias("surface"), none.cast("string").alias("raw"), none.cast("string").alias("sem"), F.lit("NNG").alias("type"), one.alias("len"), a["start"].cast("int").alias("start"), none.cast("string").alias("expr"))
    plain = F.transform("units", slim)
    made = groups.select(
        "doc_id", "eojeol", (F.col("decompounded") | apart).alias("dec"),
        F.when(prefixed & ~apart, F.concat(F.array(noun), F.slice(plain, 3, F.greatest(F.size("units") - 2, zero)))).otherwise(plain).alias("u"),
    )
    made = made.withColumn("n", F.array_position(F.transform("u", lambda x: x["type"].isin(*absolute)), F.lit(False)).cast("int"))
    made = made.withColumn("n", F.when(F.col("n") == 0, F.size("u")).otherwise(F.col("n") - 1))
    made = made.withColumn("lead", F.slice("u", 1, F.col("n")))
    u, lead, n = F.col("u"), F.col("lead"), F.col("n")
    start = F.get(u, zero)["start"]
    tags = F.array_join(F.transform(u, lambda x: F.coalesce(x["raw"], F.lit(""))), "+")
    tags = F.when(tags != "", tags)
    phrase = lambda first, second, incr, length: _token(first, second, _joined(u), F.lit("EOJEOL"), tags, none, incr, length, start)
    word = lambda x, i, incr: _token(i, 2, x["surface"], x["type"], x["raw"], x["sem"], incr, x["len"], x["start"])
    total = lambda units: F.aggregate(units, zero, lambda s, x: s + x["len"])
    empty = F.filter(F.array(phrase(zero, 0, one, one)), lambda x: F.lit(False))

    tiny = lambda x: x["type"].isin("NNG", "NNP") & (F.length(x["surface"]) == 1)
    places = F.when(n > 1, F.sequence(one, n - 1)).otherwise(F.array().cast("array<int>"))
    places = F.filter(places, lambda i: ~(tiny(F.get(lead, i - 1)) & tiny(F.get(lead, i))))
    two = F.transform(places, lambda i: _token(i, 1, F.concat(F.get(lead, i - 1)["surface"], F.get(lead, i)["surface"]), F.lit("COMPOUND"), none, none, zero, F.get(lead, i - 1)["len"] + F.get(lead, i)["len"], F.get(lead, i - 1)["start"]))
    every = F.when(n > 2, F.array(_token(zero, 4, _joined(lead), F.lit("COMPOUND"), none, none, zero, total(lead), start))).otherwise(empty)
    spelled = (n == F.size(u)) & ((n > 2) | (F.size(places) == 1))  # a compound covers the phrase already
    apart_tokens = F.concat(F.transform(lead, lambda x, i: word(x, i, one)), two, every, F.when(spelled, empty).otherwise(F.array(phrase(zero, 3, zero, n))))

    def stem(x: Column, i: Column) -> Column:
        item = F.split(F.get(F.split(x["expr"], r"\+"), zero), "/")
        kind = tag_of(F.get(item, one))
        fits = F.coalesce((x["type"] == "INFLECT") & (F.size(item) == 3) & kind.isin(*absolute) & (F.length(F.get(item, zero)) <= F.length(x["surface"])), F.lit(False))
        return F.when(fits, _token(i, 3, F.get(item, zero), kind, F.get(item, one), F.nullif(F.get(item, F.lit(2)), F.lit("*")), zero, one, x["start"]))

    stems = F.filter(F.transform(u, stem), lambda x: x.isNotNull())
    words = F.filter(F.transform(u, lambda x, i: F.when(x["type"].isin(*absolute), word(x, i, zero))), lambda x: x.isNotNull())
    alone = F.array(word(F.get(u, zero), zero, one))
    tokens = (
        F.when(F.size(u) == 1, F.when(F.col("dec"), alone).otherwise(F.concat(alone, stems)))
        .when(F.col("dec") & (n > 0), apart_tokens)
        .when(F.col("dec"), F.array(phrase(F.lit(-1), 0, one, one)))
        .otherwise(F.concat(F.array(phrase(F.lit(-1), 0, one, one)), words, stems))
    )
    return made.select("doc_id", "eojeol", F.sort_array(tokens).alias("tokens"))


def tokenize(morphemes: DataFrame, mode: str = "standard", min_len: int = 3, use_original_form: bool = True) -> DataFrame:
    """Search tokens of every document (see ``TOKEN``)."""
    if mode not in FOLLOWS:
        raise ValueError(f"unknown mode {mode!r}")
    groups = _groups(eojeols(morphemes, mode, min_len)).where(_kept(mode))
    if mode == "standard":
        rows = standard_tokens(groups, use_original_form).select("doc_id", "eojeol", F.posexplode("tokens").alias("_i", "t")).select("doc_id", "eojeol", "_i", "t.*")
    else:
        one, many = F.get("units", F.lit(0)), F.size("units") > 1
        surface = F.array_join(F.transform("units", lambda u: u["surface"]), "")
        term = F.when(many, surface).when(one["type"].isin("VV", "VA"), F.concat_ws("/", one["surface"], one["type"])).otherwise(one["surface"])
        rows = groups.select(
            "doc_id", "eojeol", F.lit(0).alias("_i"), term.alias("term"), F.when(many, "EOJEOL").otherwise(one["type"]).alias("type"),
            F.array_join(F.transform("units", lambda u: u["raw"]), "+").alias("pos"), F.when(~many, one["sem"]).alias("sem"), F.lit(1).alias("pos_incr"),
            F.when(many, 1).otherwise(one["len"]).alias("pos_len"), one["start"].alias("start_off"), (one["start"] + F.length(surface)).alias("end_off"),
        )
    order = Window.partitionBy("doc_id").orderBy("eojeol", "_i")
    numbered = rows.withColumn("token_no", (F.row_number().over(order) - 1).cast("int"))
    return numbered.select("doc_id", "token_no", "term", "type", "pos", "sem", "pos_incr", "pos_len", "start_off", "end_off")


def positions(tokens: DataFrame) -> DataFrame:
    """Tokens with their absolute position: the running sum of increments."""
    order = Window.partitionBy("doc_id").orderBy("token_no")
    return tokens.withColumn("position", F.sum("pos_incr").over(order) - 1)
