"""Operator 5: PII surrogates (native).

Patterns find e-mail addresses, phone, card, tax and account numbers, network
addresses, secrets and titled names. Each is reduced to a canonical form (a
phone number to its digits, an e-mail to lower case), so that its spellings
corefer, and gets one surrogate, keyed by a secret: letters stay letters of
their script and case, digits stay digits, cards keep a valid check digit,
network addresses stay in range. A name is its surname (the last word) and
given names, each an entity of its own, so ``Mr Smith`` and ``Mr. John Smith``
keep one surname; given names keep the gender of the title. The surrogate is
then written in the format of each mention.

Distinctness is checked on the table of all distinct entities: where two
would share a surrogate, or one equals an entity that really occurs, all but
one are drawn again, at most ``ROUNDS`` times; addresses, secrets and names
grow with each further draw. What still collides then (numbers of a fixed
width, where nearly all that exist are taken) gets a token, ``[phone:...]``
with 32 keyed hexadecimal digits, in place of a surrogate in its format.

The table has one row for each distinct entity; a document meets only the part
it needs, by a hash of its text, as a list in order of its mentions. Texts
without entities never move. Entities and texts are counted on the map side
first, so a mention that a third of all documents share is one partial row
per task; the joins back are ones that AQE may split.

Defined cases: a null text stays null, an empty one empty; texts of any length
are read whole; a secret without letter or digit (a masked one) is none; an
e-mail's domain has 126 labels at most; scripts: Latin (accented letters become
plain ones), Cyrillic, Greek, Hangul, Han and kana stay, letters of others
become Latin; equal texts get equal results; rows may repeat; the other
columns pass through, whatever their names, ``n_chars`` (where there is one)
is that of the new text where that has changed; an input column named
``n_entities`` is refused; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.bind import let
from termloom.llm.store import discard, materialise

_TITLE_M = r"(?:Mr|Herr|Hr|Señor|Sr|Monsieur|Sir|Don|Г-н|господин)"
_TITLE_F = r"(?:Mrs|Ms|Miss|Frau|Fr|Señora|Señorita|Sra|Srta|Madame|Mme|Mlle|Doña|Г-жа|госпожа)"
_NAME = r"\.?[ \u00A0]\p{Lu}[\p{L}'’\-]+(?:[ \u00A0]\p{Lu}[\p{L}'’\-]+){0,2}"
#: type -> pattern, in order of precedence.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.){1,126}[A-Za-z]{2,}",
    "access_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "service_key": r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_\-]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}|AIza[A-Za-z0-9_\-]{35})",
    "secret": r"(?i:\b(?:password|passwd|pwd|secret|token|api[_\-]?key)[ ]?[=:][ ]?)(?:\"[^\"\s]{6,}\"|'[^'\s]{6,}'|[^\s\"',;]{6,})",
    "iban": r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "card": r"(?<![\d\-])(?:\d{4}[ \-]?){3}\d{4}(?![\d])|(?<![\d\-])3[47]\d{2}[ \-]?\d{6}[ \-]?\d{5}(?!\d)",
    "tax_number": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)|(?<!\w)\(\d{3}\)[ ]?\d{3}[ .\-]\d{4}(?!\d)|(?<![\w.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-])",
    "name_m": rf"(?<!\p{{L}}){_TITLE_M}{_NAME}",
    "name_f": rf"(?<!\p{{L}}){_TITLE_F}{_NAME}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text that holds neither of these has no entity; tells most texts apart at little cost.
HINTS = (
    r"[0-9@=:]|(?:gh[pousr]_|sk-|xox[abprs]-|AIza|AKIA|ASIA)[A-Za-z0-9]",
    r"[MHSDFГг](?:rs?|s|iss|err|eñor(?:it)?a?|rt?a|onsieur|ir|on|rau|me|lle|adame|oña|-на?|-жа|осподин|оспожа)\.?[ \u00A0]\p{Lu}",
)
_SECRET_HEAD = r"^(?i:(?:password|passwd|pwd|secret|token|api[_\-]?key)[ ]?[=:][ ]?)[\"']?"
_TITLE_HEAD = rf"^(?:{_TITLE_M}|{_TITLE_F})\.?[ \u00A0]"
#: What stays as it is at the head of an entity, by type.
_KEEP_HEAD = {"access_key": r"^(?:AKIA|ASIA)", "service_key": r"^(?:gh[pousr]_|sk-|xox[abprs]-|AIza)", "secret": _SECRET_HEAD, "iban": r"^[A-Z]{2}"}

#: Draws of an entity; more for what can grow.
ROUNDS = 8
# Invented given names, by script and gender.
NAMES = {
    ("latin", "m"): "adam bruno carl daniel emil felix gustav henry ivan jonas karl leo martin noah oscar paul quentin robert simon thomas ulrich victor walter xavier".split(),
    ("latin", "f"): "anna bella clara diana emma flora greta helena irene julia karen laura maria nina olivia paula rita sofia teresa ursula vera wanda xenia yvonne".split(),
    ("cyrillic", "m"): "иван пётр олег борис юрий павел антон денис роман фёдор глеб игорь".split(),
    ("cyrillic", "f"): "анна мария ольга елена ирина вера нина дарья юлия софья лидия полина".split(),
    ("greek", "m"): "γιώργος νίκος κώστας γιάννης δημήτρης παύλος πέτρος στέφανος".split(),
    ("greek", "f"): "μαρία ελένη άννα σοφία ειρήνη βασιλική δήμητρα κατερίνα".split(),
}
_SYLLABLES = {
    "latin": "ba be bo da de di fa fe ga go ha he ka ke la le lo ma me mi na ne no pa pe ra re ri sa se so ta".split(),
    "cyrillic": "ба бе бо да де ди фа фе га го ха хе ка ке ла ле ло ма ме ми на не но па пе ра ре ри са се со та".split(),
    "greek": "βα βε βο δα δε δι φα φε γα γο χα χε κα κε λα λε λο μα με μι να νε νο πα πε ρα ρε ρι σα σε σο τα".split(),
}
#: How a drawn given name ends, by script and gender.
_ENDINGS = {("latin", "m"): "n", ("latin", "f"): "na", ("cyrillic", "m"): "н", ("cyrillic", "f"): "на", ("greek", "m"): "ς", ("greek", "f"): "να"}
#: Class of a character -> what it is replaced by; the first that fits.
_ALPHABETS = {
    "[0-9]": "0123456789",
    r"[\p{IsLatin}&&\p{Ll}]": "abcdefghijklmnopqrstuvwxyz",
    r"[\p{IsLatin}&&\p{Lu}]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    r"[\p{IsCyrillic}&&\p{Ll}]": "абвгдежзиклмнопрстуфхцчшэюя",
    r"[\p{IsCyrillic}&&\p{Lu}]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ",
    r"[\p{IsGreek}&&\p{Ll}]": "αβγδεζηθικλμνξοπρστυφχψω",
    r"[\p{IsGreek}&&\p{Lu}]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    r"\p{IsHangul}": "가나다라마바사아자차카타파하고노도로모보소오조초코토포호",
    r"\p{IsHan}": "山川田中木林石金水火土日月天人口大小上下東西南北春夏秋冬",
    r"\p{IsHiragana}": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほ",
    r"\p{IsKatakana}": "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホ",
    r"\p{Lu}": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    r"\p{L}": "abcdefghijklmnopqrstuvwxyz",
    r"\p{Nd}": "0123456789",
}


def kind_of(entity: Column) -> Column:
    """The first type whose pattern covers the whole entity."""
    out = F.lit("other")
    for name, pattern in reversed(PATTERNS.items()):
        # Look-arounds hold at the ends of a cut-out entity.
        out = F.when(entity.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def canonical(kind: Column, entity: Column) -> Column:
    """The (kind, canon) parts of a mention: what all mentions of one entity have in common."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    national = F.when(F.length(digits) == 11, F.regexp_replace(digits, "^1", "")).otherwise(digits)  # +1 and its absence corefer
    bare = F.rtrim(F.regexp_replace(entity, _SECRET_HEAD, ""), F.lit("\"'"))
    canon = (
        F.when(kind == "email", F.lower(entity))
        .when(kind == "phone", national)
        .when(kind.isin("card", "tax_number"), digits)
        .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .when(kind == "secret", bare)
        .otherwise(entity)
    )
    words = F.split(F.lower(F.regexp_replace(entity, _TITLE_HEAD, "")), "[ \u00a0]+")
    given = F.replace(kind, F.lit("name"), F.lit("given"))
    named = F.transform(words, lambda w, i: F.struct(F.when(i == F.size(words) - 1, "surname").otherwise(given).alias("kind"), w.alias("canon")))
    return F.when(kind.isin("name_m", "name_f"), named).otherwise(F.array(F.struct(kind.alias("kind"), canon.alias("canon"))))


def _stream(key: str, kind: Column, canon: Column, attempt: Column, block: int) -> Column:
    """128 hexadecimal digits that depend on the key, the entity, the attempt and the block."""
    inner = F.sha2(F.concat_ws("|", F.lit(f"{key}|{block}"), kind, canon, attempt.cast("string")), 256)
    return F.sha2(F.concat(F.lit(f"{key}/"), inner), 512)


def _number(stream: Column, at: int, width: int = 8) -> Column:
    return F.conv(F.substring(stream, at, width), 16, 10).cast("long")


def _shape(canon: Column, head: Column, stream: Column) -> Column:
    """Each letter and digit after ``head`` replaced by one of its class, by the stream; longer ones reuse it, shifted."""
    hexadecimal = canon.rlike("^[0-9a-f]{8,}$")
    chars = F.filter(F.split(canon, ""), lambda c: c != "")

    def one(c: Column, i: Column, own: Column) -> Column:
        kind = F.lit(None).cast("string")
        for cls, alphabet in reversed(_ALPHABETS.items()):
            kind = F.when(F.rlike(c, F.lit(cls)), alphabet).otherwise(kind)
        kind = F.when(own["hexadecimal"] & c.between("a", "f"), "abcdef").otherwise(kind)
        n = F.conv(F.substr(own["stream"], (i * 2) % 126 + 1, F.lit(2)), 16, 10).cast("int") + F.floor(i / 63).cast("int") * 7
        return F.when(i < own["head"], c).otherwise(F.coalesce(let(kind, lambda a: F.substr(a, n % F.length(a) + 1, F.lit(1))), c))

    bound = F.struct(stream.alias("stream"), head.alias("head"), hexadecimal.alias("hexadecimal"))
    return let(bound, lambda own: F.array_join(F.transform(chars, lambda c, i: one(c, i, own)), ""))


def _spelled(stream: Column, syllables: list[str], count: Column) -> Column:
    some = F.array(*map(F.lit, syllables))
    return F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: F.get(some, F.conv(F.substr(stream, i * 2 + 15, F.lit(2)), 16, 10).cast("int") % len(syllables))), "")


def _luhn(body: Column) -> Column:
    """The check digit of a card number without it."""
    chars = F.reverse(F.filter(F.split(body, ""), lambda c: c != ""))
    doubled = F.transform(chars, lambda c, i: F.when(i % 2 == 0, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10)).otherwise(c.cast("int")).cast("int"))
    total = F.aggregate(doubled, F.lit(0), lambda a, b: a + b)
    return ((10 - total % 10) % 10).cast("string")


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The surrogate of a canonical entity, as drawn at an attempt."""
    return let(_stream(key, kind, canon, attempt, 0), lambda stream: let(_shape(canon, _head(kind, canon), stream), lambda shaped: _drawn(kind, canon, attempt, stream, shaped)))


def _head(kind: Column, canon: Column) -> Column:
    """How many characters at the head of an entity stay."""
    head = F.lit(0)
    for name, pattern in _KEEP_HEAD.items():
        if name != "secret":
            head = F.when(kind == name, F.length(F.regexp_extract(canon, pattern, 0))).otherwise(head)
    return F.when(kind.isin("card", "phone"), 1).otherwise(head)


def _drawn(kind: Column, canon: Column, attempt: Column, stream: Column, shaped: Column) -> Column:
    # From the third draw on what may grow does: never too few for distinctness.
    more = F.when(attempt > 1, F.translate(F.substr(stream, F.lit(65), (attempt - 1) * 6), "0123456789", "ghijklmnop")).otherwise("")
    local, domain = F.regexp_extract(shaped, "^([^@]*)@", 1), F.regexp_extract(shaped, r"(@.*)\.[^.]*$", 1)
    email = F.concat(local, more, domain, F.regexp_extract(canon, r"\.[^.]*$", 0))  # the last label of the domain stays
    card = F.concat(F.substr(shaped, F.lit(1), F.length(shaped) - 1), _luhn(F.substr(shaped, F.lit(1), F.length(shaped) - 1)))
    ip = F.concat_ws(".", *[(_number(stream, 1 + 8 * k) % n + low).cast("string") for k, (n, low) in enumerate(((222, 1), (256, 0), (256, 0), (254, 1)))])
    person = F.lit(None).cast("string")
    for script, syllables in _SYLLABLES.items():  # Latin first, the others over it
        spelled = _spelled(stream, syllables, 3 + attempt)
        own = F.when(kind == "surname", spelled)
        for gender in "mf":
            listed = NAMES[script, gender]
            drawn = F.get(F.array(*map(F.lit, listed)), (_number(stream, 1) % len(listed)).cast("int"))
            own = F.when(kind == f"given_{gender}", F.when(attempt == 0, drawn).otherwise(F.concat(F.substr(spelled, F.lit(1), 2 + 2 * attempt), F.lit(_ENDINGS[script, gender])))).otherwise(own)
        person = own if script == "latin" else F.when(canon.rlike(rf"\p{{Is{script.capitalize()}}}"), own).otherwise(person)
    grows = kind.isin("secret", "service_key")
    return F.when(kind == "email", email).when(kind == "card", card).when(kind == "ip", ip).when(kind.isin("surname", "given_m", "given_f"), person).when(grows, F.concat(shaped, more)).otherwise(shaped)


def token(key: str, kind: Column, canon: Column) -> Column:
    """What stands for an entity that no free surrogate was found for."""
    return F.concat(F.lit("["), kind, F.lit(":"), F.substr(_stream(key, kind, canon, F.lit(-1), 1), F.lit(1), F.lit(32)), F.lit("]"))


def in_format(kind: Column, entity: Column, surs: Column) -> Column:
    """The surrogates of a mention's parts, written as the mention was."""
    sur = F.get(surs, F.lit(0))
    chars = F.filter(F.split(entity, ""), lambda c: c != "")
    slots = F.when(kind == "iban", F.lit("[A-Z0-9]")).otherwise(F.lit("[0-9]"))
    # A country code before the canonical digits stays.
    lead = F.length(F.regexp_replace(entity, "[^0-9]", "")) - F.length(sur)
    lead = F.when(kind == "phone", F.greatest(lead, F.lit(0))).otherwise(0)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def put(s: Column, c: Column) -> Column:
        own = F.regexp_like(c, slots)
        new = F.when(own & (s["n"] >= lead), F.substr(sur, s["n"] - lead + 1, F.lit(1))).otherwise(c)
        return F.struct(F.concat(s["out"], new).alias("out"), (s["n"] + own.cast("int")).alias("n"))

    spaced = F.aggregate(chars, start, put, lambda s: s["out"])
    quote = F.regexp_extract(entity, r"[\"']$", 0)
    title = F.regexp_extract(entity, _TITLE_HEAD, 0)
    words = F.split(F.regexp_replace(entity, _TITLE_HEAD, ""), "[ \u00a0]+")
    named = F.array_join(F.transform(surs, lambda w, i: F.when((F.length(F.get(words, i)) > 1) & (F.get(words, i) == F.upper(F.get(words, i))), F.upper(w)).otherwise(F.initcap(w))), " ")
    return (
        F.when(kind == "secret", F.concat(F.regexp_extract(entity, _SECRET_HEAD, 0), sur, quote))
        .when(kind.isin("name_m", "name_f"), F.concat(title, named))
        .when(sur.startswith("["), sur)
        .when(kind.isin("phone", "card", "tax_number", "iban"), spaced)
        .when((kind == "email") & (entity == F.upper(entity)), F.upper(sur))
        .otherwise(sur)
    )


def entities(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def assign(found: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """Distinct (kind, canon) -> sur, no two alike within a kind and none that really occurs there.

    All entities are drawn once; only those that collide, normally none or
    few, are drawn again, each time against all that are settled.
    """
    real = found.select("kind", "canon").distinct()
    kind, canon = F.col("kind"), F.col("canon")
    settled = materialise(real.withColumn("attempt", F.lit(0)).withColumn("sur", surrogate(key, kind, canon, F.col("attempt"))), "surrogates")
    for drawn in range(1, rounds + 1):
        first = settled.groupBy("kind", "sur").agg(F.min("canon").alias("_first"), F.count("*").alias("_n"))
        taken = settled.select("kind", F.col("canon").alias("sur"), F.lit(True).alias("_real"))
        bad = first.join(taken, ["kind", "sur"], "left").where("_n > 1 or _real").select("kind", "sur", F.when(F.col("_real").isNull(), F.col("_first")).alias("_first"))
        bad = materialise(bad, "collisions")
        if bad.isEmpty():
            discard(bad)
            break
        marked = settled.join(bad.withColumn("_bad", F.lit(True)), ["kind", "sur"], "left")
        again = F.coalesce("_bad", F.lit(False)) & ~F.coalesce(F.col("_first") == canon, F.lit(False))
        attempt = F.when(again, F.col("attempt") + 1).otherwise(F.col("attempt"))
        moved = marked.select("kind", "canon", attempt.alias("attempt"), "sur", again.alias("_again"))
        other = surrogate(key, kind, canon, F.col("attempt")) if drawn < rounds else token(key, kind, canon)
        after = materialise(moved.select("kind", "canon", "attempt", F.when(F.col("_again"), other).otherwise(F.col("sur")).alias("sur")), "surrogates")
        discard(bad)
        discard(settled)
        settled = after
    return settled.select("kind", "canon", "sur")


def _hinted(text: Column) -> Column:
    """Whether a text has an entity; two cheap patterns leave most texts out."""
    return F.coalesce((text.rlike(HINTS[0]) | text.rlike(HINTS[1])) & text.rlike(ANY), F.lit(False))


def replacements(texts: DataFrame, key: str) -> DataFrame:
    """(sha, new, n): of every text (column ``text``) with entities, by its SHA-256, what stands for each mention, in order, and how many changed."""
    found = texts.where(_hinted(F.col("text"))).select(F.sha2("text", 256).alias("sha"), entities(F.col("text")).alias("e"))
    found = materialise(found.groupBy("sha").agg(F.first("e").alias("e")).select("sha", F.posexplode("e").alias("pos", "mention")), "mentions")
    kind = kind_of(F.col("mention"))
    masked = (kind == "secret") & ~F.regexp_replace("mention", _SECRET_HEAD, "").rlike(r"[\p{L}\p{Nd}]")
    known = found.groupBy("mention").agg(F.count("*").alias("_n")).select("mention", F.when(~masked, kind).alias("kind"))
    known = materialise(known.withColumn("parts", canonical(F.col("kind"), F.col("mention"))).where("kind is not null"), "known")
    each = known.select("mention", F.col("kind").alias("whole"), F.posexplode("parts").alias("at", "part")).select("mention", "whole", "at", "part.*")
    table = assign(each, key)
    told = each.join(table.hint("merge"), ["kind", "canon"]).groupBy("mention", "whole").agg(F.sort_array(F.collect_list(F.struct("at", "sur"))).alias("s"))
    told = materialise(told.select("mention", in_format(F.col("whole"), F.col("mention"), F.col("s.sur")).alias("new")), "told")
    both = found.join(told.hint("merge"), "mention", "left").select("sha", "pos", F.coalesce("new", "mention").alias("new"), F.col("new").isNotNull().cast("int").alias("own"))
    listed = both.groupBy("sha").agg(F.sort_array(F.collect_list(F.struct("pos", "new"))).alias("m"), F.sum("own").cast("int").alias("n"))
    out = materialise(listed.select("sha", F.col("m.new").alias("new"), "n"), "replacements")
    for done in (found, known, table, told):
        discard(done)
    return out


def replace_pii(docs: DataFrame, key: str, count: bool = False) -> DataFrame:
    """``docs`` with surrogates in ``text`` (and ``n_entities``, the mentions replaced)."""
    if "n_entities" in docs.columns:
        raise ValueError("input already has n_entities")
    new = replacements(docs.select("text"), key)
    # The caller's row is one struct, so no name of ours can meet one of its own.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col("row")["text"]
    some = rows.where(_hinted(text)).withColumn("sha", F.sha2(text, 256)).join(new.hint("merge"), "sha", "left")
    changed = F.concat(F.array_join(F.transform("new", lambda e, i: F.concat(F.get("gaps", i), e)), ""), F.element_at("gaps", -1))
    some = some.withColumn("gaps", F.split(text, ANY, -1)).select("row", F.coalesce(changed, text).alias("new"), F.coalesce("n", F.lit(0)).alias("n"))
    both = some.unionByName(rows.where(~_hinted(text)).select("row", text.alias("new"), F.lit(0).alias("n")))
    own = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("new")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("n") > 0, F.length("new")).otherwise(own["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return both.select(*[c.alias(name) for name, c in own.items()], *[F.col("n").alias("n_entities")] * count)
