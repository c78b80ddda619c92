"""Operator 7: exact dedup by content-defined chunk recipes (native).

A text is cut where its own content says so: after a white-space character
that follows one of a few letter pairs, at least ``LEAST`` and at most
``MOST`` characters after the last cut. Equal passages so give equal chunks
wherever they stand. A chunk is known by its length, its SHA-256 and an
independent 64-bit checksum; chunks that agree in all three are one, and one
that agreed in the SHA-256 alone would get an identifier of its own. A
document is then the ordered list of its chunks' identifiers, and equal lists
are equal texts.

Texts are read once and never shuffled: what moves is about fifty bytes for a
chunk. Chunks and recipes are counted on the map side first, so a chunk or a
text that a third of all rows share is one partial row per task; joins back
are ones that AQE may split.

Defined cases: a null text counts as empty; all empty texts are one group; of
equal texts the row with the largest doc_id stays, and of equal rows with one
doc_id exactly one; a null doc_id is smaller than any other; other columns of
the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.store import materialise, small, without

LEAST, MOST = 512, 8192
#: A cut stands after white space that follows one of these endings (about one word in forty).
ENDINGS = "[aeiou][dlg]|[nrt]k|[mz]e"


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The chunks of a text, which join to the text again."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most}}}?(?<=(?:{ENDINGS})\s)|.{{1,{most}}}"), F.lit(0))


def recipes(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """row, doc_id, text_sha256 and the ordered chunk keys of every text."""
    text = F.coalesce("text", F.lit(""))
    # Texts of one chunk at most (no longer than the least size) need no pattern.
    parts = F.when(F.length("t") <= least, F.when(F.length("t") == 0, F.array().cast("array<string>")).otherwise(F.array("t"))).otherwise(chunks(F.col("t"), least, most))
    key = lambda c: F.struct(F.unhex(F.sha2(c, 256)).alias("sha"), F.octet_length(c).alias("len"), F.xxhash64(c).alias("sum"))
    cut = docs.select(F.col("doc_id").cast("long"), text.alias("t")).select("doc_id", F.sha2("t", 256).alias("text_sha256"), parts.alias("parts"))
    return cut.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_sha256", F.transform("parts", key).alias("keys"))


def duplicates(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    made = materialise(recipes(docs, least, most), "recipes")  # stored, so that ``row`` stays what it is
    uses = made.select("row", F.posexplode("keys").alias("pos", "key")).select("row", "pos", "key.*")
    # A chunk's identifier: the number of its row in the stored table of verified chunks.
    verified = materialise(uses.groupBy("sha", "len", "sum").agg(F.count("*").alias("uses")).withColumn("id", F.monotonically_increasing_id()), "chunks")
    numbered = uses.join(verified.select("sha", "len", "sum", "id").hint("merge"), ["sha", "len", "sum"]).select("row", "pos", "id")
    lists = numbered.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("p")).select("row", F.col("p.id").alias("ids"))
    texts = made.select("row", "doc_id", "text_sha256").join(lists.hint("merge"), "row", "left")
    texts = materialise(texts.withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>"))), "lists")
    last = F.max(F.struct("doc_id", "row"))
    # Stored, so that the join has an exchange of its own, whose hot partitions AQE can split.
    groups = materialise(texts.groupBy("ids").agg(last.alias("last"), F.count("*").alias("group_size")).where("group_size > 1"), "groups")
    out = texts.join(groups.hint("merge"), "ids", "left")
    single = F.col("last").isNull()
    return out.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("last.row") == F.col("row"))).alias("kept"),
        "text_sha256",
    )


def chunk_store(docs: DataFrame, least: int = LEAST, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(chunks, recipes): each distinct chunk once, and the keys that rebuild each document.

    The form to keep a corpus in: the texts themselves move once, to be stored.
    """
    text = F.coalesce("text", F.lit(""))
    parts = docs.select("doc_id", F.posexplode(chunks(text, least, most)).alias("pos", "chunk"))
    parts = parts.withColumns({"sha": F.sha2("chunk", 256), "len": F.octet_length("chunk")})
    return parts.groupBy("sha", "len").agg(F.min("chunk").alias("chunk")), parts.select("doc_id", "pos", "sha", "len")


def nested(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as one struct, so that no name of ours meets one of theirs, with their key: doc_id and the text's SHA-256."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("_sha"))


def keep_last(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stay.

    Only keys of dropped rows meet the texts: broadcast where few, see ``without``.
    """
    judged = materialise(duplicates(docs), "judged")
    names = {"_id": F.coalesce("doc_id", F.lit(-(2**63))), "_sha": F.col("text_sha256")}
    groups = judged.withColumns(names).groupBy("_id", "_sha").agg(F.max("kept").alias("any"), F.count("*").alias("n"))
    gone = materialise(groups.where("not any").select("_id", "_sha"), "gone")
    left = without(nested(docs), gone, ["_id", "_sha"])
    tied = materialise(groups.where("any and n > 1").select("_id", "_sha"), "tied")  # one row in a table twice or more
    if tied.isEmpty():
        return left.select("row.*")
    few = F.broadcast(tied) if small(tied) else tied
    once = left.join(few, ["_id", "_sha"], "left_semi").dropDuplicates(["_id", "_sha"])
    return without(left, tied, ["_id", "_sha"]).unionByName(once).select("row.*")
