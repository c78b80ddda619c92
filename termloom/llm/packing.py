"""Operator 2: best-fit packing by large-item matching.

Pieces above one third of the capacity can share a bin with one other such
piece at most, so they are matched greedily: the longest takes the longest
that still fits beside it. Shorter pieces then go, longest first, into the
smallest gap that holds them.

Pieces of one length are interchangeable, so the plan is made on the histogram
of lengths (``capacity`` numbers, whatever the corpus) and is still one global
plan. It is a list of intervals ``(length, first rank, first bin, pieces per
bin, offset)``; a piece finds its bin from its rank among the pieces of its
length. Ranks come from counts per (length, salt), so a length that holds a
third of all pieces is spread over all tasks.

Defined cases: a null or empty text is a document of the end id alone; an
empty table gives an empty result; equal rows are packed each; other columns
of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.llm.store import materialise

CAPACITY = 2048
END_ID = 0
SPECIAL = "<|endoftext|>"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict[int, object] = {}


def byte_bpe(vocabulary: bytes):
    """An encoder text -> ids equal to those of the tokenizers library for this file.

    The ids are made by tiktoken from the vocabulary and merge order in the
    file, five times as fast; a text that it refuses goes to the tokenizers
    library itself. Files with a normalizer or another pre-tokenizer than the
    usual byte-level one go to the tokenizers library throughout.
    """
    key = zlib.crc32(vocabulary)
    if key not in _ENCODERS:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(vocabulary)
        slow = Tokenizer.from_str(vocabulary.decode())
        plain = spec["normalizer"] is None and spec["pre_tokenizer"].get("use_regex") and not spec["pre_tokenizer"]["add_prefix_space"]
        if plain and [x["content"] for x in spec["added_tokens"]] == [SPECIAL]:
            visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
            chars = {chr(b): b for b in visible}
            chars |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}
            added = spec["added_tokens"][0]["id"]
            ranks = {bytes(chars[c] for c in w): i for w, i in spec["model"]["vocab"].items() if i != added}
            fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: added})

            def encode(text: str) -> list[int]:
                try:
                    return fast.encode(text, allowed_special="all")
                except (KeyboardInterrupt, SystemExit):
                    raise
                except BaseException:  # the library panics on patterns too deep for it, not as an Exception
                    return slow.encode(text, add_special_tokens=False).ids
        else:

            def encode(text: str) -> list[int]:
                return slow.encode(text, add_special_tokens=False).ids

        _ENCODERS.clear()
        _ENCODERS[key] = encode
    return _ENCODERS[key]


def cut(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 (and ids).

    Only a document longer than ``capacity`` is cut; its first piece takes
    what does not fill a whole piece.
    """
    with open(vocabulary_path, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(vocabulary.value)
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            ids_out: list[np.ndarray] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), END_ID], dtype="<u4")
                first = len(ids) % capacity or capacity
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    part = ids[a:b]
                    for col, v in zip(cols, (doc, k, a, b - a, zlib.crc32(part.tobytes())), strict=True):
                        col.append(v)
                    if with_ids:
                        ids_out.append(part.astype(np.int32))
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Intervals (length, rank from, rank to, first bin, pieces per bin, offset in the bin).

    A group is a number of equal bins: (gap, bins, [(length, per bin)]).
    """
    left = [0] * (capacity + 1)
    for length, n in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        left[length] += n
    gaps: list[list[tuple[int, tuple]]] = [[] for _ in range(capacity + 1)]  # by gap: (bins, content)
    third = capacity // 3
    for a in range(capacity, third, -1):
        b = min(a, capacity - a)
        while left[a]:
            while b > third and not left[b]:
                b -= 1
            if b <= third:
                gaps[capacity - a].append((left[a], ((a, 1),)))
                left[a] = 0
            elif b == a:
                if left[a] > 1:
                    gaps[capacity - 2 * a].append((left[a] // 2, ((a, 2),)))
                    left[a] %= 2
                else:
                    b -= 1
            else:
                n = min(left[a], left[b])
                gaps[capacity - a - b].append((n, ((a, 1), (b, 1))))
                left[a] -= n
                left[b] -= n
    for s in range(third, 0, -1):
        gap = s
        while left[s]:
            while gap <= capacity and not gaps[gap]:
                gap += 1
            if gap > capacity:  # no bin has room: open as many as this length needs
                gap = capacity
                gaps[gap].append((-(-left[s] // (capacity // s)), ()))
            bins, content = gaps[gap].pop()
            k = gap // s
            full = min(bins, left[s] // k)
            if full:
                gaps[gap - k * s].append((full, (*content, (s, k))))
                left[s] -= full * k
            if full < bins:
                rest = bins - full
                if left[s] and left[s] < k:  # the last, partly filled bin of this length
                    gaps[gap - left[s] * s].append((1, (*content, (s, left[s]))))
                    left[s] = 0
                    rest -= 1
                if rest and (content or left[s]):
                    gaps[gap].append((rest, content))
    rank = [0] * (capacity + 1)
    intervals, first = [], 0
    for groups in gaps:
        for bins, content in groups:
            at = 0
            for length, k in content:
                intervals.append((length, rank[length], rank[length] + bins * k, first, k, at))
                rank[length] += bins * k
                at += length * k
            first += bins if content else 0
    return intervals


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a stored table with ``length``) with sequence_id and offset."""
    spark: SparkSession = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    table = np.array(plan(histogram, capacity), dtype=np.int64).reshape(-1, 6)
    # One sorted key for (length, rank): lengths stay below 2**21, ranks below 2**42.
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    shared = spark.sparkContext.broadcast(((table[:, 0] << 42) + table[:, 1], table))

    salts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("length", "_salt").orderBy(*[c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns])
    ranked = salted.withColumn("_row", F.row_number().over(own) - 1).join(counts.hint("merge"), ["length", "_salt"])
    ranked = ranked.select(*pieces.columns, (F.col("_base") + F.col("_row")).alias("_rank"))
    schema = pieces.schema.jsonValue()
    fields = ", ".join(f"`{f['name']}` {pieces.schema[f['name']].dataType.simpleString()}" for f in schema["fields"])
    at_length, at_rank = ranked.columns.index("length"), ranked.columns.index("_rank")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = shared.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (at_length, at_rank))
            row = rows[np.searchsorted(keys, (length << 42) + rank, side="right") - 1]
            j = rank - row[:, 1]
            sequence, offset = row[:, 3] + j // row[:, 4], row[:, 5] + j % row[:, 4] * length
            arrays = [batch.column(i) for i in range(batch.num_columns) if i != at_rank]
            names = [n for n in batch.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(put, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and place all of ``docs``; one row per piece."""
    return place(materialise(cut(docs, vocabulary_path, capacity, with_ids), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """The filled sequences, from a table packed with ids: sequence_id, doc_ids, ids.

    A group holds at most ``capacity`` ids, so collecting one is bounded.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.col("p.doc_id").alias("doc_ids"), F.flatten("p.ids").alias("ids"))
