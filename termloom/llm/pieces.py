"""Operator 6: SentencePiece encoding and decoding by a distinct-chunk table.

The white-space marker opens a piece and never stands inside one (runs of
markers aside), so no piece crosses from one marked word into the next. Each
text is cut before every run of markers, each distinct chunk is segmented once
by the library, and the ids are joined back by position. The table of a task
is cleared when it holds ``TABLE`` chunks: that bounds memory and costs time
only. A model that breaks the assumption (checked on its pieces and its
normalizer) is encoded text by text instead.

Defined cases: a null or empty text is the end id alone and decodes to the
empty string; an empty table gives an empty result; repeated rows are encoded
each; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
TABLE = 200_000
_MODELS: dict[bytes, tuple] = {}


def _model(proto: bytes) -> tuple:
    """(processor, whether pieces keep to marked words and the normalizer keeps text as it is)."""
    key = hashlib.sha256(proto).digest()
    if key not in _MODELS:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        inside = [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if MARK in p.lstrip(MARK)]
        probe = " a ﬁ  \t\nＡ "
        plain = sp.encode(probe, out_type=str, add_bos=False, add_eos=False)
        kept = sp.decode(sp.encode(probe)) == probe and not inside and "".join(plain).startswith(MARK + MARK + "a")
        _MODELS.clear()
        _MODELS[key] = (sp, kept)
    return _MODELS[key]


class Encoder:
    """Text -> (ids, ids as decimal text), with a table of the distinct chunks seen."""

    def __init__(self, proto: bytes, table: int = TABLE):
        self.sp, self.by_chunk = _model(proto)
        self.limit, self.table = table, {}
        self.numbers = list(range(self.sp.get_piece_size()))  # shared by all entries
        self.cut = re.compile(" +[^ ]*").findall

    def _entry(self, chunk: str) -> tuple[list[int], str]:
        # The library puts a marker before its input, so the chunk's first one is left out.
        ids = self.sp.encode(chunk[1:], add_bos=False, add_eos=False) if len(chunk) > 1 else [self.sp.piece_to_id(MARK)]
        found = [self.numbers[i] for i in ids], " ".join(map(str, ids))
        if len(self.table) >= self.limit:
            self.table.clear()
        self.table[chunk] = found
        return found

    def encode(self, text: str) -> tuple[list[int], str]:
        end = self.sp.eos_id()
        if not self.by_chunk or "\0" in text:
            ids = [*self.sp.encode(text, add_bos=False, add_eos=False), end]
            return ids, " ".join(map(str, ids))
        if not text:
            return [end], str(end)
        get, entry, ids, parts = self.table.get, self._entry, [], []
        for chunk in self.cut(" " + text.replace(MARK, " ")):
            found = get(chunk) or entry(chunk)
            ids += found[0]
            parts.append(found[1])
        ids.append(end)
        parts.append(str(end))
        return ids, " ".join(parts)


def _mapped(docs: DataFrame, model_path: str, schema: str, row: Callable[[Encoder, str], tuple], types: list[pa.DataType]) -> DataFrame:
    with open(model_path, "rb") as f:
        proto = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ["doc_id", *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(proto.value)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(batch), 500):  # ids of a few texts at a time
                rows = [row(encoder, t.as_py() or "") for t in texts[at : at + 500]]
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 500], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {schema}")


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids): each whole text as ids, with an end id."""
    return _mapped(docs, model_path, "ids array<int>", lambda e, t: (e.encode(t)[0],), [pa.list_(pa.int32())])


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text)."""
    with open(model_path, "rb") as f:
        proto = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _model(proto.value)[0]
        for batch in batches:
            texts = [sp.decode(ids.as_py() or []) or "" for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, made in one pass so that no ids leave the task."""

    def row(encoder: Encoder, text: str) -> tuple[int, str, str]:
        ids, joined = encoder.encode(text)
        decoded = encoder.sp.decode(ids)
        return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    return _mapped(docs, model_path, "n_tokens long, ids_sha256 string, decoded_sha256 string", row, [pa.int64(), pa.string(), pa.string()])
