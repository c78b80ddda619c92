"""Operator 3: token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton names every piece that ends at each place of a word;
dynamic programming carries the best score and the number of pieces there and
keeps no back pointers. The tie rule is that of the ``tokenizers`` library's
unigram model: arrivals are tried from the earliest start, and a later one
replaces an earlier one only with a strictly greater score. A character that
no one-character piece covers costs ten below the least score and falls back
to its UTF-8 bytes.

White space becomes the marker, each marker opens a word, and one is put in
front of the text, so a word is segmented alone and each distinct word once
per task table (cleared at ``TABLE`` words, which bounds memory only).

Defined cases: a null or empty text has no tokens; an empty table gives an
empty result; repeated rows are counted each; other columns of the input are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
TABLE = 300_000


def vocabulary(model_path: str) -> list[tuple[str, float]]:
    """(piece, score) in id order, from a SentencePiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Counter:
    """Number of tokens of a text, as the unigram model with byte fallback has them."""

    def __init__(self, pieces: list[tuple[str, float]], table: int = TABLE):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in dict(pieces[::-1]).items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - 10.0
        self.limit, self.table = table, {}

    def word(self, word: str) -> int:
        n, unknown = len(word), self.unknown
        arrivals: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, found in self.automaton.iter(word):  # the longest first at each end
            arrivals[end + 1].append(found)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            score = None
            pieces, single = 0, False
            for length, own in arrivals[end]:
                start = end - length
                if (s := best[start] + own) > score if score is not None else True:
                    score = best[start] + own
                    pieces = count[start] + 1
                single |= length == 1
            if not single and (score is None or best[end - 1] + unknown > score):
                score = best[end - 1] + unknown
                pieces = count[end - 1] + len(word[end - 1].encode())
            best[end], count[end] = score, pieces
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        table, total = self.table, 0
        marked = text.replace(" ", MARK)
        for word in (marked[1:] if marked[0] == MARK else marked).split(MARK):
            n = table.get(word)
            if n is None:
                if len(table) >= self.limit:
                    table.clear()
                n = table[word] = self.word(MARK + word)
            total += n
        return total


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]]) -> DataFrame:
    """(doc_id, n_tokens) of every whole text; the vocabulary is broadcast (its size is fixed)."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            counts = [counter.count(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long")
