"""Operator 9: SimHash near-dedup by tiled exact comparison.

A fingerprint has a bit set where more than half of the text's shingle hashes
have it. Equal fingerprints are one row from the start, so copies never meet
as pairs. The distinct ones are sorted by population counts and cut into
blocks; a task takes one pair of blocks and compares their tiles with
exclusive-or and bit counts. Two numbers that differ in d bits differ in
population count by d at most, and so do the sums over their bytes, so a pair
of tiles whose counts lie further apart is skipped, exactly.

A task sends out a spanning forest of the links it found, not the links: at
most one row for each fingerprint it holds, with the same components. Blocks
have a bounded number of rows, so a task's memory does not grow with the
input, only the number of tasks does.

Defined cases: a null or empty text, or one without words, has fingerprint
zero, which links like any other; an empty table gives an empty result; rows
that repeat a doc_id count as one document, joined to all that any of them
links to; rows with a null doc_id are documents of their own, and a component
without another doc_id has a null component_id; other columns of the input are
ignored, whatever their names; texts of any length are read whole.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.components import components
from termloom.llm.store import BROADCAST_ROWS, materialise, small

#: Fingerprints of a tile, and the most of a block (one side of a task).
TILE = 1024
BLOCK = 262_144
#: Blocks of a small input, so that its comparison is spread too.
LEAST_BLOCKS = 8
#: Tasks that the pairs of blocks are dealt to, unless the cluster has more than a quarter as many cores.
MOST_TASKS = 4096


def shingles(text: bytes, size: int) -> list[bytes]:
    """Runs of ``size`` words joined by one space; a shorter text is one shingle, none without words."""
    words = text.lower().split()  # of bytes: A-Z and the six ASCII white-space characters only
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    return [joined[a : b - 1] for a, b in zip(starts, ends[size - 1 :], strict=False)]


def fingerprint(text: bytes, size: int, seeds: list[int], spread: int = 1, distinct: bool = False) -> bytes:
    """Big-endian 64-bit words, ``spread`` per seed: the hash itself and others mixed from it.

    A shingle counts as often as it is in the text, or once if ``distinct``.
    """
    import xxhash

    parts = shingles(text, size)
    if distinct:
        parts = list(set(parts))
    if not parts:
        return bytes(8 * len(seeds) * spread)
    out = b""
    for seed in seeds:
        some = (parts[at : at + 8192] for at in range(0, len(parts), 8192))
        out += majority((np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in s), dtype=np.uint64, count=len(s)) for s in some), spread)
    return out


def majority(parts: Iterable[np.ndarray], spread: int) -> bytes:
    """The fingerprint of shingle hashes, which come in arrays of at most 8192: ``spread`` big-endian words."""
    total, count = np.zeros((spread, 64), dtype=np.int64), 0
    for hashes in parts:
        count += len(hashes)
        for k in range(spread):
            bits = np.unpackbits((_mixed(hashes, k) if k else hashes).astype(">u8").view(np.uint8)).reshape(-1, 64)
            total[k] += bits.sum(axis=0, dtype=np.uint16)  # at most 8192
    return np.packbits(2 * total.reshape(-1) > count).tobytes()


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Another 64-bit hash from each of ``hashes``: a bijection by shifts and odd factors."""
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, size: int = 4, seeds: tuple[int, ...] = (42,), spread: int = 1) -> DataFrame:
    """(doc_id, fp): the fingerprint in bytes, of the whole text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = [fingerprint(t.as_py() or b"", size, list(seeds), spread) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp binary")


def _forest(a: np.ndarray, b: np.ndarray, links: set[tuple[int, int]], parent: dict[int, int]) -> None:
    """Add to ``links`` those of the edges (a, b) that join two trees of ``parent``."""

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            links.add((x, y))


def _thin(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the same components as (a, b), one for each node at most where there were many."""
    if len(a) < 4096:
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:  # labels sink to the least of each component
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, new[i])
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def compare(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]] | None, radius: int, coarse: int | None = None) -> set[tuple[int, int]]:
    """Spanning links between tiles (fps [n, words] uint64, ids [n]); within ``left`` if right is None.

    With ``coarse``, a link must also differ in no more bits of the first two
    words; the others are then compared for such pairs alone.
    """
    links: set[tuple[int, int]] = set()
    parent: dict[int, int] = {}

    def bounds(tiles):
        counts = [np.bitwise_count(np.ascontiguousarray(f).view(np.uint8)).reshape(len(f), -1) for f, _ in tiles]
        return np.array([c.min(0) for c in counts], dtype=np.int16), np.array([c.max(0) for c in counts], dtype=np.int16), np.array([[c.sum(1).min(), c.sum(1).max()] for c in counts], dtype=np.int64)

    low_r, high_r, sum_r = bounds(right if right is not None else left)
    low_l, high_l, sum_l = (low_r, high_r, sum_r) if right is None else bounds(left)
    for x, (f, ids) in enumerate(left):
        apart = np.maximum(0, np.maximum(low_r - high_l[x], low_l[x] - high_r)).sum(1)
        total = np.maximum(0, np.maximum(sum_r[:, 0] - sum_l[x, 1], sum_l[x, 0] - sum_r[:, 1]))
        near = np.flatnonzero((apart <= radius) & (total <= radius))
        for y in near[near >= x] if right is None else near:
            g, other = (left if right is None else right)[y]
            step = 128
            for at in range(0, len(f), step):  # rows a few at a time, so that the matrix stays in the cache
                part = f[at : at + step]
                d = np.bitwise_count(part[:, None, 0] ^ g[None, :, 0]).astype(np.uint16 if f.shape[1] > 3 else np.uint8, copy=False)
                for w in range(1, f.shape[1] if coarse is None else 2):
                    d += np.bitwise_count(part[:, None, w] ^ g[None, :, w])
                i, j = np.nonzero(d <= (radius if coarse is None else coarse))
                if coarse is not None and len(i):
                    close = np.bitwise_count(part[i] ^ g[j]).sum(1, dtype=np.int32) <= radius
                    i, j = i[close], j[close]
                if len(i):
                    _forest(*_thin(ids[at + i], other[j]), links, parent)
    return links


def links(distinct: DataFrame, radius: int, words: int = 1, coarse: int | None = None) -> DataFrame:
    """(a, b) rows that connect all ``distinct`` (fp binary, rep long) within ``radius`` bits.

    ``distinct`` is a stored table with each fingerprint once.
    """
    n = distinct.count()
    blocks = max(LEAST_BLOCKS, -(-n // BLOCK))
    ones = F.bit_count(F.conv(F.hex(F.substring(F.col("fp"), 1, 4)), 16, 10).cast("long"))
    total = ones
    for at in range(5, 8 * words + 1, 4):
        total = total + F.bit_count(F.conv(F.hex(F.substring(F.col("fp"), at, 4)), 16, 10).cast("long"))
    keyed = distinct.withColumns({"_c": total, "_h": ones})

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        fps, ids, counts = [], [], []
        out = ["part", "tile", "low", "high", "fps", "ids"]

        def tile(size: int) -> pa.RecordBatch:
            nonlocal number
            c = counts[:size]
            row = [[part], [number], [min(c)], [max(c)], [b"".join(fps[:size])], [np.array(ids[:size], dtype="<i8").tobytes()]]
            number += 1
            del fps[:size], ids[:size], counts[:size]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], out)

        for batch in batches:
            fps += batch.column(0).to_pylist()
            ids += batch.column(1).to_pylist()
            counts += batch.column(2).to_pylist()
            while len(fps) >= TILE:
                yield tile(TILE)
        if fps:
            yield tile(len(fps))

    # Sorted by total count, then by that of the first half: tiles are narrow in both.
    ranged = keyed.repartitionByRange(blocks, "_c", "_h", "fp").sortWithinPartitions("_c", "_h", "fp")
    tiled = materialise(ranged.select("fp", F.col("rep").cast("long"), F.col("_c").cast("int")).mapInArrow(tiles, "part int, tile int, low int, high int, fps binary, ids binary"), "tiles")
    ends = tiled.groupBy("part").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum(F.octet_length("ids") / 8).cast("long").alias("rows")).orderBy("part").collect()  # one row a range
    joined: list[list] = []  # a block: neighbouring ranges of up to ``most`` rows, however many ranges there are
    most, held = min(BLOCK, -(-n // LEAST_BLOCKS)), 0
    for e in ends:
        held += e.rows
        if not joined or held > most:
            joined.append([])
            held = e.rows
        joined[-1].append(e)
    spans = [(min(e.low for e in es), max(e.high for e in es)) for es in joined]
    # Blocks lie in order of their counts, so those that one must meet follow it without a gap: up to ``reach``, and from ``first`` on
    # those that reach it. This is one row a range; the pairs, which are many more, are made on the executors.
    reach = [bisect.bisect_right([s[0] for s in spans], high + radius) - 1 for _, high in spans]
    first = [bisect.bisect_left(reach, b) for b in range(len(spans))]
    ranges = tiled.sparkSession.createDataFrame([(e.part, b, first[b], reach[b]) for b, es in enumerate(joined) for e in es] or [(-1, -1, -1, -1)], "part int, block int, first int, reach int")
    pairs = sum(last - b + 1 for b, last in enumerate(reach))

    def work(key: tuple, tables: pa.Table) -> pa.Table:
        sides = {0: [], 1: []}
        for block, fps, ids in zip(*(tables.column(c).to_pylist() for c in ("block", "fps", "ids")), strict=True):
            f = np.frombuffer(fps, dtype=">u8").astype(np.uint64).reshape(-1, words)
            sides[int(block != key[0].as_py())].append((f, np.frombuffer(ids, dtype="<i8")))
        found = compare(sides[0], sides[1] if key[0].as_py() != key[1].as_py() else None, radius, coarse) if sides[0] else set()
        rows = sorted(found)
        return pa.table({"a": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64())})

    # A pair of blocks is the unit of work and of memory; a task takes one or, where there are very many, several in turn.
    tasks = min(max(pairs, 1), max(MOST_TASKS, 4 * tiled.sparkSession.sparkContext.defaultParallelism))
    held = tiled.select("part", "tile", "fps", "ids").join(F.broadcast(ranges) if len(ends) <= BROADCAST_ROWS else ranges.hint("merge"), "part")
    dealt = held.withColumn("other", F.explode(F.sequence("first", "reach")))
    dealt = dealt.select("part", "tile", "fps", "ids", "block", F.least("block", "other").alias("pair_a"), F.greatest("block", "other").alias("pair_b"))
    return dealt.repartition(tasks, "pair_a", "pair_b").groupBy("pair_a", "pair_b").applyInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, size: int = 4, seeds: tuple[int, ...] = (42,), spread: int = 1, coarse: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (hex), component_id.

    ``spread`` words a seed make a fingerprint longer and its radius sharper;
    ``coarse`` is the most that the first two of three words or more may differ.
    """
    words = len(seeds) * spread
    if coarse is not None and words < 3:
        raise ValueError("coarse needs fingerprints of three words or more")
    fps = materialise(fingerprints(docs, size, seeds, spread), "fingerprints")
    # Each fingerprint has a number of its own in the links; a doc_id may be null or stand for several.
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("rep", F.monotonically_increasing_id())
    distinct = materialise(distinct, "distinct")  # stored, so that ``rep`` stays what it is
    found = materialise(components(links(distinct.select("fp", "rep"), radius, words, coarse).unionByName(_shared(fps, distinct))), "components")
    labelled = distinct.join(F.broadcast(found) if small(found) else found.hint("merge"), distinct.rep == found.node, "left")
    labelled = materialise(labelled.select("fp", "least", F.coalesce("component", "rep").alias("group")), "labelled")
    least = labelled.groupBy("group").agg(F.min("least").alias("component_id"))
    least = materialise(least, "least")
    labelled = labelled.join(F.broadcast(least) if small(least) else least.hint("merge"), "group").select("fp", "component_id")
    return fps.join(labelled.hint("merge"), "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def _shared(fps: DataFrame, distinct: DataFrame) -> DataFrame:
    """(a, b) links between the fingerprints that one doc_id has."""
    key = F.xxhash64("fp")
    several = fps.where("doc_id is not null").groupBy("doc_id").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    several = materialise(several.where("low <> high").select("doc_id"), "several")
    uses = fps.join(F.broadcast(several) if small(several) else several.hint("merge"), "doc_id").distinct()
    uses = materialise(uses.join(distinct.select("fp", "rep").hint("merge"), "fp").select("doc_id", "rep"), "uses")
    first = uses.groupBy("doc_id").agg(F.min("rep").alias("b"))
    return uses.join(F.broadcast(first) if small(first) else first.hint("merge"), "doc_id").select(F.col("rep").alias("a"), "b")
