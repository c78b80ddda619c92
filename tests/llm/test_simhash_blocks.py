"""Tile comparison over many blocks against all pairs."""

import random

import pytest

from termloom.llm import simhash


@pytest.mark.parametrize("radius", [0, 4, 9])
def test_links_over_many_blocks_have_the_components_of_all_pairs(spark, monkeypatch, radius):
    monkeypatch.setattr(simhash, "BLOCK", 40)
    monkeypatch.setattr(simhash, "TILE", 8)
    rng = random.Random(radius)
    fps = [rng.getrandbits(64) & (rng.getrandbits(64) if k % 3 else 2**64 - 1) for k in range(150)]
    for f in fps[:60]:  # neighbours, over borders of blocks too
        fps += [f ^ sum(1 << b for b in rng.sample(range(64), d)) for d in (1, 4, 5)]
    fps = sorted(set(fps) | {0, 2**64 - 1})
    df = spark.createDataFrame([(f.to_bytes(8, "big"), i) for i, f in enumerate(fps)], "fp binary, rep long")
    found = {tuple(r) for r in simhash.links(df, radius).collect()}
    near = {(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= radius}
    assert {(max(p), min(p)) for p in found} <= near

    def groups(edges):
        root = list(range(len(fps)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(a)] = find(b)
        first = {}
        return [first.setdefault(find(i), i) for i in range(len(fps))]

    assert groups(found) == groups(near)


def test_no_rows_no_links(spark):
    assert simhash.links(spark.createDataFrame([], "fp binary, rep long"), 4).count() == 0
    docs = spark.createDataFrame([], "doc_id long, text string, fp string, rep string")
    assert simhash.near_duplicates(docs).count() == 0
