"""The near-duplicate stage against exact Jaccard similarity of shingle sets."""

import random

import corpus_pipeline
import pytest
from oracle import SMALL
from termloom.llm import simhash, similar

COLUMNS = "doc_id long, text string"


def exact_left(rows):
    """The (doc_id, text) that stay by brute force over all pairs."""
    sets = [set(simhash.shingles((t or "").encode(), corpus_pipeline.SHINGLE)) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if 5 * common >= 4 * (len(a) + len(sets[j]) - common):
                root[find(i)] = find(j)
    first = {}
    for i, (d, t) in enumerate(rows):
        key = (-(2**63) if d is None else d, t)
        first[find(i)] = min(first.get(find(i), key), key)
    return {(None if d == -(2**63) else d, t) for d, t in first.values()}


def stage_left(spark, rows):
    left = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, COLUMNS), SMALL)
    return {tuple(r) for r in left.collect()}


def words(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def with_similarity(first, count, shared, at=0):
    """``count`` texts that share a passage of ``shared`` words and have ``at`` others each."""
    passage = words(first, shared)
    return [(1000 * first + k, " ".join(passage + words((first, k).__hash__(), at))) for k in range(count)]


def test_links_below_the_limit_are_none(spark):
    # Pairs of 0.70 to 0.78 similarity: many of them have fingerprints within the radius.
    rows = [r for g in range(1, 31) for r in with_similarity(g, 2, 304, 40 + g)]
    assert stage_left(spark, rows) == exact_left(rows) == set(rows)


def test_groups_of_several_blocks(spark):
    rows = [r for g in range(1, 5) for r in with_similarity(g, 100, 604, 4 * g)]
    rows += [(-5, "a b c d e f g"), (-6, "a  b c d\te f G")]  # one shingle set
    assert stage_left(spark, rows) == exact_left(rows) and len(exact_left(rows)) == 5


def test_pairs_at_the_limit_are_found(spark):
    # Pairs of similarities 0.80 to 0.82, of about 110, 330 and 880 shingles a side.
    rows = []
    for g in range(1, 121):
        shared = (100, 300, 800)[g % 3]
        rows += with_similarity(g, 2, shared + 4, shared // 9 if g % 2 else shared // 8 - 1)
    assert stage_left(spark, rows) == exact_left(rows)


def test_texts_of_few_shingles_at_the_limit(spark):
    rows = []
    for g in range(1, 61):  # 4 shingles inside 5, 8 inside 10 and so on, up to 48 inside 60; every fifth just below
        n = 5 * (1 + g % 12)
        body = words(g, n + 4)
        rows += [(1000 * g, " ".join(body)), (1000 * g + 1, " ".join(body[: 4 * n // 5 + 4 - (g % 5 == 0)]))]
    rows += [(10**6 + k, f"one line that all of these texts have {k} {k + 1} {k + 2} {k + 3}") for k in range(50)]
    assert stage_left(spark, rows) == exact_left(rows)


def test_repeated_lines_are_no_difference(spark):
    rows = []
    for g, (n, line, times) in enumerate([(304, 10, 5), (1004, 12, 10), (204, 9, 60)], 1):
        body = words(g, n)
        rows += [(1000 * g, " ".join(body)), (1000 * g + 1, " ".join(body + body[40 : 40 + line] * times))]
    assert stage_left(spark, rows) == exact_left(rows) and len(exact_left(rows)) == 3


def test_stage_equals_exact_similarity(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").distinct().collect()
    rows = [tuple(r) for r in docs]
    assert stage_left(spark, rows) == exact_left(rows)


def test_rows_that_share_a_doc_id(spark):
    near, far = words(1, 200), " ".join(words(2, 200))
    text = lambda k: " ".join([*near[:k], "changed", *near[k + 1 :]])
    rows = [(1, text(10)), (5, text(20)), (5, far), (7, text(30)), (7, text(40)), (None, " ".join(words(3, 9))), (None, " ".join(words(4, 9)))]
    left = stage_left(spark, rows)
    assert left == exact_left(rows) and {(1, text(10)), (5, far)} <= left and len(left) == 4
    two = [(7, text(30)), (7, text(40))]
    assert stage_left(spark, two) == exact_left(two) and len(exact_left(two)) == 1


def test_unlike_texts_are_not_compared_as_all_pairs(spark, monkeypatch):
    """The tiles compare every pair of the fingerprints they get; of texts that share no frequent passage they are to get none."""
    compared = []
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda df, *a: compared.append(df.count()) or links(df, *a))
    rows = [(k, " ".join(words(k, 60))) for k in range(1, 800)]
    rows += [r for g in range(1001, 1031) for r in with_similarity(g, 2, 304, 20)]
    assert stage_left(spark, rows) == exact_left(rows) and len(exact_left(rows)) == 799 + 30
    assert sum(compared) == 0


@pytest.mark.parametrize("limits", [{"GROUP": 3}, {"PART_ROWS": 8, "GROUP": 20}, {"SAMPLE_USES": 2}, {"SAMPLE_USES": 10**6}])
def test_search_limits_lose_no_link(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(similar, name, value)
    line = words(9, 30)  # in every other text, and the whole of a few
    rows = [(10**6 + k, " ".join(line[k % 3 :] + words((8, k).__hash__(), 40 * (k % 4)))) for k in range(40)]
    rows += [r for g in range(1, 9) for r in with_similarity(g, 2 + g, 184, 8 + g)] + [(1, ""), (2, None)]
    assert stage_left(spark, rows) == exact_left(rows)
