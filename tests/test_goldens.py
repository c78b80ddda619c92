import pytest

from termloom.operators import morph
from termloom.plans import goldens


@pytest.mark.parametrize("options", sorted({c[:3] for c in goldens.CASES}))
def test_tokens_of_all_cases(spark, options):
    cases = [(i, c) for i, c in enumerate(goldens.CASES) if c[:3] == options]
    rows = [(i, *m) for i, c in cases for m in goldens.morphemes(c[3])]
    wanted = {(i, *t) for i, c in cases for t in goldens.tokens(c[4])}
    mode, least, original = options
    found = morph.tokenize(spark.createDataFrame(rows, morph.MORPHEME), mode, least, original)
    assert {tuple(r) for r in found.select("doc_id", "token_no", "term", "type", "sem", "pos_incr", "pos_len", "start_off", "end_off").collect()} == wanted


def test_cases_are_read_whole():
    assert len(goldens.CASES) > 30
    for _, _, _, text, _ in goldens.CASES:
        assert len(goldens.morphemes(text)) == text.count("⟨") > 0
