import pytest

from termloom.operators import morph


def rows(*items):
    """``surface/TAG`` items; a leading ``_`` is a space, ``|kind|first|last|expr`` may follow."""
    out = []
    for i, item in enumerate(items):
        head, *more = item.split("|")
        surface, _, tag = head.rpartition("/")
        out.append((1, i, surface.lstrip("_"), tag, None, *(more or [None] * 4), int(surface[0] == "_")))
    return out


CASES = {
    "basic": ("standard", 9999, rows("진달래/NNG", "_꽃/NNG", "이/JKS", "_피/VV", "었/EP", "습니다/EF", "./SF"), "진달래 1 1 0 3, 꽃이 1 1 4 6, 꽃 0 1 4 5, 피었습니다 1 1 7 12, 피/VV 0 1 7 8"),
    "decompound": ("standard", 1, rows("삼성전자/NNP|Compound|||삼성/NNG/*+전자/NNG/*"), "삼성 1 1 0 2, 삼성전자 0 2 0 4, 전자 1 1 2 4"),
    "three parts": ("standard", 1, rows("아질산나트륨/NNG|Compound|||아/NNG/*+질산/NNG/*+나트륨/NNG/*"), "아 1 1 0 1, 아질산나트륨 0 3 0 6, 아질산 0 2 0 3, 질산 1 1 1 3, 질산나트륨 0 2 1 6, 나트륨 1 1 3 6"),
    "no decompound": ("standard", 9999, rows("삼성전자/NNP|Compound|||삼성/NNG/*+전자/NNG/*"), "삼성전자 1 2 0 4"),
    "preanalysis": ("standard", 4, rows("은전한닢/NNG+NR+NNG|Preanalysis|NNG|NR|은전/NNG/*+한/NR/*+닢/NNG/*"), "은전 1 1 0 2, 한 1 1 2 3, 닢 1 1 3 4"),
    "unknown": ("standard", 4, rows("걀꿀/UNKNOWN", "_없/VA", "는/ETM", "_단어/NNG"), "걀꿀 1 1 0 2, 없는 1 1 3 5, 없/VA 0 1 3 4, 단어 1 1 6 8"),
    "symbols": ("standard", 3, rows("!@#/SY"), ""),
    "suffix": ("standard", 4, rows("공대/NNG", "생/XSN", "은/JX", "_바쁘/VA", "다/EF"), "공대 1 1 0 2, 생은 1 1 2 4, 생 0 1 2 3, 바쁘다 1 1 5 8, 바쁘/VA 0 1 5 7"),
    "own prefix": ("standard", 4, rows("왕/XPN", "게임/NNG"), "왕 1 1 0 1, 왕게임 0 2 0 3, 게임 1 1 1 3"),
    "prefix": ("standard", 4, rows("비/XPN", "정상/NNG"), "비정상 1 1 0 3"),
    "inflected": ("standard", 4, rows("오빤/NNG+VCP+JX|Inflect|NNG|JX|오빠/NNG/*+이/VCP/*+ㄴ/JX/*", "강남/NNP"), "오빤 1 1 0 2, 오빠 0 1 0 2, 강남 1 1 2 4"),
    "similarity": ("similarity", 9999, rows("진달래/NNG", "_꽃/NNG", "이/JKS", "_피/VV", "었/EP", "습니다/EF", "./SF"), "진달래 1 1 0 3, 꽃 1 1 4 5"),
    "keyword": ("keyword", 9999, rows("진달래/NNG", "_꽃/NNG", "이/JKS", "_피/VV", "었/EP", "습니다/EF", "./SF"), "진달래 1 1 0 3, 꽃 1 1 4 5, 피었습니다 1 1 7 12"),
}


@pytest.mark.parametrize("name", CASES)
def test_golden(spark, name):
    mode, least, morphemes, wanted = CASES[name]
    found = morph.tokenize(spark.createDataFrame(morphemes, morph.MORPHEME), mode, least).orderBy("token_no").collect()
    assert ", ".join(f"{t.term} {t.pos_incr} {t.pos_len} {t.start_off} {t.end_off}" for t in found) == wanted


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        morph.tokenize(spark.createDataFrame([], morph.MORPHEME), "other")
