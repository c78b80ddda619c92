"""Morphemes and the tokens that are expected of them.

Fixed values: the inputs and results below must equal those of the analyzer
that this library is compatible with. Notation of a morpheme:
``surface⟨TAG sem=.. KIND first→last =expression⟩``, ``␣`` for a space before
it; of a token: ``surface/TYPE/sem/pos_incr/pos_len/start/end``, ``‖`` between
phrases.
"""

from __future__ import annotations

import re

#: (mode, least length to decompound, original forms of verbs, morphemes, tokens)
CASES = [
    ('standard', 9999, True, '진달래⟨NNG⟩ ␣꽃⟨NNG⟩ 이⟨JKS⟩ ␣피⟨VV⟩ 었⟨EP⟩ 습니다⟨EF⟩ .⟨SF⟩',
     '진달래/NNG/null/1/1/0/3 ‖ 꽃이/EOJEOL/null/1/1/4/6, 꽃/NNG/null/0/1/4/5 ‖ 피었습니다/EOJEOL/null/1/1/7/12, 피/VV/null/0/1/7/8'),
    ('standard', 9999, False, '진달래⟨NNG⟩ ␣꽃⟨NNG⟩ 이⟨JKS⟩ ␣피⟨VV⟩ 었⟨EP⟩ 습니다⟨EF⟩ .⟨SF⟩',
     '진달래/NNG/null/1/1/0/3 ‖ 꽃이/EOJEOL/null/1/1/4/6, 꽃/NNG/null/0/1/4/5 ‖ 피었습니다/EOJEOL/null/1/1/7/12'),
    ('standard', 1, True, '삼성전자⟨NNP Compound =삼성/NNG/*+전자/NNG/*⟩',
     '삼성/NNG/null/1/1/0/2, 삼성전자/COMPOUND/null/0/2/0/4, 전자/NNG/null/1/1/2/4'),
    ('standard', 1, True, '아질산나트륨⟨NNG Compound =아/NNG/*+질산/NNG/*+나트륨/NNG/*⟩',
     '아/NNG/null/1/1/0/1, 아질산나트륨/COMPOUND/null/0/3/0/6, 아질산/COMPOUND/null/0/2/0/3, 질산/NNG/null/1/1/1/3, 질산나트륨/COMPOUND/null/0/2/1/6, 나트륨/NNG/null/1/1/3/6'),
    ('standard', 1, True, '새절역⟨NNP sem=지명 Compound =새/MM/~명사+절/NNG/*+역/NNG/*⟩',
     '새/MM/~명사/1/1/0/1, 새절역/COMPOUND/null/0/3/0/3, 새절/COMPOUND/null/0/2/0/2, 절/NNG/null/1/1/1/2, 역/NNG/null/1/1/2/3'),
    ('standard', 1, True, '을지로3가역⟨NNG Compound =을지로/NNP/*+3/SN/*+가/NNG/*+역/NNG/*⟩',
     '을지로/NNP/null/1/1/0/3, 을지로3가역/COMPOUND/null/0/4/0/6, 을지로3/COMPOUND/null/0/2/0/4, 3/SN/null/1/1/3/4, 3가/COMPOUND/null/0/2/3/5, 가/NNG/null/1/1/4/5, 역/NNG/null/1/1/5/6'),
    ('standard', 9999, True, '삼성전자⟨NNP Compound =삼성/NNG/*+전자/NNG/*⟩',
     '삼성전자/COMPOUND/null/1/2/0/4'),
    ('standard', 4, True, '무궁화⟨NNG Compound =무궁/NNG/*+화/NNG/*⟩',
     '무궁화/COMPOUND/null/1/2/0/3'),
    ('standard', 4, True, '삼성전자⟨NNP Compound =삼성/NNG/*+전자/NNG/*⟩',
     '삼성/NNG/null/1/1/0/2, 삼성전자/COMPOUND/null/0/2/0/4, 전자/NNG/null/1/1/2/4'),
    ('standard', 1, True, '삼성전자⟨NNP Compound =삼성/NNG/*+전자/NNG/*⟩ 는⟨JX⟩ ␣대표⟨NNG⟩ 적⟨XSN⟩ 인⟨VCP+ETM Inflect VCP→ETM =이/VCP/*+ㄴ/ETM/*⟩ ␣복합⟨NNG⟩ 명사⟨NNG⟩ 이⟨VCP⟩ 다⟨EF⟩ .⟨SF⟩',
     '삼성/NNG/null/1/1/0/2, 삼성전자는/EOJEOL/null/0/2/0/5, 삼성전자/COMPOUND/null/0/2/0/4, 전자/NNG/null/1/1/2/4 ‖ 대표/NNG/null/1/1/6/8 ‖ 적인/EOJEOL/null/1/1/8/10, 적/XSN/null/0/1/8/9 ‖ 복합/NNG/null/1/1/11/13 ‖ 명사이다/EOJEOL/null/1/1/13/17, 명사/NNG/null/0/1/13/15'),
    ('standard', 1, True, '아질산나트륨⟨NNG Compound =아/NNG/*+질산/NNG/*+나트륨/NNG/*⟩ 이란⟨JX⟩ 무엇⟨NP⟩ 인가요⟨VCP+EF Inflect VCP→EF =이/VCP/*+ㄴ가요/EF/*⟩ ?⟨SF⟩',
     '아/NNG/null/1/1/0/1, 아질산나트륨이란/EOJEOL/null/0/3/0/8, 아질산나트륨/COMPOUND/null/0/3/0/6, 아질산/COMPOUND/null/0/2/0/3, 질산/NNG/null/1/1/1/3, 질산나트륨/COMPOUND/null/0/2/1/6, 나트륨/NNG/null/1/1/3/6 ‖ 무엇인가요/EOJEOL/null/1/1/8/13, 무엇/NP/null/0/1/8/10'),
    ('standard', 4, True, '나⟨NP⟩ 의⟨JKG⟩ 무궁화⟨NNG Compound =무궁/NNG/*+화/NNG/*⟩ 꽃⟨NNG⟩ 을⟨JKO⟩ 보⟨VV⟩ 아라⟨EF⟩ .⟨SF⟩',
     '나의/EOJEOL/null/1/1/0/2, 나/NP/null/0/1/0/1 ‖ 무궁화/COMPOUND/null/1/2/2/5 ‖ 꽃을/EOJEOL/null/1/1/5/7, 꽃/NNG/null/0/1/5/6 ‖ 보아라/EOJEOL/null/1/1/7/10, 보/VV/null/0/1/7/8'),
    ('standard', 2, True, '영어⟨NNG⟩ (⟨SSO⟩ english⟨SL⟩ )⟨SSC⟩ 를⟨JKO⟩ study⟨SL⟩ 하⟨XSV⟩ 는⟨ETM⟩ 것⟨NNB⟩ 은⟨JX⟩ 어렵⟨VA⟩ 다⟨EF⟩ .⟨SF⟩',
     '영어/NNG/null/1/1/0/2 ‖ english/SL/null/1/1/3/10 ‖ 를/J/null/1/1/11/12 ‖ study/SL/null/1/1/12/17 ‖ 하는/EOJEOL/null/1/1/17/19 ‖ 것은/EOJEOL/null/1/1/19/21, 것/NNB/null/0/1/19/20 ‖ 어렵다/EOJEOL/null/1/1/21/24, 어렵/VA/null/0/1/21/23'),
    ('standard', 4, True, '은전한닢⟨NNG+NR+NNG Preanalysis NNG→NR =은전/NNG/*+한/NR/*+닢/NNG/*⟩',
     '은전/NNG/null/1/1/0/2 ‖ 한/NR/null/1/1/2/3 ‖ 닢/NNG/null/1/1/3/4'),
    ('standard', 4, True, '은전한닢⟨NNG+NR+NNG Preanalysis NNG→NR =은전/NNG/*+한/NR/*+닢/NNG/*⟩ 은⟨JX⟩ 오픈⟨NNG⟩ 소스⟨NNG⟩ 이⟨VCP⟩ 다⟨EF⟩',
     '은전/NNG/null/1/1/0/2 ‖ 한/NR/null/1/1/2/3 ‖ 닢은/EOJEOL/null/1/1/3/5, 닢/NNG/null/0/1/3/4 ‖ 오픈/NNG/null/1/1/5/7 ‖ 소스이다/EOJEOL/null/1/1/7/11, 소스/NNG/null/0/1/7/9'),
    ('standard', 4, True, '걀꿀⟨UNKNOWN⟩ ␣없⟨VA⟩ 는⟨ETM⟩ ␣단어⟨NNG⟩',
     '걀꿀/UNKNOWN/null/1/1/0/2 ‖ 없는/EOJEOL/null/1/1/3/5, 없/VA/null/0/1/3/4 ‖ 단어/NNG/null/1/1/6/8'),
    ('standard', 3, True, '!@#$%^&*()⟨SY⟩',
     '∅ (no token)'),
    ('standard', 4, True, '의대⟨NNG⟩ 생⟨XSN⟩',
     '의대/NNG/null/1/1/0/2 ‖ 생/XSN/null/1/1/2/3'),
    ('standard', 4, True, '공대⟨NNG⟩ 생⟨XSN⟩ 은⟨JX⟩ ␣바쁘⟨VA⟩ 다⟨EF⟩',
     '공대/NNG/null/1/1/0/2 ‖ 생은/EOJEOL/null/1/1/2/4, 생/XSN/null/0/1/2/3 ‖ 바쁘다/EOJEOL/null/1/1/5/8, 바쁘/VA/null/0/1/5/7'),
    ('standard', 4, True, '왕⟨XPN⟩ 게임⟨NNG⟩',
     '왕/XPN/null/1/1/0/1, 왕게임/COMPOUND/null/0/2/0/3, 게임/NNG/null/1/1/1/3'),
    ('standard', 4, True, '비⟨XPN⟩ 정상⟨NNG⟩',
     '비정상/NNG/null/1/1/0/3'),
    ('standard', 4, True, '너⟨NP⟩ 는⟨JX⟩ 비⟨XPN⟩ 정상⟨NNG⟩ 이⟨VCP⟩ 다⟨EF⟩',
     '너는/EOJEOL/null/1/1/0/2, 너/NP/null/0/1/0/1 ‖ 비정상이다/EOJEOL/null/1/1/2/7, 비정상/NNG/null/0/1/2/5'),
    ('standard', 4, True, '그것⟨NP⟩ 은⟨JX⟩ 어려운⟨VA+ETM Inflect VA→ETM =어렵/VA/*+ᆫ/ETM/*⟩ 문제⟨NNG⟩ 다⟨VCP+EF Inflect VCP→EF =이/VCP/*+다/EF/*⟩ .⟨SF⟩',
     '그것은/EOJEOL/null/1/1/0/3, 그것/NP/null/0/1/0/2 ‖ 어려운/INFLECT/null/1/1/3/6, 어렵/VA/null/0/1/3/5 ‖ 문제다/EOJEOL/null/1/1/6/9, 문제/NNG/null/0/1/6/8'),
    ('standard', 4, True, '그것⟨NP⟩ 은⟨JX⟩ 어려워⟨VA+EF Inflect VA→EF =어렵/VA/*+어/EF/*⟩ 란⟨ETM⟩ 문제⟨NNG⟩ 다⟨VCP+EF Inflect VCP→EF =이/VCP/*+다/EF/*⟩ .⟨SF⟩',
     '그것은/EOJEOL/null/1/1/0/3, 그것/NP/null/0/1/0/2 ‖ 어려워란/EOJEOL/null/1/1/3/7, 어렵/VA/null/0/1/3/5 ‖ 문제다/EOJEOL/null/1/1/7/10, 문제/NNG/null/0/1/7/9'),
    ('standard', 4, True, '오빤⟨NNG+VCP+JX Inflect NNG→JX =오빠/NNG/*+이/VCP/*+ㄴ/JX/*⟩ 강남⟨NNP sem=지명⟩ 스타일⟨NNG⟩',
     '오빤/INFLECT/null/1/1/0/2, 오빠/NNG/null/0/1/0/2 ‖ 강남/NNP/지명/1/1/2/4 ‖ 스타일/NNG/null/1/1/4/7'),
    ('standard', 4, True, '남희석⟨NNP sem=인명⟩ 은⟨JX⟩ ␣충남⟨NNP sem=지명⟩ 사람⟨NNG⟩ 이⟨VCP⟩ 다⟨EF⟩ .⟨SF⟩',
     '남희석은/EOJEOL/null/1/1/0/4, 남희석/NNP/인명/0/1/0/3 ‖ 충남/NNP/지명/1/1/5/7 ‖ 사람이다/EOJEOL/null/1/1/7/11, 사람/NNG/null/0/1/7/9'),
    ('similarity', 9999, True, '진달래⟨NNG⟩ ␣꽃⟨NNG⟩ 이⟨JKS⟩ ␣피⟨VV⟩ 었⟨EP⟩ 습니다⟨EF⟩ .⟨SF⟩',
     '진달래/NNG/null/1/1/0/3 ‖ 꽃/NNG/null/1/1/4/5'),
    ('similarity', 9999, True, '삼성전자⟨NNP Compound =삼성/NNG/*+전자/NNG/*⟩ 는⟨JX⟩ ␣대표⟨NNG⟩ 적⟨XSN⟩ 인⟨VCP+ETM Inflect VCP→ETM =이/VCP/*+ㄴ/ETM/*⟩ ␣복합⟨NNG⟩ 명사⟨NNG⟩ 이⟨VCP⟩ 다⟨EF⟩ .⟨SF⟩',
     '삼성전자/COMPOUND/null/1/2/0/4 ‖ 대표적/EOJEOL/null/1/1/6/9 ‖ 복합/NNG/null/1/1/11/13 ‖ 명사/NNG/null/1/1/13/15'),
    ('similarity', 9999, True, '영어⟨NNG⟩ (⟨SSO⟩ english⟨SL⟩ )⟨SSC⟩ 를⟨JKO⟩ study⟨SL⟩ 하⟨XSV⟩ 는⟨ETM⟩ 것⟨NNB⟩ 은⟨JX⟩ 어렵⟨VA⟩ 다⟨EF⟩ .⟨SF⟩',
     '영어/NNG/null/1/1/0/2 ‖ english/SL/null/1/1/3/10 ‖ study/SL/null/1/1/12/17'),
    ('similarity', 9999, True, '아이폰⟨NNP⟩ 5⟨SN⟩ s⟨SL⟩ 를⟨JKO⟩ 32⟨SN⟩ GB⟨SL⟩ 로⟨JKB⟩ 구입⟨NNG⟩ 했⟨XSV+EP Inflect XSV→EP =하/XSV/*+았/EP/*⟩ 다⟨EF⟩ .⟨SF⟩ elasticsearch⟨SL⟩ 1⟨SN⟩ .⟨SY⟩ 4⟨SN⟩ .⟨SY⟩ 3⟨SN⟩ 릴리스⟨NNG⟩ 되⟨VV⟩ 었⟨EP⟩ 다⟨EF⟩ .⟨SF⟩',
     '아이폰/NNP/null/1/1/0/3 ‖ 5s/EOJEOL/null/1/1/3/5 ‖ 32GB/EOJEOL/null/1/1/6/10 ‖ 구입/NNG/null/1/1/11/13 ‖ elasticsearch1.4.3/EOJEOL/null/1/1/16/34 ‖ 릴리스/NNG/null/1/1/34/37'),
    ('keyword', 9999, True, '파란⟨VA+ETM Inflect VA→ETM =파랗/VA/*+ᆫ/ETM/*⟩ 진달래⟨NNG⟩ ␣꽃⟨NNG⟩ 이⟨JKS⟩ ␣피⟨VV⟩ 었⟨EP⟩ 습니다⟨EF⟩ .⟨SF⟩',
     '파란/INFLECT/null/1/1/0/2 ‖ 진달래/NNG/null/1/1/2/5 ‖ 꽃/NNG/null/1/1/6/7 ‖ 피었습니다/EOJEOL/null/1/1/9/14'),
    ('keyword', 9999, True, '훈민정음⟨NNP Compound =훈민/NNG/*+정음/NNG/*⟩ 은⟨JX⟩ 경건⟨XR⟩ 한⟨XSA+ETM Inflect XSA→ETM =하/XSA/*+ᆫ/ETM/*⟩ 글자⟨NNG Compound =글/NNG/*자/NNG/*⟩ 이⟨VCP⟩ 다⟨EF⟩ .⟨SF⟩',
     '훈민정음/COMPOUND/null/1/2/0/4 ‖ 경건/XR/null/1/1/5/7 ‖ 글자/COMPOUND/null/1/1/8/10'),
    ('keyword', 9999, True, '삼성전자⟨NNP Compound =삼성/NNG/*+전자/NNG/*⟩ 는⟨JX⟩ ␣대표⟨NNG⟩ 적⟨XSN⟩ 인⟨VCP+ETM Inflect VCP→ETM =이/VCP/*+ㄴ/ETM/*⟩ ␣복합⟨NNG⟩ 명사⟨NNG⟩ 이⟨VCP⟩ 다⟨EF⟩ .⟨SF⟩',
     '삼성전자/COMPOUND/null/1/2/0/4 ‖ 대표적/EOJEOL/null/1/1/6/9 ‖ 복합/NNG/null/1/1/11/13 ‖ 명사/NNG/null/1/1/13/15'),
    ('keyword', 9999, True, '영어⟨NNG⟩ (⟨SSO⟩ english⟨SL⟩ )⟨SSC⟩ 를⟨JKO⟩ study⟨SL⟩ 하⟨XSV⟩ 는⟨ETM⟩ 것⟨NNB⟩ 은⟨JX⟩ 어렵⟨VA⟩ 다⟨EF⟩ .⟨SF⟩',
     '영어/NNG/null/1/1/0/2 ‖ english/SL/null/1/1/3/10 ‖ study/SL/null/1/1/12/17 ‖ 것/NNB/null/1/1/19/20 ‖ 어렵다/EOJEOL/null/1/1/21/24'),
    ('keyword', 9999, True, '아이폰⟨NNP⟩ 5⟨SN⟩ s⟨SL⟩ 를⟨JKO⟩ 32⟨SN⟩ GB⟨SL⟩ 로⟨JKB⟩ 구입⟨NNG⟩ 했⟨XSV+EP Inflect XSV→EP =하/XSV/*+았/EP/*⟩ 다⟨EF⟩ .⟨SF⟩ elasticsearch⟨SL⟩ 1⟨SN⟩ .⟨SY⟩ 4⟨SN⟩ .⟨SY⟩ 3⟨SN⟩ 릴리스⟨NNG⟩ 되⟨VV⟩ 었⟨EP⟩ 다⟨EF⟩ .⟨SF⟩',
     '아이폰/NNP/null/1/1/0/3 ‖ 5/SN/null/1/1/3/4 ‖ s/SL/null/1/1/4/5 ‖ 32/SN/null/1/1/6/8 ‖ GB/SL/null/1/1/8/10 ‖ 구입/NNG/null/1/1/11/13 ‖ elasticsearch/SL/null/1/1/16/29 ‖ 1/SN/null/1/1/29/30 ‖ 4/SN/null/1/1/31/32 ‖ 3/SN/null/1/1/33/34 ‖ 릴리스/NNG/null/1/1/34/37 ‖ 되었다/EOJEOL/null/1/1/37/40'),
]
_MORPHEME = re.compile(r"(␣?)(\S+?)⟨(\S+)(?: sem=(\S+))?(?: (Compound|Inflect|Preanalysis)(?: (\S+)→(\S+))? =(\S+))?⟩")


def morphemes(text: str) -> list[tuple]:
    """(seq, surface, tag, sem, kind, start_tag, end_tag, expr, space_len) rows."""
    return [(i, surface, tag, sem or None, kind or None, first or None, last or None, expr or None, len(space)) for i, (space, surface, tag, sem, kind, first, last, expr) in enumerate(_MORPHEME.findall(text))]


def tokens(text: str) -> list[tuple]:
    """(token_no, term, type, sem, pos_incr, pos_len, start_off, end_off) rows."""
    out = []
    for item in re.split(r" ‖ |, ", text) if "/" in text else []:
        surface, kind, sem, *numbers = item.rsplit("/", 6)
        out.append((len(out), f"{surface}/{kind}" if kind in ("VV", "VA") else surface, kind, None if sem == "null" else sem, *map(int, numbers)))
    return out
