"""Hangul syllable arithmetic, as Column builders and as Python twins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE, LAST, MEDIALS, FINALS = 0xAC00, 0xD7A3, 21, 28
# Compatibility letters in syllable order.
INITIAL = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
MEDIAL = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FINAL = " ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
#: Particles that ask for a final consonant before them, and those that forbid it.
AFTER_FINAL, AFTER_VOWEL = frozenset("은이을과"), frozenset("는가를와")


def is_hangul(ch: str) -> bool:
    return BASE <= ord(ch) <= LAST


def split(ch: str) -> tuple[int, int, int]:
    """(initial, medial, final) numbers of a syllable; final 0: none."""
    n = ord(ch) - BASE
    return n // (MEDIALS * FINALS), n // FINALS % MEDIALS, n % FINALS


def combine(initial: int, medial: int, final: int = 0) -> str:
    return chr(BASE + (initial * MEDIALS + medial) * FINALS + final)


def decompose(text: str) -> str:
    """Syllables as letters; other characters as they are."""
    out = []
    for ch in text:
        if is_hangul(ch):
            i, m, f = split(ch)
            out.append(INITIAL[i] + MEDIAL[m] + (FINAL[f] if f else ""))
        else:
            out.append(ch)
    return "".join(out)


def has_final(ch: str) -> bool:
    return is_hangul(ch) and split(ch)[2] > 0


def particle_agrees(before: str, particle: str) -> bool:
    """Whether a particle may follow a word by its last sound."""
    if not before or not is_hangul(before[-1]):
        return True
    if particle in AFTER_FINAL:
        return has_final(before[-1])
    if particle in AFTER_VOWEL:
        return not has_final(before[-1])
    return True


def _number(c: Column) -> Column:
    return F.ascii(c) - F.lit(BASE)


def is_hangul_col(c: Column) -> Column:
    return c.rlike("^[가-힣]")


def initial(c: Column) -> Column:
    """First letter of the first syllable; null where it is none."""
    n = F.floor(_number(c) / (MEDIALS * FINALS)).cast("int")
    return F.when(is_hangul_col(c), F.substr(F.lit(INITIAL), n + 1, F.lit(1)))


def medial(c: Column) -> Column:
    n = (F.floor(_number(c) / FINALS) % MEDIALS).cast("int")
    return F.when(is_hangul_col(c), F.substr(F.lit(MEDIAL), n + 1, F.lit(1)))


def final_code(c: Column) -> Column:
    return F.when(is_hangul_col(c), (_number(c) % FINALS).cast("int"))


def final(c: Column) -> Column:
    """Last letter; empty where the syllable has none, null where it is no syllable."""
    return F.when(final_code(c) > 0, F.substr(F.lit(FINAL), final_code(c) + 1, F.lit(1))).when(final_code(c) == 0, F.lit(""))


def decompose_col(c: Column) -> Column:
    one = lambda x: F.when(is_hangul_col(x), F.concat(initial(x), medial(x), final(x))).otherwise(x)
    return F.array_join(F.transform(F.filter(F.split(c, ""), lambda x: x != ""), one), "")
