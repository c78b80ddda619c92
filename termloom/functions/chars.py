"""Character classes and the types of strings, as Column builders and as Python twins.

The Python twins serve the Arrow functions of the stateful operators; the
Column builders stay inside the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHA, NUMBER, SYMBOL, HANGUL, HANGUL_JAMO = "ALPHA", "NUMBER", "SYMBOL", "HANGUL", "HANGUL_JAMO"
JAPANESE, CHINESE, OTHER, WHITESPACE, UNCATEGORIZED = "JAPANESE", "CHINESE", "OTHER_LANGUAGE", "WHITESPACE", "UNCATEGORIZED"
ALPHANUM, ASCII = "ALPHANUM", "ASCII"

# Regular expression classes of the character types. Java's white
# space leaves out the no-break spaces.
SPACE_CLASS = r"\t\n\x0B\f\r\x1C-\x1F   -  -    　"
CLASSES = {
    WHITESPACE: SPACE_CLASS,
    SYMBOL: r"\p{P}\p{S}",
    HANGUL: "가-힣",
    HANGUL_JAMO: r"ㄱ-ㆎ",
    JAPANESE: r"ぁ-ゖゟァ-ヺヿㇰ-ㇿ",
    CHINESE: r"㐀-䶿一-鿿豈-﫿",
    ALPHA: r"\p{Lu}\p{Ll}",
    NUMBER: r"\p{Nd}",
}
#: Symbols that may stay inside a model name, that connect its parts, and that may stand inside a number.
ALLOWED_SYMBOLS, CONNECTORS, NUMBER_SYMBOLS = "-./+&", "-./&", ",.:"
#: Thousands in groups or plain digits, decimal parts, at most one ratio.
NUMBER_PATTERN = r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)*(?::(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)*)?"
_NUMBER = re.compile(rf"{NUMBER_PATTERN}\Z")
_SPACES = {chr(c) for c in (*range(9, 14), *range(0x1C, 0x21), 0x1680, *range(0x2000, 0x2007), *range(0x2008, 0x200B), 0x2028, 0x2029, 0x205F, 0x3000)}


@lru_cache(1 << 16)
def type_of(ch: str) -> str:
    """The type of one character."""
    if ch in _SPACES:
        return WHITESPACE
    category = unicodedata.category(ch)
    if category[0] in "PS":
        return SYMBOL
    if category in ("Lu", "Ll"):
        return ALPHA
    if category == "Nd":
        return NUMBER
    if category == "Lo":
        c = ord(ch)
        if 0xAC00 <= c <= 0xD7AF:
            return HANGUL
        if 0x3130 <= c <= 0x318F:
            return HANGUL_JAMO
        if 0x3040 <= c <= 0x30FF or 0x31F0 <= c <= 0x31FF:
            return JAPANESE
        if 0x3400 <= c <= 0x4DBF or 0x4E00 <= c <= 0x9FFF or 0xF900 <= c <= 0xFAFF:
            return CHINESE
        return OTHER
    return UNCATEGORIZED


def runs_of(text: str) -> list[tuple[str, int, int]]:
    """(type, start, end) of the maximal runs of one type, without white space."""
    out: list[tuple[str, int, int]] = []
    at = 0
    while at < len(text):
        kind, end = type_of(text[at]), at + 1
        while end < len(text) and type_of(text[end]) == kind:
            end += 1
        if kind != WHITESPACE:
            out.append((kind, at, end))
        at = end
    return out


def uni_type_of(text: str) -> str:
    """The type all characters share; of a mixed string, that of its first run."""
    return type_of(text[0]) if text else UNCATEGORIZED


def _joined(left: str, right: str) -> str:
    if left == right:
        return left
    if {left, right} <= {ALPHA, NUMBER, ALPHANUM}:
        return ALPHANUM
    if left in (ALPHA, NUMBER, ALPHANUM, ASCII) and right in (ALPHA, NUMBER, SYMBOL):
        return ASCII
    return UNCATEGORIZED


def term_type_of(text: str) -> str:
    """One type, or ALPHANUM, or ASCII; a fold from the left, so that a leading symbol spoils it."""
    kind = ""
    for ch in text:
        kind = _joined(kind, type_of(ch)) if kind else type_of(ch)
        if kind == UNCATEGORIZED:
            break
    return kind or UNCATEGORIZED


def is_number(text: str) -> bool:
    return bool(_NUMBER.match(text))


def char_type(c: Column) -> Column:
    """Type of the first character of ``c``."""
    out = F.when(F.length(c) == 0, F.lit(None)).when(c.rlike(r"^\p{Lo}"), OTHER).otherwise(UNCATEGORIZED)
    for kind, cls in reversed(CLASSES.items()):
        out = F.when(c.rlike(f"^[{cls}]"), kind).otherwise(out)
    return out


def uni_type(c: Column) -> Column:
    return char_type(c)


def term_type(c: Column) -> Column:
    """``term_type_of`` in the JVM: each outcome of the fold is a regular language."""
    out = F.lit(UNCATEGORIZED)
    an = r"\p{Lu}\p{Ll}\p{Nd}"
    out = F.when(c.rlike(rf"^[{an}]+[\p{{P}}\p{{S}}][{an}\p{{P}}\p{{S}}]*$"), ASCII).otherwise(out)
    out = F.when(c.rlike(rf"^[{an}]+$"), ALPHANUM).otherwise(out)
    out = F.when(c.rlike(r"^[\p{Lo}&&[^가-힣ㄱ-ㆎぁ-ゖゟァ-ヺヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿]]+$"), OTHER).otherwise(out)
    for kind, cls in CLASSES.items():
        out = F.when(c.rlike(f"^[{cls}]+$"), kind).otherwise(out)
    return out


def is_alnum(c: Column) -> Column:
    """ASCII letters and digits only, at least one."""
    return c.rlike("^[A-Za-z0-9]+$")


def is_number_col(c: Column) -> Column:
    return c.rlike(f"^{NUMBER_PATTERN}$")


def fold(c: Column) -> Column:
    """The key of a case-insensitive dictionary: ASCII letters in upper case, all others as they are."""
    return F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


_FOLD = {i: i - 32 for i in range(ord("a"), ord("z") + 1)}


def folded(text: str) -> str:
    return text.upper() if text.isascii() else text.translate(_FOLD)


def strip_commas(c: Column) -> Column:
    """``1,024`` -> ``1024``."""
    return F.replace(c, F.lit(","), F.lit(""))


def without_spaces(c: Column) -> Column:
    """U+0020 goes; other white space stays."""
    return F.replace(c, F.lit(" "), F.lit(""))
