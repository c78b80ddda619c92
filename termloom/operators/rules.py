"""Product-name rules: numbers, units, model names, compounds and their sub-terms.

A product name is a list of spans over its text. Each stage is a function from
one list of spans to the next; nothing is changed in place. The words come from
``segment``; the dictionaries are a ``Dictionaries`` snapshot.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

from termloom.functions import chars
from termloom.operators import segment

FULL_STRING, HANGUL, ALPHA, NUMBER, NUMBER_TRANS, SYMBOL = "FULL_STRING", "HANGUL", "ALPHA", "NUMBER", "NUMBER_TRANS", "SYMBOL"
UNIT, UNIT_ALPHA, MODEL_NAME, COMPOUND, STOPWORD, UNCATEGORIZED = "UNIT", "UNIT_ALPHA", "MODEL_NAME", "COMPOUND", "STOPWORD", "UNCATEGORIZED"
FULL_STRING_BELOW, BUFFER, JOIN_MOST, UNIT_SPANS, UNIT_CHARS, LONG_NUMBER = 64, 1000, 10, 5, 10, 5
_TAG_TYPES = {"N": HANGUL, "DIGIT": NUMBER, "ALPHA": ALPHA, "SYMBOL": SYMBOL, "UNK": UNCATEGORIZED}


@dataclass(frozen=True)
class AnalyzerOptions:
    """Switches of the analyzer; query mode keeps sub-terms beside their term, index mode emits them as terms."""

    use_for_query: bool = False
    use_synonym: bool = True
    use_stopword: bool = True
    use_full_string: bool = False
    to_uppercase: bool = False

    @classmethod
    def filter_defaults(cls) -> AnalyzerOptions:
        return cls(use_for_query=True)


@dataclass
class Dictionaries:
    """A snapshot of all dictionaries; keys are folded to upper case (ASCII only)."""

    lexicon: dict[str, list[tuple[str, float]]] = field(default_factory=dict)
    user: set[str] = field(default_factory=set)
    stop: set[str] = field(default_factory=set)
    unit: set[str] = field(default_factory=set)
    synonym: dict[str, list[str]] = field(default_factory=dict)
    unit_synonym: dict[str, list[str]] = field(default_factory=dict)
    compound: dict[str, list[str]] = field(default_factory=dict)
    space: dict[str, list[str]] = field(default_factory=dict)

    def find(self, word: str) -> list[tuple[str, float]] | None:
        return self.lexicon.get(chars.folded(word))

    def known(self, word: str, query: bool) -> bool:
        """In the lexicon or the user's words; in query mode a compound too."""
        key = chars.folded(word)
        return key in self.lexicon or key in self.user or (query and key in self.compound)


class Span(NamedTuple):
    start: int
    end: int
    type: str
    fixed: bool = False
    parts: tuple[Span, ...] = ()
    synonyms: tuple[str, ...] = ()
    #: The term where it is not the text under the span.
    term: str | None = None

    def text(self, text: str) -> str:
        return text[self.start : self.end] if self.term is None else self.term


def _by_type(text: str, start: int, end: int) -> list[Span]:
    """One span per run of one character type."""
    return [Span(start + a, start + b, kind) for kind, a, b in chars.runs_of(text[start:end])]


def words(text: str, dicts: Dictionaries) -> list[Span]:
    """Stage 0: tagged words as spans; forced splits apart and closed to later joining."""
    out: list[Span] = []
    for start, end, tag, _ in segment.segment_text(text, dicts.find) if dicts.lexicon else [(a, b, None, 0) for _, a, b in chars.runs_of(text)]:
        if parts := dicts.space.get(chars.folded(text[start:end])):
            out += _split_at(parts, start, True)
            continue
        kind = _TAG_TYPES.get(tag or "", HANGUL) if tag else chars.type_of(text[start])
        if tag == "ALPHA" or kind in (UNCATEGORIZED,):
            key = text[start:end]
            out += [Span(start, end, HANGUL)] if chars.folded(key) in dicts.user else _by_type(text, start, end)
        else:
            out.append(Span(start, end, kind))
    return out


def _split_at(parts: list[str], start: int, fixed: bool) -> list[Span]:
    out = []
    for part in parts:
        out.append(Span(start, start + len(part), HANGUL, fixed))
        start += len(part)
    return out


def _bounded(text: str, start: int, end: int) -> bool:
    """Whether [start, end) ends at white space or at a change of character type on both sides."""
    left = start == 0 or chars.type_of(text[start - 1]) != chars.type_of(text[start])
    right = end == len(text) or chars.type_of(text[end]) != chars.type_of(text[end - 1])
    return left and right


def join_words(text: str, spans: list[Span], dicts: Dictionaries, query: bool) -> list[Span]:
    """Stage 1: adjoining spans that spell a dictionary word are one; the longest wins."""
    out: list[Span] = []
    at = 0
    while at < len(spans):
        taken = 0
        if not spans[at].fixed:
            reach = at
            while reach + 1 < len(spans) and reach - at < JOIN_MOST and spans[reach + 1].start == spans[reach].end and not spans[reach + 1].fixed:
                reach += 1
            for last in range(reach, at, -1):
                start, end = spans[at].start, spans[last].end
                key = chars.folded(text[start:end])
                if not _bounded(text, start, end):
                    continue
                if key in dicts.space:
                    out += _split_at(dicts.space[key], start, True)
                elif key in dicts.stop:
                    out.append(Span(start, end, HANGUL, True))
                elif dicts.known(key, query):
                    out.append(Span(start, end, HANGUL))
                else:
                    continue
                taken = last - at + 1
                break
        if not taken:
            out.append(spans[at])
            taken = 1
        at += taken
    return [part for i, s in enumerate(out) for part in _retyped(text, s, out[i - 1] if i else None, out[i + 1] if i + 1 < len(out) else None, dicts)]


def _retyped(text: str, span: Span, before: Span | None, after: Span | None, dicts: Dictionaries) -> list[Span]:
    """A dictionary word that is a number with its unit as two spans; a short one by its characters."""
    if span.type != HANGUL or span.fixed:
        return [span]
    own = span.text(text)
    if chars.type_of(own[0]) == NUMBER:
        n = next((i for i, c in enumerate(own) if chars.type_of(c) != NUMBER and c not in chars.NUMBER_SYMBOLS), len(own))
        if chars.folded(own[n:]) in dicts.unit:
            kind = NUMBER if own[:n].isdigit() else NUMBER_TRANS
            return [Span(span.start, span.start + n, kind), Span(span.start + n, span.end, chars.term_type_of(own[n:]))]
        return [span]
    if len(own) > 3 or chars.folded(own) in dicts.user:
        return [span]
    if own.isascii() and own.isalnum():
        near = (ALPHA, NUMBER, SYMBOL)
        if (before and before.end == span.start and before.type in near) or (after and after.start == span.end and after.type in near):
            return _by_type(text, span.start, span.end)
        return [span]
    kind = chars.term_type_of(own)
    return [span._replace(type={ALPHA: ALPHA, NUMBER: NUMBER, chars.ASCII: MODEL_NAME, chars.ALPHANUM: MODEL_NAME}.get(kind, span.type))]


def numbers(text: str, spans: list[Span]) -> list[Span]:
    """Stage 2: grouped, decimal and ratio numbers are one; so are adjoining letters, digits, and mixed kana and Chinese."""
    out: list[Span] = []
    for span in spans:
        if len(out) > 1 and span.type == NUMBER and out[-1].type == SYMBOL and out[-2].type in (NUMBER, NUMBER_TRANS):
            a, mark = out[-2], out[-1]
            joined = text[a.start : span.end]
            if mark.end - mark.start == 1 and text[mark.start] in chars.NUMBER_SYMBOLS and a.end == mark.start and mark.end == span.start and chars.is_number(joined):
                out[-2:] = [Span(a.start, span.end, NUMBER_TRANS)]
                continue
        if out and out[-1].end == span.start and not (out[-1].fixed or span.fixed):
            pair = (out[-1].type, span.type)
            eastern = set(pair) <= {chars.JAPANESE, chars.CHINESE} and chars.JAPANESE in pair
            if pair in ((ALPHA, ALPHA), (NUMBER, NUMBER)) or eastern:
                out[-1] = Span(out[-1].start, span.end, chars.JAPANESE if eastern else span.type)
                continue
        out.append(span)
    return out


def _unit_after(text: str, spans: list[Span], at: int, dicts: Dictionaries) -> tuple[int, int] | None:
    """(spans used, characters) of the longest unit that follows the number at ``at``."""
    start = spans[at].end
    usable = [i for i in range(at + 1, min(at + 1 + UNIT_SPANS, len(spans)))]
    for last in reversed(usable):
        if spans[at + 1].start != start or any(spans[i].start != spans[i - 1].end for i in range(at + 1, last + 1)):
            continue
        if last > at + 1 and spans[last].type == HANGUL:
            continue
        candidate = chars.folded(text[start : spans[last].end])
        if len(candidate) > UNIT_CHARS:
            continue
        shrinks = chars.uni_type_of(candidate) in (ALPHA, SYMBOL)
        least = spans[last].start - start  # a shorter unit is found with fewer spans
        for n in range(len(candidate), least if shrinks else len(candidate) - 1, -1):
            if candidate[:n] in dicts.unit:
                return last - at, n
    return None


def units(text: str, spans: list[Span], dicts: Dictionaries, query: bool) -> list[Span]:
    """Stage 3: a number and the unit after it are one span, with the bare number below it."""
    out: list[Span] = []
    at = 0
    while at < len(spans):
        span = spans[at]
        found = _unit_after(text, spans, at, dicts) if span.type in (NUMBER, NUMBER_TRANS) and not span.fixed else None
        if not found:
            out.append(span)
            at += 1
            continue
        used, n = found
        unit, end = text[span.end : span.end + n], span.end + n
        whole = spans[at + used].end
        alpha = chars.uni_type_of(unit) == ALPHA
        adjoins = bool(out) and out[-1].end == span.start
        letter_before = adjoins and chars.type_of(text[span.start - 1]) == ALPHA
        if letter_before and text[span.start - 1] in "xX" and len(out) > 1 and out[-1].end - out[-1].start == 1 and out[-2].end == out[-1].start and out[-2].type in (NUMBER, NUMBER_TRANS, UNIT, UNIT_ALPHA):
            letter_before = False
        after_unit = bool(out) and out[-1].type in (UNIT, UNIT_ALPHA)
        if end == whole:
            is_unit = not (letter_before and alpha) or (alpha and after_unit)
        else:  # the unit ends inside a word
            next_digit = at + used + 1 < len(spans) and spans[at + used + 1].start == whole and chars.type_of(text[whole]) == NUMBER
            letters = letter_before or chars.type_of(text[end]) == ALPHA
            is_unit = not (alpha and letters) or (text[end] in "xX" and end + 1 == whole and next_digit)
        if not is_unit:
            out.append(span)
            at += 1
            continue
        bare = Span(span.start, span.end, NUMBER if span.type == NUMBER else NUMBER_TRANS)
        number = span.text(text)
        below = [bare]
        if "," in number:
            below.insert(0, Span(span.start, span.end, NUMBER, term=number.replace(",", "")))
        others = tuple(number + s for s in dicts.unit_synonym.get(chars.folded(unit), [])) if query else ()
        out.append(Span(span.start, end, UNIT_ALPHA if alpha else UNIT, parts=tuple(below), synonyms=others))
        at += used + 1
        if end < whole:
            out += _by_type(text, end, whole)
    return out


def _dimension_marks(text: str, spans: list[Span]) -> list[Span]:
    """The ``x`` between two measures goes, where the right one is a unit."""
    measures, out = (NUMBER, NUMBER_TRANS, UNIT, UNIT_ALPHA), []
    for i, s in enumerate(spans):
        if 0 < i < len(spans) - 1 and s.end - s.start == 1 and text[s.start] in "xX":
            a, b = spans[i - 1], spans[i + 1]
            lone = i < 2 or spans[i - 2].end != a.start or spans[i - 2].type not in (ALPHA, SYMBOL, NUMBER)
            if a.end == s.start and s.end == b.start and a.type in measures and b.type in (UNIT, UNIT_ALPHA) and lone:
                out.append(s._replace(type="SEPARATOR"))
                continue
        out.append(s)
    return out


def sub_terms(text: str, spans: list[Span], query: bool) -> list[Span]:
    """What a model name is found by: its runs and the pieces that connectors part.

    A piece of exactly two single characters stays whole; a later piece that
    opens with letters is a term itself; in index mode the runs on both sides
    of a connector join when they are of one type.
    """
    pieces: list[list[Span]] = [[]]
    for s in spans:
        if s.type == SYMBOL:
            pieces.append([])
        else:
            pieces[-1] += [s] if s.type in (UNIT, UNIT_ALPHA, HANGUL) else _by_type(text, s.start, s.end)
    pieces = [p for p in pieces if p]
    found: list[Span] = []
    for i, runs in enumerate(pieces):
        start, end = runs[0].start, runs[-1].end
        if len(runs) == 2 and all(r.end - r.start == 1 for r in runs):
            found.append(Span(start, end, MODEL_NAME))
        else:
            found += [r._replace(parts=()) for r in runs]
            if i and len(runs) > 2 and runs[0].type == ALPHA:
                found.append(Span(start, end, MODEL_NAME))
        if not query and i + 1 < len(pieces):
            left, right = runs[-1], pieces[i + 1][0]
            if left.type == right.type:
                found.append(Span(left.start, right.end, left.type, term=left.text(text) + right.text(text)))
    whole = (spans[0].start, spans[-1].end)
    unique = {(s.text(text), s.start): s for s in found if (s.start, s.end) != whole or s.term}
    return sorted(unique.values(), key=lambda s: (s.start, -(s.end - s.start)))


def models(text: str, spans: list[Span], query: bool) -> list[Span]:
    """Stage 4: letters, digits and connectors without space between them are a model name."""
    spans = _dimension_marks(text, spans)
    inside = (ALPHA, NUMBER, NUMBER_TRANS, MODEL_NAME)
    out: list[Span] = []
    at = 0
    while at < len(spans):
        s = spans[at]
        if s.fixed or s.type not in inside:
            out.append(s)
            at += 1
            continue
        last = at
        while last + 1 < len(spans):
            nxt = spans[last + 1]
            if nxt.start != spans[last].end or nxt.fixed:
                break
            if nxt.type in inside:
                last += 1
            elif nxt.type == SYMBOL and nxt.end - nxt.start == 1 and text[nxt.start] in chars.CONNECTORS:
                if last + 2 >= len(spans) or spans[last + 2].start != nxt.end or spans[last + 2].fixed or spans[last + 2].type not in inside:
                    break
                lone = spans[last].type in (NUMBER, NUMBER_TRANS) and spans[last + 2].type in (NUMBER, NUMBER_TRANS)
                if text[nxt.start] == "/" and lone and last == at:
                    break
                last += 2
            else:
                break
        group = spans[at : last + 1]
        if len(group) == 1:
            out.append(s)
        else:
            kinds = {g.type for g in group if g.type != SYMBOL}
            marked = any(g.type == SYMBOL for g in group)
            kind = MODEL_NAME if len(kinds) > 1 or marked else kinds.pop()
            out.append(Span(s.start, group[-1].end, kind, parts=tuple(sub_terms(text, group, query))))
        at = last + 1
    return out


def cleanup(text: str, spans: list[Span]) -> list[Span]:
    """Stage 5: what is left of symbols and separators goes; a number of five digits and more is a model."""
    out = []
    for s in spans:
        if s.type in (SYMBOL, "SEPARATOR") or s.start == s.end:
            continue
        if s.type == NUMBER and s.end - s.start >= LONG_NUMBER:
            s = s._replace(type=MODEL_NAME)
        out.append(s)
    return out


def compounds(text: str, spans: list[Span], dicts: Dictionaries, query: bool) -> list[Span]:
    """Index mode: the parts of a compound word below it."""
    if query:
        return spans
    out = []
    for s in spans:
        parts = dicts.compound.get(chars.folded(s.text(text)))
        if parts:
            s = s._replace(type=COMPOUND, parts=s.parts + tuple(Span(s.start, s.end, HANGUL, term=p) for p in parts))
        out.append(s)
    return out


def analyse(text: str, dicts: Dictionaries, options: AnalyzerOptions, full: bool = True) -> list[Span]:
    """All stages; ``full`` also joins dictionary words and lists sub-terms."""
    query = options.use_for_query
    spans = words(text, dicts)
    if len(spans) == 1 and spans[0].type == SYMBOL:
        return []
    if full:
        spans = join_words(text, spans, dicts, query)
    spans = models(text, units(text, numbers(text, spans), dicts, query), query)
    spans = compounds(text, cleanup(text, spans), dicts, query)
    return spans if full else [s._replace(parts=()) for s in spans]


def reanalysed(synonym: str, dicts: Dictionaries) -> str:
    """A synonym as its own tokens, joined by spaces."""
    plain = AnalyzerOptions(use_synonym=False)
    return " ".join(s.text(w) for w in synonym.split(" ") if w for s in analyse(w, dicts, plain, full=False))


def _final_type(kind: str) -> str:
    return {UNIT_ALPHA: UNIT, NUMBER_TRANS: NUMBER}.get(kind, kind or UNCATEGORIZED)


def terms(text: str, dicts: Dictionaries, options: AnalyzerOptions, memo: dict[str, str] | None = None) -> list[tuple]:
    """Emitted rows: (term, type, pos_incr, start, end, is_stop, synonyms, extras)."""
    memo = {} if memo is None else memo
    query = options.use_for_query
    text = text.rstrip()
    shown = (lambda s: s.upper()) if options.to_uppercase else (lambda s: s)
    spans = analyse(text, dicts, options)

    def synonyms_of(term: str, again: bool) -> list[str]:
        if not options.use_synonym:
            return []
        out = []
        for s in dicts.synonym.get(chars.folded(term), []):
            if again:
                if s not in memo:
                    memo[s] = reanalysed(s, dicts)
                s = memo[s]
            out.append(s)
        return [s for s in dict.fromkeys(out) if s and s != term]

    rows: list[tuple] = []
    if query and options.use_full_string and 0 < len(text) < FULL_STRING_BELOW and text[:BUFFER].strip():
        sole = len(spans) == 1 and (spans[0].start, spans[0].end) == (0, len(text))
        if not sole:
            rows.append((shown(text), FULL_STRING, 1, 0, len(text), False, [shown(s) for s in synonyms_of(text, True)], []))
    for s in spans:
        term = s.text(text)
        stop = chars.folded(term) in dicts.stop
        kind = STOPWORD if stop else _final_type(s.type)
        parts = [p for p in s.parts if p.text(text) != term]
        if query:
            if stop and options.use_stopword:
                continue
            if s.type in (UNIT, UNIT_ALPHA):
                parts = [p for p in parts if p.type not in (NUMBER, NUMBER_TRANS)]
            found = [*synonyms_of(term, s.type not in (UNIT, UNIT_ALPHA)), *s.synonyms]
            extras = [(shown(p.text(text)), _final_type(p.type), [shown(x) for x in synonyms_of(p.text(text), False)]) for p in parts]
            rows.append((shown(term), kind, 1, s.start, s.end, stop, [shown(x) for x in dict.fromkeys(found)], extras))
            continue
        first = not (stop and options.use_stopword)
        if first:
            rows.append((shown(term), kind, 1, s.start, s.end, stop, [], []))
            rows += [(shown(x), "SYNONYM", 0, s.start, s.end, False, [], []) for x in s.synonyms]
        for p in parts:
            rows.append((shown(p.text(text)), _final_type(p.type), 0 if first else 1, p.start, p.end, False, [], []))
            first = True
    return rows
