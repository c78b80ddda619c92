"""Boolean text queries: building, JSON and explain forms, execution, paging and highlighting.

A query is a small tree on the driver; execution turns it into one predicate
over the array of a row's terms. A search so is a scan with a filter: no
shuffle, no join, at any size. Only a sorted page moves rows, and of each
task no more than the page needs.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import chars
from termloom.operators import tokens


@dataclass(frozen=True)
class Term:
    word: str


@dataclass(frozen=True)
class And:
    of: tuple


@dataclass(frozen=True)
class Or:
    of: tuple


def phrase(text: str) -> Term | And:
    """A word, or all of the words of a spaced synonym."""
    found = tuple(Term(w) for w in text.split(" ") if w)
    return found[0] if len(found) == 1 else And(found)


def _one_of(word: str, synonyms: list[str], *more) -> Term | Or:
    other = [phrase(s) for s in dict.fromkeys(synonyms) if s.strip() and s != word]
    found = tuple([Term(word), *other, *more])
    return found[0] if len(found) == 1 else Or(found)


def build(rows: list[tuple]) -> And:
    """All emitted rows of a query-mode analysis; each may be met by a synonym or by all of its sub-terms."""
    clauses = []
    for term, kind, _, _, _, _, synonyms, extras in rows:
        if kind == "FULL_STRING":
            continue
        sub = And(tuple(_one_of(t, s) for t, _, s in extras)) if extras else None
        clauses.append(_one_of(term, synonyms, *([sub] if sub else [])))
    return And(tuple(clauses))


def terms_of(node) -> list[str]:
    """Distinct words of a query, sorted: what a highlighter marks."""
    found = {node.word} if isinstance(node, Term) else {w for x in node.of for w in terms_of(x)}
    return sorted(found)


def to_json(node, fields: dict[str, float], analyzer: str = "whitespace") -> dict:
    """The query in the host search server's JSON form."""
    if isinstance(node, Term):
        shown = [f if b == 1.0 else f"{f}^{b:g}" for f, b in fields.items()]
        return {"multi_match": {"query": node.word, "fields": shown, "analyzer": analyzer}}
    return {"bool": {"must" if isinstance(node, And) else "should": [to_json(x, fields, analyzer) for x in node.of]}}


def explain(node) -> dict | str:
    return node.word if isinstance(node, Term) else {"AND" if isinstance(node, And) else "OR": [explain(x) for x in node.of]}


def fields_with_boosts(spec: str) -> dict[str, float]:
    """``f1^2,f2`` -> boosts; one that is not a number counts as 1."""
    out = {}
    for part in filter(None, (p.strip() for p in spec.split(","))):
        name, _, boost = part.partition("^")
        try:
            out[name] = float(boost) if boost else 1.0
        except ValueError:
            out[name] = 1.0
    return out


def predicate(node, terms: Column) -> Column:
    """The query over an array of folded terms; an empty AND meets everything."""
    if isinstance(node, Term):
        return F.array_contains(terms, chars.folded(node.word))
    each = [predicate(x, terms) for x in node.of]
    if not each:
        return F.lit(isinstance(node, And))
    return reduce((lambda a, b: a & b) if isinstance(node, And) else (lambda a, b: a | b), each)


def field_terms(*fields: str) -> Column:
    """Folded terms of a row's fields."""
    return tokens.words(chars.fold(F.concat_ws(" ", *fields)))


def search(df: DataFrame, node, *fields: str) -> DataFrame:
    """Rows that meet the query; the texts are split once a row."""
    return df.withColumn("_terms", field_terms(*fields)).where(predicate(node, F.col("_terms"))).drop("_terms")


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def page(df: DataFrame, order: list[Column], start: int = 0, size: int = 20, echo: list[str] | None = None) -> DataFrame:
    """One page of sorted rows with ``_rownum`` from ``start``; a size of -1: all that follow.

    With ``echo`` (the names sorted by) each row has their values as ``_sort``.
    """
    if echo:
        df = df.withColumn("_sort", F.array(*[F.col(c).cast("string") for c in echo]))
    if size >= 0:
        found = df.orderBy(*order).offset(start).limit(size)
        return found.withColumn("_rownum", F.row_number().over(Window.orderBy(*order)) - 1 + start)
    # All rows are numbered by ranges: a task sorts one range, and the driver sees one count for each.
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).persist()
    before, total = {}, 0
    for r in ranged.groupBy("_part").count().orderBy("_part").collect():
        before[r["_part"]], total = total, total + r["count"]
    skipped = F.element_at(F.create_map(*[F.lit(x) for kv in (before or {0: 0}).items() for x in kv]), F.col("_part"))
    numbered = ranged.withColumn("_rownum", (F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + skipped).cast("int"))
    return numbered.where(F.col("_rownum") >= start).drop("_part")


def act(df: DataFrame, node, fields: str, *, base: dict | None = None, sort: list | None = None, start: int = 0, size: int = 20, marked: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, dict | str]:
    """(page, total, explanation) of a search: the query and a base query in JSON, counted, sorted, paged and highlighted."""
    found = search(df, node, *fields_with_boosts(fields))
    if base:
        found = found.where(parse_dsl(base))
    order = parse_sort(sort) if sort else [F.monotonically_increasing_id()]
    names = [n for item in sort or [] for n in (item if isinstance(item, dict) else [item])]
    rows = page(found, order, start, size, names)
    for c in marked:
        rows = rows.withColumn(f"{c}_marked", highlight(F.col(c), terms_of(node)))
    return rows, total(found), explain(node)


def parse_sort(spec: list) -> list[Column]:
    """``["a", {"b": "desc"}, {"c": {"order": "asc"}}]`` as sort columns."""
    out = []
    for item in spec if isinstance(spec, list) else [spec]:
        for name, how in (item.items() if isinstance(item, dict) else [(item, "asc")]):
            order = how.get("order", "asc") if isinstance(how, dict) else how
            out.append(F.desc(name) if str(order).lower() == "desc" else F.asc(name))
    return out


def highlight(text: Column, words: list[str], before: str = "<b>", after: str = "</b>") -> Column:
    """``text`` with HTML escaped and each whole word of ``words`` between the tags, whatever its case."""
    safe = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")], text)
    if not words:
        return safe
    some = "|".join(rf"\Q{w}\E" for w in sorted(words, key=lambda w: (-len(w), w)))
    return F.regexp_replace(safe, rf"(?i)(?<![\p{{L}}\p{{Nd}}])({some})(?![\p{{L}}\p{{Nd}}])", f"{before}$1{after}")


def _match(field: str, text: str, every: bool = False) -> Column:
    found = tuple(Term(w) for w in str(text).split())
    return predicate(And(found) if every else Or(found), field_terms(field))


def _text_query(body: dict) -> Column:
    """``a AND b``, ``a OR b``, ``-c`` over the named fields; words alone follow the default operator."""
    fields = list(fields_with_boosts(",".join(body.get("fields") or [body.get("default_field", "text")])))
    every = str(body.get("default_operator", "or")).lower() == "and"
    must, some, none, joint = [], [], [], False
    for w in body["query"].split():
        if w in ("AND", "OR"):
            joint = w == "AND"
            if joint and some:
                must.append(some.pop())
            continue
        (none if w[0] == "-" else must if w[0] == "+" or joint or every else some).append(Term(w.lstrip("+-")))
        joint = False
    tree = And(tuple(must + ([Or(tuple(some))] if some and not must else [])))
    out = predicate(tree, field_terms(*fields))
    return out & ~predicate(Or(tuple(none)), field_terms(*fields)) if none else out


def parse_dsl(query: dict) -> Column:
    """A JSON query as a predicate over columns; scores and boosts do not select rows."""
    (kind, body), = query.items()
    if kind in ("query_string", "simple_query_string"):
        return _text_query(body)
    if kind == "multi_match":
        found = [_match(f, body["query"], str(body.get("operator", "or")).lower() == "and") for f in fields_with_boosts(",".join(body["fields"]))]
        return reduce(lambda a, b: a | b, found)
    if kind == "wrapper":
        return parse_dsl(json.loads(base64.b64decode(body["query"])))
    if kind == "function_score":
        return parse_dsl(body["query"])
    if kind == "boosting":
        return parse_dsl(body["positive"])
    if kind == "bool":
        lists = {k: [parse_dsl(q) for q in (v if isinstance(v, list) else [v])] for k, v in body.items() if k in ("must", "filter", "should", "must_not")}
        out = F.lit(True)
        for c in lists.get("must", []) + lists.get("filter", []):
            out = out & c
        for c in lists.get("must_not", []):
            out = out & ~F.coalesce(c, F.lit(False))
        least = int(body.get("minimum_should_match", 0 if lists.get("must") or lists.get("filter") else 1))
        if lists.get("should") and least:
            met = reduce(lambda a, b: a + b, [F.coalesce(c.cast("int"), F.lit(0)) for c in lists["should"]])
            out = out & (met >= least)
        return out
    (field, value), = ((k, v) for k, v in body.items() if k != "boost")
    if kind == "match":
        spec = value if isinstance(value, dict) else {"query": value}
        return _match(field, spec["query"], str(spec.get("operator", "or")).lower() == "and")
    if kind == "match_phrase":
        text = value["query"] if isinstance(value, dict) else value
        whole = F.concat(F.lit(" "), F.array_join(field_terms(field), " "), F.lit(" "))
        return F.contains(whole, F.lit(" " + " ".join(chars.folded(text).split()) + " "))
    if kind == "term":
        return F.col(field) == (value["value"] if isinstance(value, dict) else value)
    if kind == "terms":
        return F.col(field).isin(*value)
    if kind == "terms_set":
        met = reduce(lambda a, b: a + b, [predicate(Term(t), field_terms(field)).cast("int") for t in value["terms"]])
        return met >= F.col(value["minimum_should_match_field"]) if "minimum_should_match_field" in value else met >= len(value["terms"])
    if kind == "range":
        col, out = F.col(field), F.lit(True)
        for op, test in (("gte", col.__ge__), ("gt", col.__gt__), ("lte", col.__le__), ("lt", col.__lt__)):
            if op in value:
                out = out & test(F.lit(value[op]))
        return out
    raise ValueError(f"unknown query type {kind!r}")
