"""Operator 8: URL filter (native).

Block and allow rules come first: a rule fits its host and every subdomain of
it, where the path starts with the rule's; the longest wins. Other addresses
are judged by a logistic regression on hashed character n-grams of host and
path, trained from a small labelled URL table.

The n-gram hash is plain arithmetic on code points, the weights are whole
millionths and are applied as one literal array, so a score is a sum of whole
numbers and does not depend on order. Training reads the small table alone
(its size is fixed by the caller and checked); the judging of a table is a
projection, without a shuffle.

The default table is made from lists of words, as pairs and alone, on a domain
of its own; it has no host of any page. Held-out hosts are measured in the
tests.

Defined cases: a null address, or one without ``://``, has empty host and path,
and the model judges those as any other; addresses of any length are read
whole; an empty table gives an empty result; rows may repeat; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.bind import let

BUCKETS = 4096
SIZES = (3, 4)
MOST_LABELLED = 20_000
#: Score in millionths above which an address is blocked: even odds.
BLOCK_ABOVE = 0
#: (rule, verdict)
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]

_UNWANTED = """casino poker bets betting slots jackpot lottery win bonus roulette pills pharmacy viagra diet adult porn sex cams xxx escort
spam farm seo ads adserver click popunder track tracker loan loans payday cash crypto cheap free discount replica warez crack keygen torrent prizes
malware phish""".split()
_ORDINARY = """library museum weather city news history university research garden cooking recipes travel guide railway parliament court medicine
hospital school physics chemistry biology mathematics software docs handbook wiki archive journal letters theatre orchestra painting football cycling
mountain river farming bakery carpentry astronomy election economy nation north south other another thing together mother weekend winter window
teacher father bathroom within thread thunder eastern western reader street station letter country people water paper answer house number""".split()
_PATHS = ("/en/12", "/de/article/345.html", "/", "/fr/678?page=2", "/es/90?ref=x")


def labelled_urls() -> list[tuple[str, int]]:
    """The small table: addresses of unwanted (1) and ordinary (0) sites, words alone and joined to others of their list, on five paths."""
    rows = []
    for words, label in ((_UNWANTED, 1), (_ORDINARY, 0)):
        hosts = [*words, *(f"{w}-{words[(i + step) % len(words)]}" for step in (1, 3, 7) for i, w in enumerate(words))]
        if not label:
            hosts += [w + words[(i + 5) % len(words)] for i, w in enumerate(words)]
        for i, host in enumerate(hosts):
            sub, domain = ("", "www.", "blog.", "m.")[i % 4], ("com", "net", "org")[i % 3]
            rows.append((f"https://{sub}{host}.training.{domain}{_PATHS[i % 5]}", label))
    return rows


def split_url(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path) as the rules read them."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def grams(host: Column, path: Column) -> Column:
    """Buckets of the distinct n-grams of the host (marked at both ends) and of the path."""
    chars = lambda c: F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("long"))

    def part(c: Column, n: int, seed: int) -> Column:
        last = F.size(c) - n + 1
        at = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))

        def bucket(i: Column) -> Column:
            h = F.lit(seed).cast("long")
            for k in range(n):
                h = h * 257 + F.get(c, i + k)
            return F.pmod(h, F.lit(65521)) % BUCKETS

        return F.transform(at, bucket)

    def all_of(c: Column) -> Column:
        return F.concat(*[part(c["host"], n, n) for n in SIZES], *[part(c["path"], n, 16 + n) for n in SIZES])

    return F.array_distinct(let(F.struct(chars(F.concat(F.lit("^"), host, F.lit("$"))).alias("host"), chars(path).alias("path")), all_of))


def grams_of(host: str, path: str) -> list[int]:
    """``grams`` of one address, without Spark."""
    found = []
    for text, base in ((f"^{host}$", 0), (path, 16)):
        for n in SIZES:
            for at in range(len(text) - n + 1):
                h = base + n
                for c in text[at : at + n]:
                    h = h * 257 + ord(c)
                found.append(h % 65521 % BUCKETS)
    return list(dict.fromkeys(found))


def fit(rows: list[tuple[list[int], int]], steps: int = 400) -> tuple[list[int], int]:
    """(weights, bias) in millionths, from rows of buckets and label, by gradient steps from nothing; deterministic."""
    weights, bias = np.zeros(BUCKETS), 0.0
    y = np.array([label for _, label in rows], dtype=float)
    row = np.repeat(np.arange(len(rows)), [len(g) for g, _ in rows])
    col = np.array([b for g, _ in rows for b in g], dtype=np.int64)
    for _ in range(steps if rows else 0):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[col], len(rows)) + bias, -30, 30)))
        weights -= 0.5 * (np.bincount(col, (p - y)[row], BUCKETS) / len(rows) + 1e-4 * weights)
        bias -= 0.5 * (p - y).mean()
    return [round(w * 1e6) for w in weights.tolist()], round(bias * 1e6)


def train(labelled: DataFrame, steps: int = 400) -> tuple[list[int], int]:
    """(weights, bias) from a table (url, label) of at most MOST_LABELLED rows."""
    host, path = split_url(F.col("url"))
    rows = labelled.where("label in (0, 1)").select("url", grams(host, path).alias("g"), "label").orderBy("url", "label").limit(MOST_LABELLED + 1).collect()
    if len(rows) > MOST_LABELLED:
        raise ValueError(f"the labelled table has more than {MOST_LABELLED} rows")
    return fit([(r.g, r.label) for r in rows], steps)


def default_model(spark: SparkSession) -> tuple[list[int], int]:
    return train(spark.createDataFrame(labelled_urls(), "url string, label int"))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is asked first
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, model: tuple[list[int], int], rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score in millionths (a rule's verdict stands whatever the score)."""
    weights, bias = model
    host, path = split_url(F.col("url"))
    rule, says = fitting_rule(F.col("host"), F.col("path"), RULES if rules is None else rules)
    parts = pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "_says": says})
    table = F.array(*[F.lit(w) for w in weights]) if len(weights) <= 64 else F.from_json(F.lit(str(weights)), "array<bigint>")
    total = F.aggregate(grams(F.col("host"), F.col("path")), F.lit(bias).cast("long"), lambda s, b: s + F.get(F.col("_w"), b.cast("int")))
    scored = parts.withColumn("_w", table).withColumn("score", total)
    model_says = F.when(F.col("score") > BLOCK_ABOVE, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("_says", model_says).alias("verdict"), "score")
