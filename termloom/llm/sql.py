"""DuckDB SQL for those queries that SQL can express."""

from __future__ import annotations

from termloom.llm import quality, sharding, urls

_SPACE = r"[\x20\x09-\x0D]+"


def op1() -> str:
    """Placement by the filled table, given as a list: filling it by turns takes SQL minutes, so that has a test of its own."""
    return f"""
WITH shards AS (SELECT {[sharding.SHARDS[i] for i in sharding.lookup_table(sharding.SHARDS)]} AS by_slot)
SELECT doc_id, CAST(slot AS INTEGER) AS slot, by_slot[slot + 1] AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {sharding.SLOTS} AS slot FROM documents), shards"""


def op4() -> str:
    lists = " ".join(f"WHEN '{lang}' THEN [{', '.join(repr(w) for w in words)}]" for lang, words in quality.COMMON_WORDS.items())
    langs = ", ".join(f"'{lang}'" for lang in quality.COMMON_WORDS)
    classes = ["a-z", "A-Z", "0-9", r"\x20\x09-\x0D", r""".,;:!?''"()\-""", quality.SYMBOLS]
    counts = ", ".join(f"length(t) - length(regexp_replace(t, '[{c}]', '', 'g'))" for c in classes)
    slots = quality.SLOTS
    jsd = lambda p, q: f"""sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: (
      CASE WHEN z[1] > 0 THEN (z[1] / list_sum({p})) * log2((z[1] / list_sum({p})) / ((z[1] / list_sum({p}) + z[2] / list_sum({q})) / 2)) ELSE 0 END
      + CASE WHEN z[2] > 0 THEN (z[2] / list_sum({q})) * log2((z[2] / list_sum({q})) / ((z[1] / list_sum({p}) + z[2] / list_sum({q})) / 2)) ELSE 0 END))) / 2))"""  # noqa: E731
    sums = lambda c, n: "[" + ", ".join(f"sum({c}[{k + 1}])::BIGINT" for k in range(n)) + "]"
    return rf"""
WITH base AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    CASE lang {lists} END AS common
  FROM documents),
windows AS (SELECT b.rowid_ AS r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS v FROM (SELECT row_number() OVER () AS rowid_, w FROM base) b, range(1, len(w) - 1) g(i)),
numbered AS (SELECT row_number() OVER () AS r, * FROM base),
places AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, v) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, sum(least(3, i - coalesce(before, -3)))::BIGINT AS n FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM places) GROUP BY r),
feats AS (
  SELECT r, doc_id, lang, len(w)::BIGINT AS n_words, [{counts}] AS cls, length(t) AS chars, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    list_transform(w, lambda x: lower(rtrim(x, '.,;:!?'))) AS low, common
  FROM numbered),
hist AS (
  SELECT *, list_concat(cls, [chars - list_sum(cls)::BIGINT]) AS cc,
    list_transform(range(1, {slots} + 1), lambda k: CASE WHEN k <= len(common) THEN len(list_filter(low, lambda x: x = common[k])) ELSE 0 END) AS wc0
  FROM feats),
full_hist AS (SELECT *, CASE WHEN common IS NOT NULL THEN list_concat(wc0, [n_words - list_sum(wc0)::BIGINT]) END AS wc FROM hist),
refs AS (SELECT lang, {sums("cc", 7)} AS rc, {sums("wc", slots + 1)} AS rw FROM full_hist WHERE lang IN ({langs}) GROUP BY lang),
judged AS (
  SELECT doc_id, n_words, (chars - cls[4])::BIGINT AS word_chars, cls[6]::BIGINT AS n_symbols, n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    n_words < {quality.LEAST_WORDS} OR 100 * coalesce(c.n, 0) > {quality.MOST_REPEATED} * n_words AS base_failed,
    CASE WHEN chars >= {quality.LEAST_CHARS} AND list_sum(rc) > 0 THEN {jsd("cc", "rc")} END AS char_distance,
    CASE WHEN n_words >= {quality.LEAST_HISTOGRAM_WORDS} AND list_sum(rw) > 0 THEN {jsd("wc", "rw")} END AS word_distance
  FROM full_hist f LEFT JOIN refs USING (lang) LEFT JOIN covered c USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(char_distance, 0) <= {quality.MOST_CHAR_DISTANCE}
    AND coalesce(word_distance, 0) <= {quality.MOST_WORD_DISTANCE} + {quality.CHANCE} / sqrt(greatest(n_words, 1)) AS kept
FROM judged"""


OP7 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW g AS (PARTITION BY t)"""


def op8() -> str:
    """Rules and score; the weights are those of the labelled table, as a list (learning them has a test of its own)."""
    rows = sorted(urls.labelled_urls())
    parts = [(u.partition("://")[2].partition("/")[0], "/" + u.partition("://")[2].partition("/")[2].partition("?")[0]) for u, _ in rows]
    weights, bias = urls.fit([(urls.grams_of(*p), label) for p, (_, label) in zip(parts, rows, strict=True)])
    lists = []
    for name, base in (("h", 0), ("p", 16)):
        for n in urls.SIZES:
            h = str(base + n)
            for k in range(n):
                h = f"({h}) * 257 + {name}[i + {k}]"
            lists.append(f"list_transform(range(1, greatest(1, len({name}) - {n} + 2)), lambda i: ({h}) % 65521 % {urls.BUCKETS})")
    buckets = lists[0]
    for more in lists[1:]:
        buckets = f"list_concat({buckets}, {more})"
    fits = [(r, v, *r.partition("/")[::2]) for r, v in sorted(urls.RULES, key=lambda r: -len(r[0]))]
    fits = [(r, v, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')") for r, v, h, p in fits]
    rule, says = (f"CASE {' '.join(f'WHEN {test} THEN {chr(39)}{x[k]}{chr(39)}' for *x, test in fits)} END" for k in (0, 1))
    return rf"""
WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
split AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS own FROM rest),
parts AS (SELECT page_id, translate(own, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(r, length(own) + 1), '^[^?#]*') AS path FROM split),
codes AS (SELECT *, list_transform(string_split('^' || host || '$', ''), lambda c: unicode(c)::BIGINT) AS h, CASE WHEN path = '' THEN []::BIGINT[] ELSE list_transform(string_split(path, ''), lambda c: unicode(c)::BIGINT) END AS p FROM parts),
told AS (SELECT *, {rule} AS rule, {says} AS says, list_distinct({buckets}) AS b FROM codes),
model AS (SELECT {weights} AS w),
scored AS (SELECT t.*, ({bias} + coalesce(list_sum(list_transform(b, lambda x: w[x + 1])), 0))::BIGINT AS score FROM told t, model)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN score > {urls.BLOCK_ABOVE} THEN 'block' ELSE 'allow' END) AS verdict, score FROM scored"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": op1(), "op4_quality": op4(), "op7_exact": OP7, "op8_urls": op8()}
