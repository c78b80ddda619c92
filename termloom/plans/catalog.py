"""The registered queries of the text-analysis operators and their DuckDB SQL.

Dictionaries of the queries are small literals, named below, so that both
engines read the same ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import chars, hangul
from termloom.operators import administration, dictionary, large, morph, product, search, segment, tokens
from termloom.operators.rules import AnalyzerOptions
from termloom.operators.search import And, Or, Term
from termloom.plans import goldens
from termloom.sources import tagged

STOP = ["the", "and", "of", "die", "der", "la", "le", "de"]
SYNONYMS = [("SYNONYM", None, "widget,gadget", None), ("SYNONYM", "cold", "icy,frosty", None), ("SYNONYM", "hot", "warm spell", None)]
COMPOUNDS = [("COMPOUND", "widget", "wid,get", None), ("COMPOUND", "gizmo", "giz,mo", None)]
SPACES = [("SPACE", "Brand 13", None, None), ("SPACE", "large bolt", None, None)]
SOURCE_ROWS = SYNONYMS + COMPOUNDS + SPACES + [("STOP", w, None, None) for w in STOP] + [("UNIT", u, None, None) for u in ("GB", "CM", "MM", "GHZ", "V", "MA")]
LEXICON = ["# comment", "노트북\tN\t-9.5", "노트북\tNNG\t-8.5", "물\tN\t-5.0", "를\tJ\t-3.0", "가다\tV\t-7", "bad\tline", "x\tQ\t-1"]
SYLLABLES = ["가", "닭", "한", "글", "없", "A", "힣"]
TAGGED = ["[%ID%]1001[%NAME%]삼성 노트북 15인치[%REGISTERDATE%]20210401", "[%ID%]1002[%NAME%]a [b] c[%REGISTERDATE%]", "[%ID%]1003[%NAME%]x"]
NAMES = ["I7-4700MQ (2.4GHZ)", "120cmx60cm cold widget", "1A-B2C3D4", "the 1,024GB hot gizmo", "노트북 12345"]
MORPHEMES = [
    (1, 0, "진달래", "NNG", None, None, None, None, None, 0), (1, 1, "꽃", "NNG", None, None, None, None, None, 1), (1, 2, "이", "JKS", None, None, None, None, None, 0),
    (1, 3, "피", "VV", None, None, None, None, None, 1), (1, 4, "었", "EP", None, None, None, None, None, 0), (1, 5, "습니다", "EF", None, None, None, None, None, 0),
    (1, 6, ".", "SF", None, None, None, None, None, 0), (2, 0, "의대", "NNG", None, None, None, None, None, 0), (2, 1, "생", "XSN", None, None, None, None, None, 0),
    (2, 2, "은", "JX", None, None, None, None, None, 0), (2, 3, "바쁘", "VA", None, None, None, None, None, 1), (2, 4, "다", "EF", None, None, None, None, None, 0),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark: SparkSession, values: list, schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def _values(rows: list, names: str) -> str:
    q = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(q(v) for v in (r if isinstance(r, tuple) else (r,))) + ')' for r in rows)}) AS t({names})"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.top_terms(_table(spark, sf_dir, "documents"), "text", 100)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# DuckDB: runs of one type, and their type.
_SQL_SPACE = r"\t\n\x0B\f\r\x1C-\x20\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}"
_SQL_RUNS = rf"[\p{{P}}\p{{S}}]+|[\p{{Lu}}\p{{Ll}}]+|\p{{Nd}}+|\p{{Lo}}+|[^\p{{P}}\p{{S}}\p{{Lu}}\p{{Ll}}\p{{Nd}}\p{{Lo}}{_SQL_SPACE}]+"
_SQL_TYPE = r"CASE WHEN regexp_matches(term, '^[\p{P}\p{S}]') THEN 'SYMBOL' WHEN regexp_matches(term, '^[\p{Lu}\p{Ll}]') THEN 'ALPHA' WHEN regexp_matches(term, '^\p{Nd}') THEN 'NUMBER' WHEN regexp_matches(term, '^\p{Lo}') THEN 'OTHER_LANGUAGE' ELSE 'UNCATEGORIZED' END"
_SQL_TERMS = f"SELECT term, {_SQL_TYPE} AS type, count(*) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '{_SQL_RUNS}')) AS term FROM documents) GROUP BY term"
_WORDS = lambda c: rf"list_filter(string_split_regex(coalesce({c}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_UP = lambda c: f"translate({c}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_STOP_LIST = ", ".join(f"'{w}'" for w in STOP)


@_query("token_type_counts", f"SELECT type, sum(n)::BIGINT AS n_tokens, count(*) AS n_terms FROM ({_SQL_TERMS}) GROUP BY type")
def _(spark, d):
    return tokens.type_counts(_table(spark, d, "documents"), "text")


@_query("token_topk", f"SELECT term, type, n FROM ({_SQL_TERMS}) ORDER BY n DESC, encode(term) LIMIT 100")
def _(spark, d):
    return flagship(spark, d)


@_query("token_positions", f"""SELECT p_partkey, token_no::INTEGER AS token_no, term, {_SQL_TYPE} AS type
FROM (SELECT p_partkey, generate_subscripts(r, 1) - 1 AS token_no, unnest(r) AS term FROM (SELECT p_partkey, regexp_extract_all(p_brand || ' ' || p_name, '{_SQL_RUNS}') AS r FROM part))""")
def _(spark, d):
    return tokens.tokens(_table(spark, d, "part").withColumn("t", F.concat_ws(" ", "p_brand", "p_name")), "p_partkey", "t")


@_query("term_type_fold", rf"""SELECT type, count(*) AS n FROM (SELECT CASE WHEN regexp_full_match(w, '[\p{{Lu}}\p{{Ll}}]+') THEN 'ALPHA' WHEN regexp_full_match(w, '\p{{Nd}}+') THEN 'NUMBER'
  WHEN regexp_full_match(w, '[\p{{P}}\p{{S}}]+') THEN 'SYMBOL' WHEN regexp_full_match(w, '\p{{Lo}}+') THEN 'OTHER_LANGUAGE' WHEN regexp_full_match(w, '[\p{{Lu}}\p{{Ll}}\p{{Nd}}]+') THEN 'ALPHANUM'
  WHEN regexp_full_match(w, '[\p{{Lu}}\p{{Ll}}\p{{Nd}}]+[\p{{P}}\p{{S}}][\p{{Lu}}\p{{Ll}}\p{{Nd}}\p{{P}}\p{{S}}]*') THEN 'ASCII' ELSE 'UNCATEGORIZED' END AS type
  FROM (SELECT unnest({_WORDS("text")}) AS w FROM documents)) GROUP BY type""")
def _(spark, d):
    words = _table(spark, d, "documents").select(F.explode(tokens.words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("k"))
    return words.select(chars.term_type(F.col("w")).alias("type"), "k").groupBy("type").agg(F.sum("k").alias("n"))


_SQL_NUM = r"([0-9]{1,3}(,[0-9]{3})+|[0-9]+)(\.[0-9]+)*(:([0-9]{1,3}(,[0-9]{3})+|[0-9]+)(\.[0-9]+)*)?"


@_query("number_pattern_filter", f"SELECT w AS number, replace(w, ',', '') AS plain, count(*) AS n FROM (SELECT unnest({_WORDS('text')}) AS w FROM documents) WHERE regexp_full_match(w, '{_SQL_NUM}') GROUP BY ALL")
def _(spark, d):
    words = _table(spark, d, "documents").select(F.explode(tokens.words(F.col("text"))).alias("number"))
    return words.where(chars.is_number_col(F.col("number"))).groupBy("number").agg(F.count("*").alias("n")).select("number", chars.strip_commas(F.col("number")).alias("plain"), "n")


@_query("strip_commas", "SELECT o_orderkey, replace(format('{:,}', o_totalprice::BIGINT), ',', '') AS plain FROM orders")
def _(spark, d):
    grouped = F.format_number(F.bround(F.col("o_totalprice")).cast("long"), 0)
    return _table(spark, d, "orders").select("o_orderkey", chars.strip_commas(grouped).alias("plain"))


@_query("long_number_to_model", f"SELECT term, CASE WHEN type = 'NUMBER' AND length(term) >= 5 THEN 'MODEL_NAME' ELSE type END AS final_type, n FROM ({_SQL_TERMS}) WHERE type IN ('NUMBER', 'UNCATEGORIZED')")
def _(spark, d):
    found = tokens.term_counts(_table(spark, d, "documents"), "text", "NUMBER", "UNCATEGORIZED")
    return found.select("term", tokens.retyped(F.col("term"), F.col("type")).alias("final_type"), "n")


_UNITS = ["CM", "GB", "V"]
_SQL_SIZES = "(SELECT p_partkey, p_brand || ' ' || p_size || 'cm ' || p_name || ' 3,' || p_size || ' GB' AS t FROM part)"


@_query("unit_number_pairs", f"""SELECT p_partkey, number, unit FROM (SELECT p_partkey, term AS unit, lag(term) OVER (PARTITION BY p_partkey ORDER BY token_no) AS number
  FROM (SELECT p_partkey, generate_subscripts(r, 1) AS token_no, unnest(r) AS term FROM (SELECT p_partkey, regexp_extract_all(t, '{_SQL_RUNS}') AS r FROM {_SQL_SIZES})))
WHERE regexp_full_match(number, '\\p{{Nd}}+') AND upper(unit) IN ({', '.join(f"'{u}'" for u in _UNITS)})""")
def _(spark, d):
    size = F.col("p_size").cast("string")
    texts = _table(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit(" "), size, F.lit("cm "), "p_name", F.lit(" 3,"), size, F.lit(" GB")).alias("t"))
    return texts.select("p_partkey", F.explode(tokens.unit_numbers(F.col("t"), _UNITS)).alias("u")).select("p_partkey", "u.*")


@_query("stopword_antijoin", f"SELECT term, n FROM ({_SQL_TERMS}) WHERE lower(term) NOT IN ({_STOP_LIST}) AND type = 'ALPHA'")
def _(spark, d):
    found = tokens.term_counts(_table(spark, d, "documents"), "text", "ALPHA")
    stop = _rows(spark, [(w,) for w in STOP], "w string")  # a fixed list
    return found.join(F.broadcast(stop), F.lower("term") == F.col("w"), "left_anti").select("term", "n")


@_query("stopword_label", f"SELECT CASE WHEN lower(term) IN ({_STOP_LIST}) THEN 'STOPWORD' ELSE type END AS type, sum(n)::BIGINT AS n FROM ({_SQL_TERMS}) GROUP BY 1")
def _(spark, d):
    found = tokens.term_counts(_table(spark, d, "documents"), "text")
    return found.select(F.when(F.lower("term").isin(*STOP), "STOPWORD").otherwise(F.col("type")).alias("type"), "n").groupBy("type").agg(F.sum("n").alias("n"))


_SQL_SYN = f"""(SELECT upper(keyword) AS key, trim(unnest(string_split(value, ','))) AS word FROM {_values(SYNONYMS, 'dict_type, keyword, value, id')} WHERE keyword IS NOT NULL
 UNION SELECT upper(a), b FROM (SELECT unnest(v) AS a, v FROM (SELECT string_split(value, ',') AS v FROM {_values(SYNONYMS, 'dict_type, keyword, value, id')} WHERE keyword IS NULL)), unnest(v) AS u(b) WHERE a <> b)"""


@_query("synonym_expand", f"SELECT p_partkey, w AS word, s.word AS synonym FROM (SELECT p_partkey, unnest({_WORDS('p_name')}) AS w FROM part) LEFT JOIN {_SQL_SYN} s ON upper(w) = s.key")
def _(spark, d):
    syn = dictionary.synonyms(_rows(spark, SYNONYMS, dictionary.SOURCE))  # a fixed list
    words = _table(spark, d, "part").select("p_partkey", F.explode(tokens.words(F.col("p_name"))).alias("word"))
    return words.join(F.broadcast(syn), chars.fold(F.col("word")) == F.col("key"), "left").select("p_partkey", "word", F.explode_outer("words").alias("synonym"))


@_query("synonym_one_way", f"SELECT key, word FROM {_SQL_SYN}")
def _(spark, d):
    return dictionary.synonyms(_rows(spark, SYNONYMS, dictionary.SOURCE)).select("key", F.explode("words").alias("word"))


_SQL_LISTS = "(SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_suppkey <> l_partkey)"


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and parts as words that list each other: a table of synonyms that grows with the data."""
    return _table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).where("a <> b")


@_query("synonym_two_way_pairs", f"SELECT x.a, x.b FROM {_SQL_LISTS} x JOIN {_SQL_LISTS} y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b")
def _(spark, d):
    return dictionary.mutual(_lists(spark, d))


@_query("synonym_closure", f"""WITH RECURSIVE lists AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_suppkey <> l_partkey AND l_returnflag = 'R' AND l_linestatus = 'F'),
grown(main, word) AS (SELECT x.a, x.b FROM lists x JOIN lists y ON x.a = y.b AND x.b = y.a
  UNION SELECT g.main, l.b FROM grown g JOIN lists l ON g.word = l.a JOIN lists y ON y.a = l.b AND y.b = g.main WHERE l.b <> g.main),
members AS (SELECT * FROM grown UNION SELECT main, main FROM grown), sizes AS (SELECT main, count(*) AS n FROM members GROUP BY main),
told AS (SELECT m.main, l.b AS word, count(*) AS n FROM members m JOIN lists l ON l.a = m.word GROUP BY m.main, l.b),
kept AS (SELECT m.main, m.word FROM members m JOIN told t ON t.main = m.main AND t.word = m.word JOIN sizes s ON s.main = m.main WHERE t.n = s.n - 1)
SELECT main, word FROM kept WHERE main IN (SELECT main FROM kept GROUP BY main HAVING count(*) > 1)""")
def _(spark, d):
    returned = _table(spark, d, "lineitem").where("l_returnflag = 'R' and l_linestatus = 'F'")  # with all lines nearly every word lists every other
    return administration.two_way(returned.select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")))


@_query("compound_explode", f"SELECT p_partkey, w AS word, trim(part) AS part FROM (SELECT p_partkey, unnest({_WORDS('p_name')}) AS w FROM part) JOIN {_values(COMPOUNDS, 'dict_type, keyword, value, id')} ON upper(w) = upper(keyword), unnest(string_split(value, ',')) AS u(part)")
def _(spark, d):
    found = dictionary.parts(_rows(spark, COMPOUNDS, dictionary.SOURCE))  # a fixed list
    words = _table(spark, d, "part").select("p_partkey", F.explode(tokens.words(F.col("p_name"))).alias("word"))
    return words.join(F.broadcast(found), chars.fold(F.col("word")) == F.col("key")).select("p_partkey", "word", F.explode("words").alias("part"))


@_query("space_split", f"SELECT p_partkey, replace(upper(p_name), ' ', '') AS key, unnest(string_split(keyword, ' ')) AS part FROM part JOIN {_values(SPACES, 'dict_type, keyword, value, id')} ON replace(upper(p_name), ' ', '') = replace(upper(keyword), ' ', '')")
def _(spark, d):
    found = dictionary.forced_splits(_rows(spark, SPACES, dictionary.SOURCE))  # a fixed list
    names = _table(spark, d, "part").select("p_partkey", chars.without_spaces(chars.fold(F.col("p_name"))).alias("key"))
    return names.join(F.broadcast(found), "key").select("p_partkey", "key", F.explode("words").alias("part"))


_HAS = lambda w, c="text": f"list_contains({_WORDS(_UP(c))}, '{w.upper()}')"


@_query("bool_and_search", f"SELECT doc_id FROM documents WHERE {_HAS('the')} AND {_HAS('and')}")
def _(spark, d):
    return search.search(_table(spark, d, "documents"), And((Term("the"), Term("and"))), "text").select("doc_id")


@_query("bool_or_search", f"SELECT doc_id FROM documents WHERE {_HAS('die')} OR {_HAS('les')}")
def _(spark, d):
    return search.search(_table(spark, d, "documents"), Or((Term("die"), Term("les"))), "text").select("doc_id")


@_query("bool_synonym_search", f"SELECT p_partkey, p_name FROM part WHERE ({_HAS('cold', 'p_name')} OR {_HAS('icy', 'p_name')} OR {_HAS('frosty', 'p_name')}) AND ({_HAS('widget', 'p_name')} OR {_HAS('gadget', 'p_name')})")
def _(spark, d):
    dicts = dictionary.snapshot(_rows(spark, SYNONYMS, dictionary.SOURCE))
    return search.search(_table(spark, d, "part"), product.query_of("cold widget", dicts), "p_name").select("p_partkey", "p_name")


@_query("extra_term_search", f"SELECT p_partkey FROM part WHERE {_HAS('brand#13', 'p_brand')} OR ({_HAS('small', 'p_name')} AND {_HAS('widget', 'p_name')})")
def _(spark, d):
    tree = Or((Term("Brand#13"), And((Term("small"), Term("widget")))))
    return search.search(_table(spark, d, "part"), tree, "p_brand", "p_name").select("p_partkey")


@_query("search_page_rownum", "SELECT o_orderkey, o_totalprice, (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1)::INTEGER AS _rownum FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def _(spark, d):
    return search.page(_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), search.parse_sort([{"o_totalprice": "desc"}, "o_orderkey"]), 40, 20)


@_query("search_total", f"SELECT count(*) AS total FROM documents WHERE {_HAS('the')}")
def _(spark, d):
    return search.total(search.search(_table(spark, d, "documents"), Term("the"), "text"))


@_query("range_term_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 1000 AND o_totalprice < 200000 AND NOT o_orderpriority = '1-URGENT'")
def _(spark, d):
    dsl = {"bool": {"filter": [{"terms": {"o_orderstatus": ["F", "O"]}}, {"range": {"o_totalprice": {"gte": 1000, "lt": 200000}}}], "must_not": [{"term": {"o_orderpriority": "1-URGENT"}}]}}
    return _table(spark, d, "orders").where(search.parse_dsl(dsl)).select("o_orderkey")


@_query("dsl_match", f"SELECT p_partkey FROM part WHERE ({_HAS('cold', 'p_name')} OR {_HAS('small', 'p_name')}) AND NOT {_HAS('widget', 'p_name')}")
def _(spark, d):
    dsl = {"bool": {"must": [{"match": {"p_name": "cold small"}}], "must_not": [{"simple_query_string": {"query": "widget", "fields": ["p_name"]}}]}}
    return _table(spark, d, "part").where(search.parse_dsl(dsl)).select("p_partkey")


@_query("highlight_terms", r"SELECT p_partkey, regexp_replace(p_name, '\b(widget|cold)\b', '<b>\1</b>', 'gi') AS shown FROM part")
def _(spark, d):
    return _table(spark, d, "part").select("p_partkey", search.highlight(F.col("p_name"), ["cold", "widget"]).alias("shown"))


def _sql_grams(n: int) -> str:
    joined = " || ".join(f"w[i + {k}]" for k in range(n))
    return f"SELECT gram, count(*) AS n FROM (SELECT {joined} AS gram FROM (SELECT {_WORDS('text')} AS w FROM documents) x, range(1, len(w) - {n - 2}) g(i)) GROUP BY gram"


@_query("term_bigrams", _sql_grams(2))
def _(spark, d):
    return tokens.grams(_table(spark, d, "documents"), "doc_id", "text", 2).groupBy("gram").agg(F.count("*").alias("n"))


@_query("term_trigrams", _sql_grams(3))
def _(spark, d):
    return tokens.grams(_table(spark, d, "documents"), "doc_id", "text", 3).groupBy("gram").agg(F.count("*").alias("n"))


@_query("dict_counts", f"SELECT dict_type, count(*) AS n FROM {_values(SOURCE_ROWS, 'dict_type, keyword, value, id')} GROUP BY dict_type")
def _(spark, d):
    return dictionary.counts(_rows(spark, SOURCE_ROWS, dictionary.SOURCE))


@_query("dict_find", f"SELECT dict_type, keyword, value FROM {_values(SOURCE_ROWS, 'dict_type, keyword, value, id')} WHERE keyword = 'widget' OR value = 'widget'")
def _(spark, d):
    return dictionary.find(_rows(spark, SOURCE_ROWS, dictionary.SOURCE), dictionary.lexicon(_rows(spark, [(x,) for x in LEXICON], "value string")), "widget")


@_query("lexicon_merge_max", "SELECT * FROM (VALUES ('노트북', 'N', -8.0::DOUBLE), ('물', 'N', -8.0::DOUBLE), ('가다', 'V', -7.0::DOUBLE), ('새말', 'N', -8.0::DOUBLE)) t(key, tag, prob)")
def _(spark, d):
    lex = dictionary.lexicon(_rows(spark, [(x,) for x in LEXICON], "value string"))
    return dictionary.with_words(lex, _rows(spark, [("노트북",), ("물",), ("새말",)], "word string"), "HIGH")


_SQL_N = f"SELECT s, ascii(s) - {hangul.BASE} AS k FROM {_values(SYLLABLES, 's')}"
_SQL_IS = f"ascii(s) BETWEEN {hangul.BASE} AND {hangul.LAST}"


@_query("jamo_decompose", f"SELECT s, CASE WHEN {_SQL_IS} THEN substr('{hangul.INITIAL}', (k // 588 + 1)::BIGINT, 1) || substr('{hangul.MEDIAL}', (k // 28 % 21 + 1)::BIGINT, 1) || CASE WHEN k % 28 > 0 THEN substr('{hangul.FINAL}', (k % 28 + 1)::BIGINT, 1) ELSE '' END ELSE s END AS jamo FROM ({_SQL_N})")
def _(spark, d):
    return _rows(spark, [(s,) for s in SYLLABLES], "s string").select("s", hangul.decompose_col(F.col("s")).alias("jamo"))


@_query("final_consonant", f"SELECT s, CASE WHEN {_SQL_IS} THEN (k % 28)::VARCHAR END AS code FROM ({_SQL_N})")
def _(spark, d):
    return _rows(spark, [(s,) for s in SYLLABLES], "s string").select("s", hangul.final_code(F.col("s")).cast("string").alias("code"))


_SQL_FIELD = lambda k: rf"CASE WHEN contains(line, '[%{k}%]') THEN regexp_extract(line, '\[%{k}%\](.*?)(\[%[a-zA-Z0-9_-]+%\]|$)', 1) END"


@_query("bulk_text_parse", f"SELECT {_SQL_FIELD('ID')} AS id, {_SQL_FIELD('NAME')} AS name FROM {_values(TAGGED, 'line')}")
def _(spark, d):
    f = _rows(spark, [(x,) for x in TAGGED], "line string").select(tagged.fields(F.col("line")).alias("f"))
    return f.select(F.col("f")["ID"].alias("id"), F.col("f")["NAME"].alias("name"))


@_query("date_field_parse", f"SELECT {_SQL_FIELD('ID')} AS id, CAST(CAST(try_strptime({_SQL_FIELD('REGISTERDATE')}, '%Y%m%d') AS DATE) AS VARCHAR) AS day FROM {_values(TAGGED, 'line')}")
def _(spark, d):
    f = _rows(spark, [(x,) for x in TAGGED], "line string").select(tagged.fields(F.col("line")).alias("f"))
    return f.select(F.col("f")["ID"].alias("id"), tagged.coerced(F.col("f")).cast("string").alias("day"))


_SQL_TAGS = _values([(k, v) for k, v in morph.TAGS.items()], "name, number")
_SQL_MORPH = _values([(a, b, c, e, z) for a, b, c, e, *_, z in MORPHEMES], "doc_id, seq, surface, tag, space_len")
_SQL_TAG = "CASE WHEN tag LIKE 'J%' THEN 'J' WHEN regexp_matches(tag, '^E[^J]') THEN 'E' ELSE tag END"


@_query("pos_tag_lookup", f"SELECT doc_id, seq, n.name, n.number FROM (SELECT *, {_SQL_TAG} AS kind FROM {_SQL_MORPH}) m JOIN (SELECT * FROM {_SQL_TAGS}) n ON m.kind = n.name")
def _(spark, d):
    rows = _rows(spark, MORPHEMES, morph.MORPHEME).select("doc_id", "seq", morph.tag_of(F.col("tag")).alias("name"))
    return rows.select("*", morph.tag_id(F.col("name")).alias("number"))


def _sql_groups(mode: str) -> str:
    joint = ", ".join(f"'{a}>{b}'" for a, b in morph.pairs(mode))
    return f"""SELECT doc_id, seq, kind, surface, start_off, sum(fresh) OVER (PARTITION BY doc_id ORDER BY seq)::INTEGER AS eojeol FROM (
  SELECT *, CASE WHEN space_len = 0 AND coalesce(lag(kind) OVER w || '>' || kind IN ({joint}), false) THEN 0 ELSE 1 END AS fresh,
    (sum(space_len + length(surface)) OVER w - length(surface))::INTEGER AS start_off
  FROM (SELECT *, {_SQL_TAG} AS kind FROM {_SQL_MORPH}) WINDOW w AS (PARTITION BY doc_id ORDER BY seq))"""


@_query("eojeol_groups", f"SELECT doc_id, seq, surface, start_off, eojeol FROM ({_sql_groups('standard')})")
def _(spark, d):
    return morph.eojeols(_rows(spark, MORPHEMES, morph.MORPHEME)).select("doc_id", "seq", "surface", F.col("start").alias("start_off"), "eojeol")


def _sql_mode(mode: str, kept: list[str]) -> str:
    return f"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY eojeol) - 1)::INTEGER AS token_no, CASE WHEN n = 1 AND kind IN ('VV', 'VA') THEN term || '/' || kind ELSE term END AS term,
  CASE WHEN n > 1 THEN 'EOJEOL' ELSE kind END AS type, start_off FROM (
  SELECT doc_id, eojeol, count(*) AS n, min(kind) AS kind, string_agg(surface, '' ORDER BY seq) AS term, min(start_off) AS start_off FROM ({_sql_groups(mode)}) GROUP BY ALL)
  WHERE n > 1 OR kind IN ({", ".join(f"'{k}'" for k in kept)})"""


@_query("similarity_tokens", _sql_mode("similarity", morph.KEPT_ALONE))
def _(spark, d):
    return morph.tokenize(_rows(spark, MORPHEMES, morph.MORPHEME), "similarity").select("doc_id", "token_no", "term", "type", "start_off")


@_query("keyword_tokens", _sql_mode("keyword", [*morph.KEPT_ALONE, "NNB", "NP"]))
def _(spark, d):
    return morph.tokenize(_rows(spark, MORPHEMES, morph.MORPHEME), "keyword").select("doc_id", "token_no", "term", "type", "start_off")


@_query("props_json_extract", "SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type")
def _(spark, d):
    k = F.from_json("props", "k long")["k"]
    return _table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


def _golden(spark: SparkSession, d: str, options: tuple) -> DataFrame:
    """Every part with the morphemes of one of the worked cases, as tokens."""
    cases = [c for c in goldens.CASES if c[:3] == options]
    rows = [(i, *m) for i, c in enumerate(cases) for m in goldens.morphemes(c[3])]
    listed = _rows(spark, rows, morph.MORPHEME.replace("doc_id long", "case_no long"))  # a fixed list
    parts = _table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), (F.col("p_partkey") % len(cases)).alias("case_no"))
    mode, least, original = options
    found = morph.tokenize(parts.join(F.broadcast(listed), "case_no").drop("case_no"), mode, least, original)
    return found.select("doc_id", "token_no", "term", "type", "sem", "pos_incr", "pos_len", "start_off", "end_off")


def _sql_golden(options: tuple) -> str:
    cases = [c for c in goldens.CASES if c[:3] == options]
    rows = [(i, *t) for i, c in enumerate(cases) for t in goldens.tokens(c[4])]
    names = "case_no, token_no, term, type, sem, pos_incr, pos_len, start_off, end_off"
    return f"SELECT p_partkey AS doc_id, {names.partition(', ')[2]} FROM part JOIN {_values(rows, names)} ON p_partkey % {len(cases)} = case_no"


for _name, _options in {"standard_tokens": ("standard", 4, True), "standard_tokens_apart": ("standard", 1, True), "standard_tokens_whole": ("standard", 9999, True),
                        "similarity_tokens_cases": ("similarity", 9999, True), "keyword_tokens_cases": ("keyword", 9999, True)}.items():
    _query(_name, _sql_golden(_options))(lambda spark, d, options=_options: _golden(spark, d, options))

_WORDS_KNOWN = [("COLD", "N", -9.0), ("WIDGET", "N", -9.0), ("BRAND", "N", -8.0), ("BOLT", "N", -9.0), ("OLD", "V", -9.5), ("GET", "V", -10.0)]
_SQL_KNOWN = f"(VALUES {', '.join(map(str, _WORDS_KNOWN))}) AS x(key, tag, prob)"


@_query("segment_words", f"""SELECT p_partkey, n::INTEGER AS "at", word, coalesce(x.tag, CASE WHEN regexp_full_match(word, '[0-9]+') THEN 'DIGIT' WHEN regexp_full_match(word, '[^A-Za-z0-9]+') THEN 'SYMBOL' ELSE 'UNK' END) AS tag
FROM (SELECT p_partkey, generate_subscripts(r, 1) - 1 AS n, unnest(r) AS word FROM (SELECT p_partkey, regexp_extract_all(p_brand || ' ' || p_name, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9 ]+') AS r FROM part))
LEFT JOIN {_SQL_KNOWN} ON upper(word) = x.key""")
def _(spark, d):
    lex = {k: [(tag, prob)] for k, tag, prob in _WORDS_KNOWN}
    return segment.segmented(_table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_name").alias("text")), lex, "p_partkey")


@_query("lexicon_substrings", f"""SELECT p_partkey, s::INTEGER AS start, n::INTEGER AS length, tag, prob FROM (SELECT p_partkey, s, unnest(range(1, least(20, length(p_name) - s) + 1)) AS n, p_name
  FROM (SELECT p_partkey, p_name, unnest(range(0, length(p_name))) AS s FROM part)) JOIN {_SQL_KNOWN} ON upper(substr(p_name, s + 1, n)) = x.key""")
def _(spark, d):
    lex = _rows(spark, _WORDS_KNOWN, "key string, tag string, prob double")
    return segment.lexicon_matches(_table(spark, d, "part").select("p_partkey", "p_name"), lex, "p_name").drop("p_name")


# Model names and the terms they must give, in index and query mode.
MODEL_TERMS = [
    ("1b-12345", "1b 12345 1b-12345", "1b 12345 1b-12345"), ("b1/a2s", "b1 a 2 s a2s b1/a2s", "b1 a 2 s a2s b1/a2s"), ("c9-123567", "c9 123567 9123567 c9-123567", "c9 123567 c9-123567"),
    ("d9-b", "d9 b d9-b", "d9 b d9-b"), ("d8-1", "d8 1 81 d8-1", "d8 1 d8-1"), ("1b/a2s", "1b a ba 2 s a2s 1b/a2s", "1b a 2 s a2s 1b/a2s"), ("9c-abcdef", "9c abcdef cabcdef 9c-abcdef", "9c abcdef 9c-abcdef"),
    ("8a/b", "8a b ab 8a/b", "8a b 8a/b"), ("7b-3", "7b 3 7b-3", "7b 3 7b-3"), ("1A-B2C3D4", "1A B AB 2 C 3 D 4 B2C3D4 1A-B2C3D4", "1A B 2 C 3 D 4 B2C3D4 1A-B2C3D4"),
    ("AKSO-1X", "AKSO 1X AKSO-1X", "AKSO 1X AKSO-1X"), ("AKSO-1G", "AKSO 1G AKSO-1G", "AKSO 1G AKSO-1G"), ("120cmx60cm", "120 120cm 60 60cm", "120cm 60cm"), ("120x60cm", "120 60 60cm", "120 60cm"),
]


def _model_terms(spark: SparkSession, d: str, query: bool, join: bool = False) -> DataFrame:
    rows = _rows(spark, SOURCE_ROWS, dictionary.SOURCE)
    options = AnalyzerOptions(use_for_query=query, use_synonym=False)
    names = F.array(*[F.lit(t) for t, _, _ in MODEL_TERMS])
    parts = _table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat_ws(" ", F.get(names, (F.col("p_partkey") % len(MODEL_TERMS)).cast("int")), "p_name").alias("text"))
    found = large.analyse(parts, rows, None, options) if join else product.analyse(parts, dictionary.snapshot(rows), options)
    each = found.select("doc_id", "end_off", F.explode(F.concat(F.array("term"), "extras.term")).alias("term"))
    first = F.transform(names, lambda t: F.length(t))
    return each.where(F.col("end_off") <= F.get(first, (F.col("doc_id") % len(MODEL_TERMS)).cast("int"))).select("doc_id", "term")


def _sql_model_terms(column: int) -> str:
    rows = [(i, t) for i, row in enumerate(MODEL_TERMS) for t in row[column].split()]
    return f"SELECT p_partkey AS doc_id, term FROM part JOIN {_values(rows, 'case_no, term')} ON p_partkey % {len(MODEL_TERMS)} = case_no"


@_query("model_terms_index", _sql_model_terms(1))
def _(spark, d):
    return _model_terms(spark, d, False)


@_query("model_terms_query", _sql_model_terms(2))
def _(spark, d):
    return _model_terms(spark, d, True)


@_query("model_terms_join", _sql_model_terms(2))
def _(spark, d):
    return _model_terms(spark, d, True, join=True)


CONFIG = [("automobile", "SYNONYM", "HIGH", True, "a.dict", 1, "cars"), ("building", "CUSTOM", None, True, "b.dict", 2, "homes"), ("machinery", "MAP", "MID", False, "m.dict", 3, None), ("unused", "SET", None, True, "u.dict", 4, "none")]
RECORDS = [("building", 7, "2020-01-01 00:00:00", "2020-01-02 00:00:00"), ("other", 1, "2020-01-01 00:00:00", None)]
NOW = "2024-01-01 00:00:00"
_SQL_SOURCE = "(SELECT upper(c_mktsegment) AS dict_type, CASE WHEN c_nationkey > 5 THEN c_name END AS keyword, CASE WHEN c_acctbal > 0 THEN c_name || ',' || c_nationkey END AS value, c_custkey::VARCHAR AS id FROM customer)"
_SQL_CONFIG = _values([(n, t, k, "true" if i else "false", q, x) for n, t, k, i, _, q, x in CONFIG], "name, type, token_type, ignore_case, seq, label")
_SQL_LINE = """CASE WHEN type LIKE 'SYNONYM%' THEN CASE WHEN keyword IS NULL THEN coalesce(value, '') ELSE keyword || chr(9) || coalesce(value, '') END
  WHEN type = 'CUSTOM' THEN coalesce(keyword, '') || chr(9) || id WHEN value IS NULL THEN coalesce(keyword, '') ELSE coalesce(keyword, '') || chr(9) || value END"""


def _source(spark: SparkSession, d: str) -> DataFrame:
    """Customers as source rows of the dictionaries of their market segments."""
    listed = F.when(F.col("c_acctbal") > 0, F.concat_ws(",", "c_name", F.col("c_nationkey").cast("string")))
    return _table(spark, d, "customer").select(F.upper("c_mktsegment").alias("dict_type"), F.when(F.col("c_nationkey") > 5, F.col("c_name")).alias("keyword"), listed.alias("value"), F.col("c_custkey").cast("string").alias("id"))


@_query("dict_compile", f"SELECT name, type, {_SQL_LINE} AS line FROM {_SQL_SOURCE} JOIN (SELECT * FROM {_SQL_CONFIG}) c ON dict_type = upper(name)")
def _(spark, d):
    return administration.compiled(_source(spark, d), _rows(spark, CONFIG, administration.CONFIG))


_SQL_APPLIED = f"SELECT coalesce(n.id, r.id) AS id, coalesce(n.count, r.count) AS count, coalesce(n.t, r.a) AS appliedTime, r.u AS updatedTime FROM (SELECT * FROM {_values(RECORDS, 'id, count, a, u')}) r FULL JOIN (SELECT name AS id, count(*)::INTEGER AS count, '{NOW}' AS t FROM {_SQL_SOURCE} JOIN (SELECT * FROM {_SQL_CONFIG}) c ON dict_type = upper(name) GROUP BY name) n ON n.id = r.id"


def _applied(spark: SparkSession, d: str) -> DataFrame:
    lines = administration.compiled(_source(spark, d), _rows(spark, CONFIG, administration.CONFIG))
    return administration.upserted(_rows(spark, RECORDS, administration.APPLY), administration.applied(lines, NOW))


@_query("dict_apply_records", _SQL_APPLIED)
def _(spark, d):
    return _applied(spark, d)


@_query("dict_info", f"""SELECT upper(name) AS dict_type, name AS id, type, ignore_case = 'true' AS ignore_case, coalesce(token_type, 'NONE') AS token_type, label, seq, coalesce(appliedTime, '') AS appliedTime, coalesce(updatedTime, '') AS updatedTime,
  coalesce(r.count, 0) AS count, coalesce(n, 0) AS index_count FROM (SELECT * FROM {_SQL_CONFIG}) c LEFT JOIN ({_SQL_APPLIED}) r ON r.id = c.name LEFT JOIN (SELECT dict_type, count(*) AS n FROM {_SQL_SOURCE} GROUP BY dict_type) s ON s.dict_type = upper(name)""")
def _(spark, d):
    return administration.info(_source(spark, d), _rows(spark, CONFIG, administration.CONFIG), _applied(spark, d))


@_query("search_all_rownum", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1)::INTEGER AS _rownum FROM orders QUALIFY _rownum >= 40")
def _(spark, d):
    return search.page(_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), search.parse_sort([{"o_totalprice": "desc"}, "o_orderkey"]), 40, -1).drop("o_totalprice")


@_query("search_action", rf"""SELECT p_partkey, p_name, p_partkey::VARCHAR AS _sort, (row_number() OVER (ORDER BY p_partkey DESC) - 1)::INTEGER AS _rownum, regexp_replace(p_name, '\b(cold|frosty|gadget|icy|widget)\b', '<b>\1</b>', 'gi') AS p_name_marked
FROM part WHERE ({_HAS('cold', 'p_name')} OR {_HAS('icy', 'p_name')} OR {_HAS('frosty', 'p_name')}) AND ({_HAS('widget', 'p_name')} OR {_HAS('gadget', 'p_name')}) AND p_size >= 10 ORDER BY p_partkey DESC LIMIT 20""")
def _(spark, d):
    node = product.query_of("cold widget", dictionary.snapshot(_rows(spark, SYNONYMS, dictionary.SOURCE)))
    return search.act(_table(spark, d, "part"), node, "p_name^2", base={"range": {"p_size": {"gte": 10}}}, sort=[{"p_partkey": "desc"}], marked=("p_name",))[0].select("p_partkey", "p_name", F.array_join("_sort", ",").alias("_sort"), "_rownum", "p_name_marked")


@_query("keyword_expansion", f"SELECT p_partkey AS doc_id, w AS term, s.word AS word FROM (SELECT p_partkey, unnest({_WORDS('p_name')}) AS w FROM part) JOIN {_SQL_SYN} s ON upper(w) = s.key")
def _(spark, d):
    dicts = dictionary.snapshot(_rows(spark, SYNONYMS, dictionary.SOURCE))
    found = product.expand(_table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text")), dicts)
    return found.select("doc_id", "term", F.explode("words").alias("word"))


def _product_terms(spark: SparkSession, d: str, query: bool) -> DataFrame:
    dicts = dictionary.snapshot(_rows(spark, SOURCE_ROWS, dictionary.SOURCE))
    names = _table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat_ws(" ", "p_brand", "p_name", F.concat(F.col("p_size"), F.lit("cm"))).alias("text"))
    more = _rows(spark, [(-1 - i, n) for i, n in enumerate(NAMES)], "doc_id long, text string")
    return product.analyse(names.unionByName(more), dicts, AnalyzerOptions(use_for_query=query))


@_query("product_terms_index")
def _(spark, d):
    return _product_terms(spark, d, False)


@_query("product_terms_query")
def _(spark, d):
    return _product_terms(spark, d, True)


@_query("analyze_sets")
def _(spark, d):
    return product.labelled_sets(_product_terms(spark, d, True))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
