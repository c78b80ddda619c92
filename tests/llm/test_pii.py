"""Surrogates: a plain second reading of every replaced text, and the edge cases."""

import re

import pytest
import regex
from pyspark.sql import functions as F

from oracle import SMALL
from termloom.llm import pii

CLASHING = "doc_id long, text string, sha string, row string, new string, n long, gaps string, _sha string, _e string, _map string, n_chars long"
ANY = regex.compile(pii.ANY)
KINDS = {k: regex.compile(p) for k, p in pii.PATTERNS.items()}


def replaced(spark, texts, key="key"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.replace_pii(df, key).orderBy("doc_id").collect()]


def plain(kind, mention):
    """What the mentions of one entity have in common, written again without Spark."""
    digits = re.sub("[^0-9]", "", mention)
    if kind in ("card", "tax_number"):
        return digits
    if kind == "phone":
        return digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
    if kind == "secret":
        return re.sub(pii._SECRET_HEAD.replace("(?i:", "(?:"), "", mention, flags=re.I).rstrip("\"'")
    return mention.lower() if kind == "email" else mention.replace(" ", "") if kind == "iban" else mention


def shape(text):
    return "".join("9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in text)


def test_replaced_texts_equal_a_plain_replacement(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.join(pii.replace_pii(docs, "key", count=True).select("doc_id", F.col("text").alias("new"), "n_entities"), "doc_id").collect()
    told = {}
    for r in rows:
        mentions, gaps = [m.group() for m in ANY.finditer(r.text or "")], ANY.split(r.text or "")
        assert r.n_entities == len(mentions)
        at = 0
        for i, mention in enumerate(mentions):  # the text between mentions is as it was
            assert r.new.startswith(gaps[i], at)
            at += len(gaps[i])
            kind = next(k for k, p in KINDS.items() if p.fullmatch(mention))
            new = r.new[at : at + len(mention)]
            at += len(mention) if kind != "ip" else len(new := pii_ip.match(r.new, at).group())
            assert new != mention and (kind == "ip" or shape(new) == shape(mention) or kind == "secret"), (mention, new)
            told.setdefault((kind, plain(kind, mention)), set()).add(plain(kind, new))
        assert r.new[at:] == gaps[-1] or (r.text is None and r.new is None)
    assert len(told) > 10 and all(len(v) == 1 for v in told.values())  # one entity, one surrogate
    surs = [(k, next(iter(v))) for (k, _), v in told.items()]
    assert len(set(surs)) == len(surs) and not set(surs) & set(told)  # distinct, and none that occurs


pii_ip = re.compile(r"[0-9.]*[0-9]")


def test_masked_and_hard_values_end(spark):
    long_mail = "a@" + "b." * 6000 + "com"
    texts = ["password: ******", "x _@a.com y", long_mail, "password: пароль12", "token=漢字漢字漢字", "see " + "c" * 30_000 + "@d.org", "secret = ------ end", "http://u:p@host.example.com/a@b", "a@b.co."]
    out = replaced(spark, texts)
    assert out[0] == texts[0] and out[6] == texts[6]
    assert re.fullmatch(r"x _[a-p]*@[a-z]\.com y", out[1]) and out[1] != texts[1]
    assert re.fullmatch(r"password: [а-я]{6}\d\d", out[3]) and out[3] != texts[3]
    assert re.fullmatch(r"token=[一-鿿]{6}", out[4]) and out[4] != texts[4]
    assert len(out[5]) == len(texts[5]) and out[5] != texts[5] and out[8].endswith(".co.") and "a@b" not in out[8]


def test_a_space_that_is_full_ends_in_tokens(spark):
    texts = [f"call +1 2{i:01d} {j:02d} now" for i in range(10) for j in range(100)]  # every five-digit number with these heads
    out = replaced(spark, texts)
    assert len(set(out)) == len(texts) and not set(out) & set(texts)
    assert all(re.fullmatch(r"call (\+\d \d\d \d\d|\[phone:[0-9a-f]{32}\]) now", t) for t in out)
    mails = [f"{c}@{d}.com" for c in "abcdefghijklmnopqrstuvwxyz" for d in "abcdefghijklmnopqrstuvwxyz"]  # every address of this form
    out = replaced(spark, mails)
    assert len(set(out)) == len(mails) and not set(out) & set(mails) and all(re.fullmatch(r"[a-z]+@[a-z]\.com", t) for t in out)


def test_names_keep_gender_script_and_surname(spark):
    texts = ["Mr Smith and Mr. John Smith met Mrs Anna Jones.", "Mr SMITH", "Г-н Иван Петров", "Mr Γιώργος Παπάς", "Frau Müller", "Mrs Jones", "Mr. Paul Smith"]
    out = replaced(spark, texts)
    first, second, third = re.fullmatch(r"Mr (\w+) and Mr\. (\w+ \w+) met Mrs (\w+ \w+)\.", out[0]).groups()
    assert second.split()[1] == first and out[1] == f"Mr {first.upper()}" and out[5] == f"Mrs {third.split()[1]}"
    assert out[6].split()[2] == first and out[6].split()[1] != second.split()[0]
    assert third.split()[0].lower() in pii.NAMES["latin", "f"] and second.split()[0].lower() in pii.NAMES["latin", "m"] + [second.split()[0].lower()] * second.split()[0].endswith("n")
    assert re.fullmatch("Г-н [А-Яа-яё]+ [А-Яа-яё]+", out[2]) and re.fullmatch("Mr [Ͱ-Ͽ]+ [Ͱ-Ͽ]+", out[3])
    assert not re.search("Smith|Jones|Петров|Παπάς|Müller", " ".join(out))


def test_cards_keep_a_check_digit(spark):
    (text,) = replaced(spark, ["card 4111 1111 1111 1111."])
    digits = [int(c) for c in text if c.isdigit()]
    assert re.fullmatch(r"card 4\d{3} \d{4} \d{4} \d{4}\.", text)
    assert sum(sum(divmod(d * 2, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0


def test_columns_rows_and_empty_tables(spark):
    rows = [(1, "mail a.b@corp.org", "s", "r", "n", 5, "g", "x", "y", "z", 17)] * 2 + [(None, None, None, "r", "n", 5, "g", "x", "y", "z", None), (2, "", "s", "r", "n", 5, "g", "x", "y", "z", 0), (3, "a.b@corp.org " * 20_000, "s", "r", "n", 6, "g", "x", "y", "z", 1)]
    df = spark.createDataFrame(rows, CLASHING)
    out = pii.replace_pii(df, "key")
    assert out.schema.simpleString() == df.schema.simpleString() and out.count() == 5
    kept = [c for c in df.columns if c not in ("text", "n_chars")]
    assert sorted(map(repr, out.select(kept).collect())) == sorted(map(repr, df.select(kept).collect()))
    by_id = {r.doc_id: r.text for r in out.collect()}
    mail = by_id[1].split()[1]
    assert by_id[None] is None and by_id[2] == "" and by_id[3] == f"{mail} " * 20_000 and mail != "a.b@corp.org"
    assert pii.replace_pii(df.limit(0), "key", count=True).count() == 0
    with pytest.raises(ValueError):
        pii.replace_pii(df.withColumn("n_entities", F.lit(1)), "key")
