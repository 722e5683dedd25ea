"""Surrogates: formats, coreference, distinctness, untouched text; the plan holds no Python."""

from __future__ import annotations

import re

from sparkloupe.llm import pii
from sparkloupe.llm.common import table
from sparkloupe.llm.pii import replace_pii


def run(spark, texts, **options):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, mention string")
    return [r.text for r in replace_pii(df, **{"key": "k", **options}).orderBy("doc_id").collect()]


def mod97(text):
    plain = re.sub(" ", "", text)
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def luhn(text):
    d = [int(c) for c in text if c.isdigit()][::-1]
    return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d)) % 10 == 0


def test_formats_and_coreference(spark):
    out = run(spark, [
        "Mail und.34@mail7.example.com or UND.34@MAIL7.EXAMPLE.COM; +1 (377) 555-0271, +1-377-555-0271.",
        "4111 1111 1111 1111, 4111-1111-1111-1111, 1234567890123456, at 97.51.17.173 and 97.51.17.173",
        "Dr. Ada Lovelace met Ms. Ada Lovelace and Mr. JOHN SMITH; г-н Иван Петров и Г-жа Иван Петров",
        'token = "87e15d78b9d8ef29b6c10061e3551a60fa07e990" DE89 3704 0044 0532 0130 00 123-45-6789',
        "again und.34@mail7.example.com",
    ])
    mail = re.search(r"\S+@\S+", out[0])[0]
    assert re.fullmatch(r"[a-z]{3}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com\.example", mail) and "mail7" not in mail and out[4] == f"again {mail}"
    assert f"or {mail.upper()};" in out[0]
    a, b = re.findall(r"\+[\d (-]+[\d) -]+\d", out[0])
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", a) and re.sub(r"\D", "", a) == re.sub(r"\D", "", b) and "377" not in a
    cards = out[1].split(", at ")[0].split(", ")
    assert luhn(cards[0]) and cards[0].replace(" ", "-") == cards[1] and cards[0][0] == "4" and not luhn(cards[2]) and len(cards[2]) == 16
    x, y = re.findall(r"\d+\.\d+\.\d+\.\d+", out[1])
    assert x == y and all(int(n) < 256 for n in x.split(".")) and x != "97.51.17.173"
    first, second = re.findall(r"(?:Dr|Ms)\. (\S+ \S+)", out[2])
    assert first == second and first.split()[0] in pii._GIVEN["latin"]["f"].split()
    john = re.search(r"Mr\. (\S+) (\S+);", out[2])
    assert john[1].isupper() and john[1].title() in pii._GIVEN["latin"]["m"].split() and john[1] != "JOHN"
    assert re.search("[а-я]", out[2]) and "Петров" not in out[2]
    assert re.fullmatch(r'token = "[0-9a-f]{40}" DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d \d{3}-\d\d-\d{4}', out[3])
    assert "87e15d" not in out[3] and "3704" not in out[3]
    assert mod97("DE89 3704 0044 0532 0130 00") == 1 == mod97(re.search(r"DE[\d ]+ \d\d(?= \d{3}-)", out[3])[0])


def test_distinct_by_construction(spark):
    """More entities than any small space of surrogates: permutations use all of it, and end."""
    texts = [f"at 9.{a}.{b}.7" for a in range(0, 200, 4) for b in range(0, 200, 4)] + [f"at 10.{a}.3.4" for a in range(200)]
    out = run(spark, texts)
    assert len(set(out)) == len(texts) and not set(out) & set(texts)
    assert run(spark, texts[:3], key="other") != run(spark, texts[:3])
    mails = [f"write {a}@{b}.{c} now" for a in "0123456789" for b in "0123456789" for c in ("com", "net", "org")]
    out = run(spark, mails)
    assert len(set(out)) == len(mails) and all(re.fullmatch(r"write \d@\d\.(com|net|org)\.example now", t) for t in out)
    full = [f"id {a:03d}-00-{b:04d}" for a in range(2) for b in range(0, 10000, 3)]
    assert len(set(run(spark, full))) == len(full)
    phones = [f"+49 {a:02d} {b:02d}" for a in range(100) for b in range(100)]  # the whole space of this form
    out = run(spark, phones)
    assert set(out) == set(phones) and sum(a == b for a, b in zip(out, phones, strict=True)) < 50
    cards = [f"4{k:011d}{c}" for k in range(300) for c in range(10)]
    assert len(set(run(spark, cards))) == len(cards)
    people = [f"Mr. {chr(65 + k % 26)}{'abcdefghij'[k // 26 % 10]}n" for k in range(260)]
    assert len(set(run(spark, people))) == len(set(people))


def test_names_keep_surname_gender_and_script(spark):
    out = run(spark, ["Mr Smith saw Mr John Smith, Mrs Mary Smith, Dr Mary Jones and Mr SMITH", "г-н Петров, Г-жа Анна Петров, Dr Νίκος Παπάς", "Mr Smith Mrs Jones"])
    a = re.fullmatch(r"Mr (\w+) saw Mr (\w+) (\w+), Mrs (\w+) (\w+), Dr (\w+) (\w+) and Mr (\w+)", out[0])
    assert a[1] == a[3] == a[5] == a[8].title() and a[8].isupper() and a[4] == a[6] and a[7] != a[1]
    assert any(a[4].startswith(n) for n in pii._GIVEN["latin"]["f"].split()) and any(a[2].startswith(n) for n in pii._GIVEN["latin"]["m"].split())
    assert out[2] == f"Mr {a[1]} Mrs {a[7]}"
    b = re.fullmatch(r"г-н (\w+)ов, Г-жа (\w+) (\w+)ова, Dr (\w+) (\w+)", out[1])
    assert b[1] == b[3] and all("ά" <= c.lower() <= "ώ" for c in b[4] + b[5])


def test_scripts_and_country_codes(spark):
    out = run(spark, ["用户@例子.cn пётр@почта.ru +44 20 7946 0958 +380 44 555 1212 (555) 123-4567 +1 202 555 0143"])[0]
    assert re.fullmatch(r"[\u4e00-\ua000]{2}@[\u4e00-\ua000]{2}\.cn\.example [а-џ]{4}@[а-џ]{5}\.ru\.example \+44 \d\d \d{4} \d{4} \+380 \d\d \d{3} \d{4} \(\d{3}\) \d{3}-\d{4} \+1 \d{3} \d{3} \d{4}", out)


def test_more_names_than_short_surnames(spark):
    """Entities beyond the 20 ** 3 surnames of three syllables get longer ones."""
    letters = "abcdefghij"
    people = [f"Mr. Q{letters[k // 1000 % 10]}{letters[k // 100 % 10]}{letters[k // 10 % 10]}{letters[k % 10]}" for k in range(9000)]
    out = run(spark, people)
    assert len(set(out)) == len(people) and not set(out) & set(people)


def test_tokens_without_digits(spark):
    """A key that is the only mention of its text and holds no digit is replaced."""
    keys = ["AKIA" + "ABCDEFGHIJKLMNOP", *(f"gh{c}_" + "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ" for c in "pousr"), "sk-abcdefghijklmnopqrstuvwx"]
    for key, new in zip(keys, run(spark, [f"key {k} here" for k in keys]), strict=True):
        assert key not in new and re.fullmatch(rf"key {key[:3]}\S{{{len(key) - 3}}} here", new)


def test_rest_is_untouched(spark, sf):
    docs = table(spark, sf, "documents")
    both = replace_pii(docs, "k").withColumnRenamed("text", "new")
    rows = both.join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == docs.count() and any(r.n_pii for r in rows)
    pattern = re.compile(r"[^\W]*[\w.%+-]+@[\w.-]+\.\w+|\b(?:\d{1,3}\.){3}\d{1,3}\b|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b|\b[0-9a-fA-F]{40}\b")
    for r in rows:
        old, new = r.text or "", r.new or ""
        assert (r.text is None) == (r.new is None)
        assert pattern.sub("#", old) == pattern.sub("#", new)
        assert not set(pattern.findall(old)) & set(pattern.findall(new))
        assert bool(pattern.search(old)) == bool(r.n_pii)


def test_odd_rows_and_plan(spark):
    assert run(spark, [None, "", "no data 12 3.4", "x" * 200000 + " a@b.cc"])[:3] == [None, "", "no data 12 3.4"]
    df = spark.createDataFrame([(1, "a@b.cc 1"), (1, "zz@b.cc 2"), (None, "a@b.cc 3"), (None, None)], "doc_id long, text string")
    got = [r.text for r in replace_pii(df, "k").collect()]
    assert len(got) == 4 and len({t.split()[0] for t in got if t}) == 2 and not any("b.cc" in t for t in got if t)
    assert replace_pii(df.limit(0), "k").collect() == []
    clash = df.selectExpr("*", *(f"'{c}' AS {c}" for c in ("rid", "row", "found", "names", "m", "kind", "canon", "word", "name_rid", "n_pii")))
    rows = replace_pii(clash, "k").collect()
    assert len(rows) == 4 and all(r.rid == "rid" and r.row == "row" and r.names == "names" and r.n_pii in (0, 1) for r in rows)
    plan = replace_pii(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
