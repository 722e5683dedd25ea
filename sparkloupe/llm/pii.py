"""Operator 5: personal data replaced by surrogates, with DataFrame functions only.

One regular expression finds e-mail addresses, access tokens, IBANs, network addresses, identity numbers,
telephone and card numbers and titled names.  A mention's canonical form (case and separators off) is the entity.

* Everything but names is permuted: a keyed Feistel network over the places of the canonical form, each place
  within its own kind (digits, the letters of one script and case, hexadecimal letters, octets).  A permutation
  gives different entities different surrogates whatever their number, without any table, and equal ones equal
  surrogates wherever they stand.  Country code and length of a telephone number, country of an IBAN, prefix of a
  token, first digit of a card and last label of a mail domain stay; check digits of cards and IBANs are right
  where they were right (and wrong alike where they were wrong); mail addresses get the reserved end `.example`.
* Names are replaced word by word, so `Mr Smith` and `Mr John Smith` keep one surname: given names from the list
  of the gender that the title (or another title of that given name) tells, surnames of syllables, both in the
  script of the word, with the ending of the gender where the script has one; words of other scripts are permuted.
  Words that draw the same surrogate, or one that is itself a name of the table, draw again, a syllable longer
  each time, until none does: names never run out, so this ends.

A mention is written in its own format: its separators, its title, and capitals where it is all capitals.

Only rows with a mention are stored and exchanged, and of these only the words of names meet the table of names;
very frequent names are joined in parts.  The key is the caller's: who has it can tell which surrogate stands for
which guess, so the registered query takes it from the session and otherwise draws one for the run.

Cases: null, empty and mention-free texts come back unchanged; repeated rows and shared or null ids are rows like
others; all columns of the input are kept, whatever their names (one named like the count column is replaced); a
very long text is one row with as many mentions as it holds; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloupe.llm.common import discard, stored, table

KEY_SETTING = "spark.sparkloupe.surrogateKey"
#: Parts in which the mentions of a name word are joined with its surrogate.
SALTS = 16
ROUNDS = 4

_TITLES_F = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа", "г-жа", "Госпожа", "госпожа")
_TITLES_M = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "г-н", "Господин", "господин")
_TITLES_N = ("Dr", "Prof")
_TITLE = r"(?:" + "|".join(sorted((*_TITLES_F, *_TITLES_M, *_TITLES_N), key=len, reverse=True)) + r")\.?"
_NAME = r"[\p{Lu}][\p{L}'’-]+"

PATTERNS = (
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"),
    ("token", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[A-Fa-f0-9]{32,})(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("address", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?![0-9]|\.[0-9])"),
    ("identity", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", r"(?<![A-Za-z0-9+(])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])|(?<![A-Za-z0-9(])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])"),
    ("card", r"(?<![0-9.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"),
    ("name", rf"(?<![\p{{L}}\p{{N}}]){_TITLE} {_NAME}(?: (?!{_TITLE}(?: |$)){_NAME}){{0,2}}"),
)
PATTERN = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: What every mention holds; a cheap test before the whole pattern runs.
_HINT = rf"[0-9@]|AKIA|gh[pousr]_|sk-|(?:{_TITLE}) \p{{Lu}}"

#: Given names by script and gender, and syllables of surnames.
_GIVEN = {
    "latin": {"f": "Anna Clara Emma Julia Laura Maria Nora Sofia Helen Irene Paula Rita", "m": "Adam Bruno David Felix Hugo Jonas Leo Martin Oscar Paul Simon Victor", "": "Alex Chris Jamie Kim Robin Sascha Taylor Jordan"},
    "cyrillic": {"f": "Анна Вера Елена Ирина Мария Нина Ольга Софья", "m": "Антон Борис Виктор Иван Максим Олег Павел Юрий", "": "Саша Женя Валя Слава"},
}
_SYLLABLES = {"latin": "bar bel bor dal den dor fal fen gar hal ker lan mor nel par ros sel tar ven wil", "cyrillic": "бор вет гор дан зар кал лун мир нов пал рос сел тар фед хар яр"}
#: First code point and number of the characters that stand for one another.
_ALPHABETS = (
    (0x30, 10), (0x41, 26), (0x61, 26), (0xC0, 23), (0xD8, 7), (0xDF, 24), (0xF8, 7), (0x388, 3), (0x391, 17), (0x3A3, 7), (0x3AC, 4), (0x3B1, 25), (0x3CA, 5), (0x400, 16), (0x410, 32), (0x430, 32), (0x450, 16), (0x561, 38), (0x5D0, 27), (0x628, 19), (0x641, 10),
    (0x915, 37), (0xE01, 46), (0x10D0, 33), (0x3041, 86), (0x30A1, 90), (0x4E00, 20902), (0xAC00, 11172),
)
_HEXADECIMAL = ((0x30, 10), (0x41, 6), (0x61, 6))
#: Telephone country codes of one and of two digits; all others have three.
_COUNTRY_CODE = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def surrogate_key(spark: SparkSession) -> str:
    """The session's key, or a new one."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(16)


def _draw(*parts: Column) -> Column:
    """A number from the keyed hash of the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, 8), 16, 10).cast("long")


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _permuted(key: str, kind: str, values: Column, sizes: Column) -> Column:
    """Numbers, each below its size, by a Feistel network of additions: a permutation of all such arrays."""
    half = F.floor(F.size(values) / 2).cast("int")
    left, right = lambda x: F.slice(x, F.lit(1), half), lambda x: F.slice(x, half + 1, F.size(x) - half)
    start = F.struct(left(values).alias("l"), right(values).alias("r"), left(sizes).alias("m"), right(sizes).alias("n"))

    def step(a: Column, k: Column) -> Column:
        seed = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), k.cast("string"), F.array_join(F.transform(a["r"], lambda x: x.cast("string")), ",")), 256)
        new = F.transform(a["l"], lambda x, i: F.pmod(x + _draw(seed, i), F.element_at(a["m"], i + 1)))
        return F.struct(a["r"].alias("l"), new.alias("r"), a["n"].alias("m"), a["m"].alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda a: F.concat(a["l"], a["r"]))


def _shape(key: str, kind: str, text: Column, alphabets: tuple[tuple[int, int], ...] = _ALPHABETS) -> Column:
    """Digits for digits, letters for letters of the same script and case; the rest stays."""

    def place(c: Column) -> Column:
        code = F.ascii(c)
        first, size = F.lit(None).cast("int"), F.lit(None).cast("int")
        for a, n in alphabets:
            inside = (code >= a) & (code < a + n)
            first, size = F.coalesce(first, F.when(inside, F.lit(a))), F.coalesce(size, F.when(inside, F.lit(n)))
        return F.struct(c.alias("c"), F.coalesce(first, code).cast("long").alias("first"), F.coalesce(size, F.lit(1)).cast("long").alias("size"), code.cast("long").alias("code"))

    def written(x: Column, new: Column) -> Column:
        code = x["first"] + new
        return F.when(x["size"] == 1, x["c"]).when(code < 128, F.chr(code)).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE"))

    places = F.transform(_chars(text), place)
    return _bound(places, lambda p: F.array_join(F.zip_with(p, _permuted(key, kind, F.transform(p, lambda x: x["code"] - x["first"]), F.transform(p, lambda x: x["size"])), written), ""))


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _luhn_sum(digits: Column) -> Column:
    """Sum of a digit string by Luhn's rule, as if a check digit followed it."""
    turned = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 0, F.lit(2)).otherwise(F.lit(1)) * c.cast("int"))
    return F.aggregate(turned, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))


def _check(digits: Column) -> Column:
    return (F.lit(10) - _luhn_sum(digits) % 10) % 10


def _card(key: str, text: Column) -> Column:
    inner = _shape(key, "card", F.substr(text, F.lit(2), F.length(text) - 2))
    off = F.pmod(F.substring(text, -1, 1).cast("int") - _check(F.substr(text, F.lit(1), F.length(text) - 1)), F.lit(10))
    return _bound(F.concat(F.substring(text, 1, 1), inner), lambda new: F.concat(new, F.pmod(_check(new) + off, F.lit(10)).cast("string")))


def _iban_digits(body: Column, country: Column) -> Column:
    """The right check digits, as a number of 2 to 98."""

    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (a * 10 + code - 48) % 97).otherwise((a * 100 + code - 55) % 97)

    return F.lit(98) - F.aggregate(_chars(F.concat(body, country, F.lit("00"))), F.lit(0), step)


def _iban(key: str, text: Column) -> Column:
    country, digits, body = F.substring(text, 1, 2), F.substring(text, 3, 2).cast("int"), F.substr(text, F.lit(5))

    def whole(new: Column) -> Column:
        moved = F.pmod(digits - _iban_digits(body, country) + _iban_digits(new, country) - 2, F.lit(97)) + 2
        check = F.when(digits.between(2, 98), moved).otherwise(digits)
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), new)

    return _bound(_shape(key, "iban", body), whole)


def _headed(key: str, kind: str, text: Column, head: Column, alphabets: tuple[tuple[int, int], ...] = _ALPHABETS) -> Column:
    """The head stays, the rest is permuted for itself."""
    return F.concat(head, _shape(key, kind, F.substr(text, F.length(head) + 1), alphabets))


def _address(key: str, text: Column) -> Column:
    octets = F.transform(F.split(text, r"\."), lambda x: x.cast("long"))
    return F.array_join(F.transform(_permuted(key, "address", octets, F.transform(octets, lambda x: F.lit(256).cast("long"))), lambda x: x.cast("string")), ".")


def _email(key: str, text: Column) -> Column:
    end = F.regexp_extract(text, r"\.[^.]*$", 0)
    return F.concat(_shape(key, "email", F.substr(text, F.lit(1), F.length(text) - F.length(end))), end, F.lit(".example"))


def _surrogate(key: str, kind: Column, mention: Column, text: Column) -> Column:
    """Of an entity that is no name."""
    known = F.regexp_extract(text, r"^(?:AKIA|gh[pousr]_|sk-)", 0)
    token = F.when(F.rlike(text, F.lit("^[A-Fa-f0-9]+$")), _shape(key, "hexadecimal", text, _HEXADECIMAL)).otherwise(_headed(key, "token", text, known))
    code = F.when(F.startswith(mention, F.lit("+")), F.regexp_extract(text, _COUNTRY_CODE, 0)).otherwise("")
    return (
        F.when(kind == "email", _email(key, text)).when(kind == "token", token).when(kind == "iban", _iban(key, text)).when(kind == "address", _address(key, text))
        .when(kind == "identity", _shape(key, "identity", text)).when(kind == "phone", _headed(key, "phone", text, code)).when(kind == "card", _card(key, text))
    )


def _kind(mention: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in PATTERNS:
        out = F.coalesce(out, F.when(F.rlike(mention, F.lit(f"^(?:{pattern})$")), F.lit(name)))
    return out


def _canon(kind: Column, mention: Column) -> Column:
    plain = F.regexp_replace(mention, "[^A-Za-z0-9]", "")
    name = F.lower(F.regexp_replace(mention, rf"^{_TITLE} ", ""))
    return F.when(kind == "email", F.lower(mention)).when(kind.isin("token", "address"), mention).when(kind == "name", name).otherwise(plain)


def _gender(mention: Column) -> Column:
    title = F.regexp_extract(mention, rf"^({_TITLE}) ", 1)
    plain = F.regexp_replace(title, r"\.", "")
    return F.when(plain.isin(*_TITLES_F), "f").when(plain.isin(*_TITLES_M), "m").otherwise("")


def _poured(mention: Column, text: Column) -> Column:
    """The surrogate's characters in the places of the mention's letters and digits."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))

    def step(a: Column, c: Column) -> Column:
        plain = F.rlike(c, F.lit("[A-Za-z0-9]"))
        return F.struct(F.concat(a["s"], F.when(plain, F.substr(text, a["k"], F.lit(1))).otherwise(c)).alias("s"), (a["k"] + F.when(plain, 1).otherwise(0)).alias("k"))

    return F.aggregate(_chars(mention), start, step, lambda a: a["s"])


def _written(kind: Column, mention: Column, text: Column) -> Column:
    """The surrogate of an entity that is no name, in the mention's own format."""
    loud = (F.upper(mention) == mention) & (F.lower(mention) != mention)
    return F.when(kind == "email", F.when(loud, F.upper(text)).otherwise(text)).when(kind.isin("token", "address"), text).otherwise(_poured(mention, text))


def _script(word: Column) -> Column:
    return F.when(F.rlike(word, F.lit(r"\p{IsCyrillic}")), "cyrillic").when(F.rlike(word, F.lit(r"[\p{L}&&[^\p{IsLatin}]]")), "other").otherwise("latin")


def _new_word(key: str, least: int) -> Column:
    """The surrogate of a name word (role, gender, script, word) at its attempt: a syllable more with every attempt."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), "role", "gender", "word", F.col("attempt").cast("string")), 256)
    pick = lambda a, *at: F.element_at(a, (_draw(seed, *at) % F.size(a) + 1).cast("int"))

    def of(script: str) -> Column:
        syllables = F.array(*map(F.lit, _SYLLABLES[script].split()))
        given = F.lit(None).cast("array<string>")
        for g, names in _GIVEN[script].items():
            given = F.coalesce(given, F.when(F.col("gender") == g, F.array(*map(F.lit, names.lower().split()))))
        tail = lambda n: F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: pick(syllables, k)), "")).otherwise("")
        return F.when(F.col("role") == "given", F.concat(pick(given, F.lit("g")), tail(F.when(F.col("attempt") == 0, 0).otherwise(F.col("attempt") + least - 3)))).otherwise(tail(F.col("attempt") + least))

    return F.when(F.col("script") == "cyrillic", of("cyrillic")).when(F.col("script") == "latin", of("latin")).otherwise(_shape(key, "name", F.col("word")))


def name_words(words: DataFrame, key: str) -> DataFrame:
    """(role, title_gender, word, new) for the distinct (role, title_gender, word) of a table of name words."""
    seen = stored(words.select("role", "title_gender", "word").distinct(), "pii-words")
    known = seen.where("role = 'given'").groupBy("word").agg(F.max("title_gender").alias("known"))
    # a given name without a telling title takes the gender that another title gives it; surnames have none
    gender = F.when(F.col("role") == "surname", "").when(F.col("title_gender") != "", F.col("title_gender")).otherwise(F.coalesce("known", F.lit("")))
    seen_as = stored(seen.join(known, "word", "left").withColumn("gender", gender).drop("known"), "pii-words")
    entities = seen_as.select("role", "gender", "word").distinct().withColumns({"script": _script(F.col("word")), "attempt": F.lit(0)})
    # so many syllables that a clash is rare, and never fewer than three
    least = max(3, math.ceil(math.log(8 * max(1, seen_as.count()), 16)))
    now = stored(entities.withColumn("new", _new_word(key, least)), "pii-names")
    real = stored(now.select("role", F.col("word").alias("new")).distinct(), "pii-real")
    while True:
        # a surrogate belongs to its first word, unless it is itself a name of the table; permuted words never clash
        drawn = now.where("script <> 'other'")
        first = drawn.groupBy("role", "script", "new").agg(F.min(F.struct("attempt", "word", "gender")).alias("first"))
        clash = drawn.join(first, ["role", "script", "new"]).where(F.col("first") != F.struct("attempt", "word", "gender")).select("role", "gender", "word")
        own = drawn.join(real, ["role", "new"], "left_semi").select("role", "gender", "word")
        again = stored(clash.union(own).distinct(), "pii-clashes")
        if again.isEmpty():
            break
        redo = now.join(again.withColumn("redo", F.lit(1)), ["role", "gender", "word"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("redo", F.lit(0)))
        last, now = now, stored(redo.withColumn("new", F.when(F.col("redo") == 1, _new_word(key, least)).otherwise(F.col("new"))).drop("redo"), "pii-names")
        discard(last, again)
    return seen_as.join(now.select("role", "gender", "word", "script", "new"), ["role", "gender", "word"]).select("role", "title_gender", "word", "script", "new")


def _named(found: DataFrame, key: str) -> DataFrame:
    """(rid, mention, written) of the names that a table (rid, found: array of (m, kind)) holds."""
    each = found.select("rid", F.explode(F.array_distinct(F.filter("found", lambda x: x["kind"] == "name"))).alias("x")).select("rid", F.col("x.m").alias("mention"))
    plain = F.regexp_replace("mention", rf"^{_TITLE} ", "")
    each = each.withColumns({"title_gender": _gender(F.col("mention")), "words": F.split(F.lower(plain), " ")})
    words = each.select("rid", "mention", "title_gender", F.size("words").alias("n"), F.posexplode("words").alias("k", "word"))
    words = words.withColumns({"role": F.when(F.col("k") == F.col("n") - 1, "surname").otherwise("given"), "salt": F.pmod(F.xxhash64("rid"), F.lit(SALTS))})
    words = stored(words, "pii-name-words")
    lookup = name_words(words, key)
    by = ["role", "title_gender", "word"]
    parts = words.select(*by, "salt").distinct().join(lookup, by)
    back = words.join(parts, [*by, "salt"])
    feminine = F.when(F.col("title_gender") == "f", "ова").otherwise("ов")
    new = F.concat("new", F.when((F.col("role") == "surname") & (F.col("script") == "cyrillic"), feminine).otherwise(""))
    whole = back.groupBy("rid", "mention").agg(F.array_sort(F.collect_list(F.struct("k", new.alias("w")))).alias("new"))
    text = F.array_join(F.transform("new", lambda x: x["w"]), " ")
    shout = (F.upper(plain) == plain) & (F.length(plain) > 1)
    return whole.select("rid", "mention", F.concat(F.regexp_extract("mention", rf"^{_TITLE} ", 0), F.when(shout, F.upper(text)).otherwise(F.initcap(text))).alias("written"))


def replace_pii(docs: DataFrame, key: str, *, text_col: str = "text", count_col: str = "n_pii") -> DataFrame:
    """The input with its text's personal data replaced, and the number of mentions."""
    keep = [c for c in docs.columns if c != count_col]
    text = docs[text_col]
    hint = F.rlike(text, F.lit(_HINT))
    rest = docs.where(~F.coalesce(hint & F.rlike(text, F.lit(PATTERN)), F.lit(False))).select(*keep, F.lit(0).alias(count_col))
    mentions = F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda m: F.struct(m.alias("m"), _kind(m).alias("kind")))
    found = docs.where(hint).select(F.struct(*keep).alias("row"), mentions.alias("found"))
    found = stored(found.where(F.size("found") > 0).withColumn("rid", F.monotonically_increasing_id()), "pii-found")
    names = _named(found, key).groupBy(F.col("rid").alias("name_rid")).agg(F.map_from_entries(F.collect_list(F.struct("mention", "written"))).alias("names"))
    none = F.create_map().cast("map<string,string>")

    def with_canon(x: Column) -> Column:
        return F.struct(x["m"].alias("m"), x["kind"].alias("kind"), _canon(x["kind"], x["m"]).alias("canon"))

    def with_new(x: Column) -> Column:
        return F.struct(x["m"].alias("m"), x["kind"].alias("kind"), _surrogate(key, x["kind"], x["m"], x["canon"]).alias("new"))

    both = found.join(names, F.col("rid") == F.col("name_rid"), "left").select("row", "found", F.coalesce("names", none).alias("names"))
    new = F.transform(F.transform(F.transform("found", with_canon), with_new), lambda x: F.when(x["kind"] == "name", F.try_element_at(F.col("names"), x["m"])).otherwise(_written(x["kind"], x["m"], x["new"])))
    between = F.split(F.col(f"row.{text_col}"), PATTERN, -1)
    whole = F.array_join(F.flatten(F.zip_with(between, new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    done = both.select(*(whole.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in keep), F.size("found").alias(count_col))
    return rest.union(done)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), surrogate_key(spark))
