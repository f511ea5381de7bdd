import re

import duckdb
import pytest
from pyspark.sql import functions as F

from probity.llm import pii

SF = "/root/testdata/sf0.01"
TEXT = (
    "Mail anna.b.34@mail7.example.com, ANNA.B.34@mail7.example.com; IP 139.38.82.176### and +1 (017) 555-7713, +1 017 555 7713. Card 4111 1111 1111 1111 or 4111111111111111$$$ "
    "SSN 123-45-6789. Frau Müller met Mrs Anna Smith, Mr John Smith and Dr SMITH; г-жа Анна Петрова. IBAN DE89 3704 0044 0532 0130 00. 1.2.3.4.5 x1234567890123456 no"
)


def run(spark, rows):
    return {r["doc_id"]: (r["text"], r["n_entities"]) for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_kinds_forms_and_coreference(spark):
    text, n = run(spark, [(1, TEXT)])[1]
    assert n == 14
    for gone in ("anna", "139.38.82.176", "7713", "4111 1", "41111", "-6789", "Müller", "Smith", "SMITH", "Анна", "Петрова", "3704"):
        assert gone not in text, (gone, text)
    mails = re.findall(r"([a-z]+\.[0-9]{2}@[a-z]+\.example)", text)
    assert len(mails) == 2 and mails[0] == mails[1]
    phones = re.findall(r"\+1 \((\d{3})\) (\d{3})-(\d{4}), \+1 (\d{3}) (\d{3}) (\d{4})\.", text)[0]
    assert phones[:3] == phones[3:]
    spaced, plain = re.findall(r"Card (4\d{3} \d{4} \d{4} \d{4}) or (4\d{15})\$\$\$", text)[0]
    assert spaced.replace(" ", "") == plain and sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(plain)))) % 10 == 0
    assert re.search(r"SSN \d{3}-\d{2}-\d{4}\.", text) and re.search(r"IBAN DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d\.", text)
    assert text.endswith("1.2.3.4.5 x1234567890123456 no")
    one, two, three = re.search(r"Mrs [A-Z][a-z]+a ([A-Z][a-z]+), Mr [A-Z][a-z]+n ([A-Z][a-z]+) and Dr ([A-Z]+);", text).groups()
    assert one == two == three.capitalize()
    assert re.search(r"г-жа [А-Я][а-я]+а [А-Я][а-я]+\.", text)


def test_collisions_draw_again(spark, monkeypatch):
    # a tiny range of addresses: 60 entities and 90 surrogates
    monkeypatch.setattr(pii, "_ip", lambda unit, draw, key: F.concat(F.lit("9.9.9."), (F.conv(F.substring(pii._hex(unit, draw, 0, key), 1, 6), 16, 10).cast("int") % 90).cast("string")))
    rows = [(i, f"a 10.0.0.{i} b 10.0.0.{(i + 1) % 60}") for i in range(60)] + [(100, "9.9.9.7")]
    for rows_most in (0, 1000):
        monkeypatch.setattr(pii, "BROADCAST_ROWS", rows_most)
        got = run(spark, rows)
        first = {i: got[i][0].split()[1] for i in range(60)}
        assert len(set(first.values())) == 60 and all(got[i][0].split()[3] == first[(i + 1) % 60] for i in range(60))
        assert "9.9.9.7" not in first.values()


def test_query_replaces_all_and_leaves_the_rest(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    out = {r["doc_id"]: r for r in pii.query(spark, SF).collect()}
    assert set(out) == set(texts)
    plain = re.compile(r"(?<![\w.%+-])[\w.%+-]+@[\w.-]+\.[a-z]{2,}|(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\w)|(?<![\w+])\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\w-])\d{13,19}(?!\w)")
    maps = {}
    for d, t in texts.items():
        want, new = plain.findall(t), out[d]["text"]
        if out[d]["n_entities"] == 0:
            assert new == t and not want
        mine = plain.findall(new)
        assert len(mine) == len(want) <= out[d]["n_entities"] and plain.sub("@", t).count("@") == plain.sub("@", new).count("@")
        for a, b in zip(want, mine, strict=True):
            assert maps.setdefault(a, b) == b and a != b
    assert len(set(maps.values())) == len(maps) > 20


def test_cases(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "word " * 30_000 + "a@b.com", "k"), (3, "a@b.com", "k"), (3, "a@b.com", "k"), (None, "no entity", "k")], "doc_id long, text string, n_entities string")
    out = pii.replace(df)
    assert out.columns == ["doc_id", "text", "n_entities", "_n_entities"]
    rows = [(r[0], r[1], r[3]) for r in out.collect()]
    assert (1, None, 0) in rows and (2, "", 0) in rows and (None, "no entity", 0) in rows
    short = [t for d, t, n in rows if d == 3 and len(t) < 100]
    assert len(short) == 2 and short[0] == short[1] and any(t.endswith(short[0]) and len(t) > 100 for d, t, n in rows if d == 3)
    assert pii.replace(df.limit(0)).count() == 0


def test_no_python_on_the_way(spark):
    plan = pii.replace(spark.createDataFrame([(1, "a@b.com")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("digits, good", [("4111111111111111", True), ("4111111111111112", False)])
def test_luhn(spark, digits, good):
    assert (spark.range(1).select(pii._luhn(F.lit(digits))).first()[0] == 0) == good


NUMBERS = ("+33 1 23 45 67 89", "+61 2 9374 4000", "+49 30 123456", "+49 (0)30 123456", "+358 (9) 1 2345678", "+1 (017) 555-7713", "+4930123456", "+1 2 3 4 5 6 7", "+44 20 7946 0958", "+86 123456789012")


@pytest.mark.parametrize("after", ["", ".", " and 5 more", ", 12", ") 34 56"])
def test_phone_numbers_are_replaced_whole(spark, after):
    rows = run(spark, [(i, f"call {n}{after}") for i, n in enumerate(NUMBERS)])
    for i, n in enumerate(NUMBERS):
        text, count = rows[i]
        new = text[5 : 5 + len(n)]
        assert count == 1 and text == f"call {new}{after}" and re.sub("[0-9]", "0", new) == re.sub("[0-9]", "0", n), (n, text)
        found = spark.range(1).select(pii.matches(F.lit(f"call {n}{after}"))).first()[0]
        assert found == [n]


def test_phone_numbers_next_to_other_numbers(spark):
    cases = {
        "+49 30 123456 4111 1111 1111 1111": ["+49 30 123456", "4111 1111 1111 1111"],
        "+49 30 123456 192.168.1.10": ["+49 30 123456", "192.168.1.10"],
        "+33 1 23 45 67 89 123-45-6789": ["+33 1 23 45 67 89", "123-45-6789"],
        "+33 1 23 45 67 89 +61 2 9374 4000": ["+33 1 23 45 67 89", "+61 2 9374 4000"],
        "+1 (017) 555-7713 1000 2000 3000": ["+1 (017) 555-7713 1000"],
        "a+1 2 3 and +1 2": [],
    }
    for text, want in cases.items():
        found, kinds = spark.range(1).select(pii.matches(F.lit(text)).alias("m")).select("m", F.transform("m", pii.kind_of)).first()
        assert found == want and all((k == "phone") == (m[0] == "+") for m, k in zip(found, kinds, strict=True))


def test_one_person_has_one_surrogate_whatever_the_title(spark):
    rows = run(spark, [(1, "Mrs Anna Smith came. Dr Anna Smith spoke. Later Anna Smith left, and Smith slept; Anna too. Bananna Smithers stayed."), (None, "Rabbi Cohen and Prof Anna Smith. My name is Ludwig van Beethoven."), (2, "Smith is nobody here.")])
    text, n = rows[1]
    first, given, surname = re.match(r"Mrs (([A-Z][a-z]+a) ([A-Z][a-z]+)) came", text).groups()
    assert text == f"Mrs {first} came. Dr {first} spoke. Later {first} left, and {surname} slept; {given} too. Bananna Smithers stayed." and n == 5
    other, n = rows[None]
    assert n == 3 and f"Prof {first}." in other and re.fullmatch(r"Rabbi (?!Cohen)[A-Z][a-z]+ and Prof \w+ \w+\. My name is (?!Ludwig)[A-Z][a-z]+ van (?!Beethoven)[A-Z][a-z]+\.", other)
    assert rows[2] == ("Smith is nobody here.", 0)


def test_surrogates_never_run_out(spark, monkeypatch):
    # ten surrogates for thirty numbers, until they get longer
    monkeypatch.setattr(pii, "_number", lambda unit, draw, key: F.repeat((F.conv(F.substring(pii._hex(unit, draw, 0, key), 1, 6), 16, 10).cast("int") % 10).cast("string"), F.lit(60)))
    rows = run(spark, [(i, f"SSN 123-45-67{i}") for i in range(10, 40)])
    new = {i: t.removeprefix("SSN ") for i, (t, _) in rows.items()}
    assert len(set(new.values())) == 30 and all(re.fullmatch(r"(\d)\1\1-\1\1-\1{4,}", t) for t in new.values()) and not set(new.values()) & {f"123-45-67{i}" for i in range(10, 40)}


def test_accounts_are_keyed_and_keep_valid_check_digits(spark):
    mod = lambda a: int("".join(str(int(c, 36)) for c in a[4:] + a[:4])) % 97
    account = "GB82WEST12345698765432"
    assert mod(account) == 1
    docs = spark.createDataFrame([(1, f"pay {account} or {account[:4]} WEST 1234 5698 7654 32 or GB00WEST12345698765432")], "doc_id long, text string")
    one, two = (pii.replace(docs, key).first()["text"] for key in ("k1", "k2"))
    found = re.fullmatch(r"pay (GB\d\d[A-Z]{4}\d{14}) or (GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d) or (GB\d\d[A-Z]{4}\d{14})", one)
    assert found and found[1] == found[2].replace(" ", "") and mod(found[1]) == 1 and found[1][4:8] != "WEST" and found[1] != found[3]
    assert one != two and one.split()[1][4:8] != two.split()[1][4:8]


def test_a_map_of_its_own_replaces_as_the_operator_does(spark):
    """An independent pass over the texts: entities by own expressions, each replaced by what its first place became, must give the operator's texts."""
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    out = {r["doc_id"]: r["text"] for r in pii.query(spark, SF).collect()}
    own = re.compile(r"(?<![\w.%+-])[\w.%+-]+@[\w.-]+\.[a-z]{2,}|(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\w)|(?<![\w+])\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\w-])\d{13,19}(?!\w)")
    became = {}
    for d, text in rows:
        for a, b in zip(own.findall(text), own.findall(out[d]), strict=True):
            became.setdefault(a.lower(), b.lower())
    other = [d for d, text in rows if own.sub(lambda m: became[m[0].lower()], text).lower() != out[d].lower()]
    assert len(became) > 20 and len(set(became.values())) == len(became) and not set(became) & set(became.values()) and not other


def test_no_numbers_of_other_kinds_and_no_clash_of_names(spark):
    df = spark.createDataFrame([("x", "+100 points, +12 345 and ask a@b.com, Mr Xi Li", 1, 2, 3, 4)], "text_facts string, text string, text_key long, text_key2 long, rewritten int, draws_id int")
    out = pii.replace(df)
    r = out.first()
    assert out.columns == [*df.columns, "n_entities"] and r["text"].startswith("+100 points, +12 345 and ask ") and r["n_entities"] == 2 and (r[0], r[2], r[3], r[4], r[5]) == ("x", 1, 2, 3, 4)
