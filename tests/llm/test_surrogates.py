import time

import regex

from liftwise.llm.surrogates import PATTERN, _core, _replacement, assign_surrogates, replace_entities

DATA = "/root/testdata/sf0.01"
FOUND = regex.compile(PATTERN)


def shape(value):
    return regex.sub(r"\p{Lu}", "A", regex.sub(r"\p{Ll}", "a", regex.sub(r"[0-9]", "0", value)))


def test_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    old = {r.doc_id: r.text for r in docs.collect()}
    new = {r.doc_id: r for r in replace_entities(docs, "k", count_col="n").collect()}
    assert old.keys() == new.keys()
    pairs = set()
    for key, text in old.items():
        values = FOUND.findall(text)
        assert new[key].n == len(values)
        rest, at = FOUND.split(text), 0
        out = new[key].text
        assert out.startswith(rest[0]) and out.endswith(rest[-1])
        again = FOUND.findall(out)
        assert FOUND.split(out) == rest and len(again) == len(values)
        pairs |= set(zip(values, again))
    forward, back = dict(pairs), {b: a for a, b in pairs}
    assert len(pairs) > 30 and len(forward) == len(pairs) == len(back)
    assert not set(forward) & set(back)
    for a, b in pairs:
        if "@" in a:
            assert shape(a).split("@")[0].lower() == shape(b).split("@")[0].lower()
        elif a[0].isdigit() and a.count(".") != 3 or a[0] in "+(":
            assert shape(a) == shape(b)


def test_formats_and_coreference(spark):
    texts = [
        "call +1 (017) 555-7713 or (017) 555-7713 or 017-555-7713.",
        "4111 1111 1111 1111 and 4111111111111111",
        "Mrs. Anna Berg met Herr Berg; Dr. Иван Петров",
        "10.1.2.3 192.168.7.9 8.8.8.8",
        None, "", "12 34", "Write to a.b@c.example.org, a.b@c.example.org", "Write to a.b@c.example.org, a.b@c.example.org",
        "x " * 200_000 + 'token = "0123456789abcdef0123456789abcdef"',
    ]
    df = spark.createDataFrame([(i % 9 or None, t, "pos", i) for i, t in enumerate(texts)], "doc_id long, text string, value string, h1 int")
    out = replace_entities(df, "k")
    assert out.columns == df.columns
    got = [r.text for r in out.orderBy("h1").collect()]
    digits = [regex.sub(r"\D", "", v)[-10:] for v in FOUND.findall(got[0])]
    assert len(set(digits)) == 1 and digits[0] != "0175557713" and got[0].startswith("call +1 (")
    one, two = FOUND.findall(got[1])
    assert one.replace(" ", "") == two
    total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(two)))
    assert total % 10 == 0
    names = regex.match(r"Mrs\. (\p{Latin}+) (\p{Latin}+) met Herr (\p{Latin}+); Dr\. (\p{Cyrillic}+) (\p{Cyrillic}+)$", got[2])
    assert names[2] == names[3] != "Berg" and names[1] != "Anna"
    assert regex.match(r"10\.\d+\.\d+\.\d+ 192\.168\.\d+\.\d+ (?!8\.8\.8\.8)", got[3])
    assert got[4:7] == [None, "", "12 34"] and got[7] == got[8] != texts[7]
    assert len(got[9]) == len(texts[9]) and got[9] != texts[9]
    assert [r.text for r in replace_entities(df, "other").orderBy("h1").collect()][0] != got[0]
    assert replace_entities(df.limit(0), "k").count() == 0


def test_clashes_are_drawn_again(spark):
    names = [(k, f"n{i}") for i in range(6000) for k in ("name:latin:s", "name:greek:f")]
    rows = assign_surrogates(spark.createDataFrame([*names, ("name:latin:s", None)][:-1], "kind string, canon string"), "k").collect()
    assert len(rows) == len(names) == len({(r.kind, r.core) for r in rows})


def test_letters_of_other_scripts(spark):
    values = ["анна@почта.рф", "олег@почта.рф", "νίκος@αβγ.gr", "山田@例え.jp", "դար@ab.am", "ᚠᚢᚦ@ab.com", "ᚠᚢᚨ@ab.com", "٣٤@ab.com", "ñandú@ab.com"]
    df = spark.createDataFrame([(i, f"to {v} now") for i, v in enumerate(values)], "doc_id long, text string")
    got = [r.text[3:-4] for r in replace_entities(df, "k").orderBy("doc_id").collect()]
    assert len(set(got)) == len(got) and not set(got) & set(values)
    assert all(regex.fullmatch(rf"{p}@{q}\.example\.com", v) for v, (p, q) in zip(got, [(r"\p{Cyrillic}{4}", r"\p{Cyrillic}{5}")] * 2 + [(r"\p{Greek}{5}", r"\p{Greek}{3}"), (r"\p{Han}{2}", r"\p{Han}\p{Hiragana}"), (r"\p{Armenian}{3}", "[a-z]{2}")]))
    assert regex.fullmatch(r"[٠-٩]{2}@[a-z]{2}\.example\.com", got[7])


def test_rooms_that_are_too_small_widen(spark):
    emails = [f"{a}@{b}.example.com" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    units = [("email", v) for v in emails] + [("secret", "--------")]
    rows = assign_surrogates(spark.createDataFrame(units, "kind string, canon string"), "k").collect()
    cores = {(r.kind, r.core) for r in rows}
    assert len(rows) == len(units) == len(cores) and not cores & set(units)
    tried = [("ip", "192.168.1.1", 0), ("ip", "192.168.1.1", 4), ("ip", "192.168.1.1", 8), ("ip", "8.8.8.8", 4), ("phone", "12345", 4)]
    cores = [r[0] for r in spark.createDataFrame(tried, "kind string, canon string, attempt int").select(_core("k")).collect()]
    for core, form in zip(cores, (r"192\.168(\.\d+){2}", r"10(\.\d+){3}", r"10(\.\d+){4}", r"\d+(\.\d+){4}", r"\d{6}")):
        assert regex.fullmatch(form, core)
    longer = [("+12345", "phone", "678901"), ("+1 (017) 555-7713", "phone", "98765432101"), ("123-45-6789", "ssn", "9876543210"), ("DE12 3456 7890", "iban", "DE9876543210Z")]
    shown = [r[0] for r in spark.createDataFrame([(*v, None) for v in longer], "value string, kind string, core1 string, core2 string").select(_replacement()).collect()]
    assert shown == ["+678901", "+1 (987) 654-32101", "987-65-43210", "DE98 7654 3210Z"]


def test_long_runs_of_marks_and_a_column_named_new(spark):
    runs = [mark * 200_000 + " ann.lee@site.org" for mark in "._%+-"] + ["a." * 100_000, "@" * 200_000, "555-123-4567.a@b.co", "+" * 3 + "x_y@mail.example.com"]
    docs = spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string").selectExpr("*", "doc_id as new", "text as h1")
    start = time.time()
    got = {r.doc_id: r for r in replace_entities(docs, "k", count_col="n").collect()}
    assert time.time() - start < 60
    assert [got[i].n for i in range(9)] == [1] * 5 + [0, 0, 1, 1]
    for i in range(5):
        assert got[i].text[:200_000] == runs[i][:200_000] and "ann.lee" not in got[i].text and got[i].new == i
    assert "a@b.co" not in got[7].text and "4567" not in got[7].text
