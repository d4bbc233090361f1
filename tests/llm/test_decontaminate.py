import re

from liftwise.llm.decontaminate import NUMBER_WORDS, UNIT_WORDS, find_leaks, without_leaks

DATA = "/root/testdata/sf0.01"
ITEM = "In the morning Anna Smith bought 12 red apples for 3 dollars each at the market, and later Anna Smith gave 12 of these to Peter near the old station."


def brute_template(text):
    out, last_kind, at = [], None, 0
    for m in re.finditer(r"(?:(?<=\d)[.,](?=\d)|[0-9A-Za-z\x80-\U0010ffff])+", text or ""):
        gap, w = text[at : m.start()], m.group()
        begins = at == 0 and not out or not re.fullmatch(r"[ ,\-'\t]*", gap)
        low = re.sub("[A-Z]", lambda c: c.group().lower(), w)
        if w[0] in "0123456789" or low in NUMBER_WORDS.split():
            kind = "number"
        elif last_kind == "number" and low in UNIT_WORDS.split():
            kind = "unit"
        elif re.match("[A-ZÀ-Þ]", w) and not begins:
            kind = "name"
        else:
            kind = "literal"
        if kind == "name" and last_kind == "name":
            out[-1] = (kind, out[-1][1] + (low,))
        else:
            out.append((kind, (low,)))
        last_kind, at = kind, m.end()
    return out


def brute_items(text, items):
    doc, found = brute_template(text), []
    place = {}
    for i in range(len(doc)):
        for n in range(5, 9):
            place.setdefault(tuple(v if k == "literal" else k for k, v in doc[i : i + n]), []).append(i)
    for item, body in items:
        own = brute_template(body)
        n = min(8, len(own))
        first = {}
        for i in range(len(own) - n + 1):
            key = tuple(v if k == "literal" else k for k, v in own[i : i + n])
            if sum(k == "literal" for k, _ in own[i : i + n]) >= 5:
                first.setdefault(key, i)
        runs = {}
        for key, i in first.items():
            for d in place.get(key, []):
                runs.setdefault(d - i, []).append(i)
        good = set()
        for shift, starts in runs.items():
            pairs = {(own[i + k][1], doc[i + shift + k][1]) for i in starts for k in range(n) if own[i + k][0] != "literal"}
            if len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
                good |= set(starts)
        if first and len(good) >= min(6, len(first)):
            found.append(item)
    return sorted(found)


def test_documents_match_brute_force(spark):
    docs, bench = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = {r.doc_id: r["items"] for r in find_leaks(docs, bench).collect()}
    items = [(r.item_id, r.text) for r in bench.collect()]
    heads = {i: set(re.findall(r"[a-z]{9,}", t.lower())) for i, t in items}
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for key, text in rows:
        have = set(re.findall(r"[a-z]{9,}", text.lower()))
        near = [(i, t) for i, t in items if not heads[i] or len(heads[i] & have) * 2 >= len(heads[i])]
        assert got[key] == brute_items(text, near)
    assert len(got) == docs.count() and sum(bool(v) for v in got.values()) > 15


def test_reparameterised_question(spark):
    again = ITEM.replace("Anna Smith", "Maria").replace("12", "40").replace("3 dollars", "7 euros").replace("Peter", "Ivan Petrov")
    mixed = again.replace("later Maria", "later Olga").replace("gave 40", "gave 41")
    docs = [(1, "Note. " + ITEM), (2, "x " + again + " y"), (3, mixed), (4, ITEM[:60]), (5, None), (6, ""), (7, ITEM), (7, ITEM), (None, again), (8, "lorem ipsum " * 50_000)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, h1 int")
    bench = spark.createDataFrame([(10, ITEM), (10, ITEM), (11, None), (12, ""), (None, "a short item of only seven words"), (13, "3 4 5")], "item_id long, text string")
    got = sorted(((r.doc_id or 0, r["items"]) for r in find_leaks(df, bench).collect()))
    assert got == sorted((d or 0, brute_items(t, [(10, ITEM), (13, "3 4 5")])) for d, t in docs)
    assert [r[0] for r in got if r[1]] == [0, 1, 2, 7, 7]
    kept = without_leaks(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 8]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert [tuple(r) for r in find_leaks(docs, bench.limit(0)).collect()] == [(1, False, 0, [])]
    assert find_leaks(docs.limit(0), bench).count() == 0 and without_leaks(docs, bench).count() == 0


def test_word_for_word_copies(spark):
    items = [
        (1, "Compute 12 + 7 * 3 - 45 / 9"),
        (2, "一个农夫有十七只羊除了九只以外都死了还剩几只羊"),
        (3, "Birds of this kind build their nests near water"),
        (4, "ÜBER 5 kg Öl und 3 l Milch, 7 Uhr"),
        (5, "?!"),
    ]
    docs = [
        (1, "He said: please compute 12 + 7 * 3 - 45 / 9 now"),
        (2, "题目：一个农夫有十七只羊，除了九只以外都死了。还剩几只羊？"),
        (3, "We know that Birds of this kind build their nests near water, or so"),
        (4, "da sind über 5 kg öl und 3 l milch, 7 uhr."),
        (5, "He said: please compute 12 + 7 * 3 - 46 / 9 now ?!"),
        (6, "一个农夫有羊 compute 12 7"),
        (7, "compute 12 + 7 * 3 -"),
        (8, "45 / 9 compute 12"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r["items"] for r in find_leaks(df, bench).collect()}
    assert got == {1: [1], 2: [2], 3: [3], 4: [4], 5: [], 6: [], 7: [], 8: []}


def test_contradicting_slots_drop_their_windows_only(spark):
    said = ["the old miller sold", "ground the flour for", "carried it along the river to", "came back with the cart for", "rested near the bridge before"]
    long = " ".join(f"then Anna {s} 12 sacks while the rain fell" for s in said)
    words = ITEM.replace("12", "5").replace("for 3 dollars", "for 5 euros").replace("Anna Smith", "Maria").replace("Peter", "Ivan")
    twice = "We know that the farmer has 3 brown cows and that the miller has 3 white goats behind the barn today"
    docs = [
        (1, "x " + long[::-1].replace("21", "31", 1)[::-1] + " y"),
        (2, "x " + words + " y"),
        (3, twice.replace("3 brown", "5 brown").replace("3 white", "7 white")),
        (4, twice.replace("3 brown", "5 brown").replace("3 white", "5 white")),
        (5, "We know that the farmer has 3 brown cows"),
    ]
    bench = spark.createDataFrame([(1, long), (2, ITEM), (3, twice)], "item_id long, text string")
    got = {r.doc_id: r["items"] for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got[1] == [1] and got[2] == [2] and got[4] == [3] and got[5] == []
