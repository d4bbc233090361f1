"""Queries with a SQL twin, and the parts of the other two native operators that plain Python can restate."""

import random

import pytest

from liftwise.llm import queries
from liftwise.llm.sharding import fill_table, lookup_table, place, write_shards
from liftwise.llm.url_filter import filter_urls
from tests.oracle import compare, connect

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query(spark, name):
    assert compare(spark, connect(DATA), queries.QUERIES[name], queries.ORACLES[name], DATA) is None


def test_table_is_even_and_stable(spark):
    names = [f"s{i}" for i in range(10)]
    table = fill_table(names, 1009)
    counts = [table.count(i) for i in range(10)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == 1009
    less = fill_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, less) if a != 9)
    assert moved < 0.1 * 1009
    rows = {r.slot: r.shard for r in lookup_table(spark, names, 1009).collect()}
    assert rows == {i: names[o] for i, o in enumerate(table)}
    for wrong in ((names, 1000), ([], 7), (["a", "a"], 7), (names, 7)):
        with pytest.raises(ValueError):
            fill_table(*wrong)


def test_odd_keys_are_placed(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x", 5), (1, "x", 5), (None, None, 6)], "doc_id long, shard string, slot int")
    got = place(docs, "doc_id", ["only", "näme, with comma"], 13).collect()
    assert len(got) == 3 and len({r.shard for r in got if r.doc_id == 1}) == 1 and all(0 <= r.slot < 13 for r in got)
    assert place(docs.limit(0), "doc_id", ["a"], 13).count() == 0
    write_shards(docs, f"{tmp_path}/out", "doc_id", ["a", "b"], 13)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def brute_rule(url, rules):
    rest = url.partition("://")[2] if "://" in (url or "") else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r, _ in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return host, path, max(sorted(fits), key=len, default=None)


def test_urls(spark):
    rules, says = queries.URL_RULES, dict(queries.URL_RULES)
    rng = random.Random(1)
    urls = [None, "", "x", "http://", "HTTP://WWW.Example.ORG/es/1?x", "http://a.org", "http://org/", "a://b.com/de/\nx#q", "http://example.org/en/12", "http://h?a/b", "b://c://d/e", "http://É.org/"]
    urls += [f"http://{rng.choice(('a', 'b', 'c'))}{i}.example.{rng.choice(('org', 'com', 'net'))}/{rng.choice(('es', 'fr', 'de', 'en'))}/{rng.randrange(99)}" for i in range(300)]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls + urls[:20])], "page_id long, url string, host string")
    got = filter_urls(pages, rules).collect()
    assert len(got) == len(urls) + 20
    for r in got:
        host, path, rule = brute_rule((urls + urls)[r.page_id], rules)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
        assert rule is None or r.verdict == says[rule]
    # French paths are only ever accepted, German ones only ever rejected by rules; the model follows for hosts without a rule.
    free = {lang: [r.verdict for r in got if r.rule is None and f"/{lang}/" in r.path] for lang in ("fr", "de")}
    share = {lang: v.count("allow") / len(v) for lang, v in free.items()}
    assert share["fr"] > 0.8 and share["de"] < 0.6
    assert filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in filter_urls(pages.where("page_id in (9, 10)"), rules).collect()} <= {"allow", "block"}
