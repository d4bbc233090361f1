"""Secret scan against the same rules run one by one with Python's regular expressions."""

import random
import re

import pytest

from liftwise.llm.automaton import compile_patterns
from liftwise.llm.secret_scan import RULES, Rule, find_secrets

PARTS = ["password", "PassWD", "secret", "token", "api_key", "APIkey", '"', "'", " ", "  ", ":", "=", "abcdef0123456789", "deadbeef", "AKIA", "AKIAABCDEFGH1234XY", "é", "漢", "gh", "ghp_",
         "-----BEGIN", " RSA", " PRIVATE KEY-----", "a", "0", "Z", "_", "-", "xoxb-", "sk_live_", "AIza", "x" * 12, "A1" * 9, "\n", "\x00"]


def brute(text, rules=RULES):
    found = []
    for k, rule in enumerate(rules):
        pattern = re.compile(rule.pattern.replace("(?<value>", "(?P<value>").replace("(?i:", "(?ai:"))
        for m in pattern.finditer(text or ""):
            value = m.start("value") if "value" in pattern.groupindex else m.start()
            if m.end() - value >= rule.least:
                found.append((m.start(), k, m.end(), value))
    return [(rules[k].kind, start, end, value) for start, k, end, value in sorted(found)]


def test_scan(spark):
    rng = random.Random(4)
    texts = [None, "", "é" * 30 + "token=" + "é", "secret=token:abcdefghijklmnop", "token==abcdefghijkl", "AKIAKIA" + "B" * 13, "f" * 15, "f" * 16]
    texts += ["".join(rng.choice(PARTS) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["deadbeef" * 60_000, "password: " + "k" * 400_000 + " AKIA" + "Q" * 300_000, "x " * 200_000 + "token=abcdefghijklm"]
    docs = spark.createDataFrame([(i if i else None, t, "kept") for i, t in enumerate(texts + texts[:50])], "doc_id long, text string, kind string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in find_secrets(docs, ["doc_id", "kind"]).collect()}
    for i, text in enumerate(texts + texts[:50]):
        assert got[i if i else None] == brute(text), repr(text)[:200]
    assert find_secrets(docs.limit(0), ["doc_id"]).count() == 0
    more = find_secrets(docs.withColumn("spans", docs.doc_id), ["doc_id", "spans"], out="found").collect()
    assert all([tuple(s) for s in r.found] == got[r.doc_id] for r in more)


def test_rules_may_be_others(spark):
    rules = [Rule("one", "ab"), Rule("two", "(a|ba){2,3}"), Rule("three", "[^a-z]+"), Rule("four", r"\x41?b\.c*")]
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcA. ") for _ in range(rng.randrange(30))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    with pytest.raises(ValueError):  # ends after two or three, but a third part's first letter leads on without an end
        find_secrets(docs, ["doc_id"], rules)
    rules[1] = Rule("two", "(a|ba)+")
    with pytest.raises(ValueError):
        find_secrets(docs, ["doc_id"], rules)
    rules[1] = Rule("two", "c(a|b)*")
    for r in find_secrets(docs, ["doc_id"], rules).collect():
        assert [tuple(s) for s in r.spans] == brute(texts[r.doc_id], rules)
    for wrong in (["a*"], ["a(bcd)?"], ["(a"], ["é"], [], ["abcd|bc"]):
        with pytest.raises(ValueError):
            compile_patterns(wrong)
    with pytest.raises(ValueError):
        find_secrets(docs, ["doc_id"], [Rule("x", "a"), Rule("x", "b")])


def test_automaton_is_minimal():
    """Two spellings of one language have equally many states, and no two states of a rule act alike."""
    assert len(compile_patterns(["[0-9a-f]{16,}"]).step) == len(compile_patterns(["[0-9a-f]{15}([0-9]|[a-f])+"]).step)
