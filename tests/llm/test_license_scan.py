import re

import pytest

from liftwise.llm.license_scan import PHRASES, REACH, STRIDE, TEMPLATES, scan_licenses
from tests.llm.brute import LOWER

DATA = "/root/testdata/sf0.01"


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at, base, more, score = [], set(), set(), 0.0
    for phrase, label in PHRASES:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                base.add(label)
                score = 1.0
    for b in range(0, max(len(words), 1), STRIDE):
        held = set(words[b : b + STRIDE + REACH])
        for text, label, share in TEMPLATES:
            own = set(text.split())
            if len(own & held) >= -int(-share * len(own) // 1):
                more.add(label)
                score = max(score, len(own & held) / len(own))
    ends = (min(at), max(at)) if at else (None, None)
    return (len(words), len(at), *ends, ",".join(sorted(base)), ",".join(sorted(base | more)), round(score, 9))


def got(df):
    return [(r.doc_id, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9))) for r in df.collect()]


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = got(scan_licenses(docs))
    assert len(rows) == len(texts)
    hits = 0
    for key, row in rows:
        assert row == brute(texts[key])
        hits += bool(row[4])
    assert hits >= 20


def test_edge_rows(spark):
    long = "word " * 63 + "All rights\nreserved. " + "x " * 70_000 + "CC-BY cc by cc by"
    rows = [(1, None), (2, ""), (3, " .,!"), (4, "cc by"), (4, "cc by"), (None, "All Rights, Reserved"), (6, long), (7, "Ünder CC ßy General\tPublic_License cc BY"), (8, "by cc license public general")]
    rows += [(9, "Permission is hereby granted, free of charge, to any person obtaining one copy of such software and related documentation files")]
    docs = spark.createDataFrame([(*r, "z", 0) for r in rows], "doc_id long, text string, word string, h1 int")
    key = lambda x: (x[0] or 0, x[1])
    assert sorted(got(scan_licenses(docs)), key=key) == sorted(((k, brute(t)) for k, t in rows), key=key)
    assert scan_licenses(docs.limit(0)).count() == 0
