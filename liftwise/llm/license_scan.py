"""License scan: exact containment join of text blocks with license templates. Built-in column functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftwise.llm.decontaminate import text_key
from liftwise.session import materialize

#: Words of a block that no other block begins with, and the longest passage that surely lies within one block.
STRIDE = 64
REACH = 64

# Phrases whose every place counts, and wording of public licenses with the share of its words that a block must hold.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
TEMPLATES = [
    ("licensed under the apache license version 2 0", "apache", 0.8),
    ("released under the mit license", "mit", 0.9),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit", 0.8),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that", "bsd", 0.8),
    ("this work is licensed under the gnu general public license version 3", "gpl", 0.8),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", 0.8),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl", 0.85),
    ("this source code form is subject to the terms of the mozilla public license", "mpl", 0.8),
    ("licensed under cc by nc 4 0", "cc-by-nc", 0.85),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by", 0.8),
    ("dual licensed under the apache license version 2 0 or the mit license", "dual", 0.9),
]

_APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words(text):
    """Words of a text, A-Z lower-cased; null reads as empty."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(low, _APART), "")


def _templates(phrases: list[tuple[str, str]], templates: list[tuple[str, str, float]]) -> list[tuple[list[str], str, int, bool]]:
    """(distinct words, label, words a block must hold, exact phrase) of each."""
    out = [(sorted(set(p.split())), label, len(set(p.split())), True) for p, label in phrases]
    for text, label, share in templates:
        words = sorted(set(text.split()))
        out.append((words, label, -int(-share * len(words) // 1), False))
    return out


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str, float]] = TEMPLATES,
) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Texts are cut into blocks of ``STRIDE + REACH`` words, one every ``STRIDE``,
    so that any passage of ``REACH`` words lies whole within a block, across
    lines too. A block meets a template when it holds at least the share asked
    for of its distinct words; phrases ask for all, and their places are then
    those where the words stand one after another.

    The join is exact. Words of all templates are put in order of the number of
    texts of the table that have them, rarest first. A block that holds ``need``
    of a template's words has one of the template's first ``size - need + 1``
    (prefix); it must hold ``need`` template words at all (length), and those
    from the met word on must suffice (position). Candidates are then counted
    out. The templates are a parameter, so tables about them stay small.

    score is the largest share found, 0 without any; labels are distinct,
    sorted and joined by commas, empty without any. Null and empty texts have
    no words. Equal texts are scanned once and repeated rows stay repeated.
    """
    wanted = _templates(phrases, templates)
    vocabulary = sorted({w for words, *_ in wanted for w in words})
    known = F.array(*[F.lit(w) for w in vocabulary])
    h1, h2 = text_key(F.col(text_col))
    texts = docs.select(F.col(id_col).alias("id"), h1.alias("h1"), h2.alias("h2"), _words(F.col(text_col)).alias("words"))

    seen = texts.select(F.explode(F.array_intersect("words", known)).alias("word")).groupBy("word").count()
    counts = {r["word"]: r["count"] for r in seen.collect()}  # one row for each word of the templates at most
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}

    index, facts = {}, []
    for t, (words, label, need, exact) in enumerate(wanted):
        ranked = sorted(rank[w] for w in words)
        facts.append((t, label, need, len(words), exact, ranked))
        for place, r in enumerate(ranked[: len(words) - need + 1]):
            index.setdefault(r, []).append((t, place))
    starts = F.array(*[F.lit(order[r]) for r in sorted(index)])
    prefix = _literal(docs, [(r, t, place) for r in index for t, place in index[r]], "rank int, template int, place int")
    ranks = _literal(docs, [(w, r) for w, r in rank.items()], "word string, rank int")
    facts = _literal(docs, [(t, label, need, size, exact, ",".join(map(str, own))) for t, label, need, size, exact, own in facts], "template int, label string, need int, size int, exact boolean, own string")
    facts = facts.withColumn("own", F.transform(F.split("own", ","), lambda x: x.cast("int")))

    likely = texts.where(F.arrays_overlap("words", starts)).select("h1", "h2", F.size("words").alias("n"), F.posexplode("words").alias("pos", "word"))
    places = likely.join(F.broadcast(ranks), "word").select("h1", "h2", "pos", "rank").distinct()
    places = materialize(places, "license-words")
    last = F.floor(F.col("pos") / STRIDE)
    first = F.greatest(F.floor((F.col("pos") - (STRIDE + REACH)) / STRIDE) + 1, F.lit(0))
    held = places.select("h1", "h2", "rank", F.explode(F.sequence(first, last)).alias("block")).groupBy("h1", "h2", "block").agg(F.array_sort(F.collect_set("rank")).alias("held"))
    tokens = held.select("h1", "h2", "block", "held", F.posexplode("held").alias("at", "rank"))
    met = tokens.join(F.broadcast(prefix), "rank").join(F.broadcast(facts), "template")
    # words of either side from the met one on, this included, must make up what is asked for, but those before may count as well
    length = F.size("held") >= F.col("need")
    position = F.least(F.col("at"), F.col("place")) + F.least(F.size("held") - F.col("at"), F.col("size") - F.col("place")) >= F.col("need")
    common = F.size(F.array_intersect("held", "own"))
    met = met.where(length & position).withColumn("common", common).where("common >= need")
    met = materialize(met.select("h1", "h2", "block", "template", "label", "exact", (F.col("common") / F.col("size")).alias("share")).distinct(), "license-blocks")

    phrase_rows = [(t, k, rank[w], len(p.split())) for t, (p, _) in enumerate(phrases) for k, w in enumerate(p.split())]
    steps = _literal(docs, phrase_rows, "template int, step int, rank int, length int")
    near = places.join(F.broadcast(steps), "rank").select("h1", "h2", "template", "length", (F.col("pos") - F.col("step")).alias("start"), "step")
    runs = near.groupBy("h1", "h2", "template", "length", "start").agg(F.count("*").alias("n")).where("n = length")
    inside = met.where("exact").select("h1", "h2", "template", "label", F.col("block").alias("of"))
    base = runs.withColumn("of", F.floor(F.col("start") / STRIDE)).join(inside, ["h1", "h2", "template", "of"])
    base = base.groupBy("h1", "h2").agg(
        F.count("*").alias("n_base"), F.min("start").cast("long").alias("first_word"), F.max("start").cast("long").alias("last_word"),
        F.collect_set("label").alias("base_set"), F.lit(1.0).alias("base_score"),
    )
    more = met.where("not exact").groupBy("h1", "h2").agg(F.collect_set("label").alias("more_set"), F.max("share").alias("more_score"))
    found = base.join(more, ["h1", "h2"], "full")

    none = F.array().cast("array<string>")
    base_set, more_set = F.coalesce("base_set", none), F.coalesce("more_set", none)
    rows = texts.select("id", "h1", "h2", F.size("words").cast("long").alias("n_words")).join(found, ["h1", "h2"], "left")
    return rows.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.array_join(F.array_sort(base_set), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base_set, more_set)), ",").alias("labels"),
        F.greatest(F.coalesce("base_score", F.lit(0.0)), F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def _literal(docs: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A small table about the templates, as rows of literals."""
    names = [part.split() for part in schema.split(", ")]
    values = ", ".join("(" + ", ".join(_sql(x) for x in row) + ")" for row in rows)
    casts = ", ".join(f"CAST(c{i} AS {kind}) AS {name}" for i, (name, kind) in enumerate(names))
    columns = ", ".join(f"c{i}" for i in range(len(names)))
    return docs.sparkSession.sql(f"SELECT {casts} FROM VALUES {values} AS t({columns})")


def _sql(x) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else str(x)
