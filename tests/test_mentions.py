"""Mentions in texts and links of names against plain loops."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from dealmill.operators.mentions import linked, mentions


def by_hand(texts, aliases):
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    held = {}
    for entity, alias, canonical in aliases:
        if entity is not None and cut(alias):
            own = held.setdefault(tuple(cut(alias)), {})
            own[entity] = own.get(entity, False) or bool(canonical)
    out = []
    for key, text in texts:
        ws, at = cut(text), 0
        while at < len(ws):
            fits = [n for n in range(len(ws) - at, 0, -1) if tuple(ws[at : at + n]) in held]
            if fits:
                found = held[tuple(ws[at : at + fits[0]])]
                own = [e for e, c in found.items() if c]
                told = ("exact", own[0], 1) if len(own) == 1 else ("plausible", next(iter(found)), 1) if len(found) == 1 else ("ambiguous", None, len(found))
                out.append((key, at, " ".join(ws[at : at + fits[0]]), *told))
            at += fits[0] if fits else 1
    return sorted(out, key=str)


def test_mentions_longest_first_none_inside_another(spark):
    r = random.Random(7)
    words = ["acme", "bio", "pharma", "of", "ny", "x"]
    aliases = [(r.randint(1, 9), " ".join(r.choices(words, k=r.randint(1, 4))), r.choice([True, False, None])) for _ in range(30)] + [(None, "of", True), (3, "", True), (4, "--", True), (5, None, True)]
    texts = [(k % 50, " ".join(r.choices([*words, "Acme,", "BIO-pharma", "zz"], k=r.randint(0, 40)))) for k in range(80)] + [(200, None), (201, "Acme bio " * 3000)]
    df = spark.createDataFrame(texts, "id long, t string").withColumn("alias", F.lit("clash"))
    got = mentions(df, spark.createDataFrame(aliases, "entity long, alias string, canonical boolean"), "id", "t").collect()
    assert sorted((tuple(x) for x in got), key=str) == by_hand(texts, aliases)
    assert mentions(df, spark.createDataFrame([], "entity long, alias string, canonical boolean"), "id", "t").count() == 0


def test_links_of_sure_and_clear_names(spark):
    names = spark.createDataFrame([(1, "drug", " Aspirin-C "), (1, "drug", "Aspirin-C"), (1, "drug", "both"), (2, "drug", "weak"), (3, "drug", None), (4, "drug", "??")], "subject long, role string, name string")
    aliases = spark.createDataFrame([(10, "aspirin c", 0.9), (10, "ASPIRIN C", 0.9), (11, "Both", 0.8), (12, "both!", 0.8), (13, "weak", 0.5), (None, "both", 0.9), (14, "!!", 1.0)], "entity long, alias string, confidence double")
    rows = lambda unique: sorted(tuple(x) for x in linked(names, aliases, 0.7, unique).collect())
    assert rows(True) == [(1, "drug", "Aspirin-C", 10, "ASPIRIN C", 0.9)]
    assert rows(False) == [(1, "drug", "Aspirin-C", 10, "ASPIRIN C", 0.9), (1, "drug", "both", 11, "Both", 0.8), (1, "drug", "both", 12, "both!", 0.8)]
