"""License rules on made texts, odd rows and against a fold in plain Python."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treeline.llm import licenses
from treeline.llm.arrays import running

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def scanned(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["licenses"] for r in licenses.scan(df, **options).orderBy("doc_id").collect()]


def test_there_are_hundreds_of_rules_and_their_keywords_hold():
    rules = licenses.rules()
    assert len(rules) > 300 and [r.rule for r in rules] == list(range(len(rules)))
    assert {r.rank for r in rules} == set(range(len(licenses.SURE)))


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Released under the MIT License.", "mit"), ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"), ("Licensed under the Apache License, Version 2.0", "apache-2,apache-2.0"),
        ("GNU Lesser General Public License v2.1", "lgpl-2.1"), ("the GNU General Public License, version 3", "gpl-3.0"), ("code is GPLv3 now", "gpl-3.0"),
        ("CC BY-NC-SA 4.0", "cc-by-nc,cc-by-nc-sa-4.0"), ("Creative Commons Attribution-NonCommercial 4.0", "cc-by-nc-4.0"), ("BSD 3-Clause License", "bsd-3-clause"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"), ("Mozilla Public License 2.0", "mpl-2.0"),
        ("placed by its author into the public domain", "public-domain"), ("we went with mit dem Auto to a general public event", ""), ("apache license version 20", "apache"),
    ],
)
def test_mentions(spark, text, labels):
    (got,) = scanned(spark, [text])
    assert ",".join(sorted({d["label"] for d in got["found"]})) == labels
    assert got["n_words"] == len(WORD.findall(text.lower()))


def test_places_are_words_and_adjacent_matches_count(spark):
    text = "under the mit license " * 3 + "x CC-BY-NC"
    (got,) = scanned(spark, [text])
    assert [(d["start"], d["end"]) for d in got["found"] if d["rank"] == 0] == [(0, 4), (4, 8), (8, 12), (13, 16)]


def test_containment_and_rank(spark):
    rows = [(0, 9, 5, 1, "a"), (1, 4, 5, 2, "b"), (1, 4, 3, 3, "c"), (1, 4, 3, 4, "d"), (2, 3, 0, 5, "e"), (8, 12, 6, 6, "f"), (8, 12, 2, 7, "g"), (9, 13, 6, 8, "h")]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame([(rows,)], f"found array<{licenses.DETECTION}>")
    got = df.select(F.explode(licenses.resolved(F.col("found"))).alias("d")).select("d.label").collect()
    assert [r["label"] for r in got] == ["a", "c", "e", "g", "h"]


detection = st.tuples(st.integers(0, 9), st.integers(1, 5), st.integers(0, 6))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(detection, max_size=14), min_size=1, max_size=12))
def test_resolution_by_pairs(spark, cases):
    made = [[(lo, lo + n, rank, i, f"{i}") for i, (lo, n, rank) in enumerate(c)] for c in cases]

    def stays(d, all_):
        beats = lambda e: e[0] <= d[0] and e[1] >= d[1] and e[2] <= d[2] and (e[0] < d[0] or e[1] > d[1] or (e[2], e[3]) < (d[2], d[3]))
        return d[2] == 0 or not any(beats(e) for e in all_)

    df = spark.createDataFrame([(i, c) for i, c in enumerate(made)], f"i int, found array<{licenses.DETECTION}>")
    got = {r["i"]: {d["rule"] for d in r["kept"]} for r in df.select("i", licenses.resolved(F.col("found")).alias("kept")).collect()}
    assert got == {i: {d[3] for d in c if stays(d, c)} for i, c in enumerate(made)}


def test_running_fold_of_any_length(spark):
    df = spark.range(0, 600, 37).withColumn("xs", F.when(F.col("id") > 0, F.sequence(F.lit(1), F.col("id").cast("int"))).otherwise(F.array().cast("array<int>")))
    got = df.select("id", running(F.col("xs"), F.lit(0), "int", lambda s, x: (s + x, s + x), block=16).alias("sums")).collect()
    assert all(r["sums"] == [k * (k + 1) // 2 for k in range(1, r["id"] + 1)] for r in got)


def test_odd_rows(spark, odd_docs):
    named = odd_docs.withColumn("licenses", F.lit("mine")).withColumn("found", F.lit(1))
    out = licenses.scan(named)
    assert sorted(out.columns) == sorted(named.columns)
    rows = {(r["doc_id"], r["text"]): r["licenses"] for r in out.collect()}
    assert out.count() == odd_docs.count() and out.limit(0).collect() == []
    assert rows[(3, None)]["n_words"] == rows[(4, "")]["n_words"] == 0 and rows[(3, None)]["found"] == []
    assert licenses.scan(named.limit(0)).collect() == []


def test_a_long_text_of_mentions(spark):
    text = "Licensed under the Apache License, Version 2.0 and under the MIT license. " * 4000
    (got,) = scanned(spark, [text])
    assert sum(d["rank"] == 0 for d in got["found"]) == 8000 and max(d["end"] for d in got["found"]) == got["n_words"] == 13 * 4000


def test_every_rule_on_every_text(spark, sf):
    """By Python's expressions and pairs of detections, without keywords: the table and a text made of each rule's family."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    made = [f"Offered by us under the {re.sub('[|?!]', ' ', n)} License, version {(v.split() or [''])[-1]} or later" for _, _, names, v in licenses.FAMILIES for n in names.split("/")]
    made += [phrase.replace("|", " ").replace("?", "").replace("*", "w") for _, _, phrase in licenses.TEXTS]
    docs = docs.unionByName(spark.createDataFrame([(-i - 1, t) for i, t in enumerate(made)], "doc_id long, text string"))
    rules = [(r, re.compile(r.pattern)) for r in licenses.rules()]
    count = lambda s: s.count(" ") // 2
    for row in licenses.scan(docs).collect():
        text = re.sub(licenses.NO_WORD, "  ", f" {(row['text'] or '').lower()} ")
        found = [(count(text[: m.start()]), count(text[: m.start()]) + count(m[0]), r.rank, r.rule, r.label) for r, p in rules for m in p.finditer(text)]
        beats = lambda e, d: e[0] <= d[0] and e[1] >= d[1] and e[2] <= d[2] and (e[0] < d[0] or e[1] > d[1] or e[2:4] < d[2:4])
        kept = [d for d in found if d[2] == 0 or not any(beats(e, d) for e in found)]
        assert sorted(map(tuple, row["licenses"]["found"])) == sorted(kept), row["text"]
