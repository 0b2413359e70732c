"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from treeline.llm import chat, decontam, html, lm, neardup, packing, phrases, repetition, secrets, suffixes


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve"), (2, None), (3, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def operators(bench):
    return {
        "repetition": repetition.score, "phrases": phrases.remove, "decontam": lambda d: decontam.findings(d, bench), "neardup": neardup.classes,
        "secrets": secrets.scan, "suffixes": suffixes.remove, "lm": lm.score, "packing": packing.pack,
    }


NAMES = ["repetition", "phrases", "decontam", "neardup", "secrets", "suffixes", "lm", "packing"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(operators, odd_docs, name):
    rows = operators[name](odd_docs).collect()
    assert len(rows) == (0 if name == "decontam" else odd_docs.count())


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(operators, odd_docs, name):
    assert operators[name](odd_docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["phrases", "suffixes"])
def test_repeated_ids_keep_the_first(operators, odd_docs, name):
    got = [(r["id"], r["n_removed"]) for r in operators[name](odd_docs).collect()]
    assert sorted(x for i, x in got if i == 2)[0] > 0 and [x for i, x in got if i == 3] == [0]


def test_filters_keep_columns(spark, odd_docs, bench):
    for df in (repetition.keep(odd_docs), neardup.deduplicate(odd_docs), decontam.clean(odd_docs, bench), secrets.redact(odd_docs)):
        assert df.columns == odd_docs.columns
        df.collect()
    kept = sorted((r["doc_id"] or 0) for r in neardup.deduplicate(odd_docs, shingle=2).collect())
    assert kept == [0, 1, 3, 4, 5, 6, 7, 9, 10]
    assert neardup.deduplicate(odd_docs.limit(0)).count() == 0


def test_pages(spark):
    rows = [(1, None, None), (2, "http://a/b", ""), (3, "odd", "<p>x"), (3, "odd", "<p>x"), (4, "http://a/c", "<article><p>t &lt;b&gt;</article>")]
    got = [(r["page_id"], r["text"]) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got) == [(1, ""), (2, ""), (3, "x"), (3, "x"), (4, "t <b>")]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_chats(spark):
    rows = [(1, 0, None, None), (1, 0, "assistant", "</s>~1"), (None, None, "user", "x"), (1, 0, "assistant", "</s>~1")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_parts(F.col("text")))
    got = {r["conv_id"]: r for r in chat.format_chats(df).select("*", chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    assert [tuple(t) for t in got[1]["back"]] == [("", ""), ("assistant", "</s>~1"), ("assistant", "</s>~1")] and got[1]["loss"] == "</s>~1" * 2
    assert len(got[None]["back"]) == 1 and chat.format_chats(df.limit(0)).count() == 0
