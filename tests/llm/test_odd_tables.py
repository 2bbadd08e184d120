"""Operators on empty tables and on tables whose further columns bear names the operators use themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.llm import ann, chat, decontaminate, langid, mixing, neardup, pii, repeats, url_filter, warc

NAMES = [
    "h", "n", "ord", "hot", "comp", "words", "sig", "label", "k1", "k2", "cuts", "lo", "hi", "spans", "base", "cand", "added", "b_email", "c_mail", "score",
    "lang_pred", "bits_per_char", "n_tokens", "p", "rate", "copies", "word", "domain", "item_id", "cosine",
]


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join("".join(x) for x in np.random.default_rng(3).choice(list("abcdef"), (200, 5)))
    rows = [(1, long), (2, long + " end"), (3, None), (4, ""), (5, "mail me@x.org"), (None, "one"), (5, "mail me@x.org")]
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in NAMES])


def others(df, own):
    """Whether the further columns came through as they were, but for those the operator writes."""
    kept = [c for c in NAMES if c not in own]
    return len(set(df.columns)) == len(df.columns) and all(r[c] == "x" for r in df.collect() for c in kept)


def test_clashing_columns_of_documents(spark, docs):
    assert neardup.near_duplicates(docs).count() == repeats.without_repeats(docs).count() == 7
    model = langid.build({"x": ["abc def"], "y": ["mail"]})
    assert others(langid.predict(docs, model), ("lang_pred", "score", "bits_per_char"))
    found = pii.find(docs, models={})
    assert others(found, ("base", "spans")) and found.select(F.sum(F.size("base"))).first()[0] == 2
    bench = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string").withColumn("words", F.lit("x"))
    assert decontaminate.leaks(docs, bench).count() == 0
    labels = spark.createDataFrame([(1, "g"), (5, "b")], "doc_id long, domain string").withColumn("word", F.lit("x"))
    assert others(mixing.mix(docs, labels, {"g": 0.5, "b": 0.5}), ("n_tokens", "p", "rate", "copies"))


def test_clashing_columns_of_other_tables(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.com/x", "h" * 200), (2, None, None)], "page_id long, url string, html string")
    pages = pages.select("*", *[F.lit("x").alias(c) for c in ("host", "path", "rule", "verdict", "listed", "best", "key", "digest", "first_id", "file")])
    rules = spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string").withColumn("key", F.lit("x"))
    got = url_filter.filter_urls(pages, rules, pages.where("false").select("url", "host"))
    assert {(r.page_id, r.verdict) for r in got.collect()} == {(1, "block"), (2, "allow")}
    assert warc.read_warc(warc.write_warc(pages, f"file://{tmp_path}/w").select("file", "bytes")).count() == 2
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "ok")], "conv_id long, turn long, role string, text string")
    turns = turns.select("*", *[F.lit("x").alias(c) for c in ("dup", "step", "kind", "message", "seq", "e")])
    assert chat.read_back(chat.render(chat.fold(chat.events_of(turns), ["turn", "dup", "step"]))).first().n_turns == 2
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<double>").select("*", *[F.lit("x").alias(c) for c in ("leaf", "score", "rank", "query_id", "x")])
    assert ann.nearest(v, v.where("vec_id = 0")).count() == 4


def test_empty_tables(spark, docs, tmp_path):
    none = docs.where("false").select("doc_id", "text")
    assert neardup.near_duplicates(none).count() == repeats.without_repeats(none).count() == pii.find(none).count() == 0
    assert langid.predict(none, langid.train(spark.createDataFrame([], "text string, lang string"))).count() == 0
    bench = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    assert decontaminate.leaks(none, bench).count() == decontaminate.leaks(docs, bench.where("false")).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert url_filter.filter_urls(pages, rules, pages.select("url")).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.render(chat.fold(chat.events_of(turns), ["turn", "dup", "step"]))).count() == 0
