"""Quality rules against plain Python, on odd rows, and rules read from a table."""

import re

import pytest
from pyspark.sql import functions as F

from pagelake.llm import quality
from pagelake.llm.quality import Rule


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in quality.SYMBOLS for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
    }


TEXTS = [
    None, "", " \t\n\x0b", "one", "a b c d e f g h", "a b c d e f g h " * 3, "x " * 40, "ha\nha\n\nha \nho", "#1 $2 <b> & | %", "- one\n* two\n• three …\nfour...",
    "é𝒳ü wörd same  wide", "the cat and the dog of a house is in it. " + " ".join(f"word{i}" for i in range(40)),
    "p q r s t u v w 1 p q r s t u v w x 2 q r s t u v w x", "p q r s t u v w x " + " ".join(map(str, range(30_000))) + " p q r s t u v w x",
]


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "one"), (5, TEXTS[5])]
    return quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()


def test_counts_equal_plain_python(judged):
    assert len(judged) == len(TEXTS) + 2
    for r in judged:
        want = plain(r.text)
        assert {k: r[k] for k in want} == want, r.text
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.broken) and (not r.base_failed or not r.kept)
    assert len({str(r[2:]) for r in judged if r.doc_id == 5}) == 1


def test_rules_name_what_is_broken(judged):
    by = {r.doc_id: r for r in judged if r.doc_id is not None}
    assert by[0].broken == by[1].broken == by[2].broken == ["few_words"]
    assert "symbols" in by[8].broken and "words_without_letter" in by[8].broken
    assert by[9].n_bullet_lines == 3 and by[9].n_ellipsis_lines == 2 and "cut_lines" in by[9].broken
    assert by[6].broken[0] == "repeated_words" and by[11].kept


def test_rules_from_a_table(spark):
    t = spark.createDataFrame([("b", "n_words", 2.0, None), ("a", "mean_word", None, 3.0), ("c", "n_lines", None, None)], "rule string, measure string, low double, high double")
    rules = quality.rules_of(t)
    assert [r.rule for r in rules] == ["a", "b", "c"]
    docs = spark.createDataFrame([(1, "long words"), (2, "one"), (3, ""), (4, "longer")], "doc_id long, text string")
    got = {r.doc_id: (r.broken, r.kept) for r in quality.judge(docs, rules, base=[]).collect()}
    assert got == {1: (["a"], False), 2: (["b"], False), 3: (["b"], False), 4: (["a", "b"], False)}
    assert quality.judge(docs, [], base=[]).where("kept and not base_failed").count() == 4
    with pytest.raises(ValueError):
        quality.judge(docs, [Rule("x", "no_such", 1, None)])
    with pytest.raises(ValueError):
        quality.rules_of(t, at_most=2)


def test_bounds_are_inclusive(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i #")], "doc_id long, text string")
    assert quality.judge(docs, [Rule("s", "symbol_ratio", 0.1, 0.1)], base=[]).first().kept


def test_clashing_columns_empty_table_and_one_projection(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("kept", "n_words", "x", "w", "h", "p", "rule", "broken", "lines")])
    q = quality.judge(docs)
    r = q.first()
    assert len(set(q.columns)) == len(q.columns) and r.n_words == 2 and r.kept is False and r.x == r.w == r.h == r.p == r.lines == "x"
    assert quality.judge(docs.where("false")).count() == 0
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
