"""Spelling variants against plain edit checks, with groups cut into blocks, ties, chains and odd rows."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelake.llm import spelling

WORDS = "word string, n long"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(words):
    out = {}
    for w, n in words.items():
        near = [(-words[x], x) for x in words if one_edit(w, x)]
        best = min(near) if near else None
        form = best[1] if best and -best[0] >= 5 * n else None
        out[w] = (form, n, len(near), -best[0] if form else None)
    result = set()
    for w, (form, n, k, m) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        result.add((w, form, root, n, k, m))
    return result


def rows(spark, words):
    return spark.createDataFrame([(w, n) for w, n in words.items()], WORDS)


def random_words(k, alphabet, seed):
    r = random.Random(seed)
    return {"".join(r.choice(alphabet) for _ in range(r.randint(2, 7))): r.choice([1, 2, 5, 10, 50, 300]) for _ in range(k)}


@given(st.lists(st.text("abé", min_size=1, max_size=6), min_size=1, max_size=12, unique=True))
@settings(max_examples=60, deadline=None)
def test_tile_equals_edit_check(words):
    for longer in {len(w) for w in words}:
        seats = [w for w in words if len(w) in (longer, longer - 1)]
        got = [(seats[x], seats[y]) for by_end in (False, True) for x, y in zip(*spelling.tile(seats, seats, longer, by_end))]
        want = [(a, b) for a in seats for b in seats if one_edit(a, b) and max(len(a), len(b)) == longer]
        assert sorted(got) == sorted(want)


@pytest.mark.parametrize("block", [3, 20, 512])
def test_variants_equal_brute_force(spark, block):
    words = {**random_words(400, "ab", 1), **random_words(200, "abcdé𝒳", 2)}
    got = [tuple(r) for r in spelling.variants(rows(spark, words), block=block).collect()]
    assert len(got) == len(words) and set(got) == plain(words)


def test_chains_ties_and_long_words(spark):
    chain = {"aaaaaa": 1, "aaaaab": 5, "aaaabb": 25, "aaabbb": 125, "aabbbb": 625, "abbbbb": 3125, "bbbbbb": 15625}
    long = {"x" * 70_000: 1, "x" * 69_999: 9, "x" * 35_000 + "y" + "x" * 34_999: 9}
    words = {**chain, **long, "zebra": 1, "zebrb": 7, "zebrc": 7}
    got = {r.word: r for r in spelling.variants(rows(spark, words)).collect()}
    assert {tuple(r) for r in got.values()} == plain(words)
    assert all(got[w].root == "bbbbbb" for w in chain) and got["zebra"].form == "zebrb" and got["x" * 70_000].n_near == 2


def test_repeated_null_and_no_words(spark):
    got = spelling.variants(spark.createDataFrame([("abc", 2), ("abc", 1), (None, 9), ("abd", 15), ("", 4), ("a", 1)], WORDS)).collect()
    assert {(r.word, r.form, r.n, r.n_near) for r in got} == {("abc", "abd", 3, 1), ("abd", None, 15, 1), ("", None, 4, 0), ("a", None, 1, 0)}
    assert spelling.variants(spark.createDataFrame([], WORDS)).count() == 0


def test_words_of_a_corpus(spark):
    text = "The Größen größen straße×straße naïveté; " + " ".join(f"wörter{chr(97 + i % 26)}" for i in range(300))
    docs = [(i, text) for i in range(40)] + [(None, text), (3, None), (3, ""), (7, text), (7, text), (8, "b" * 30_000)]
    want = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                want[run] += 1
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("id", "run", "h", "word", "n")])
    got = {r.word: r.n for r in spelling.corpus_words(df, least=1).collect()}
    assert got == dict(want) and any(len(w) == 6 and w.startswith("wörte") for w in got)
    assert {r.word for r in spelling.corpus_words(df).collect()} == {w for w, n in want.items() if n >= 5}
    assert spelling.corpus_words(df.where("false")).count() == 0
