"""Alignment of two extractions' controls against a plain search, and merged timing sketches against exact ranks."""

import itertools
import random

from pyspark.sql import functions as F

from pagelake.operators import evaluation as E
from pagelake.operators import routing as R

SCHEMA = "page_id long, pos int, tag string, role string, name string, testid string, locator string"


def longest(x):
    """Length of the longest ascending part, by trying all."""
    return next(n for n in range(len(x), -1, -1) if any(list(c) == sorted(c) for c in itertools.combinations(x, n)))


def test_longest_ascending_part(spark):
    r = random.Random(6)
    lists = [r.sample(range(30), r.randint(0, 9)) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(lists)), "k long, x array<int>")
    for row in df.select("x", E._in_order(F.col("x")).alias("ok")).collect():
        kept = [v for v, ok in zip(row.x, row.ok) if ok]
        assert len(row.x) == len(row.ok) and kept == sorted(kept) and len(kept) == longest(row.x)


def control(pos, name, tag="a", testid=None, locator="role", page=1):
    return (page, pos, tag, {"a": "link", "button": "button"}[tag], name, testid, locator)


def test_controls_are_followed_through_inserts_renames_and_moves(spark):
    before = [control(2, "Home"), control(5, "Buy", "button", "b1", "testid"), control(7, "More"), control(9, "More", locator="structural"), control(12, "Help")]
    after = [control(2, "New"), control(4, "Home"), control(7, "Purchase", "button", "b1", "testid"), control(9, "More"), control(11, "More"), control(15, "Help"), control(17, "Help")]
    b, a = spark.createDataFrame(before, SCHEMA), spark.createDataFrame(after, SCHEMA)
    assert {(r.pos, r.pos_after) for r in E.aligned(b, a).collect()} == {(2, 4), (5, 7), (7, 9), (9, 11), (12, 15)}
    r = E.locator_stability(b, a).first()
    # Home and Buy are found again; both "More" share a name; the fourth link is now the other "More"; "Help" is ambiguous.
    assert (r.controls, r.kept, r.moved, r.lost, r.share) == (5, 2, 1, 2, 0.4)
    assert E.locator_stability(b, a.where("false")).first().lost == 5 and E.locator_stability(b.where("false"), a).count() == 0
    assert E.locator_stability(b, b).first().moved == 0


def test_merged_sketches_keep_their_error(spark):
    r = random.Random(1)
    rows = [(f"https://h{r.randrange(9)}.example/", r.randrange(12), "static", {"fetch": r.lognormvariate(5, 1), "total": None}) for _ in range(40_000)]
    df = spark.createDataFrame(rows, "url string, day int, extraction_path string, timings_ms map<string,double>")
    s = R.timing_sketches(df)
    assert s.count() == 9 * 12
    m = R.merged_timings(s, ["path", "stage"], (0.1, 0.5, 0.95, 0.99)).first()
    x = sorted(t["fetch"] for *_, t in rows)
    assert m.n == len(x)
    for p in (0.1, 0.5, 0.95, 0.99):
        assert abs(sum(v <= m[f"p{round(p * 100)}_ms"] for v in x) / len(x) - p) <= R.RANK_ERROR
