"""Act lookup and reachability against plain Python."""

import random

from pyspark.sql import functions as F

from pagelake.operators import contracts as K


def contracts(spark, rows):
    c = spark.createDataFrame(rows, "action_id string, contract long, requires_confirm boolean, c long, e long")
    return c.select("action_id", "contract", "requires_confirm", F.timestamp_seconds("c").alias("created_at"), F.timestamp_seconds("e").alias("expires_at"))


def requests(spark, rows):
    r = spark.createDataFrame(rows, "request_id long, action_id string, t long, confirm boolean")
    return r.select("request_id", "action_id", F.timestamp_seconds("t").alias("ts"), "confirm")


def test_lookup_equals_plain_search_with_a_hot_action_in_many_ranges(spark):
    r = random.Random(2)
    name = lambda: "hot" if r.random() < 0.7 else f"a{r.randrange(4)}"
    cs = [(name(), k, r.random() < 0.3, t := r.randrange(2000), t + r.choice([-5, 0, 3, 40, 400, 10**8])) for k in range(250)]
    rs = [(k, name() if r.random() < 0.95 else "none", r.randrange(2500), r.choice([True, False, None])) for k in range(1200)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x.request_id: (x.contract, x.error) for x in K.resolve_act(requests(spark, rs), contracts(spark, cs)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for k, a, t, ok in rs:
        best = max(((c, n, conf) for x, n, conf, c, e in cs if x == a and c <= t < e), default=None)
        want[k] = (best and best[1], "action_not_found" if best is None else "mutating_not_confirmed" if best[2] and not ok else None)
    assert got == want and len({w[0] for w in want.values()}) > 50


def test_a_long_contract_takes_two_rows(spark):
    c = contracts(spark, [("a", 1, False, 0, 315_360_000), ("a", 2, True, 100, 200), ("b", 3, False, 9, 9)])
    assert [(x.action_id, x.at // 10**6, x.version and x.version[12:13]) for x in K.reigns(c).orderBy("at").collect()] == [
        ("a", 0, "1"), ("a", 100, "2"), ("a", 200, "1"), ("a", 315_360_000, None)]
    none = contracts(spark, [])
    assert K.resolve_act(requests(spark, [(1, "a", 5, None)]), none).first().error == "action_not_found"
    assert K.resolve_act(requests(spark, []), c).count() == 0


def test_distances_and_ways_on_a_cycle_a_long_chain_and_random_edges(spark):
    r = random.Random(9)
    edges = [("s", "c0"), *[(f"c{i}", f"c{i + 1}") for i in range(14)], ("c14", "c3"), ("c5", "c5")]
    edges += [(f"n{r.randrange(30)}", f"n{r.randrange(30)}") for _ in range(45)] + [("s", "n1"), ("c2", "n7")]
    df = spark.createDataFrame(edges, "src string, dst string")
    dist, way, queue = {"s": 0}, {"s": ["s"]}, ["s"]
    while queue:
        new = {}
        for a in queue:
            for x, y in edges:
                if x == a and y not in dist:
                    new[y] = min(new.get(y, a), a)
        for y, a in new.items():
            dist[y], way[y] = dist[a] + 1, way[a] + [y]
        queue = sorted(new)
    found = K.distances(df, spark.createDataFrame([("s",), (None,), ("s",)], "node string"))
    assert {x.node: x.step for x in found.collect()} == dist and max(dist.values()) >= 14
    assert {x.node: x.path for x in K.paths(found).collect()} == way
    assert {x.node for x in K.reachable(df, spark.createDataFrame([("s",)], "node string"), 2).collect()} == {n for n, d in dist.items() if d <= 2}
    assert K.distances(df, spark.createDataFrame([], "node string")).count() == 0
