import random

import pytest
from pyspark.sql import functions as F

from pagelake.operators import cache as C
from pagelake.plans import derived as D
from pagelake.streaming import cache_stream as CS


def brute(rows):
    """Replay by a loop: (id, key, us, ttl_s, storable, use_cache) -> id: (outcome, stored, stored at)."""
    out, state = {}, {}
    for i, key, us, ttl, storable, use in sorted(rows, key=lambda r: (r[2], r[0])):
        if not use or ttl <= 0:
            out[i] = ("bypass", False, None)
            continue
        at, until = state.get(key, (None, None))
        if until is not None and us <= until:
            out[i] = ("hit", False, at)
        elif storable:
            state[key] = (us, us + ttl * 1_000_000)
            out[i] = ("miss", True, us)
        else:
            out[i] = ("miss", False, None)
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "id long, key string, us long, ttl long, storable boolean, use_cache boolean")
    return df.withColumn("ts", F.timestamp_micros("us")).drop("us")


def outcomes(df):
    return {r.id: (r.outcome, r.stored, r.at) for r in df.withColumn("at", F.unix_micros("stored_at")).collect()}


@pytest.mark.parametrize("seed,hot_rows", [(1, 10**6), (1, 60), (2, 200), (3, 25)])
def test_replay_equals_loop(spark, seed, hot_rows):
    """One key holds most rows; small limits send it through carried waves and single slices."""
    rnd = random.Random(seed)
    rows = [
        (i, "hot" if rnd.random() < 0.7 else f"k{rnd.randrange(9)}", rnd.randrange(2000) * 500_000,
         rnd.choice([50, 90, 200]) if rnd.random() < 0.95 else 0, rnd.random() < 0.8, rnd.random() < 0.9)
        for i in range(700)
    ]
    assert outcomes(C.cache_replay(frame(spark, rows), hot_rows)) == brute(rows)


def test_equal_time_is_a_hit_and_hits_do_not_extend(spark):
    rows = [(0, "a", 0, 10, True, True), (1, "a", 10_000_000, 10, True, True), (2, "a", 10_000_001, 10, True, True)]
    assert [outcomes(C.cache_replay(frame(spark, rows)))[i][0] for i in range(3)] == ["miss", "hit", "miss"]


def test_known_counts(spark, sf):
    r = D.requests(spark, sf).select("id", "ts", F.col("user_id").alias("key"), F.lit(86400).alias("ttl"), F.lit(True).alias("storable"), F.lit(True).alias("use_cache"))
    got = {x.outcome: x["count"] for x in C.cache_replay(r).groupBy("outcome").count().collect()}
    assert got == {"miss": 3128, "hit": 6872}


def test_digest(spark):
    r = spark.range(1).selectExpr("'auto' render", "'fast' actions", "true include_actions", "cast(null as int) max_tokens", "cast(null as string) selector_hint")
    assert r.select(C.options_digest().alias("d")).first().d == "ffae72ba61ef6c88"


def test_stream_equals_batch(spark, sf, tmp_path):
    """The same requests in several files, one per micro-batch."""
    e = D.requests(spark, sf).orderBy("ts", "id").limit(3000).select(
        "id", "ts", F.col("user_id").cast("string").alias("key"), F.lit(86400).alias("ttl"), F.lit(True).alias("storable"), F.lit(True).alias("use_cache"), "url")
    rows = e.toPandas().sort_values(["ts", "id"])
    for i in range(6):
        spark.createDataFrame(rows.iloc[i * 500:(i + 1) * 500], e.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = CS.run_available(CS.cache_stream(stream))
    assert {x.outcome: x["count"] for x in got.groupBy("outcome").count().collect()} == {"miss": 976, "hit": 2024}
    batch = C.cache_replay(spark.createDataFrame(rows, e.schema).drop("url"))
    assert got.select("id", "outcome").exceptAll(batch.select("id", "outcome")).count() == 0


def test_kpi_stream_gives_closed_windows(spark, sf, tmp_path):
    r = D.requests(spark, sf).select("ts", "url", F.when(F.col("id") % 2 == 0, "hit").otherwise("miss").alias("outcome"))
    r.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(r.schema).parquet(str(tmp_path / "in"))
    got = CS.run_available(CS.kpi_stream(stream, "6 hours"))
    want = r.withColumn("stored", F.lit(False)).transform(lambda d: C.cache_kpis(d, "6 hours"))
    kept = got.join(want, ["window_start", "host", "requests", "hits"])
    assert got.count() > 0.9 * want.count() and kept.count() == got.count()


def test_sliding_windows_equal_plain_count_with_a_hot_host(spark):
    rnd = random.Random(11)
    rows = [(k, "https://hot.example/x" if rnd.random() < 0.7 else f"https://h{rnd.randrange(5)}.example/", 86_300 + rnd.randrange(900) * rnd.choice([1, 1, 400])) for k in range(900)]
    df = spark.createDataFrame(rows, "id long, url string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: (r.in_window, r.rate_limited) for r in C.sliding_flags(df, 20, seconds=60, block_seconds=7).collect()}
    want = {k: sum(u == url and s - 60 < t <= s for _, u, t in rows) for k, url, s in rows}
    assert got == {k: (n, n > 20) for k, n in want.items()} and any(n > 20 for n in want.values())


def test_sliding_windows_keep_no_host_together(spark):
    df = spark.createDataFrame([(1, "https://a.example/", 5)], "id long, url string, s long").withColumn("ts", F.timestamp_seconds("s"))
    plan = C.sliding_flags(df, 1)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x]
    by_request = [x for x in windows if "sum(one" in x]
    assert len(windows) == 3 and len(by_request) == 1
    assert all("block#" in x for x in by_request)


def test_revalidated_content(spark):
    rows = [(1, "a", 0, True, "x"), (2, "a", 5, False, "x"), (3, "a", 9, True, "x"), (4, "a", 20, True, "y"), (5, "b", 3, True, None), (6, "b", 9, True, "x"), (7, "b", 30, True, "x"), (8, "c", 1, False, "z")]
    df = spark.createDataFrame(rows, "id long, key string, s long, stored boolean, content string").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r.revalidated for r in C.revalidations(df).collect()}
    assert got == {1: None, 2: None, 3: True, 4: False, 5: None, 6: None, 7: True, 8: None}
    k = C.revalidation_kpis(C.revalidations(df.withColumn("url", F.lit("https://h.example/"))), "1 hour").first()
    assert (k.requests, k.stores, k.refreshes, k.revalidated, k.revalidated_share) == (8, 6, 3, 2, 0.666667)
