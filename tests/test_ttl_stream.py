"""The event-time TTL stream against the batch replay: restarts, late requests, requests out of order, entries open at the start."""

import random

from pyspark.sql import functions as F

from pagelake.operators import cache as C
from pagelake.streaming import ttl_stream as TS

SCHEMA = "id long, key string, ts timestamp, ttl int, storable boolean, use_cache boolean"
T0 = 1_700_000_000


def requests(n, seed):
    r = random.Random(seed)
    return [(k, f"k{r.randrange(6)}", T0 + r.randrange(40_000), r.choice([0, 600, 3600, 9000]), r.random() < 0.9, r.random() < 0.9) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, key string, s long, ttl int, storable boolean, use_cache boolean").withColumn("ts", F.timestamp_seconds("s")).select(*[x.split()[0] for x in SCHEMA.split(", ")])


def run(spark, folder, state, out, **how):
    s = TS.ttl_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder), **how)
    q = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return {r.id: (r.outcome, r.stored, r.stored_us) for r in spark.read.schema(s.schema).parquet(out).collect()}


def batch(spark, rows):
    got = C.cache_replay(frame(spark, rows).where("use_cache and ttl > 0")).select("id", "outcome", "stored", F.unix_micros("stored_at").alias("us"))
    out = {r.id: (r.outcome, r.stored, r.us) for r in got.collect()}
    return {r[0]: out.get(r[0], ("bypass", False, None)) for r in rows}


def clock(spark, folder, at):
    frame(spark, [(TS.CLOCK, "clock", at, 1, True, True)]).coalesce(1).write.mode("append").parquet(folder)


def test_restart_out_of_order_and_late(spark, tmp_path):
    rows = requests(400, 1)
    d = f"{tmp_path}/in"
    first = [r for r in rows if r[2] < T0 + 20_000]
    for part in (first[::2], first[1::2]):  # each file spans all times, so the second is out of order
        frame(spark, part).coalesce(1).write.mode("append").parquet(d)
    how = dict(late="12 hours", slot_seconds=900)
    assert run(spark, d, f"{tmp_path}/state", f"{tmp_path}/out", **how) == {}
    frame(spark, [r for r in rows if r not in first]).coalesce(1).write.mode("append").parquet(d)
    clock(spark, d, T0 + 200_000)
    assert run(spark, d, f"{tmp_path}/state", f"{tmp_path}/out", **how) == batch(spark, rows)
    frame(spark, [(900, "k1", T0 + 5, 600, True, True)]).coalesce(1).write.mode("append").parquet(d)
    got = run(spark, d, f"{tmp_path}/state", f"{tmp_path}/out", **how)
    assert got.pop(900) == ("late", False, None) and got == batch(spark, rows)


def test_starts_from_the_entries_of_a_batch(spark, tmp_path):
    rows = requests(300, 2)
    cut = T0 + 15_000
    before, after = [r for r in rows if r[2] < cut], [r for r in rows if r[2] >= cut]
    replayed = C.cache_replay(frame(spark, before).where("use_cache and ttl > 0"))
    d = f"{tmp_path}/in"
    frame(spark, after).coalesce(1).write.parquet(d)
    clock(spark, d, T0 + 100_000)
    got = run(spark, d, f"{tmp_path}/state", f"{tmp_path}/out", start=TS.open_entries(replayed))
    want = batch(spark, rows)
    assert got == {r[0]: want[r[0]] for r in after} and any(want[r[0]][0] == "hit" and want[r[0]][2] < cut * 1_000_000 for r in after)


def test_keys_share_state(spark, tmp_path):
    """Rows of state follow buckets and slots, not keys; a null key is a key."""
    r = random.Random(3)
    rows = [(k, r.choice([None, *(f"k{i}" for i in range(300))]), T0 + r.randrange(9_000), r.choice([0, 900, 4000]), r.random() < 0.9, r.random() < 0.9) for k in range(2000)]
    d = f"{tmp_path}/in"
    frame(spark, rows).coalesce(1).write.parquet(d)
    s = TS.ttl_stream(spark.readStream.schema(SCHEMA).parquet(d), late="12 hours", buckets=4)
    q = s.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    slots = len({row[2] // 3600 for row in rows})
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 4 * slots * 8
    clock(spark, d, T0 + 200_000)
    got = run(spark, d, f"{tmp_path}/state", f"{tmp_path}/out", late="12 hours", buckets=4)
    want = batch(spark, [(*row[:1], row[1] or "none", *row[2:]) for row in rows])
    assert got == want
