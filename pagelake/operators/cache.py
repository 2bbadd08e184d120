"""Cache keys, exact replay of a TTL cache over a request log, duplicate detection, KPIs.

A stored entry lives for a fixed time from the moment it was stored; hits do not extend it.
Whether a request is a hit therefore depends on every earlier request of its key, which is a
sequential recurrence per key. Keys of ordinary size are replayed by one sorted pass over the
partition they hash to. Keys with more rows than ``hot_rows`` are never brought together:
they are replayed in waves over time, and each wave hands the open entry of each key on.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.functions import rules, urls
from pagelake.functions.text import short_hash
from pagelake.session import checkpoint_dir

HOT_ROWS = 1_000_000
_NEVER = -(1 << 62)


def options_digest() -> Column:
    """16 hex digits of the canonical JSON of the five options that change a result."""
    text = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    return short_hash(
        F.concat(
            F.lit('{"actions": '), text("actions"),
            F.lit(', "include_actions": '), plain("include_actions"),
            F.lit(', "max_tokens": '), plain("max_tokens"),
            F.lit(', "render": '), text("render"),
            F.lit(', "selector_hint": '), text("selector_hint"),
            F.lit("}"),
        )
    )


def cache_key(url: Column, content: Column, digest: Column) -> Column:
    return F.concat_ws("|", url, F.sha2(content, 256), digest)


def cache_keys(requests: DataFrame, content: str = "markdown") -> DataFrame:
    """Add ``digest``, ``probe_key`` (no content yet) and ``content_key``."""
    r = requests.withColumn("digest", options_digest())
    return r.withColumns(
        {
            "probe_key": cache_key(F.col("url"), F.lit(""), F.col("digest")),
            "content_key": cache_key(F.col("url"), F.col(content), F.col("digest")),
        }
    )


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replay rows sorted by key and time; the open entry is all that is kept between rows.

    A row with ``carried`` set is not a request but the entry a key brings along.
    """
    key, expires, stored = None, _NEVER, _NEVER
    for batch in batches:
        hit, keep, since = [], [], []
        columns = [batch.column(c).to_pylist() for c in ("key", "us", "ttl_us", "storable", "carried")]
        for k, us, ttl, storable, carried in zip(*columns):
            if k != key:
                key, expires, stored = k, _NEVER, _NEVER
            if carried:
                expires, stored = us + ttl, us
                hit.append(False), keep.append(False), since.append(stored)
                continue
            fresh = us <= expires
            put = not fresh and storable
            if put:
                expires, stored = us + ttl, us
            hit.append(fresh), keep.append(put), since.append(stored if fresh or put else _NEVER)
        marks = [pa.array(hit, pa.bool_()), pa.array(keep, pa.bool_()), pa.array(since, pa.int64())]
        out = pa.RecordBatch.from_arrays(batch.columns + marks, names=batch.schema.names + ["hit", "stored", "stored_us"])
        yield out.filter(pa.compute.invert(out.column("carried")))


def _with_marks(schema: T.StructType) -> T.StructType:
    return (
        T.StructType(list(schema.fields))
        .add("hit", T.BooleanType()).add("stored", T.BooleanType()).add("stored_us", T.LongType())
    )


def _replay_sorted(rows: DataFrame) -> DataFrame:
    """Replay where all rows of a key may share a task."""
    if "carried" not in rows.columns:
        rows = rows.withColumn("carried", F.lit(False))
    ordered = rows.repartition("key").sortWithinPartitions("key", F.desc("carried"), "us", "id")
    return ordered.mapInArrow(_scan, _with_marks(rows.schema)).drop("carried")


def cache_replay(requests: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Outcome of each request against a TTL cache.

    Input: key, ts, id, ttl (seconds), storable, use_cache and any further columns. Output adds
    ``outcome`` (hit, miss, bypass), ``stored``, and ``stored_at`` of the entry that served or
    was made. Ties in time are replayed in order of ``id``.
    """
    r = requests.withColumns(
        {"us": F.unix_micros("ts"), "ttl_us": F.col("ttl").cast("long") * 1_000_000}
    ).drop("ts")
    live = F.col("use_cache") & (F.col("ttl_us") > 0)
    rows = r.where(live)
    # Keys beyond the limit: at most (number of rows / hot_rows) of them, so this set and all per-key
    # entries of the waves are small enough to broadcast, and no join moves the rows of a hot key.
    hot = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("key")
    if hot.isEmpty():
        done = _replay_sorted(rows)
    else:
        light = rows.join(F.broadcast(hot), "key", "left_anti")
        heavy = rows.join(F.broadcast(hot), "key", "left_semi")
        done = _replay_sorted(light).unionByName(_replay_hot(heavy, hot_rows))
    marked = done.withColumn("outcome", F.when(F.col("hit"), "hit").otherwise("miss"))
    bypass = r.where(~live).withColumns(
        {"hit": F.lit(False), "stored": F.lit(False), "stored_us": F.lit(_NEVER).cast("long"), "outcome": F.lit("bypass")}
    )
    out = marked.unionByName(bypass)
    return out.withColumns(
        {
            "ts": F.timestamp_micros("us"),
            "stored_at": F.when(F.col("stored_us") > _NEVER, F.timestamp_micros("stored_us")),
        }
    ).drop("us", "ttl_us", "hit", "stored_us")


def _replay_hot(rows: DataFrame, hot_rows: int) -> DataFrame:
    """Replay of keys too large for one task, in waves over time.

    Time is cut into slices no longer than the shortest life, so a key stores at most once
    per slice. Neighbouring slices form one wave while no key has more than ``hot_rows`` rows in
    it, and are replayed by the sorted pass with the entries carried in. A slice in which some
    key alone has more is a wave by itself: its store, if any, is the earliest storable row
    after the carried entry ends, which is a plain (map-side combined) minimum. So the number of
    waves is bounded by the span of the log over the shortest life and by rows over ``hot_rows``.
    """
    spark = rows.sparkSession
    folder = f"{checkpoint_dir(spark)}/replay-{uuid.uuid4().hex}"
    rows.repartitionByRange("us", "key").sortWithinPartitions("us").write.parquet(f"{folder}/rows")
    table = spark.read.parquet(f"{folder}/rows")
    width = table.agg(F.min("ttl_us")).first()[0]
    table = table.withColumn("slice", F.expr(f"(us - pmod(us, {width}L)) div {width}L"))
    load = table.groupBy("slice", "key").count().groupBy("slice").agg(F.max("count").alias("n")).orderBy("slice")
    waves, first, last, total = [], None, None, 0
    for slice_, n in load.toLocalIterator():
        if first is not None and total + n > hot_rows:
            waves.append((first, last, total))
            first, total = None, 0
        first = slice_ if first is None else first
        last, total = slice_, total + n
    if first is not None:
        waves.append((first, last, total))
    entry = T.StructType([f for f in table.schema.fields if f.name in ("key", "us", "ttl_us")])
    state = spark.createDataFrame([], entry)
    for i, (first, last, n) in enumerate(waves):
        # Reading by time range lets the scan skip files and row groups of other waves.
        part = table.where((F.col("us") >= int(first) * width) & (F.col("us") < (int(last) + 1) * width)).drop("slice")
        if n <= hot_rows:
            carried = state.withColumn("carried", F.lit(True))
            marked = _replay_sorted(part.withColumn("carried", F.lit(False)).unionByName(carried, allowMissingColumns=True))
        else:
            marked = _replay_slice(part, state)
        marked.write.parquet(f"{folder}/marked/wave={i}")
        made = spark.read.parquet(f"{folder}/marked/wave={i}").where("stored").select("key", "us", "ttl_us")
        newest = state.unionByName(made).groupBy("key").agg(F.max(F.struct("us", "ttl_us")).alias("e"))
        newest.select("key", "e.us", "e.ttl_us").write.parquet(f"{folder}/state/{i}")
        state = spark.read.parquet(f"{folder}/state/{i}")
    return spark.read.parquet(f"{folder}/marked").drop("wave")


def _replay_slice(part: DataFrame, state: DataFrame) -> DataFrame:
    """One slice in which a key stores at most once; rows of a key are never grouped."""
    open_until = state.select("key", F.col("us").alias("in_us"), (F.col("us") + F.col("ttl_us")).alias("in_expires"))
    e = part.join(F.broadcast(open_until), "key", "left").withColumn("in_expires", F.coalesce("in_expires", F.lit(_NEVER)))
    late = F.col("us") > F.col("in_expires")
    put = e.where(late & F.col("storable")).groupBy("key").agg(F.min(F.struct("us", "id", "ttl_us")).alias("put"))
    e = e.join(F.broadcast(put), "key", "left")
    stored = (F.col("put.us") == F.col("us")) & (F.col("put.id") == F.col("id"))
    after = F.struct("us", "id") > F.struct("put.us", "put.id")
    fresh = ~late | (F.col("put").isNotNull() & after)
    e = e.withColumns({"hit": F.coalesce(fresh, F.lit(False)), "stored": F.coalesce(stored, F.lit(False))})
    since = F.when(~late, F.col("in_us")).when(F.col("hit") | F.col("stored"), F.col("put.us")).otherwise(_NEVER)
    return e.withColumn("stored_us", since.cast("long")).select(*part.columns, "hit", "stored", "stored_us")


def content_dedup(responses: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Same URL, content and options seen again: the earlier result is served.

    Input: url, ts, id, ttl, the five options, markdown, has_error, use_cache. Empty or failed
    results are neither looked up nor stored. ``cached_at`` is when the served copy was made.
    """
    r = cache_keys(responses)
    usable = (F.col("markdown") != "") & ~F.col("has_error")
    r = r.withColumns(
        {"key": F.col("content_key"), "storable": F.lit(True), "use_cache": F.col("use_cache") & usable}
    ).drop("markdown", "content_key", "probe_key", "digest")
    out = cache_replay(r, hot_rows)
    hit = F.col("outcome") == "hit"
    return out.withColumns(
        {
            "cached": hit,
            "cached_at": F.when(hit, F.col("stored_at")),
            "strategy": F.when(hit, "cache").otherwise("static"),
        }
    )


def cache_kpis(replayed: DataFrame, every: str = "1 hour") -> DataFrame:
    """Requests, hits and hit rate per host and time window."""
    hit = (F.col("outcome") == "hit").cast("int")
    return (
        replayed.groupBy(F.window("ts", every).alias("w"), urls.netloc(F.col("url")).alias("host"))
        .agg(F.count("*").alias("requests"), F.sum(hit).alias("hits"), F.sum(F.col("stored").cast("int")).alias("stores"))
        .select(
            F.col("w.start").alias("window_start"), "host", "requests", "hits", "stores",
            F.round(F.col("hits") / F.col("requests"), 6).alias("hit_rate"),
        )
    )


def revalidations(replayed: DataFrame) -> DataFrame:
    """``replayed`` (id, key, ts, stored, content) with ``revalidated``: whether a store after the first of its key found the content unchanged.

    Null where nothing was stored or nothing had been. Only stores are compared with each other; a key has at most one
    in each life of an entry.
    """
    order = W.partitionBy("key").orderBy("ts", "id")
    stores = replayed.where("stored").select("id", "key", "ts", F.sha2("content", 256).alias("digest"))
    before = F.lag("digest").over(order)
    same = stores.select("id", F.when(before.isNotNull(), before == F.col("digest")).alias("revalidated"))
    return replayed.join(same, "id", "left")


def revalidation_kpis(checked: DataFrame, every: str = "1 hour") -> DataFrame:
    """Per host and window: requests, stores, refreshes (stores of a key stored before), revalidated ones and their share."""
    again = F.col("revalidated")
    g = checked.groupBy(F.window("ts", every).alias("w"), urls.netloc(F.col("url")).alias("host")).agg(
        F.count("*").alias("requests"), F.sum(F.col("stored").cast("int")).alias("stores"),
        F.count(again).alias("refreshes"), F.count(F.when(again, 1)).alias("revalidated"))
    share = F.round(F.col("revalidated") / F.nullif(F.col("refreshes"), F.lit(0)), 6)
    return g.select(F.col("w.start").alias("window_start"), "host", "requests", "stores", "refreshes", "revalidated", share.alias("revalidated_share"))


def rate_flags(requests: DataFrame, limit: int, every: str = "1 minute") -> DataFrame:
    """Hosts and windows with more requests than the limit allows."""
    return (
        requests.groupBy(F.window("ts", every).alias("w"), urls.netloc(F.col("url")).alias("host"))
        .agg(F.count("*").alias("requests"))
        .select(
            F.col("w.start").alias("window_start"), "host", "requests",
            (F.col("requests") > limit).alias("rate_limited"),
            F.greatest(F.col("requests") - limit, F.lit(0)).alias("over"),
        )
    )


def sliding_flags(requests: DataFrame, limit: int, seconds: int = 60, block_seconds: int = 60) -> DataFrame:
    """id, host, in_window, rate_limited of every request (id, ts, url): requests of its host in the ``seconds`` up to it, itself and equal times included; ids name requests.

    The number is a difference of two running counts, at the request and ``seconds`` before it. A running count is what
    its block of time is carried in (from counts of blocks and of days) and the count inside the block, so a host
    is only ever brought together block by block.
    """
    us, block, day = F.col("us"), block_seconds * 1_000_000, 86_400 * 1_000_000
    r = requests.select("id", urls.netloc(F.col("url")).alias("host"), F.unix_micros("ts").alias("us"))
    points = r.select("id", "host", F.explode(F.array(
        F.struct(us.alias("at"), F.lit(1).alias("one")), F.struct((us - seconds * 1_000_000).alias("at"), F.lit(0).alias("one")),
    )).alias("p")).select("id", "host", "p.*")
    points = points.withColumns({"block": F.floor(F.col("at") / block), "day": F.floor(F.floor(F.col("at") / block) * block / day)})
    blocks = points.groupBy("host", "day", "block").agg(F.sum("one").alias("n"))
    days = blocks.groupBy("host", "day").agg(F.sum("n").alias("n"))
    before = lambda *keys: W.partitionBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    days = days.select("host", "day", F.coalesce(F.sum("n").over(before("host").orderBy("day")), F.lit(0)).alias("days_before"))
    blocks = blocks.withColumn("blocks_before", F.coalesce(F.sum("n").over(before("host", "day").orderBy("block")), F.lit(0)))
    carried = blocks.join(days, ["host", "day"]).select("host", "block", (F.col("days_before") + F.col("blocks_before")).alias("carried"))
    inside = F.sum("one").over(W.partitionBy("host", "block").orderBy("at").rangeBetween(W.unboundedPreceding, 0))
    counted = points.withColumn("inside", inside).join(carried, ["host", "block"])
    total = F.col("carried") + F.col("inside")
    out = counted.groupBy("id", "host").agg(F.sum(F.when(F.col("one") == 1, total).otherwise(-total)).alias("in_window"))
    return out.withColumn("rate_limited", F.col("in_window") > limit)


def normalised_keys(requests: DataFrame, pattern: str = rules.TRACKING_PARAMETER) -> DataFrame:
    """Groups of URLs that share a normalised form: how many forms and requests each merges.

    URLs are counted first, so a URL with a third of all requests reaches its group as one row.
    """
    counted = requests.groupBy("url").agg(F.count("*").alias("n"))
    return counted.groupBy(urls.normalised(F.col("url"), pattern).alias("norm_url")).agg(
        F.count("*").alias("forms"), F.sum("n").alias("requests"), F.min("url").alias("first_url")
    )
