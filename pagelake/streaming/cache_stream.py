"""Streaming forms of the cache: TTL replay with keyed state, KPIs, and page extraction per micro-batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagelake.functions import urls
from pagelake.session import checkpoint_dir

OUT = "id bigint, key string, us bigint, outcome string, stored boolean, stored_us bigint"
STATE = "expires bigint, stored bigint"


def _serve(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    expires, stored = state.get if state.exists else (-1, -1)
    pdf = pd.concat(list(batches)).sort_values(["us", "id"], kind="stable")
    outcome, keep, since = [], [], []
    for us, ttl, storable, use in zip(pdf["us"].tolist(), pdf["ttl_us"].tolist(), pdf["storable"].tolist(), pdf["use_cache"].tolist()):
        if not use or ttl <= 0:
            outcome.append("bypass"), keep.append(False), since.append(None)
            continue
        hit = us <= expires
        put = not hit and storable
        if put:
            expires, stored = us + ttl, us
        outcome.append("hit" if hit else "miss"), keep.append(put), since.append(stored if hit or put else None)
    if expires >= 0:
        state.update((expires, stored))
        # Expired entries are freed once no request they could serve can still arrive.
        state.setTimeoutTimestamp(max(expires // 1000 + 1, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(
        {"id": pdf["id"], "key": key[0], "us": pdf["us"], "outcome": outcome, "stored": keep,
         "stored_us": pd.array(since, dtype="Int64")}
    )


def cache_stream(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """TTL replay of a request stream (id, key, ts, ttl, storable, use_cache).

    Requests of one micro-batch are replayed in time order; a request older than the watermark
    is dropped, because the entry that was open at its time is gone. The trigger limits of the
    source bound what a key can bring into one micro-batch.
    """
    r = requests.withWatermark("ts", late).withColumns(
        {"us": F.unix_micros("ts"), "ttl_us": F.col("ttl").cast("long") * 1_000_000}
    )
    return r.select("id", "key", "ts", "us", "ttl_us", "storable", "use_cache").groupBy("key").applyInPandasWithState(
        _serve, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def kpi_stream(outcomes: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Hit counts per host and window of a stream of outcomes (ts, url, outcome); final windows only."""
    hit = (F.col("outcome") == "hit").cast("int")
    return (
        outcomes.withWatermark("ts", late)
        .groupBy(F.window("ts", every).alias("w"), urls.netloc(F.col("url")).alias("host"))
        .agg(F.count("*").alias("requests"), F.sum(hit).alias("hits"))
        .select(F.col("w.start").alias("window_start"), "host", "requests", "hits")
    )


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process what the source has now into a parquet folder of the checkpoint directory, and read it."""
    spark = stream.sparkSession
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.outputMode(mode).format("parquet")
        .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_pages(pages: DataFrame, extract: Callable[[DataFrame], DataFrame], checkpoint: str, path: str):
    """Extract a stream of pages batch by batch; pages do not depend on each other, so this is exact.

    Each batch writes its own folder, so a batch that is run again after a failure replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        extract(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
