"""TTL cache over a request stream in event time, on ``transformWithState`` with RocksDB.

Keys share state by buckets of their hash, since each call of a state or timer costs far more than a request. Requests wait
in state by slots of time; when the watermark has passed a slot, its requests are replayed in time order, so the
outcome does not depend on how requests were dealt to micro-batches. A micro-batch of a bucket is put into state some
frames at a time and never put together; what is sorted at once is one slot of one bucket. Requests behind the watermark come out at once with
the outcome ``late`` and touch nothing. A stream can start from the entries that a batch replay left open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagelake.streaming.cache_stream import OUT

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A request with this id only moves the clock (the watermark) on.
CLOCK = -1
#: Groups of keys that share state.
BUCKETS = 1024
#: Requests of a micro-batch that are held before they go into state.
HELD = 50_000
_REQUESTS = pa.schema({"key": pa.string(), "us": pa.int64(), "id": pa.int64(), "ttl_us": pa.int64(), "storable": pa.int64(), "use_cache": pa.int64()})
_ENTRIES = pa.schema({"key": pa.string(), "expires": pa.int64(), "stored": pa.int64()})


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(data)).read_all()


class Replay(StatefulProcessor):
    def __init__(self, slot_ms: int):
        self.slot = slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getValueState("entries", "entries binary")
        self.parts = handle.getMapState("parts", "slot bigint", "parts bigint")
        self.waiting = handle.getMapState("waiting", "slot bigint, part bigint", "requests binary")

    def _open(self) -> dict[str | None, tuple[int, int]]:
        """Expiry and time of storing of each key's entry."""
        if not self.entries.exists():
            return {}
        key, expires, stored = (c.to_pylist() for c in _unpacked(self.entries.get()[0]).columns)
        return dict(zip(key, zip(expires, stored)))

    def _keep(self, entries: dict[str | None, tuple[int, int]]) -> None:
        if not entries:
            self.entries.clear()
            return
        expires, stored = zip(*entries.values())
        self.entries.update((_packed(pa.table([list(entries), expires, stored], schema=_ENTRIES)),))
        # At the end of the slot in which the first entry ends: requests of that slot may still meet it.
        self.handle.registerTimer((min(expires) // 1000 // self.slot + 1) * self.slot)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        entries = self._open()
        for k, expires, stored in zip(initialState["key"].tolist(), initialState["expires"].tolist(), initialState["stored"].tolist()):
            entries[k] = max(entries.get(k, (expires, stored)), (expires, stored))
        self._keep(entries)

    def _wait(self, frames: list[pd.DataFrame]) -> None:
        pdf = pd.concat(frames)
        for slot, part in pdf.groupby(pdf["us"] // 1000 // self.slot):
            at = (int(slot),)
            n = self.parts.getValue(at)[0] if self.parts.containsKey(at) else 0
            self.waiting.updateValue((*at, n), (_packed(pa.Table.from_pandas(part, _REQUESTS, preserve_index=False)),))
            self.parts.updateValue(at, (n + 1,))
            if not n:
                self.handle.registerTimer((at[0] + 1) * self.slot)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        frames, held = [], 0
        for pdf in rows:
            pdf = pdf[pdf["id"] != CLOCK]
            late = pdf[pdf["us"] // 1000 < now]
            if len(late):
                yield pd.DataFrame({"id": late["id"], "key": late["key"], "us": late["us"], "outcome": "late", "stored": False, "stored_us": pd.array([None] * len(late), dtype="Int64")})
            frames.append(pdf[pdf["us"] // 1000 >= now])
            held += len(frames[-1])
            if held >= HELD:
                self._wait(frames)
                frames, held = [], 0
        if held:
            self._wait(frames)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        slot = (end // self.slot - 1,)
        entries = self._open()
        if self.parts.containsKey(slot):
            places = [(*slot, n) for n in range(self.parts.getValue(slot)[0])]
            block = pa.concat_tables([_unpacked(self.waiting.getValue(p)[0]) for p in places]).sort_by([("us", "ascending"), ("id", "ascending")])
            for p in places:
                self.waiting.removeKey(p)
            self.parts.removeKey(slot)
            outcome, keep, since = [], [], []
            for k, us, ttl, storable, use in zip(*(block.column(c).to_pylist() for c in ("key", "us", "ttl_us", "storable", "use_cache"))):
                if not use or ttl <= 0:
                    outcome.append("bypass"), keep.append(False), since.append(None)
                    continue
                expires, stored = entries.get(k, (-1, -1))
                hit = us <= expires
                put = not hit and bool(storable)
                if put:
                    entries[k] = us + ttl, us
                    stored = us
                outcome.append("hit" if hit else "miss"), keep.append(put), since.append(stored if hit or put else None)
            yield pd.DataFrame({"id": block.column("id").to_numpy(), "key": block.column("key").to_pylist(), "us": block.column("us").to_numpy(), "outcome": outcome, "stored": keep, "stored_us": pd.array(since, dtype="Int64")})
        self._keep({k: e for k, e in entries.items() if e[0] // 1000 >= end})

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """The state store of streams started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def open_entries(replayed: DataFrame) -> DataFrame:
    """key, expires, stored of the last entry of each key of a batch replay (key, ts, ttl, stored)."""
    us = F.unix_micros("ts")
    last = F.max(F.struct(us.alias("us"), (us + F.col("ttl").cast("long") * 1_000_000).alias("expires")))
    return replayed.where("stored").groupBy("key").agg(last.alias("e")).select("key", "e.expires", F.col("e.us").alias("stored"))


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))


def ttl_stream(requests: DataFrame, late: str = "1 hour", slot_seconds: int = 3600, start: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """id, key, us, outcome, stored, stored_us of a stream of requests (id, key, ts, ttl, storable, use_cache).

    ``start`` (key, expires, stored) are entries open at the beginning. Outcomes come when the watermark has passed a
    request's slot of ``slot_seconds``; a request with id ``CLOCK`` moves it on. A stream that goes on from its checkpoint
    must keep its number of ``buckets``.
    """
    use_rocksdb(requests.sparkSession)
    # The time goes on as a number: Spark would drop requests behind the watermark before they could be told apart.
    r = requests.withWatermark("ts", late).select(
        "id", "key", F.unix_micros("ts").alias("us"), (F.col("ttl").cast("long") * 1_000_000).alias("ttl_us"),
        F.col("storable").cast("long").alias("storable"), F.col("use_cache").cast("long").alias("use_cache"))
    entries = _bucketed(start.select("key", "expires", "stored"), buckets).groupBy("bucket") if start is not None else None
    return _bucketed(r, buckets).groupBy("bucket").transformWithStateInPandas(Replay(slot_seconds * 1000), OUT, "Append", "EventTime", entries)
