"""URL filter: a blocked Bloom filter passes possible hits, an exact hash join removes the false ones.

The list holds two kinds of entries in one table: rules (host and path prefix, allow or block) and canonical URLs that
are listed as bad. Every URL asks for a few keys: its canonical form, and every pair of a host suffix and a path prefix
as long as some rule's. The filter is probed in the map tasks, so only possible hits are shuffled. Its size follows the
list up to ``max_blocks``; a longer list gets fewer bits an entry and hence more false hits, never a wrong verdict.

Null and malformed URLs have an empty host and path, no keys, and the verdict ``allow``. A verdict depends on the URL
alone, so repeated rows and repeated or null ids get the verdict of their URL. Of rules of equal length that fit, the
longer host wins, then block before allow. An empty list allows everything.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import mix, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A block is eight words of 64 bits; a key sets one bit in each word of its block.
WORDS, KEYS_PER_BLOCK, MAX_BLOCKS = 8, 40, 1 << 18
_SEEDS = [int(x) for x in mix(np.arange(1, WORDS + 1, dtype=np.uint64)).view(np.int64)]


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without final slashes, query without tracking parameters; null if there is no host."""
    query = F.regexp_extract(_rest(url), "^[^?#]*[?]([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, "(^|&)(utm_|ref=)[^&]*", ""), "^&+", "")
    h = F.regexp_replace(host(url), "^(www|m)[.]", "")
    whole = F.concat(h, F.regexp_replace(path(url), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(h != "", whole)


def entries(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """key, kind, rule, verdict: ``rules`` has host, path, verdict; ``listed`` has a column url."""
    r = rules.where("host <> '' and path is not null and verdict in ('allow', 'block')").select(
        F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_len"))
    r = r.groupBy("rule", "host_len").agg(F.max("verdict").alias("verdict"))
    u = listed.select(canonical(F.col("url")).alias("c")).where("c is not null").distinct()
    return r.select(F.concat(F.lit("r"), "rule").alias("key"), "rule", "verdict", "host_len").unionByName(
        u.select(F.concat(F.lit("u"), "c").alias("key"), F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"), F.lit(0).alias("host_len")))


def bloom(keys: DataFrame, max_blocks: int = MAX_BLOCKS) -> np.ndarray:
    """Words of the filter, at most 64 bytes times ``max_blocks``."""
    n = keys.count()
    blocks = int(min(max(1, -(-n // KEYS_PER_BLOCK)), max_blocks))
    h = keys.select(F.xxhash64("key").alias("h")).select(F.pmod(F.shiftright("h", 20), F.lit(blocks)).alias("block"), "h")
    bit = lambda w: F.expr(f"shiftleft(1L, cast(pmod(shiftright(xxhash64(h, {_SEEDS[w]}L), 9), 64) as int))")
    rows = h.groupBy("block").agg(*[F.bit_or(bit(w)).alias(f"w{w}") for w in range(WORDS)]).toPandas()
    out = np.zeros((blocks, WORDS), np.int64)
    if len(rows):
        out[rows["block"].to_numpy()] = rows[[f"w{w}" for w in range(WORDS)]].to_numpy()
    return out.view(np.uint64)


def probe(spark, filter_words: np.ndarray):
    """A test of keys against the filter, which travels to the executors once. False means surely not listed."""
    shared = spark.sparkContext.broadcast(filter_words)

    @F.pandas_udf("boolean")
    def maybe(block: pd.Series, bits: pd.Series) -> pd.Series:
        # bits holds eight positions of six bits each
        f, b, p = shared.value, block.to_numpy(), bits.to_numpy()
        ok = np.ones(len(b), bool)
        for w in range(f.shape[1]):
            at = ((p >> (6 * w)) & 63).astype(np.uint64)
            ok &= ((f[b, w] >> at) & np.uint64(1)).astype(bool)
        return pd.Series(ok)

    blocks = len(filter_words)

    def call(key: Column) -> Column:
        h = F.xxhash64(key)
        packed = F.lit(0).cast("bigint")
        for w, seed in enumerate(_SEEDS):
            packed = packed + F.shiftleft(F.pmod(F.shiftright(F.xxhash64(h, F.lit(seed)), 9), F.lit(64)).cast("bigint"), 6 * w)
        return maybe(F.pmod(F.shiftright(h, 20), F.lit(blocks)), packed)

    return call


def _wanted(rules: DataFrame) -> tuple[int, list[int]]:
    """Most labels of a rule's host, and the lengths of the rules' paths."""
    s = rules.agg(F.max(F.size(F.split("host", "[.]"))).alias("labels"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths")).first()
    return s.labels or 0, list(s.lengths or [])


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id") -> DataFrame:
    """id, host, path, rule, verdict and listed of every row of ``pages`` (a column url)."""
    spark = pages.sparkSession
    listing = written(entries(rules, listed))
    maybe = probe(spark, bloom(listing.select("key").distinct()))
    labels, lengths = _wanted(rules)
    urls = pages.select("url").where("instr(url, '://') > 0").distinct().select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    parts = F.split("host", "[.]")
    suffix = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(labels, 1)))), lambda i: F.array_join(F.slice(parts, -i, i), "."))
    prefix = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    ruled = F.flatten(F.transform(suffix, lambda s: F.transform(F.filter(prefix, lambda p: p.isNotNull()), lambda p: F.concat(F.lit("r"), s, p))))
    c = canonical(F.col("url"))
    keys = F.concat(F.when(F.col("host") != "", ruled).otherwise(F.array().cast("array<string>")), F.when(c.isNotNull(), F.array(F.concat(F.lit("u"), c))).otherwise(F.array().cast("array<string>")))
    hits = urls.select("url", F.explode(F.array_distinct(keys)).alias("key")).where(maybe(F.col("key")))
    exact = hits.join(listing, "key")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "host_len", "verdict", "rule")))
    found = exact.groupBy("url").agg(best.alias("best"), F.max(F.col("rule").isNull()).alias("listed"))
    out = pages.select(F.col(id_col), "url").join(found, "url", "left")
    listed_col = F.coalesce("listed", F.lit(False))
    return out.select(
        id_col, host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.when(listed_col, "block").otherwise("allow")).alias("verdict"), listed_col.alias("listed"),
    )
