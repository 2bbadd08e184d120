"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import gathered, written


def _both(e: DataFrame) -> DataFrame:
    return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(e: DataFrame) -> DataFrame:
    """Each node hands the smallest node around it to its larger neighbours."""
    both = _both(e)
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(e: DataFrame) -> DataFrame:
    """Each node connects itself and its smaller neighbours to the smallest of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    turned = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return turned.union(low.select("u", F.col("m").alias("v"))).distinct()


def hooked(links: DataFrame, steps: int = 2) -> DataFrame:
    """node, comp after a few steps: every component takes the smallest one around it, then that one's smallest.

    Labels stay inside the components of ``links``, but a component may still have several.
    """
    comp, rows = None, 2 * links.count()
    for _ in range(steps):
        e = _both(links)
        if comp is not None:
            one = lambda c: comp.select(F.col("node").alias(c), F.col("comp").alias(f"{c}c"))
            e = e.join(one("u"), "u").join(one("v"), "v").select(F.col("uc").alias("u"), F.col("vc").alias("v"))
        low = written(gathered(e.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("comp")), rows))
        up = low.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        step = low.join(up, "comp").select("node", F.col("top").alias("comp"))
        if comp is not None:
            step = comp.join(step.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp").select("node", F.col("top").alias("comp"))
        comp = written(gathered(step, rows))
    return comp


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) of every node of ``links`` (u, v) but those that are their own smallest.

    Stars shrink in a number of steps that grows with the logarithm of the longest chain. Hubs are combined before they
    are shuffled; every step is written to the shared folder. Null ends and loops are ignored.
    """
    e = links.select("u", "v").where("u is not null and v is not null and u <> v")
    mark, rows = None, 2 * e.count()
    while True:
        e = written(gathered(_small_star(_large_star(e)), rows))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        mark, rows = now, 2 * now[0]
