"""MinHash near-duplicates with an LSH forest: sorted signature orders, neighbours by longest common prefix.

A signature of ``HASHES`` values is sorted in ``ORDERS`` orders, each starting at another value. Documents that stand
together with ``DEPTH`` or more equal leading values form a region; a region of more than ``REGION`` documents is dealt
out by a longer prefix and cut at deeper ones until its parts fit, so the depth follows how crowded the place is. A pair
cut apart in one order meets in others, or in round 4. Only candidates are compared whose signatures agree in ``AGREE`` of their values, and every link is
confirmed on the full shingle sets.

Regions are worked off in rounds, and links found so far join documents to components:
1. every document with the best of its neighbours in the orders and the middles of its regions (the middle is the
   document nearest to the most frequent value at each place of the signature),
2. every document outside a region's largest component with its best candidate in another component,
3. all candidates that are left between different components,
4. documents that share a region of more than ``REGION`` with another component, by an exact prefix-filter join: two sets
   similar enough share one of their rarest shingles, which are ordered by how many of these documents hold them. A
   shingle of many documents is dealt out in cells; lengths, places and the parity bits of the sets rule pairs out.
Thus no pair inside a component is ever made, and no candidate between components is dropped.

Equal sets are one node from the start. Texts without words have no set, link with nothing and are kept; null text
counts as empty. A null id takes no part: no component, kept. Rows that repeat an id are judged by their own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm import graph
from pagelake.llm.common import U64, mix, partitions, slices, written
from pagelake.llm.shingles import minhash, set_key, shingle_sets

HASHES, ORDERS, DEPTH, MAX_DEPTH, REGION, AGREE = 256, 16, 3, 32, 4096, 0.76
STEP = HASHES // ORDERS
FACTORS = mix(np.arange(7000, 7000 + HASHES, dtype=U64)) | U64(1)
#: Rounds of comparisons, in order.
ROUNDS = ("first", "best", "rest")
#: Parts a shingle's documents are counted in; documents of a cell of the join, cells a side at most; parity bits of a set.
SALTS, CELL, CELLS, BITS = 64, 4096, 64, 1024
#: Pairs that one numpy step of the join looks at.
TILE = 1 << 18
#: AGREE is four standard deviations of the estimate below the similarity of a link.
#: Ids that may travel with a map task instead of a shuffle of the texts.
SMALL_IDS = 1_000_000


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, data, offsets in slices(batches, "text"):
        sets = shingle_sets(data, offsets)
        some = [x for x in sets if len(x)]
        sig = iter(minhash(some, FACTORS).astype(">u2") if some else ())
        keys = [set_key(x) if len(x) else (None, None) for x in sets]
        yield pa.RecordBatch.from_arrays([
            b.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()),
            pa.array([k[1] for k in keys], pa.int64()), pa.array([next(sig).tobytes() if len(x) else None for x in sets], pa.binary()),
        ], ["doc_id", "n", "k1", "k2", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, data, offsets in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x.tobytes() for x in shingle_sets(data, offsets)], pa.binary())], ["doc_id", "shingles"])


def only_ids(df: DataFrame, ids: DataFrame, column: str = "doc_id", small: int = SMALL_IDS) -> DataFrame:
    """Rows of ``df`` with an id in ``ids``; a counted, small list of ids is broadcast, a longer one is not."""
    ids = ids.select(column).distinct()
    return df.join(F.broadcast(ids) if ids.count() <= small else ids, column, "left_semi")


def _crowded(nodes: DataFrame) -> DataFrame:
    """doc_id, ord, h, crowd: places where a document shares a region of an order with another component.

    ``h`` names the region, ``crowd`` counts its documents.
    """
    heads = F.array(*[F.struct(F.lit(t).alias("ord"), F.xxhash64(F.lit(t), F.substring("sig", 2 * STEP * t + 1, 2 * DEPTH)).alias("h")) for t in range(ORDERS)])
    p = nodes.select("doc_id", "comp", F.explode(heads).alias("x")).select("doc_id", "comp", "x.ord", "x.h")
    mixed = p.groupBy("h").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("crowd")).where("a <> b").select("h", "crowd")
    return p.join(mixed, "h").select("doc_id", "ord", "h", "crowd")


def _regions(lo: int, hi: int, lcp: np.ndarray, depth: int, most: int) -> Iterator[tuple[int, int]]:
    """Parts of the sorted rows ``lo`` to ``hi`` that share ``depth`` values, cut deeper where they hold more than ``most``."""
    cuts = np.flatnonzero(lcp[lo + 1:hi] < depth) + lo + 1
    for a, b in zip(np.append(lo, cuts).tolist(), np.append(cuts, hi).tolist()):
        if b - a <= 1:
            continue
        if b - a <= most:
            yield a, b
        elif depth < MAX_DEPTH:
            yield from _regions(a, b, lcp, depth + 1, most)
        else:
            for x in range(a, b, most):
                yield x, min(b, x + most)


def _middle(label: np.ndarray) -> int:
    votes = np.zeros(len(label), np.int64)
    for column in label.T:
        value, count = np.unique(column, return_counts=True)
        votes += column == value[count.argmax()]
    return int(votes.argmax())


def _shared_before(x: np.ndarray, y: np.ndarray, order: int) -> np.ndarray:
    """Whether two signatures, turned to ``order``, stand in one region of an earlier order too."""
    out = np.zeros(len(x), bool)
    for t in range(order):
        at = (np.arange(DEPTH) + STEP * (t - order)) % HASHES
        out |= (x[:, at] == y[:, at]).all(1)
    return out


def _pairs_in(rows: dict[str, np.ndarray], a: int, b: int, mode: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i, j and agreement of the candidates of the region ``a`` to ``b``."""
    label, n, comp, hot = (rows[c][a:b] for c in ("label", "n", "comp", "hot"))
    m = b - a
    fits = lambda i, j: (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= 85 * np.maximum(n[i], n[j]))
    if mode == "first":
        i = np.arange(m - 1)
        agree = (label[1:] == label[:-1]).mean(1)
        agree = np.where((agree >= AGREE) & fits(i, i + 1), agree, 0.0)
        after, before = np.append(agree, 0.0), np.append(0.0, agree)
        best = np.maximum(after, before)
        to = np.where(after >= before, np.arange(m) + 1, np.arange(m) - 1)
        if m > 4:  # the middle of the region, where it is as near
            c = _middle(label)
            near = (label == label[c]).mean(1)
            near = np.where((near >= AGREE) & fits(np.arange(m), np.full(m, c)), near, 0.0)
            to, best = np.where(near >= best - 0.05, c, to), np.maximum(best, near)
        i = np.flatnonzero(best > 0)
        return i, to[i], best[i]
    values, size = np.unique(comp, return_counts=True)
    is_outside = comp != values[size.argmax()]
    outside = np.flatnonzero(is_outside)
    found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    for part in np.array_split(outside, max(1, len(outside) * m // 40_000)):
        agree = (label[part][:, None, :] == label[None, :, :]).mean(2)
        agree[~fits(part[:, None], np.arange(m)[None, :])] = 0
        if mode == "best":
            j = agree.argmax(1)
            top = agree[np.arange(len(part)), j]
            found.append((part[top >= AGREE], j[top >= AGREE], top[top >= AGREE]))
            continue
        agree[(np.arange(m)[None, :] < part[:, None]) & is_outside[None, :]] = 0  # such a pair comes from its other end
        i, j = np.nonzero(agree >= AGREE)
        # A pair is made in the first order that has both in one region, if no crowded region is cut.
        new = (hot[part[i]] & hot[j]) | ~_shared_before(label[part[i]], label[j], int(rows["ord"][a]))
        found.append((part[i[new]], j[new], agree[i[new], j[new]]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _scan(mode: str, most: int):
    def emit(rows: dict[str, np.ndarray], lo: int, hi: int, lcp: np.ndarray) -> Iterator[pa.RecordBatch]:
        got = []
        for a, b in _regions(lo, hi, lcp, DEPTH, most):
            i, j, agree = _pairs_in(rows, a, b, mode)
            if len(i):
                got.append((rows["doc_id"][a + i], rows["doc_id"][a + j], agree))
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*got)], ["i", "j", "agree"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            new = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("h", "ord", "hot", "doc_id", "n", "comp")}
            data = b.column("label")
            new["label"] = np.frombuffer(data.buffers()[2], np.uint16, b.num_rows * HASHES, data.offset * 2 * HASHES).reshape(-1, HASHES)
            held = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in new}
            lcp = _lcp(held)
            ends = np.flatnonzero(lcp < DEPTH)
            cut = int(ends[-1]) if len(ends) and ends[-1] > 0 else 0
            if len(lcp) - cut > 4 * most:
                cut = len(lcp)
            yield from emit(held, 0, cut, lcp)
            held = {c: x[cut:] for c, x in held.items()}
        if held is not None and len(held["n"]):
            yield from emit(held, 0, len(held["n"]), _lcp(held))

    return run


def _lcp(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Leading values a row shares with the row before, up to ``MAX_DEPTH``; the first row shares none."""
    x, same = rows["label"][:, :MAX_DEPTH], rows["h"][1:] == rows["h"][:-1]
    equal = np.logical_and.accumulate(x[1:] == x[:-1], axis=1).sum(1) * same
    return np.append(0, equal)


def candidates(nodes: DataFrame, places: DataFrame, mode: str) -> DataFrame:
    """Pairs u < v of ``nodes`` (doc_id, n, comp, sig) in different components that one round compares.

    A region of more than ``REGION`` documents is spread over tasks by a longer prefix, the longer the more it holds.
    """
    hot = places.where(F.col("crowd") > REGION).select("doc_id").distinct().withColumn("hot", F.lit(True))
    at = 2 * STEP * F.col("ord")
    label = F.concat(F.substring("sig", at + 1, F.lit(2 * HASHES)), F.substring("sig", F.lit(1), at))
    depth = F.least(F.when(F.col("crowd") <= REGION, DEPTH).otherwise(DEPTH + F.ceil(F.log(F.col("crowd") / REGION) * 4.5)), F.lit(MAX_DEPTH)).cast("int")
    rows = places.join(nodes, "doc_id").join(hot, "doc_id", "left").select("h", "ord", F.coalesce("hot", F.lit(False)).alias("hot"), "doc_id", "n", "comp", label.alias("label"), depth.alias("depth"))
    rows = rows.repartition(partitions(nodes.sparkSession), F.xxhash64("h", F.substring("label", F.lit(1), 2 * F.col("depth")))).drop("depth").sortWithinPartitions("h", "label", "doc_id")
    c = rows.mapInArrow(_scan(mode, REGION), "i bigint, j bigint, agree double")
    if mode != "rest":
        c = c.groupBy("i").agg(F.max(F.struct("agree", "j")).alias("x")).select("i", F.col("x.j").alias("j"))
    return c.select(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = np.zeros(b.num_rows, bool)
        for k, (x, y) in enumerate(zip(b.column("su"), b.column("sv"))):
            x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
            both = len(x) + len(y) - len(np.union1d(x, y)) if len(x) * len(y) else 0
            keep[k] = both > 0 and 100 * both >= 85 * (len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"]).filter(pa.array(keep))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= 85 * union."""
    one = lambda c: sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"s{c}"))
    return pairs.join(one("u"), "u").join(one("v"), "v").select("u", "v", "su", "sv").mapInArrow(_confirm, "u bigint, v bigint")


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets with their key, size and for each of ``BITS`` classes of shingles whether the set holds an odd number of it."""
    for b in batches:
        sets = [np.frombuffer(x.as_buffer(), U64) for x in b.column("shingles")]
        if not sets:
            continue
        keys = [set_key(x) for x in sets]
        odd = [np.packbits((np.bincount((x % U64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes() for x in sets]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([
            b.column("doc_id"), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([len(x) for x in sets], pa.int64()),
            pa.array(odd, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64))),
        ], ["doc_id", "k1", "k2", "n", "odd", "shingles"])


def _alike(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Pairs of whole cells that no bound rules out; in a cell of two parts only pairs across them."""
    size = len(rows["n"])
    new = np.append(True, (rows["s"][1:] != rows["s"][:-1]) | (rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1]))
    start = np.flatnonzero(new)
    cell = np.cumsum(new) - 1
    first = start[cell]
    across = rows["a"] != rows["b"]
    low = np.add.reduceat((rows["own"] == rows["a"]).astype(np.int64), start)[cell]
    partners = np.where(across, np.where(rows["own"] == rows["b"], low, 0), np.arange(size) - first)
    total = np.cumsum(partners)
    lo = 0
    while lo < size:
        done = int(total[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + TILE, "right")))
        count = partners[lo:hi]
        i = np.repeat(np.arange(lo, hi), count)
        j = first[i] + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        lo = hi
        ni, nj = rows["n"][i], rows["n"][j]
        need = (85 * (ni + nj) + 184) // 185  # shared shingles of a link
        fits = (rows["comp"][i] != rows["comp"][j]) & (np.minimum(ni - rows["at"][i], nj - rows["at"][j]) >= need) & (np.minimum(ni, nj) >= need)
        i, j, most = i[fits], j[fits], (ni + nj - 2 * need)[fits]
        fits = np.bitwise_count(rows["odd"][i] ^ rows["odd"][j]).sum(1, dtype=np.int64) <= most
        u, v = rows["doc_id"][i[fits]], rows["doc_id"][j[fits]]
        if len(u):
            pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        new = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("s", "a", "b", "own", "doc_id", "comp", "n", "at")}
        data = b.column("odd")
        new["odd"] = np.frombuffer(data.buffers()[2], np.uint8, b.num_rows * BITS // 8, data.offset * BITS // 8).reshape(-1, BITS // 8).view(U64)
        last = tuple(new[c][-1] for c in ("s", "a", "b"))
        if held is not None:
            new = {c: np.concatenate([held[c], new[c]]) for c in new}
        cut = int(np.argmax((new["s"] == last[0]) & (new["a"] == last[1]) & (new["b"] == last[2])))
        if cut:
            yield from _alike({c: x[:cut] for c, x in new.items()})
        held = {c: x[cut:] for c, x in new.items()}
    if held is not None:
        yield from _alike(held)


def crowded_pairs(nodes: DataFrame, hot: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs u < v of the documents ``hot`` in different components; every pair of similar sets is among them.

    Of sets in one order of shingles, rarest first, those similar to a set of n hold one of its first n - ceil(0.85 n) + 1.
    """
    key = ["doc_id", "k1", "k2"]
    docs = only_ids(sets, hot).mapInArrow(_marked, "doc_id bigint, k1 bigint, k2 bigint, n bigint, odd binary, shingles array<bigint>").dropDuplicates(key)
    docs = written(docs.join(nodes.select("doc_id", "comp").distinct(), "doc_id"))
    held = docs.select(*key, "comp", F.explode("shingles").alias("s")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    parts = held.groupBy("s", "salt").agg(F.count("*").alias("c"), F.min("comp").alias("a"), F.max("comp").alias("b"))
    counts = parts.groupBy("s").agg(F.sum("c").alias("c"), (F.min("a") != F.max("b")).alias("mixed"), F.collect_list("salt").alias("salt")).where("c > 1")
    counts = counts.select("s", "c", "mixed", F.explode("salt").alias("salt"))
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "s", F.coalesce("mixed", F.lit(False)).alias("mixed"))))
    ordered = held.join(counts, ["s", "salt"], "left").groupBy(key).agg(order.alias("x"))
    rare = F.slice("x", F.lit(1), F.expr("cast(size(x) - (85 * size(x) + 99) div 100 + 1 as int)"))
    posts = ordered.select(*key, F.posexplode(rare).alias("at", "y")).where("y.mixed").select(*key, "at", "y.s", F.least(F.ceil(F.col("y.c") / CELL), F.lit(CELLS)).cast("int").alias("cells"))
    rows = posts.join(docs.drop("shingles"), key).withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("cells")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    rows = rows.select("s", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "doc_id", "comp", "n", F.col("at").cast("bigint").alias("at"), "odd")
    rows = rows.repartition(partitions(nodes.sparkSession), "s", "a", "b").sortWithinPartitions("s", "a", "b", "own")
    return rows.mapInArrow(_cells, "u bigint, v bigint").distinct()


def _with_comp(nodes: DataFrame, comp: DataFrame) -> DataFrame:
    return nodes.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))


def clusters(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows (doc_id, n, k1, k2), and rep, comp of the sets that are linked with a smaller id's set."""
    sketch = written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_sketch, "doc_id bigint, n bigint, k1 bigint, k2 bigint, sig binary"))
    reps = sketch.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    nodes = sketch.where("n > 0").join(reps.distinct(), "doc_id", "left_semi").select("doc_id", "n", "sig")
    places = written(_crowded(nodes.select("doc_id", "sig", F.col("doc_id").alias("comp"))))
    active = places.select("doc_id").distinct()
    nodes = written(only_ids(nodes, active))
    sets = written(only_ids(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), nodes).mapInArrow(_sets, "doc_id bigint, shingles binary"))
    now = nodes.withColumn("comp", F.col("doc_id"))
    links = comp = None
    for mode in ROUNDS:
        if comp is not None:
            now = _with_comp(nodes, comp)
            places = written(_crowded(now))
        new = written(confirmed(written(candidates(now, places, mode)), sets))
        links = new if links is None else links.union(new)
        comp = graph.hooked(links) if mode != ROUNDS[-1] else graph.components(links)
    crowded = F.col("crowd") > REGION
    if not places.where(crowded).isEmpty():  # regions were cut
        now = _with_comp(nodes, comp)
        hot = written(_crowded(now).where(crowded).select("doc_id").distinct())
        if not hot.isEmpty():
            new = written(confirmed(written(crowded_pairs(now, hot, sets)), sets))
            comp = graph.components(links.union(new))
    return sketch.drop("sig"), comp.select(F.col("node").alias("rep"), "comp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text)."""
    sketch, comp = clusters(docs)
    reps = written(sketch.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).join(comp, "rep", "left").where("c > 1 or comp is not null").select("k1", "k2", F.coalesce("comp", "rep").alias("comp")))
    out = sketch.join(reps, ["k1", "k2"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
