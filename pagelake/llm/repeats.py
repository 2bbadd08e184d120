"""Suffix-array dedup of long repeats by a distributed merge sort that knows common prefixes.

A byte goes when a ``SPAN``-byte string that covers it starts anywhere else too. Sorting every suffix would move every
text hundreds of times over, so suffixes start at anchors: in every stretch of SPAN bytes the places whose ``GRAM``-byte
string hashes lowest. Two equal strings of SPAN bytes have the same anchors, so no repeat is lost. Anchors whose gram
occurs once are left out; the others' suffixes are sorted in runs, front-coded (length shared with the suffix before,
then the rest) and exchanged by ranges of the sorted order. A range's runs are merged with a loser tree that carries the
length each candidate shares with the last winner: it compares no byte twice. Neighbours that share GRAM bytes form a
group, and all SPAN-byte strings around the group's anchors are compared at once, by 64-bit hashes of their bytes.

A gram in more than ``CROWD`` places would be one large group; its strings are counted by hash over all tasks instead.
Texts with equal bytes are worked on once; where there are several of SPAN bytes or more, all of each goes. Matches do
not cross texts. Null text counts as empty; ids may be null or repeated, each row gets its result.

Passages of over 50 words that another row has too are counted beside that, also those of fewer bytes than SPAN: every
string of PASSAGE words belongs to the lowest hash of its strings of WORD_GRAM words, which equal strings share; only
strings whose lowest hash comes from several texts are listed and counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.llm.common import BLANKS, BYTE_VALUE, U64, mix, partitions, powers, slices, text_buffers, words, written

SPAN, GRAM, CROWD, RUN, PREFIX = 400, 200, 20_000, 20_000, 32
#: Suffixes whose groups are compared in one numpy step (a larger group is a step of its own).
TOGETHER = 2048
#: Rows of a batch that are Python objects at once.
ROWS = 128
SMALL_KEYS = 1_000_000
PASSAGE, WORD_GRAM = 51, 16


def _rolled(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` values in a row."""
    if len(values) < n:
        return np.zeros(0, U64)
    up, down = powers(len(values))
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up, out=total[1:])
    return mix((total[n:] - total[:-n]) * down[:len(values) - n + 1])


def _hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n``-byte string."""
    return _rolled(BYTE_VALUE[data], n)


def _sliding(x: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """``op`` over every window of ``w`` values."""
    n, pad = len(x), -len(x) % w
    edge = x.max() if op is np.minimum else x.min()
    rows = np.append(x, np.full(pad, edge, x.dtype)).reshape(-1, w)
    ahead = op.accumulate(rows, axis=1).ravel()
    back = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n - w + 1], ahead[w - 1:n])


def anchors(data: np.ndarray, block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Places, and gram hashes there, that are lowest in some stretch of SPAN bytes; worked on in overlapping blocks."""
    w = SPAN - GRAM + 1
    at, values = [], []
    for lo in range(0, max(1, len(data) - SPAN + 1), block):
        part = data[lo:lo + block + SPAN - 1]
        if len(part) < SPAN:
            continue
        h = _hashes(part, GRAM)
        low = _sliding(h, w, np.minimum)
        wide = np.concatenate([np.zeros(w - 1, U64), low, np.zeros(w - 1, U64)])
        here = np.flatnonzero(_sliding(wide, w, np.maximum) == h)
        at.append(here + lo)
        values.append(h[here])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    places, first = np.unique(np.concatenate(at), return_index=True)
    return places, np.concatenate(values)[first]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = text_buffers(b.column("text"))
        for lo in range(0, b.num_rows, 500):
            part = b.slice(lo, 500)
            found = [anchors(data[x:y]) for x, y in zip(offsets[lo:lo + part.num_rows], offsets[lo + 1:lo + part.num_rows + 1])]
            size = np.cumsum([0] + [len(p) for p, _ in found])
            yield pa.RecordBatch.from_arrays([
                part.column("k1"), part.column("k2"), pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(np.concatenate([p for p, _ in found]), pa.int64())),
                pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(np.concatenate([h for _, h in found]).view(np.int64))),
            ], ["k1", "k2", "at", "h"])


def front_coded(entries: list[tuple]) -> bytes:
    """Sorted (suffix, left, k1, k2, at): length shared with the suffix before, the rest, the left side, and the place."""
    out, before = [], b""
    for suffix, left, k1, k2, at in entries:
        n = _shared(before, suffix, 0)
        out += [n.to_bytes(2, "little"), (len(suffix) - n).to_bytes(2, "little"), suffix[n:], len(left).to_bytes(1, "little"), left, (k1 & (2**64 - 1)).to_bytes(8, "little"), (k2 & (2**64 - 1)).to_bytes(8, "little"), at.to_bytes(8, "little")]
        before = suffix
    return b"".join(out)


def decoded(data: bytes) -> Iterator[tuple[int, tuple]]:
    """Entries of a run with the length each shares with the one before."""
    at, before, num = 0, b"", int.from_bytes
    while at < len(data):
        n, rest = num(data[at:at + 2], "little"), num(data[at + 2:at + 4], "little")
        at += 4
        suffix = before[:n] + data[at:at + rest]
        at += rest
        left = data[at + 1:at + 1 + data[at]]
        at += 1 + data[at]
        k1, k2, place = (num(data[at + 8 * i:at + 8 * i + 8], "little", signed=True) for i in range(3))
        at += 24
        yield n, (suffix, left, k1, k2, place)
        before = suffix


def _shared(a: bytes, b: bytes, n: int) -> int:
    """Length of the common prefix, known to be ``n`` at least."""
    end = min(len(a), len(b))
    step = 64
    while n < end and a[n:n + step] == b[n:n + step]:
        n += step
    n = min(n, end)
    while n < end and a[n] == b[n]:
        n += 1
    return n


def merged(runs: list[bytes]) -> Iterator[tuple[int, tuple]]:
    """All entries of the runs in order, with the length each shares with the one before, by a loser tree."""
    readers = [decoded(r) for r in runs]
    k = len(readers)
    heads = [next(r, None) for r in readers]
    entry = [h[1] if h else None for h in heads]
    known = [0] * k  # length shared with the last winner
    losers = [-1] * k

    def beats(a: int, b: int) -> bool:
        """Whether a comes first; the loser then knows what it shares with the winner."""
        if entry[a] is None or entry[b] is None:
            return entry[b] is None
        if known[a] != known[b]:
            return known[a] > known[b]
        x, y = entry[a][0], entry[b][0]
        n = _shared(x, y, known[a])
        first = x[n:n + 1] <= y[n:n + 1]
        known[b if first else a] = n
        return first

    def enter(r: int) -> int:
        node = (r + k) // 2
        while node:
            if losers[node] < 0:
                losers[node] = r
                return -1
            if beats(losers[node], r):
                losers[node], r = r, losers[node]
            node //= 2
        return r

    winner = -1
    for r in range(k):
        w = enter(r)
        winner = w if w >= 0 else winner
    while winner >= 0 and entry[winner] is not None:
        yield known[winner], entry[winner]
        following = next(readers[winner], None)
        entry[winner], known[winner] = (following[1], following[0]) if following else (None, 0)
        winner = enter(winner)


def _windows(entries: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the SPAN-byte strings around each anchor, the first that of the string starting SPAN - GRAM bytes
    before it, and how many bytes the entry has before its anchor and from it on; strings beyond those are not real."""
    reach = SPAN - GRAM
    left, right = np.array([len(e[1]) for e in entries]), np.array([len(e[0]) for e in entries])
    up, down = powers(reach + SPAN)
    hashes = np.empty((len(entries), reach + 1), U64)
    for lo in range(0, len(entries), 256):
        part = entries[lo:lo + 256]
        flat = b"".join(e[1].rjust(reach, b"\0") + e[0].ljust(SPAN, b"\0") for e in part)
        total = np.zeros((len(part), reach + SPAN + 1), U64)
        np.cumsum(BYTE_VALUE[np.frombuffer(flat, np.uint8).reshape(len(part), -1)] * up, axis=1, out=total[:, 1:])
        hashes[lo:lo + 256] = mix((total[:, SPAN:] - total[:, :-SPAN]) * down[:reach + 1])
    return hashes, left, right


def repeated(groups: list[list[tuple]]) -> Iterator[tuple[int, int, int, int]]:
    """k1, k2, start, end of the stretches of SPAN-byte strings that occur in several places of one group.

    Many groups are worked on together; a string's hash is mixed with its group's number.
    """
    groups = [g for g in (list({(e[2], e[3], e[4]): e for e in g}.values()) for g in groups) if len(g) > 1]
    if not groups:
        return
    salt = mix(np.repeat(np.arange(1, len(groups) + 1, dtype=U64), [len(g) for g in groups]))
    group = [e for g in groups for e in g]
    hashes, left, right = _windows(group)
    hashes += salt[:, None]
    reach = SPAN - GRAM
    again = np.zeros((len(group), reach + 1), bool)  # by bytes before the anchor
    for o in range(reach + 1):
        ok = np.flatnonzero((left >= o) & (right >= SPAN - o))
        _, back, n = np.unique(hashes[ok, reach - o], return_inverse=True, return_counts=True)
        again[ok, o] = n[back] > 1
    for i in np.flatnonzero(again.any(1)):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], again[i].view(np.int8), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):  # from a to b - 1 bytes before the anchor
            yield group[i][2], group[i][3], group[i][4] - (b - 1), group[i][4] - a + SPAN


def _some(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch a few at a time: as Python objects they take several times their bytes."""
    for lo in range(0, b.num_rows, ROWS):
        yield b.slice(lo, ROWS)


def _entries(batch: pa.RecordBatch, hot: bool) -> Iterator[tuple]:
    for b in _some(batch):
        for k1, k2, text, places in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), b.column("text").to_pylist(), b.column("places").to_pylist()):
            data = text.encode()
            for p in places:
                if p["hot"] == hot:
                    yield data[p["at"]:p["at"] + SPAN], data[max(0, p["at"] - SPAN + GRAM):p["at"]], k1, k2, p["at"]


def _runs(splitters: list[bytes]):
    from bisect import bisect_right

    def flush(entries: list[tuple]) -> pa.RecordBatch:
        entries.sort(key=lambda e: e[0])
        ranges, blocks, lo = [], [], 0
        of = [bisect_right(splitters, e[0][:PREFIX]) for e in entries]
        while lo < len(entries):
            hi = lo
            while hi < len(entries) and of[hi] == of[lo]:
                hi += 1
            ranges.append(of[lo])
            blocks.append(front_coded(entries[lo:hi]))
            lo = hi
        return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int64()), pa.array(blocks, pa.binary())], ["range", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for e in _entries(b, False):
                held.append(e)
                if len(held) >= RUN:
                    yield flush(held)
                    held = []
        if held:
            yield flush(held)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def finish(runs: list[bytes]) -> Iterator[pa.RecordBatch]:
        groups, held = [[]], 0
        for n, e in merged(runs):
            if n < GRAM and groups[-1]:
                if held >= TOGETHER:
                    yield from batch(list(repeated(groups)))
                    groups, held = [], 0
                groups.append([])
            groups[-1].append(e)
            held += 1
        yield from batch(list(repeated(groups)))

    def batch(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["k1", "k2", "lo", "hi"])

    now, runs = None, []
    for b in batches:
        for r, run in ((b.column("range")[i].as_py(), b.column("run")[i].as_py()) for i in range(b.num_rows)):
            if r != now and runs:
                yield from finish(runs)
                runs = []
            now = r
            runs.append(run)
    if runs:
        yield from finish(runs)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(entries: list[tuple]) -> pa.RecordBatch:
        hashes, left, right = _windows(entries)
        before = np.arange(SPAN - GRAM, -1, -1)
        i, o = np.nonzero((left[:, None] >= before) & (right[:, None] >= SPAN - before))
        k1, k2, at = (np.array([e[c] for e in entries], np.int64) for c in (2, 3, 4))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (hashes[i, o].view(np.int64), k1[i], k2[i], at[i] - before[o])], ["w", "k1", "k2", "lo"])

    held: list[tuple] = []
    for b in batches:
        for e in _entries(b, True):
            held.append(e)
            if len(held) == 256:
                yield batch(held)
                held = []
    if held:
        yield batch(held)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (part for batch in batches for part in _some(batch)):
        removed, spans, digest, left = [], [], [], []
        for text, cuts in zip(b.column("text").to_pylist(), b.column("cuts").to_pylist()):
            data, at, kept, gone, n = text.encode(), 0, [], 0, 0
            end = -1
            for c in sorted((c["lo"], c["hi"]) for c in cuts):
                if c[0] > end:
                    kept.append(data[max(at, 0):c[0]])
                    n += 1
                    gone += c[1] - c[0]
                    at = end = c[1]
                elif c[1] > end:
                    gone += c[1] - end
                    at = end = c[1]
            kept.append(data[at:])
            rest = b"".join(kept)
            removed.append(gone)
            spans.append(n)
            digest.append(hashlib.sha256(rest).hexdigest())
            left.append(rest.decode("utf-8", "ignore"))
        yield pa.RecordBatch.from_arrays([
            b.column("doc_id"), b.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(left, pa.string()),
            b.column("n_passages"), b.column("n_passage_words"),
        ], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "n_passages", "n_passage_words"])


def _word_strings(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the row, hash and lowest gram hash of every string of PASSAGE words; and the words of each row."""
    _, _, h, first = words(data, offsets, BLANKS)
    n, counts = len(h) - PASSAGE + 1, np.diff(first)
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.view(U64), none.view(U64), counts
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(row[:n] == row[PASSAGE - 1:])
    low = _sliding(_rolled(h, WORD_GRAM), PASSAGE - WORD_GRAM + 1, np.minimum)
    return row[at], at - first[row[at]], _rolled(h, PASSAGE)[at], low[at], counts


def _lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in slices(batches, "text"):
        row, _, _, low, counts = _word_strings(data, offsets)
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (low[1:] != low[:-1])
        size = np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=part.num_rows))])
        yield pa.RecordBatch.from_arrays([
            part.column("k1"), part.column("k2"), pa.array(counts, pa.int64()),
            pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(low[new].view(np.int64))),
        ], ["k1", "k2", "n_words", "lows"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in slices(batches, "text"):
        row, at, whole, low, _ = _word_strings(data, offsets)
        edge = np.searchsorted(row, np.arange(part.num_rows + 1))
        lists = part.column("lows")
        found = [x + np.flatnonzero(np.isin(low[x:y], lists[i].values.to_numpy().view(U64))) for i, (x, y) in enumerate(zip(edge[:-1], edge[1:]))]
        here = np.concatenate(found)
        k1, k2 = (part.column(c).take(pa.array(row[here])) for c in ("k1", "k2"))
        yield pa.RecordBatch.from_arrays([pa.array(whole[here].view(np.int64)), k1, k2, pa.array(at[here], pa.int64())], ["w", "k1", "k2", "at"])


def passages(keyed: DataFrame) -> DataFrame:
    """k1, k2, n_passages, n_passage_words: texts with strings of PASSAGE words (A-Z lower-cased) that another row has too.

    ``n_passage_words`` counts the words that such strings cover, ``n_passages`` the stretches they make.
    """
    long = keyed.where(F.col("n_bytes") >= 2 * PASSAGE - 1).select("k1", "k2", "text")
    rows = written(long.mapInArrow(_lowest, "k1 bigint, k2 bigint, n_words bigint, lows array<bigint>").where(F.col("n_words") >= PASSAGE))
    each = rows.select("k1", "k2", F.explode("lows").alias("low"))
    shared = each.groupBy("low").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b").select("low")
    wanted = written(each.join(shared, "low", "left_semi").groupBy("k1", "k2").agg(F.collect_set("low").alias("lows")))
    texts = _with_keys(long, wanted).groupBy("k1", "k2").agg(F.first("text").alias("text"))
    strings = written(texts.join(wanted, ["k1", "k2"]).mapInArrow(_listed, "w bigint, k1 bigint, k2 bigint, at bigint"))
    again = strings.groupBy("w").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b").select("w")
    ats = strings.join(again, "w", "left_semi").groupBy("k1", "k2").agg(F.array_sort(F.collect_list("at")).alias("ats"))
    step = F.transform("ats", lambda x, i: x - F.coalesce(F.get("ats", i - 1), x - 2 * PASSAGE))
    ats = ats.select("k1", "k2", step.alias("steps"))
    covered = F.aggregate("steps", F.lit(0).cast("bigint"), lambda s, x: s + F.least(x, F.lit(PASSAGE)))
    stretches = F.size(F.filter("steps", lambda x: x > PASSAGE)).cast("bigint")
    copies = rows.groupBy("k1", "k2").agg(F.count("*").alias("c"), F.max("n_words").alias("n")).where("c > 1")
    found = ats.select("k1", "k2", F.struct(covered.alias("n"), stretches.alias("p")).alias("x"))
    found = found.union(copies.select("k1", "k2", F.struct("n", F.lit(1).cast("bigint").alias("p")).alias("x")))
    found = found.groupBy("k1", "k2").agg(F.max("x").alias("x"))
    return written(found.select("k1", "k2", F.col("x.p").alias("n_passages"), F.col("x.n").alias("n_passage_words")))


def intervals(keyed: DataFrame) -> DataFrame:
    """k1, k2, lo, hi: stretches that go, by text key, of rows with k1, k2, text, n_bytes."""
    spark = keyed.sparkSession
    long = keyed.where(F.col("n_bytes") >= SPAN)
    a = long.select("k1", "k2", "text").mapInArrow(_anchor_rows, "k1 bigint, k2 bigint, at array<bigint>, h array<bigint>")
    a = written(a.select("k1", "k2", F.explode(F.arrays_zip("at", "h")).alias("x")).select("k1", "k2", "x.at", "x.h"))
    place = F.xxhash64("k1", "k2", "at")
    seen = a.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n")).where("a <> b")
    seen = seen.select("h", (F.col("n") > CROWD).alias("hot"))
    places = written(a.join(seen, "h").groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "hot")).alias("places")))
    texts = _with_keys(long.select("k1", "k2", "text"), places).groupBy("k1", "k2").agg(F.first("text").alias("text"))
    marked = written(texts.join(places, ["k1", "k2"]))
    some = marked.agg(F.count("*").alias("n"), F.sum(F.size("places")).alias("places")).first()
    # Range ends from a bounded sample of suffixes.
    first = F.transform("places", lambda p: F.substring(F.col("text").cast("binary"), (p["at"] + 1).cast("int"), F.lit(PREFIX)))
    sample = marked.where(F.rand(5) < 2000 / max(1, some.n)).select(F.explode(F.slice(F.shuffle(first), 1, 20)).alias("s")).limit(100_000)
    ends = sorted(bytes(r.s) for r in sample.collect())
    ranges = max(partitions(spark), (some.places or 0) // RUN)
    splitters = sorted({ends[len(ends) * i // ranges] for i in range(1, ranges)}) if ends else []
    runs = marked.mapInArrow(_runs(splitters), "range bigint, run binary").repartition(partitions(spark), "range").sortWithinPartitions("range")
    out = runs.mapInArrow(_merge, "k1 bigint, k2 bigint, lo bigint, hi bigint")
    strings = written(marked.where(F.exists("places", lambda p: p["hot"])).mapInArrow(_strings, "w bigint, k1 bigint, k2 bigint, lo bigint"))
    place = F.xxhash64("k1", "k2", "lo")
    twice = strings.groupBy("w").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("w")
    out = out.union(strings.join(twice, "w").select("k1", "k2", "lo", F.col("lo") + SPAN))
    copied = long.groupBy("k1", "k2").agg(F.count("*").alias("c"), F.max("n_bytes").alias("hi")).where("c > 1")
    return out.union(copied.select("k1", "k2", F.lit(0).cast("bigint"), "hi"))


def _with_keys(df: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    keys = keys.select("k1", "k2").distinct()
    return df.join(F.broadcast(keys) if keys.count() <= SMALL_KEYS else keys, ["k1", "k2"], how)


def joined(stretches: DataFrame) -> DataFrame:
    """The stretches of each text (k1, k2, lo, hi), those that overlap or touch made one.

    A string in very many places gives one stretch for each of its places; a text's whole list would be far larger than the text.
    """
    order = W.partitionBy("k1", "k2").orderBy("lo")
    end = F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1))
    first = stretches.withColumn("first", F.when(end >= F.col("lo"), 0).otherwise(1))
    runs = first.withColumn("run", F.sum("first").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("k1", "k2", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, text, n_passages, n_passage_words of every row of ``docs`` (doc_id, text).

    ``text`` is what remains. Cuts are made between bytes: a character of which only some bytes remain is left out of
    ``text``, but not of ``kept_sha256``. Passages (see ``passages``) are counted on the input and not cut.
    """
    return _result(docs, True)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``deduplicated`` without texts and passages: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return _result(docs, False).drop("text", "n_passages", "n_passage_words")


def _result(docs: DataFrame, count: bool) -> DataFrame:
    text, zero = F.coalesce("text", F.lit("")), F.lit(0).cast("bigint")
    keyed = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes"), F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(F.lit(2), text).alias("k2"))
    cuts = written(joined(intervals(keyed)).groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("cuts")))
    numbers = ["n_passages", "n_passage_words"]
    counts = passages(keyed) if count else None
    if count and counts.count() <= SMALL_KEYS:
        counts = F.broadcast(counts)

    def counted(df: DataFrame) -> DataFrame:
        if not count:
            return df.withColumns({c: zero for c in numbers})
        return df.join(counts, ["k1", "k2"], "left").withColumns({c: F.coalesce(c, zero) for c in numbers})

    whole = counted(_with_keys(keyed, cuts, "left_anti")).select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), "text", *numbers)
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, text string, n_passages bigint, n_passage_words bigint"
    return whole.union(counted(_with_keys(keyed, cuts).join(cuts, ["k1", "k2"])).mapInArrow(_cut, fields))
