"""Benchmark decontamination by latent semantic retrieval.

Texts become hashed words. Passages of ``PASSAGE`` words, weighted by inverse frequency over all documents, make
a matrix whose right singular vectors come from a distributed randomised SVD: one pass over all passages, whose sketch
(``BUCKETS`` by ``SKETCH``) is all that reaches the driver. Windows of every document, about as long as each item, are
compared with the items by the cosine of their whitened latent vectors; windows at ``COSINE`` or more are candidates. So
is, whatever its cosine, every window that holds enough of the rarer half of an item's words: where the subsequence
below holds ``LCS`` of the item, at most 1 - ``LCS`` of it can be missing from that half. The latent space thus decides
nothing alone, and a corpus of few passages loses no match. A
candidate counts when the longest common subsequence of words holds ``LCS`` of the item and ``ANSWER`` of the words of
its last sentence (of its last third, if it has one sentence), so edited and reordered sentences are found, and passages
that merely share a topic are not.

Null and empty texts and items match nothing; items of fewer than ``SHORTEST`` words are left out, as they would match
by chance. Every text is read whole, in windows. Repeated rows and ids each give their matches. The benchmark is dealt
with ``ITEMS`` items at a time, so what travels with the tasks is bounded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import NON_LETTERS, partitions, slices, words, written

BUCKETS, RANK, SKETCH, PASSAGE, STRIDE = 8192, 64, 128, 32, 4
COMMON, COSINE, LCS, ANSWER, SHORTEST, ITEMS = 400, 0.55, 0.7, 0.6, 6, 5000
#: Words of one text that are worked on at a time, with an overlap longer than any window.
SEGMENT = 1 << 12


def _words_of(texts: list[str]) -> list[np.ndarray]:
    b = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    out = []
    for _, data, offsets in slices(iter([b]), "text"):
        _, _, h, row = words(data, offsets, NON_LETTERS)
        h = (h >> np.uint64(32)).astype(np.uint32)
        out += [h[a:z] for a, z in zip(row[:-1], row[1:])]
    return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, data, offsets in slices(batches, "text"):
        _, _, h, row = words(data, offsets, NON_LETTERS)
        h = (h >> np.uint64(32)).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([h[a:z].tobytes() for a, z in zip(row[:-1].tolist(), row[1:].tolist())], pa.binary())], ["doc_id", "words"])


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of many words at a time, and the passage each belongs to; the last passage of a text may be short."""
    held, of, passages, size = [], [], 0, 0
    for b in batches:
        for x in b.column("words"):
            w = np.frombuffer(x.as_buffer(), np.uint32)
            for lo in range(0, len(w), SEGMENT):
                part = w[lo:lo + SEGMENT] % BUCKETS
                held.append(part)
                of.append(passages + np.arange(len(part)) // PASSAGE)
                passages += -(-len(part) // PASSAGE)
                size += len(part)
                if size > 1 << 17:
                    yield np.concatenate(held), np.concatenate(of)
                    held, of, passages, size = [], [], 0, 0
    if held:
        yield np.concatenate(held), np.concatenate(of)


def _summed(parts: DataFrame, width: int) -> np.ndarray:
    """Sum over tasks of rows (block, cells): each block of buckets is added up where it lands, then read by the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("block").to_pylist(), b.column("cells")):
                v = np.frombuffer(x.as_buffer(), np.float32)
                total[k] = total[k] + v if k in total else v
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["block", "cells"])

    rows = parts.repartition(partitions(parts.sparkSession), "block").mapInArrow(add, "block int, cells binary").collect()
    out = np.zeros((BUCKETS, width))
    for r in rows:
        v = np.frombuffer(r.cells, np.float32).reshape(-1, width)
        out[r.block * len(v):(r.block + 1) * len(v)] = v
    return out


def _blocks(cells: np.ndarray) -> pa.RecordBatch:
    parts = np.split(cells, 64)
    return pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary())], ["block", "cells"])


def word_counts(hashed: DataFrame) -> np.ndarray:
    """Occurrences of each bucket in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((BUCKETS, 1))
        for w, _ in _passages(batches):
            n[:, 0] += np.bincount(w, minlength=BUCKETS)
        yield _blocks(n)

    return _summed(hashed.select("words").mapInArrow(run, "block int, cells binary"), 1)[:, 0]


def weights_of(counts: np.ndarray) -> np.ndarray:
    """Inverse frequency; buckets that hold more than one word in ``COMMON`` weigh next to nothing."""
    return np.maximum(0.1, np.log((1 + counts.sum()) / (1 + counts)) - np.log(COMMON))


def latent_basis(hashed: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 11) -> np.ndarray:
    """BUCKETS by rank: right singular vectors over the singular values (whitened), by a randomised SVD.

    Every unit TF-IDF passage is added, with a random sign, to one of ``SKETCH`` random rows. The few rows have, in
    expectation, the Gram matrix of all passages, and their SVD gives its strongest directions in one pass.
    """
    weights = hashed.sparkSession.sparkContext.broadcast(idf)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        z = np.zeros(BUCKETS * SKETCH)
        for w, of in _passages(batches):
            weight = weights.value[w]
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            n = np.diff(np.append(first, len(of)))
            norm = np.sqrt(np.add.reduceat(weight * weight, first))
            sign = rng.choice((-1.0, 1.0), len(first)) / np.maximum(norm, 1e-9)
            np.add.at(z, w.astype(np.int64) * SKETCH + np.repeat(rng.integers(0, SKETCH, len(first)), n), weight * np.repeat(sign, n))
        yield _blocks(z.reshape(BUCKETS, SKETCH))

    z = _summed(hashed.select("words").mapInArrow(sketch, "block int, cells binary"), SKETCH)
    u, value, _ = np.linalg.svd(z, full_matrices=False)
    strong = value[:rank] > 1e-6 * max(1e-30, value[0])
    return u[:, :rank][:, strong] / value[:rank][strong][None, :]


def lcs_length(a: np.ndarray, b: np.ndarray) -> int:
    """Words in the longest common subsequence, by bits."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        m = places.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def answer_text(text: str) -> str:
    """Last sentence of an item, or its last third."""
    sentences = [s for s in re.split(r"(?<=[.?!])\s+", text.strip()) if re.search(r"\w.*\s.*\w", s)]
    if len(sentences) > 1:
        return sentences[-1]
    parts = text.split()
    return " ".join(parts[len(parts) * 2 // 3:])


def _size(n: int) -> int:
    """Window length for an item of ``n`` words: 12, 24, 48, ... whichever is nearest as a ratio."""
    return int(12 * 2 ** max(0, round(np.log2(n / 12))))


class Items:
    def __init__(self, ids: list, texts: list[str], idf: np.ndarray, basis: np.ndarray):
        hashed, answers = _words_of(texts), _words_of([answer_text(t) for t in texts])
        self.idf, self.weighted = idf, (basis * idf[:, None]).astype(np.float32)
        keep = [k for k, w in enumerate(hashed) if len(w) >= SHORTEST]
        self.ids, self.words, self.answers = [ids[k] for k in keep], [hashed[k] for k in keep], [answers[k] for k in keep]
        self.sorted = [np.unique(w) for w in self.words]
        # One more row for the filling between texts.
        self.weighted = np.append(self.weighted, np.zeros((1, basis.shape[1]), np.float32), axis=0)
        latent = np.array([self.weighted[w % BUCKETS].sum(0) for w in self.words]).reshape(len(self.words), basis.shape[1])
        self.latent = (latent / np.maximum(np.linalg.norm(latent, axis=1), 1e-9)[:, None]).astype(np.float32)
        size = np.array([_size(len(w)) for w in self.words])
        self.by_size = {int(s): np.flatnonzero(size == s) for s in np.unique(size)}
        self.widest = 2 * max([STRIDE, *self.by_size])
        self.size = size
        # Rarer half of each item, and how many of its places have to be matched by a subsequence that counts.
        halves = [w[np.argsort(-idf[w % BUCKETS], kind="stable")[:-(-len(w) // 2)]] for w in self.words]
        self.least = np.array([int(np.ceil(LCS * len(w) - 1e-9)) - (len(w) - len(h)) for w, h in zip(self.words, halves)], np.int64)
        pairs = [(x, k, int(c)) for k, h in enumerate(halves) for x, c in zip(*np.unique(h, return_counts=True))]
        pairs.sort(key=lambda e: int(e[0]))
        word = np.array([e[0] for e in pairs], np.uint32)
        self.rare, first = np.unique(word, return_index=True)
        self.rare_first = np.append(first, len(word))
        self.rare_item, self.rare_places = (np.array([e[c] for e in pairs], np.int64) for c in (1, 2))

    def pieces(self, texts: list[np.ndarray]) -> Iterator[list[tuple[int, np.ndarray]]]:
        """Texts, long ones in overlapping parts, in groups of about ``SEGMENT`` words."""
        held, size = [], 0
        for t, w in enumerate(texts):
            for lo in range(0, len(w), SEGMENT):
                part = w[max(0, lo - self.widest):lo + SEGMENT]
                held.append((t, part))
                size += len(part)
                if size >= SEGMENT:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def matches(self, texts: list[np.ndarray]) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(text, item): cosine, LCS share and answer share of the best match."""
        found: dict[tuple[int, int], tuple[float, float, float]] = {}
        for group in self.pieces(texts):
            self._group(group, found)
        return found

    def _group(self, group: list[tuple[int, np.ndarray]], found: dict) -> None:
        filled = [-(-len(p) // STRIDE) * STRIDE for _, p in group]
        begin = np.concatenate([[0], np.cumsum(filled)])
        tail = max([STRIDE, *self.by_size])
        w = np.full(int(begin[-1]) + tail, BUCKETS, np.int64)
        for b, (_, p) in zip(begin.tolist(), group):
            w[b:b + len(p)] = p % BUCKETS
        steps = self.weighted[w[0::STRIDE]]
        for k in range(1, STRIDE):
            steps += self.weighted[w[k::STRIDE]]
        run = np.concatenate([np.zeros((1, steps.shape[1]), np.float32), np.cumsum(steps, axis=0)])
        for size, items in self.by_size.items():
            n, jump = size // STRIDE, max(1, size // (4 * STRIDE))
            at = np.arange(0, int(begin[-1]) // STRIDE, jump)
            x = run[at + n] - run[at]
            x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
            cos = x @ self.latent[items].T
            for i, j in np.argwhere(cos >= COSINE) if cos.size and cos.max() >= COSINE else ():
                a = int(at[i]) * STRIDE
                first, last = np.searchsorted(begin, [a, a + size - 1], "right") - 1
                for g in range(int(first), min(int(last), len(group) - 1) + 1):
                    self._judge(group[g], a - int(begin[g]), size, int(items[j]), float(cos[i, j]), found)

        self._exact(group, begin, w.shape[0], found)

    def _exact(self, group: list[tuple[int, np.ndarray]], begin: np.ndarray, length: int, found: dict) -> None:
        """Judges every window, at steps of ``STRIDE``, whose region can hold enough of an item's rarer half."""
        if not len(self.rare):
            return
        at = np.concatenate([b + np.arange(len(p)) for b, (_, p) in zip(begin.tolist(), group)])
        w = np.concatenate([p for _, p in group])
        row = np.minimum(np.searchsorted(self.rare, w), len(self.rare) - 1)
        hit = self.rare[row] == w
        row, block = row[hit], at[hit] // STRIDE
        count = self.rare_first[row + 1] - self.rare_first[row]
        entry = np.repeat(self.rare_first[row], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        item, block, places = self.rare_item[entry], np.repeat(block, count), self.rare_places[entry]
        # A region lies in two neighbouring stretches of its length; stretches that hold too little together are left out.
        stretch = block // (2 * self.size[item] // STRIDE + 2)
        wide = length // (6 * STRIDE) + 2
        held = np.bincount(item * wide + stretch, places, len(self.words) * wide).reshape(-1, wide)
        two = held[:, :-1] + held[:, 1:] >= self.least[:, None]
        enough = np.zeros(held.shape, bool)
        enough[:, :-1] |= two
        enough[:, 1:] |= two
        kept = enough[item, stretch]
        item, block, places = item[kept], block[kept], places[kept]
        order = np.lexsort((block, item))
        item, block, places = item[order], block[order], places[order]
        edges = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else []
        for lo, hi in zip(edges, np.append(edges[1:], len(item)) if len(item) else []):
            k, size = int(item[lo]), int(self.size[item[lo]])
            run = np.concatenate([[0], np.cumsum(places[lo:hi])])
            starts = np.arange(0, int(begin[-1]), STRIDE)
            inside = run[np.searchsorted(block[lo:hi], -(-(starts + size + size // 2) // STRIDE), "left")]
            inside = inside - run[np.searchsorted(block[lo:hi], (starts - size // 2) // STRIDE, "left")]
            starts = starts[inside >= self.least[k]]
            if not len(starts):
                continue
            # Words of the region that the item has at all; a region over the end of its text is counted too high, never too low.
            own = self.sorted[k]
            has = np.concatenate([[0], np.cumsum(own[np.minimum(np.searchsorted(own, w), len(own) - 1)] == w)])
            shared = has[np.searchsorted(at, starts + size + size // 2)] - has[np.searchsorted(at, starts - size // 2)]
            for a in starts[shared >= LCS * len(self.words[k]) - 1e-9].tolist():
                g = int(np.searchsorted(begin, a, "right")) - 1
                self._judge(group[g], a - int(begin[g]), size, k, None, found)

    def _cosine(self, w: np.ndarray, k: int) -> float:
        x = self.weighted[w % BUCKETS].sum(0)
        return float(x @ self.latent[k] / max(1e-9, float(np.sqrt(x @ x))))

    def _judge(self, piece: tuple[int, np.ndarray], a: int, size: int, k: int, cosine: float | None, found: dict) -> None:
        text, w = piece
        item, best = self.words[k], found.get((text, k))
        if best and best[1] >= 0.999:
            return
        region = w[max(0, a - size // 2):a + size + size // 2]
        least, own = LCS * len(item) - 1e-9, self.sorted[k]
        shared = region[own[np.minimum(np.searchsorted(own, region), len(own) - 1)] == region]
        if len(shared) < least:
            return
        there = set(shared.tolist())
        if sum(x in there for x in item.tolist()) < least:
            return
        share = lcs_length(item, region) / len(item)
        if share < LCS or (best and best[1] >= share):
            return
        answer = float(np.isin(self.answers[k], region).mean()) if len(self.answers[k]) else 1.0
        if answer >= ANSWER:
            found[text, k] = (self._cosine(w[a:a + size], k) if cosine is None else cosine, share, answer)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer: items of ``benchmark`` (item_id, text) found in rows of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    schema = "doc_id bigint, item_id bigint, cosine double, lcs double, answer double"
    hashed = written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_hashed, "doc_id bigint, words binary"))
    seen = word_counts(hashed)
    idf = weights_of(seen)
    basis = latent_basis(hashed, idf)
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    n = items.count()
    chunks = max(1, -(-n // ITEMS))
    out = None
    for c in range(chunks):
        part = (items if chunks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(chunks)) == c)).orderBy("item_id").collect()
        shared = spark.sparkContext.broadcast(Items([r.item_id for r in part], [r.text for r in part], idf, basis))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            it = shared.value
            for b in batches:
                rows = []
                if it.ids:
                    ids, texts = b.column("doc_id").to_pylist(), [np.frombuffer(x.as_buffer(), np.uint32) for x in b.column("words")]
                    rows = [(ids[t], it.ids[k], *v) for (t, k), v in it.matches(texts).items()]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["doc_id", "item_id", "cosine", "lcs", "answer"])

        got = hashed.mapInArrow(run, schema)
        out = got if out is None else out.union(got)
    return out
