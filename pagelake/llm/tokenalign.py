"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often corpus-wide.

External spill counting. Each task aligns its documents and gathers records (pair of ids, document, times). When it holds
``RUN_LINKS`` of them it sorts them and spills a *run*: its records cut by the radix of the B id into ``BUCKETS`` zstd
blobs, each sorted by B id, A id, document. Only the pairs of a run and their totals go on: the runs of a bucket are
merged through a heap, at most about ``FAN`` at a time and in as many levels as their number needs, so a pair is summed
run by run and every pair of one B id passes before the next B id; there its highest count is known. The counts return
down the same levels to the runs, where they are added up by document. Documents' records never meet those of
other runs, and what is shuffled of a hot pair or B id is one entry a run.

Texts are cut before a single space between two plain signs, where both vocabularies always end a token (this is checked
when they are loaded; otherwise texts stay whole); equal cuts are encoded once and remembered, up to ``KNOWN`` of them.

Null or empty texts, and those whose tokens do not give back their bytes, have no tokens: zeros and ''. Rows are aligned
one by one, so repeated rows count twice and null ids are kept as they are. A very long text is one document of a run that
is then longer. An empty table gives no rows. Further columns are not read. A count in which several A ids tie for
the highest is the highest for all of them.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm.common import partitions, written

BUCKETS, FAN = 64, 64
#: Links a task gathers before it spills a run.
RUN_LINKS = 2_000_000
#: Runs whose counts a task adds up, about.
RUNS_PER_TASK = 8
#: Cuts of text a task remembers, their characters, and characters of text it encodes at once.
KNOWN, KNOWN_CHARS, SLICE = 200_000, 1 << 24, 1 << 20
_CUT = re.compile("(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")
RUNS = "run long, bucket int, pairs binary, docs binary"
DIGEST = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers as one zstd frame, each as narrow as its values; ascending ones should come as differences."""
    narrow = []
    for x in arrays:
        lo, hi = (int(x.min()), int(x.max())) if len(x) else (0, 0)
        kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= lo and hi <= np.iinfo(t).max)
        narrow.append(np.asarray(x).astype(kind))
    head = np.array([len(arrays), *[v for x in narrow for v in (len(x), x.itemsize)]], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(x.tobytes() for x in narrow))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, 2 * n, 8).reshape(n, 2).tolist()
    out, at = [], 8 + 16 * n
    for size, width in sizes:
        out.append(np.frombuffer(data, f"i{width}", size, at).astype(np.int64))
        at += size * width
    return out


def _byte_values() -> dict[str, int]:
    """The printable sign that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(others)}}


class Pair:
    """Two tokenizers, made from the bytes of their files, and the bytes of all their tokens."""

    def __init__(self, a_json: bytes, b_model: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        value = _byte_values()
        self.n_a, self.n_b = max(self.a.get_vocab(True).values()) + 1, self.b.get_piece_size()
        self.a_bytes = [b""] * self.n_a
        for piece, k in self.a.get_vocab(True).items():
            self.a_bytes[k] = bytes(value[c] for c in piece) if all(c in value for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.n_b)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        spec = json.loads(a_json)
        first = spec.get("pre_tokenizer") or {}
        level = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not spec.get("normalizer")
        # No piece may reach over a space that follows another sign, nor may spaces be changed.
        self.cuts = bool(level) and not any(re.search("[^▁]▁", p) for p in pieces) and [self.b.id_to_piece(k) for k in self.b.encode("x  y z")][1:2] == ["▁"]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        text = lambda n, end: [b"%d%s" % (k, end) for k in range(n)]
        # Texts of ids with the sign that follows: A inside a group, A at its end, B inside, B at its end.
        self.says = np.array(text(self.n_a, b",") + text(self.n_a, b"|") + text(self.n_b, b",") + text(self.n_b, b";"), object)

    def pieces(self, text: str) -> list[str]:
        return _CUT.split(text) if self.cuts else [text]


@lru_cache(maxsize=1)
def _loaded(a_json: bytes, b_model: bytes) -> Pair:
    return Pair(a_json, b_model)


def _ends(ids: list[list[int]], lengths: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids in a row, the end of each in bytes of all texts together, and the number of ids of each text."""
    n = np.array([len(x) for x in ids], np.int64)
    flat = np.fromiter((k for x in ids for k in x), np.int64, int(n.sum()))
    ends = np.cumsum(lengths[flat]) if len(flat) else np.zeros(0, np.int64)
    # Texts with tokens give back their bytes, so a text's ends differ from the running sum by what stands before it.
    first = np.cumsum(n) - n
    before = np.concatenate([[0], ends])[first]
    return flat, ends + np.repeat(start - before, n), n


class Cuts:
    """What is known of the cuts of text met so far: counts, the text of their groups, and the codes of their linked pairs."""

    def __init__(self, pair: Pair, bucket_bits: int):
        self.pair, self.mask, self.shift = pair, (1 << bucket_bits) - 1, bucket_bits
        self.per = (pair.n_b >> bucket_bits) + 1
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.chars = 0
        self.counts = np.zeros((0, 5), np.int64)  # valid, ids of A, ids of B, groups, links
        self.says: list[bytes] = []
        self.links, self.first = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def place(self, b: np.ndarray) -> np.ndarray:
        """B ids in the order of the runs: by bucket, then by id."""
        return (b & self.mask) * self.per + (b >> self.shift)

    def learn(self, new: list[str]) -> None:
        p = self.pair
        said = [(" " + x).encode() for x in new]
        ids_a = [e.ids for e in p.a.encode_batch([" " + x for x in new], add_special_tokens=False)]
        ids_b = p.b.encode(new, num_threads=1)
        ok = np.array([b"".join([p.a_bytes[k] for k in x]) == s == b"".join([p.b_bytes[k] for k in y]) for s, x, y in zip(said, ids_a, ids_b)], bool)
        ids_a, ids_b = ([x if o else [] for o, x in zip(ok, ids)] for ids in (ids_a, ids_b))
        size = np.array([len(s) if o else 0 for o, s in zip(ok, said)], np.int64)
        start = np.cumsum(size) - size
        a, end_a, n_a = _ends(ids_a, p.a_len, start)
        b, end_b, n_b = _ends(ids_b, p.b_len, start)
        # Every stretch between two neighbouring ends of either side belongs to one token of A and one of B.
        ends = np.union1d(end_a, end_b)
        link_a, link_b = a[np.searchsorted(end_a, ends)], b[np.searchsorted(end_b, ends)]
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        per_text = lambda x: np.searchsorted(x, start + size, "right") - np.searchsorted(x, start, "right")
        n_links, n_groups = per_text(ends), per_text(both)
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = a + np.where(np.isin(end_a, both), p.n_a, 0)
        order[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = b + 2 * p.n_a + np.where(np.isin(end_b, both), p.n_b, 0)
        parts = p.says[order].tolist()
        to = np.cumsum(n_a + n_b).tolist()
        says = [b"".join(parts[lo:hi]) for lo, hi in zip([0, *to], to)]
        for k, x in enumerate(new, len(self.at)):
            self.at[x] = k
            self.chars += len(x)
        self.says += says
        self.counts = np.concatenate([self.counts, np.stack([ok, n_a, n_b, n_groups, n_links], 1).astype(np.int64)])
        self.first = np.concatenate([self.first, len(self.links) + np.cumsum(n_links) - n_links])
        self.links = np.concatenate([self.links, self.place(link_b) * p.n_a + link_a])

    def look_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the cuts of all texts in a row, and how many each text has."""
        cuts = [self.pair.pieces(t) if t else [] for t in texts]
        new = list(dict.fromkeys(c for x in cuts for c in x if c not in self.at))
        if self.at and (len(self.at) + len(new) > KNOWN or self.chars > KNOWN_CHARS):
            self.clear()
            new = list(dict.fromkeys(c for x in cuts for c in x))
        if new:
            self.learn(new)
        n = np.array([len(x) for x in cuts], np.int64)
        return np.fromiter((self.at[c] for x in cuts for c in x), np.int64, int(n.sum())), n


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the stretches of lengths ``n`` of the rows of ``values``."""
    total = np.concatenate([np.zeros((1, values.shape[1]), np.int64), np.cumsum(values, 0)])
    hi = np.cumsum(n)
    return total[hi] - total[hi - n]


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts, about ``size`` characters of text at a time."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for k, t in zip(batch.column(0), batch.column(1)):
            ids.append(k.as_py())
            texts.append(t.as_py() or "")
            held += len(texts[-1])
            if held >= size or len(ids) >= 1 << 16:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


class Spill:
    """Records of a task's documents, spilled as sorted runs."""

    def __init__(self, n_a: int, per: int, part: int):
        self.n_a, self.per, self.part, self.n = n_a, per, part, 0
        self.clear()

    def clear(self) -> None:
        self.codes: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.heads: list[tuple[list, np.ndarray, list[str]]] = []
        self.held = self.rows = 0

    def add(self, ids: list, counts: np.ndarray, shas: list[str], codes: np.ndarray, docs: np.ndarray) -> None:
        self.heads.append((ids, counts, shas))
        self.codes.append(codes)
        self.docs.append(docs + self.rows)
        self.held += len(codes)
        self.rows += len(ids)

    def run(self) -> Iterator[tuple[int, int, bytes, bytes]]:
        """A row for the documents (bucket -1), then one a bucket that has pairs: pairs with totals, and their documents."""
        name = (self.part << 32) + self.n
        self.n += 1
        ids = [k for h in self.heads for k in h[0]]
        known = np.array([k is not None for k in ids], np.int64)
        head = pack(known, np.array([k or 0 for k in ids], np.int64), np.concatenate([h[1] for h in self.heads]).ravel())
        yield name, -1, head, "\n".join(s for h in self.heads for s in h[2]).encode()
        code, doc = np.concatenate(self.codes), np.concatenate(self.docs)
        wide = np.uint64(max(self.rows, 1))
        key, times = np.unique(code.astype(np.uint64) * wide + doc.astype(np.uint64), return_counts=True)
        code, doc = (key // wide).astype(np.int64), (key % wide).astype(np.int64)
        if len(code):
            new = np.flatnonzero(np.diff(code, prepend=-1))
            pairs, size, total = code[new], np.diff(new, append=len(code)), np.add.reduceat(times, new)
            bucket = pairs // (self.per * self.n_a)
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            for lo, hi in zip(cut, [*cut[1:], len(pairs)]):
                a, b = new[lo], new[lo] + int(size[lo:hi].sum())
                d = doc[a:b].copy()
                d[1:] -= doc[a:b - 1]
                yield name, int(bucket[lo]), pack(np.diff(pairs[lo:hi], prepend=0), total[lo:hi]), pack(size[lo:hi], d, times[a:b])
        self.clear()


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_RUN = pa.schema([("run", pa.int64()), ("bucket", pa.int32()), ("pairs", pa.binary()), ("docs", pa.binary())])


def spill_runs(docs: DataFrame, a_file: bytes, b_file: bytes, run_links: int = RUN_LINKS, buckets: int = BUCKETS) -> DataFrame:
    """Runs of the records of ``docs`` (id, text)."""
    # Both files have a fixed size of a few megabytes.
    files = docs.sparkSession.sparkContext.broadcast((a_file, b_file))
    bits = buckets.bit_length() - 1
    if 1 << bits != buckets:
        raise ValueError("the number of buckets must be a power of two")

    def work(batches):
        pair = _loaded(*files.value)
        cuts = Cuts(pair, bits)
        out = Spill(pair.n_a, cuts.per, TaskContext.get().partitionId())
        for ids, texts in _slices(batches, SLICE):
            at, n = cuts.look_up(texts)
            counts = _sums(cuts.counts[at], n)
            good = (counts[:, 0] == n) & (n > 0)
            counts = np.where(good[:, None], counts[:, 1:], 0)
            says, hi = [cuts.says[k] for k in at.tolist()], np.cumsum(n).tolist()
            shas = [hashlib.sha256(b"".join(says[lo:to])[:-1]).hexdigest() if g else "" for lo, to, g in zip([0, *hi], hi, good.tolist())]
            row = np.repeat(np.arange(len(n)), n)
            at, row = at[good[row]], row[good[row]]
            m = cuts.counts[at, 4]
            inner = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            out.add(ids, counts, shas, cuts.links[np.repeat(cuts.first[at], m) + inner], np.repeat(row, m))
            if out.held >= run_links:
                for r in out.run():
                    yield _rows([r], _RUN)
        if out.rows:
            for r in out.run():
                yield _rows([r], _RUN)

    return docs.mapInArrow(work, RUNS)


def _merge(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """k-way heap merge of sorted pairs: each pair once, with the sum of its totals."""
    cursors = []
    for blob in runs:
        gaps, total = unpack(blob)
        cursors.append(zip(np.cumsum(gaps).tolist(), total.tolist()))
    codes, sums = [], []
    for code, same in groupby(heapq.merge(*cursors), key=lambda x: x[0]):
        codes.append(code)
        sums.append(sum(t for _, t in same))
    return np.array(codes, np.int64), np.array(sums, np.int64)


def _merged(level: DataFrame, groups: int, last: int | None) -> DataFrame:
    """bucket, run, pairs of each group of runs of a bucket; of the last level also the answer: count and whether it is its B id's highest."""

    def work(t: pa.Table) -> pa.Table:
        code, total = _merge([x.as_py() for x in t["pairs"]])
        answer = None
        if last:  # side-major: all pairs of a B id stand together
            new = np.flatnonzero(np.diff(code // last, prepend=-1))
            high = np.repeat(np.maximum.reduceat(total, new), np.diff(new, append=len(code)))
            answer = pack(total, total == high)
        return pa.table({"bucket": t["bucket"][:1], "run": t["grp"][:1], "pairs": [pack(np.diff(code, prepend=0), total)], "answer": pa.array([answer], pa.binary())})

    grouped = level.select("bucket", "pairs", F.pmod("run", F.lit(groups)).alias("grp")).groupBy("bucket", "grp")
    return grouped.applyInArrow(work, "bucket int, run long, pairs binary, answer binary")


def _answered(level: DataFrame, parents: DataFrame, groups: int) -> DataFrame:
    """bucket, run, answer of the runs of a level, from the answers of the groups they were merged into."""

    def work(t: pa.Table, parent: pa.Table) -> pa.Table:
        gaps, _ = unpack(parent["pairs"][0].as_py())
        code = np.cumsum(gaps)
        answer = unpack(parent["answer"][0].as_py())
        out = []
        for x in t["pairs"]:
            at = np.searchsorted(code, np.cumsum(unpack(x.as_py())[0]))
            out.append(pack(*[v[at] for v in answer]))
        return pa.table({"bucket": t["bucket"], "run": t["run"], "pairs": t["pairs"], "answer": pa.array(out, pa.binary())})

    left = level.select("bucket", "run", "pairs", F.pmod("run", F.lit(groups)).alias("grp")).groupBy("bucket", "grp")
    return left.cogroup(parents.withColumnRenamed("run", "grp").groupBy("bucket", "grp")).applyInArrow(work, "bucket int, run long, pairs binary, answer binary")


def answers(runs: DataFrame, n: int, n_a: int, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """For every one of ``n`` runs and each bucket its pairs' corpus-wide counts; and the merged pairs of each bucket with their counts."""
    # A run's hash, which is a permutation of its number, spreads the runs evenly over groups.
    levels, groups = [runs.where("bucket >= 0").select("bucket", F.xxhash64("run").alias("run"), "pairs")], []
    while True:
        g = max(1, -(-n // fan))
        last = g == 1
        groups.append(g)
        levels.append(written(_merged(levels[-1], g, n_a if last else None)))
        if last:
            break
        n = g
    top = found = levels[-1]
    for level, g in zip(levels[-2::-1], groups[::-1]):
        found = _answered(level, found, g)
    return found.select("run", "bucket", "answer"), top


def _summed(runs: DataFrame, answer: DataFrame, n: int) -> DataFrame:
    """doc_id and digest: the counts that returned to a run, added up by document."""
    schema = "doc_id long, " + DIGEST
    names = [x.split()[0] for x in schema.split(", ")]

    def finish(head, sums, best) -> pa.RecordBatch:
        known, ids, counts = unpack(head[0])
        counts = counts.reshape(-1, 4)
        cols = [pa.array(ids, mask=known == 0), *[pa.array(counts[:, k]) for k in range(4)], pa.array(best), pa.array(sums), pa.array(head[1].decode().split("\n"), pa.string())]
        return pa.RecordBatch.from_arrays(cols, names)

    def work(batches):
        now, head, sums, best, docs = None, None, None, None, None
        for batch in batches:
            for at in range(batch.num_rows):
                r = {c: batch.column(c)[at].as_py() for c in ("key", "pairs", "docs")}
                if r["key"] != now:
                    if head:
                        yield finish(head, sums, best)
                    now, head, docs = r["key"], (r["pairs"], r["docs"]), None
                    rows = len(unpack(head[0])[0])
                    sums, best = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
                elif r["docs"] is not None:
                    docs = r["docs"]
                else:
                    size, gaps, times = unpack(docs)
                    count, high = (np.repeat(x, size) for x in unpack(r["pairs"]))
                    doc = np.cumsum(gaps)
                    np.add.at(sums, doc, times * count)
                    np.add.at(best, doc, times * high)
        if head:
            yield finish(head, sums, best)

    key = F.xxhash64("run").alias("key")
    records = runs.select(key, "bucket", F.when(F.col("bucket") < 0, F.col("pairs")).alias("pairs"), "docs")
    back = answer.select(F.col("run").alias("key"), "bucket", F.col("answer").alias("pairs"), F.lit(None).cast("binary").alias("docs"))
    rows = records.unionByName(back).withColumn("later", F.col("docs").isNull())
    dealt = rows.repartition(max(partitions(runs.sparkSession), -(-n // RUNS_PER_TASK)), "key").sortWithinPartitions("key", "bucket", "later")
    return dealt.mapInArrow(work, schema)


def align(docs: DataFrame, a_file: bytes, b_file: bytes, id_col: str = "doc_id", text: str = "text", run_links: int = RUN_LINKS, buckets: int = BUCKETS, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Digest of every document; and the linked pairs: a_id, b_id, links, best (whether no A id has more links with that B id).

    ``a_file`` is a byte-level BPE of the tokenizers library, ``b_file`` a sentencepiece model, both as bytes.
    """
    pair = _loaded(a_file, b_file)
    runs = written(spill_runs(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text")), a_file, b_file, run_links, buckets))
    n = runs.where("bucket = -1").count()
    answer, top = answers(runs, n, pair.n_a, fan)
    digest = _summed(runs, answer, n).withColumnRenamed("doc_id", id_col)
    per, n_a, shift = (pair.n_b >> (buckets.bit_length() - 1)) + 1, pair.n_a, buckets.bit_length() - 1

    def open_pairs(batches):
        for batch in batches:
            for r in batch.to_pylist():
                code, (total, high) = np.cumsum(unpack(r["pairs"])[0]), unpack(r["answer"])
                place = code // n_a
                b = ((place % per) << shift) + place // per
                yield pa.RecordBatch.from_arrays([pa.array(code % n_a), pa.array(b), pa.array(total), pa.array(high.astype(bool))], ["a_id", "b_id", "links", "best"])

    return digest, top.select("pairs", "answer").mapInArrow(open_pairs, "a_id long, b_id long, links long, best boolean")


def read_file(spark: SparkSession, path: str) -> bytes:
    """A tokenizer's file: through Spark where the path names a store, else from the driver's disk."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first().content)
    with open(path, "rb") as f:
        return f.read()
