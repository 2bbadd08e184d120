"""Spelling variant grouping: words one edit apart, found by dense tiles of code-point matrices.

Two words differ by one inserted, deleted or replaced code point if, and only if, their lengths differ by one at most and
their common prefix and common suffix together reach the longer length less one. A tile compares a block of words with a
block of words at once: both are padded matrices, one column of code points a step, from the left for the prefix and from
the right for the suffix.

Which blocks meet: of two such words, the longer of length c, either the first c // 2 code points are common or the last
c - c // 2 are. So a word stands in four groups (as the longer and as the shorter word, by first and by last half); a
pair is reported by its first half if that is common, else by its last, hence once. Small groups are packed into one
tile. A group of more than ``BLOCK`` words is dealt into blocks by a hash of the word, and every pair of its blocks is a
tile of its own, so no task holds a group.

``words`` holds each word once with its number of occurrences n; null words are left out, repeated ones are added up. Ties
in n go to the smaller word in code-point order. A very long word narrows its block. An empty table gives no rows. Further
columns of the documents are not read; a null id counts as an empty one, a null text as empty, and repeated rows count
as often as they stand there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import partitions, written

#: Words of a block, and cells of its matrix.
BLOCK, CELLS = 512, 1 << 20
#: Big groups, and words with a form, that are broadcast at most (about 10 MB); more are joined by shuffle.
SMALL = 100_000
RUN = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def corpus_words(docs: DataFrame, shortest: int = 6, least: int = 5, slip: int = 199, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: runs of letters of all texts, A-Z lower-cased, of ``shortest`` code points and ``least`` occurrences.

    One occurrence in ``slip``, drawn by the CRC of ``<id>:<run>``, loses the code point that the CRC names (0: none does).
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"{RUN}{{{shortest},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    word = F.col("run")
    if slip:
        runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
        at = F.pmod("h", F.length("run")).cast("int")
        word = F.when(F.col("h") % slip == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(word)
    counted = runs.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least)


def code_points(words: list[str], width: int, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left-aligned and right-aligned matrices of code points, column by column, and the words' lengths."""
    n = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)
    row, at = np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    left, right = np.full((width, len(n)), pad, np.int32), np.full((width, len(n)), pad, np.int32)
    left[at, row] = flat
    right[np.repeat(n, n) - 1 - at, row] = flat
    return left, right, n


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each column of ``a`` with each column of ``b``."""
    kind = np.uint8 if len(a) < 255 else np.int32
    same = np.ones((a.shape[1], b.shape[1]), bool)
    out = np.zeros(same.shape, kind)
    for x, y in zip(a, b):
        same &= x[:, None] == y[None, :]
        if not same.any():
            break
        out += same
    return out


def tile(a: list[str], b: list[str], longer: int, by_end: bool) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of ``a`` and of ``b`` that are one edit apart, the longer of length ``longer``, and share their first half (or, ``by_end``, only the last)."""
    # Different padding: beyond its end no word equals another.
    left_a, right_a, n_a = code_points(a, longer, -1)
    left_b, right_b, n_b = code_points(b, longer, -2)
    prefix, suffix = _common(left_a, left_b), _common(right_a, right_b)
    longest = np.maximum(n_a[:, None], n_b[None, :])
    ok = (longest == longer) & (np.minimum(n_a[:, None], n_b[None, :]) >= longer - 1)
    ok &= (prefix.astype(np.int32) + suffix >= longer - 1) & (prefix < longer)
    half = longer // 2
    ok &= (prefix < half) & (suffix >= longer - half) if by_end else prefix >= half
    return np.nonzero(ok)


def _units(rows: DataFrame, block: int) -> DataFrame:
    """Rows of the groups, those of big groups once for each pair of blocks they take part in."""
    group = ["longer", "by_end", "half"]
    room = F.least(F.lit(block), F.greatest(F.lit(1), (F.lit(CELLS) / F.col("longer")).cast("int")))
    big = written(rows.groupBy(*group).agg(F.count("*").alias("size"), F.max("is_longer").alias("any")).where("any")
                  .withColumn("blocks", F.ceil(F.col("size") / room).cast("int")).where("blocks > 1").select(*group, "blocks"))
    joined = rows.join(F.broadcast(big) if big.count() <= SMALL else big, group, "left")
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    joined = joined.withColumn("own", F.coalesce(own, F.lit(0)))
    joined = joined.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0)))))
    return joined.select(*group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", F.col("blocks").isNotNull().alias("big"), "word", "n")


_OUT = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def _tiled(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Both directions of the pairs of every tile, from rows sorted by group and pair of blocks."""

    def compare(key, units) -> pa.RecordBatch | None:
        rows = [r for unit in units for r in unit]
        i, j = key[3:5]
        a = [r for r in rows if r[0] == i] if key[5] and i != j else rows
        b = [r for r in rows if r[0] == j] if key[5] and i != j else rows
        if not a or not b:
            return None
        x, y = tile([r[1] for r in a], [r[1] for r in b], key[0], key[1])
        if a is b:
            x, y = x[x < y], y[x < y]
        if not len(x):
            return None
        wa, na = np.array([r[1] for r in a], object), np.array([r[2] for r in a], np.int64)
        wb, nb = np.array([r[1] for r in b], object), np.array([r[2] for r in b], np.int64)
        cols = [np.concatenate([wa[x], wb[y]]), np.concatenate([wb[y], wa[x]]), np.concatenate([nb[y], na[x]])]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT)], schema=_OUT)

    packed, held, first, now, unit = [], 0, None, None, []

    def close():
        """The finished unit joins the packed ones, or is a tile of its own."""
        nonlocal packed, held, first, unit
        done = []
        if unit and now[5]:
            done.append((now, [unit]))
        elif len(unit) > 1:
            room = min(block, max(1, CELLS // now[0]))
            if packed and (first[:2] != now[:2] or held + len(unit) > room):
                done.append((first, packed))
                packed, held = [], 0
            if not packed:
                first = now
            packed.append(unit)
            held += len(unit)
        unit = []
        return done

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("longer", "by_end", "half", "i", "j", "big", "own", "word", "n")]
        for *key, own, word, n in zip(*cols):
            if key != now:
                for k, units in close():
                    if (out := compare(k, units)) is not None:
                        yield out
                now = key
            unit.append((own, word, n))
    for k, units in [*close(), *([(first, packed)] if packed else [])]:
        if (out := compare(k, units)) is not None:
            yield out


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, near, near_n: every ordered pair of words (word, n) that are one edit apart. ``words`` has each word once."""
    size = F.length("word")

    def seats(longer: Column, is_longer: bool):
        half = F.floor(longer / 2).cast("int")
        at = lambda by_end, part: F.struct(longer.alias("longer"), F.lit(by_end).alias("by_end"), part.alias("half"), F.lit(is_longer).alias("is_longer"))
        return [at(False, F.substring("word", F.lit(1), half)), at(True, F.substring("word", size - (longer - half) + 1, longer - half))]

    rows = words.where(size > 0).select("word", "n", F.explode(F.array(*seats(size, True), *seats(size + 1, False))).alias("s")).select("word", "n", "s.*")
    units = _units(rows, block)
    key = ["longer", "by_end", "half", "i", "j"]
    dealt = units.repartition(partitions(words.sparkSession), *key).sortWithinPartitions(*key)
    return dealt.mapInArrow(lambda b: _tiled(b, block), "word string, near string, near_n long")


def _roots(links: DataFrame) -> DataFrame:
    """word, root: where following the links (word, form) ends. A form has more occurrences than its word, so no link comes back."""
    root = written(links.select("word", F.col("form").alias("root")))
    while True:
        on = root.select(F.col("word").alias("__w"), F.col("root").alias("__r"))
        root = written(root.join(on, F.col("root") == F.col("__w"), "left").select("word", F.coalesce("__r", "root").alias("root"), F.col("__r").isNotNull().alias("moved")))
        if not root.where("moved").limit(1).count():
            return root.select("word", "root")


def variants(words: DataFrame, factor: int = 5, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``words`` (word, n).

    The form is the most frequent near word if it is ``factor`` times as frequent as the word; the root is where forms lead.
    """
    words = written(words.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")))
    near = near_words(words, block).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    found = words.join(near, "word", "left").withColumn("form_n", -F.col("best.minus"))
    good = F.col("form_n") >= factor * F.col("n")
    found = written(found.select(
        "word", F.when(good, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(good, F.col("form_n")).alias("form_n")))
    out = found.join(_roots(found.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
