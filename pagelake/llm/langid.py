"""Language ID by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton. A text is parsed greedily into the longest phrases that the
language's text holds; a walk from the initial state spells just these, so the automaton with a restart at every failing
step is one dense table, and a parse is one table look-up a character. Phrases times log2 of the labelled text's length,
over the characters parsed, is the cross entropy in bits a character. The language that needs least wins.

Texts are parsed whole, in blocks of ``BLOCK`` characters side by side; a block starts a new phrase in every language.
Characters are compared in lower case; everything but letters counts as one separator, and letters that no labelled text
holds as one unknown letter. Null texts and texts without a letter are ``und`` with score 0; ties go to the first label.
The score is 1 - best / second, which is 1 if one language alone was learnt. Without labelled text all is ``und``.

Labelled text is sampled: about ``SAMPLE_ROWS`` different texts a language, chosen by a hash of the text however many copies
there are, ``ROW_CHARS`` characters of each, ``CHARS`` a language. That bounds the automata (2 * CHARS states of ``ALPHABET`` entries) whatever the input.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import slices

CHARS, SAMPLE_ROWS, ROW_CHARS, ALPHABET, BLOCK = 32_000, 200, 160, 64, 256


class Model(NamedTuple):
    langs: list[str]
    classes: np.ndarray  # class of every code point; 0 separates
    letter: np.ndarray  # whether a code point is a letter
    tables: list[np.ndarray]  # next state times ALPHABET, by state and class; states up to ALPHABET - 1 begin a phrase
    bits: list[float]


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring; state 0 is the initial one."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur, p = len(step), last
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return step


def parse_table(text: list[int]) -> np.ndarray:
    """Dense table of the greedy parse: state c (below ALPHABET) has just begun a phrase with class c."""
    step = suffix_automaton(text)
    t = np.empty((ALPHABET + len(step), ALPHABET), np.int32)
    t[:] = np.arange(ALPHABET)  # no way on: a new phrase begins with this class
    for s, to in enumerate(step):
        for c, q in to.items():
            t[ALPHABET + s, c] = ALPHABET + q
    for c, q in step[0].items():
        t[c] = t[ALPHABET + q]
    return (t * ALPHABET).astype(np.int32)


def _folded() -> tuple[np.ndarray, np.ndarray]:
    low = np.arange(0x110000, dtype=np.int32)
    letter = np.zeros(0x110000, bool)
    for i in range(0x110000):
        ch = chr(i)
        if ch.isalpha():
            letter[i] = True
            x = ch.lower()
            low[i] = ord(x) if len(x) == 1 else i
    return low, letter


def build(samples: dict[str, list[str]], chars: int = CHARS) -> Model:
    low, letter = _folded()
    texts: dict[str, np.ndarray] = {}
    for lang, rows in samples.items():
        whole = "\n".join(rows)[:chars]
        texts[lang] = low[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)] if whole else np.zeros(0, np.int32)
    counts = Counter(x for t in texts.values() for x in t[letter[t]].tolist())
    common = [x for x, _ in sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[: ALPHABET - 2]]
    by_low = np.full(0x110000, ALPHABET - 1, np.uint8)
    by_low[common] = np.arange(1, len(common) + 1)
    classes = np.where(letter, by_low[low], 0).astype(np.uint8)
    langs = sorted(lang for lang, t in texts.items() if letter[t].any())
    tables = [parse_table(classes[texts[lang]].tolist()) for lang in langs]
    return Model(langs, classes, letter, tables, [float(np.log2(len(texts[lang]) + 1)) for lang in langs])


def phrases(model: Model, classes: np.ndarray, size: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """Phrases of each row in each language; ``classes`` holds a block a column, by falling ``size``, of the rows in ``owner``."""
    open_at = np.searchsorted(-size, -np.arange(len(classes)), "left")  # columns longer than i
    out = np.zeros((rows, len(model.langs)), np.int64)
    for k, table in enumerate(model.tables):
        flat = table.ravel()
        at = np.zeros(classes.shape[1], np.int32)
        at[:] = ALPHABET * ALPHABET  # the initial state
        n = np.zeros(classes.shape[1], np.int32)
        for m, c in zip(open_at.tolist(), classes):
            if not m:
                break
            now = flat.take(at[:m] + c[:m])
            n[:m] += now < ALPHABET * ALPHABET
            at = now
        out[:, k] = np.bincount(owner, n, rows).astype(np.int64) + np.bincount(owner, minlength=rows)
    return out


def score_texts(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the best language (-1: none), score, and bits a character of the best, of UTF-8 rows."""
    rows = len(offsets) - 1
    # UTF-8 is valid here, so code points and their rows follow from the bytes that do not continue one.
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    edge = begins[offsets]
    has = np.add.reduceat(np.append(model.letter[points], False), np.minimum(edge[:-1], len(points)), dtype=np.int64) if rows else np.zeros(0, np.int64)
    has = np.where(np.diff(edge) > 0, has, 0) > 0
    best, score, bits = np.full(rows, -1), np.zeros(rows), np.zeros(rows)
    if not len(model.langs) or not has.any():
        return best, score, bits
    cls = model.classes[points]
    per = np.where(has, -(-np.diff(edge) // BLOCK), 0)
    owner = np.repeat(np.arange(rows), per)
    first = np.repeat(edge[:-1], per) + BLOCK * (np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per))
    size = np.minimum(BLOCK, edge[1:][owner] - first)
    order = np.argsort(-size, kind="stable")
    lanes = np.zeros((BLOCK, len(owner)), np.uint8)
    at = first[order][None, :] + np.arange(BLOCK)[:, None]
    inside = np.arange(BLOCK)[:, None] < size[order][None, :]
    lanes[inside] = cls[at[inside]]
    n = phrases(model, lanes, size[order], owner[order], rows)
    length = np.maximum(np.bincount(owner, size, rows), 1)
    h = n * np.array(model.bits) / length[:, None]
    best = np.where(has, h.argmin(1), -1)
    two = np.sort(h, 1)
    rest = two[:, 1] if h.shape[1] > 1 else np.full(rows, np.inf)
    score = np.where(has, np.clip(1 - two[:, 0] / np.maximum(rest, 1e-12), 0, 1), 0.0)
    return best, score, np.where(has, two[:, 0], 0.0)


def train(rows: DataFrame, chars: int = CHARS, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from text and lang of ``rows``; a bounded sample reaches the driver."""
    rows = rows.where("lang is not null and text rlike '\\\\p{L}'").select("lang", "text")
    have = {r.lang: max(1, r.n) for r in rows.groupBy("lang").agg(F.approx_count_distinct("text").alias("n")).collect()}
    if not have:
        return Model([], np.zeros(0x110000, np.uint8), np.zeros(0x110000, bool), [], [])
    share = F.create_map(*[F.lit(x) for lang, n in have.items() for x in (lang, min(1.0, sample_rows / n))])
    draw = F.pmod(F.xxhash64("text", F.lit(17)), F.lit(1_000_003)) / 1_000_003
    picked = rows.where(draw < share[F.col("lang")]).select("lang", F.xxhash64("text").alias("h"), F.substring("text", 1, ROW_CHARS).alias("text")).distinct()
    samples: dict[str, list[str]] = {lang: [] for lang in have}
    seen = set()
    for r in picked.orderBy("h").limit(4 * sample_rows * len(have)).collect():
        if (r.lang, r.h) not in seen:
            seen.add((r.lang, r.h))
            samples[r.lang].append(r.text)
    return build(samples, chars)


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) with lang_pred, score and bits_per_char of every row's whole text."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    keep = keep if keep is not None else [c for c in docs.columns if c not in ("lang_pred", "score", "bits_per_char")]
    schema = StructType([docs.schema[c] for c in keep] + [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("bits_per_char", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = "text" if "text" in keep else "text_to_parse"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = pa.array([*m.langs, "und"])
        for b, data, offsets in slices(batches, column, 1 << 20):
            best, score, bits = score_texts(m, data, offsets)
            out = [b.column(c) for c in keep]
            out += [names.take(pa.array(np.where(best < 0, len(m.langs), best))), pa.array(score), pa.array(bits)]
            yield pa.RecordBatch.from_arrays(out, [*keep, "lang_pred", "score", "bits_per_char"])

    return docs.select(*keep, *([] if column in keep else [F.col("text").alias(column)])).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows kept out of training: crc32 of the id as text leaves 2 modulo 4; a null id is trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
