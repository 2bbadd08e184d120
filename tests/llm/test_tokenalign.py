"""Token alignment against a plain two-pointer walk over whole texts, with runs and merges of several levels."""

import hashlib
import re
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagelake.llm import registry, tokenalign

A, B = f"{registry.TOKENIZERS}/byte_bpe_50k.json", f"{registry.TOKENIZERS}/piece_bpe_32k.model"
ODD = [
    None, "", " ", "  a", "a ", "one two  three\n\n four\tfive'll it's  ", "naïve café — 東京 🙂  x", "▁ up", "a▁b", "<s> </s> <unk> <|endoftext|> <0x41>",
    "x y z\u0085 w", "a\x1c b", "x" * 5000, "word " * 3000, "١٢٣ abc ½", "a\x00b", "éa èb ça",
]


@pytest.fixture(scope="module")
def files(spark):
    return tokenalign.read_file(spark, A), tokenalign.read_file(spark, f"file://{B}")


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    value = tokenalign._byte_values()
    a_bytes = {k: bytes(value[c] for c in p) for p, k in a.get_vocab().items() if all(c in value for c in p)}

    def piece(k):
        p = b.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()

    def one(text):
        if not text:
            return None
        x, y, whole = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
        if b"".join(a_bytes[k] for k in x) != whole or b"".join(map(piece, y)) != whole:
            return None
        i = j = at_a = at_b = 0
        links, groups, ga, gb = [], [], [], []
        while i < len(x):
            links.append((x[i], y[j]))
            ea, eb = at_a + len(a_bytes[x[i]]), at_b + len(piece(y[j]))
            if ea <= eb:
                ga.append(x[i])
                i, at_a = i + 1, ea
            if eb <= ea:
                gb.append(y[j])
                j, at_b = j + 1, eb
            if ea == eb:
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                ga, gb = [], []
        return len(x), len(y), groups, links

    def all_of(texts):
        found = [one(t) for t in texts]
        count = Counter(p for f in found if f for p in f[3])
        best = {}
        for (_, k), c in count.items():
            best[k] = max(best.get(k, 0), c)
        rows = [(0,) * 6 + ("",) if f is None else (
            f[0], f[1], len(f[2]), len(f[3]), sum(count[p] == best[p[1]] for p in f[3]), sum(count[p] for p in f[3]),
            hashlib.sha256(";".join(f[2]).encode()).hexdigest()) for f in found]
        return rows, {(p[0], p[1], c, c == best[p[1]]) for p, c in count.items()}

    return all_of


def test_odd_texts_equal_a_plain_walk(spark, files, plain):
    texts = [*ODD, ODD[5], ODD[6]]
    ids = [*range(len(ODD)), 5, None]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("run", "bucket", "pairs", "docs", "id", "key", "n_a")])
    digest, pairs = tokenalign.align(docs, *files)
    want, counts = plain(texts)
    got = digest.collect()
    assert digest.columns == ["doc_id", *[x.split()[0] for x in tokenalign.DIGEST.split(", ")]]
    assert Counter(tuple(r) for r in got) == Counter((i, *w) for i, w in zip(ids, want))
    assert {tuple(r) for r in pairs.collect()} == counts
    assert all(w[0] == 0 for t, w in zip(texts, want) if t and "▁" in t) and sum(w[0] > 0 for w in want) >= 13


def test_many_runs_and_levels_equal_a_plain_walk(spark, files, plain):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want, counts = plain([r.text for r in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    digest, pairs = tokenalign.align(docs, *files, run_links=4000, buckets=4, fan=3)
    assert {tuple(r) for r in digest.collect()} == {(r.doc_id, *w) for r, w in zip(rows, want)}
    assert {tuple(r) for r in pairs.collect()} == counts


def test_empty_table_and_bad_parameter(spark, files):
    none = spark.createDataFrame([], "doc_id long, text string")
    digest, pairs = tokenalign.align(none, *files)
    assert digest.count() == pairs.count() == 0
    with pytest.raises(ValueError):
        tokenalign.align(none, *files, buckets=3)


def test_blobs_and_forgetting(files, plain, monkeypatch):
    import numpy as np

    arrays = [np.array([1, -5, 1 << 40]), np.zeros(0, np.int64), np.array([7])]
    assert all((x == y).all() for x, y in zip(arrays, tokenalign.unpack(tokenalign.pack(*arrays)), strict=True))
    monkeypatch.setattr(tokenalign, "KNOWN", 5)
    cuts = tokenalign.Cuts(tokenalign._loaded(*files), 2)
    for text in ["a b c d", "e f g h i", "a b x y z w v"]:
        at, n = cuts.look_up([text, ""])
        assert n.tolist() == [len(text.split()), 0] and cuts.counts[at, 1].sum() == plain([text])[0][0][0]
