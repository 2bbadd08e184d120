"""Added spans of personal data: planted disguises and secrets that the base rules miss, beside numbers of other kinds."""

import math
import random

from pyspark.sql import functions as F

from pagelake.llm import pii


def luhn_card(r):
    d = [r.randrange(10) for _ in range(15)]
    total = sum(x if i % 2 else (2 * x - 9 if 2 * x > 9 else 2 * x) for i, x in enumerate(d))
    return "".join(map(str, [*d, -total % 10]))


def planted(n, seed):
    """Documents with what the rules know, what they miss, and harmless numbers; (kind, value) of the second."""
    r = random.Random(seed)
    word = lambda k=6: "".join(r.choice("abcdefghij") for _ in range(k))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k - 2)) + "a7"
    phone = lambda: f"{r.randrange(1, 99)} ({r.randrange(100, 999)}) {r.randrange(100, 999)}-{r.randrange(1000, 9999)}"
    docs, missed = [], {}
    for k in range(n):
        known = [f"{word()}.{r.randrange(99)}@{word()}.org", ".".join(str(r.randrange(256)) for _ in range(4)), luhn_card(r), f"+{phone()}", f'token = "{hexa(40)}"']
        other = [f"{r.randrange(1900, 2030)}-{r.randrange(10, 12)}-{r.randrange(10, 28)}", f"{r.randrange(10**6, 10**7)}", f"{r.randrange(100, 999)}.{r.randrange(1000, 9999)}", f"{word(18)}", f"{r.randrange(10, 24)}:{r.randrange(10, 59)}:{r.randrange(10, 59)}"]
        new = [("email", f"{word()} (at) {word()} (dot) org".replace("j ", "k ")), ("secret", hexa(40)), ("email", f"{word()}.{word(4)} [at] {word()}.net")]
        parts = [r.choice(known), r.choice(other), r.choice(other)]
        if k % 3 == 0:
            kind, value = r.choice(new)
            parts.append(value if kind != "secret" else f"see {value}")
            missed[k] = (kind, value)
        r.shuffle(parts)
        docs.append((k, " ".join(w for p in parts for w in (word(), word(3), p)) + " " + word()))
    return docs, missed


def test_added_spans_have_recall_and_precision(spark):
    docs, missed = planted(1500, 3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = pii.find(df).withColumn("extra", F.array_except("spans", "base")).select("doc_id", "extra", "base").collect()
    text = dict(docs)
    added = [(r.doc_id, s.kind, text[r.doc_id][s.start:s.end]) for r in found for s in r.extra]
    assert sum(len(r.base) for r in found) > 1000
    want = {(k, kind, v) for k, (kind, v) in missed.items()} | {(k, "secret", t.split('token = "')[1][:40]) for k, t in docs if "token =" in t}
    hit = {a for a in added if a in want}
    assert len(hit) >= 0.95 * len(want) and len(added) - len(hit) <= 0.02 * len(added)


def test_sample_does_not_depend_on_how_rows_are_dealt(spark):
    docs, _ = planted(400, 5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    drawn = [sorted(r.text for r in pii.sample_of(df.repartition(n), 100).collect()) for n in (1, 7)]
    assert drawn[0] == drawn[1] and 50 < len(drawn[0]) < 200
    key = lambda rows: sorted((tuple(r.f), tuple(r.y), r.test) for r in rows.collect())
    assert key(pii.examples(df.repartition(1))) == key(pii.examples(df.repartition(7)))


def test_overlapping_repeated_and_null_rows(spark):
    docs, _ = planted(900, 4)
    odd = [(None, "a token = \"0123456789abcdef0123456789abcdef01234567\""), (None, None), (7, ""), (7, ""), (8, "x" * 100_000 + " me@x.org " + "1" * 5000), (9, "10.0.0.1 " * 2000)]
    got = pii.find(spark.createDataFrame(docs + odd, "doc_id long, text string")).collect()
    assert len(got) == 906
    for r in got:
        spans = [(s.start, s.end) for s in r.spans]
        base = {(s.kind, s.start, s.end) for s in r.base}
        assert base <= {(s.kind, s.start, s.end) for s in r.spans}
        extra = sorted((s.start, s.end) for s in r.spans if (s.kind, s.start, s.end) not in base)
        assert all(a[1] <= b[0] for a, b in zip(extra, extra[1:])) and len(spans) == len(set(spans)) or base
        assert [pii.ADDED.index(s.kind) for s in r.spans] == sorted(pii.ADDED.index(s.kind) for s in r.spans)
    null = next(r for r in got if r.doc_id is None and r.text)
    assert [(s.kind, null.text[s.start:s.end]) for s in null.spans] == [("secret", null.text[-41:-1])]
    assert next(len(r.base) for r in got if r.doc_id == 9) == 2000 or any(len(r.base) == 2000 for r in got)


def test_trees_learn_from_every_document(spark):
    """Secrets in 2 of 1,000 of more documents than a sample of 20,000 would hold."""
    secret = F.concat(F.lit("token = "), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 30), F.lit("a7"))
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 500 == 3, secret).otherwise(F.concat(F.lit("no 1"), F.col("id") + 100_000)).alias("text"))
    e = pii.examples(df).where("not test")
    n, secrets = e.count(), e.where(F.col("y")[pii.ADDED.index("secret")]).count()
    assert secrets >= pii.LEAST
    model = pii.fit(df)["secret"]
    assert abs(model.base - math.log(secrets / (n - secrets))) < 1e-9 and model.threshold is not None
