"""The pipeline against plain Python, stage by stage, on a given table and on empty ones."""

import re

import corpus_pipeline as C
from pyspark.sql import functions as F

from pagelake.llm import decontaminate
from pagelake.llm.common import written

from .test_operators import SF, base_spans, shingles


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def first_of_groups(docs):
    sets = {i: shingles(r.text) for i, r in docs.items()}
    comp = {i: i for i in sets}

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = sets[a], sets[b]
            if x and 100 * len(x & y) >= 85 * len(x | y):
                p, q = sorted((top(a), top(b)))
                comp[q] = p
    return {i for i in ids if top(i) == i}


def plain_words(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_stages_against_plain_python(spark, monkeypatch):
    seen = {}

    def watched(name, stage):
        def run(spark, docs, sf_dir):
            out = written(stage(spark, docs, sf_dir))
            seen[name] = rows(docs), rows(out)
            return out

        return run

    monkeypatch.setattr(C, "STAGES", [(n, watched(n, f)) for n, f in C.STAGES])
    result = C.run(spark, SF)
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert result.columns[:len(columns)] == columns

    before, after = seen["language"]
    assert set(after) == {i for i, r in before.items() if any(c.isalpha() for c in r.text or "")}

    before, after = seen["near_duplicates"]
    assert set(after) == first_of_groups(before)

    before, after = seen["decontamination"]
    items = [plain_words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items = [w for w in items if len(w) >= decontaminate.SHORTEST]
    text = {i: " " + " ".join(plain_words(r.text)) + " " for i, r in before.items()}
    assert set(after) <= {i for i, t in text.items() if not any(" " + " ".join(w) + " " in t for w in items)}
    for i in set(before) - set(after):
        own = set(text[i].split())
        assert any(sum(x in own for x in w) >= decontaminate.LCS * len(w) for w in items)

    before, after = seen["personal_data"]
    assert set(before) == set(after)
    for i, r in before.items():
        found = base_spans(r.text)
        assert (after[i].text == r.text and after[i].n_chars == r.n_chars) or after[i].n_chars == len(after[i].text)
        assert not [s for s in found if r.text[s[1]:s[2]] in after[i].text and len(r.text[s[1]:s[2]]) > 12]
        assert not found or re.search("<(EMAIL|IP|CARD|PHONE)>", after[i].text)

    before, after = seen["mixture"]
    assert set(after) <= set(before) and all(r.copies > 0 for r in after.values())


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_mixture_keeps_every_clean_document(spark):
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in C.mixture(spark, docs, sf).select("doc_id").collect()}
    domain = {r.doc_id: r.domain for r in C.domain_labels(spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    clean = {r.doc_id for r in docs.select("doc_id").collect() if domain.get(r.doc_id) == "clean"}
    toxic = {r.doc_id for r in docs.select("doc_id").collect() if domain.get(r.doc_id) == "toxic"}
    assert clean and clean <= kept and len(toxic & kept) <= 0.1 * len(toxic)


def test_personal_data_learns_from_every_document(spark):
    """Secrets too rare for a sample of 20,000 documents to tell of them."""
    value = F.concat(F.translate(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 30), "0123456789", "ghijklmnop"), F.lit("a7"))
    secret = F.concat(F.lit("a token = "), value, F.lit(" b"))
    text = F.when(F.col("id") % 500 == 3, secret).otherwise(F.concat(F.lit("no 1"), F.col("id") + 100_000))
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), text.alias("text")).withColumn("n_chars", F.length("text"))
    got = C.personal_data(spark, docs, SF).where("doc_id % 500 = 3").groupBy("text", "n_chars").count().collect()
    assert sum(r["count"] for r in got if (r.text, r.n_chars) == ("a token = <SECRET> b", 20)) >= 60
