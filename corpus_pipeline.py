"""The corpus pipeline: language ID, near-duplicates, decontamination, personal data, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's
documents. When a stage begins, the tables that the one before wrote on its way are dropped, unless its documents read them; a
result that was not written before the next stage began is lost with them. All but the last keep the columns of ``documents``. Null texts go with the first stage; a document that has
a null id cannot be named as a copy or a leak and stays. Rows are dropped by id.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm import decontaminate, langid, mixing, neardup, pii
from pagelake.llm.common import TABLES, drop, prepare, read_by, table, written
from pagelake.llm.registry import SHARES, domain_labels

#: SQL cannot express the stages; tests/llm/test_pipeline.py holds them against plain Python.
ORACLE_SQL = None


#: Tables that the last stage wrote on its way.
_left: list[str] = []


def _stage(fn):
    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = {r.rsplit("/", 1)[-1] for r in read_by(docs)}
        kept = [t for t in _left if t.rsplit("/", 1)[-1] in read]
        drop(spark, [t for t in _left if t not in kept])
        there = set(TABLES)
        out = fn(spark, docs, sf_dir)
        _left[:] = kept + [t for t in TABLES if t not in there]
        return out

    return run_stage


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is not in ``ids``; a counted, small list is broadcast."""
    ids = written(ids.select("doc_id").where("doc_id is not null").distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= neardup.SMALL_IDS else ids, "doc_id", "left_anti").select(docs.columns)


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be told; those without a letter go."""
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs, model).where("lang_pred <> 'und'").select(docs.columns)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return _without(docs, neardup.near_duplicates(docs).where("not kept"))


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return _without(docs, decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")))


@_stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the new text."""
    # The new text has a name of its own: a length taken beside an alias "text" would be that of a text redacted twice.
    found = pii.find(docs)
    found = found.withColumn("__new", pii.redact(F.col("text"), F.col("spans")))
    new = {"text": F.col("__new").alias("text"), "n_chars": F.when(F.size("spans") > 0, F.length("__new")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")}
    return found.select(*[new.get(c, F.col(c)) for c in docs.columns])


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the number of copies that meets the target shares; those with none go, of the clean domain none goes."""
    return mixing.mix(docs, domain_labels(table(spark, sf_dir, "labels")), SHARES, whole="clean").where("copies > 0")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
