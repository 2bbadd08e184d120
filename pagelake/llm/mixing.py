"""Mixing by soft membership, in DataFrame operations only.

A naive Bayes classifier over hashed words is learnt from a labelled table (a bounded sample, ``SAMPLE`` rows); its
word weights (``BUCKETS`` a domain) become literals of an expression that gives every document's domain posteriors. A
weight is the log of how much more often a word stands in a domain than its share of all words, both counts plus
``PRIOR``: rare words tell nothing, however small the domain or long its documents.
Rates r >= 0 then minimise the squared difference between the expected tokens of each domain, sum of n * p * r, and its
target, by projected gradient steps. A document's step depends on its posteriors alone, so documents with the same
posteriors (to ``GRID``) are summed once and every step is one aggregation of that table; the driver sees one number a
domain and step. Rates follow for every document by folding the steps.

A domain may be kept ``whole``: documents labelled with it, and those without a label that are likeliest of it, have rates
of 1 or more, so none goes. The budget is then the least that has room for them in every domain with a share; what they
hold of a domain without a share stays.

Copies are the rate rounded up or down by a hash of the id and text, so that they add up to the rate on average. Null
and empty texts have no tokens: their posteriors are the priors and their rate counts for nothing. A domain without
labelled rows gets no posterior, a target for it cannot be met. Without labelled rows nothing is learnt and all
documents share one domain, the first. Null and repeated ids keep their rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import written

SAMPLE, BUCKETS, GRID, STEPS, TOLERANCE = 20_000, 8192, 200, 40, 1e-4
#: Occurrences added to a word's count and to its expected count in each domain.
PRIOR = 1.0


def word_ids(text: Column) -> Column:
    """Bucket of each word, words being parted by blanks."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.hash(w), F.lit(BUCKETS)) + 1)


def known_domains(labels: DataFrame, domains: list[str]) -> DataFrame:
    return labels.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))


def learn(docs: DataFrame, labels: DataFrame, domains: list[str], sample: int = SAMPLE) -> tuple[list[float], list[list[float]]]:
    """Log priors and word weights of the domains from ``labels`` (doc_id, domain)."""
    known = known_domains(labels, domains)
    share = min(1.0, sample / max(1, known.count()))
    known = written(known.where(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1_000_003)) / 1_000_003 < share).limit(2 * sample))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    counts = written(rows.select("domain", F.explode(F.array_distinct(word_ids(F.col("text")))).alias("word")).groupBy("domain", "word").agg(F.count("*").alias("n")))
    n = {r.domain: r.n for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    table = np.zeros((len(domains), BUCKETS))
    for r in counts.toLocalIterator():  # at most BUCKETS rows a domain
        table[domains.index(r.domain), r.word - 1] = r.n
    total = np.array([n.get(d, 0) for d in domains], float)
    expected = table.sum(0) * table.sum(1, keepdims=True) / max(1.0, table.sum())
    weights = np.log((table + PRIOR) / (expected + PRIOR))
    weights -= weights[:1]  # what does not tell domains apart is zero
    prior = np.where(total > 0, np.log(np.maximum(total, 1) / max(1.0, total.sum())), -60.0)
    if not total.sum():
        prior = np.array([0.0] + [-60.0] * (len(domains) - 1))
    weights[total == 0] = 0
    return prior.tolist(), weights.tolist()


def with_posteriors(docs: DataFrame, domains: list[str], prior: list[float], weights: list[list[float]]) -> DataFrame:
    """Adds n_tokens and p (array of double, one a domain, to 1 / GRID)."""
    own = [F.col(c) for c in docs.columns if c not in ("n_tokens", "p")]
    ids = docs.select(*own, word_ids(F.col("text")).alias("__ids"))
    distinct = ids.select("*", F.size("__ids").cast("bigint").alias("n_tokens")).withColumn("__ids", F.array_distinct("__ids"))
    logits = [F.lit(prior[0])]
    for b, w in zip(prior[1:], weights[1:]):
        logits.append(F.aggregate("__ids", F.lit(0.0), _added(_numbers([round(x, 4) for x in w]))) + F.lit(b))
    scored = distinct.select(*own, "n_tokens", F.array(*logits).alias("__z"))
    top = scored.withColumn("__z", F.transform("__z", lambda z: F.exp(F.greatest(z - F.array_max("__z"), F.lit(-60.0)))))
    return top.select(*own, "n_tokens", _grid(F.col("__z"), len(domains)).alias("p"))


def _numbers(values: list[float]) -> Column:
    """Constant array, folded by the optimizer from one string; thousands of literals would make a slow plan."""
    return F.split(F.lit(" ".join(map(repr, values))), " ").cast("array<double>")


def _added(table: Column):
    return lambda a, i: a + F.element_at(table, i)


def _grid(z: Column, k: int) -> Column:
    """Shares rounded to the grid; the first takes the rest."""
    total = F.aggregate(z, F.lit(0.0), lambda a, x: a + x)
    rest = [F.round(z[i] / total * GRID) / GRID for i in range(1, k)]
    first = F.lit(1.0)
    for r in rest:
        first = first - r
    return F.array(F.greatest(first, F.lit(0.0)), *rest)


def fit_rates(posteriors: DataFrame, targets: list[float], steps: int = STEPS) -> list[list[float]]:
    """Steps (one number a domain each) that lead from rate 1 to the least squares rates of ``least`` or more."""
    k = len(targets)
    groups = written(posteriors.groupBy("p", "least").agg(F.sum("n_tokens").cast("double").alias("n")).where("n > 0"))
    m = groups.agg(*[F.sum(F.col("n") * F.col("p")[i] * F.col("p")[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(k)]).first()
    gram = np.array([[m[f"m{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)])
    scale = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-9))
    rate = 1 / max(1e-9, float(np.linalg.eigvalsh(scale[:, None] * gram * scale[None, :]).max()))
    path: list[list[float]] = []
    t = np.array(targets, float)
    last = math.inf
    for _ in range(steps):
        r = rates(F.col("p"), path, F.col("least"))
        got = groups.agg(*[F.sum(F.col("n") * F.col("p")[i] * r).alias(f"t{i}") for i in range(k)]).first()
        miss = np.array([got[f"t{i}"] or 0.0 for i in range(k)]) - t
        size = float(np.abs(miss).sum() / max(1.0, t.sum()))
        if size < TOLERANCE or abs(last - size) < TOLERANCE * 0.01:
            break
        last = size
        path.append((rate * scale**2 * miss).tolist())
    return path


def rates(p: Column, path: list[list[float]], least: Column) -> Column:
    """Rate of a document with posteriors ``p``: each step goes down the gradient and back to ``least`` or more."""
    if not path:
        return F.lit(1.0)
    steps = F.transform(F.split(F.lit(";".join(" ".join(map(repr, map(float, e))) for e in path)), ";"), lambda e: F.split(e, " ").cast("array<double>"))

    def step(r: Column, e: Column) -> Column:
        return F.greatest(least, r - F.aggregate(F.zip_with(p, e, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x))

    return F.aggregate(steps, F.lit(1.0), step)


def mix(docs: DataFrame, labels: DataFrame, shares: dict[str, float], budget: float = 0.8, keep: list[str] | None = None, whole: str | None = None) -> DataFrame:
    """``keep`` columns (all by default) with n_tokens, p, rate, copies; domain d gets shares[d] of ``budget`` times all tokens.

    With a domain ``whole``, of which no document goes, the budget follows from what that domain holds.
    """
    domains = list(shares)
    own = [c for c in (keep if keep is not None else docs.columns) if c not in ("n_tokens", "p", "rate", "copies")]
    model = learn(docs, labels, domains)

    def scored(columns: list[str]) -> DataFrame:
        """``columns`` of the documents with n_tokens, p and the least rate."""
        rows = with_posteriors(docs.select(*dict.fromkeys(["doc_id", "text", *columns])), domains, *model)
        least = F.lit(0.0)
        if whole is not None:
            label = known_domains(labels, domains).select(F.col("doc_id").alias("__id"), F.col("domain").alias("__label"))
            rows = rows.select(*dict.fromkeys(["doc_id", *columns]), "n_tokens", "p").join(label, F.col("doc_id") == F.col("__id"), "left")
            likeliest = F.element_at(F.array(*map(F.lit, domains)), F.array_position("p", F.array_max("p")).cast("int"))
            least = (F.coalesce("__label", likeliest) == whole).cast("double")
        return rows.select(*columns, "n_tokens", "p", least.alias("__least"))

    # What the rates are fitted to is written without the texts; rates are then an expression over the documents.
    few = own if set(own) <= {"doc_id"} else []
    fitted = written(scored(few))
    sums = fitted.agg(F.sum("n_tokens").alias("all"), *[F.sum(F.col("n_tokens") * F.col("__least") * F.col("p")[k]).alias(f"f{k}") for k in range(len(domains))]).first()
    tokens = budget * (sums["all"] or 0)
    if whole is not None:
        tokens = max([(sums[f"f{k}"] or 0.0) / shares[d] for k, d in enumerate(domains) if shares[d] > 0], default=0.0)
    path = fit_rates(fitted.withColumnRenamed("__least", "least"), [tokens * shares[d] for d in domains])
    rows = fitted if own and few else scored(list(dict.fromkeys(["doc_id", *own])))
    draw = F.pmod(F.xxhash64("doc_id", "n_tokens", F.lit(41)), F.lit(1_000_003)) / 1_000_003
    out = rows.withColumn("rate", rates(F.col("p"), path, F.col("__least")))
    return out.select(*own, "n_tokens", "p", "rate", F.floor(F.col("rate") + draw).cast("bigint").alias("copies"))
