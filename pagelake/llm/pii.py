"""Personal data by candidate gradient boosting, in DataFrame operations only.

Four base rules (e-mail, IP address, card, phone) give spans that always stay. High-recall generators propose further,
possibly overlapping spans, among them long runs of letters and digits that may be secrets; boosted trees of depth two
score them for each kind by their format and surroundings, and a threshold calibrated on rows the trees have not
seen decides which are redacted too.

The trees learn from what the rules and contexts tell, but must judge without it, so that they find more than these do:
base spans are also shown in disguise (``name (at) host (dot) org``, phones without their plus sign, card groups parted
by other signs), and runs behind an assignment to a name such as ``token`` or ``password`` are examples of secrets, while
no feature tells of that name. Written-out addresses that no rule knows are no counter-examples. They learn from all
documents: examples with equal features and truth are one row with their number. Histograms of gradients are grouped in
Spark, only their (feature, value) sums reach the driver, and the finished trees are column expressions, applied to all
documents in one projection.

A candidate that touches a base span adds nothing; of overlapping added spans the best score wins, then the first. Null
text counts as empty. Spans count code points, ends exclusive. Rows are judged by their text alone, so null and repeated
ids, repeated rows and further columns do no harm. With too little to learn from, only base spans are given.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import written

KINDS = ["email", "ip", "card", "phone"]
#: Kinds of added spans, in the order in which spans are listed.
ADDED = [*KINDS, "secret"]
# The base rules. Possessive forms and look-behinds find the same spans as the plain rules without trying a long run
# again from each of its characters; a card rule of exact length is the plain one's longest run, checked for length.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
RULES = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE)))
#: Generators: written-out addresses, and any run of six or more digits and the signs that group them.
MAIL_LIKE = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}+){1,8}+"
NUMBER_LIKE = r"(?<![0-9])[+(]?[0-9](?:[ ().:/_-]{0,2}[0-9]){5,30}+(?![0-9])"
SECRET_LIKE = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]{0,64}[0-9])(?=[0-9_+/=-]{0,64}[A-Za-z])[A-Za-z0-9_+/=-]{16,200}+(?![A-Za-z0-9_+/=-])"
#: What stands before an example of a secret; no feature may tell of it.
ASSIGNED = r"(?i)(token|secret|key|passw(or)?d|pwd|credentials?)[\"']?\s{0,3}[:=]\s{0,3}[\"']?$"
CUES = r"(?i)(mail|e-mail|tel|phone|call|fax|mobile|ip|host|card|visa|account)[:.]?\s*$"
SAMPLE_DOCS, ROUNDS, RATE, SHRINK, TOP_VALUE, PRECISION, LEAST = 20_000, 8, 0.5, 1.0, 64, 0.99, 40
#: Lengths added up one by one before a carried sum takes over.
BLOCK = 256


def _starts(lens: Column) -> Column:
    """Running sums before each element; work follows the length, by blocks of sums."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / BLOCK).cast("int")), lambda b: F.slice(lens, b * BLOCK + 1, F.lit(BLOCK)))
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, e: a + e)
    carried = F.aggregate(F.transform(blocks, total), F.array(F.lit(0)), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s)))
    return F.flatten(F.transform(F.arrays_zip(blocks.alias("x"), F.slice(carried, 1, F.size(carried) - 1).alias("c")), lambda z: F.transform(z["x"], lambda e, i: z["c"] + total(F.slice(z["x"], F.lit(1), i)))))


SPAN = "array<struct<start:int,end:int,value:string>>"


def with_matches(df: DataFrame, text: Column, rules: dict[str, tuple[Column, str]]) -> DataFrame:
    """Adds a column of spans for each rule (what a text must have, pattern): leftmost non-overlapping matches.

    What lies between matches gives their places. Each step is a column of its own, so that no text is searched twice.
    """
    own = df.columns
    m, g, n, at = ({k: f"__{x}_{k}" for k in rules} for x in ("match", "gap", "len", "at"))
    some = {k: F.size(F.coalesce(m[k], F.array().cast("array<string>"))) > 0 for k in rules}
    df = df.withColumns({m[k]: F.when(need, F.regexp_extract_all(text, F.lit(p), F.lit(0))) for k, (need, p) in rules.items()})
    df = df.withColumns({g[k]: F.when(some[k], F.transform(F.split(text, p, -1), F.length)) for k, (_, p) in rules.items()})
    df = df.withColumns({n[k]: F.when(some[k], F.zip_with(F.slice(g[k], F.lit(1), F.size(m[k])), m[k], lambda x, y: x + F.length(y))) for k in rules})
    df = df.withColumns({at[k]: F.when(some[k], F.zip_with(_starts(F.col(n[k])), n[k], lambda x, y: x + y)) for k in rules})
    span = lambda end, value: F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"))
    spans = {k: F.when(some[k], F.zip_with(at[k], m[k], span)).otherwise(F.array().cast(SPAN)).alias(k) for k in rules}
    return df.select(*[F.col(c) for c in own], *spans.values())


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Sum of the Luhn rule over the digits of ``value``, modulo 10."""
    d = F.reverse(F.transform(F.filter(F.split(_digits(value), ""), lambda c: c != ""), lambda c: c.cast("int")))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x * 2 > 9, x * 2 - 9).otherwise(x * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10


def _small(part: Column) -> Column:
    return part.rlike("^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$")


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, "[.]"), _small)
    if kind == "card":
        return luhn(value) == 0
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _valid_spans(kind: str) -> Column:
    return F.filter(f"b_{kind}", lambda s: valid(kind, s["value"]))


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with arrays of base spans (``b_`` and the kind) and candidate spans (c_mail, c_number, c_secret).

    A text without the signs that a rule needs is not searched for it.
    """
    text = F.coalesce("text", F.lit(""))
    rules = {
        "b_email": (text.contains("@"), EMAIL), "b_ip": (text.rlike(r"[0-9]\.[0-9]"), IP), "b_card": (text.rlike("[0-9][0-9 -]{14}"), CARD),
        "b_phone": (text.contains("+"), PHONE), "c_mail": (text.contains("@") | text.contains("(at)") | text.contains("[at]"), MAIL_LIKE),
        "c_number": (text.rlike("[0-9][0-9 ().:/_-]{4}"), NUMBER_LIKE), "c_secret": (text.rlike("[A-Za-z0-9_+/=-]{16}"), SECRET_LIKE),
    }
    return with_matches(docs, text, rules).withColumns({f"b_{k}": _valid_spans(k) for k in ("ip", "card", "phone")})


def _count(value: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{keep}]", ""))


def _features(value: Column, before: Column, after: Column) -> Column:
    """Small whole numbers that describe a candidate and what stands around it."""
    groups = F.filter(F.split(value, "[^0-9]+"), lambda g: g != "")
    yes = lambda c: F.when(c, 1).otherwise(0)
    changes = F.regexp_count(value, F.lit("[A-Za-z][0-9]|[0-9](?=[A-Za-z])"))
    f = [
        _count(value, "0-9"), F.length(value), _count(value, "."), _count(value, " -"), _count(value, "A-Za-z"), yes(value.contains("@")), yes(value.startswith("+")),
        yes(value.contains("(")), _count(value, ":/_"), F.size(groups), F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)), luhn(value),
        yes(F.forall(groups, _small)), yes(before.rlike("[A-Za-z0-9]$")), yes(after.rlike("^[A-Za-z0-9]")), yes(before.rlike(CUES)),
        yes(value.rlike(r"(?i)[(\[](at|dot)[)\]]")), _count(value, "g-zG-Z"), _count(value, "A-Z"), changes, yes(before.rlike("[\"']$")),
    ]
    return F.array(*[F.least(x.cast("int"), F.lit(TOP_VALUE)) for x in f])


N_FEATURES = 21
_DISGUISES = {
    "email": [lambda v: F.replace(F.replace(v, F.lit("@"), F.lit(" (at) ")), F.lit("."), F.lit(" (dot) ")), lambda v: F.replace(v, F.lit("@"), F.lit(" [at] "))],
    "phone": [lambda v: F.substring(v, F.lit(2), F.length(v)), lambda v: F.concat(F.lit("00"), F.substring(v, F.lit(2), F.length(v)))],
    "card": [lambda v: F.regexp_replace(_digits(v), "(?<=[0-9])(?=(?:[0-9]{4})+$)", "."), lambda v: F.regexp_replace(_digits(v), "(?<=[0-9])(?=(?:[0-9]{4})+$)", "/")],
}


def _around(text: Column, s: Column) -> tuple[Column, Column]:
    before = F.substring(text, F.greatest(s["start"] - 15, F.lit(1)), F.least(s["start"], F.lit(16)))
    return before, F.substring(text, s["end"] + 1, F.lit(1))


def with_candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with base spans and ``cand``: start, end, features f of each candidate that is no base span."""
    text = F.coalesce("text", F.lit(""))
    spot = lambda column: F.transform(column, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    base = F.concat(*[spot(f"b_{k}") for k in KINDS])
    found = with_spans(docs).withColumn("cand", F.array_except(F.concat("c_mail", "c_number", "c_secret"), base)).drop("c_mail", "c_number", "c_secret")
    describe = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _features(s["value"], *_around(text, s)).alias("f"))
    return found.withColumn("cand", F.transform("cand", describe))


def examples(docs: DataFrame) -> DataFrame:
    """f, y (one truth a kind of ``ADDED``) and test of what there is to learn from in ``docs`` (text)."""
    text = F.coalesce("text", F.lit(""))
    found = with_spans(docs.select("text"))
    truth = lambda kind: F.array(*[F.lit(k == kind) for k in ADDED])

    def shown(value: Column, s: Column, y: Column) -> Column:
        return F.struct(_features(value, *_around(text, s)).alias("f"), y.alias("y"), F.xxhash64("text", s["start"], value).alias("h"))

    def as_seen(kind: str, look) -> Column:
        return F.transform(f"b_{kind}", lambda s: shown(look(s["value"]), s, truth(kind)))

    parts = [as_seen(k, look) for k in KINDS for look in [lambda v: v, *_DISGUISES.get(k, [])]]
    spot = lambda s: F.struct(s["start"], s["end"])
    base = F.concat(*[F.transform(f"b_{k}", spot) for k in KINDS])
    # Numbers that no rule knows are of no kind; runs of letters and digits are secrets where something says so, and count for nothing elsewhere.
    others = F.filter("c_number", lambda s: ~F.array_contains("__base", spot(s)))
    secrets = F.filter("c_secret", lambda s: _around(text, s)[0].rlike(ASSIGNED))
    parts += [F.transform(others, lambda s: shown(s["value"], s, truth(None))), F.transform(secrets, lambda s: shown(s["value"], s, truth("secret")))]
    rows = found.withColumn("__base", base).select(F.explode(F.concat(*parts)).alias("e")).select("e.*")
    return rows.select("f", "y", (F.pmod(F.xxhash64("h", F.lit(7)), F.lit(2)) == 0).alias("test"))


class Trees:
    """Boosted trees of one kind: (feature, value) splits at the root and in both halves, and four leaves."""

    def __init__(self):
        self.base, self.trees, self.threshold = 0.0, [], None

    def margin(self, f: Column) -> Column:
        out = F.lit(self.base)
        for (a, x), (b, y), (c, z), leaf in self.trees:
            low = F.when(f[b] <= y, leaf[0]).otherwise(leaf[1])
            out = out + F.when(f[a] <= x, low).otherwise(F.when(f[c] <= z, leaf[2]).otherwise(leaf[3]))
        return out

    def score(self, f: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin(f)))


def _best(g: np.ndarray, h: np.ndarray) -> tuple[tuple[int, int], float, float]:
    """Best split of a (feature, value) histogram, and the leaf values left and right."""
    gl, hl = g.cumsum(1), h.cumsum(1)
    gr, hr = gl[:, -1:] - gl, hl[:, -1:] - hl
    gain = gl**2 / (hl + SHRINK) + gr**2 / (hr + SHRINK)
    f, v = np.unravel_index(gain.argmax(), gain.shape)
    return (int(f), int(v)), float(RATE * gl[f, v] / (hl[f, v] + SHRINK)), float(RATE * gr[f, v] / (hr[f, v] + SHRINK))


def sample_of(docs: DataFrame, at_most: int = SAMPLE_DOCS) -> DataFrame:
    """About ``at_most`` documents, drawn by a hash of their id (if there is one) and text."""
    share = min(1.0, at_most / max(1, docs.count()))
    if share == 1.0:
        return docs.select("text")
    key = [c for c in ("doc_id", "text") if c in docs.columns]
    return docs.where(F.pmod(F.xxhash64(*key, F.lit(3)), F.lit(1_000_003)) / 1_000_003 < share).select("text").limit(2 * at_most)


def fit(docs: DataFrame) -> dict[str, Trees]:
    """Trees and threshold of each kind from all of ``docs`` (text); a kind with too few examples gets none."""
    rows = written(examples(docs).groupBy("f", "y", "test").agg(F.count("*").alias("n")))
    models: dict[str, Trees] = {}
    have = rows.where("not test").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("y")[k], F.col("n"))).alias(kind) for k, kind in enumerate(ADDED)]).first()
    for kind in ADDED:
        if have.n and min(have[kind] or 0, have.n - (have[kind] or 0)) >= LEAST:
            models[kind] = Trees()
            models[kind].base = float(np.log(have[kind] / (have.n - have[kind])))
    learn = rows.where("not test")

    def histograms(sides: dict[str, Column]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        f = F.col("f")
        cols = {}
        for name, (kind, side) in sides.items():
            p = models[kind].score(f)
            cols[f"g_{name}"] = F.when(side, F.col("n") * (F.col("y")[ADDED.index(kind)].cast("double") - p)).otherwise(0.0)
            cols[f"h_{name}"] = F.when(side, F.col("n") * p * (1 - p)).otherwise(0.0)
        e = learn.select(F.posexplode("f").alias("feature", "value"), *[c.alias(n) for n, c in cols.items()])
        got = e.groupBy("feature", "value").agg(*[F.sum(n).alias(n) for n in cols]).toPandas()
        out = {}
        for name in sides:
            g, h = np.zeros((N_FEATURES, TOP_VALUE + 1)), np.zeros((N_FEATURES, TOP_VALUE + 1))
            g[got["feature"], got["value"]], h[got["feature"], got["value"]] = got[f"g_{name}"], got[f"h_{name}"]
            out[name] = (g, h)
        return out

    for _ in range(ROUNDS if models else 0):
        roots = {k: _best(*x)[0] for k, x in histograms({k: (k, F.lit(True)) for k in models}).items()}
        halves = histograms({f"{k}_{s}": (k, (F.col("f")[a] <= x) if s == "low" else (F.col("f")[a] > x)) for k, (a, x) in roots.items() for s in ("low", "high")})
        for k, root in roots.items():
            (low, l0, l1), (high, l2, l3) = _best(*halves[f"{k}_low"]), _best(*halves[f"{k}_high"])
            models[k].trees.append((root, low, high, (l0, l1, l2, l3)))
    for kind, m in models.items():
        hit = F.when(F.col("y")[ADDED.index(kind)], F.col("n")).otherwise(0)
        by = rows.where("test").groupBy(F.floor(m.score(F.col("f")) * 100).alias("s")).agg(F.sum("n").alias("n"), F.sum(hit).alias("hit")).toPandas().sort_values("s", ascending=False)
        good = by[(by["hit"].cumsum() / by["n"].cumsum()) >= PRECISION]
        if len(good):
            m.threshold = float(good["s"].min()) / 100
    return models


def _named(column: str, kind: str) -> Column:
    return F.transform(column, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _chosen(kind: str, m: Trees) -> Column:
    s = F.transform("cand", lambda c: F.struct(F.lit(kind).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), m.score(c["f"]).alias("score")))
    return F.filter(s, lambda c: c["score"] >= m.threshold)


ALL = "array<struct<kind:string,start:int,end:int>>"


def find(docs: DataFrame, keep: list[str] | None = None, models: dict[str, Trees] | None = None) -> DataFrame:
    """``docs`` (with a column text) with ``base`` and ``spans``: arrays of kind, start, end, by kind as listed, then start.

    ``keep`` names the columns to keep, all by default; columns named base or spans are replaced. The documents are read
    for the examples and once more for the result; nothing of them is written.
    """
    own = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in ("base", "spans")]
    if models is None:
        models = fit(docs)
    # Columns of the table travel as one, so that their names meet none of those used here.
    apart = docs.select(F.col("text"), F.struct(*own).alias("__own"))
    cand = with_candidates(apart).select("__own", *[f"b_{k}" for k in KINDS], "cand")
    base = F.concat(*[_named(f"b_{k}", k) for k in KINDS])
    touches = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    scored = []
    for kind, m in models.items():
        if m.threshold is not None:
            scored.append(_chosen(kind, m))
    out = cand.withColumn("base", base)
    if scored:
        out = out.withColumn("added", F.filter(F.concat(*scored), lambda c: ~F.exists("base", lambda b: touches(b, c))))
        better = lambda o, c: (o["score"] > c["score"]) | ((o["score"] == c["score"]) & (F.struct(o["start"], o["end"], o["kind"]) < F.struct(c["start"], c["end"], c["kind"])))
        out = out.withColumn("added", F.filter("added", lambda c: ~F.exists("added", lambda o: touches(o, c) & better(o, c))))
        added = F.transform("added", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
        place = F.create_map(*[x for i, k in enumerate(ADDED) for x in (F.lit(k), F.lit(i))])
        order = F.transform(F.concat("base", added), lambda s: F.struct(place[s["kind"]].alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
        spans = F.transform(F.array_sort(order), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    else:
        spans = F.col("base")
    return out.select("__own.*", F.col("base").cast(ALL).alias("base"), spans.cast(ALL).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in angle brackets; overlapping spans of several kinds become one."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    step = lambda a, s: F.when(s["start"] >= a["at"], F.struct(
        F.concat(a["text"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("text"), s["end"].alias("at"),
    )).otherwise(F.struct(a["text"].alias("text"), F.greatest(a["at"], s["end"]).alias("at")))
    whole = F.aggregate(order, start, step, lambda a: F.concat(a["text"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
