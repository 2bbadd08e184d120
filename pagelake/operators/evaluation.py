"""Corpus evaluation: expectations joined with responses, failures in check order, summary and gates."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.functions import rules
from pagelake.functions.text import word_count
from pagelake.operators.routing import ticks_report
from pagelake.session import written


def quoted(c: Column) -> Column:
    """A text as a quoted literal: single quotes, double ones when it holds a single quote only."""
    esc = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    double = c.contains("'") & ~c.contains('"')
    return F.when(c.isNull(), "None").when(double, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(esc, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def action_text(a: Column) -> Column:
    part = lambda k: F.coalesce(a[k], F.lit("None"))
    return F.concat_ws(" ", part("label"), part("description"), part("target"), part("method"))


def has_action(actions: Column, name: Column) -> Column:
    """Whether an action matches a name: by its pattern where it has one, else by its words (false without actions)."""
    known = F.create_map(*[F.lit(x) for pair in rules.ACTION_NAME_PATTERNS for x in pair])
    words = F.lower(F.replace(name, F.lit("_"), F.lit(" ")))
    hit = F.exists(
        actions,
        lambda a: F.when(
            F.element_at(known, name).isNotNull(), F.regexp_like(action_text(a), F.element_at(known, name))
        ).otherwise(F.lower(action_text(a)).contains(words)),
    )
    return F.coalesce(hit, F.lit(False))


def _checks() -> Column:
    """Failure messages of a row of fixture expectations ``x`` and response columns, in check order."""
    none = F.array().cast("array<string>")
    md = F.coalesce("markdown", F.lit(""))
    acts = F.col("response_actions")
    words, count = word_count(md), F.coalesce(F.size(acts), F.lit(0))
    xm, xa, xs = F.col("x.markdown"), F.col("x.actions"), F.col("x.meta.strategy")
    path = F.coalesce("meta.extraction_path", "meta.strategy")
    one = lambda cond, msg: F.array(F.when(F.coalesce(cond, F.lit(False)), msg))
    each = lambda arr, bad, msg: F.transform(F.coalesce(arr, none), lambda n: F.when(bad(n), msg(n)))
    local = F.exists(acts, lambda a: F.lower(F.coalesce(a["description"], F.lit(""))).contains("local"))
    say = lambda check, *args: F.format_string(rules.CHECK_MESSAGES[check], *args) if args else F.lit(rules.CHECK_MESSAGES[check])
    parts = [
        one(F.col("x.expect_no_error") & F.col("error").isNotNull(),
            say("error", quoted(F.col("error.code")), F.coalesce("error.message", F.lit("")))),
        one(words < xm["min_tokens"], say("min_tokens", words, xm["min_tokens"])),
        each(xm["must_contain"], lambda n: ~md.contains(n), lambda n: say("must_contain", quoted(n))),
        each(xm["must_not_contain"], lambda n: md.contains(n), lambda n: say("must_not_contain", quoted(n))),
        one(xm["has_code_fence"] & ~md.contains("```"), say("code_fence")),
        one(xs.isin("static", "render") & ~path.eqNullSafe(xs), say("path", quoted(path), xs)),
        one(count < xa["min_count"], say("min_count", count, xa["min_count"])),
        one(count > xa["max_count"], say("max_count", count, xa["max_count"])),
        each(xa["must_include_names"], lambda n: ~has_action(acts, n), lambda n: say("must_include", n)),
        each(xa["must_not_include_names"], lambda n: has_action(acts, n), lambda n: say("must_not_include", n)),
        one((xa["must_include_effect"] == "local") & ~F.coalesce(local, F.lit(False)), say("local_effect")),
    ]
    return F.filter(F.concat(*parts), lambda m: m.isNotNull())


def fixture_category() -> Column:
    i = F.col("id")
    return (
        F.when(i.startswith("e2e_"), "e2e")
        .when(i.contains("form") | F.coalesce(F.col("actions") == "verified", F.lit(False)), "forms")
        .when(F.coalesce(F.col("render") == "always", F.lit(False)), "spa/render")
        .when(i.rlike("listing|pagination|books|quotes|amazon"), "listing")
        .otherwise("read")
    )


def evaluate(fixtures: DataFrame, responses: DataFrame) -> DataFrame:
    """Result row per fixture: category, status, failures in order.

    Both tables are keyed by the fixture id, so this is one equi-join; every check, with all its
    needles and names, is an expression on the joined row (a response offers few actions), and
    nothing is multiplied out.
    """
    r = responses.withColumnRenamed("actions", "response_actions")
    for name, kind in (("http_status", "int"), ("http_error", "string"), ("title", "string")):
        if name not in r.columns:
            r = r.withColumn(name, F.lit(None).cast(kind))
    f = fixtures.select(
        "id", F.coalesce("name", "id").alias("name"), "url", F.coalesce("e2e", F.lit(False)).alias("e2e"),
        fixture_category().alias("category"), F.col("expectations").alias("x"),
    )
    j = f.join(r.drop("url", "name", "category"), "id", "left")
    none = F.array().cast("array<string>")
    answered = F.col("markdown").isNotNull() & F.col("http_error").isNull() & F.coalesce(F.col("http_status") == 200, F.lit(True))
    j = j.withColumn("_ok", answered & ~F.col("e2e"))
    j = j.withColumn(
        "failures",
        F.when(F.col("e2e"), none)
        .when(F.col("http_error").isNotNull(), F.array(_say("HTTP error: ", F.col("http_error"))))
        .when(~F.col("_ok"), F.array(_say("HTTP ", F.coalesce("http_status", F.lit(0)), ": ", F.coalesce("title", F.lit("")))))
        .otherwise(_checks()),
    )
    status = (
        F.when(F.col("e2e"), "skipped").when(~F.col("_ok"), "error").when(F.size("failures") == 0, "pass").otherwise("fail")
    )
    shown = lambda c: F.when(F.col("_ok"), c)
    return j.select(
        "id", "name", "url", "category", status.alias("status"),
        F.when(F.col("e2e"), rules.SKIPPED_REASON).alias("skipped_reason"),
        shown(F.col("meta.extraction_path")).alias("extraction_path"),
        shown(F.coalesce(F.size("response_actions"), F.lit(0))).alias("action_count"),
        shown(F.length("markdown")).alias("markdown_length"),
        "failures",
        shown(F.col("error.code")).alias("error"),
    )


def failing_snapshots(results: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses of failing fixtures, as evidence."""
    return responses.join(results.where("status = 'fail'").select("id"), "id", "left_semi")


def run_summary(results: DataFrame) -> DataFrame:
    """Totals of a run, overall and per category."""
    n = lambda *s: F.sum(F.col("status").isin(*s).cast("int"))
    return results.rollup("category").agg(
        F.count("*").alias("total"), n("pass").alias("passed"), n("fail", "error").alias("failed"), n("skipped").alias("skipped")
    ).withColumn("category", F.coalesce("category", F.lit("all")))


def action_precision(predicted: DataFrame, labelled: DataFrame, target: float = 0.8) -> DataFrame:
    """Share of predicted action names that are labelled, per fixture (both: id, name)."""
    p, lab = predicted.select("id", "name").distinct(), labelled.select("id", "name").distinct()
    marked = p.join(lab.withColumn("hit", F.lit(1)), ["id", "name"], "left")
    return marked.groupBy("id").agg(
        F.count("*").alias("predicted"), F.coalesce(F.sum("hit"), F.lit(0)).alias("matched")
    ).withColumns(
        {
            "precision": F.round(F.col("matched") / F.col("predicted"), 6),
            "reached": F.col("matched") >= F.lit(target) * F.col("predicted"),
        }
    )


def exit_criteria(results: DataFrame, timings: DataFrame, p50_limit_ms: float = 600.0) -> DataFrame:
    """Milestone gates per category: median time, action cap, share of passes.

    ``results`` has category, status, action_count; ``timings`` has category, ms.
    """
    t = timings.withColumn("tick", F.round(F.col("ms") * 100).cast("long"))
    p50 = ticks_report(t, ["category"], (0.5,)).select("category", "p50_ms")
    g = results.groupBy("category").agg(
        F.count("*").alias("fixtures"),
        F.coalesce(F.max("action_count"), F.lit(0)).alias("max_actions"),
        F.sum((F.col("status") == "pass").cast("int")).alias("passed"),
    )
    return g.join(p50, "category", "left").withColumns(
        {
            "p50_ok": F.coalesce(F.col("p50_ms") < p50_limit_ms, F.lit(True)),
            "cap_ok": F.col("max_actions") <= rules.MAX_ACTIONS,
            "all_passed": F.col("passed") == F.col("fixtures"),
        }
    )


def unsafe_probes(actions: DataFrame) -> DataFrame:
    """Per page the actions that were probed and verified although they need confirmation; a gate wants none.

    ``actions`` has page_id, probed, verification, requires_confirm.
    """
    bad = F.col("probed") & (F.col("verification") == "verified") & F.col("requires_confirm")
    return actions.groupBy("page_id").agg(F.sum(F.coalesce(bad, F.lit(False)).cast("int")).alias("unsafe")).withColumn(
        "gate_ok", F.col("unsafe") == 0
    )


def stability(before: DataFrame, after: DataFrame) -> DataFrame:
    """Action keys of two extractions of the same pages (both: page_id, action_key): kept, lost, new."""
    b = before.select("page_id", "action_key").distinct().withColumn("b", F.lit(True))
    a = after.select("page_id", "action_key").distinct().withColumn("a", F.lit(True))
    n = lambda c: F.sum(c.cast("int"))
    in_b, in_a = F.col("b").isNotNull(), F.col("a").isNotNull()
    return b.join(a, ["page_id", "action_key"], "full").groupBy("page_id").agg(
        n(in_b & in_a).alias("kept"), n(in_b & ~in_a).alias("lost"), n(~in_b & in_a).alias("new")
    ).withColumn("stable", (F.col("lost") == 0) & (F.col("new") == 0))


def _in_order(places: Column) -> Column:
    """For a list of places whether each belongs to its longest ascending part (of several, the one with the smallest ends)."""

    def one(x) -> list[bool]:
        tails, at, before = [], [], []
        for k, v in enumerate(x):
            i = bisect.bisect_left(tails, v)
            before.append(at[i - 1] if i else -1)
            tails[i:i + 1], at[i:i + 1] = [v], [k]
        keep, k = [False] * len(x), at[-1] if at else -1
        while k >= 0:
            keep[k], k = True, before[k]
        return keep

    @F.pandas_udf("array<boolean>")
    def all_of(lists: pd.Series) -> pd.Series:
        return lists.map(one)

    return all_of(places)


def aligned(before: DataFrame, after: DataFrame) -> DataFrame:
    """page_id, pos, pos_after: which control of a later extraction is which of an earlier one (both: ``contracts.locators``).

    Controls of equal tag, role, name and test id are paired in their order; of the pairs those in ascending order hold. Between
    them, what is left is paired by tag and role alone. All keys start with the page, whose controls are few.
    """
    strong, weak = ["tag", "role", "name", "testid"], ["tag", "role", "gap"]

    def paired(b: DataFrame, a: DataFrame, keys: list[str]) -> DataFrame:
        nth = lambda d: d.withColumn("nth", F.row_number().over(W.partitionBy("page_id", *keys).orderBy("pos")))
        x, y = nth(b).alias("b"), nth(a).alias("a")
        same = [F.col(f"b.{k}").eqNullSafe(F.col(f"a.{k}")) for k in ["page_id", "nth", *keys]]
        pairs = x.join(y, same).select("b.page_id", "b.pos", F.col("a.pos").alias("pos_after"))
        lists = pairs.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pos", "pos_after"))).alias("p"))
        held = lists.select("page_id", F.explode(F.arrays_zip("p", _in_order(F.col("p.pos_after")).alias("ok"))).alias("z"))
        return held.where("z.ok").select("page_id", "z.p.pos", "z.p.pos_after")

    anchors = written(paired(before, after, strong))

    def left_over(d: DataFrame, place: str) -> DataFrame:
        """Controls without a partner, with the number of anchors before them."""
        marks = anchors.select("page_id", F.col(place).alias("pos"), F.lit(1).alias("anchor"))
        j = d.select("page_id", "pos", "tag", "role").join(marks, ["page_id", "pos"], "left")
        gap = F.count("anchor").over(W.partitionBy("page_id").orderBy("pos"))
        return j.withColumn("gap", gap).where("anchor is null")

    return anchors.unionByName(paired(left_over(before, "pos"), left_over(after, "pos_after"), weak))


def locator_stability(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per page of ``before``: controls, and how many of their locators name the same control in ``after``, another one, or none or several (kept, moved, lost)."""
    numbered = lambda d: d.withColumn("nth", F.row_number().over(W.partitionBy("page_id", "tag").orderBy("pos")))
    ways = {
        "role": F.concat_ws("\u0001", F.lit("role"), "role", "name"), "testid": F.concat_ws("\u0001", F.lit("testid"), "testid"),
        "label": F.concat_ws("\u0001", F.lit("label"), "name"), "structural": F.concat_ws("\u0001", F.lit("structural"), "tag", F.col("nth").cast("string")),
    }
    pick = F.lit(None).cast("string")
    for kind, key in ways.items():
        pick = F.when(F.col("locator") == kind, key).otherwise(pick)
    asked = numbered(before).select("page_id", "pos", pick.alias("key"))
    named = numbered(after).select("page_id", "pos", F.explode(F.array(*ways.values())).alias("key"))
    found = named.groupBy("page_id", "key").agg(F.count("*").alias("n"), F.min("pos").alias("named"))
    same = aligned(before, after)
    j = asked.join(found, ["page_id", "key"], "left").join(same, ["page_id", "pos"], "left")
    lost = F.coalesce(F.col("n") != 1, F.lit(True))
    kept = ~lost & F.coalesce(F.col("named") == F.col("pos_after"), F.lit(False))
    count = lambda c: F.sum(c.cast("int"))
    g = j.groupBy("page_id").agg(F.count("*").alias("controls"), count(kept).alias("kept"), count(~lost & ~kept).alias("moved"), count(lost).alias("lost"))
    return g.withColumn("share", F.round(F.col("kept") / F.col("controls"), 6))
