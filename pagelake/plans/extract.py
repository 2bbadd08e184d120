"""Whole extraction plans: Markdown and actions of a page in one pass, and response assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.functions import urls
from pagelake.functions.text import token_estimate
from pagelake.operators import actions as A
from pagelake.operators import contracts as K
from pagelake.operators import html as H
from pagelake.operators import markdown as M
from pagelake.operators import routing as R

ACTIONS = (
    "array<struct<type:string,label:string,target:string,method:string,"
    f"parameters:{A.PARAMETERS},description:string>>"
)


def extract(
    pages: DataFrame, payload: list[str], partitions: int | None = None, with_actions: bool = True,
    with_template: bool = False,
) -> DataFrame:
    """Markdown and ranked actions per page, from one exchange of the pages.

    ``pages`` has page_id, base (URL links resolve against) and html; optional columns
    ``selector_hint`` and ``max_tokens`` apply per page. ``payload`` columns come back with the
    result; ``with_template`` adds domain and template. Markdown is assembled in the same aggregate that collects the elements, and rides
    on the page's own row while actions are worked out, so nothing is computed twice or joined.
    """
    hint = "selector_hint" if "selector_hint" in pages.columns else None
    if "max_tokens" not in pages.columns:
        pages = pages.withColumn("max_tokens", F.lit(None).cast("int"))
    pages = pages.withColumn("host_rule", A.needs_host_search(pages.withColumn("url", F.col("base"))))
    page = F.struct("base", "host_rule", "max_tokens", *payload).alias("page")
    hints = [M.parse_hint(F.col(hint)).alias(hint)] if hint else []
    nd = H.nodes(pages.select("page_id", "html", page, *hints), ["page", hint] if hint else ["page"], partitions)
    nd = M.with_main(nd, hint)
    aggs = [F.any_value("page", F.lit(True)).alias("page"), M.joined(F.collect_list(M.content_piece())).alias("markdown")]
    if with_actions:
        aggs += [M.collected_texts(), A.element_fields()]
    if with_template:
        aggs.append(K.shape().alias("shape"))
    pr = M.normalise(nd.groupBy("page_id").agg(*aggs))
    pr = M.truncate(pr, "page.max_tokens")
    kept = ["markdown", "truncated", *[F.col(f"page.{c}").alias(c) for c in payload]]
    if with_template:
        base = F.col("page.base")
        kept += [urls.netloc(base).alias("domain"), K.template(F.col("shape"), base).alias("template")]
    if not with_actions:
        return pr.select("page_id", *kept)
    pr = pr.select(
        "page_id", F.col("page.base").alias("base"), F.col("page.host_rule").alias("host_rule"), "texts", "els",
        F.struct(*kept).alias("payload"),
    )
    out = A.collected(A.candidates(pr))
    return out.select("page_id", "payload.*", F.col("actions").cast(ACTIONS).alias("actions"))


def action_rows(extracted: DataFrame, *keep: str) -> DataFrame:
    """One row per action of ``extract``'s result, ranked from 1."""
    return extracted.select("page_id", *keep, F.posexplode("actions").alias("rank", "a")).select(
        "page_id", *keep, (F.col("rank") + 1).alias("rank"), "a.*"
    )


def with_threads(extracted: DataFrame, pages: DataFrame) -> DataFrame:
    """Replace the Markdown of forum pages by their thread Markdown."""
    t = M.thread_markdown(pages).withColumnRenamed("markdown", "thread_md")
    return extracted.join(t, "page_id", "left").withColumn(
        "markdown", F.coalesce("thread_md", "markdown")
    ).drop("thread_md")


_OPTIONS = {
    "render": "auto", "actions": "fast", "include_actions": True, "timeout_ms": 30000, "status_code": 200,
}


def with_defaults(requests: DataFrame) -> DataFrame:
    """Fill request options that are absent or null with their defaults."""
    for name, value in _OPTIONS.items():
        have = F.col(name) if name in requests.columns else F.lit(None)
        requests = requests.withColumn(name, F.coalesce(have, F.lit(value)))
    for name, kind in (("transport", "string"), ("wait_selector", "string")):
        if name not in requests.columns:
            requests = requests.withColumn(name, F.lit(None).cast(kind))
    return requests


def responses(fetches: DataFrame, renders: DataFrame | None = None) -> DataFrame:
    """Responses for a table of fetched pages and, where pages were rendered, their rendered snapshots.

    The static extraction decides the route; ``renders`` is small (only pages that were
    rendered), is extracted the same way, and is joined on ``page_id``, which both sides are
    already partitioned by. Where the pages make more tasks than there are cores, the rendered ones are
    extracted in a stage of their own and their results exchanged, so that no task holds the sorts of
    both extractions. Without ``renders`` no page is routed (static-only variant).
    """
    f = R.classify_fetch(with_defaults(fetches))
    if renders is None:
        f = f.withColumn("render", F.lit("never"))
    # A page that is always rendered is not fetched first.
    got = F.col("render") != "always"
    fetched = got & F.col("fetch_error").isNull()
    f = f.withColumns({
        **{c: F.when(got, F.col(c)) for c in ("html", "fetch_error", "elapsed_ms")},
        "status_code": F.when(got, F.col("status_code")).otherwise(200),
        "final_url": F.when(fetched, F.col("final_url")).otherwise(F.col("url")),
    })
    f = f.withColumns({"signals": R.page_signals(F.col("html")), "base": F.col("final_url")})
    carry = ["url", "final_url", "render", "actions_mode", "include_actions", "status_code", "elapsed_ms", "fetch_error", "signals"]
    n = H.page_partitions(f)
    s = extract(f.withColumnRenamed("actions", "actions_mode"), carry, n)
    if renders is None:
        return _assemble(s.withColumns({
            "need": F.lit(False), "used": F.lit(False), "render_error": F.lit(None).cast(R.ERROR),
            "r_elapsed": F.lit(None).cast("double"),
        }))
    r = renders
    for name, kind in (("failure", "string"), ("wait_selector", "string"), ("timeout_ms", "int")):
        if name not in r.columns:
            r = r.withColumn(name, F.lit(None).cast(kind))
    r = R.classify_render(r).withColumns({"signals": R.page_signals(F.col("html")), "base": F.col("final_url")})
    options = [c for c in ("selector_hint", "max_tokens") if c in f.columns]
    if options:  # the request's options hold for its rendered page too
        r = r.drop(*options).join(f.select("page_id", *options), "page_id", "left")
    apart = n > f.sparkSession.sparkContext.defaultParallelism
    r = extract(r, ["final_url", "elapsed_ms", "render_error", "signals"], n // 2 if apart else n)
    if apart:
        r = r.repartition(n, "page_id")
    r = r.select("page_id", F.struct(*[c for c in r.columns if c != "page_id"]).alias("r"))
    j = s.join(r, "page_id", "left")
    need = R.needs_render(F.col("render"), F.col("signals"), F.col("markdown"))
    j = j.withColumn("need", need)
    j = j.withColumn("used", F.col("need") & F.col("r").isNotNull() & F.col("r.render_error").isNull())
    j = j.withColumn("render_error", F.when(F.col("need") & ~F.col("used"), F.coalesce(F.col("r.render_error"), R.missing_render())))
    swap = {c: F.when(F.col("used"), F.col(f"r.{c}")).otherwise(F.col(c)) for c in ("markdown", "truncated", "final_url", "signals", "actions")}
    return _assemble(j.withColumns({**swap, "r_elapsed": F.when(F.col("used"), F.col("r.elapsed_ms"))}))


def _assemble(j: DataFrame) -> DataFrame:
    md = F.col("markdown")
    failed = ((F.col("render") == "never") & F.col("fetch_error").isNotNull()) | (
        F.col("render_error").isNotNull() & (md == "")
    )
    content = F.when(
        F.col("signals.has_html"),
        R.content_error(F.col("signals"), md, F.when(F.col("fetch_error").isNull(), F.col("status_code")).otherwise(200)),
    )
    err = F.when(failed, F.coalesce("render_error", "fetch_error")).otherwise(
        F.coalesce(F.col("render_error"), content, F.col("fetch_error"))
    )
    offer = ~failed & F.col("include_actions") & (F.col("actions_mode") != "none") & F.col("signals.has_html")
    path = F.when(F.col("used"), "render").otherwise("static")
    fetched = F.when(F.col("fetch_error").isNull() & F.col("elapsed_ms").isNotNull(), F.col("elapsed_ms"))
    timing = F.map_from_entries(F.filter(
        F.array(
            F.struct(F.lit("fetch").alias("k"), fetched.alias("v")),
            F.struct(F.lit("render").alias("k"), F.col("r_elapsed").alias("v")),
            F.struct(F.lit("total").alias("k"), (F.coalesce(fetched, F.lit(0.0)) + F.coalesce("r_elapsed", F.lit(0.0))).alias("v")),
        ),
        lambda x: x["v"].isNotNull(),
    ))
    return j.select(
        "page_id",
        F.when(failed, F.lit("")).otherwise(md).alias("markdown"),
        F.when(offer, F.col("actions")).otherwise(F.array().cast(ACTIONS)).alias("actions"),
        F.struct(
            "url",
            "final_url",
            path.alias("extraction_path"),
            path.alias("strategy"),
            (F.col("truncated") & ~failed).alias("truncated"),
            F.lit(False).alias("cached"),
            F.lit(None).cast("timestamp").alias("cached_at"),
            F.when(failed, F.create_map().cast("map<string,int>")).otherwise(
                F.create_map(F.lit("markdown"), token_estimate(md))
            ).alias("tokens"),
            timing.alias("timings_ms"),
        ).alias("meta"),
        err.alias("error"),
    )
