"""Outcome classes, routing and content errors. Row-wise expressions; nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions import rules, urls
from pagelake.functions.text import strip, visible_len

ERROR = "struct<code:string,message:string,recoverable:boolean>"


def error(code, message, recoverable) -> Column:
    col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(col(code).alias("code"), col(message).alias("message"), col(recoverable).alias("recoverable")).cast(ERROR)


def _listed(table: dict, rule: str, *args: Column, code: Column | None = None) -> Column:
    """Error of a table of fixed values, its message filled with ``args``."""
    message, recoverable = table[rule]
    return error(rule if code is None else code, F.format_string(message, *args) if args else message, recoverable)


def fetch_error() -> Column:
    """Error of a logged fetch, from ``transport`` (null when a response came) and ``status_code``."""
    status, transport = F.col("status_code"), F.col("transport")
    http = F.concat(F.lit("http_"), status.cast("string"))
    e = lambda *a, **k: _listed(rules.FETCH_ERRORS, *a, **k)
    return (
        F.when(transport == "timeout", e("timeout", F.col("timeout_ms")))
        .when(transport == "redirect_loop", e("redirect_loop"))
        .when(transport.isNotNull(), e("network_error", transport))
        .when(status == 429, e("http_429"))
        .when(status >= 500, e("http_5xx", status, code=http))
        .when(status >= 400, e("http_4xx", status, code=http))
    )


def classify_fetch(fetches: DataFrame) -> DataFrame:
    """Add ``fetch_error``; failed fetches keep no html."""
    f = fetches.withColumn("fetch_error", fetch_error())
    return f.withColumn("html", F.when(F.col("fetch_error").isNull(), F.col("html")))


def render_error() -> Column:
    """Error of a logged render, from ``failure`` (exception text or kind; null on success) and the html."""
    fail = F.col("failure")
    short = F.length(strip(F.coalesce("html", F.lit("")))) < rules.EMPTY_DOCUMENT_CHARS
    e = lambda *a: _listed(rules.RENDER_ERRORS, *a)
    return (
        F.when(fail == "unavailable", e("js_rendering_unavailable"))
        .when(fail == "wait_timeout", e("js_wait_timeout", F.coalesce("wait_selector", F.lit(""))))
        .when(fail.contains("Timeout"), e("js_navigation_timeout", F.col("timeout_ms")))
        .when(fail.isNotNull(), e("js_rendering_failed", fail))
        .when(short, e("js_empty_document"))
    )


def missing_render() -> Column:
    """Error of a page that needed rendering and has no rendered snapshot."""
    return _listed(rules.RENDER_ERRORS, "js_rendering_failed", F.lit("no snapshot"))


def classify_render(renders: DataFrame) -> DataFrame:
    r = renders.withColumn("render_error", render_error())
    return r.withColumn("html", F.when(F.col("render_error").isNull(), F.col("html")))


def client_rendered(html: Column) -> Column:
    """An empty application shell, or framework signals with little visible text."""
    n = visible_len(html)
    shell = html.rlike(rules.APP_SHELL) & (n < rules.SHELL_MIN_TEXT)
    return shell | (html.rlike(rules.FRAMEWORK_SIGNALS) & (n < 2 * rules.SHELL_MIN_TEXT))


def page_signals(html: Column) -> Column:
    """What later decisions need to know of the source, as one small struct, so the source itself need not travel."""
    h = F.coalesce(html, F.lit(""))
    return F.struct(
        (h != "").alias("has_html"),
        F.length(strip(h)).alias("html_len"),
        client_rendered(h).alias("client_rendered"),
        h.rlike(rules.PAYWALL).alias("paywall"),
        h.rlike(rules.BOT_WALL).alias("bot"),
    )


def needs_render(mode: Column, signals: Column, markdown: Column) -> Column:
    short = F.length(strip(markdown)) < rules.SHORT_MARKDOWN
    return (
        F.when(mode == "always", True)
        .when(mode == "never", False)
        .when(~signals["has_html"], True)
        .otherwise(signals["client_rendered"] | short)
    )


def content_error(signals: Column, markdown: Column, status: Column) -> Column:
    """Empty page, paywall or bot wall; the first that applies, null when none does."""
    md = strip(markdown)
    rich = F.length(md) >= rules.SUBSTANTIAL_MARKDOWN
    empty = (F.length(md) < 20) & (signals["html_len"] < 100)
    paywall = md.rlike(rules.PAYWALL) | (~rich & signals["paywall"])
    bot = md.rlike(rules.BOT_WALL) | signals["bot"] | status.isin(403, 503)
    e = lambda code: error(code, *rules.CONTENT_ERRORS[code])
    return F.when(empty, e("empty_page")).when(paywall, e("paywall")).when(bot, e("bot_detection"))


def timing_report(responses: DataFrame, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Count, mean and percentiles per stage and path.

    Times are put on a 0.01 ms grid and counted per grid value first (map-side combined), so
    what reaches a group is bounded by the grid of a request's time limit, not by its rows.
    """
    long = responses.select(
        F.col("extraction_path").alias("path"), F.explode("timings_ms").alias("stage", "ms")
    ).withColumn("tick", F.round(F.col("ms") * 100).cast("long"))
    return ticks_report(long, ["path", "stage"], shares)


def ticks_report(long: DataFrame, keys: list[str], shares: tuple[float, ...]) -> DataFrame:
    from pyspark.sql import Window as W

    counted = long.groupBy(*keys, "tick").agg(F.count("*").alias("n"))
    w = W.partitionBy(*keys).orderBy("tick")
    run = counted.withColumns(
        {
            "upto": F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)),
            "total": F.sum("n").over(W.partitionBy(*keys)),
        }
    )
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * p), F.col("tick"))) / 100
    return run.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.round(F.sum(F.col("tick") * F.col("n")) / F.sum("n") / 100, 4).alias("mean_ms"),
        *[at(p).alias(f"p{round(p * 100)}_ms") for p in shares],
    )


#: Size of a KLL sketch, and the error of its ranks that may be relied on (the sketch's own bound is below one in a hundred).
SKETCH, RANK_ERROR = 400, 0.02


def timing_sketches(responses: DataFrame) -> DataFrame:
    """host, day, path, stage, n, sketch: quantile sketches of the times (ms) of ``responses`` (url, day, extraction_path, timings_ms), to be stored and merged."""
    long = responses.select(
        urls.netloc(F.col("url")).alias("host"), "day", F.col("extraction_path").alias("path"), F.explode("timings_ms").alias("stage", "ms")
    ).where("ms is not null")
    return long.groupBy("host", "day", "path", "stage").agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col("ms").cast("double"), SKETCH).alias("sketch"))


def merged_timings(sketches: DataFrame, keys: list[str], shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """n and percentiles per ``keys`` of any sketches put together; their ranks are off by ``RANK_ERROR`` at most."""
    g = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", SKETCH).alias("sketch"))
    return g.select(*keys, "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(f"p{round(p * 100)}_ms") for p in shares])


def domain_hints(responses: DataFrame, share: float = 0.5, least: int = 1) -> DataFrame:
    """Hosts that should be rendered without trying the static path first, and hosts that block."""
    host = urls.netloc(F.col("url"))
    rendered = (F.col("extraction_path") == "render").cast("int")
    blocked = F.coalesce(F.col("error_code").isin("bot_detection", "http_429", "http_403", "http_503"), F.lit(False))
    return (
        responses.groupBy(host.alias("host"))
        .agg(F.count("*").alias("pages"), F.sum(rendered).alias("rendered"), F.sum(blocked.cast("int")).alias("blocked"))
        .withColumn("requires_js", (F.col("pages") >= least) & (F.col("rendered") >= share * F.col("pages")))
        .withColumn(
            "strategy",
            F.when(F.col("blocked") * 2 > F.col("pages"), "render_with_proxy").when(F.col("requires_js"), "render").otherwise("static"),
        )
    )


def with_hints(fetches: DataFrame, hints: DataFrame) -> DataFrame:
    """Give new fetches the strategy learned for their host; unknown hosts start static.

    ``hints`` has one row per host, so nothing multiplies; Spark broadcasts it while it is small
    and splits the partition of a host with very many fetches otherwise (adaptive skew join).
    """
    f = fetches.withColumn("host", urls.netloc(F.col("url")))
    return f.join(hints.select("host", F.col("strategy").alias("hint")), "host", "left").withColumn(
        "hint", F.coalesce("hint", F.lit("static"))
    ).drop("host")
