"""Inputs that Spark derives from the given tables: richer pages, fetch logs, requests, fixtures, threads.

Every derived table keeps all rows of the table it comes from; what a row gets depends on its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.sources.tables import EXPECTATIONS, table

# Put before the article of a page, by page_id % 8.
FRAGMENTS = {
    0: '<form action="/search" method="get"><label for="q1">Find</label><input id="q1" name="q" required><button type="submit">Go</button></form>',
    1: '<form action="apply.php" method="post"><input type="hidden" name="csrf" value="t"><input type="email" name="mail" placeholder="E-mail"><select name="size"><option value="">-</option><option value="s">S</option></select><input type="submit" name="send"></form>',
    2: '<a href="?page=2">next</a><a href="../up">Up one</a><a href="https://other.example/x">Out</a><a href="mailto:a@b.c">Mail</a><a href="?page=2">next</a>',
    3: """<a href="#part-2">Part two</a><button onclick="showTab(2)">Tab</button><button onclick="location.href='/go'">Go there</button>""",
    4: '<div class="cookie-bar"><button>Accept all</button><a href="/privacy">Cookie policy</a></div><p>1 < 2 &nbsp;</p>',
    5: '<main><h2>Data</h2><table><tr><th>k</th><th>v</th></tr><tr><td>a</td><td>1</td></tr></table><pre><code>x = 1</code></pre></main>',
    6: '<p>Only $9</p><form><button type="submit">Add</button></form><input type="submit" title="Send it"><form action="/cart" method="post"><input type="number" name="n" min="1" max="9"><input type="checkbox" name="gift"><input type="date" name="day"><button type="submit">Buy now</button></form>',
}
SHELL = '<html><head><title>App</title></head><body><div id="root"></div></body></html>'

# Put after the first heading inside the article, by page_id % 5.
RICH = {
    0: '<ul><li>one</li><li>two<ul><li>two a</li></ul></li></ul>',
    1: '<table><tr><th>k</th><th>v</th></tr><tr><td>a</td><td>1</td></tr></table>',
    2: '<pre><code>x = 1\n  y = 2</code></pre><p>Use <code>x</code> or <em>y</em>.</p>',
    3: '<p>See <a href="/doc?utm_source=a&amp;id=3">the doc</a>, <a href="/doc?id=3">again</a> and <a href="/more">more</a>.</p>',
    4: '<h2>Part &amp; parcel</h2><ol><li>first</li><li>second</li></ol><blockquote>quoted</blockquote><hr>',
}


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages")


def pages_aug(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with forms, buttons, banners, tables; every eighth an empty application shell."""
    p = pages(spark, sf)
    mod = F.pmod("page_id", F.lit(8))
    html = F.lit(SHELL)
    for m, frag in FRAGMENTS.items():
        html = F.when(mod == m, F.replace("html", F.lit("<article>"), F.lit(frag + "<article>"))).otherwise(html)
    return p.withColumn("html", html)


def pages_rich(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with lists, tables, code, links and quotes inside the article."""
    p = pages(spark, sf)
    mod = F.pmod("page_id", F.lit(5))
    html = F.col("html")
    for m, frag in RICH.items():
        html = F.when(mod == m, F.replace("html", F.lit("</h1>"), F.lit("</h1>" + frag))).otherwise(html)
    return p.withColumn("html", html)


def fetches(spark: SparkSession, sf: str) -> DataFrame:
    """A fetch log over ``pages_aug``: some hosts refuse, limit or fail, a few connections break."""
    p = pages_aug(spark, sf)
    m = F.pmod("page_id", F.lit(20))
    status = F.when(m == 7, 429).when(m == 11, 503).when(m == 13, 404).when(m == 17, 403).otherwise(200)
    k = F.pmod("page_id", F.lit(41))
    transport = F.when(k == 3, "timeout").when(k == 5, "redirect_loop").when(k == 8, "connection reset")
    return p.select(
        "page_id", "url", F.col("url").alias("final_url"),
        F.when((status < 400) & transport.isNull(), F.col("html")).alias("html"),
        status.alias("status_code"),
        (F.length("html") / 100.0).alias("elapsed_ms"),
        transport.alias("transport"),
        F.lit(30000).alias("timeout_ms"),
        F.when(F.pmod("page_id", F.lit(3)) == 1, "never").otherwise("auto").alias("render"),
        F.when(F.pmod("page_id", F.lit(7)) == 2, "none").otherwise("fast").alias("actions"),
    )


def renders(spark: SparkSession, sf: str) -> DataFrame:
    """A render log for the shells: the original page in five cases of eight, else a failure."""
    shells = pages_aug(spark, sf).where(F.col("html").contains('<div id="root"></div>')).select("page_id")
    p = pages(spark, sf).join(shells, "page_id", "left_semi")
    k = F.pmod(F.floor(F.col("page_id") / 8), F.lit(8))
    failure = F.when(k == 1, "Timeout 30000ms exceeded").when(k == 3, "browser crashed")
    return p.select(
        "page_id", "url", F.col("url").alias("final_url"),
        F.when(failure.isNull(), F.when(k == 5, "<html></html>").otherwise(F.col("html"))).alias("html"),
        (F.length("html") / 10.0).alias("elapsed_ms"),
        failure.alias("failure"), F.lit(30000).alias("timeout_ms"), F.lit(None).cast("string").alias("wait_selector"),
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """A request log from the events: 50 URLs, three render modes, some results empty or failed."""
    e = table(spark, sf, "events")
    t = F.col("event_type")
    return e.select(
        F.col("event_id").alias("id"),
        "ts",
        "user_id",
        F.concat(F.lit("https://h"), F.pmod("user_id", F.lit(7)).cast("string"), F.lit(".example.com/p/"), F.pmod("user_id", F.lit(50)).cast("string")).alias("url"),
        F.when(t == "view", "always").when(t == "click", "never").otherwise("auto").alias("render"),
        F.when(t == "signup", "none").otherwise("fast").alias("actions"),
        (t != "signup").alias("include_actions"),
        F.when(t == "purchase", 500).alias("max_tokens"),
        F.lit(None).cast("string").alias("selector_hint"),
        F.concat(F.lit("md "), F.floor(F.col("value") / 10).cast("string")).alias("markdown"),
        (t == "error").alias("has_error"),
        (t != "error").alias("storable"),
        (F.pmod("event_id", F.lit(11)) != 0).alias("use_cache"),
        F.when(F.pmod("user_id", F.lit(3)) == 0, 3600).when(F.pmod("user_id", F.lit(3)) == 1, 86400).otherwise(7200).alias("ttl"),
        "value",
    )


def raw_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests as they arrive: options may be missing or wrong."""
    e = table(spark, sf, "events")
    t, i = F.col("event_type"), F.col("event_id")
    return e.select(
        i.alias("id"),
        F.when(F.pmod(i, F.lit(13)) == 0, F.concat(F.lit("ftp://x/"), i.cast("string")))
        .when(F.pmod(i, F.lit(17)) == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("https://x.example/"), i.cast("string"))).alias("url"),
        F.when(t == "view", "sometimes").when(t == "click", "never").alias("render"),
        F.when(t == "signup", "verified").when(t == "error", "slow").alias("actions"),
        F.when(F.col("value") < 50, F.floor(F.col("value") * 10).cast("int")).alias("max_tokens"),
        (F.pmod(i, F.lit(9)) - 1).cast("int").alias("cache_ttl"),
        (F.pmod(i, F.lit(70)) * 1000).cast("int").alias("timeout_ms"),
    )


def fixtures(spark: SparkSession, sf: str) -> DataFrame:
    """One fixture per page with expectations of every kind; defaults not merged yet."""
    p = pages(spark, sf)
    i = F.col("page_id")
    m = F.pmod(i, F.lit(6))
    nil = lambda t: F.lit(None).cast(t)
    words = "array<string>"
    x = F.struct(
        F.when(m == 1, True).alias("expect_no_error"),
        F.struct(
            F.when(m == 2, 60).alias("min_tokens"),
            F.when(m == 0, F.array(F.lit("#"), F.lit("que"), F.lit("it's missing"))).alias("must_contain"),
            F.when(m == 3, F.array(F.lit("<script"), F.lit("the"))).alias("must_not_contain"),
            F.when(m == 4, F.pmod(i, F.lit(4)) == 0).alias("has_code_fence"),
        ).alias("markdown"),
        F.struct(F.when(m == 5, F.when(F.pmod(i, F.lit(4)) == 1, "render").otherwise("static")).alias("strategy")).alias("meta"),
        F.struct(
            F.when(m == 1, 6).alias("min_count"),
            F.when(m == 2, 5).alias("max_count"),
            F.when(m == 3, F.array(F.lit("go_to_next_page"), F.lit("navigate_via"))).alias("must_include_names"),
            F.when(m == 4, F.array(F.lit("search_products"), F.lit("site_navigation"))).alias("must_not_include_names"),
            F.when(m == 5, "local").alias("must_include_effect"),
        ).alias("actions"),
    ).cast(EXPECTATIONS)
    return p.select(
        F.concat(F.when(F.pmod(i, F.lit(10)) == 0, "e2e_").when(F.pmod(i, F.lit(10)) == 1, "form_").when(F.pmod(i, F.lit(10)) == 2, "listing_").otherwise("page_"), i.cast("string")).alias("id"),
        nil("string").alias("name"), "url", nil("string").alias("snapshot"),
        F.when(F.pmod(i, F.lit(10)) == 3, "always").alias("render"),
        F.when(F.pmod(i, F.lit(10)) == 4, "verified").when(F.pmod(i, F.lit(10)) == 5, "none").alias("actions"),
        (F.pmod(i, F.lit(10)) == 0).alias("e2e"),
        x.alias("expectations"),
        "page_id",
    )


def threads(spark: SparkSession, sf: str) -> DataFrame:
    """Forum pages from the conversations: the first turn gives the title, the others are comments."""
    c = table(spark, sf, "conversations").select(
        "conv_id", "turn",
        "role",
        F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "[<>&]", " "), r"[ \t\r\n\f]+", " "), "^ | $", "").alias("text"),
    )
    row = F.concat(
        F.lit('<tr class="comtr"><td><span class="comhead">'),
        F.when(F.pmod("turn", F.lit(2)) == 0, F.concat(F.lit('<a class="hnuser">'), F.col("role"), F.lit("</a> on x"))).otherwise(F.concat(F.col("role"), F.lit(" on top"))),
        F.lit("</span>"),
        F.when(F.pmod("turn", F.lit(5)) != 3, F.concat(F.lit('<div class="commtext">'), F.col("text"), F.lit(" <i>end</i></div>"))).otherwise(""),
        F.lit("</td></tr>"),
    )
    g = c.groupBy("conv_id").agg(
        F.min(F.struct("turn", "text"))["text"].alias("title"),
        F.count("*").alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", row.alias("r")))), lambda x: x["r"]), "").alias("rows"),
    )
    return g.select(
        F.col("conv_id").alias("page_id"),
        F.concat(F.lit("https://forum.example/item?id="), F.col("conv_id").cast("string")).alias("url"),
        F.concat(
            F.lit('<html><body><span class="pagetop">Forum</span><table class="fatitem"><tr class="athing"><td><span class="titleline">'),
            F.col("title"), F.lit('</span></td></tr><tr><td class="subtext">'), F.col("n").cast("string"),
            F.lit('&nbsp;comments</td></tr></table><table class="comment-tree">'), F.col("rows"), F.lit("</table></body></html>"),
        ).alias("html"),
    )


def observations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Logged requests, navigations and document changes of probed candidates, from the events."""
    e = table(spark, sf, "events").withColumns(
        {"k": F.get_json_object("props", "$.k").cast("int"), "candidate_id": F.col("user_id")}
    )
    t = F.col("event_type")
    net = e.where(t.isin("click", "purchase")).select(
        "candidate_id",
        F.when(t == "click", "GET").otherwise(F.when(F.col("k") < 2, "POST").otherwise("GET")).alias("method"),
        F.when(F.col("k") % 3 == 0, F.lit("https://cdn.example/app.js?v=1")).when(F.col("k") % 7 == 0, F.lit("https://www.google-analytics.com/collect"))
        .otherwise(F.concat(F.lit("https://api.example/items?page="), F.col("k").cast("string"))).alias("url"),
        F.when(F.col("k") % 2 == 0, "application/json").otherwise("text/plain").alias("mime"),
        (F.col("k") * 40).cast("long").alias("bytes"),
    )
    nav = e.where(t == "view").select(
        "candidate_id", F.lit("https://a.example/").alias("from_url"),
        F.when(F.col("k") == 1, "https://a.example/next").otherwise("https://a.example/").alias("to_url"),
    )
    dom = e.where(t.isin("signup", "error")).select(
        "candidate_id", F.when(t == "signup", F.col("k") % 4).otherwise(0).alias("added"), F.lit(0).alias("removed"),
        ((t == "error") & (F.col("k") == 5)).alias("dialog_opened"),
    )
    return net, nav, dom


def contract_log(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Contracts written by sign-ups (valid one or two days) and act requests from clicks."""
    e = table(spark, sf, "events")
    action = F.concat(F.lit("act_"), F.pmod("user_id", F.lit(40)).cast("string"))
    life = F.when(F.pmod("event_id", F.lit(2)) == 0, F.expr("interval 24 hours")).otherwise(F.expr("interval 48 hours"))
    contracts = e.where("event_type = 'signup'").select(
        action.alias("action_id"), F.col("ts").alias("created_at"), (F.col("ts") + life).alias("expires_at"),
        (F.pmod("event_id", F.lit(3)) == 0).alias("requires_confirm"), F.col("event_id").alias("contract"),
    )
    acts = e.where("event_type = 'click'").select(
        F.col("event_id").alias("request_id"), action.alias("action_id"), "ts", (F.pmod("event_id", F.lit(5)) == 0).alias("confirm")
    )
    return acts, contracts


def lift_log(spark: SparkSession, sf: str) -> DataFrame:
    """Observed requests with their parameters and headers."""
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return e.select(
        F.col("event_id").alias("request_id"),
        F.when(F.col("event_type") == "purchase", "POST").otherwise("GET").alias("method"),
        F.concat(F.lit("https://api.example/s?q=w"), F.col("k"), F.lit("&user="), F.col("user_id").cast("string"), F.lit("&v=1")).alias("url"),
        F.create_map(F.lit("query"), F.concat(F.lit("w"), F.col("k")), F.lit("user"), F.col("user_id").cast("string")).alias("params"),
        F.when(
            F.col("event_type") == "error",
            F.create_map(F.lit("Host"), F.lit("api.example"), F.lit("Cookie"), F.lit("s=1"), F.lit("Accept"), F.lit("*/*")),
        ).otherwise(F.create_map(F.lit("Host"), F.lit("api.example"), F.lit("Content-Length"), F.lit("2"), F.lit("Accept"), F.lit("*/*"))).alias("headers"),
    )


def lift_log_whole(spark: SparkSession, sf: str) -> DataFrame:
    """``lift_log`` with parameters in paths, forms and JSON bodies, by event_id modulo 3."""
    r, kind = lift_log(spark, sf), F.pmod("request_id", F.lit(3))
    q, user = F.col("params")["query"], F.col("params")["user"]
    url = F.when(kind == 0, F.concat(F.lit("https://api.example/u/"), user, F.lit("/find/"), q, F.lit("?v=1"))).otherwise("https://api.example/s?v=1")
    body = F.when(kind == 1, F.concat(F.lit("q="), q, F.lit("&user="), user, F.lit("&v=x"))).when(
        kind == 2, F.concat(F.lit('{"q": "'), q, F.lit('", "ids": [0'), user, F.lit(", "), user, F.lit('], "user": "x"}')))
    sort = F.when(kind == 1, "application/x-www-form-urlencoded").otherwise("application/json; charset=utf-8")
    return r.select("request_id", "method", url.alias("url"), "params", F.map_concat("headers", F.create_map(F.lit("Content-Type"), sort)).alias("headers"), body.alias("body"))


# Markup with missing, crossing and superfluous tags, by page_id modulo their number.
MISNESTED = [
    "<div><span>x</div>y</span>z", "<b>1<i>2</b>3</i>", "<b>1<div>2</b>3</div>", "<ul><li>a<div>b<li>c</ul>",
    "<table><tr><td>a</tr><tr><td>b<table><tr><td>c</table>d</table>", '<a title="x>y" href=/p?a=1>t<a href=y>2</a>',
]


def pages_misnested(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whose article begins with a ``div`` of class ``odd`` around a piece of ``MISNESTED``."""
    piece = F.get(F.array(*map(F.lit, MISNESTED)), F.pmod("page_id", F.lit(len(MISNESTED))).cast("int"))
    return pages(spark, sf).withColumn("html", F.replace("html", F.lit("<article>"), F.concat(F.lit('<article><div class="odd">'), piece, F.lit("</div>"))))
