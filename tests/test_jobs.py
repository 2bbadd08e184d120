"""Sources, sinks, routing, evaluation and contract jobs on rows worked out by hand."""

import json

from pyspark.sql import functions as F

from pagelake.functions import rules, urls
from pagelake.operators import contracts as K
from pagelake.operators import evaluation as E
from pagelake.operators import routing as R
from pagelake.plans import extract as X
from pagelake.sources import tables as S
from pagelake.streaming import cache_stream as CS

ARTICLE = "<html><body><article><h1>Title</h1><p>" + "Plain words here. " * 30 + "</article></body></html>"
SHELL = '<html><head><title>SPA App</title></head><body><div id="root"></div><script src="/x.js"></script></body></html>'


def test_router(spark):
    p = spark.createDataFrame([(1, ARTICLE), (2, SHELL), (3, "")], "id int, html string")
    got = {r.id: r.s for r in p.select("id", R.page_signals(F.col("html")).alias("s")).collect()}
    assert not got[1].client_rendered and got[2].client_rendered and not got[3].has_html
    need = lambda i, mode, md: spark.range(1).select(R.needs_render(F.lit(mode), F.struct(F.lit(got[i].has_html).alias("has_html"), F.lit(got[i].client_rendered).alias("client_rendered")), F.lit(md))).first()[0]
    assert need(1, "always", "x") and not need(2, "never", "") and need(2, "auto", "x" * 100) and need(1, "auto", "x" * 79) and not need(1, "auto", "x" * 80) and need(3, "auto", "")


def test_content_errors(spark):
    rows = [
        ("<p>x</p>", "Subscribe to continue", 200, "paywall"), ("<script>paywall</script>", "good text " * 40, 200, None),
        ("paywall", "short text that is thin", 200, "paywall"), ("<p>Verify you are human</p>", "", 200, "empty_page"),
        ("<p>Verify you are human</p>" + "x" * 90, "", 200, "bot_detection"), ("<p>" + "x" * 99, "fine", 403, "bot_detection"),
        ("  ", "", 200, "empty_page"), ("<p>paywalled sites", "paywalled sites " * 20, 200, None),
    ]
    df = spark.createDataFrame(rows, "html string, md string, status int, want string")
    bad = df.withColumn("got", R.content_error(R.page_signals(F.col("html")), F.col("md"), F.col("status"))["code"]).where("not (got <=> want)")
    assert bad.collect() == []


def test_responses_follow_the_hybrid_order(spark):
    fetched = spark.createDataFrame(
        [(1, ARTICLE, 200, None, "auto"), (2, SHELL, 200, None, "auto"), (3, None, 503, None, "auto"), (4, None, 404, None, "never"),
         (5, SHELL, 200, None, "auto"), (6, ARTICLE, 200, None, "always"), (7, None, 200, "timeout", "auto")],
        "page_id long, html string, status_code int, transport string, render string",
    ).withColumns({"url": F.lit("https://a.example/"), "final_url": F.lit("https://a.example/"), "elapsed_ms": F.lit(10.0)})
    rendered = spark.createDataFrame([(2, ARTICLE, None), (3, ARTICLE, None), (5, None, "Timeout 30000ms"), (6, ARTICLE, None), (7, "<p>", None)], "page_id long, html string, failure string").withColumns(
        {"url": F.lit("https://a.example/"), "final_url": F.lit("https://a.example/r"), "elapsed_ms": F.lit(100.0), "timeout_ms": F.lit(30000)})
    r = {x.page_id: x for x in X.responses(fetched, rendered).collect()}
    path = {k: (v.meta.extraction_path, v.error and v.error.code) for k, v in r.items()}
    assert path == {
        1: ("static", None), 2: ("render", None), 3: ("render", "http_503"), 4: ("static", "http_404"), 5: ("static", "js_navigation_timeout"),
        6: ("render", None), 7: ("static", "js_empty_document"),
    }
    assert r[2].meta.timings_ms == {"fetch": 10.0, "render": 100.0, "total": 110.0} and "fetch" not in r[6].meta.timings_ms
    assert r[4].markdown == "" and r[4].meta.tokens == {} and r[5].markdown == "SPA App" and r[2].meta.final_url.endswith("/r")


def test_responses_written_and_read(spark, tmp_path):
    f = spark.createDataFrame([(1, "https://a.example/", ARTICLE), (2, "https://b.example/x", SHELL)], "page_id long, url string, html string").withColumns(
        {"final_url": F.col("url"), "elapsed_ms": F.lit(1.0)})
    r = X.responses(f)
    S.write_responses(r, str(tmp_path / "p"))
    assert {x.host for x in spark.read.parquet(str(tmp_path / "p")).select("host").collect()} == {"a.example", "b.example"}
    S.write_responses(r, str(tmp_path / "j"), "json")
    rows = [json.loads(x.value) for x in spark.read.text(str(tmp_path / "j")).collect()]
    assert all(x["error"] is None or x["error"]["code"] for x in rows) and all("cached_at" in x["meta"] and x["actions"] == [] for x in rows)
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "one.json").write_text(json.dumps({"markdown": "m", "actions": [], "meta": {"url": "u", "tokens": {"markdown": 1}}, "error": None}))
    s = S.load_snapshots(spark, str(tmp_path / "s")).first()
    assert (s.id, s.markdown, s.meta.tokens) == ("one", "m", {"markdown": 1})
    (tmp_path / "run.json").write_text(json.dumps({"run_at": "t", "total": 1, "results": [{"id": "one", "status": "fail", "failures": ["x"]}]}, indent=1))
    assert S.load_results(spark, str(tmp_path / "run.json")).first().failures == ["x"]


def test_fixtures_and_failures(spark, tmp_path):
    fixtures = [
        {"id": "listing_a", "url": "u", "expectations": {"markdown": {"min_tokens": 100, "must_contain": ["All products", "it's"]}, "actions": {"min_count": 2, "must_include_names": ["search_products", "go_to_next_page"]}, "meta": {"strategy": "static"}}},
        {"id": "ok", "url": "u", "render": "always", "expectations": {"actions": {"max_count": 15, "must_include_effect": "local", "must_not_include_names": ["accept_cookies"]}, "meta": {"strategy": "render"}}},
        {"id": "walled", "url": "u", "actions": "none", "expectations": {"expect_no_error": True, "markdown": {"has_code_fence": True, "must_not_contain": ["<script"]}}},
        {"id": "e2e_x", "url": "u", "e2e": True}, {"id": "gone", "url": "u"},
    ]
    path = tmp_path / "f.jsonl"
    path.write_text("\n".join(json.dumps(f) for f in fixtures))
    f = S.load_fixtures(spark, str(path))
    assert {r.id: (r.render, r.include_actions, r.timeout_ms) for r in f.collect()}["ok"] == ("always", True, 45000)
    action = lambda label, desc: {"type": "link", "label": label, "target": "https://a/", "method": "GET", "parameters": {}, "description": desc}
    answers = [
        {"id": "listing_a", "markdown": "three words here", "actions": [action("next", "Navigate to 'next' (pagination).")], "meta": {"extraction_path": "static"}},
        {"id": "ok", "markdown": "m", "actions": [action("Tab", "Activate 'Tab' for a local in-page UI change.")], "meta": {"extraction_path": "render"}},
        {"id": "walled", "markdown": "a <script b", "actions": [], "meta": {"strategy": "static"}, "error": {"code": "bot_detection", "message": "Target may be blocking automated access", "recoverable": True}},
    ]
    apath = tmp_path / "a.jsonl"
    apath.write_text("\n".join(json.dumps(a) for a in answers))
    res = E.evaluate(f, spark.read.schema("id string, " + S.RESPONSE).json(str(apath)))
    got = {r.id: (r.category, r.status, r.failures) for r in res.collect()}
    assert got["listing_a"] == ("listing", "fail", [
        "markdown tokens 3 < min 100", "markdown missing substring: 'All products'", 'markdown missing substring: "it\'s"', "actions count 1 < min 2", "missing action: search_products"])
    assert got["ok"] == ("spa/render", "pass", [])
    assert got["walled"] == ("read", "fail", [
        "unexpected error: 'bot_detection' — Target may be blocking automated access", "markdown must not contain: '<script'", "markdown missing code fence"])
    assert got["e2e_x"] == ("e2e", "skipped", []) and got["gone"][1] == "error"
    total = {r.category: (r.total, r.passed, r.failed, r.skipped) for r in E.run_summary(res).collect()}
    assert total["all"] == (5, 1, 3, 1)


def test_urls(spark):
    base = "http://a/b/c/d?q"
    cases = {  # RFC 3986, 5.4.1
        "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d?y",
        "g?y": "http://a/b/c/g?y", "#s": "#s", "g#s": "http://a/b/c/g#s", "..": "http://a/b/", "../g": "http://a/b/g", "../../g": "http://a/g",
        "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g;x=1/../y": "http://a/b/c/y", "": "", "tel:1": "tel:1",
    }
    df = spark.createDataFrame(list(cases.items()), "ref string, want string")
    bad = df.withColumn("got", urls.resolve(F.col("ref"), F.lit(base))).where("got != want")
    assert bad.collect() == []
    norm = spark.createDataFrame([("HTTPS://A.example:443/p?b=2&utm_source=x&a=1#f",)], "u string")
    assert norm.select(urls.normalised(F.col("u"), rules.TRACKING_PARAMETER)).first()[0] == "https://a.example/p?a=1&b=2"


def test_reused_templates_are_spread(spark):
    """A template with more pages than a part holds is split, and every page still gets its actions once."""
    fp = spark.range(100).select(F.col("id").alias("page_id"), F.lit("d").alias("domain"), F.when(F.col("id") < 90, "hot").otherwise("t").alias("template"), F.lit("/").alias("path_pattern"))
    acts = fp.where("page_id in (0, 90)").crossJoin(spark.range(2).withColumnRenamed("id", "rank")).withColumns({"type": F.lit("link"), "label": F.lit("x"), "method": F.lit("GET")})
    old, K.PAGES_PER_PART = K.PAGES_PER_PART, 10
    try:
        got = K.reuse_actions(fp, acts)
        assert got.count() == 200 and got.select("page_id", "rank").distinct().count() == 200
    finally:
        K.PAGES_PER_PART = old


def test_page_stream(spark, sf, tmp_path):
    """Pages extracted per micro-batch equal the batch result."""
    from pagelake.plans import derived as D

    p = D.pages(spark, sf).withColumn("base", F.col("url"))
    p.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    CS.run_pages(stream, lambda b: X.extract(b, ["url"]), str(tmp_path / "state"), str(tmp_path / "out")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("page_id", "markdown", F.size("actions").alias("n"))
    want = X.extract(p, ["url"]).select("page_id", "markdown", F.size("actions").alias("n"))
    assert got.exceptAll(want).count() == 0 and got.count() == 250


def test_hints_dead_actions_and_unsafe_probes(spark, make_pages):
    from pagelake.operators import actions as A

    seen = spark.createDataFrame([("https://a/1", "render", None), ("https://a/2", "render", None), ("https://b/1", "static", "bot_detection"), ("https://c/1", "static", None)], "url string, extraction_path string, error_code string")
    new = spark.createDataFrame([("https://a/9",), ("https://b/9",), ("https://c/9",), ("https://d/9",)], "url string")
    got = {r.url: r.hint for r in R.with_hints(new, R.domain_hints(seen)).collect()}
    assert got == {"https://a/9": "render", "https://b/9": "render_with_proxy", "https://c/9": "static", "https://d/9": "static"}
    p = make_pages((1, "https://a.example/", '<a href="/x">One link</a><a href="/y">Two link</a>'))
    dead = A.top_actions(p).where("label = 'Two link'").select("page_id", "action_key", F.lit("dead").alias("effect"))
    assert [(r.label, r.reason) for r in A.suppressed(A.page_rows(p), effects=dead).collect()] == [("Two link", "dead")]
    acts = spark.createDataFrame([(1, True, "verified", True), (1, True, "verified", False), (2, False, "inferred", True)], "page_id long, probed boolean, verification string, requires_confirm boolean")
    assert {r.page_id: r.gate_ok for r in E.unsafe_probes(acts).collect()} == {1: False, 2: True}


def test_fallback_confidence_tiers_and_lookup(spark):
    c = spark.createDataFrame([
        (1, "link", "Go on", "GET", "https://a/x", "Follow link to 'Go on'.", False, 1, False), (2, "button", "Delete", "GET", "https://a/", "Click", False, 1, False),
        (3, "form", "Pay", "POST", "https://a/payment", "Submit", False, 1, False), (4, "form", "Add", "POST", "https://a/x", "Submit", False, 1, True),
        (5, "button", "Odd", "GET", "https://a/", "Click", False, 1, False), (6, "link", "cookie", "GET", "https://a/", "x", True, 1, False), (7, "link", "Go on", "GET", "https://a/x", "x", False, 2, False),
    ], "page_id long, type string, label string, method string, target string, description string, noise boolean, nth int, near_price boolean")
    g = K.guarded(c)
    assert {r.page_id: (r.rule, r.effect) for r in g.collect()} == {
        1: (None, "navigate"), 2: ("name", "presumed_mutating"), 3: ("name", "presumed_mutating"), 4: ("price_nearby", "presumed_mutating"), 5: (None, "local"), 6: (None, "navigate"), 7: (None, "navigate")}
    tiers = {m: [r.tier for r in K.tier(g, m).orderBy("page_id").collect()] for m in ("fast", "verified")}
    assert tiers["verified"] == ["t0_http", "ignore", "ignore", "ignore", "t2_browser", "ignore", "ignore"] and tiers["fast"][4] == "t1_light_dom"


def test_blanks_around_an_address_do_not_count(spark):
    rows = [(" /foo",), ("\n\tbar",), ("a\nb",)]
    got = spark.createDataFrame(rows, "href string").select(urls.resolve(F.col("href"), F.lit("http://c.example/x/y")).alias("u"))
    assert [r.u for r in got.collect()] == ["http://c.example/foo", "http://c.example/x/bar", "http://c.example/x/ab"]


def test_small_writes_count_and_small_reads_do_not(spark):
    net = spark.createDataFrame(
        [("a", "https://h.example/save", "POST", 0, None), ("b", "https://h.example/ping", "GET", 10, "application/json")],
        "candidate_id string, url string, method string, bytes int, mime string",
    )
    nav = spark.createDataFrame([], "candidate_id string, from_url string, to_url string")
    dom = spark.createDataFrame([("a", False, 1, 0), ("b", False, 1, 0)], "candidate_id string, dialog_opened boolean, added int, removed int")
    got = {r.candidate_id: r.effect for r in K.effects(net, nav, dom).collect()}
    assert got == {"a": "mutating", "b": "local"}


def test_a_contract_that_ends_before_it_starts_is_never_found(spark):
    requests = spark.sql("SELECT 'r' AS request_id, 'x' AS action_id, timestamp'2024-01-02 12:00:00' AS ts, true AS confirm")
    bad = spark.sql("SELECT 'x' AS action_id, timestamp'2024-01-05' AS created_at, timestamp'2024-01-01' AS expires_at, false AS requires_confirm, 'c' AS contract")
    assert [r.error for r in K.resolve_act(requests, bad).collect()] == ["action_not_found"]


def test_lifted_paths_forms_and_json(spark):
    jsons = {"Content-Type": "application/json"}
    form = {"content-type": "application/x-www-form-urlencoded", "Cookie": "s"}
    rows = [
        (1, "https://h.example/a/J%C3%BCrgen%20B/x?q=a+b&q2=c%26d&e=", {"name": "Jürgen B", "q": "a b", "r": "c&d", "none": ""}, jsons, None),
        (2, "https://h.example/s", {"q": 'say "hi"\\', "n": "7", "f": "true", "k": "q"}, jsons, '{"q": "say \\"hi\\"\\\\", "n": [7, 77, "7"], "x": {"f": true, "q":"q"}}'),
        (3, "/rel/7?x", {"a": "7", "b": "7"}, form, "x=7&7=8&y"),
        (4, "https://h.example/%zz/7", {"n": "9"}, {}, "n=9"),
    ]
    df = spark.createDataFrame(rows, "request_id long, url string, params map<string,string>, headers map<string,string>, body string").withColumn("method", F.lit("POST"))
    got = {r.request_id: (r.url_template, r.body_template, r.auth, r.lifted) for r in K.lift_whole(df).collect()}
    assert got[1] == ("https://h.example/a/{name}/x?q={q}&q2={r}&e=", None, "none", True)
    assert got[2] == ("https://h.example/s", '{"q": "{q}", "n": [{n}, 77, "{n}"], "x": {"f": {f}, "q":"{k}"}}', "none", True)
    assert got[3] == ("/rel/{a}?x", "x={a}&7=8&y", "cookie", False)
    assert got[4] == ("https://h.example/%zz/7", "n=9", "none", False)
