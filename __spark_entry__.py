"""Entry points: the flagship query, all queries, and the SQL they are checked against."""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.functions import text, urls
from pagelake.operators import actions as A
from pagelake.operators import cache as C
from pagelake.operators import contracts as K
from pagelake.operators import evaluation as E
from pagelake.operators import html as H
from pagelake.operators import markdown as M
from pagelake.operators import routing as R
from pagelake.operators import templates as T
from pagelake.plans import derived as D
from pagelake.plans import extract as X
from pagelake.session import checkpoint_dir, prepare, written
from pagelake.sources import history as Hi
from pagelake.sources import tables as S
from pagelake.streaming import cache_stream as CS
from pagelake.streaming import ttl_stream as TS

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register a query; whole numbers come back as bigint."""

    @functools.wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = fn(prepare(spark), sf)
        return df.select(*[
            F.col(f.name).cast("bigint").alias(f.name) if f.dataType.simpleString() in ("int", "smallint", "tinyint") else F.col(f.name)
            for f in df.schema
        ])

    _QUERIES[fn.__name__] = run
    return fn


def micros(c: str) -> object:
    return F.unix_micros(c).alias(c)


# ------------------------------------------------------------------------ sources and sinks
@query
def fetch_outcomes(spark, sf):
    f = R.classify_fetch(D.fetches(spark, sf))
    return f.select(
        "page_id", F.col("fetch_error.code").alias("code"), F.col("fetch_error.message").alias("message"),
        F.col("fetch_error.recoverable").alias("recoverable"), F.length("html").alias("html_chars"),
    )


@query
def fetches_reloaded(spark, sf):
    """Fetch log written as parquet and read back through the snapshot source."""
    path = f"{checkpoint_dir(spark)}/fetches-{uuid.uuid4().hex}"
    D.fetches(spark, sf).drop("render", "actions").withColumn("headers", F.lit(None).cast("map<string,string>")).write.parquet(path)
    return S.load_fetches(spark, path).groupBy("status_code").agg(F.count("*").alias("n"), F.count("html").alias("with_html"))


@query
def render_outcomes(spark, sf):
    r = R.classify_render(D.renders(spark, sf))
    return r.select(
        "page_id", F.col("render_error.code").alias("code"), F.col("render_error.message").alias("message"),
        F.col("render_error.recoverable").alias("recoverable"),
    )


@query
def request_validation(spark, sf):
    r = S.checked_requests(D.raw_requests(spark, sf))
    return r.select(
        "id", "render", "actions", "cache_ttl", "timeout_ms", "use_cache", F.array_join("problems", ",").alias("problems")
    )


@query
def fixture_requests(spark, sf):
    f = S.with_fixture_defaults(D.fixtures(spark, sf))
    return f.select("id", "url", "render", "actions", "include_actions", "use_cache", "timeout_ms")


@query
def response_json(spark, sf):
    j = S.response_json(X.responses(D.fetches(spark, sf), D.renders(spark, sf)))
    get = lambda p: F.get_json_object("json", p)
    return j.select(
        "page_id", get("$.meta.final_url").alias("final_url"), get("$.meta.extraction_path").alias("path"),
        get("$.error.code").alias("error_code"), F.col("json").contains('"error":null').alias("error_is_null"),
        F.col("json").contains('"actions":[]').alias("no_actions"), F.col("json").contains('"cached_at":null').alias("cached_at_is_null"),
    )


@query
def history_append(spark, sf):
    """Two extractions of all pages appended to the history; the newest row of each URL."""
    path = f"{checkpoint_dir(spark)}/history-{uuid.uuid4().hex}"
    r = X.responses(D.fetches(spark, sf))
    for day in ("2024-01-01 06:00:00", "2024-01-02 06:00:00"):
        S.append_history(S.history_rows(r, F.lit(day).cast("timestamp"), F.lit("0" * 16)), path)
    h = spark.read.parquet(path)
    return h.groupBy("url").agg(
        F.count("*").alias("versions"), F.countDistinct("id").alias("ids"),
        F.unix_micros(F.max("created_at")).alias("newest"), F.max("strategy").alias("strategy"),
    )


@query
def history_commits(spark, sf):
    """Two commits, the first of them repeated; the history as of each version."""
    path = f"{checkpoint_dir(spark)}/commits-{uuid.uuid4().hex}"
    r = X.responses(D.fetches(spark, sf))
    days = {d: written(S.history_rows(r, F.lit(f"2024-01-0{d} 06:00:00").cast("timestamp"), F.lit("0" * 16))) for d in (1, 2)}
    for day in (1, 2, 1):
        Hi.commit(days[day], path, f"day {day}")
    seen = lambda v: Hi.read(spark, path, days[1].schema, v).withColumn("version", F.lit(v))
    return seen(1).unionByName(seen(2)).groupBy("version").agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.countDistinct("url").alias("urls"), F.unix_micros(F.max("created_at")).alias("newest"))


# ------------------------------------------------------------------------ page model
@query
def page_tokens(spark, sf):
    t = H.tokens(D.pages_aug(spark, sf), ends=False).where("pos > 0")
    return t.select("page_id", "pos", "kind", "tag", F.length("raw").alias("chars"))


@query
def page_elements(spark, sf):
    e = H.elements(H.tokens(D.pages_aug(spark, sf))).where("kind = 'open'")
    return e.select("page_id", "pos", "epos", "tag", "parent_pos", "parent_tag")


@query
def repaired_elements(spark, sf):
    """Elements of misnested markup, with places counted from the block around it."""
    e = H.elements(H.tokens(D.pages_misnested(spark, sf))).where("kind = 'open'")
    odd = F.col("tag").eqNullSafe("div") & F.col("raw").eqNullSafe('<div class="odd">')
    block = F.last(F.when(odd, F.struct("pos", "epos")), ignorenulls=True).over(W.partitionBy("page_id").orderBy("pos"))
    e = e.withColumn("block", block).where(F.col("pos").between(F.col("block.pos") + 1, F.col("block.epos")))
    at = F.col("block.pos")
    return e.select("page_id", "tag", (F.col("pos") - at).alias("pos"), (F.col("epos") - at).alias("epos"), (F.col("parent_pos") - at).alias("parent"))


@query
def element_attributes(spark, sf):
    e = H.with_attributes(H.tokens(D.pages_aug(spark, sf), ends=False).where("kind = 'open'"))
    return e.select("page_id", "pos", "tag", F.explode("attrs").alias("name", "value"))


@query
def content_texts(spark, sf):
    """Texts left after navigation, footers, banners, scripts and styles are taken out."""
    nd = H.nodes(D.pages_aug(spark, sf))
    keep = (F.col("kind") == "text") & ~F.col("dropped") & (F.length("piece") > 0)
    return nd.where(keep).select("page_id", "pos", F.col("piece").alias("text"))


@query
def element_text_lengths(spark, sf):
    s = H.starts(H.nodes(D.pages_aug(spark, sf)))
    return s.select("page_id", "pos", "tag", "n_texts", "text_len")


@query
def element_texts(spark, sf):
    tags = ["a", "button", "label", "option", "h1", "h2", "p", "td", "th", "title"]
    return M.element_texts(H.nodes(D.pages_aug(spark, sf)), tags, " ").select("page_id", "pos", "tag", "text")


@query
def ancestor_flags(spark, sf):
    s = H.starts(H.nodes(D.pages_aug(spark, sf)))
    return s.select("page_id", "pos", "tag", (F.col("nav_depth") > 0).alias("in_nav"), F.col("form_pos").isNotNull().alias("in_form"))


@query
def decoded_titles(spark, sf):
    """Titles with character references decoded, the title doubled with numeric references."""
    p = D.pages(spark, sf)
    t = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    return p.select("page_id", text.decode_entities(t).alias("title"), text.decode_entities(F.concat(t, F.lit(" &#169; &#x2013; &copy;&lt;"))).alias("marked"))


@query
def character_references(spark, sf):
    """Titles with one of the standard's names each, with and without its semicolon, in a text and in an attribute's value."""
    names = F.from_json(F.lit(json.dumps([n for n in sorted(text.NAMES) if n.endswith(";")])), "array<string>")
    name = F.get(names, F.pmod(F.col("page_id") * 7, F.size(names)).cast("int"))
    bare = F.substring(name, F.lit(1), F.length(name) - 1)
    p = D.pages(spark, sf).select("page_id", F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"), name.alias("name"), bare.alias("bare"))
    marked = F.concat(F.lit("&"), "title", F.lit("&amp;lt; &#38;lt; &"), "name", F.lit("&_"), "name", F.lit(" &"), "bare", F.lit(" &notit; &#x80;&#xD800;&#1;."))
    value = F.concat(F.lit("?a=1&"), "bare", F.lit("=2&"), "name", F.lit("&copy=3&copy;&lt"))
    return p.select("page_id", "name", text.decode_entities(marked).alias("in_text"), text.decode_entities(value, attribute=True).alias("in_value"))


@query
def visible_lengths(spark, sf):
    return D.pages_aug(spark, sf).select("page_id", text.visible_len(F.col("html")).alias("visible"))


@query
def selector_hints(spark, sf):
    hint = F.when(F.col("page_id") % 5 == 0, "nav").when(F.col("page_id") % 5 == 1, "div.ad").when(F.col("page_id") % 5 == 2, "[class*=ad]").when(F.col("page_id") % 5 == 3, "#missing").otherwise("p")
    p = D.pages(spark, sf).withColumn("hint", hint)
    m = M.main_content(p, "hint")
    return m.select("page_id", "rule", "tag")


# ------------------------------------------------------------------------ Markdown
@query
def main_content(spark, sf):
    return M.main_content(D.pages(spark, sf)).select("page_id", "rule", "tag", "text_len")


@query
def markdown_pages(spark, sf):
    p = D.pages(spark, sf).withColumn("base", F.col("url"))
    m = X.extract(p, [], with_actions=False)
    return m.select("page_id", "markdown", text.token_estimate(F.col("markdown")).alias("tokens"))


@query
def markdown_rich(spark, sf):
    """Markdown of lists, tables, code, links, quotes and headings."""
    p = D.pages_rich(spark, sf).withColumn("base", F.col("url"))
    m = X.extract(p, [], with_actions=False)
    return m.select("page_id", "markdown")


@query
def markdown_truncated(spark, sf):
    p = D.pages(spark, sf).withColumns({"base": F.col("url"), "max_tokens": F.lit(100)})
    return X.extract(p, [], with_actions=False).select("page_id", "markdown", "truncated")


@query
def markdown_quality(spark, sf):
    """Two versions of each page compete: without its first heading mark, and complete."""
    p = D.pages(spark, sf).withColumn("base", F.col("url"))
    m = X.extract(p, [], with_actions=False)
    v = m.select("page_id", F.explode(F.array(
        F.struct(F.lit(0).alias("preference"), F.regexp_replace("markdown", r"^# ", "").alias("markdown")),
        F.struct(F.lit(1).alias("preference"), F.col("markdown")),
    )).alias("v")).select("page_id", "v.*").withColumn("source_has_heading", F.lit(True))
    return M.quality(v).select("page_id", "preference", "usable")


@query
def heading_outline(spark, sf):
    return M.outline(D.pages_rich(spark, sf))


@query
def thread_parts(spark, sf):
    return M.thread_rows(D.threads(spark, sf)).select("page_id", "part", "role", "author", "text", "pos").withColumn(
        "nth", F.row_number().over(W.partitionBy("page_id", "part").orderBy("pos"))
    ).drop("pos")


@query
def thread_markdown(spark, sf):
    return M.thread_markdown(D.threads(spark, sf))


@query
def link_references(spark, sf):
    return M.reference_links(D.pages_rich(spark, sf)).select("page_id", "markdown", "n_refs")


# ------------------------------------------------------------------------ routing and responses
@query
def routes(spark, sf):
    """Route of every page: signals of the source and length of its Markdown."""
    f = X.with_defaults(D.fetches(spark, sf)).withColumn("base", F.col("url"))
    f = f.withColumn("signals", R.page_signals(F.col("html")))
    s = X.extract(f, ["render", "signals"], with_actions=False)
    need = R.needs_render(F.col("render"), F.col("signals"), F.col("markdown"))
    return s.select("page_id", F.col("signals.client_rendered").alias("client_rendered"), F.coalesce(need, F.lit(False)).alias("needs_render"))


def _flat(r: DataFrame) -> DataFrame:
    return r.select(
        "page_id", F.col("meta.extraction_path").alias("path"), F.col("meta.truncated").alias("truncated"),
        F.col("meta.tokens")["markdown"].alias("tokens"), F.length("markdown").alias("chars"), F.size("actions").alias("n_actions"),
        F.col("error.code").alias("error_code"), F.col("error.recoverable").alias("recoverable"),
    )


@query
def responses(spark, sf):
    return _flat(X.responses(D.fetches(spark, sf), D.renders(spark, sf)))


@query
def responses_static(spark, sf):
    return _flat(X.responses(D.fetches(spark, sf)))


@query
def content_errors(spark, sf):
    """Content errors of documents shown as pages, some with a wall in the source."""
    d = S.table(spark, sf, "documents")
    wall = F.when(F.pmod("doc_id", F.lit(4)) == 0, "<div>Members only</div>").when(F.pmod("doc_id", F.lit(4)) == 1, "<p>verify you are human</p>").otherwise("")
    md = F.when(F.pmod("doc_id", F.lit(9)) == 0, "").otherwise(F.col("text"))
    html = F.concat(F.lit("<html>"), wall, md, F.lit("</html>"))
    status = F.when(F.pmod("doc_id", F.lit(19)) == 0, 403).otherwise(200)
    e = R.content_error(R.page_signals(html), md, status)
    return d.select("doc_id", e["code"].alias("code"), e["recoverable"].alias("recoverable"))


@query
def stage_timings(spark, sf):
    r = X.responses(D.fetches(spark, sf), D.renders(spark, sf)).select(F.col("meta.extraction_path").alias("extraction_path"), F.col("meta.timings_ms").alias("timings_ms"))
    return R.timing_report(r)


@query
def timing_sketches(spark, sf):
    """Percentiles from merged sketches of hosts and days, and whether their exact ranks are within the stated error."""
    r = X.responses(D.fetches(spark, sf), D.renders(spark, sf))
    r = written(r.select(F.col("meta.url").alias("url"), F.pmod("page_id", F.lit(7)).alias("day"), F.col("meta.extraction_path").alias("extraction_path"), F.col("meta.timings_ms").alias("timings_ms")))
    stored = written(R.timing_sketches(r))
    m = R.merged_timings(stored, ["path", "stage"])
    long = r.select(F.col("extraction_path").alias("path"), F.explode("timings_ms").alias("stage", "ms")).where("ms is not null").join(m.drop("n"), ["path", "stage"])
    share = lambda c: F.sum(c.cast("int")) / F.count("*")
    near = lambda c, p: ((share(F.col("ms") < F.col(c)) <= p + R.RANK_ERROR) & (share(F.col("ms") <= F.col(c)) >= p - R.RANK_ERROR))
    return long.groupBy("path", "stage").agg(F.count("*").alias("n"), near("p50_ms", 0.5).alias("p50_near"), near("p95_ms", 0.95).alias("p95_near"))


@query
def domain_hints(spark, sf):
    r = X.responses(D.fetches(spark, sf), D.renders(spark, sf)).select(
        F.col("meta.url").alias("url"), F.col("meta.extraction_path").alias("extraction_path"), F.col("error.code").alias("error_code")
    )
    return R.domain_hints(r)


# ------------------------------------------------------------------------ actions
def _listed(a: DataFrame) -> DataFrame:
    return a.select("page_id", "rank", "type", "label", "target", "method", "description")


@query
def top_actions(spark, sf):
    return _listed(A.top_actions(D.pages(spark, sf)))


@query
def top_actions_aug(spark, sf):
    return _listed(A.top_actions(D.pages_aug(spark, sf)))


@query
def form_fields(spark, sf):
    f = A.form_fields(D.pages_aug(spark, sf))
    return f.select("page_id", "name", "type", "label", "required", F.array_join("options", ",").alias("options"))


@query
def action_parameters(spark, sf):
    a = A.top_actions(D.pages_aug(spark, sf)).where("type = 'form'")
    return a.select("page_id", F.col("label").alias("form"), F.explode("parameters").alias("name", "p")).select(
        "page_id", "form", "name", F.col("p.type").alias("type"), F.col("p.label").alias("label"), F.coalesce("p.required", F.lit(False)).alias("required")
    )


@query
def control_labels(spark, sf):
    el = A.labelled(A.rows(A.page_rows(D.pages_aug(spark, sf))))
    return el.where(F.col("tag").isin("input", "select", "button", "a")).select("page_id", "pos", "tag", "label")


@query
def form_candidates(spark, sf):
    c = A.candidates(A.page_rows(D.pages_aug(spark, sf))).where("type = 'form'")
    return c.select("page_id", "label", "target", "method", "noise", "description")


@query
def link_candidates(spark, sf):
    c = A.candidates(A.page_rows(D.pages_aug(spark, sf))).where("type = 'link'")
    return c.select("page_id", "pos", "label", "target", "noise", "description")


@query
def button_candidates(spark, sf):
    c = A.candidates(A.page_rows(D.pages_aug(spark, sf))).where("type = 'button'")
    return c.select("page_id", "label", "target", "noise", "description")


@query
def host_search_actions(spark, sf):
    """Pages moved to the host that needs a search rule, some of them showing its marker."""
    p = D.pages_aug(spark, sf)
    html = F.when(F.pmod("page_id", F.lit(3)) > 0, F.replace("html", F.lit("</nav>"), F.lit('</nav><i class="product_pod"></i>'))).otherwise(F.col("html"))
    p = p.withColumns({"url": F.lit("https://books.toscrape.com/x/"), "html": html})
    a = A.top_actions(p).where("type = 'form'")
    return a.select("page_id", "label", "target", "description")


@query
def resolved_links(spark, sf):
    """Every reference form resolved against every page URL."""
    refs = ["/a/../b?x=1", "?page=2", "../up", "c/d#e", "//other.example/z", "#top", "mailto:a@b.c", "http://abs.example/p", "./here", "../../far/.", ""]
    p = D.pages(spark, sf).select("page_id", "url", F.explode(F.array(*[F.lit(r) for r in refs])).alias("ref"))
    r = urls.resolve(F.col("ref"), F.col("url"))
    return p.select("page_id", "ref", r.alias("resolved"), urls.same_host(r, F.col("url")).alias("same_host"))


@query
def deduped_actions(spark, sf):
    d = A.dedupe(A.candidates(A.page_rows(D.pages_aug(spark, sf))))
    return d.groupBy("page_id").agg(F.count("*").alias("candidates"), F.countDistinct("action_key").alias("distinct_keys"), F.max("nth").alias("most"))


@query
def suppressed_actions(spark, sf):
    s = A.suppressed(A.page_rows(D.pages_aug(spark, sf)))
    return s.select("page_id", "type", "label", "reason")


@query
def agent_tools(spark, sf):
    return A.tools(A.top_actions(D.pages_aug(spark, sf)))


# ------------------------------------------------------------------------ cache
@query
def cache_keys(spark, sf):
    r = C.cache_keys(D.requests(spark, sf))
    return r.select("id", "digest", "probe_key", "content_key")


@query
def cache_replay_users(spark, sf):
    """Replay keyed by user, one day of life, everything stored."""
    r = D.requests(spark, sf).select("id", "ts", F.col("user_id").alias("key"), F.lit(86400).alias("ttl"), F.lit(True).alias("storable"), F.lit(True).alias("use_cache"))
    return C.cache_replay(r).select("id", "outcome", "stored", micros("stored_at"))


@query
def cache_replay_requests(spark, sf):
    """Replay keyed by URL and options; lives differ, failed results are not stored, some requests bypass."""
    r = C.cache_keys(D.requests(spark, sf)).withColumn("key", F.col("probe_key"))
    return C.cache_replay(r.select("id", "ts", "key", "ttl", "storable", "use_cache")).select("id", "outcome", "stored", micros("stored_at"))


@query
def cache_replay_hot(spark, sf):
    """All requests under one key, which is too large for one task."""
    r = D.requests(spark, sf).select("id", "ts", F.lit(1).alias("key"), F.lit(86400).alias("ttl"), "storable", F.lit(True).alias("use_cache"))
    # A sixth of the log is already too much for a task here, so the one key takes several waves.
    return C.cache_replay(r, hot_rows=max(1000, r.count() // 6)).select("id", "outcome", "stored", micros("stored_at"))


@query
def content_duplicates(spark, sf):
    r = D.requests(spark, sf).withColumn("url", F.concat(F.lit("https://d.example/"), F.pmod("user_id", F.lit(3)).cast("string")))
    out = C.content_dedup(r)
    return out.select("id", "cached", micros("cached_at"), "strategy")


@query
def cache_stream(spark, sf):
    """The replay by user as a stream with keyed state."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")
    r = e.select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"),
        F.lit(86400).alias("ttl"), F.lit(True).alias("storable"), F.lit(True).alias("use_cache"),
    )
    return CS.run_available(CS.cache_stream(r)).select("id", "outcome", "stored", F.col("stored_us").alias("stored_at"))


def _replayed(spark, sf):
    r = C.cache_keys(D.requests(spark, sf)).withColumn("key", F.col("probe_key"))
    return C.cache_replay(r.select("id", "ts", "key", "url", "ttl", "storable", "use_cache"))


@query
def cache_kpis(spark, sf):
    k = C.cache_kpis(_replayed(spark, sf), "6 hours")
    return k.select(micros("window_start"), "host", "requests", "hits", "stores", "hit_rate")


@query
def cache_stream_resumed(spark, sf):
    """The replay by user: requests of the first half of the time in batch, the others as a stream that starts from what was open."""
    e = S.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"),
        F.lit(86400).alias("ttl"), F.lit(True).alias("storable"), F.lit(True).alias("use_cache"))
    lo, hi = e.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    half = F.timestamp_micros(F.lit((lo + hi) // 2))
    batch = C.cache_replay(e.where(F.col("ts") < half))
    folder = f"{checkpoint_dir(spark)}/requests-{uuid.uuid4().hex}"
    e.where(F.col("ts") >= half).write.parquet(folder)
    clock = spark.range(1).select(
        F.lit(TS.CLOCK).cast("bigint").alias("id"), F.lit("clock").alias("key"), F.timestamp_micros(F.lit(hi + 30 * 86_400_000_000)).alias("ts"),
        F.lit(1).alias("ttl"), F.lit(False).alias("storable"), F.lit(False).alias("use_cache"))
    clock.write.mode("append").parquet(folder)
    stream = TS.ttl_stream(spark.readStream.schema(e.schema).parquet(folder), slot_seconds=86_400, start=TS.open_entries(batch))
    out = CS.run_available(stream).select("id", "outcome", "stored", F.col("stored_us").alias("stored_at"))
    return out.unionByName(batch.select("id", "outcome", "stored", F.unix_micros("stored_at").alias("stored_at")))


def _with_content(spark, sf):
    r = C.cache_keys(D.requests(spark, sf)).withColumn("key", F.col("probe_key"))
    out = C.cache_replay(r.select("id", "ts", "key", "url", "ttl", "storable", "use_cache"))
    return out.join(r.select("id", F.col("markdown").alias("content")), "id")


@query
def revalidated(spark, sf):
    k = C.revalidation_kpis(C.revalidations(_with_content(spark, sf)), "6 hours")
    return k.withColumn("window_start", F.unix_micros("window_start"))


@query
def cache_kpi_stream(spark, sf):
    """Windows that are final in a stream of the replay's outcomes."""
    folder = f"{checkpoint_dir(spark)}/outcomes-{uuid.uuid4().hex}"
    _replayed(spark, sf).select("ts", "url", "outcome").write.parquet(folder)
    stream = spark.readStream.schema("ts timestamp, url string, outcome string").parquet(folder)
    return CS.run_available(CS.kpi_stream(stream, "6 hours")).select(micros("window_start"), "host", "requests", "hits")


@query
def rate_limit_sliding(spark, sf):
    return C.sliding_flags(D.requests(spark, sf).select("id", "ts", "url"), 3, 3600)


@query
def rate_limit_flags(spark, sf):
    return C.rate_flags(D.requests(spark, sf), 3, "1 hour").select(micros("window_start"), "host", "requests", "rate_limited", "over")


@query
def normalised_urls(spark, sf):
    """Page URLs in three spellings each."""
    p = D.pages(spark, sf).select(F.explode(F.array(
        "url", F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#x")),
        F.regexp_replace(F.concat(F.upper(urls.scheme(F.col("url"))), F.expr("substring(url, position(':' in url))")), r"^HTTPS://([^/]*)/", "HTTPS://$1:443/"),
    )).alias("url"))
    return C.normalised_keys(p)


# ------------------------------------------------------------------------ evaluation
def _evaluated(spark, sf):
    f = D.fixtures(spark, sf)
    r = X.responses(D.fetches(spark, sf), D.renders(spark, sf))
    r = written(r.join(f.select("page_id", "id"), "page_id"))
    return f, r, E.evaluate(f, r.drop("page_id"))


def _contracts(spark, sf, *keep):
    """Actions with domain and template, and the templates, both from one extraction."""
    p = D.pages_aug(spark, sf).withColumn("base", F.col("url"))
    x = written(X.extract(p, ["url"], with_template=True).drop("markdown"))
    return X.action_rows(x, "domain", "template"), x.select("page_id", "url", "domain", "template", K.path_pattern(F.col("url")).alias("path_pattern"))


@query
def corpus_results(spark, sf):
    _, _, res = _evaluated(spark, sf)
    return res.select("id", "category", "status", "extraction_path", "action_count", F.array_join("failures", "; ").alias("failures"), "error")


@query
def corpus_words(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


@query
def corpus_summary(spark, sf):
    return E.run_summary(_evaluated(spark, sf)[2])


@query
def corpus_failures_saved(spark, sf):
    """Responses of failing fixtures written as evidence and counted from the files."""
    f, r, res = _evaluated(spark, sf)
    path = f"{checkpoint_dir(spark)}/evidence-{uuid.uuid4().hex}"
    E.failing_snapshots(res, r).write.parquet(path)
    return spark.read.parquet(path).select("id", F.length("markdown").alias("chars"))


@query
def stored_results(spark, sf):
    """Results written as a stored run and read back."""
    path = f"{checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"
    res = _evaluated(spark, sf)[2]
    res.select(F.lit("2024-01-01").alias("run_at"), F.array(F.struct("id", "name", "url", "category", "status", "action_count", "failures")).alias("results")).write.json(path)
    back = spark.read.schema(S.RESULT).json(path).select("run_at", F.inline("results"))
    return back.groupBy("category", "status").agg(F.count("*").alias("n"), F.sum(F.size("failures")).alias("failures"))


@query
def action_precision(spark, sf):
    a = A.top_actions(D.pages_aug(spark, sf)).select(F.col("page_id").alias("id"), F.col("label").alias("name"))
    lab = D.pages_aug(spark, sf).select(F.col("page_id").alias("id"), F.explode(F.regexp_extract_all("html", F.lit(r"<li><a href=\"[^\"]*\">([^<]*)</a></li>"), F.lit(1))).alias("name"))
    return E.action_precision(a, lab)


@query
def milestone_gates(spark, sf):
    _, r, res = _evaluated(spark, sf)
    t = res.select("id", "category").join(r.select("id", F.col("meta.timings_ms")["total"].alias("ms")), "id").where("ms is not null")
    return E.exit_criteria(res, t)


@query
def action_stability(spark, sf):
    before, after = A.top_actions(D.pages(spark, sf)), A.top_actions(D.pages_aug(spark, sf))
    return E.stability(before, after)


@query
def locator_stability(spark, sf):
    """Controls of all pages after a link was put before the list of links, or one more of the first link's name behind it."""
    p = D.pages(spark, sf)
    first = F.regexp_extract("html", r'<li><a href="[^"]*">([^<]*)</a></li>', 1)
    kind = F.pmod("page_id", F.lit(3))
    html = F.when(kind == 0, F.replace("html", F.lit("<ul>"), F.lit('<ul><li><a href="/new">Brand new</a></li>')))
    html = html.when(kind == 1, F.replace("html", F.lit("</ul>"), F.concat(F.lit('<li><a href="/x">'), first, F.lit("</a></li></ul>")))).otherwise(F.col("html"))
    return E.locator_stability(written(K.locators(p)), written(K.locators(p.withColumn("html", html))))


# ------------------------------------------------------------------------ contracts
@query
def page_templates(spark, sf):
    return K.fingerprints(D.pages_aug(spark, sf)).select("page_id", "domain", "path_pattern", "shape", "template")


@query
def template_catalogue(spark, sf):
    return K.templates(K.fingerprints(D.pages_aug(spark, sf)))


@query
def template_reuse(spark, sf):
    a, fp = _contracts(spark, sf)
    return K.reuse_actions(fp, a).select("page_id", "rank", "type", "label")


@query
def path_patterns(spark, sf):
    """Patterns of all paths, of the pages' URLs and of shorter ones made of their hosts' names."""
    p = D.pages(spark, sf)
    more = p.select(F.concat(F.lit("https://all.example/u/"), urls.netloc(F.col("url")), F.when(F.col("page_id") % 2 == 0, "/a").otherwise("/b")).alias("url"))
    some = p.select(F.concat(F.lit("https://all.example/s/"), F.substring("url", -1, 1)).alias("url"))
    t = T.path_patterns(p.select("url").unionByName(more).unionByName(some))
    return t.select("domain", F.array_join("tokens", "/").alias("path"), "path_pattern")


@query
def template_families(spark, sf):
    return T.families(D.pages_aug(spark, sf)).select("page_id", "domain", "path_pattern", "shape", "family")


@query
def family_catalogue(spark, sf):
    return T.catalogue(T.families(D.pages_aug(spark, sf)))


@query
def action_ids(spark, sf):
    p = D.pages_aug(spark, sf).withColumn("base", F.col("url"))
    a = X.action_rows(X.extract(p, [], with_template=True), "domain", "template")
    return K.action_ids(a).select("page_id", "rank", "action_id")


@query
def parameter_schemas(spark, sf):
    s = K.param_schema(A.form_fields(D.pages_aug(spark, sf)))
    return s.select("page_id", "schema", F.array_join("passthrough", ",").alias("passthrough"))


@query
def probe_parameters(spark, sf):
    p = K.probe_params(A.form_fields(D.pages_aug(spark, sf)), "2024-01-01")
    return p.select("page_id", "name", "value")


def _guarded(spark, sf):
    return K.guarded(A.candidates(A.page_rows(D.pages_aug(spark, sf), prices=True)))


@query
def destructive_guard(spark, sf):
    return _guarded(spark, sf).select("page_id", "type", "label", "rule", "effect", "verification", "requires_confirm", "confidence_cap")


@query
def action_tiers(spark, sf):
    t = K.tier(A.dedupe(_guarded(spark, sf)), "fast")
    return t.select("page_id", "src", "pos", "label", "tier").drop("pos", "src")


@query
def observed_effects(spark, sf):
    return K.effects(*D.observations(spark, sf))


@query
def lifted_requests(spark, sf):
    r = K.lift(D.lift_log(spark, sf))
    return r.select("request_id", "method", "url_template", F.array_join(F.map_keys("headers"), ",").alias("headers"), "auth")


@query
def lifted_bodies(spark, sf):
    r = K.lift_whole(D.lift_log_whole(spark, sf))
    return r.select("request_id", "method", "url_template", "body_template", "auth", "lifted")


@query
def hinted_fetches(spark, sf):
    """Strategy that each fetch gets from what was learnt of its host."""
    f = D.fetches(spark, sf)
    r = X.responses(f, D.renders(spark, sf)).select(
        F.col("meta.url").alias("url"), F.col("meta.extraction_path").alias("extraction_path"), F.col("error.code").alias("error_code"))
    return R.with_hints(f.select("page_id", "url"), R.domain_hints(r)).select("page_id", "hint")


@query
def action_confidence(spark, sf):
    g = _guarded(spark, sf).where("not noise").withColumns({
        "locator": F.lit("role"), "schema_complete": F.size("parameters") > 0, "age_days": F.pmod("page_id", F.lit(10)),
    })
    return K.confidence(g).select("page_id", "type", "label", "confidence")


@query
def probe_queue(spark, sf):
    p = K.probe_plan(A.top_actions(D.pages_aug(spark, sf)))
    return p.select("page_id", "rank", "spent_ms", "probed", "verification")


@query
def act_lookup(spark, sf):
    r = K.resolve_act(*D.contract_log(spark, sf))
    return r.select("request_id", "action_id", "contract", "error")


@query
def act_lookup_long(spark, sf):
    """Act requests against contracts of which every fourth is valid for ten years."""
    r, c = D.contract_log(spark, sf)
    c = c.withColumn("expires_at", F.when(F.col("contract") % 4 == 0, F.col("created_at") + F.expr("interval 3650 days")).otherwise(F.col("expires_at")))
    return K.resolve_act(r, c).select("request_id", "action_id", "contract", micros("created_at"), "error")


@query
def control_locators(spark, sf):
    return K.locators(D.pages_aug(spark, sf)).select("page_id", "tag", "role", "name", "locator", "pos")


@query
def action_graph(spark, sf):
    return K.action_graph(*_contracts(spark, sf))


@query
def reachable_states(spark, sf):
    """States at most two actions away from the states of the shortest path pattern."""
    a, fp = _contracts(spark, sf)
    edges = written(K.action_graph(a, fp))
    start = fp.where(F.col("path_pattern").startswith("/en/")).select(F.col("template").alias("node")).distinct()
    return K.reachable(edges, start, 2).groupBy("step").agg(F.count("*").alias("states"))


@query
def reachable_all(spark, sf):
    """All states that actions lead to from the states of English pages, with the fewest actions and a way there."""
    a, fp = _contracts(spark, sf)
    edges = written(K.action_graph(a, fp))
    start = fp.where(F.col("path_pattern").startswith("/en/")).select(F.col("template").alias("node")).distinct()
    return K.paths(K.distances(edges, start)).select("node", "step", F.array_join("path", " ").alias("path"))


@query
def usage_metering(spark, sf):
    e = S.table(spark, sf, "events").select(
        (F.col("user_id") % 20).alias("customer"), F.col("event_type").alias("endpoint"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.round(F.col("value") * 100).cast("bigint").alias("cost"),
    )
    return K.usage(e).drop("grp")


@query
def minimal_profiles(spark, sf):
    p = D.pages_aug(spark, sf).withColumn("base", F.col("url"))
    a = X.action_rows(X.extract(p, [], with_template=True), "domain", "template")
    return K.minimal_profile(K.action_ids(a)).select("page_id", "name", "description", "parameters", "execution")


@query
def full_profiles(spark, sf):
    p = D.pages_aug(spark, sf).withColumn("base", F.col("url"))
    a = X.action_rows(X.extract(p, ["url"], with_template=True), "url", "domain", "template")
    g = K.guarded(K.action_ids(a).withColumn("near_price", F.lit(False)))
    f = K.full_profile(g.withColumns({"source_url": F.col("url"), "created_at": F.lit("2024-01-01 00:00:00").cast("timestamp")}))
    return f.select(
        "page_id", "name", "execution", "verification", "effect", "requires_confirm", "source_url", F.col("http.method").alias("method"),
        F.col("http.url_template").alias("url_template"), F.array_join("http.passthrough", ",").alias("passthrough"), micros("expires_at"),
    )


@query
def invokable_actions(spark, sf):
    """Probed actions without anything to confirm."""
    g = K.guarded(A.top(A.candidates(A.page_rows(D.pages_aug(spark, sf), prices=True))))
    p = K.probe_plan(g.drop("verification"))
    v = p.withColumn("verification", F.when(F.col("probed") & F.col("rule").isNull(), "verified").otherwise("inferred"))
    return K.auto_invokable(v).select("page_id", "rank", "label", "effect")


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: Markdown size, tokens and ranked actions of every page, from one exchange of the pages."""
    sf = "/root/testdata/sf0.001"
    p = D.pages(prepare(spark), sf).withColumn("base", F.col("url"))
    r = X.extract(p, ["url"])
    return r.select(
        "page_id", "url", F.length("markdown").alias("chars"), text.token_estimate(F.col("markdown")).alias("tokens"),
        F.posexplode_outer("actions").alias("rank", "a"),
    ).select("page_id", "url", "chars", "tokens", "rank", "a.type", "a.label", "a.target", "a.method", "a.description")


# The operators for training data are a subpackage of their own; without it all else works.
try:
    from pagelake.llm import registry as llm
except ImportError:
    llm = None


def queries() -> dict[str, Query]:
    return {**_QUERIES, **(llm.QUERIES if llm else {})}


def oracle_sql() -> dict[str, str]:
    from oracles import oracle_sql as sql

    return {**sql(), **(llm.ORACLES if llm else {})}
