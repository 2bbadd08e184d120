"""Table jobs on extracted actions: templates, ids, schemas, guards, tiers, effects, lookup, graph, usage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.functions import rules, urls
from pagelake.functions.text import let, short_hash
from pagelake.operators import html as H
from pagelake.session import written

# Tags that shape a page: landmarks, headings, lists, tables and controls.
SHAPE_TAGS = [
    "a", "article", "aside", "button", "footer", "form", "h1", "h2", "h3", "header", "input", "main",
    "nav", "ol", "section", "select", "table", "textarea", "ul",
]


PAGES_PER_PART = 500_000

# ------------------------------------------------------------------------------- templates
def path_pattern(url: Column) -> Column:
    return F.regexp_replace(urls.path(url), r"[0-9]+", "{n}")


def shape() -> Column:
    """Aggregate over a page's start tags: its distinct parent>child pairs of shaping tags, sorted."""
    edge = F.concat(F.coalesce("parent_tag", F.lit("")), F.lit(">"), F.col("tag"))
    is_start = (F.col("kind") == "open") & F.col("tag").isin(SHAPE_TAGS)
    return F.array_join(F.array_sort(F.collect_set(F.when(is_start, edge))), " ")


def template(shape_: Column, url: Column) -> Column:
    return F.concat(F.lit("tpl_"), short_hash(F.concat_ws("|", shape_, path_pattern(url))))


def fingerprints(pages: DataFrame) -> DataFrame:
    """Template of each page: digest of its parent>child shapes (no text, no counts) and its path pattern."""
    els = H.elements(H.tokens(pages, carry=["url"]))
    g = els.groupBy("page_id").agg(F.max("url").alias("url"), shape().alias("shape"))
    return g.select(
        "page_id", "url", urls.netloc(F.col("url")).alias("domain"), path_pattern(F.col("url")).alias("path_pattern"), "shape",
        template(F.col("shape"), F.col("url")).alias("template"),
    )


def templates(fp: DataFrame) -> DataFrame:
    """Catalogue: pages per domain and template, and the page that stands for them (map-side combined)."""
    return fp.groupBy("domain", "template").agg(
        F.count("*").alias("pages"), F.min("page_id").alias("representative"), F.min("path_pattern").alias("path_pattern")
    )


def reuse_actions(fp: DataFrame, actions: DataFrame) -> DataFrame:
    """Actions of the page that represents a template, given to every page of the template.

    ``fp`` and ``actions`` both have page_id, domain and template. A template multiplies each of
    its pages by the action cap at most. Pages of a template too common for one task are spread
    over as many parts as its size calls for, and its few actions are repeated for each part.
    """
    parts = F.ceil(F.col("pages") / PAGES_PER_PART)
    catalogue = templates(fp).withColumn("parts", parts)
    rep = actions.join(
        catalogue.select(F.col("representative").alias("page_id"), "domain", "template", "parts"),
        ["page_id", "domain", "template"],
    ).select("domain", "template", "rank", "type", "label", "method", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    big = catalogue.where("parts > 1").select("domain", "template", "parts")  # at most pages / PAGES_PER_PART rows
    spread = fp.select("page_id", "domain", "template").join(F.broadcast(big), ["domain", "template"], "left").withColumn(
        "part", F.pmod(F.xxhash64("page_id"), F.coalesce("parts", F.lit(1)))
    )
    return spread.join(rep, ["domain", "template", "part"]).drop("parts", "part")


def action_ids(actions: DataFrame) -> DataFrame:
    """Stable ids of actions (with domain and template): domain, template, what the action is, version."""
    semantic = F.concat_ws(":", "type", F.lower("label"), "method")
    ident = F.concat_ws("|", "domain", "template", semantic, F.lit(rules.CONTRACT_VERSION))
    return actions.withColumn("action_id", F.concat(F.lit("act_"), short_hash(ident)))


# ------------------------------------------------------------------------------- parameters
def _number(c: str) -> Column:
    return F.col(c).try_cast("double")


def param_schema(fields: DataFrame) -> DataFrame:
    """JSON Schema of each form's arguments; hidden fields are passed through and not arguments."""
    kind = (
        F.when(F.col("type").isin("number", "range"), "number").when(F.col("type") == "checkbox", "boolean").otherwise("string")
    )
    fmt = F.when(F.col("type") == "email", "email").when(F.col("type") == "url", "uri").when(F.col("type") == "date", "date")
    prop = F.struct(
        kind.alias("type"), F.col("label").alias("description"), F.col("options").alias("enum"), fmt.alias("format"),
        _number("min").alias("minimum"), _number("max").alias("maximum"),
        F.col("maxlength").try_cast("int").alias("maxLength"), F.col("pattern").alias("pattern"),
    )
    arg = F.col("type") != "hidden"
    ordered = lambda cond, v: F.transform(F.array_sort(F.collect_list(F.when(cond, v))), lambda x: x["v"])
    g = fields.groupBy("page_id", "form_pos").agg(
        ordered(arg, F.struct("pos", F.struct(F.col("name").alias("key"), prop.alias("value")).alias("v"))).alias("props"),
        ordered(arg & F.col("required"), F.struct("pos", F.col("name").alias("v"))).alias("required"),
        ordered(~arg, F.struct("pos", F.col("name").alias("v"))).alias("passthrough"),
    )
    schema = F.to_json(F.struct(F.lit("object").alias("type"), F.map_from_entries("props").alias("properties"), "required"))
    return g.select("page_id", "form_pos", schema.alias("schema"), "passthrough")


def probe_params(fields: DataFrame, today: str, email: str = "probe@example.com") -> DataFrame:
    """Representative value of each field; fields that are left out have none."""
    low, high = _number("min"), _number("max")
    mid = F.when(low.isNotNull() & high.isNotNull(), (low + high) / 2).otherwise(F.coalesce(low, high, F.lit(1.0)))
    value = (
        F.when(F.col("type") == "hidden", F.coalesce("value", F.lit("")))
        .when(F.col("tag") == "select", F.get("options", F.lit(0)))
        .when(F.col("type") == "email", email)
        .when(F.col("type").isin("number", "range"), F.regexp_replace(mid.cast("string"), r"\.0$", ""))
        .when(F.col("type") == "date", today)
        .when(F.col("type") == "checkbox", F.when(F.col("required"), "true"))
        .otherwise("test")
    )
    return fields.select("page_id", "form_pos", "name", value.alias("value"))


# ------------------------------------------------------------------------------- guards
def destructive_rule(near_price: Column) -> Column:
    post = (F.col("method") == "POST") & F.coalesce(urls.path(F.col("target")).rlike(rules.SENSITIVE_PATH), F.lit(False))
    priced = F.col("type").isin("form", "button") & F.coalesce(near_price, F.lit(False))
    return (
        F.when(F.col("label").rlike(rules.DESTRUCTIVE_NAME), "name").when(post, "post_path").when(priced, "price_nearby")
    )


def guarded(candidates: DataFrame) -> DataFrame:
    """Verification, effect, confirmation and confidence cap of candidates (with ``near_price``)."""
    c = candidates.withColumn("rule", destructive_rule(F.col("near_price")))
    risky = F.col("rule").isNotNull()
    local = F.lower("description").contains("local")
    effect = (
        F.when(risky, "presumed_mutating").when(local, "local").when(F.col("type") == "link", "navigate")
        .when((F.col("type") == "form") & (F.col("method") == "GET"), "query")
        .when(F.col("type") == "form", "mutating").otherwise("local")
    )
    return c.withColumns(
        {
            "effect": effect,
            "verification": F.when(risky, "unverified").otherwise("inferred"),
            "requires_confirm": effect.isin("mutating", "presumed_mutating"),
            "confidence_cap": F.when(risky, 0.3).otherwise(1.0),
        }
    )


def tier(deduped: DataFrame, mode: str = "verified") -> DataFrame:
    """Cheapest tier that can resolve a candidate (needs noise, nth, rule)."""
    skip = F.col("noise") | (F.col("nth") > 1) | F.col("rule").isNotNull()
    t2 = "t1_light_dom" if mode == "fast" else "t2_browser"
    local = F.lower("description").contains("local")
    t = (
        F.when(skip, "ignore").when(F.col("type").isin("link", "form"), "t0_http").when(local, "t1_light_dom").otherwise(t2)
    )
    return deduped.withColumn("tier", t)


# Our own weights; the parts of the score are given, how they add up is not.
CONFIDENCE_WEIGHTS = {"source": 0.3, "verification": 0.3, "locator": 0.2, "schema": 0.1, "age": 0.1}


def confidence(actions: DataFrame) -> DataFrame:
    """Score from source, verification, locator, schema completeness and age in days."""
    w = CONFIDENCE_WEIGHTS
    source = F.when(F.col("type") == "form", 1.0).when(F.col("type") == "link", 0.9).otherwise(0.6)
    ver = F.when(F.col("verification") == "verified", 1.0).when(F.col("verification") == "inferred", 0.6).otherwise(0.2)
    loc = F.when(F.col("locator") == "role", 1.0).when(F.col("locator") == "testid", 0.8).when(F.col("locator") == "label", 0.6).otherwise(0.3)
    age = F.greatest(F.lit(0.0), 1 - F.col("age_days") / 30)
    score = (
        source * w["source"] + ver * w["verification"] + loc * w["locator"] + F.col("schema_complete").cast("double") * w["schema"] + age * w["age"]
    )
    return actions.withColumn("confidence", F.round(F.least(score, F.col("confidence_cap")), 4))


def probe_plan(actions: DataFrame, cost_ms: int = rules.PROBE_COST_MS, limit: int = rules.PROBES_PER_PAGE, budget_ms: int = rules.PROBE_BUDGET_MS) -> DataFrame:
    """Which ranked actions of a page are probed within its count and time budget; the rest stay inferred."""
    w = W.partitionBy("page_id").orderBy("rank")
    spent = F.sum(F.lit(cost_ms)).over(w.rowsBetween(W.unboundedPreceding, 0))
    a = actions.withColumns({"place": F.row_number().over(w), "spent_ms": spent})
    ok = (F.col("place") <= limit) & (F.col("spent_ms") <= budget_ms)
    return a.withColumns({"probed": ok, "verification": F.when(ok, "queued").otherwise("inferred")})


# ------------------------------------------------------------------------------- observations
def effects(net: DataFrame, nav: DataFrame, dom: DataFrame) -> DataFrame:
    """Effect class of each candidate from its logged requests, navigations and document changes.

    The three logs become one narrow stream of flags and meet in one map-side combined
    aggregate, so the logs are shuffled once, as one row per candidate and task.
    """
    kept = ~(F.col("url").rlike(rules.STATIC_ASSET) | urls.netloc(F.col("url")).rlike(rules.ANALYTICS_HOST))
    # A small read is a beacon; a write counts at any size.
    large = F.coalesce(F.col("bytes"), F.lit(1 << 30)) >= rules.BEACON_MAX_BYTES
    no = F.lit(False)
    flags = lambda nav_, mut, qry, dlg, loc: [
        "candidate_id", nav_.alias("nav"), mut.alias("mut"), qry.alias("qry"), dlg.alias("dlg"), loc.alias("loc")
    ]
    writes = F.col("method").isin("POST", "PUT", "PATCH", "DELETE")
    reads = (F.col("method") == "GET") & F.coalesce(F.col("mime").rlike("json|html"), no)
    log = (
        net.select(*flags(no, kept & writes, kept & large & reads, no, no))
        .unionByName(nav.select(*flags(F.col("from_url") != F.col("to_url"), no, no, no, no)))
        .unionByName(dom.select(*flags(no, no, no, F.col("dialog_opened"), (F.col("added") + F.col("removed")) > 0)))
    )
    g = log.groupBy("candidate_id").agg(*[F.max(c).alias(c) for c in ("nav", "mut", "qry", "dlg", "loc")])
    changed = F.col("loc") | F.col("dlg")
    effect = (
        F.when(F.col("nav"), "navigate").when(F.col("mut"), "mutating").when(F.col("qry") & changed, "query")
        .when(F.col("dlg"), "dialog").when(F.col("loc") & ~F.col("qry"), "local").otherwise("dead")
    )
    return g.select("candidate_id", effect.alias("effect"))


def lift(net: DataFrame) -> DataFrame:
    """HTTP contract of observed requests: values of parameters become placeholders, connection headers go."""
    # A query value is replaced when it is, as a whole, the value of a parameter.
    named = lambda v: F.get(F.map_keys(F.map_filter("params", lambda k, x: (x == v) & (x != ""))), F.lit(0))
    value = lambda p: F.regexp_extract(p, r"^[^=]*=(.*)$", 1)
    parts = F.transform(
        F.split(urls.query(F.col("url")), "&"),
        lambda p: F.when(
            named(value(p)).isNotNull(),
            F.concat(F.regexp_extract(p, r"^([^=]*=)", 1), F.lit("{"), named(value(p)), F.lit("}")),
        ).otherwise(p),
    )
    template = F.when(
        urls.query(F.col("url")) != "",
        F.concat(F.regexp_extract("url", r"^([^?#]*)", 1), F.lit("?"), F.array_join(parts, "&")),
    ).otherwise(F.col("url"))
    headers = F.map_filter("headers", lambda k, v: ~F.lower(k).isin(rules.HOP_HEADERS))
    cookie = F.exists(F.map_keys("headers"), lambda k: F.lower(k) == "cookie")
    return net.select(
        "request_id", "method", template.alias("url_template"), headers.alias("headers"),
        F.when(cookie, "cookie").otherwise("none").alias("auth"),
    )


def _plain(value: Column) -> Column:
    """A segment or form value as the parameter it came from was written; null if its escapes are broken."""
    return F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%20")))


def _placeholder(value: Column) -> Column:
    """``{name}`` of the first parameter (by name) whose whole value this is; null if there is none."""
    names = F.array_sort(F.map_keys(F.map_filter("params", lambda k, x: (x == value) & (x != ""))))
    return F.concat(F.lit("{"), F.get(names, F.lit(0)), F.lit("}"))


def _form(text: Column) -> Column:
    """``a=1&b=2`` with placeholders for values of parameters."""

    def pair(p: Column) -> Column:
        named = _placeholder(_plain(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)))
        return F.when(p.contains("=") & named.isNotNull(), F.concat(F.regexp_extract(p, "^[^=]*=", 0), named)).otherwise(p)

    return F.array_join(F.transform(F.split(text, "&"), pair), "&")


# A string, number or word of a JSON text, and what parts them.
_JSON_PARTS = r'"(?:[^"\\]++|\\.)*+"|[^"{}\[\]:,\s]++|[{}\[\]:,\s]++|"'


def _json(text: Column) -> Column:
    """A JSON text in which values (not names) that equal a parameter are placeholders; strings stay strings."""
    parts = F.regexp_extract_all(text, F.lit(_JSON_PARTS), F.lit(0))

    def shown(p: Column, after: Column) -> Column:
        is_text = p.startswith('"')
        value = F.when(is_text, F.get_json_object(F.concat(F.lit('{"v":'), p, F.lit("}")), "$.v")).otherwise(p)
        named = _placeholder(value)
        name_of_field = is_text & F.coalesce(after.rlike(r"^\s*:"), F.lit(False))
        quote = F.when(is_text, F.lit('"')).otherwise("")
        return F.when(named.isNotNull() & ~name_of_field, F.concat(quote, named, quote)).otherwise(p)

    return let(parts, lambda x: F.array_join(F.transform(x, lambda p, i: shown(p, F.get(x, i + 1))), ""))


def lift_whole(net: DataFrame) -> DataFrame:
    """HTTP contract with placeholders in path, query and body of observed requests (request_id, method, url, params, headers, body).

    A path segment, form value or JSON value is replaced if it is, as a whole and unescaped, the value of a parameter. Bodies
    that are neither a form nor JSON (by their content type) stay as they are. ``lifted`` tells whether every parameter
    with a value found a place.
    """
    kind = F.lower(F.coalesce(F.get(F.map_values(F.map_filter("headers", lambda k, v: F.lower(k) == "content-type")), F.lit(0)), F.lit("")))
    start = F.regexp_extract("url", r"^([^:/?#]+:)?(//[^/?#]*)?", 0)
    segment = lambda x: F.coalesce(_placeholder(F.try_url_decode(x)), x)
    path = F.array_join(F.transform(F.split(urls.path(F.col("url")), "/"), segment), "/")
    query = urls.query(F.col("url"))
    template = F.concat(start, path, F.when(query != "", F.concat(F.lit("?"), _form(query))).otherwise(""))
    body = F.when(kind.contains("json"), _json(F.col("body"))).when(kind.contains("form-urlencoded"), _form(F.col("body"))).otherwise(F.col("body"))
    headers = F.map_filter("headers", lambda k, v: ~F.lower(k).isin(rules.HOP_HEADERS))
    cookie = F.exists(F.map_keys("headers"), lambda k: F.lower(k) == "cookie")
    out = net.select("request_id", "method", "params", template.alias("url_template"), body.alias("body_template"), headers.alias("headers"), F.when(cookie, "cookie").otherwise("none").alias("auth"))
    places = F.concat_ws(" ", "url_template", "body_template")
    found = F.forall(F.map_entries("params"), lambda p: (p["value"] == "") | places.contains(F.concat(F.lit("{"), p["key"], F.lit("}"))))
    return out.select("request_id", "method", "url_template", "body_template", "headers", "auth", F.coalesce(found, F.lit(False)).alias("lifted"))


# ------------------------------------------------------------------------------- lookup
def _reigns(rows: pd.DataFrame) -> pd.DataFrame:
    """Stretches of time in which one contract of an action is the newest valid one; the contract is null between them.

    ``rows`` are the versions of one action. Walks through them by start and keeps those that outlive all newer ones.
    """
    rows = rows.sort_values(["created", "contract", "requires_confirm"])
    alive: list[tuple[int, str]] = []  # ends and versions, newest last, ends falling
    out: list[tuple[int, str | None]] = []

    def until(now: float) -> None:
        while alive and alive[-1][0] <= now:
            end, _ = alive.pop()
            out.append((end, alive[-1][1] if alive else None))

    for created, expires, version in zip(rows["created"].tolist(), rows["expires"].tolist(), rows["version"].tolist()):
        until(created)
        while alive and alive[-1][0] <= expires:
            alive.pop()
        alive.append((expires, version))
        out.append((created, version))
    until(float("inf"))
    last = dict(out)  # of several changes at one time the last holds
    return pd.DataFrame({"action_id": rows["action_id"].iloc[0], "at": list(last), "version": list(last.values())})


def reigns(contracts: DataFrame) -> DataFrame:
    """action_id, at, version: which contract (by a JSON of its columns) is the newest valid one from ``at`` on.

    A contract takes two rows at most, however long it lives. Only the versions of one action are brought together; they
    are as many as its verifications, not its requests.
    """
    # A contract that ends before it starts is never valid.
    c = contracts.where("created_at < expires_at").select(
        "action_id", "contract", "requires_confirm", F.unix_micros("created_at").alias("created"), F.unix_micros("expires_at").alias("expires"),
        F.to_json(F.struct("contract", "requires_confirm", F.unix_micros("created_at").alias("created"))).alias("version"))
    return c.groupBy("action_id").applyInPandas(_reigns, "action_id string, at long, version string")


def resolve_act(requests: DataFrame, contracts: DataFrame) -> DataFrame:
    """Newest contract valid at the time of each act request; or why there is none. ``request_id`` names requests.

    An as-of join: requests and changes of contracts stand in one table ranged by action and time. A much-used action
    takes several ranges; what holds at the end of a range is carried to the next ones of the action.
    """
    at = F.unix_micros("ts").alias("at")
    kind = dict(requests.dtypes)["request_id"]
    changes = reigns(contracts).select("action_id", "at", F.struct("version").alias("change"), F.lit(None).cast(f"struct<id:{kind}>").alias("r"))
    asked = requests.select("action_id", at, F.lit(None).cast("struct<version:string>").alias("change"), F.struct(F.col("request_id").alias("id")).alias("r"))
    # Changes at the time of a request come before it.
    order = [F.col("at"), F.col("r").isNotNull()]
    ranged = changes.unionByName(asked).repartitionByRange("action_id", *order).withColumn("part", F.spark_partition_id())
    ranged = written(ranged)
    ends = ranged.where("change is not null").groupBy("action_id", "part").agg(F.max_by("change", "at").alias("change"))
    parts = ranged.groupBy("action_id", "part").agg(F.count("*").alias("n")).join(ends, ["action_id", "part"], "left")
    before = W.partitionBy("action_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = parts.select("action_id", "part", F.last("change", ignorenulls=True).over(before).alias("change")).where("change is not null")
    carried = carried.select("action_id", F.lit(-(1 << 62)).alias("at"), "change", F.lit(None).cast(f"struct<id:{kind}>").alias("r"), "part")
    run = W.partitionBy("action_id", "part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    held = ranged.unionByName(carried).withColumn("held", F.last("change", ignorenulls=True).over(run)).where("r is not null")
    types = dict(contracts.dtypes)
    version = F.from_json("held.version", f"contract {types['contract']}, requires_confirm boolean, created bigint")
    hit = held.select(F.col("r.id").alias("request_id"), version.alias("v")).where("v is not null")
    hit = hit.select("request_id", F.struct(F.timestamp_micros("v.created").alias("created_at"), "v.contract", "v.requires_confirm").alias("c"))
    j = requests.join(hit, "request_id", "left")
    err = F.when(F.col("c").isNull(), "action_not_found").when(
        F.col("c.requires_confirm") & ~F.coalesce(F.col("confirm"), F.lit(False)), "mutating_not_confirmed"
    )
    return j.select(*requests.columns, F.col("c.contract").alias("contract"), F.col("c.created_at").alias("created_at"), err.alias("error"))


def locators(pages: DataFrame) -> DataFrame:
    """Best locator of each control: role and name, test id, label, or place; the first that is unique on its page."""
    from pagelake.operators import actions as A

    el = A.labelled(A.rows(A.page_rows(pages, ["data-testid", "data-test"]))).where(
        F.col("tag").isin("a", "button", "input", "select", "textarea")
    )
    role = (
        F.when(A.truthy(F.col("a.role")).isNotNull(), F.col("a.role"))
        .when(F.col("tag") == "a", "link")
        .when((F.col("tag") == "button") | F.coalesce(F.col("a.type") == "submit", F.lit(False)), "button")
        .when(F.col("tag") == "select", "combobox")
        .when(F.coalesce(F.col("a.type").isin("checkbox", "radio"), F.lit(False)), F.col("a.type"))
        .otherwise("textbox")
    )
    el = el.withColumns(
        {
            "role": role,
            "testid": F.coalesce(A.truthy(F.col("a.data_testid")), A.truthy(F.col("a.data_test")), A.truthy(F.col("a.id"))),
            "by_label": A.truthy(F.col("a.aria_label")),
        }
    )
    count = lambda *k: F.count("*").over(W.partitionBy("page_id", *k))
    el = el.withColumns({"n_role": count("role", "label"), "n_test": count("testid"), "n_label": count("by_label")})
    best = (
        F.when((F.col("label") != "unnamed") & (F.col("label") != "") & (F.col("n_role") == 1), "role")
        .when(F.col("testid").isNotNull() & (F.col("n_test") == 1), "testid")
        .when(F.col("by_label").isNotNull() & (F.col("n_label") == 1), "label")
        .otherwise("structural")
    )
    return el.select("page_id", "pos", "tag", "role", F.col("label").alias("name"), "testid", best.alias("locator"))


# ------------------------------------------------------------------------------- graph
def action_graph(actions: DataFrame, fp: DataFrame) -> DataFrame:
    """Edges between page templates: type of action, and how many actions support them.

    Actions (with their page's template) are counted per source template and target before the
    join, so a target that a third of all links lead to arrives as one row per source template.
    Targets that were not seen as pages stand for themselves by host and path pattern.
    """
    src = actions.select(F.col("template").alias("src"), "type", "target")
    counted = src.groupBy("src", "type", "target").agg(F.count("*").alias("n"))
    pages = fp.groupBy("url").agg(F.min("template").alias("dst"))
    j = counted.join(pages, counted["target"] == pages["url"], "left")
    unseen = F.concat(F.lit("unseen:"), urls.netloc(F.col("target")), path_pattern(F.col("target")))
    return j.groupBy("src", F.coalesce("dst", unseen).alias("dst"), "type").agg(F.sum("n").alias("support"))


def reachable(edges: DataFrame, starts: DataFrame, steps: int | None = None) -> DataFrame:
    """node, step: templates reachable from ``starts`` (column ``node``) with the fewest actions; within ``steps``, or all there are."""
    return distances(edges, starts, steps).select("node", "step")


def distances(edges: DataFrame, starts: DataFrame, steps: int | None = None) -> DataFrame:
    """node, step, by: fewest actions from ``starts`` (column ``node``) to each node of ``edges`` (src, dst), and the node before it (the smallest, null for starts).

    Each round joins only what the round before found for the first time, and is written; it ends when nothing is new.
    """
    links = written(edges.where("src <> dst").select("src", "dst").distinct())
    found = frontier = written(starts.where("node is not null").select("node").distinct().select("node", F.lit(0).alias("step"), F.lit(None).cast("string").alias("by")))
    step = 0
    while steps is None or step < steps:
        step += 1
        nxt = links.join(frontier.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("by"))
        frontier = written(nxt.join(found.select("node"), "node", "left_anti").select("node", F.lit(step).alias("step"), "by"))
        if not frontier.limit(1).count():
            break
        found = written(found.unionByName(frontier))
    return found


def paths(reached: DataFrame) -> DataFrame:
    """node, step, path: a shortest way to each node of ``distances``, from its start on. As many rounds as the longest way has steps."""
    out = written(reached.where("step = 0").select("node", "step", F.array("node").alias("path")))
    done, last = out, reached.agg(F.max("step")).first()[0] or 0
    for step in range(1, last + 1):
        here = reached.where(F.col("step") == step).select("node", "step", "by")
        out = written(here.join(out.select(F.col("node").alias("by"), "path"), "by").select("node", "step", F.concat("path", F.array("node")).alias("path")))
        done = done.unionByName(out)
    return done


def usage(events: DataFrame) -> DataFrame:
    """Requests and cost per customer, endpoint and day, with all sub-totals."""
    return (
        events.cube("customer", "endpoint", "day")
        .agg(F.count("*").alias("requests"), F.sum("cost").alias("cost"), F.grouping_id().alias("grp"))
    )


# ------------------------------------------------------------------------------- projections
def action_name(label: Column) -> Column:
    """Snake-case tool name of a label."""
    s = F.regexp_replace(F.lower(label), r"[^a-z0-9]+", "_")
    s = F.regexp_replace(s, r"^[^a-z]+|_+$", "")
    s = F.substring(s, 1, 64)
    return F.when(F.length(s) >= 3, s).otherwise(F.concat(F.lit("do_"), F.when(s == "", "action").otherwise(s)))


def minimal_profile(actions: DataFrame) -> DataFrame:
    """id, name, description, parameters, execution."""
    execution = F.when(F.col("type") == "button", "browser").otherwise("http")
    return actions.select(
        "page_id", F.col("action_id").alias("id"), action_name(F.col("label")).alias("name"), "description",
        F.array_join(F.map_keys("parameters"), ",").alias("parameters"), execution.alias("execution"),
    )


def full_profile(actions: DataFrame, life: str = "interval 1 day") -> DataFrame:
    """The whole contract: minimal profile, guard results, HTTP form, source and end of life.

    ``actions`` come from ``guarded`` with action_id, source_url and created_at.
    """
    http = F.when(
        F.col("type") != "button",
        F.struct(
            "method",
            F.col("target").alias("url_template"),
            F.when(F.col("method") == "POST", "application/x-www-form-urlencoded").alias("content_type"),
            F.filter(F.map_keys("parameters"), lambda k: F.element_at("parameters", k)["type"] == "hidden").alias("passthrough"),
        ),
    )
    return actions.select(
        "page_id", F.col("action_id").alias("id"), action_name(F.col("label")).alias("name"), "description", "parameters",
        F.when(F.col("type") == "button", "browser").otherwise("http").alias("execution"),
        http.alias("http"), "verification", F.col("confidence_cap").alias("confidence"), "effect",
        F.col("effect").isin("mutating", "presumed_mutating").alias("requires_confirm"),
        "source_url", (F.col("created_at") + F.expr(life)).alias("expires_at"),
    )


def auto_invokable(actions: DataFrame) -> DataFrame:
    """Actions an agent may call by itself: verified, and nothing to confirm."""
    return actions.where((F.col("verification") == "verified") & ~F.col("requires_confirm"))
