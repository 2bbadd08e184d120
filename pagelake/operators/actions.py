"""Actions of every page: forms, links, buttons and submit controls, named, de-duplicated and ranked.

All steps are expressions, windows and aggregates whose keys start with ``page_id``; they stay
on the partitioning of the page exchange. A field belongs to its form, and an option to its
select, through running contexts, not through a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.functions import rules, urls
from pagelake.functions.text import short_hash, strip
from pagelake.operators import html as H
from pagelake.operators import markdown as M

TAGS = ["form", "a", "button", "input", "select", "textarea", "option", "label", "legend"]
PARAMETERS = "map<string,struct<type:string,label:string,required:boolean,options:array<string>>>"
_READ = [
    "id", "for", "name", "type", "href", "action", "method", "onclick", "role", "value",
    "aria-label", "title", "placeholder",
]


def truthy(c: Column) -> Column:
    return F.when(c != "", c)


def needs_host_search(pages: DataFrame) -> Column:
    """Rule number (1, 2, ...) of the host rule a page calls for; null when none applies."""
    host = F.lower(urls.netloc(F.col("url")))
    out = F.lit(None).cast("int")
    for i, (h, pattern, _, _) in reversed(list(enumerate(rules.HOST_SEARCH_RULES, 1))):
        out = F.when((host == h) & F.col("html").rlike(pattern), F.lit(i)).otherwise(out)
    return out


def element_fields(more: list[str] | None = None, *extra: Column) -> Column:
    """What action rules read from a start tag; ``more`` attributes and ``extra`` columns on demand."""
    a = F.col("attrs")
    return M.collected_elements(
        TAGS,
        F.struct(
            *[a[k].alias(k.replace("-", "_")) for k in _READ + (more or [])],
            a["required"].isNotNull().alias("required"),
            *extra,
        ).alias("a"),
        F.coalesce("parent_pos", F.lit(0)).alias("parent_pos"),
        F.coalesce("parent_epos", F.lit(1 << 29)).alias("parent_epos"),
        (F.col("nav_depth") > 0).alias("in_nav"),
        "form_pos",
        "select_pos",
    )


def rows(page_rows: DataFrame) -> DataFrame:
    """One row per element of interest, and row 0 per page, with the element's text.

    ``page_rows`` has page_id, texts, els and the page's own ``base`` and ``host_rule``; an
    optional struct ``payload`` travels on row 0.
    """
    load = "payload" in page_rows.columns
    load_type = page_rows.schema["payload"].dataType if load else None
    extra = lambda c: [c.alias("payload")] if load else []
    page_el = F.struct(
        F.lit(0).alias("pos"), F.lit("#page").alias("tag"), F.lit(None).cast("string").alias("text"),
        F.get("els", F.lit(0))["a"].alias("a"),
        F.lit(0).alias("parent_pos"), F.lit(0).alias("parent_epos"), F.lit(False).alias("in_nav"),
        F.lit(None).cast("int").alias("form_pos"), F.lit(None).cast("int").alias("select_pos"),
        F.col("host_rule").alias("host_rule"),
        *extra(F.col("payload")),
    )
    els = F.transform("els", lambda e: F.struct(
        e["pos"].alias("pos"), e["tag"].alias("tag"), M._slice_text(F.col("texts"), e, "").alias("text"),
        e["a"].alias("a"), e["parent_pos"].alias("parent_pos"), e["parent_epos"].alias("parent_epos"),
        e["in_nav"].alias("in_nav"), e["form_pos"].alias("form_pos"), e["select_pos"].alias("select_pos"),
        F.lit(None).cast("int").alias("host_rule"),
        *extra(F.lit(None).cast(load_type or "string")),
    ))
    out = page_rows.withColumn("parts", urls.base_parts(F.col("base")))
    return out.select("page_id", F.col("parts").alias("base"), F.inline(F.concat(F.array(page_el), els)))


def labelled(el: DataFrame) -> DataFrame:
    """Accessible label of each element.

    A ``label[for=id]`` inside the parent element wins. It is looked up as the next label of
    that id after the parent's start: an as-of lookup by window, one row per element.
    """
    is_label = F.col("tag") == "label"
    key = F.when(is_label, truthy(F.col("a.for"))).otherwise(truthy(F.col("a.id")))
    at = F.when(is_label, F.col("pos")).otherwise(F.col("parent_pos"))
    el = el.withColumns({"_key": key, "_at": at})
    ahead = (
        W.partitionBy("page_id", "_key").orderBy(F.desc("_at"), is_label.cast("int")).rowsBetween(W.unboundedPreceding, -1)
    )
    el = el.withColumn("_lab", F.last(F.when(is_label, F.struct("pos", "text")), ignorenulls=True).over(ahead))
    found = F.col("_key").isNotNull() & (F.col("_lab.pos") <= F.col("parent_epos")) & (F.col("_lab.pos") > F.col("parent_pos"))
    aria = F.coalesce(truthy(F.col("a.aria_label")), truthy(F.col("a.title")), truthy(F.col("a.placeholder")))
    label = (
        F.when(found, F.col("_lab.text"))
        .when(aria.isNotNull(), strip(aria))
        .otherwise(F.coalesce(truthy(F.col("text")), truthy(F.col("a.name")), F.lit("unnamed")))
    )
    return el.withColumn("label", label).drop("_key", "_at", "_lab")


def _with_options(el: DataFrame) -> DataFrame:
    """Fold option rows into their select: texts of options with a value, at most the first 20."""
    option = F.col("tag") == "option"
    in_select = option & F.col("select_pos").isNotNull()
    keep = [c for c in el.columns if c not in ("page_id", "select_pos")]
    el = el.where((~option) | (in_select & (F.col("a.value") != "")))
    g = el.groupBy("page_id", F.when(option, F.col("select_pos")).otherwise(F.col("pos")).alias("_unit")).agg(
        F.any_value(F.when(~option, F.struct(*keep)), F.lit(True)).alias("r"),
        F.transform(
            F.slice(F.sort_array(F.collect_list(F.when(option, F.struct("pos", "text")))), 1, rules.MAX_OPTIONS),
            lambda x: x["text"],
        ).alias("options"),
    )
    return g.where("r is not null").select("page_id", "r.*", F.when(F.size("options") > 0, F.col("options")).alias("options"))


def units(el: DataFrame) -> DataFrame:
    """One row per action candidate: forms with what their fields say, links, loose buttons and submits."""
    tag, a = F.col("tag"), F.col("a")
    field = tag.isin("input", "select", "textarea")
    in_form = F.col("form_pos").isNotNull()
    name = truthy(F.col("a.name"))
    el = _with_options(el.where(tag != "label"))
    unit = (
        F.when(tag.isin("form", "a", "#page"), F.col("pos"))
        .when(in_form & (field | tag.isin("button", "legend")), F.col("form_pos"))
        .when(~in_form & ((tag == "button") | ((tag == "input") & (F.col("a.type") == "submit"))), F.col("pos"))
    )
    part = in_form & (tag != "form")
    submit = part & tag.isin("button", "input") & (F.col("a.type") == "submit")
    param = part & field & name.isNotNull() & F.coalesce(F.col("a.type") != "submit", F.lit(True))
    shown = part & field & name.isNotNull() & ~F.coalesce(F.col("a.type").isin("submit", "hidden", "button"), F.lit(False))
    searchy = part & tag.isin("input", "select") & (
        (F.coalesce(F.col("a.type"), F.lit("text")) == "search") | F.coalesce(name, F.lit("")).rlike(rules.SEARCH)
    )
    lone = ~tag.isin("form", "legend") & ~(part & ~tag.isin("a"))
    el = el.withColumns(
        {
            "unit": unit, "pname": F.when(param, name), "is_submit": submit, "is_shown": shown, "is_searchy": searchy,
            "is_lone": lone, "is_form": tag == "form", "is_legend": part & (tag == "legend"),
        }
    ).where("unit is not null")
    param, submit, searchy, lone = F.col("pname").isNotNull(), F.col("is_submit"), F.col("is_searchy"), F.col("is_lone")
    value = F.struct(
        F.coalesce(F.col("a.type"), F.lit("text")).alias("type"),
        F.col("label").alias("label"),
        F.when(F.col("a.required"), F.lit(True)).alias("required"),
        F.when(tag == "select", F.col("options")).alias("options"),
    )
    payload = [F.any_value("payload", F.lit(True)).alias("payload")] if "payload" in el.columns else []
    if "near_price" in el.schema["a"].dataType.names:
        payload.append(F.max(F.when(submit | lone, F.col("a.near_price"))).alias("near_price"))
    by_name = el.groupBy("page_id", "unit", "pname").agg(
        F.min(F.when(param, F.col("pos"))).alias("first_pos"),
        F.max(F.when(param, F.struct("pos", value.alias("v")))).alias("last"),
        F.max("base").alias("base"),
        F.max(F.when(F.col("is_form"), F.struct(F.col("a.action").alias("action"), F.col("a.method").alias("method")))).alias("form"),
        F.min(F.when(submit, F.struct("pos", "label"))).alias("submit"),
        F.min(F.when(F.col("is_legend"), F.struct("pos", "text"))).alias("legend"),
        F.min(F.when(searchy, F.struct("pos", "label"))).alias("search_field"),
        F.max("is_shown").alias("shown"),
        F.max(F.when(lone, F.struct(
            "tag", "label", F.col("a.href").alias("href"), F.col("a.onclick").alias("onclick"),
            F.col("a.role").alias("role"), "in_nav", "host_rule"))).alias("lone"),
        *payload,
    )
    entry = F.struct("first_pos", F.col("pname").alias("key"), F.col("last.v").alias("value"))
    return by_name.groupBy("page_id", F.col("unit").alias("pos")).agg(
        F.map_from_entries(F.transform(
            F.sort_array(F.collect_list(F.when(F.col("pname").isNotNull(), entry))),
            lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")),
        )).cast(PARAMETERS).alias("parameters"),
        F.max("base").alias("base"),
        F.max("form").alias("form"),
        F.min("submit").alias("submit"),
        F.min("legend").alias("legend"),
        F.min("search_field").alias("search_field"),
        F.coalesce(F.max("shown"), F.lit(False)).alias("shown"),
        F.max("lone").alias("lone"),
        *[F.any_value(c, F.lit(True)).alias(c) if c == "payload" else F.max(c).alias(c) for c in ("payload", "near_price") if c in by_name.columns],
    )


def _any_search_key() -> Column:
    return F.exists(F.map_keys("parameters"), lambda k: k.rlike(rules.SEARCH))


def form_labels(u: DataFrame) -> DataFrame:
    """Search flag and label of form units."""
    keys = F.map_keys("parameters")
    author_tag = F.array_contains(keys, "author") & F.array_contains(keys, "tag")
    submit_hit = F.coalesce(F.col("submit.label").rlike(rules.SEARCH), F.lit(False))
    action = F.coalesce(F.col("form.action"), F.lit(""))
    base_hit = (
        _any_search_key() | submit_hit | author_tag
        | action.rlike(rules.SEARCH) | F.lower(action).contains("filter.aspx")
    )
    search_label = (
        F.when(author_tag, F.lit("Search quotes"))
        .when(
            F.col("search_field").isNotNull(),
            F.when(F.col("search_field.label").isin("", "unnamed"), F.lit("Search")).otherwise(F.col("search_field.label")),
        )
        .when(submit_hit & (F.col("submit.label") != ""), F.col("submit.label"))
        .otherwise(F.lit("Search"))
    )
    first = (
        F.when(base_hit, search_label)
        .when(F.col("legend").isNotNull(), F.col("legend.text"))
        .when(F.col("submit").isNotNull(), F.col("submit.label"))
        .otherwise(F.lit("form"))
    )
    u = u.withColumns({"_first": first, "_base_hit": base_hit, "_search_label": search_label})
    u = u.withColumn("is_search", F.col("_base_hit") | F.col("_first").rlike(rules.SEARCH))
    return u.withColumns(
        {
            "form_label": F.when(F.col("is_search"), F.col("_search_label")).otherwise(F.col("_first")),
            "form_noise": F.col("_first").rlike(rules.NOISE_LABEL),
            "trivial": ~F.col("shown") & (F.size("parameters") == 0) & F.col("submit").isNotNull(),
        }
    ).drop("_first", "_base_hit", "_search_label")


def candidates(page_rows: DataFrame) -> DataFrame:
    """Actions before de-duplication, in list order (``src``, ``pos``); ``noise`` marks labels never offered.

    With a ``payload`` in ``page_rows``, one more row per page (null type) brings it along.
    """
    u = form_labels(units(labelled(rows(page_rows))))
    tag = F.when(F.col("form").isNotNull(), F.lit("form")).otherwise(F.col("lone.tag"))
    href, onclick = F.col("lone.href"), F.coalesce(F.col("lone.onclick"), F.lit(""))
    jump = truthy(F.regexp_extract(onclick, rules.LOCATION_HREF, 1))
    base, parts = F.col("base.url"), F.col("base")
    ref = (
        F.when(tag == "form", F.coalesce(truthy(F.col("form.action")), base))
        .when(tag == "a", href)
        .when(tag == "button", jump)
    )
    u = u.withColumns({"tag": tag, "ref": ref, "jump": jump})
    u = u.withColumn("resolved", urls.resolve_parts(F.col("ref"), parts))
    tag, label = F.col("tag"), F.when(F.col("tag") == "form", F.col("form_label")).otherwise(F.col("lone.label"))
    u = u.withColumn("label", label)
    label = F.col("label")
    hash_link = href.startswith("#")
    onclick_local = (onclick != "") & onclick.rlike(rules.LOCAL_ONCLICK)
    link_ok = (
        truthy(href).isNotNull()
        & ~href.rlike(r"^(javascript:|mailto:)")
        & (F.length(label) >= 2)
        & (hash_link | (href.startswith("/") & ~href.startswith("//")) | (urls.netloc(F.col("resolved")) == parts["host"]))
    )
    ok = (
        F.when(tag == "form", ~F.col("trivial"))
        .when(tag == "a", link_ok)
        .when(tag.isin("button", "input"), label != "")
        .when(tag == "#page", F.col("lone.host_rule").isNotNull())
        .otherwise(False)
    )
    noise = F.when(tag == "form", F.col("form_noise")).when(tag == "#page", F.lit(False)).otherwise(label.rlike(rules.NOISE_LABEL))
    method = F.when(tag == "form", F.upper(F.coalesce(truthy(F.col("form.method")), F.lit("GET")))).otherwise("GET")
    target = (
        F.when(tag == "form", F.col("resolved"))
        .when((tag == "a") & hash_link, F.concat(base, href))
        .when((tag == "a") & onclick_local, base)
        .when(tag == "a", F.col("resolved"))
        .when((tag == "button") & F.col("jump").isNotNull(), F.col("resolved"))
        .otherwise(base)
    )
    say = F.format_string
    section = F.coalesce(truthy(F.substr(href, F.lit(2))), label)
    in_nav = F.col("lone.in_nav") | F.coalesce(F.col("lone.role") == "menuitem", F.lit(False))
    description = (
        F.when((tag == "form") & F.col("is_search"), rules.DESCRIBE_SEARCH)
        .when(tag == "form", say(rules.DESCRIBE_FORM, label, method, F.col("resolved")))
        .when((tag == "a") & hash_link, say(rules.DESCRIBE_SECTION, section))
        .when((tag == "a") & onclick_local, say(rules.DESCRIBE_LOCAL_LINK, label))
        .when((tag == "a") & label.rlike(rules.PAGINATION), say(rules.DESCRIBE_PAGINATION, label))
        .when((tag == "a") & in_nav, say(rules.DESCRIBE_NAVIGATION, label))
        .when(tag == "a", say(rules.DESCRIBE_LINK, label))
        .when((tag == "button") & F.col("jump").isNull() & onclick_local, say(rules.DESCRIBE_LOCAL_BUTTON, label))
        .when(tag == "button", say(rules.DESCRIBE_BUTTON, label))
        .otherwise(say(rules.DESCRIBE_SUBMIT, label))
    )
    kind = F.when(tag == "form", "form").when(tag == "a", "link").when(tag == "#page", "form").otherwise("button")
    src = F.when(tag == "form", 0).when(tag == "a", 1).when(tag == "button", 2).when(tag == "input", 3).otherwise(4)
    load = [F.col(c) for c in ("payload", "near_price") if c in u.columns]
    kept = ok | (F.col("tag") == "#page") if "payload" in u.columns else ok
    # The condition is applied behind the next window: pushed down, it would repeat the expressions it is made of.
    out = u.select(
        "page_id", F.coalesce(kept, F.lit(False)).alias("_ok"), src.alias("src"), "pos", F.coalesce(noise, F.lit(False)).alias("noise"), kind.alias("type"),
        "label", target.alias("target"), method.alias("method"), "parameters", description.alias("description"),
        "base", F.col("lone.host_rule").alias("host_rule"), *load,
    )
    return _host_search(out)


def _host_search(c: DataFrame) -> DataFrame:
    """Keep the page row as a search form only where a host rule applies and nothing offered is a search."""
    page = W.partitionBy("page_id")
    blob = F.concat_ws(" ", "label", "description", "target")
    # Only pages a host rule calls for need the test.
    c = c.withColumn("_ruled", F.max("host_rule").over(page))
    hit = F.col("_ok") & F.col("_ruled").isNotNull() & (F.col("src") < 4) & ~F.col("noise") & (blob.rlike(rules.SEARCH) | _any_search_key())
    c = c.withColumn("_searched", F.max(F.coalesce(hit, F.lit(False))).over(page))
    keep = "payload" in c.columns
    c = c.withColumn("host_rule", F.when(~F.col("_searched"), F.col("host_rule")))
    c = c.where("_ok") if keep else c.where(F.col("_ok") & ((F.col("src") < 4) | F.col("host_rule").isNotNull()))
    host_path = F.lit(None).cast("string")
    host_label = F.lit(None).cast("string")
    for i, (_, _, p, lab) in enumerate(rules.HOST_SEARCH_RULES, 1):
        host_path = F.when(F.col("host_rule") == i, F.lit(p)).otherwise(host_path)
        host_label = F.when(F.col("host_rule") == i, F.lit(lab)).otherwise(host_label)
    rule = F.col("src") == 4
    q = F.create_map(F.lit("q"), F.struct(
        F.lit("text").alias("type"), host_label.alias("label"), F.lit(True).alias("required"),
        F.lit(None).cast("array<string>").alias("options"))).cast(PARAMETERS)
    rule = rule & F.col("host_rule").isNotNull()
    page_only = (F.col("src") == 4) & F.col("host_rule").isNull()
    return c.withColumns(
        {
            "type": F.when(~page_only, F.col("type")),
            "label": F.when(rule, host_label).otherwise(F.col("label")),
            "target": F.when(rule, urls.resolve_parts(host_path, F.col("base"))).otherwise(F.col("target")),
            "parameters": F.when(rule, q).otherwise(F.col("parameters")),
            "description": F.when(rule, F.lit(rules.DESCRIBE_HOST_SEARCH)).otherwise(F.col("description")),
        }
    ).drop("_ok", "_searched", "_ruled", "host_rule", "base")


def action_key() -> Column:
    return short_hash(F.concat_ws(":", "type", "label", F.coalesce("target", F.lit("None")), F.coalesce("method", F.lit("None"))))


def dedupe(c: DataFrame) -> DataFrame:
    """First of each key per page; ``nth`` > 1 marks the repeats."""
    c = c.withColumn("action_key", action_key())
    nth = F.row_number().over(W.partitionBy("page_id", "action_key").orderBy("src", "pos"))
    return c.withColumn("nth", nth)


def rank_class() -> Column:
    blob = F.concat_ws(" ", "label", "description")
    search = blob.rlike(rules.SEARCH) | _any_search_key()
    return (
        F.when((F.col("type") == "form") & search, 0)
        .when(F.lower("description").contains("local"), 1)
        .when(F.col("label").rlike(rules.PAGINATION), 2)
        .when(F.col("type") == "form", 3)
        .when(F.col("type") == "link", 4)
        .otherwise(5)
    )


def top(c: DataFrame, k: int = rules.MAX_ACTIONS) -> DataFrame:
    """The first ``k`` distinct actions of each page by rank class, label and list order."""
    d = dedupe(c.where(~F.col("noise"))).where(F.col("nth") == 1).withColumn("rank_class", rank_class())
    order = W.partitionBy("page_id").orderBy("rank_class", "label", "src", "pos")
    return (
        d.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(
            "page_id", "rank", "rank_class", "type", "label", "target", "method", "parameters", "description",
            "action_key", "src", "pos", *[x for x in ("near_price",) if x in d.columns],
        )
    )


def collected(c: DataFrame, k: int = rules.MAX_ACTIONS) -> DataFrame:
    """Per page the payload and the array of its first ``k`` distinct actions, in one pass."""
    d = dedupe(c.where(~F.col("noise"))).where(F.col("nth") == 1)
    own = F.col("type").isNotNull()
    d = d.withColumn("rank_class", F.when(own, rank_class()).otherwise(99))
    order = W.partitionBy("page_id").orderBy("rank_class", "label", "src", "pos")
    d = d.withColumn("rank", F.row_number().over(order))
    item = F.struct("type", "label", "target", "method", "parameters", "description")
    return d.groupBy("page_id").agg(
        F.any_value("payload", F.lit(True)).alias("payload"),
        F.transform(
            F.array_sort(
                F.collect_list(F.when(own & (F.col("rank") <= k), F.struct("rank", item.alias("a")))),
                lambda x, y: x["rank"] - y["rank"],
            ),
            lambda x: x["a"],
        ).alias("actions"),
    )


def page_rows(pages: DataFrame, more: list[str] | None = None, prices: bool = False) -> DataFrame:
    """Per page: base URL, texts in order and the elements action rules look at.

    With ``prices`` an element also knows whether a price is shown within ten tokens of it.
    """
    pages = pages.withColumns({"base": F.col("url"), "host_rule": needs_host_search(pages)})
    nd = H.nodes(pages, carry=["base", "host_rule"])
    extra = []
    if prices:
        near = W.partitionBy("page_id").orderBy("pos").rangeBetween(-10, 10)
        priced = F.coalesce(F.col("piece").rlike(rules.PRICE), F.lit(False))
        nd = nd.withColumn("near_price", F.max(priced).over(near))
        extra = [F.col("near_price")]
    return nd.groupBy("page_id").agg(
        F.max("base").alias("base"), F.max("host_rule").alias("host_rule"), M.collected_texts(),
        element_fields(more, *extra),
    )


FIELD_MORE = ["min", "max", "maxlength", "pattern"]


def form_fields(pages: DataFrame) -> DataFrame:
    """Named fields of every form; of fields with the same name the last one counts, in the place of the first."""
    el = _with_options(labelled(rows(page_rows(pages, FIELD_MORE))).where(F.col("tag") != "label"))
    a = F.col("a")
    name = truthy(a["name"])
    field = F.col("tag").isin("input", "select", "textarea") & F.col("form_pos").isNotNull() & name.isNotNull()
    el = el.where(field & F.coalesce(a["type"] != "submit", F.lit(True)))
    got = F.struct(
        F.col("pos").alias("last_pos"),
        F.coalesce(a["type"], F.lit("text")).alias("type"),
        "tag", "label", a["required"].alias("required"),
        F.when(F.col("tag") == "select", F.col("options")).alias("options"),
        *[a[k].alias(k) for k in FIELD_MORE], a["value"].alias("value"),
    )
    g = el.groupBy("page_id", "form_pos", name.alias("name")).agg(F.min("pos").alias("pos"), F.max(got).alias("f"))
    return g.select("page_id", "form_pos", "pos", "name", "f.*").drop("last_pos")


def top_actions(pages: DataFrame, k: int = rules.MAX_ACTIONS) -> DataFrame:
    """Ranked actions of every page (columns page_id, url, html)."""
    return top(candidates(page_rows(pages)), k)


def tools(actions: DataFrame) -> DataFrame:
    """What an agent needs to call an action."""
    return actions.select(
        "page_id", "rank", F.col("label").alias("name"), "type", "target",
        F.array_join(F.map_keys("parameters"), ",").alias("params"),
    )


def suppressed(page_rows_: DataFrame, k: int = rules.MAX_ACTIONS, effects: DataFrame | None = None) -> DataFrame:
    """Candidates that are not offered, with the first reason that applies.

    ``effects`` (page_id, action_key, effect), where probes were logged, adds actions found dead.
    """
    d = dedupe(candidates(page_rows_)).withColumn("rank_class", rank_class())
    kept = ~F.col("noise") & (F.col("nth") == 1)
    order = W.partitionBy("page_id", kept).orderBy("rank_class", "label", "src", "pos")
    d = d.withColumn("_r", F.row_number().over(order))
    if effects is None:
        d = d.withColumn("effect", F.lit(None).cast("string"))
    else:
        d = d.join(effects.select("page_id", "action_key", "effect"), ["page_id", "action_key"], "left")
    reason = (
        F.when(F.col("noise"), "noise")
        .when(F.col("nth") > 1, "duplicate")
        .when(F.col("label").rlike(rules.DESTRUCTIVE_NAME), "destructive")
        .when(F.col("effect") == "dead", "dead")
        .when(F.col("_r") > k, "low_confidence")
    )
    return d.withColumn("reason", reason).where("reason is not null").select(
        "page_id", "type", "label", "target", "method", "reason", "src", "pos"
    )
