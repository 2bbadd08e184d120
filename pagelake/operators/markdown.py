"""Main content and Markdown of every page, from the reading-order events of ``html.nodes``.

Choosing the main block and assembling the text are windows and one aggregate over
``page_id``; they stay on the partitioning of the page exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.functions import rules, urls
from pagelake.functions.text import rstrip, strip, token_estimate
from pagelake.operators import html as H

_HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
# Marks for emphasis, and for blanks that must survive clean-up (code blocks, list indents).
_B0, _B1, _I0, _I1 = "", "", "", ""
_SP, _NL, _TB = "", "", ""

_HINT = r"""^([a-zA-Z][a-zA-Z0-9]*)?(?:([#.])([A-Za-z0-9_-]+)|\[([A-Za-z0-9_-]+)(?:(\*?=)["']?([^"'\]]*)["']?)?\])?$"""


def parse_hint(hint: Column) -> Column:
    """Parts of a selector ``tag``, ``#id``, ``.class``, ``tag.class``, ``[a]``, ``[a=v]`` or ``[a*=v]``; null otherwise."""
    part = lambda i, n: F.regexp_extract(hint, _HINT, i).alias(n)
    parsed = F.struct(
        F.lower(part(1, "tag")).alias("tag"), part(2, "mark"), part(3, "name"), F.lower(part(4, "attr")).alias("attr"),
        part(5, "op"), part(6, "value"),
    )
    return F.when(hint.rlike(_HINT) & (hint != ""), parsed)


def matches_hint(hint: Column, tag: Column, attrs: Column) -> Column:
    """Whether an element matches a parsed selector."""
    by_mark = (
        F.when(hint["mark"] == "#", attrs["id"] == hint["name"])
        .when(hint["mark"] == ".", F.array_contains(F.split(attrs["class"], r"[ \t\n\r\f]+"), hint["name"]))
        .otherwise(F.lit(True))
    )
    got = F.element_at(attrs, hint["attr"])
    by_attr = (
        F.when(hint["attr"] == "", F.lit(True))
        .when(hint["op"] == "=", got == hint["value"])
        .when(hint["op"] == "*=", got.contains(hint["value"]))
        .otherwise(got.isNotNull())
    )
    match = ((hint["tag"] == "") | (tag == hint["tag"])) & by_mark & by_attr
    return F.when(hint.isNotNull(), F.coalesce(match, F.lit(False))).otherwise(False)


def with_main(nd: DataFrame, hint: str | None = None) -> DataFrame:
    """Add ``main`` (position interval of the chosen block) and ``main_rule`` to the events of each page.

    ``hint`` names a carried column with a parsed selector.
    """
    page = W.partitionBy("page_id")
    tag, attrs = F.col("tag"), F.col("attrs")
    el = (F.col("side") == 0) & (F.col("kind") == "open") & ~F.col("dropped")
    size = F.coalesce(F.col("end.content_chars") - F.col("content_chars"), F.lit(0))
    heads = F.coalesce(F.col("end.heads") - F.col("heads"), F.lit(0))
    span = lambda: F.struct("pos", "epos")
    sized = lambda: F.struct("pos", "epos", size.alias("size"))
    if hint:
        nd = nd.withColumn("_hint", F.max(hint).over(page))
        hinted = F.min(F.when(el & matches_hint(F.col("_hint"), tag, attrs), span())).over(page)
    else:
        hinted = F.lit(None).cast("struct<pos:int,epos:int>")
    landmarks = {
        "main": tag == "main",
        "role_main": attrs["role"] == "main",
        "col_sm_8": (tag == "div") & H.has_class(attrs, "col-sm-8"),
        "article": tag == "article",
        "id_content": attrs["id"] == "content",
        "class_content": H.has_class(attrs, "content"),
        "section": tag == "section",
    }
    first = {k: F.min(F.when(el & F.coalesce(c, F.lit(False)), sized())).over(page) for k, c in landmarks.items()}
    best = F.max(
        F.when(
            el & tag.isin("div", "section", "article") & (size > rules.CANDIDATE_MIN_TEXT),
            F.struct(
                (heads * rules.HEADING_BONUS).alias("h"),
                size.alias("size"),
                (-F.col("pos")).alias("neg"),
                F.col("epos").alias("epos"),
            ),
        )
    ).over(page)
    nd = nd.withColumns(
        {
            "_hit": hinted,
            "_h1": F.min(F.when(el & (tag == "h1"), F.col("pos"))).over(page),
            "_best": best,
            **{f"_{k}": c for k, c in first.items()},
        }
    )
    around = (
        el
        & ~tag.isin("html", "body", "head")
        & (F.col("pos") < F.col("_h1"))
        & (F.col("epos") >= F.col("_h1"))
        & (size > rules.MAIN_MIN_TEXT)
    )
    nd = nd.withColumn("_anc", F.max(F.when(around, span())).over(page))
    options = [("hint", F.col("_hit")), ("heading_ancestor", F.col("_anc"))]
    for k in landmarks:
        c = F.col(f"_{k}")
        options.append((k, F.when(c["size"] > rules.MAIN_MIN_TEXT, F.struct(c["pos"], c["epos"]))))
    options.append(
        ("densest", F.when(F.col("_best").isNotNull(), F.struct((-F.col("_best.neg")).alias("pos"), "_best.epos")))
    )
    whole = F.struct(F.lit(0).alias("pos"), F.lit(1 << 29).alias("epos"))
    rule = F.coalesce(*[F.when(c.isNotNull(), F.lit(k)) for k, c in options], F.lit("page"))
    span_t = "struct<pos:int,epos:int>"
    out = nd.withColumns(
        {"main": F.coalesce(*[c.cast(span_t) for _, c in options], whole.cast(span_t)), "main_rule": rule}
    )
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def piece_text(link_end: Column | None = None) -> Column:
    """Markdown text an event contributes; ``link_end`` replaces the usual inline target of a link."""
    tag, kind, s0 = F.col("tag"), F.col("kind"), F.col("side") == 0
    attrs = F.col("attrs")
    plain = squeezed(F.col("txt"))
    kept = F.translate(F.col("txt"), " \n\t\r", _SP + _NL + _TB)
    level = F.substring(tag, 2, 1).cast("int")
    row_cells = F.col("cells") - F.col("begin.cells")
    tight = (F.col("list_depth") > 0) | (F.col("cell_depth") > 0)
    both = lambda a, b: F.when(s0, a).otherwise(b)
    gap = F.lit("\n\n")
    indent = F.repeat(F.lit(_SP + _SP), F.greatest(F.col("list_depth") - 1, F.lit(0)).cast("int"))
    return (
        F.when(kind == "text", F.when(F.col("pre_depth") > 0, kept).otherwise(plain))
        .when(kind != "open", F.lit(""))
        .when(tag.isin(_HEADINGS), both(F.concat(gap, F.repeat(F.lit("#"), level), F.lit(" ")), gap))
        .when(tag == "a", F.when(attrs["href"].isNull(), "").otherwise(
            both(F.lit("["), F.concat(F.lit("]("), attrs["href"], F.lit(")")) if link_end is None else link_end)))
        .when(tag.isin("b", "strong"), both(F.lit(_B0), F.lit(_B1)))
        .when(tag.isin("i", "em"), both(F.lit(_I0), F.lit(_I1)))
        .when(tag == "br", F.when(F.col("cell_depth") > 0, " ").otherwise("\n"))
        .when(tag == "hr", F.lit("\n\n---\n\n"))
        .when(tag == "img", F.concat(
            F.lit("!["), F.coalesce(attrs["alt"], F.lit("")), F.lit("]("), F.coalesce(attrs["src"], F.lit("")), F.lit(")")))
        .when(tag == "pre", both(F.lit("\n\n```\n"), F.lit("\n```\n\n")))
        .when(tag.isin("code", "kbd", "samp"), F.when(F.col("pre_depth") > 0, "").otherwise("`"))
        .when(tag == "li", both(
            F.concat(F.lit("\n"), indent, F.when(F.col("parent_tag") == "ol", "1. ").otherwise("- ")), F.lit("")))
        .when(tag.isin("ul", "ol"), F.when(F.col("list_depth") == F.when(s0, 1).otherwise(0), gap).otherwise(""))
        .when(tag == "tr", both(
            F.lit("\n|"),
            F.when(F.col("begin.first_row"), F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), row_cells.cast("int"))))
            .otherwise("")))
        .when(tag.isin("td", "th"), both(F.lit(" "), F.lit(" |")))
        .when(tag.isin("thead", "tbody", "tfoot"), F.lit(""))
        .when(tag == "blockquote", both(F.lit("\n\n> "), gap))
        .when(tag == "title", both(F.lit(""), gap))
        .when(tag.isin(rules.PARAGRAPH_ENDERS + ["p"]), F.when(tight & (tag != "table"), both(F.lit(""), F.lit(" "))).otherwise(gap))
        .otherwise("")
    )


def _rewrite(md: Column, marks: list[str], pattern: str, to: str) -> Column:
    """Replace by pattern, but only where one of ``marks`` occurs: most pages need few of the rewrites."""
    cond = md.contains(marks[0])
    for m in marks[1:]:
        cond = cond | md.contains(m)
    return F.when(cond, F.regexp_replace(md, pattern, to)).otherwise(md)


def squeezed(c: Column) -> Column:
    """Runs of white space as one blank."""
    return _rewrite(c, ["\n", "  ", "\t", "\r", "\f"], "[ \t\r\n\f]+", " ")


def normalise(df: DataFrame) -> DataFrame:
    """Clean the assembled ``markdown``; then at most one blank line, then no blanks at line ends.

    One column step per rewrite, so that a text is read again only by the rewrites it needs.
    """
    steps = []
    for start, end, mark in ((_B0, _B1, "**"), (_I0, _I1, "*")):
        steps.append(lambda m, x=start, t=mark: _rewrite(m, [x], x + r"(\s*)", "$1" + t))
        steps.append(lambda m, x=end, t=mark: _rewrite(m, [x], r"(\s*)" + x, t + "$1"))
    steps += [
        lambda m: _rewrite(m, ["  "], " +", " "),
        lambda m: F.replace(F.replace(m, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n")),
        lambda m: F.when(
            m.contains(_SP) | m.contains(_NL) | m.contains(_TB), F.translate(m, _SP + _NL + _TB, " \n\t")
        ).otherwise(m),
        lambda m: _rewrite(m, ["\n\n\n"], r"\n{3,}", "\n\n"),
        lambda m: _rewrite(m, [" \n", "\t\n"], r"[ \t]+\n", "\n"),
        strip,
    ]
    for step in steps:
        df = df.withColumn("markdown", step(F.col("markdown")))
    return df


def content_piece(link_end: Column | None = None) -> Column:
    """Ordered piece of an event of the main block; null for events that add nothing."""
    inside = F.col("at").between(2 * F.col("main.pos"), 2 * F.col("main.epos") + 1)
    p = piece_text(link_end)
    return F.when(
        inside & ~F.col("dropped") & (p != ""), F.struct("at", (-F.col("pos")).alias("neg"), p.alias("piece"))
    )


def joined(pieces: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(pieces), lambda x: x["piece"]), "")


def reference_links(pages: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Markdown with numbered link references, tracking parameters taken out; tables longer than ``max_rows``, if given, are cut with a mark.

    Targets are numbered per page in order of first use; the list of references follows the text.
    """
    nd = with_main(H.nodes(pages))
    inside = F.col("at").between(2 * F.col("main.pos"), 2 * F.col("main.epos") + 1) & ~F.col("dropped")
    href = urls.without_tracking(F.col("attrs")["href"], rules.TRACKING_PARAMETER)
    nd = nd.withColumn("href", F.when(inside & (F.col("tag") == "a"), href))
    nd = nd.withColumn("first_use", F.min("pos").over(W.partitionBy("page_id", "href")))
    nd = nd.withColumn("first_use", F.when(F.col("href").isNotNull(), F.col("first_use")))
    nd = nd.withColumn("ref", F.dense_rank().over(W.partitionBy("page_id").orderBy(F.col("first_use").asc_nulls_last())))
    # Rows of a table, counted in order; what lies in rows beyond the limit is left out.
    order = W.partitionBy("page_id").orderBy("at", F.desc("pos")).rowsBetween(W.unboundedPreceding, 0)
    opened = lambda t: F.last(F.when((F.col("side") == 0) & (F.col("tag") == t), F.struct("pos", "epos")), ignorenulls=True).over(order)
    nd = nd.withColumns({"_t": opened("table"), "_r": opened("tr")})
    row_of = F.when(F.col("_r.epos") >= F.col("pos"), F.col("_r.pos"))
    nd = nd.withColumn("_row", F.when((F.col("_t.epos") >= F.col("pos")) & (row_of > F.col("_t.pos")), row_of))
    nd = nd.withColumn("nth_row", F.dense_rank().over(W.partitionBy("page_id", "_t.pos").orderBy(F.col("_row").asc_nulls_last())))
    limit = F.lit(max_rows).cast("int")
    over = F.col("_row").isNotNull() & F.coalesce(F.col("nth_row") > limit, F.lit(False))
    cut = over & (F.col("nth_row") == limit + 1) & (F.col("tag") == "tr") & (F.col("side") == 0)
    shown = content_piece(F.concat(F.lit("]["), F.col("ref").cast("string"), F.lit("]")))
    mark = F.struct("at", (-F.col("pos")).alias("neg"), F.lit("\n| … |").alias("piece"))
    piece = F.when(cut & inside, mark).when(~over, shown)
    refs = F.array_sort(F.collect_set(F.when(F.col("href").isNotNull() & ~over, F.struct("ref", "href"))))
    g = normalise(nd.groupBy("page_id").agg(joined(F.collect_list(piece)).alias("markdown"), refs.alias("refs")))
    listed = F.array_join(
        F.transform("refs", lambda r: F.concat(F.lit("["), r["ref"].cast("string"), F.lit("]: "), r["href"])), "\n"
    )
    return g.select(
        "page_id",
        F.when(F.size("refs") > 0, F.concat("markdown", F.lit("\n\n"), listed)).otherwise(F.col("markdown")).alias("markdown"),
        F.size("refs").alias("n_refs"),
    )


def truncate(df: DataFrame, max_tokens: str | int) -> DataFrame:
    """Cut ``markdown`` to a token budget (null: no budget), mark the cut, and add ``truncated``."""
    limit = F.col(max_tokens) if isinstance(max_tokens, str) else F.lit(max_tokens)
    over = F.coalesce(token_estimate(F.col("markdown")) > limit, F.lit(False))
    cut = F.concat(rstrip(F.substring("markdown", F.lit(1), (4 * limit).cast("int"))), F.lit(rules.TRUNCATION_MARK))
    return df.withColumn("truncated", over).withColumn(
        "markdown", F.when(F.col("truncated"), cut).otherwise(F.col("markdown"))
    )


def main_content(pages: DataFrame, hint: str | None = None) -> DataFrame:
    """The block chosen on each page: rule, tag and content length (null tag when the whole page is taken)."""
    if hint:
        pages = pages.withColumn(hint, parse_hint(F.col(hint)))
    nd = with_main(H.nodes(pages, carry=[hint] if hint else []), hint)
    at_main = (F.col("side") == 0) & (F.col("kind") == "open") & (F.col("pos") == F.col("main.pos"))
    return nd.groupBy("page_id").agg(
        F.max("main_rule").alias("rule"),
        F.max(F.when(at_main, F.col("tag"))).alias("tag"),
        F.max(F.when(at_main, F.col("pos"))).alias("pos"),
        F.max(F.when(at_main, F.coalesce(F.col("end.content_chars") - F.col("content_chars"), F.lit(0)))).alias("text_len"),
    )


def outline(pages: DataFrame) -> DataFrame:
    """Title and headings of each page in order."""
    rows = element_texts(H.nodes(pages), ["title", *_HEADINGS], " ")
    order = W.partitionBy("page_id").orderBy("pos")
    return rows.select(
        "page_id",
        F.row_number().over(order).alias("ord"),
        "tag",
        F.when(F.col("tag") == "title", 0).otherwise(F.substring("tag", 2, 1).cast("int")).alias("level"),
        "text",
    )


def element_texts(nd: DataFrame, tags: list[str], sep: str = "") -> DataFrame:
    """Text of every element with one of ``tags``: its text pieces, stripped, joined by ``sep``.

    Pieces are collected once per page and each element takes its slice, so the work is the
    size of the result and no element is paired with tokens outside it.
    """
    rows = nd.groupBy("page_id").agg(collected_texts(), collected_elements(tags))
    return rows.select(
        "page_id", F.inline(F.transform(F.col("els"), lambda e: F.struct(
            e["pos"].alias("pos"), e["epos"].alias("epos"), e["tag"].alias("tag"),
            _slice_text(F.col("texts"), e, sep).alias("text"))))
    )


def collected_texts() -> Column:
    return F.transform(
        F.sort_array(F.collect_list(F.when(
            (F.col("kind") == "text") & (F.length("piece") > 0), F.struct("pos", "piece")))),
        lambda x: x["piece"],
    ).alias("texts")


def collected_elements(tags: list[str], *fields: str | Column) -> Column:
    return F.collect_list(F.when(
        (F.col("side") == 0) & (F.col("kind") == "open") & F.col("tag").isin(tags),
        F.struct(
            "pos", "epos", "tag", F.col("texts").alias("t0"),
            F.coalesce(F.col("end.texts") - F.col("texts"), F.lit(0)).alias("n"), *fields,
        ),
    )).alias("els")


def _slice_text(texts: Column, e: Column, sep: str) -> Column:
    return F.array_join(F.slice(texts, (e["t0"] + 1).cast("int"), e["n"].cast("int")), sep)


def quality(versions: DataFrame) -> DataFrame:
    """Usable flag of candidate Markdown: long enough, and with a heading where the source has one."""
    md = F.col("markdown")
    heading = md.rlike(r"(?m)^#{1,6}\s")
    return versions.withColumn(
        "usable",
        F.coalesce(
            (F.length(strip(md)) >= rules.USABLE_MIN_CHARS) & (~F.col("source_has_heading") | heading), F.lit(False)
        ),
    )


def best_version(versions: DataFrame) -> DataFrame:
    """Per page the first usable version in order of ``preference``; else the one preferred last."""
    v = quality(versions)
    return v.groupBy("page_id").agg(
        F.coalesce(
            F.min(F.when(F.col("usable"), F.struct("preference", "markdown")))["markdown"],
            F.max(F.struct("preference", "markdown"))["markdown"],
        ).alias("markdown")
    )


# ------------------------------------------------------------------------------- threads
def is_thread_page(pages: DataFrame) -> Column:
    host = F.lower(urls.netloc(F.col("url")))
    return host.isin(rules.THREAD_HOSTS) | F.coalesce(F.col("html").contains("fatitem"), F.lit(False))


def thread_rows(pages: DataFrame) -> DataFrame:
    """Title, subtext, comment marker and comments of forum pages, in output order.

    Pages are narrowed on their source first, so only forum pages are exchanged and parsed.
    """
    cand = pages.where(is_thread_page(pages)).withColumn(
        "_host_hit", F.lower(urls.netloc(F.col("url"))).isin(rules.THREAD_HOSTS)
    )
    nd = H.nodes(cand, carry=["_host_hit"])
    page = W.partitionBy("page_id")
    attrs, tag = F.col("attrs"), F.col("tag")
    cls = lambda c: F.coalesce(H.has_class(attrs, c), F.lit(False))
    el = (F.col("side") == 0) & (F.col("kind") == "open") & ~F.col("dropped")
    order = W.partitionBy("page_id").orderBy("at", F.desc("pos"))
    upto = order.rowsBetween(W.unboundedPreceding, 0)

    def ctx(cond: Column) -> Column:
        return F.last(F.when(el & cond, F.struct("pos", "epos")), ignorenulls=True).over(upto)

    role = (
        F.when((tag == "h1") | ((tag == "span") & cls("titleline")), "title")
        .when(cls("subtext"), "subtext")
        .when(cls("comment-tree"), "tree")
        .when(cls("comtr"), "row")
        .when(cls("comhead"), "head")
        .when(cls("commtext"), "body")
        .when((tag == "a") & cls("hnuser"), "user")
    )
    nd = nd.withColumns(
        {
            "_forum": F.max(F.coalesce(F.col("_host_hit"), F.lit(False)) | (el & (tag == "table") & cls("fatitem"))).over(page),
            "_fat": ctx((tag == "table") & cls("fatitem")),
            "_tree": ctx(cls("comment-tree")),
            "_row": ctx(cls("comtr")),
            "_sub": ctx((tag == "tr") & cls("athing") & cls("submission")),
            "role": F.when(el, role),
        }
    )
    text = (F.col("kind") == "text") & (F.length("piece") > 0) & ~F.col("dropped")
    rows = _thread_pages(nd, text)
    parts = rows.where("forum").select("page_id", F.inline("els"))
    by_row = parts.where(F.col("role").isin("row", "head", "body", "user")).where(F.col("row").isNotNull())
    first = lambda r: F.min(F.when(F.col("role") == r, F.struct("pos", "plain", "spaced")))
    comments = by_row.groupBy("page_id", F.col("row").alias("pos")).agg(
        first("head").alias("head"), first("body").alias("body"), first("user").alias("user")
    ).where(F.col("body").isNotNull())
    user = F.coalesce(
        F.when(F.col("user.plain") != "", F.col("user.plain")),
        F.split("head.spaced", " on ")[0],
        F.lit(""),
    )
    comments = comments.select(
        "page_id", F.lit(3).alias("part"), "pos", F.lit("comment").alias("role"), user.alias("author"),
        F.col("body.spaced").alias("text"),
    )
    pick = lambda r, extra=F.lit(True): F.min(F.when((F.col("role") == r) & extra, F.struct("pos", "spaced")))
    head = parts.groupBy("page_id").agg(
        pick("title").alias("title"),
        pick("subtext", F.coalesce(F.col("in_fat"), F.lit(False)) | F.col("after_submission")).alias("subtext"),
        pick("tree").alias("tree"),
    )
    head = head.select("page_id", F.explode(F.array(
        F.when(F.col("title").isNotNull(), F.struct(F.lit(0).alias("part"), F.col("title.pos").alias("pos"), F.lit("title").alias("role"), F.col("title.spaced").alias("text"))),
        F.when(F.col("subtext").isNotNull(), F.struct(F.lit(1).alias("part"), F.col("subtext.pos").alias("pos"), F.lit("subtext").alias("role"), F.col("subtext.spaced").alias("text"))),
        F.when(F.col("tree").isNotNull(), F.struct(F.lit(2).alias("part"), F.col("tree.pos").alias("pos"), F.lit("marker").alias("role"), F.lit("Comments").alias("text"))),
    )).alias("p")).where("p is not null").select(
        "page_id", "p.part", "p.pos", "p.role", F.lit("").alias("author"), "p.text"
    )
    return head.unionByName(comments)


def _thread_pages(nd: DataFrame, text: Column) -> DataFrame:
    """Forum pages with their role elements; element text counts content only (noise taken out)."""
    counted = F.sum(F.when(text, 1).otherwise(0)).over(
        W.partitionBy("page_id").orderBy("at", F.desc("pos")).rowsBetween(W.unboundedPreceding, 0)
    )
    nd = nd.withColumn("_seen", counted)
    nd = nd.withColumn("_until", F.lead("_seen").over(W.partitionBy("page_id", "pos").orderBy("at")))
    rows = nd.groupBy("page_id").agg(
        F.max("_forum").alias("forum"),
        F.transform(
            F.sort_array(F.collect_list(F.when(text, F.struct("pos", "piece")))), lambda x: x["piece"]
        ).alias("texts"),
        F.collect_list(F.when(F.col("role").isNotNull(), F.struct(
            "pos", "role",
            F.col("_seen").cast("int").alias("t0"),
            F.coalesce(F.col("_until") - F.col("_seen"), F.lit(0)).cast("int").alias("n"),
            (F.col("_fat.epos") >= F.col("pos")).alias("in_fat"),
            F.col("_sub").isNotNull().alias("after_submission"),
            F.when(
                (F.col("_tree.epos") >= F.col("pos")) & (F.col("_row.epos") >= F.col("pos")), F.col("_row.pos")
            ).alias("row"),
        ))).alias("els"),
    )
    return rows.withColumn("els", F.transform("els", lambda e: F.struct(
        e["pos"].alias("pos"), e["role"].alias("role"), e["in_fat"].alias("in_fat"),
        e["after_submission"].alias("after_submission"), e["row"].alias("row"),
        F.array_join(F.slice(F.col("texts"), e["t0"] + 1, e["n"]), "").alias("plain"),
        F.array_join(F.slice(F.col("texts"), e["t0"] + 1, e["n"]), " ").alias("spaced"),
    )))


def thread_markdown(pages: DataFrame) -> DataFrame:
    """Markdown of forum pages; pages without any thread part do not appear."""
    t, a = F.col("text"), F.col("author")
    line = (
        F.when(F.col("role") == "title", F.concat(F.lit("# "), t))
        .when(F.col("role") == "marker", F.lit("## Comments"))
        .when(F.col("role") == "comment", F.concat(
            F.lit("- "), F.when(a != "", F.concat(F.lit("**"), a, F.lit("** — "))).otherwise(""), t))
        .otherwise(t)
    )
    lines = thread_rows(pages).select("page_id", F.struct("part", "pos", line.alias("line")).alias("l"))
    md = F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["line"]), "\n\n")
    md = F.regexp_replace(F.regexp_replace(md, r"\n{3,}", "\n\n"), r"[ \t]+\n", "\n")
    return lines.groupBy("page_id").agg(md.alias("markdown"))
