"""Pages as tables: tokens, elements, attributes and reading contexts.

A page is exchanged once, as one row, by its ``page_id``; everything after that is a window
or an aggregate over ``page_id`` (or ``page_id`` and more), so Spark adds no further exchange.
Nothing here pairs elements with each other: ends come from one fold over the tags of a page (``scopes``), nesting from
running sums and ``last`` over the elements of a level.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.functions import rules
from pagelake.functions.text import decode_entities, strip
from pagelake.operators import scopes

# What follows a tag's name: a quote only opens a value after "=", and inside quotes ">" does not end the tag.
_REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)*+>"""
# Elements whose content is text up to their end tag: scripts and styles are one piece, title and textarea are taken apart.
TOKEN = (
    r"(?is)<!--(?:-?>|.*?(?:--!?>|\z))"
    rf"|<(script|style)(?=[\s/>]){_REST}.*?(?:</\1(?=[\s/>])[^>]*>|\z)"
    rf"|<(title|textarea)(?=[\s/>]){_REST}.*?(?:</\2(?=[\s/>])[^>]*>|\z)"
    rf"|</?[a-z]{_REST}|<[!?][^>]*>|</[^a-z>][^>]*>|</>|[^<]+|<"
)
_RCDATA = rf"(?is)^(<(title|textarea)(?=[\s/>]){_REST})(.*?)(</\2(?=[\s/>])[^>]*>)?\z"
ATTRIBUTE = r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?"""


MAX_PARTITIONS = 40_000


def page_partitions(pages: DataFrame, bytes_per_task: int = 4 << 20) -> int:
    """Number of page partitions: from the size of the files read; small inputs use the cores at hand.

    The sorts of a task take about a hundred times the compressed bytes of its pages, since each token becomes a row. The cap keeps the number of shuffle blocks of a 100 TB exchange in hand; beyond it tasks get
    larger (2.5 GB of compressed pages at 100 TB) and sort by spilling.
    """
    spark = pages.sparkSession
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    leaves = pages._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(s for s in sizes if s < 1 << 60)  # rows handed over by the driver have no size
    return max(least, min(MAX_PARTITIONS, math.ceil(known / bytes_per_task)))


def _taken_apart(pieces: Column) -> Column:
    """Pieces in which titles and textareas are three: start tag, text, end tag."""
    part = lambda p, k: F.regexp_extract(p, _RCDATA, k)
    whole = lambda p: p.rlike(r"(?i)^<(?:title|textarea)[\s/>]")
    split = lambda p: F.filter(F.array(*[part(p, k) for k in (1, 3, 4)]), lambda x: x != "")
    return F.flatten(F.transform(pieces, lambda p: F.when(whole(p), split(p)).otherwise(F.array(p))))


def tokens(pages: DataFrame, partitions: int | None = None, carry: list[str] | None = None, ends: bool = True) -> DataFrame:
    """One row per lexical piece in document order; row 0 of each page stands for the page itself.

    ``own_end`` is the place where the element that a piece opens ends, see ``scopes``; ``ends`` False leaves it out.

    ``carry`` columns (base URL, options) travel on row 0 only. Pages without html keep row 0.
    ``partitions`` 0 takes the pages as they are clustered, for tables bucketed by ``page_id``:
    Spark then plans no exchange at all.
    """
    carry = carry or []
    spread = pages if partitions == 0 else pages.repartition(partitions or page_partitions(pages), "page_id")
    none = F.array().cast("array<string>")
    found = F.coalesce(F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0)), none)
    spread = spread.select("page_id", *carry, _taken_apart(found).alias("pieces"))
    rows = F.transform("pieces", lambda p: F.struct(p.alias("raw")))
    if ends:
        rows = F.arrays_zip(F.col("pieces").alias("raw"), scopes.own_ends(F.col("pieces")).alias("own_end"))
    page = F.struct(F.lit("").alias("raw"), *([F.lit(0).alias("own_end")] if ends else []))
    out = spread.select("page_id", *carry, F.size("pieces").alias("last_pos"), F.posexplode(F.concat(F.array(page), rows)).alias("pos", "t"))
    out = out.select("page_id", *carry, "last_pos", "pos", "t.*")
    raw = F.col("raw")
    kind = (
        F.when(F.col("pos") == 0, "page")
        .when(raw.startswith("<!--"), "comment")
        .when(raw.rlike("^<(?:[!?]|/[^a-zA-Z])"), "decl")
        .when(raw.rlike("^</[a-zA-Z]"), "close")
        .when(raw.rlike("^<[a-zA-Z]"), "open")
        .otherwise("text")
    )
    return out.select(
        "page_id",
        "pos",
        "last_pos",
        kind.alias("kind"),
        F.lower(F.regexp_extract(raw, r"^</?([a-zA-Z][a-zA-Z0-9:-]*)", 1)).alias("tag"),
        "raw",
        *(["own_end"] if ends else []),
        *[F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in carry],
    )


def attributes(raw: Column) -> Column:
    """Attribute map of a start tag: lower-case names, first one wins, '' for attributes without value."""
    inner = F.regexp_extract(raw, rf"(?is)^<[a-z][^\s/>]*((?=[\s/]){_REST})", 1)
    names = F.transform(F.regexp_extract_all(inner, F.lit(ATTRIBUTE), F.lit(1)), F.lower)
    values = F.regexp_extract_all(inner, F.lit(ATTRIBUTE), F.lit(2))
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    first = F.filter(pairs, lambda p, i: F.array_position(names, p["k"]) == i + 1)
    entries = F.transform(
        first,
        lambda p: F.struct(
            p["k"].alias("k"),
            decode_entities(F.regexp_replace(p["v"], r"""(?s)^(["'])(.*)["']$""", "$2"), attribute=True).alias("v"),
        ),
    )
    empty = F.create_map().cast("map<string,string>")
    return F.when(raw.rlike(r"^<[^>\s/]+[\s/]"), F.map_from_entries(entries)).otherwise(empty)


def _closed(tok: DataFrame) -> DataFrame:
    """Start tags with the position of their own end (``own_end``; null when it is missing), and texts."""
    opens = F.col("kind") == "open"
    single = ~opens | F.col("tag").isin(rules.VOID_TAGS + rules.RAW_TEXT_TAGS)
    carried = [c for c in tok.columns if c not in ("page_id", "pos", "own_end")]
    rows = tok.where(F.col("kind").isin("open", "text", "page"))
    return rows.select("page_id", "pos", *carried, F.when(single, F.col("pos")).otherwise(F.col("own_end")).alias("own_end"), single.alias("single"))


def elements(tok: DataFrame) -> DataFrame:
    """Start tags and texts with interval ``[pos, epos]`` and the interval of the parent element.

    An element without its own end reaches to the end of its parent, or of the page.
    """
    rows = _closed(tok)
    carried = [c for c in rows.columns if c not in ("page_id", "pos", "own_end")]
    nests = ~F.col("single") & F.col("own_end").isNotNull()
    event = lambda at, d: F.struct(at.cast("int").alias("at"), F.lit(d).alias("d"))
    rows = rows.select(
        "page_id", "pos", "own_end", *carried, nests.alias("nests"),
        F.explode(
            F.when(nests, F.array(event(2 * F.col("pos"), 1), event(2 * F.col("own_end") + 1, -1)))
            .otherwise(F.array(event(2 * F.col("pos"), 0)))
        ).alias("e"),
    )
    order = W.partitionBy("page_id").orderBy("e.at", F.desc("pos"))
    rows = rows.withColumn("depth", F.sum("e.d").over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.where(F.col("e.d") >= 0)
    # Every element looks for its parent on the level above; nesting elements also offer themselves on theirs.
    seat = lambda lvl, offer: F.struct(lvl.cast("int").alias("lvl"), F.lit(offer).alias("offer"))
    rows = rows.withColumn(
        "s",
        F.explode(
            F.when(F.col("kind") != "open", F.array(seat(F.lit(-1), False)))
            .when(F.col("nests"), F.array(seat(F.col("depth"), True), seat(F.col("depth") - 1, False)))
            .otherwise(F.array(seat(F.col("depth"), False)))
        ),
    )
    above = W.partitionBy("page_id", "s.lvl").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn(
        "par",
        F.last(F.when(F.col("s.offer"), F.struct("pos", F.col("own_end").alias("epos"), "tag")), ignorenulls=True).over(above),
    ).where(~F.col("s.offer"))
    fits = F.col("par.epos") >= F.col("pos")
    epos = F.when(F.col("single"), F.col("pos")).otherwise(
        F.coalesce(F.col("own_end"), F.when(fits, F.col("par.epos")), F.col("last_pos"))
    )
    keep = [c for c in carried if c != "single"]
    return rows.select(
        "page_id",
        "pos",
        epos.cast("int").alias("epos"),
        *keep,
        "depth",
        F.when(fits, F.col("par.pos")).alias("parent_pos"),
        F.when(fits, F.col("par.epos")).alias("parent_epos"),
        F.when(fits, F.col("par.tag")).alias("parent_tag"),
        (F.col("own_end").isNotNull()).alias("closed"),
    )


def has_class(attrs: Column, name: str) -> Column:
    return F.array_contains(F.split(attrs["class"], r"[ \t\n\r\f]+"), name)


def is_noise(tag: Column, attrs: Column) -> Column:
    """Whether an element is page furniture whose whole subtree is dropped from the content."""
    cond = tag.isin(rules.NOISE_TAGS) | attrs["role"].isin(rules.NOISE_ROLES)
    for part in rules.NOISE_CLASS_PARTS:
        cond = cond | attrs["class"].contains(part)
    for part in rules.NOISE_ID_PARTS:
        cond = cond | attrs["id"].contains(part)
    for t, cls in rules.NOISE_CLASSES:
        hit = has_class(attrs, cls)
        cond = cond | ((tag == t) & hit if t else hit)
    return F.coalesce(cond, F.lit(False))


def with_attributes(els: DataFrame) -> DataFrame:
    empty = F.create_map().cast("map<string,string>")
    return els.withColumn(
        "attrs", F.when(F.col("kind") == "open", attributes(F.col("raw"))).otherwise(empty)
    )


def nodes(pages: DataFrame, carry: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Events of every page in reading order with the contexts all later jobs need.

    ``side`` is 0 where an element (or a text) starts and 1 where an element that can have
    content ends; ``at`` orders the events of a page. A start row also holds what its end row
    counts (``*_end``), so the amount of text or headings inside an element is a difference.
    """
    carry = carry or []
    els = with_attributes(elements(tokens(pages, partitions, carry)))
    kind, tag = F.col("kind"), F.col("tag")
    leaf = (kind != "open") | tag.isin(rules.VOID_TAGS + rules.RAW_TEXT_TAGS)
    txt = F.when(kind == "text", decode_entities(F.col("raw")))
    els = els.select(
        "page_id", "pos", "epos", "kind", "tag", "attrs", "parent_pos", "parent_epos", "parent_tag", *carry,
        txt.alias("txt"),
        is_noise(tag, F.col("attrs")).alias("noise"),
        leaf.alias("leaf"),
    )
    els = els.withColumn("piece", F.when(kind == "text", strip(F.col("txt"))))
    side = lambda at, s: F.struct(at.cast("int").alias("at"), F.lit(s).alias("side"))
    ev = els.select(
        "*",
        F.explode(
            F.when(F.col("leaf"), F.array(side(2 * F.col("pos"), 0)))
            .otherwise(F.array(side(2 * F.col("pos"), 0), side(2 * F.col("epos") + 1, 1)))
        ).alias("e"),
    ).select("*", "e.at", "e.side").drop("e")
    order = W.partitionBy("page_id").orderBy("at", F.desc("pos")).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("page_id").orderBy("at", F.desc("pos")).rowsBetween(W.unboundedPreceding, -1)
    turn = F.when(F.col("leaf"), 0).when(F.col("side") == 0, 1).otherwise(-1)
    start = F.col("side") == 0

    def open_count(cond: Column) -> Column:
        return F.sum(F.when(F.coalesce(cond, F.lit(False)), turn).otherwise(0)).over(order)

    def last_open(cond: Column) -> Column:
        return F.last(
            F.when(start & F.coalesce(cond, F.lit(False)), F.struct("pos", "epos")), ignorenulls=True
        ).over(order)

    def inside(c: str) -> Column:
        return F.when(F.col(f"{c}.epos") >= F.col("pos"), F.col(f"{c}.pos"))

    ev = ev.select(
        "*",
        (open_count(F.col("noise")) > 0).alias("in_noise_subtree"),
        open_count(tag == "nav").alias("nav_depth"),
        open_count(tag.isin("td", "th")).alias("cell_depth"),
        open_count(tag == "pre").alias("pre_depth"),
        open_count(tag.isin("ul", "ol")).alias("list_depth"),
        last_open(tag == "form").alias("form_ctx"),
        last_open(tag == "select").alias("select_ctx"),
        F.sum(F.when(F.length("piece") > 0, 1).otherwise(0)).over(order).alias("texts"),
        F.sum(F.coalesce(F.length("piece"), F.lit(0))).over(order).alias("chars"),
        F.sum(F.when(start & tag.isin("td", "th"), 1).otherwise(0)).over(order).alias("cells"),
        F.last(F.when(start & (tag == "table"), F.col("pos")), ignorenulls=True).over(before).alias("table_before"),
        F.last(F.when(start & (tag == "tr"), F.col("pos")), ignorenulls=True).over(before).alias("row_before"),
    )
    dropped = F.col("in_noise_subtree") | (F.col("leaf") & F.col("noise"))
    ev = ev.withColumn("dropped", dropped)
    ev = ev.withColumns(
        {
            "content_chars": F.sum(
                F.when(F.col("dropped"), 0).otherwise(F.coalesce(F.length("piece"), F.lit(0)))
            ).over(order),
            "heads": F.sum(
                F.when(start & ~F.col("dropped") & tag.isin("h1", "h2", "h3"), 1).otherwise(0)
            ).over(order),
            "form_pos": inside("form_ctx"),
            "select_pos": inside("select_ctx"),
            "first_row": (tag == "tr") & start
            & (F.coalesce(F.col("table_before"), F.lit(-1)) >= F.coalesce(F.col("row_before"), F.lit(-1))),
        }
    ).drop("form_ctx", "select_ctx", "in_noise_subtree", "table_before", "row_before")
    pair = W.partitionBy("page_id", "pos").orderBy("at")
    return ev.withColumns(
        {
            "end": F.lead(F.struct("texts", "chars", "content_chars", "heads")).over(pair),
            "begin": F.lag(F.struct("cells", "first_row")).over(pair),
        }
    )


def starts(nd: DataFrame) -> DataFrame:
    """Element rows of ``nodes``: one per element, with text lengths of the whole and of the content."""
    zero = F.lit(0)
    return nd.where((F.col("side") == 0) & (F.col("kind") == "open")).select(
        "page_id", "pos", "epos", "tag", "attrs", "parent_pos", "parent_epos", "dropped", "nav_depth",
        "form_pos", "select_pos",
        F.coalesce(F.col("end.texts") - F.col("texts"), zero).alias("n_texts"),
        F.col("texts").alias("texts_before"),
        F.coalesce(F.col("end.chars") - F.col("chars"), zero).alias("text_len"),
        F.coalesce(F.col("end.content_chars") - F.col("content_chars"), zero).alias("content_len"),
        F.coalesce(F.col("end.heads") - F.col("heads"), zero).alias("n_heads"),
    )
