"""URL expressions. All of them are column expressions, so they run inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def scheme(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)


def netloc(url: Column) -> Column:
    """Authority with port, case kept; empty when the URL has none."""
    return F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 4)


def same_host(url: Column, base: Column) -> Column:
    return netloc(url) == netloc(base)


def _without_dots(p: Column) -> Column:
    """Remove ``.`` and ``..`` segments of an absolute path (RFC 3986, 5.2.4)."""
    segments = F.split(p, "/")
    last = F.element_at(segments, -1)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(
            s == "..",
            F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc),
        )
        .otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.array_join(kept, "/")
    joined = F.when(last.isin(".", ".."), F.concat(joined, F.lit("/"))).otherwise(joined)
    return F.when(p.contains("/."), joined).otherwise(p)


def base_parts(base: Column) -> Column:
    """What resolving needs of a base URL; worth computing once per page."""
    base_path = F.regexp_extract(base, _SPLIT, 3)
    start = F.concat(scheme(base), F.lit("://"), netloc(base))
    search = F.regexp_extract(base, _SPLIT, 4)
    return F.struct(
        base.alias("url"),
        netloc(base).alias("host"),
        start.alias("root"),
        F.concat(start, base_path).alias("front"),
        F.regexp_extract(F.when(base_path == "", F.lit("/")).otherwise(base_path), r"^(.*/)", 1).alias("folder"),
        F.when(search != "", F.concat(F.lit("?"), search)).otherwise("").alias("query"),
    )


def resolve(href: Column, base: Column) -> Column:
    """Resolve a reference against a base URL; in-page and non-web references stay as they are."""
    return resolve_parts(href, base_parts(base))


def resolve_parts(href: Column, b: Column) -> Column:
    """``resolve`` with the parts of the base URL at hand; blanks before an address and line breaks in it are dropped."""
    href = F.translate(F.regexp_replace(href, r"^[\x00-\x20]+", ""), "\t\r\n", "")
    part = lambda mark, i: F.when(
        F.regexp_extract(href, _SPLIT, i) != "", F.concat(F.lit(mark), F.regexp_extract(href, _SPLIT, i))
    ).otherwise("")
    tail = F.concat(part("?", 4), part("#", 5))
    h_path = F.regexp_extract(href, _SPLIT, 3)
    # Most references start at the root and need no rewriting.
    plain = href.startswith("/") & ~href.startswith("//") & ~href.contains("/.") & ~href.rlike(r"[?#](#|$)")
    return (
        F.when(href.isNull() | (href == ""), href)
        .when(plain, F.concat(b["root"], href))
        .when(href.rlike(r"^(#|[A-Za-z][A-Za-z0-9+.-]*:)"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(b["root"], r"^([^/]*)", 1), href))
        .when(h_path.startswith("/"), F.concat(b["root"], _without_dots(h_path), tail))
        .when(
            h_path == "",
            F.concat(b["front"], F.when(part("?", 4) != "", part("?", 4)).otherwise(b["query"]), part("#", 5)),
        )
        .otherwise(F.concat(b["root"], _without_dots(F.concat(b["folder"], h_path)), tail))
    )


def without_tracking(url: Column, pattern: str) -> Column:
    """The URL with tracking parameters taken out of its query part."""
    kept = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~p.rlike(pattern))
    text = F.array_join(kept, "&")
    front = F.regexp_extract(url, r"^([^?#]*)", 1)
    frag = F.regexp_extract(url, r"(#.*)$", 1)
    return F.when(
        query(url) != "", F.concat(front, F.when(text == "", "").otherwise(F.concat(F.lit("?"), text)), frag)
    ).otherwise(url)


def normalised(url: Column, pattern: str) -> Column:
    """Cache form of a URL: lower-case scheme and host, no default port, no fragment, sorted query."""
    host = F.lower(netloc(url))
    sch = F.lower(scheme(url))
    host = F.when(sch == "http", F.regexp_replace(host, r":80$", "")).otherwise(
        F.regexp_replace(host, r":443$", "")
    )
    params = F.array_sort(F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~p.rlike(pattern)))
    text = F.array_join(params, "&")
    return F.concat(
        sch,
        F.lit("://"),
        host,
        F.when(path(url) == "", F.lit("/")).otherwise(path(url)),
        F.when(text == "", F.lit("")).otherwise(F.concat(F.lit("?"), text)),
    )
