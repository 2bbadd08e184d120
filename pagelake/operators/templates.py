"""Templates by likeness: path patterns mined from a prefix tree, and families of pages whose tag trees are alike.

``contracts.fingerprints`` calls two pages one template if their shapes are equal. Here a page with an optional block more
belongs to the family of the page without. A shape is the set of a page's parent>child pairs and of its pairs of
neighbouring children; only different shapes are compared, however many pages have them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.functions import urls
from pagelake.functions.text import let, short_hash
from pagelake.operators import graphs
from pagelake.operators import html as H
from pagelake.session import written

#: Different tokens a place of a path may have before its rarer ones count as a parameter; levels looked at.
CHILDREN, DEPTH = 12, 8
#: Minima of a sketch and rows of a band; a pair of likeness 0.6 meets in none of the bands once in a million.
MINIMA, ROWS = 64, 2
LIKE = 0.6
#: Prefixes with parameters that are broadcast at most; more are joined by shuffle.
SMALL = 100_000


# ------------------------------------------------------------------------------- paths
def path_tokens(url: Column) -> Column:
    """Segments of a path with every run of digits as ``{n}``, without empty ones."""
    return F.filter(F.split(F.regexp_replace(urls.path(url), "[0-9]+", "{n}"), "/"), lambda x: x != "")


def path_patterns(pages: DataFrame, children: int = CHILDREN, depth: int = DEPTH) -> DataFrame:
    """domain, tokens, path_pattern of every different path of ``pages`` (url).

    Level by level of the prefix tree of a domain: behind a prefix with more than ``children`` different tokens, those
    that less than one page in ``children`` has become ``{}``, and go on as one branch. Segments beyond ``depth`` are ``{+}``.
    """
    paths = pages.select(urls.netloc(F.col("url")).alias("domain"), path_tokens(F.col("url")).alias("tokens"))
    paths = written(paths.groupBy("domain", "tokens").agg(F.count("*").alias("pages")).withColumn("prefix", F.lit("")))
    longest = min(depth, paths.agg(F.max(F.size("tokens"))).first()[0] or 0)
    for level in range(longest):
        here = paths.where(F.size("tokens") > level).select("domain", "prefix", F.get("tokens", F.lit(level)).alias("token"), "pages")
        counted = here.groupBy("domain", "prefix", "token").agg(F.sum("pages").alias("n"))
        many = counted.groupBy("domain", "prefix").agg(F.count("*").alias("different"), F.sum("n").alias("total")).where(F.col("different") > children)
        common = counted.join(many, ["domain", "prefix"]).groupBy("domain", "prefix").agg(
            F.collect_list(F.when(F.col("n") * children >= F.col("total"), F.col("token"))).alias("common"))  # at most ``children`` tokens
        common = written(common)
        joined = paths.join(F.broadcast(common) if common.count() <= SMALL else common, ["domain", "prefix"], "left")
        token = F.get("tokens", F.lit(level))
        shown = F.when(F.col("common").isNull() | F.array_contains("common", token), token).otherwise("{}")
        paths = written(joined.select("domain", "tokens", "pages", F.when(token.isNotNull(), F.concat("prefix", F.lit("/"), shown)).otherwise(F.col("prefix")).alias("prefix")))
    end = F.when(F.size("tokens") > depth, "/{+}").when(F.size("tokens") == 0, "/").otherwise("")
    return paths.select("domain", "tokens", F.concat("prefix", end).alias("path_pattern"))


# ------------------------------------------------------------------------------- shapes
def shapes(pages: DataFrame) -> DataFrame:
    """page_id, url, features: sorted parent>child pairs and pairs of neighbouring children of each page; none for a page without html."""
    els = H.elements(H.tokens(pages, carry=["url"]))
    is_open = F.col("kind") == "open"
    beside = F.lag("tag").over(W.partitionBy("page_id", "parent_pos", is_open).orderBy("pos"))
    els = els.withColumn("beside", beside)
    parent = F.coalesce("parent_tag", F.lit(""))
    own = F.when(is_open, F.concat(parent, F.lit(">"), F.col("tag")))
    pair = F.when(is_open & F.col("beside").isNotNull(), F.concat(parent, F.lit(">"), F.col("beside"), F.lit("+"), F.col("tag")))
    return els.groupBy("page_id").agg(F.max("url").alias("url"), F.array_sort(F.array_union(F.collect_set(own), F.collect_set(pair))).alias("features"))


def likeness(a: Column, b: Column) -> Column:
    """Shared features as a share of all; 1 for two empty sets."""
    n = F.size(F.array_intersect(a, b))
    return F.coalesce(n / F.nullif(F.size(a) + F.size(b) - n, F.lit(0)), F.lit(1.0))


def _bands(features: Column) -> Column:
    """Keys of the bands of a MinHash sketch."""
    least = lambda h: F.transform(F.sequence(F.lit(1), F.lit(MINIMA)), lambda k: F.array_min(F.transform(h, lambda x: F.xxhash64(x, k))))
    sketch = lambda h: let(least(h), lambda m: F.transform(F.sequence(F.lit(0), F.lit(MINIMA // ROWS - 1)), lambda b: F.xxhash64(b, F.slice(m, b * ROWS + 1, ROWS))))
    return let(F.transform(features, lambda f: F.xxhash64(f)), sketch)


def families(pages: DataFrame, like: float = LIKE) -> DataFrame:
    """page_id, domain, path_pattern, shape, family of each page (page_id, url, html).

    Different shapes of one domain and path pattern meet in the bands of their sketches. In each band the shapes are
    held against the one that most pages have, by their full sets; links of ``like`` or more connect them to families.
    """
    sets = written(shapes(pages).withColumns({"domain": urls.netloc(F.col("url")), "tokens": path_tokens(F.col("url"))}))
    patterns = path_patterns(pages)
    named = sets.join(patterns, ["domain", "tokens"]).select(
        "page_id", "domain", "path_pattern", "features", short_hash(F.concat_ws("|", "domain", "path_pattern", F.array_join("features", " "))).alias("shape"))
    named = written(named)
    different = named.groupBy("domain", "path_pattern", "shape").agg(F.count("*").alias("pages"), F.any_value("features").alias("features"))
    different = written(different)
    at = ["domain", "path_pattern", "band"]
    met = different.where(F.size("features") > 0).select("domain", "path_pattern", "shape", "pages", "features", F.explode(_bands(F.col("features"))).alias("band"))
    centre = met.groupBy(*at).agg(F.count("*").alias("n"), F.min(F.struct((-F.col("pages")).alias("minus"), "shape", "features")).alias("c")).where("n > 1")
    links = met.join(centre.select(*at, "c"), at).where(F.col("shape") != F.col("c.shape"))
    links = links.where(likeness(F.col("features"), F.col("c.features")) >= like).select(F.col("shape").alias("a"), F.col("c.shape").alias("b"))
    root = graphs.components(links)
    out = named.join(root.withColumnRenamed("node", "shape"), "shape", "left")
    return out.select("page_id", "domain", "path_pattern", "shape", F.concat(F.lit("fam_"), F.coalesce("root", "shape")).alias("family"))


def catalogue(fam: DataFrame) -> DataFrame:
    """Families with their pages, different shapes, the page that stands for them and its share of pages with the same shape."""
    per_shape = fam.groupBy("domain", "path_pattern", "family", "shape").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    top = F.min(F.struct((-F.col("n")).alias("minus"), "first"))
    return per_shape.groupBy("domain", "path_pattern", "family").agg(
        F.sum("n").alias("pages"), F.count("*").alias("shapes"), top["first"].alias("representative"), (-top["minus"] / F.sum("n")).alias("share"))
