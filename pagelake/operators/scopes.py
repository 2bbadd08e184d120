"""Where elements end: a stack of open elements, folded over the tags of a page.

The rules are those of the HTML standard for nesting: an end tag closes the nearest open element of its kind unless a
boundary (a table cell, a block for inline tags) lies between; whatever is open inside is closed with it; an end tag that
closes nothing is ignored; start tags close elements whose end tag may be left out; a formatting element that a block
inside it outlives ends before that block. So intervals of elements never cross.

The fold is one ``aggregate`` per page. Its results are gathered in parts of ``PART`` entries, which keeps the work on a page
of n tags near n times the depth of its nesting.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake.functions import rules
from pagelake.functions.text import let

PART = 256
# What an element is to those that look through it.
BOUNDARY, BUTTON, LIST, TABLE, SPECIAL, OPTIONAL, FORMAT, STOPS_ITEM, NO_HEADING = (1 << k for k in range(9))
_GROUPS = {"#cell": ["td", "th"], "#row": ["tr"], "#rows": ["tbody", "thead", "tfoot"], "#dd": ["dd", "dt"], "#h": rules.HEADINGS, "#ruby": ["rt", "rp"]}
_STACK = "array<struct<tag:string,grp:string,flags:int,at:int>>"
_ENDS = "array<struct<at:int,end:int>>"


def _flags(tag: Column) -> Column:
    def bit(cond: Column, value: int) -> Column:
        return F.when(cond, F.lit(value)).otherwise(F.lit(0))

    special = tag.isin(rules.SPECIAL_TAGS)
    return (
        bit(tag.isin(rules.SCOPE_TAGS), BOUNDARY) + bit(tag == "button", BUTTON) + bit(tag.isin("ol", "ul"), LIST)
        + bit(tag.isin("table", "template", "html"), TABLE) + bit(special, SPECIAL) + bit(tag.isin(rules.OPTIONAL_END_TAGS), OPTIONAL)
        + bit(tag.isin(rules.FORMATTING_TAGS), FORMAT) + bit(special & ~tag.isin("address", "div", "p"), STOPS_ITEM)
        + bit(~tag.isin(rules.HEADINGS), NO_HEADING)
    )


def _group(tag: Column) -> Column:
    out = tag
    for name, tags in _GROUPS.items():
        out = F.when(tag.isin(tags), F.lit(name)).otherwise(out)
    return out


def _wanted(tag: Column, close: Column) -> Column:
    """What a tag looks for among the open elements, from the innermost on, and the boundaries that end the search."""

    def want(name, *bits: int) -> Column:
        n = name if isinstance(name, Column) else F.lit(name)
        return F.struct(n.alias("name"), F.lit(sum(bits)).alias("mask"))

    table_tags = ["table", "caption", "colgroup", "td", "th", "tr", "tbody", "thead", "tfoot"]
    ends = (
        F.when(tag == "p", F.array(want("p", BOUNDARY, BUTTON)))
        .when(tag == "li", F.array(want("li", BOUNDARY, LIST)))
        .when(tag.isin(rules.HEADINGS), F.array(want("#h", BOUNDARY)))
        .when(tag.isin(table_tags), F.array(want(tag, TABLE)))
        .when(tag.isin("body", "html"), F.array(want(tag)))
        .when(tag.isin(rules.SPECIAL_TAGS + rules.FORMATTING_TAGS), F.array(want(tag, BOUNDARY)))
        .otherwise(F.array(want(tag, SPECIAL)))
    )
    none = F.array().cast("array<struct<name:string,mask:int>>")
    paragraph = F.when(tag.isin(["p", *rules.PARAGRAPH_ENDERS]), F.array(want("p", BOUNDARY, BUTTON))).otherwise(none)
    cell, row = want("#cell", TABLE), want("#row", TABLE)
    starts = (
        F.when(tag == "li", F.array(want("li", STOPS_ITEM)))
        .when(tag.isin("dd", "dt"), F.array(want("#dd", STOPS_ITEM)))
        .when(tag.isin("td", "th"), F.array(cell))
        .when(tag == "tr", F.array(cell, row))
        .when(tag.isin("tbody", "thead", "tfoot"), F.array(cell, row, want("#rows", TABLE), want("caption", TABLE), want("colgroup", TABLE)))
        .when(tag == "option", F.array(want("option", SPECIAL)))
        .when(tag == "optgroup", F.array(want("option", SPECIAL), want("optgroup", SPECIAL)))
        .when(tag.isin("a", "button", "nobr"), F.array(want(tag, BOUNDARY)))
        .when(tag.isin(rules.HEADINGS), F.array(want("#h", NO_HEADING)))
        .when(tag.isin("rt", "rp"), F.array(want("#ruby", SPECIAL)))
        .when(tag == "body", F.array(want("head", BOUNDARY)))
        .otherwise(none)
    )
    return F.when(close, ends).otherwise(F.concat(starts, paragraph))


def _step(acc: Column, x: Column) -> Column:
    stack, close = acc["stack"], x["close"]

    def found(w: Column) -> Column:
        marks = F.transform(stack, lambda e: F.when((e["tag"] == w["name"]) | (e["grp"] == w["name"]), 1).when(e["flags"].bitwiseAND(w["mask"]) != 0, 2).otherwise(0))

        def first(m: Column) -> Column:
            hit, wall = F.array_position(m, 1), F.array_position(m, 2)
            return F.when((hit > 0) & ((wall == 0) | (hit < wall)), hit).otherwise(0).cast("int")

        return let(marks, first)

    def with_depth(k: Column) -> Column:
        # A block inside a formatting element outlives it: the number of open elements from that block inwards.
        inner = F.transform(F.slice(stack, 1, F.greatest(k - 1, F.lit(0))), lambda e, i: F.when(e["flags"].bitwiseAND(SPECIAL) != 0, i + 1))
        outlives = F.when(close & (x["flags"].bitwiseAND(FORMAT) != 0) & (k > 1), F.array_max(inner))
        return let(F.coalesce(outlives, F.lit(0)), lambda j: changed(k, j))

    def changed(k: Column, j: Column) -> Column:
        end = F.when(j > 0, F.get(stack, j - 1)["at"] - 1).when(close, x["pos"]).otherwise(x["pos"] - 1)
        ended = F.transform(
            F.slice(stack, j + 1, k - j),
            lambda e, i: F.struct(e["at"].alias("at"), F.when(i == k - j - 1, end).when((j == 0) & (e["flags"].bitwiseAND(OPTIONAL) != 0), x["pos"] - 1).alias("end")),
        )
        own = F.struct(x["tag"].alias("tag"), x["grp"].alias("grp"), x["flags"].alias("flags"), x["pos"].alias("at"))
        rest = F.slice(stack, k + 1, F.greatest(F.size(stack) - k, F.lit(0)))
        kept = F.when(close, F.when(k == 0, stack).otherwise(F.concat(F.slice(stack, 1, j), rest))).otherwise(F.concat(F.array(own), rest))
        return F.when(k == 0, F.struct(kept.alias("stack"), acc["done"].alias("done"), acc["part"].alias("part"))).otherwise(
            let(F.concat(acc["part"], ended), lambda p: F.struct(
                kept.alias("stack"),
                F.when(F.size(p) >= PART, F.concat(acc["done"], F.array(p))).otherwise(acc["done"]).alias("done"),
                F.when(F.size(p) >= PART, F.array().cast(_ENDS)).otherwise(p).alias("part"),
            ))
        )

    return let(F.coalesce(F.array_max(F.transform(x["wants"], found)), F.lit(0)), with_depth)


def own_ends(pieces: Column) -> Column:
    """For each piece of a page, the place (from 1) where the element it opens ends; null if its end is missing, its own place if it opens none."""

    def tagged(p: Column, i: Column) -> Column:
        close = p.startswith("</")
        name = F.lower(F.regexp_extract(p, r"^</?([a-zA-Z][a-zA-Z0-9:-]*)", 1))
        return F.struct((i + 1).alias("pos"), name.alias("tag"), close.alias("close"))

    def told(t: Column) -> Column:
        return F.struct(
            t["pos"].alias("pos"), t["tag"].alias("tag"), _group(t["tag"]).alias("grp"), _flags(t["tag"]).alias("flags"),
            t["close"].alias("close"), _wanted(t["tag"], t["close"]).alias("wants"))

    leaf = rules.VOID_TAGS + rules.RAW_TEXT_TAGS
    nests = lambda t: (t["tag"] != "") & ~t["tag"].isin(leaf)

    def of(tags: Column) -> Column:
        empty = F.struct(F.array().cast(_STACK).alias("stack"), F.array().cast(f"array<{_ENDS}>").alias("done"), F.array().cast(_ENDS).alias("part"))
        last = lambda acc: F.concat(F.flatten(acc["done"]), acc["part"], F.transform(acc["stack"], lambda e: F.struct(e["at"].alias("at"), F.lit(None).cast("int").alias("end"))))
        ended = F.aggregate(F.transform(F.filter(tags, nests), told), empty, _step, last)
        alone = F.transform(F.filter(tags, lambda t: ~(nests(t) & ~t["close"])), lambda t: F.struct(t["pos"].alias("at"), t["pos"].alias("end")))
        return F.transform(F.sort_array(F.concat(ended, alone.cast(_ENDS))), lambda e: e["end"])

    return let(F.transform(pieces, tagged), of)
