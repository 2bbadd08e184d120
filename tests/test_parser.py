"""Tokens and element intervals against a plain tokenizer's and a plain stack parser's on misnested pages."""

import random

import pytest
from pyspark.sql import functions as F

from pagelake.functions import rules
from pagelake.operators import html as H

SCOPE, SPECIAL = set(rules.SCOPE_TAGS), set(rules.SPECIAL_TAGS)
TABLE = {"table", "template", "html"}
HEADS = set(rules.HEADINGS)


def parse(tags):
    """{place: end} of start tags of [(place, tag, is_end)], by a list of open elements and the standard's rules."""
    stack, ends = [], {}

    def near(kinds, walls):
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][1] in kinds:
                return k
            if walls(stack[k][1]):
                return None
        return None

    def drop(to, end, at):
        for place, t in stack[to + 1:]:
            if t in rules.OPTIONAL_END_TAGS:
                ends[place] = at - 1
        ends[stack[to][0]] = end
        del stack[to:]

    button = lambda t: t in SCOPE or t == "button"
    scope, table, special = (lambda t: t in SCOPE), (lambda t: t in TABLE), (lambda t: t in SPECIAL)
    item = lambda t: t in SPECIAL - {"address", "div", "p"}
    for at, t, is_end in tags:
        if is_end:
            if t in ("table", "caption", "colgroup", "td", "th", "tr", "tbody", "thead", "tfoot"):
                to = near({t}, table)
            elif t == "li":
                to = near({t}, lambda x: x in SCOPE or x in ("ol", "ul"))
            elif t == "p":
                to = near({t}, button)
            elif t in HEADS:
                to = near(HEADS, scope)
            elif t in ("body", "html"):
                to = near({t}, lambda x: False)
            else:
                to = near({t}, scope if t in SPECIAL or t in rules.FORMATTING_TAGS else special)
            if to is None:
                continue
            outliving = next((k for k in range(to + 1, len(stack)) if stack[k][1] in SPECIAL), None)
            if t in rules.FORMATTING_TAGS and outliving is not None:
                ends[stack[to][0]] = stack[outliving][0] - 1
                del stack[to:outliving]
            else:
                drop(to, at, at)
            continue
        wants = {
            "li": [({"li"}, item)], "dd": [({"dd", "dt"}, item)], "dt": [({"dd", "dt"}, item)], "td": [({"td", "th"}, table)], "th": [({"td", "th"}, table)],
            "tr": [({"td", "th"}, table), ({"tr"}, table)], "option": [({"option"}, special)], "optgroup": [({"option"}, special), ({"optgroup"}, special)],
            "a": [({"a"}, scope)], "button": [({"button"}, scope)], "nobr": [({"nobr"}, scope)], "body": [({"head"}, scope)],
            **{h: [(HEADS, lambda x: x not in HEADS)] for h in HEADS}, **{r: [({"rt", "rp"}, special)] for r in ("rt", "rp")},
            **{b: [({"td", "th"}, table), ({"tr"}, table), ({"tbody", "thead", "tfoot"}, table), ({"caption"}, table), ({"colgroup"}, table)] for b in ("tbody", "thead", "tfoot")},
        }.get(t, [])
        if t == "p" or t in rules.PARAGRAPH_ENDERS:
            wants = [*wants, ({"p"}, button)]
        found = [k for kinds, walls in wants if (k := near(kinds, walls)) is not None]
        if found:
            drop(min(found), at - 1, at)
        stack.append((at, t))
    return ends


def shown(pages):
    rows = H.tokens(pages).where("kind in ('open', 'close')").where(~F.col("tag").isin(rules.VOID_TAGS + rules.RAW_TEXT_TAGS))
    return rows.orderBy("page_id", "pos").collect()


TAGS = ["div", "p", "span", "b", "i", "a", "ul", "li", "table", "tr", "td", "th", "tbody", "h1", "h2", "section", "button", "select", "option", "optgroup", "dl", "dt", "dd", "x-y", "form", "article", "object", "caption", "body"]


@pytest.mark.parametrize("seed", range(3))
def test_random_tag_soup_equals_plain_stack_parser(make_pages, seed):
    r = random.Random(seed)
    soups = ["".join(f"<{'/' if r.random() < 0.45 else ''}{r.choice(TAGS[:r.randint(3, len(TAGS))])}>" + r.choice(["", "t"]) for _ in range(r.choice([5, 40, 700]))) for _ in range(40)]
    rows = shown(make_pages(*[(k, "u", s) for k, s in enumerate(soups)]))
    for k, s in enumerate(soups):
        mine = [x for x in rows if x.page_id == k]
        want = parse([(x.pos, x.tag, x.kind == "close") for x in mine])
        assert {x.pos: x.own_end for x in mine if x.kind == "open"} == {x.pos: want.get(x.pos) for x in mine if x.kind == "open"}, s
        spans = [(x.pos, x.own_end) for x in mine if x.kind == "open" and x.own_end is not None]
        assert not any(a < c <= b < d for a, b in spans for c, d in spans)


@pytest.mark.parametrize("html,want", [
    ("<div><span>x</div>y</span>z", [("div", 1, 4, None), ("span", 2, 4, "div")]),
    ("<b>1<i>2</b>3</i>", [("b", 1, 5, None), ("i", 3, 5, "b")]),
    ("<b>1<div>2</b>3</div>", [("b", 1, 2, None), ("div", 3, 7, None)]),
    ("<ul><li>a<div>b<li>c</ul>", [("ul", 1, 8, None), ("li", 2, 5, "ul"), ("div", 4, 5, "li"), ("li", 6, 7, "ul")]),
    ("<span><div><span>x</div></span>", [("span", 1, 6, None), ("div", 2, 5, "span"), ("span", 3, 5, "div")]),
    ("<table><tr><td>a</tr><tr><td>b<table><tr><td>c</table>d</table>", [
        ("table", 1, 15, None), ("tr", 2, 5, "table"), ("td", 3, 4, "tr"), ("tr", 6, 14, "table"), ("td", 7, 14, "tr"),
        ("table", 9, 13, "td"), ("tr", 10, 12, "table"), ("td", 11, 12, "tr")]),
    ("<p>a<button><div>b</p></div></button></p>", [("p", 1, 9, None), ("button", 3, 8, "p"), ("div", 4, 7, "button")]),
    ("<a href=x>1<a href=y>2</a>", [("a", 1, 2, None), ("a", 3, 5, None)]),
    ("</div><div>x</p></div>", [("div", 2, 5, None)]),
])
def test_repairs(make_pages, html, want):
    e = H.elements(H.tokens(make_pages((1, "u", html)))).where("kind = 'open'").orderBy("pos")
    assert [(r.tag, r.pos, r.epos, r.parent_tag) for r in e.collect()] == want


@pytest.mark.parametrize("html,want", [
    ('<a title="x>y" href=/p?a=1>t</a>', ["<a title=\"x>y\" href=/p?a=1>", "t", "</a>"]),
    ("<title>a<b & </i></title><p>", ["<title>", "a<b & </i>", "</title>", "<p>"]),
    ('<textarea name="n>m">\n<p>x</TEXTAREA >y', ['<textarea name="n>m">', "\n<p>x", "</TEXTAREA >", "y"]),
    ("<title></title><titles>a<b></b>", ["<title>", "</title>", "<titles>", "a", "<b>", "</b>"]),
    ("<title>never closed <b>", ["<title>", "never closed <b>"]),
    ('<script a="</script>">if (a<b) "</p>"</script >x', ['<script a="</script>">if (a<b) "</p>"</script >', "x"]),
    ("<style>p > a {}", ["<style>p > a {}"]),
    ("a<!-->b<!--->c<!-- > -- x --!>d<!-- <p> ", ["a", "<!-->", "b", "<!--->", "c", "<!-- > -- x --!>", "d", "<!-- <p> "]),
    ("<?xml a='b'?><!DOCTYPE html></3></><p>1 < 2</p>", ["<?xml a='b'?>", "<!DOCTYPE html>", "</3>", "</>", "<p>", "1 ", "<", " 2", "</p>"]),
    ("<p title='it\"s' data-x=\"a='b>\">t<br/>", ["<p title='it\"s' data-x=\"a='b>\">", "t", "<br/>"]),
    ('<p title="open>t</p>', ['<p title="open>', "t", "</p>"]),
    ("<p a==\"x>y\">", ["<p a==\"x>", "y\">"]),
])
def test_tokens(make_pages, html, want):
    assert [r.raw for r in H.tokens(make_pages((1, "u", html))).where("pos > 0").orderBy("pos").collect()] == want


def test_attributes_of_quoted_and_bare_values(make_pages):
    html = """<a title="x>y" href=/p?a=1&b=2 data-q='"' checked CLASS="A" class="b" e=""x=1 y = 2 /z><script src="a>b" defer>x="1"</script>"""
    rows = H.with_attributes(H.tokens(make_pages((1, "u", html))).where("kind = 'open'")).orderBy("pos").collect()
    assert rows[0].attrs == {"title": "x>y", "href": "/p?a=1&b=2", "data-q": '"', "checked": "", "class": "A", "e": "", "x": "1", "y": "2", "z": ""}
    assert rows[1].attrs == {"src": "a>b", "defer": ""}


def test_long_and_odd_pages(make_pages):
    rows = [(1, "u", "<div>" * 300 + "x" + "</div>" * 300), (2, "u", "<p>x" * 20_000), (3, "u", None), (4, "u", ""), (5, "u", "<a " + " ".join(f'a{i}="{i}>"' for i in range(1500)) + ">t</a>"), (4, "u", "")]
    t = H.tokens(make_pages(*rows))
    got = {(r.page_id, r.pos): r.own_end for r in t.where("kind = 'open'").collect()}
    assert got[1, 1] == 601 and got[1, 300] == 302 and got[2, 1] == 2 and got[2, 39_997] == 39_998 and got[2, 39_999] is None
    assert got[5, 1] == 3 and t.where("page_id in (3, 4)").count() == 3
