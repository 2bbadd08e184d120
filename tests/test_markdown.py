import pytest
from pyspark.sql import functions as F

from pagelake.functions import rules
from pagelake.operators import html as H
from pagelake.operators import markdown as M
from pagelake.plans import extract as X

LONG = "word " * 30


def md(pages, **options):
    p = pages.withColumn("base", F.col("url"))
    for k, v in options.items():
        p = p.withColumn(k, F.lit(v))
    return {r.page_id: r for r in X.extract(p, [], with_actions=False).collect()}


def test_noise_is_dropped_and_lookalikes_kept(make_pages):
    r = md(make_pages((1, "https://a.example/", f"<html><body><nav>Home</nav><div class='load-more'>gone</div><div class='ad'>kept</div>"
                                                f"<div id='cookie-x'>gone</div><aside class='widget'>gone</aside><aside>stays</aside><p>{LONG}<footer>foot</footer></body></html>")))[1]
    assert r.markdown == "kept\n\nstays\n\n" + LONG.strip()


def test_main_content_cascade(make_pages):
    rows = M.main_content(make_pages(
        (1, "u", f"<body><div><section><h1>T</h1></section><p>{LONG}</div></body>"),
        (2, "u", f"<body><article>short</article><main>{LONG}</main></body>"),
        (3, "u", f"<body><div id='content'>{LONG}</div><p>x</body>"),
        (4, "u", f"<body><div><div>{LONG * 2}</div><div><h2>A</h2>{LONG}</div></div></body>"),
        (5, "u", "<body><p>tiny</body>"),
    )).collect()
    got = {r.page_id: (r.rule, r.tag) for r in rows}
    assert got == {1: ("heading_ancestor", "div"), 2: ("main", "main"), 3: ("id_content", "div"), 4: ("densest", "div"), 5: ("page", None)}
    # The outer block has as many headings and more text than the inner one.
    assert {r.page_id: r.pos for r in rows}[4] == 2


def test_blocks(make_pages):
    html = ("<h2>T &amp; U</h2><ul><li>a<ul><li>b</ul><li>c</ul><ol><li>x</ol><table><tr><th>k<th>v<tr><td>1<td>2</table>"
            "<pre>a\n\n  b</pre><p>i <b> bold </b>, <i>it</i> <code>c</code><br>next <a href='/z'>li <em>nk</em></a> <img src='i.png' alt='pic'><hr><blockquote>q</blockquote>")
    assert md(make_pages((1, "u", html)))[1].markdown == (
        "## T & U\n\n- a\n  - b\n- c\n\n1. x\n\n| k | v |\n| --- | --- |\n| 1 | 2 |\n\n```\na\n\n  b\n```\n\n"
        "i **bold** , *it* `c`\nnext [li *nk*](/z) ![pic](i.png)\n\n---\n\n> q"
    )


def test_truncation(make_pages):
    r = md(make_pages((1, "u", f"<p>{LONG * 20}</p>")), max_tokens=50)[1]
    assert r.truncated and r.markdown.endswith(rules.TRUNCATION_MARK) and len(r.markdown) <= 203
    assert not md(make_pages((1, "u", "<p>few</p>")), max_tokens=50)[1].truncated


@pytest.mark.parametrize("hint,tag", [("p", "p"), ("#x", "div"), (".k", "span"), ("span.k", "span"), ("[role=main]", "div"), ("[data-a*=bc]", "i"), ("div p", None)])
def test_selector_hints(make_pages, hint, tag):
    p = make_pages((1, "u", "<body><div id='x'>a</div><span class='j k'>b</span><div role='main'>c</div><i data-a='abcd'>d</i><p>e</body>"))
    r = M.main_content(p.withColumn("hint", F.lit(hint)), "hint").first()
    assert (r.rule, r.tag) == (("hint", tag) if tag else ("page", None))


def test_thread(make_pages):
    html = ('<span class="pagetop">top</span><table class="fatitem"><tr class="athing"><td><span class="titleline"><a href="x">Y Combinator</a></span></td></tr>'
            '<tr><td class="subtext">3&nbsp;comments</td></tr></table><table class="comment-tree"><tr class="comtr"><td><div class="commtext">First comment</div></td></tr>'
            '<tr class="comtr"><td><span class="comhead">bob on x</span><div class="commtext">Second <i>one</i></div></td></tr><tr class="comtr"><td>none</td></tr></table>')
    p = make_pages((1, "https://news.ycombinator.com/item?id=1", html), (2, "https://a.example/", "<p>plain</p>"))
    rows = M.thread_markdown(p).collect()
    assert [(r.page_id, r.markdown) for r in rows] == [(1, "# Y Combinator\n\n3 comments\n\n## Comments\n\n- First comment\n\n- **bob** — Second one")]
    x = X.with_threads(X.extract(p.withColumn("base", F.col("url")), []), p)
    assert {r.page_id: r.markdown[:6] for r in x.collect()} == {1: "# Y Co", 2: "plain"}


def test_quality_picks_first_usable(spark):
    v = spark.createDataFrame(
        [(1, 0, "too short", True), (1, 1, "# Head\n\n" + LONG, True), (2, 0, LONG, True), (2, 1, "x", True), (3, 0, LONG, False), (3, 1, "# " + LONG, False)],
        "page_id long, preference int, markdown string, source_has_heading boolean")
    assert {r.page_id: r.markdown for r in M.best_version(v).collect()} == {1: "# Head\n\n" + LONG, 2: "x", 3: LONG}


def test_references_and_long_tables(make_pages):
    rows = "".join(f"<tr><td>{i}</td></tr>" for i in range(5))
    html = f"<p><a href='/a?utm_source=x&b=1#f'>one</a> <a href='/a?b=1#f'>two</a></p><table>{rows}</table>"
    r = M.reference_links(make_pages((1, "u", html)), max_rows=2).first()
    assert r.markdown == "[one][1] [two][1]\n\n| 0 |\n| --- |\n| 1 |\n| … |\n\n[1]: /a?b=1#f"


def test_intervals_nest_or_are_disjoint(spark, sf):
    """Elements that have their own end never cross each other."""
    from pagelake.plans import derived as D

    e = H.elements(H.tokens(D.pages_aug(spark, sf))).where("kind = 'open' and closed").select("page_id", "pos", "epos")
    a, b = e.alias("a"), e.alias("b")
    crossing = a.join(b, (F.col("a.page_id") == F.col("b.page_id")) & (F.col("a.pos") < F.col("b.pos")) & (F.col("b.pos") <= F.col("a.epos")) & (F.col("b.epos") > F.col("a.epos")))
    assert crossing.count() == 0


def test_optional_ends_and_unclosed(make_pages):
    e = H.elements(H.tokens(make_pages((1, "u", "<div><p>a<b>c<p>d<ul><li>x<li>y<ul><li>z</ul></ul></div><i>t")))).where("kind = 'open'").orderBy("pos")
    got = [(r.tag, r.pos, r.epos, r.parent_tag) for r in e.collect()]
    assert got == [
        ("div", 1, 18, None), ("p", 2, 5, "div"), ("b", 4, 5, "p"), ("p", 6, 7, "div"), ("ul", 8, 17, "div"), ("li", 9, 10, "ul"),
        ("li", 11, 16, "ul"), ("ul", 13, 16, "li"), ("li", 14, 15, "ul"), ("i", 19, 20, None),
    ]
