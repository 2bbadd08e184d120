"""Small pages with rows worked out by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pagelake.operators import actions as A

BOOKS = "https://books.toscrape.com/"
OPTIONS = "".join(f'<option value="{i}">o{i}</option>' for i in range(25))
PAGES = [
    (1, BOOKS, '<form action="/catalogue/search"><input name="q" placeholder="Search"><button type="submit">Search</button></form>'
               '<a href="/catalogue/page-2.html">next</a><a href="/book/1">A Book</a>'),
    (2, "https://quotes.toscrape.com/search.aspx",
     '<form action="/filter.aspx" method="post"><label for="author">Author</label><select id="author" name="author"><option value="">-</option>'
     '<option value="E">Einstein</option></select><label for="tag">Tag</label><select name="tag" id="tag"><option value="life">life</option></select>'
     '<input type="hidden" name="__VIEWSTATE" id="__VIEWSTATE" value="x"><input type="submit" name="go" value="Search"></form>'),
    (3, BOOKS, '<form action="/basket"><button type="submit">Add to basket</button></form><article class="product_pod">x</article>'),
    (4, "https://x.example/B", '<ul><li><a href="#tabs-1">Nunc tincidunt</a></li><li><a href="#tabs-2">Proin dolor</a></li></ul>'),
    (5, "https://example.com/", '<nav><a href="/">Home</a></nav><div class="cookie-banner"><button>Accept all</button></div>'),
    (6, "https://spa.example", '<div id="root"></div><script>var h="<a href=\'/x\'>Inner</a>";</script>'),
    (7, "https://e.example:8080/d/p", '<a href="/FAQ">FAQ</a><a href="/p">prevent</a><a href="/l">Local news</a><a href="tel:1">Call us</a>'
        '<a href="javascript:x()">Script</a><a href="mailto:a@b.c">Mail me</a><a href="/s">x</a><a href="../up">Up one</a><a href="?page=2">Second</a>'
        '<a href="http://e.example/other-port">Other port</a><a href="/dup">Twice</a><a href="/dup">Twice</a><a href="/z" role="menuitem">Menu</a>'
        '<a href="/o" onclick="toggle()">Open</a>'),
    (8, "https://many.example/", "".join(f'<a href="/n{i}">Link {i:02d}</a>' for i in range(20))),
    (9, "https://f.example/", f'<form><select name="s">{OPTIONS}</select></form><form><input type="hidden" name="t" value="1"></form>'
        '<form method="post"><legend>Your data</legend><input name="a" value="1"><input name="b"><input name="a" type="email" required></form>'
        '<form><input name="open">'),
    (10, "https://g.example/", ""),
]


@pytest.fixture(scope="module")
def got(make_pages):
    top = A.top_actions(make_pages(*PAGES)).withColumn("names", F.map_keys("parameters"))
    rows = top.orderBy("page_id", "rank").collect()
    return {p[0]: [r for r in rows if r.page_id == p[0]] for p in PAGES}


def brief(rows):
    return [(r.type, r.label, r.target, r.method, r.description) for r in rows]


def test_listing(got):
    assert brief(got[1]) == [
        ("form", "Search", BOOKS + "catalogue/search", "GET", "Submit a search query and load matching results."),
        ("link", "next", BOOKS + "catalogue/page-2.html", "GET", "Navigate to 'next' (pagination)."),
        ("link", "A Book", BOOKS + "book/1", "GET", "Follow link to 'A Book'."),
    ]
    assert got[1][0].parameters["q"].asDict() == {"type": "text", "label": "Search", "required": None, "options": None}


def test_author_tag_search(got):
    (r,) = got[2]
    assert (r.label, r.method, r.target) == ("Search quotes", "POST", "https://quotes.toscrape.com/filter.aspx")
    assert r.names == ["author", "tag", "__VIEWSTATE"]
    assert r.parameters["author"].options == ["Einstein"] and r.parameters["author"].label == "Author"
    assert r.parameters["__VIEWSTATE"].type == "hidden" and r.parameters["__VIEWSTATE"].label == "__VIEWSTATE"


def test_trivial_form_gives_way_to_host_search(got):
    (r,) = got[3]
    assert (r.label, r.target, r.parameters["q"].required) == ("Search", BOOKS + "catalogue/search", True)


def test_tabs(got):
    assert brief(got[4])[0] == ("link", "Nunc tincidunt", "https://x.example/B#tabs-1", "GET", "Switch to in-page section 'tabs-1' (local DOM effect).")
    assert [r.label for r in got[4]] == ["Nunc tincidunt", "Proin dolor"]


def test_navigation_noise_shell_and_empty(got):
    assert brief(got[5]) == [("link", "Home", "https://example.com/", "GET", "Navigate via site navigation to 'Home'.")]
    assert got[6] == [] and got[10] == []


def test_edge_links(got):
    by = {r.label: r for r in got[7]}
    assert set(by) == {"FAQ", "prevent", "Local news", "Up one", "Second", "Twice", "Menu", "Open"}
    assert by["prevent"].rank_class == 2 and "(pagination)" in by["prevent"].description
    assert by["Local news"].rank_class == 1 and by["Open"].rank_class == 1
    assert by["Up one"].target == "https://e.example:8080/up" and by["Second"].target == "https://e.example:8080/d/p?page=2"
    assert by["Open"].target == "https://e.example:8080/d/p"
    assert "site navigation" in by["Menu"].description
    assert sum(r.label == "Twice" for r in got[7]) == 1


def test_cap_and_forms(got):
    assert len(got[8]) == 15 and [r.label for r in got[8]][-1] == "Link 14"
    forms = {r.label: r for r in got[9]}
    assert [len(r.parameters["s"].options) for r in got[9] if "s" in r.parameters] == [20]
    assert forms["Your data"].parameters["a"].asDict() == {"type": "email", "label": "a", "required": True, "options": None}
    assert forms["Your data"].names == ["a", "b"]
    # All three other forms are called "form" with the same target: the first is kept.
    assert len(got[9]) == 2


def test_action_key(spark):
    row = spark.createDataFrame([("link", "next", BOOKS + "catalogue/page-2.html", "GET")], "type string, label string, target string, method string")
    key = row.select(A.action_key().alias("k")).first().k
    assert key == "84f7a5ae6b36e24e"
    assert key == hashlib.sha256(f"link:next:{BOOKS}catalogue/page-2.html:GET".encode()).hexdigest()[:16]


def test_faq_counts_as_search_for_forms(make_pages):
    p = make_pages((1, "https://q.example/", '<form><input name="x"><button type="submit">FAQ</button></form>'))
    r = A.top_actions(p).first()
    assert (r.label, r.rank_class) == ("FAQ", 0)


def test_suppressed_reasons(make_pages):
    s = A.suppressed(A.page_rows(make_pages(PAGES[4], PAGES[6], PAGES[7]))).groupBy("page_id", "reason").agg(F.count("*").alias("n"))
    assert {(r.page_id, r.reason): r.n for r in s.collect()} == {(5, "noise"): 1, (7, "duplicate"): 1, (8, "low_confidence"): 5}
