"""Path patterns and template families against planted ones; components against a plain search."""

import random

from pyspark.sql import functions as F

from pagelake.operators import graphs
from pagelake.operators import templates as T

BLOCKS = ["<aside><h4>x</h4><img></aside>", "<section><em>new</em></section>", "<figure><img><figcaption>c</figcaption></figure>"]


def page(kind, extra):
    head = "<html><body><header><a href=/>h</a></header>"
    body = {
        "article": "<main><h1>t</h1><p>a<b>b</b></p><p>c</p><ul><li>1</li><li>2</li></ul><blockquote>q</blockquote><pre>x</pre>",
        "listing": "<main><form><input><button>s</button></form><table><tr><th>k</th></tr><tr><td>v</td><td>w</td></tr></table><nav><a>1</a><a>2</a></nav>",
        "login": "<div><form><label>l</label><input><input><select><option>o</option></select><button>b</button></form></div>",
    }[kind]
    return head + body + "".join(BLOCKS[k] for k in extra) + "</main><footer><small>f</small></footer></body></html>"


def test_optional_blocks_share_a_family_and_other_kinds_do_not(spark, make_pages):
    r = random.Random(4)
    planted, rows = {}, []
    for k in range(90):
        kind = r.choice(["article", "listing", "login"])
        extra = [r.randrange(3)] if r.random() < 0.5 else []
        planted[k] = kind
        rows.append((k, f"https://a.example/p/{k}", page(kind, extra)))
    rows += [(200, "https://b.example/p/1", page("article", [])), (201, "https://a.example/q", page("article", [])), (202, "https://a.example/p/5", None)]
    got = {r.page_id: r for r in T.families(make_pages(*rows)).collect()}
    assert len(got) == len(rows) and len({got[k].shape for k in planted}) > 6
    pairs = [(a, b) for a in planted for b in planted if a < b]
    same = [(a, b) for a, b in pairs if planted[a] == planted[b]]
    found = [(a, b) for a, b in pairs if got[a].family == got[b].family]
    assert set(found) == set(same)  # precision and recall of 1
    assert len({got[k].family for k in (200, 201, 202)} | {got[k].family for k in planted}) == 6
    c = {r.family: r for r in T.catalogue(T.families(make_pages(*rows))).collect()}
    assert sum(r.pages for r in c.values()) == len(rows) and all(planted.get(r.representative) == planted.get(k) for k in planted for r in [c[got[k].family]])


def test_sketch_loses_no_like_pair(spark):
    r = random.Random(7)
    sets = [(k, sorted(r.sample([f"f{i}" for i in range(24)], 16))) for k in range(150)]
    df = spark.createDataFrame(sets, "k long, fs array<string>").select("k", "fs", F.explode(T._bands(F.col("fs"))).alias("band"))
    met = df.alias("a").join(df.alias("b"), F.col("a.band") == F.col("b.band")).where("a.k < b.k").select("a.k", "b.k").distinct().collect()
    like = {(a, b) for a, x in sets for b, y in sets if a < b and len({*x} & {*y}) >= 0.6 * len({*x} | {*y})}
    assert like and like <= {tuple(x) for x in met}
    one = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], [])], "x array<string>, y array<string>")
    assert [r[0] for r in one.select(T.likeness(F.col("x"), F.col("y"))).collect()] == [1 / 3, 1.0, 0.0]


def test_path_patterns(spark):
    urls = [f"https://a.example/user/{chr(97 + i)}name/posts/{i}" for i in range(20)] + ["https://a.example/user/me/posts/1"] * 30
    urls += ["https://a.example/about", "https://a.example/", "https://a.example", "https://b.example/user/x", "x", "https://a.example/1/2/3/4/5/6/7/8/9/10"]
    got = {(r.domain, "/".join(r.tokens)): r.path_pattern for r in T.path_patterns(spark.createDataFrame([(u,) for u in urls], "url string"), children=5).collect()}
    assert got["a.example", "user/aname/posts/{n}"] == "/user/{}/posts/{n}" and got["a.example", "user/me/posts/{n}"] == "/user/me/posts/{n}"
    assert got["a.example", "about"] == "/about" and got["a.example", ""] == "/" and got["b.example", "user/x"] == "/user/x"
    assert got["a.example", "/".join(["{n}"] * 10)] == "/{n}" * 8 + "/{+}"
    assert T.path_patterns(spark.createDataFrame([], "url string")).count() == 0


def test_components_equal_plain_search(spark):
    r = random.Random(3)
    edges = [(f"n{r.randrange(300):03}", f"n{r.randrange(300):03}") for _ in range(180)] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(60)]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((top(a), top(b)))
        root[q] = p
    got = {x.node: x.root for x in graphs.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: top(x) for e in edges for x in e if e[0] != e[1] or x in got}
    assert graphs.components(spark.createDataFrame([], "a string, b string")).count() == 0
