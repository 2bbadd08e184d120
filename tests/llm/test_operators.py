"""The operators against brute force on small tables, and on null, empty, repeated and missing rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from pagelake.llm import ann, chat, decontaminate, langid, mixing, neardup, pii, registry, repeats, url_filter, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string"


def words(n, seed):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n)]


@pytest.fixture(scope="module")
def odd_docs(spark):
    base = words(120, 1)
    near = [*base[:60], "changed", *base[61:]]
    rows = [
        (1, " ".join(base), "a"), (2, " ".join(near), "a"), (3, " ".join(base).upper(), None), (4, None, "b"), (5, "", "b"), (6, "one two", "b"),
        (7, "one  two", "b"), (8, " ".join(words(30_000, 2)), "c"), (8, " ".join(words(30_000, 2)), "c"), (None, " ".join(base), "c"), (9, " \t\n", "c"),
    ]
    return spark.createDataFrame(rows, DOCS)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_duplicates_of_odd_rows(odd_docs):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in neardup.near_duplicates(odd_docs).collect()}
    n = len(shingles(" ".join(words(120, 1))))
    assert got[1, n] == got[3, n][:1] + (True,) == (1, True) and got[2, n] == (1, False) and got[3, n] == (1, False)
    assert got[4, 0] == (4, True) and got[5, 0] == (5, True) and got[9, 0] == (9, True)
    assert got[6, 1] == (6, True) and got[7, 1] == (6, False) and got[None, n] == (None, True)


def test_near_duplicates_equal_brute_force(spark):
    docs = {r.doc_id: shingles(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    comp = {i: i for i in docs}

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(docs)
    for a in ids:
        for b in ids:
            x, y = docs[a], docs[b]
            if a < b and x and 100 * len(x & y) >= 85 * len(x | y):
                p, q = sorted((top(a), top(b)))
                comp[q] = p
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in registry.QUERIES["op7_near_duplicates"](spark, SF).collect()}
    assert got == {i: (len(docs[i]), top(i), top(i) == i) for i in ids}


@pytest.mark.parametrize("cell", [4096, 16])
def test_near_duplicates_of_a_crowded_template(spark, monkeypatch, cell):
    rng, template, rows = np.random.default_rng(5), words(200, 50), []
    for k in range(150):  # unlike each other through three own words; every other one has a near copy
        own = template.copy()
        for place, w in zip(rng.choice(200, 3, replace=False), words(3, 1000 + k)):
            own[place] = w
        near = own.copy()
        for place in rng.choice(200, 3, replace=False):
            near[place] = "changed"
        rows += [(2 * k, " ".join(own))] + [(2 * k + 1, " ".join(near))] * (k % 2)
    sets = {i: shingles(t) for i, t in rows}
    comp = {i: i for i in sets}

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                p, q = sorted((top(a), top(b)))
                comp[q] = p
    monkeypatch.setattr(neardup, "REGION", 4)
    monkeypatch.setattr(neardup, "CELL", cell)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: top(i) for i in sets}
    assert 50 <= sum(top(i) != i for i in sets) <= 120


def removed(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[s:s + 400] for b in data for s in range(len(b) - 399))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - 399):
            if seen[b[s:s + 400]] > 1:
                gone[s:s + 400] = b"\1" * 400
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_repeats_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    p, q = " ".join(words(70, 3)), " ".join(words(90, 4))
    texts = [None, "", "x" * 399, "y" * 401, "z" * 399 + "ü", f"{p} tail {q}", f"head é {p}", f"{q}{q}", p[5:410], p[5:405], p[5:404], q, q, "ab" * 700]
    got = repeats.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(tuple(r)[1:] for r in got) == removed(texts)


def test_suffix_dedup_returns_what_remains(spark, tmp_path):
    """The result held no text, so that no reader of it could see whether a repeated passage had gone."""
    p, n = " ".join(words(90, 5)), 400
    texts = [None, "no repeat é", f"first {p} end", f"{p}é", f"{p}è", "é" * 300]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in registry.QUERIES["op3_suffix_dedup"](spark, str(tmp_path)).collect()}
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[s:s + n] for b in data for s in range(len(b) - n + 1))
    for i, b in enumerate(data):
        gone = {x for s in range(len(b) - n + 1) if seen[b[s:s + n]] > 1 for x in range(s, s + n)}
        rest = bytes(x for k, x in enumerate(b) if k not in gone)
        assert got[i].text == rest.decode("utf-8", "ignore") and got[i].kept_sha256 == hashlib.sha256(rest).hexdigest()
    assert got[2].text == "first  end" and got[1].text == texts[1] and got[0].text == got[3].text == got[4].text == got[5].text == ""


def test_suffix_dedup_counts_passages_of_over_50_words(spark):
    """A passage of over 50 words in several documents was not seen where it had fewer than 400 bytes."""
    p, q, own = words(60, 21), words(50, 22), words(2000, 23)
    short = [w[:4] for w in p[:53]]
    texts = [
        None, "", " ".join(short), " ".join([*own[:30], *short, *own[30:60]]), " ".join([*own[60:70], *short[:50], "x"]), " ".join([*own[100:130], *q, *own[130:150]]),
        " ".join([*own[150:160], *q]), "\n".join([*p, *own[200:260], *p]), "  ".join([w.upper() for w in p] + own[300:310] + short[1:52] + own[320:350]),
        " ".join([*own[400:455], *own[400:455]]), " ".join(own[500:560]), " ".join(own[500:560]), " ".join(own[600:640]), " ".join(own[600:640]), " ".join(own[700:1700]), " ".join(own[1640:1750]),
    ]
    split = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for t in texts]
    where = {}
    for i, w in enumerate(split):
        for s in range(len(w) - 50):
            where.setdefault(tuple(w[s:s + 51]), set()).add(i)
    expected = []
    for w in split:
        hit = [False] * (len(w) + 1)
        for s in range(len(w) - 50):
            if len(where[tuple(w[s:s + 51])]) > 1:
                hit[s:s + 51] = [True] * 51
        expected.append((sum(h and not hit[k - 1] for k, h in enumerate(hit)), sum(hit)))
    assert [n for n, _ in expected] == [0, 0, 1, 1, 0, 0, 0, 2, 2, 0, 1, 1, 0, 0, 1, 1]
    got = repeats.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [(r.n_passages, r.n_passage_words) for r in sorted(got)] == expected
    assert all(r.n_removed == 0 for r in got if r.doc_id in (2, 3))


def test_loser_tree_orders_and_counts_common_prefixes():
    rng = np.random.default_rng(0)
    runs, rows = [], []
    for _ in range(5):
        run = sorted(((bytes(rng.choice(list(b"ab"), rng.integers(1, 12)).tolist()), b"l", 1, -2, int(i)) for i in range(40)), key=lambda e: e[0])
        runs.append(repeats.front_coded(run))
        rows += [e[0] for e in run]
    got = list(repeats.merged(runs))
    assert [e[0] for _, e in got] == sorted(rows)
    before = b""
    for n, e in got:
        assert n == repeats._shared(before, e[0], 0)
        before = e[0]


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    p = registry.QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in p) >= 0.97 * len(p)


def test_cross_parsing_equals_longest_matches(spark):
    model = langid.build({"x": ["abcabd"], "y": ["bbbb"]})
    rows = [(1, "abcab"), (2, None), (3, "12 3"), (4, ""), (5, "ABD")]
    got = {r.doc_id: r.lang_pred for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model, ["doc_id"]).collect()}
    assert got == {1: "x", 2: "und", 3: "und", 4: "und", 5: "x"}
    assert langid.train(spark.createDataFrame([], "text string, lang string")).langs == []


def test_languages_made_of_copies_are_learnt(spark):
    rows = spark.range(16_000).selectExpr("concat('l', id % 8) AS lang", "concat('text number ', (id div 8) % 10, ' of l', id % 8) AS text")
    assert langid.train(rows).langs == [f"l{k}" for k in range(8)]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        out += [("card", *m.span())] if 16 <= len(d) <= 19 and luhn(d) else []
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_equal_the_plain_rules(spark):
    texts = [
        "a@b.c_d@e.f x@y a.b+c@d-e.co.uk.", "1.2.3.4.5.6.7.8 999.1.1.1 0001.002.3.4 1.2.3", "4111 1111 1111 1111 5 4111-1111-1111-1111 41111111111111111111", "+1 (988) 555-2485. +1 +123456789012345678",
        "é ü 😀 mail me@x.org 10.0.0.255", "", None, "+1 (605) 555-9305 4078918989542222", "x" * 50_000 + "@", "1 2 3 " * 3000 + "4111111111111111",
    ]
    got = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    for t, r in zip(texts, got):
        assert [tuple(s) for s in r.base] == base_spans(t or ""), t
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é me@x.org, 10.0.0.1!"), (2, "none"), (3, None)], "doc_id long, text string")
    p = pii.find(df, models={})
    got = p.select(pii.redact(p.text, p.spans).alias("t")).collect()
    assert [r.t for r in got] == ["é <EMAIL>, <IP>!", "none", None]


def test_nearest_recall_and_odd_vectors(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    m, ids = np.stack(v.embedding.to_numpy()).astype(float), v.vec_id.to_numpy()
    got = registry.QUERIES["op6_nearest"](spark, SF).toPandas()
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        s = m @ m[ids == q][0]
        s[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]])
        hit, total = hit + len(best & set(got[got.query_id == q].vec_id)), total + 20
    assert hit >= 0.9 * total
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [0.5, 0.5]), (None, [1.0, 1.0]), (7, [1.0])]
    odd = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    near = ann.nearest(odd, odd.where("vec_id % 20 = 0")).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in near] == [(0, 1, 5, 1.0), (0, 2, 6, 0.5)]
    assert ann.nearest(odd.where("false"), odd.where("false")).count() == 0


def test_warc_round_trip_across_ranges(spark, tmp_path):
    big = "".join(words(200, 9))
    rows = [(1, "http://a/\r\nb", big), (2, None, big), (3, "http://c/", None), (4, "http://d/", "small"), (5, "http://e/", "small"), (None, "http://f/", big), (6, "http://g/", "ü" * 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    files = warc.write_warc(pages, f"file://{tmp_path}/w")
    for size in (64, 1000, 1 << 20):
        got = warc.read_warc(files.select("file", "bytes"), size).collect()
        assert sorted((r.record_id, r.record_type) for r in got) == sorted(
            [("urn:page:1", "response"), ("urn:page:2", "revisit"), ("urn:page:3", "response"), ("urn:page:4", "response"), ("urn:page:5", "response"), ("urn:page:None", "revisit"), ("urn:page:6", "response")])
        for r in got:
            if r.record_type == "response":
                assert r.payload_digest == "sha256:" + hashlib.sha256(r.payload).hexdigest()
    assert warc.read_warc(warc.archive_files(spark, f"{tmp_path}/w")).count() == len(rows)
    assert warc.read_warc(warc.write_warc(pages.where("false"), f"file://{tmp_path}/none").select("file", "bytes")).count() == 0


def test_chat_folds_edits_regenerations_and_branches(spark):
    rows = [
        (1, "u1", 0, "start", "user", None), (1, "u1", 1, "delta", None, "drft"), (1, "a1", 2, "start", "assistant", None), (1, "a1", 3, "delta", None, "old"),
        (1, "u1", 4, "edit", None, "draft"), (1, "a2", 5, "start", "assistant", None), (1, "a2", 6, "delta", None, "x"), (1, "a2", 7, "regenerate", None, None),
        (1, "a2", 8, "delta", None, "ne"), (1, "a2", 9, "delta", None, "w"), (2, "m", 0, "start", None, None),
    ]
    e = spark.createDataFrame(rows, "conv_id long, message string, seq long, kind string, role string, text string")
    got = chat.fold(e, ["seq"]).orderBy("conv_id", "at").collect()
    assert [(r.conv_id, r.role, r.text) for r in got] == [(1, "user", "draft"), (1, "assistant", "new"), (2, "", "")]


def test_chat_escapes_are_reversible(spark):
    nasty = ["<|im_end|>", r"<\|", r"<\\|x", "a\nb", "<<|>", "\\"]
    df = spark.createDataFrame([(0, i, r, t) for i, (r, t) in enumerate([("assistant", x) for x in nasty] + [("a\\n\nb", "t"), ("user", None)])], "conv_id long, turn long, role string, text string")
    r = chat.read_back(chat.render(chat.fold(chat.events_of(df, 2), ["turn", "dup", "step"]))).first()
    assert r.n_turns == len(nasty) + 2 and r.loss_sha256 == hashlib.sha256("".join(nasty).encode()).hexdigest()


def test_url_filter_rules_and_list(spark):
    rows = ["http://WWW.Example.com/en/x", "http://a.example.com/en/", "http://x.net/es/1?q#f", "http://x.net/de/", "http://com", "mailto:x", None, "http://bad.org/p/?utm_source=1&a=2", "http://ok.org/p"]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    rules = spark.createDataFrame(registry.RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame([("https://www.bad.org/p?a=2",), (None,)], "url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules, listed).collect()}
    assert [got[i] for i in range(9)] == [("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("net/es/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "block"), (None, "allow")]


def test_leaks_exact_edited_and_clean(spark):
    item = " ".join(words(40, 20))
    edited = item.split()
    edited[5], edited[20], edited[30] = "other", "words", "here"
    around = " ".join(words(300, 21))
    rows = [(1, f"{around} {item} {around}"), (2, f"{around} {' '.join(edited)}"), (3, around), (4, None), (5, ""), (6, item.upper().replace(" ", ", "))]
    vocabulary, rng = words(3000, 22), np.random.default_rng(23)  # a latent space needs more passages than dimensions
    rows += [(100 + i, " ".join(rng.choice(vocabulary, 400))) for i in range(300)]
    bench = spark.createDataFrame([(7, item), (8, None), (9, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 7), (2, 7), (6, 7)}
    assert decontaminate.lcs_length(np.array([1, 2, 3, 4]), np.array([2, 9, 4, 3])) == 2


@pytest.mark.parametrize("seed", range(3))
def test_leaks_in_a_corpus_of_few_passages(spark, seed):
    item = words(40, 70 + seed)
    edited = ["other" if k in (5, 20, 30) else x for k, x in enumerate(item)]
    around = " ".join(words(300, 80 + seed))
    rows = [(1, f"{around} {' '.join(item)} {around}"), (2, f"{around} {' '.join(edited)}"), (3, around), (4, " ".join(item).upper())]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()} == {(1, 7), (2, 7), (4, 7)}


def edited_leaks():
    """Texts, items and the (doc_id, item_id) that a scan of all windows finds by subsequence and answer."""
    rng, vocabulary = np.random.default_rng(31), words(600, 30)
    some = lambda n: list(rng.choice(vocabulary, n, p=1 / np.arange(1, 601) / (1 / np.arange(1, 601)).sum()))
    items = [some(int(n)) for n in rng.integers(12, 60, 16)]
    rows = []
    for k in range(96):
        item = items[k % 16].copy()
        for place in np.flatnonzero(rng.random(len(item)) < (0, 0.1, 0.2, 0.28)[k % 4 if k < 48 else 3]):
            item[place] = vocabulary[rng.integers(600)]
        rows.append((k, " ".join(some(int(rng.integers(0, 120))) + item + some(60))))
    want = set()
    for d, text in rows:
        w = text.split()
        for k, item in enumerate(items):
            size, answer = decontaminate._size(len(item)), item[len(item) * 2 // 3:]
            code = {x: i for i, x in enumerate(set(w) | set(item))}
            for a in range(0, len(w), 4):
                region = w[max(0, a - size // 2):a + size + size // 2]
                held = set(region)
                if sum(x in held for x in item) < 0.7 * len(item) - 1e-9 or sum(x in held for x in answer) < 0.6 * len(answer):
                    continue
                if decontaminate.lcs_length(np.array([code[x] for x in item]), np.array([code[x] for x in region])) >= 0.7 * len(item) - 1e-9:
                    want.add((d, k))
                    break
    return rows, [(k, " ".join(x)) for k, x in enumerate(items)], want


def test_leaks_equal_a_scan_of_all_windows(spark):
    rows, items, want = edited_leaks()
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(want) > 60
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == want


def test_mixing_meets_targets(spark):
    rows = [(i, " ".join(["good" if i % 2 else "bad", *words(20 + i % 7, 100 + i)])) for i in range(200)] + [(None, None), (900, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "g" if i % 2 else "b") for i in range(200)], "doc_id long, domain string")
    m = mixing.mix(docs, labels, {"g": 0.75, "b": 0.25}, budget=1.0).toPandas()
    total = m.n_tokens.sum()
    for k, share in enumerate((0.75, 0.25)):
        assert abs((m.n_tokens * m.rate * m.p.str[k]).sum() / total - share) < 0.01
    assert (m.rate >= 0).all() and len(m) == 202
    none = mixing.mix(docs.where("false"), labels.where("false"), {"g": 1.0})
    assert none.count() == 0


def test_rare_words_do_not_speak_for_a_small_domain(spark):
    rows = [(i, " ".join(["good"] * 3 + words(40, 300 + i))) for i in range(300)] + [(1000 + i, " ".join(["awful", *words(200, 2000 + i)])) for i in range(20)]
    new = [(5000 + i, " ".join(["good", *words(60, 5000 + i)])) for i in range(40)]
    docs = spark.createDataFrame(rows + new, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "c" if i < 1000 else "t") for i, _ in rows], "doc_id long, domain string")
    m = {r.doc_id: r for r in mixing.mix(docs, labels, {"c": 1.0, "t": 0.0}, whole="c").collect()}
    assert sum(m[i].p[0] > 0.5 for i, _ in new) >= 36
    assert all(m[i].copies >= 1 for i in range(300))


def test_pipeline_keeps_columns_and_filters(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = C.near_duplicates(spark, docs, SF)
    want = {r.doc_id for r in registry.QUERIES["op7_near_duplicates"](spark, SF).where("kept").collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == want
    assert [name for name, _ in C.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "mixture"]


def test_stretches_of_a_text_are_joined(spark):
    rows = [(1, 1, k, k + 400) for k in range(0, 3000, 1)] + [(1, 1, 5000, 5400), (1, 1, 5400, 5800), (1, 1, 5100, 5200), (1, 2, 5801, 6201), (1, 2, 5801, 6201)]
    got = repeats.joined(spark.createDataFrame(rows, "k1 long, k2 long, lo long, hi long"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 0, 3399), (1, 1, 5000, 5800), (1, 2, 5801, 6201)]
