"""Queries of the operators and the SQL they are checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm import ann, chat, decontaminate, langid, mixing, neardup, pii, quality, repeats, spelling, tokenalign, url_filter, warc
from pagelake.llm.common import checkpoint_dir, prepare, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, sf: fn(prepare(spark), sf)
    return fn


# ------------------------------------------------------------------------ URL filter
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Pages whose title is littered with signs are listed as bad.
LITTERED_TITLE = r"<title>[^<]*(&amp;&amp;&amp;|###|[$][$][$]|%%%|[*][*][*]|!!)"


@query
def op2_url_filter(spark, sf):
    pages = table(spark, sf, "pages")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(pages, rules, pages.where(F.col("html").rlike(LITTERED_TITLE)).select("url"))


ORACLES["op2_url_filter"] = rf"""
WITH p AS (
  SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT *, translate(regexp_extract(rest, '^[^/?#]*', 0), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_replace(regexp_replace(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), '(^|&)(utm_|ref=)[^&]*', '', 'g'), '^&+', '') AS query
  FROM p
), c AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)[.]', '') || regexp_replace(path, '/+$', '') ||
    CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canon FROM h
), listed AS (
  SELECT DISTINCT canon FROM c WHERE canon IS NOT NULL AND regexp_matches(html, '{LITTERED_TITLE}')
), rules(rhost, rpath, rverdict) AS (VALUES {", ".join(f"('{a}', '{b}', '{v}')" for a, b, v in RULES)}
), best AS (
  SELECT c.page_id, c.url, first(rhost || rpath ORDER BY length(rhost || rpath) DESC) AS rule, first(rverdict ORDER BY length(rhost || rpath) DESC) AS rverdict
  FROM (SELECT DISTINCT page_id, url, host, path FROM c) c JOIN rules
    ON (c.host = rhost OR ends_with(c.host, '.' || rhost)) AND starts_with(c.path, rpath) GROUP BY ALL
)
SELECT c.page_id, c.host, c.path, b.rule, coalesce(b.rverdict, CASE WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  l.canon IS NOT NULL AS listed
FROM c LEFT JOIN listed l ON l.canon = c.canon LEFT JOIN best b ON b.page_id = c.page_id AND b.url = c.url
"""


# ------------------------------------------------------------------------ language ID
@query
def op4_language_id(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    p = langid.predict(docs.select("doc_id", "text"), model, ["doc_id"])
    return p.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


# ------------------------------------------------------------------------ chat formatting
@query
def op8_chat_format(spark, sf):
    said = "<|im_end|><|im_start|>assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.render(chat.fold(chat.events_of(c), ["turn", "dup", "step"])))


ORACLES["op8_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS escaped,
    regexp_replace(replace(replace(role, '\', '\s'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') AS escaped_role FROM t
), c AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS learnt,
    sum(length('<|im_start|>' || escaped_role || chr(10) || escaped || '<|im_end|>' || chr(10))) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256,
  formatted_chars::BIGINT AS formatted_chars FROM c
"""


# ------------------------------------------------------------------------ WARC
@query
def op10_warc(spark, sf):
    folder = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    written = warc.write_warc(table(spark, sf, "pages").select("page_id", "url", "html"), folder)
    r = warc.read_warc(written.select("file", "bytes"))
    number = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("None")).cast("bigint")
    full = F.col("record_type") == "response"
    return r.select(
        number(F.col("record_id")).alias("page_id"), F.when(full, F.octet_length("payload")).otherwise(F.col("http_length")).cast("bigint").alias("payload_bytes"),
        F.when(full, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type", number(F.col("refers_to")).alias("refers_to"),
    )


ORACLES["op10_warc"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first_id FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f
"""


# ------------------------------------------------------------------------ near-duplicates
@query
def op7_near_duplicates(spark, sf):
    return neardup.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))


# ------------------------------------------------------------------------ personal data
@query
def op5_personal_data(spark, sf):
    p = pii.find(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"])
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return p.select("doc_id", *[n(kind) for kind in pii.KINDS], F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


# ------------------------------------------------------------------------ nearest neighbours
@query
def op6_nearest(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return ann.nearest(v, v.where("vec_id % 20 = 0"))


# ------------------------------------------------------------------------ mixing
#: Share of each domain in the token budget.
SHARES = {"clean": 0.9, "poor": 0.1, "toxic": 0.0}


def domain_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").otherwise("clean").alias("domain"))


@query
def op9_mixing(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    m = mixing.mix(docs, domain_labels(table(spark, sf, "labels")), SHARES, keep=["doc_id"])
    p = [F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(SHARES)]
    return m.select("doc_id", "n_tokens", *p, "rate", "copies")


# ------------------------------------------------------------------------ decontamination
@query
def op1_decontamination(spark, sf):
    return decontaminate.leaks(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))


# ------------------------------------------------------------------------ pipeline
@query
def pipeline(spark, sf):
    from corpus_pipeline import run

    return run(spark, sf)


# ------------------------------------------------------------------------ repeats
@query
def op3_suffix_dedup(spark, sf):
    return repeats.deduplicated(table(spark, sf, "documents").select("doc_id", "text"))


# ------------------------------------------------------------------------ quality rules
@query
def op11_quality_rules(spark, sf):
    q = quality.judge(table(spark, sf, "documents").select("doc_id", "text"), keep=["doc_id"])
    return q.withColumn("broken", F.array_join("broken", ","))


def _broken(rules) -> str:
    """SQL of the names of the rules that a row breaks, comma-joined."""
    value = lambda name: "{}::DOUBLE / nullif({}, 0)".format(*quality.RATIOS[name]) if name in quality.RATIOS else name
    tests = [(r.rule, " OR ".join(f"{value(r.measure)} {sign} {limit}" for sign, limit in (("<", r.low), (">", r.high)) if limit is not None)) for r in rules]
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {test} THEN '{rule}' END" for rule, test in tests) + ")"


ORACLES["op11_quality_rules"] = rf"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t
), win AS (
  SELECT k, i, array_to_string(w[i:i + {quality.WINDOW - 1}], ' ') AS s FROM (SELECT k, w, unnest(generate_series(1, len(w) - {quality.WINDOW - 1})) AS i FROM w)
), twice AS (
  SELECT k, i, coalesce(lead(i) OVER (PARTITION BY k ORDER BY i), i + {quality.WINDOW}) AS nx FROM (SELECT *, count(*) OVER (PARTITION BY k, s) AS c FROM win) WHERE c > 1
), rep AS (SELECT k, sum(least({quality.WINDOW}, nx - i))::BIGINT AS n FROM twice GROUP BY k
), m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(translate(text, '{quality.SYMBOLS}', '')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
    len(list_filter(regexp_split_to_array(lower(translate(text, '{quality.SIGNS.replace("'", "''")}', '')), '[\x20\x09-\x0D]+'), lambda x: x IN ({", ".join(f"'{x}'" for x in dict.fromkeys(quality.STOP_WORDS))}))) AS n_stop_words,
    len(list_filter(w, lambda x: ends_with(x, '!'))) AS n_shouts, len(lines) AS n_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '([.]{{3}}|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines
  FROM w LEFT JOIN rep USING (k)
), j AS (SELECT *, {_broken(quality.BASE)} AS base, {_broken(quality.RULES)} AS own FROM m)
SELECT * EXCLUDE (base, own), base <> '' AS base_failed, concat_ws(',', nullif(base, ''), nullif(own, '')) AS broken, base = '' AND own = '' AS kept FROM j
"""


# ------------------------------------------------------------------------ cross-tokenizer alignment
#: Folder of the public tokenizers' files.
TOKENIZERS = "/opt/tokenizers"


@query
def op13_token_alignment(spark, sf):
    a, b = (tokenalign.read_file(spark, f"{TOKENIZERS}/{f}") for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return tokenalign.align(table(spark, sf, "documents"), a, b)[0]


# ------------------------------------------------------------------------ spelling variants
@query
def op12_spelling_variants(spark, sf):
    return spelling.variants(spelling.corpus_words(table(spark, sf, "documents")))


#: CRC-32 of each of the sixteen values of half a byte (polynomial 0xEDB88320), worked out bit by bit.
def _crc_half(x: int) -> int:
    for _ in range(4):
        x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
    return x


_HALF = "[" + ", ".join(f"{_crc_half(k)}::BIGINT" for k in range(16)) + "]"
_STEP = f"xor(({{0}}) >> 4, {_HALF}[(({{0}}) & 15) + 1])"

ORACLES["op12_spelling_variants"] = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '{spelling.RUN}{{6,}}')), '{spelling.UPPER}', '{spelling.LOWER}') AS run FROM documents
), d AS (SELECT doc_id, run, count(*) AS c FROM r GROUP BY ALL
), b AS (
  SELECT *, flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x) >> 6)::BIGINT, 128 + (unicode(x) & 63)::BIGINT] END)) AS bytes FROM d
), h AS (
  SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda s, x: {_STEP.format(_STEP.format("xor(s, x)"))})) AS h FROM b
), w AS (
  SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM h
), v AS (SELECT word, sum(c)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5
), p AS (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM v
), cut AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM p
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i WHERE a.word <> b.word
  UNION SELECT cut.word, v.word, v.n FROM cut JOIN v ON cut.rest = v.word
  UNION SELECT v.word, cut.word, cut.n FROM cut JOIN v ON cut.rest = v.word
), s AS (
  SELECT v.word, v.n, count(near.near) AS n_near, arg_min(near.near, (-near_n, near.near)) AS form, max(near_n) AS form_n FROM v LEFT JOIN near USING (word) GROUP BY v.word, v.n
), f AS (SELECT word, n, n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM s
), walk AS (
  SELECT word, word AS at, form AS nx FROM f
  UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON f.word = walk.nx
)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word AND walk.nx IS NULL
"""
