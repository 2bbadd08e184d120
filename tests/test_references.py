"""Character references against the standard library."""

import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from pagelake.functions import text


def decoded(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    return [r.d for r in df.select("k", text.decode_entities(F.col("t"), **how).alias("d")).orderBy("k").collect()]


def test_every_name_with_and_without_semicolon(spark):
    texts = [f"a&{n}b" for n in html5] + [f"&{n.rstrip(';')} &{n.rstrip(';')}x;&{n}" for n in html5]
    assert decoded(spark, texts) == [html.unescape(t) for t in texts]


def test_numbers(spark):
    codes = [*range(0, 0x180), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFD, 0xFFFE, 0xFFFF, 0x1F600, 0x1FFFE, 0x10FFFD, 0x10FFFF, 0x110000, 10**11, 10**30]
    texts = [f"&#{c}; &#{c}&#x{c:x};&#X{c:X} &#000{c};" for c in codes]
    assert decoded(spark, texts) == [html.unescape(t) for t in texts]


def test_one_pass_from_left_to_right(spark):
    texts = ["&#38;lt; &amp;lt; &amp;amp;amp;", "&copy 2024 &eacute;&eacutex", "&&&lt&;&#;&#x;&#xg;", "&notit; &notin; &noti", "& &amp", "", None, "&" * 50, "plain", "&longer" + "x" * 80 + ";", "é&é;&\n&lt"]
    assert decoded(spark, texts) == [t if t is None else html.unescape(t) for t in texts]


def test_random_texts(spark):
    r = random.Random(5)
    parts = ["&", "#", "x", ";", "3", "8", "lt", "amp", "not", "in", "copy", " ", "é", "Alpha", "<"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(3000)]
    assert decoded(spark, texts) == [html.unescape(t) for t in texts]


def test_names_in_attribute_values(spark):
    texts = ["?a=1&copy=2", "?a&copy2", "?a&copy", "?a&copy;=2", "&amp=1 &amp;=1 &amp-", "&notit;", "&#38=2"]
    assert decoded(spark, texts, attribute=True) == ["?a=1&copy=2", "?a&copy2", "?a©", "?a©=2", "&amp=1 &=1 &-", "&notit;", "&=2"]
