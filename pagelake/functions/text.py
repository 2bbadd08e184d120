"""Text expressions: character references, trimming, visible text, digests."""

from __future__ import annotations

import json
from functools import cache
from html.entities import html5 as NAMES

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = " \t\n\r\f\u00a0"


# References as they stand in a text: decimal, hexadecimal, named.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# Names that also count without their semicolon, longest first.
_BARE = "|".join(sorted((n for n in NAMES if not n.endswith(";")), key=lambda n: (-len(n), n)))
# Code points that numeric references name by mistake.
_MENDED = {0: "\ufffd", 13: "\r", **{b: bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in range(0x80, 0xA0)}}


@cache
def _by_beginning() -> str:
    """JSON of the names by their first two letters: a map of small maps, since Spark looks maps up from front to back."""
    out: dict[str, dict[str, str]] = {}
    for name, text in NAMES.items():
        out.setdefault(name[:2], {})[name] = text
    return json.dumps(out)


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def decode_entities(c: Column, attribute: bool = False) -> Column:
    """Decode all character references of a text in one pass from left to right; what a reference yields is not read again.

    Names are those of the HTML standard; a name that may lack its semicolon counts up to its longest beginning. In the
    value of an ``attribute`` such a name is kept if "=", a letter or a digit follows.
    """
    names = F.from_json(F.lit(_by_beginning()), "map<string,map<string,string>>")
    look_up = lambda n: F.element_at(F.element_at(names, F.substring(n, 1, 2)), n)

    def named(body: Column) -> Column:
        bare = F.regexp_extract(body, f"^(?:{_BARE})", 0)
        rest = F.substr(body, F.length(bare) + 1)
        ends = ~rest.rlike("^[=0-9A-Za-z]") if attribute else F.lit(True)
        return F.coalesce(look_up(body), F.when((bare != "") & ends, F.concat(look_up(bare), rest)), F.concat(F.lit("&"), body))

    def decoded(piece: Column) -> Column:
        return (
            F.when(F.length(piece) < 2, piece).when(~piece.startswith("&"), piece)
            .when(piece.startswith("&#"), _character(F.regexp_extract(piece, "^&#([xX]?[0-9A-Fa-f]+)", 1)))
            .otherwise(named(F.substring(piece, 2, 64)))
        )

    pieces = F.regexp_extract_all(c, F.lit(REFERENCE + "|[^&]+|&"), F.lit(0))
    return F.when(c.contains("&"), F.array_join(F.transform(pieces, decoded), "")).otherwise(c)


def _character(ref: Column) -> Column:
    """What ``8211`` or ``x2013`` names: the code point, its mend, U+FFFD if it is none, '' if it is no character."""
    digits = F.regexp_replace(F.regexp_replace(ref, "^[xX]", ""), "^0+(?=.)", "")
    long = F.length(digits) > 10
    code = F.when(long, F.lit(0x110000)).when(ref.rlike("^[xX]"), F.conv(digits, 16, 10).cast("long")).otherwise(digits.try_cast("long"))
    mended = F.from_json(F.lit(json.dumps(_MENDED)), "map<string,string>")

    def text(n: Column) -> Column:
        low = F.pmod(n, F.lit(0x10000))
        none = n.between(1, 8) | (n == 0xB) | n.between(0xE, 0x1F) | n.between(0x7F, 0x9F) | n.between(0xFDD0, 0xFDEF) | (low >= 0xFFFE)
        return (
            F.when((n < 0xA0) & (F.element_at(mended, n.cast("string")).isNotNull()), F.element_at(mended, n.cast("string")))
            .when((n > 0x10FFFF) | n.between(0xD800, 0xDFFF), "\ufffd").when(none, "")
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
        )

    return let(code, text)


def strip(c: Column) -> Column:
    """Trim white space including the no-break space."""
    return F.trim(c, F.lit(SPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACE))


def visible_len(html: Column) -> Column:
    """Length of the text a reader would see, computed on the raw source."""
    t = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", "")
    t = F.regexp_replace(t, r"(?is)<style[^>]*>.*?</style>", "")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = F.regexp_replace(t, f"[{SPACE}]+", " ")
    return F.length(F.trim(t))


def token_estimate(md: Column) -> Column:
    """Four characters per token, at least one token for a non-empty text, none for an empty one."""
    return F.when(md == "", F.lit(0)).otherwise(
        F.greatest(F.lit(1), F.floor(F.length(md) / 4).cast("int"))
    )


def word_count(md: Column) -> Column:
    return F.size(F.filter(F.split(md, f"[{SPACE}]+"), lambda w: w != ""))


def short_hash(c: Column, n: int = 16) -> Column:
    return F.left(F.sha2(c, 256), F.lit(n))
