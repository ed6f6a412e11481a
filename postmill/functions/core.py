"""Number, whitespace and word-boundary rules shared by every operator.

The rules follow ECMAScript, so they are spelled out once: rounding is half-up
toward +infinity, whitespace includes the Unicode spaces, and a word boundary
only knows ASCII word characters (Java's own boundary is Unicode-aware).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as a JavaScript regular expression sees it.
WS_CLASS = r"\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
# The intersection lets printable ASCII fail on one range test. A single blank is left alone.
_SPACE = rf"[[\x00-\x20\x7F-\x{{FFFF}}]&&[{WS_CLASS}]]"
WS = rf"{_SPACE}{{2,}}|[{_SPACE}&&[^ ]]"
# Any other character; and text that is neither blank nor the word unknown. Both are decided at the first letters.
SOMETHING = f"[^{WS_CLASS}]"
KNOWN = rf"(?iu)^(?![{WS_CLASS}]*unknown[{WS_CLASS}]*\z)[{WS_CLASS}]*[^{WS_CLASS}]"

# ASCII word boundary for java.util.regex.
W = "[A-Za-z0-9_]"
B = rf"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"


def word(*alternatives: str) -> str:
    """Pattern of whole words; every alternative starts and ends with a word character.

    The class of first letters lets the engine pass over most positions with one test.
    """
    first = "".join(dict.fromkeys(re.match(r"\(?(\w)", a).group(1) for a in alternatives))
    return rf"(?=[{first}])(?<!{W})(?:{'|'.join(alternatives)})(?!{W})"


def half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


def ratio3(c: Column) -> Column:
    """Ratio cut to 0..1 with three digits; null stays null."""
    r = half_up(c * 1000) / 1000
    return F.when(c.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), r)))


def percent_text(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("n/a")).otherwise(
        F.concat(half_up(c * 100).cast("string"), F.lit("%"))
    )


def clamp_score(c: Column) -> Column:
    return (
        F.when(c < 0, F.lit(0)).when(c > 100, F.lit(100)).otherwise(half_up(c)).cast("int")
    )


def ratio_of(num: Column, den: Column) -> Column:
    """num / den, null when there is nothing to divide by."""
    return F.when(den > 0, num.cast("double") / den)


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, WS, " "))


def text(c: Column) -> Column:
    """Normalised text, empty instead of null."""
    return F.coalesce(collapse(c), F.lit(""))


def column_text(name: str) -> Column:
    """``text`` of a column; one that is ASCII without runs of blanks or other white space, as letters tell, meets no pattern."""
    c = F.col(name)
    clean = F.octet_length(c) == F.length(c)
    for odd in ("  ", "\t", "\n", "\x0b", "\f", "\r"):
        clean = clean & ~c.contains(odd)
    return F.when(clean, F.trim(c)).otherwise(text(c))


def lower_text(c: Column) -> Column:
    return F.lower(text(c))


def nonempty(c: Column) -> Column:
    """null for the empty string, otherwise unchanged."""
    return F.nullif(c, F.lit(""))


def is_blank(c: Column) -> Column:
    """Null or white space alone, as ``text(c) == ""``."""
    return ~F.coalesce(c.rlike(SOMETHING), F.lit(False))


def is_present(c: Column) -> Column:
    """Neither blank nor "unknown" in any case, as ``lower_text`` would show it."""
    return F.coalesce(c.rlike(KNOWN), F.lit(False))


def join_text(arr: Column, sep: str = ", ") -> Column:
    return F.array_join(arr, sep)


def first_present(*cols: Column) -> Column:
    return F.coalesce(*[nonempty(c) for c in cols])


def iso(c: Column) -> Column:
    """UTC timestamp as ISO text with milliseconds."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def packed(c: Column) -> Column:
    """Text as bytes for exchanges and joins: digests in lower-case hex take half the room, different texts stay different."""
    raw = F.unhex(c)
    return F.when(F.lower(F.hex(raw)) == c, F.concat(F.lit(bytearray(b"\x01")), raw)).otherwise(F.concat(F.lit(bytearray(b"\x00")), F.encode(c, "UTF-8")))


def unpacked(c: Column) -> Column:
    """The text of ``packed`` bytes."""
    rest = F.substring(c, 2, 1 << 30)
    return F.when(F.substring(c, 1, 1) == F.lit(bytearray(b"\x01")), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))
