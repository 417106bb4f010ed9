"""Identifiers, list lines, numbers and times, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: The characters of Unicode's White_Space property.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def trim(x: str | Column) -> Column:
    """Without white space at both ends, as Unicode has it."""
    return F.regexp_replace(_c(x), f"^[{WHITE}]+|[{WHITE}]+$", "")


def blank_to_null(x: str | Column) -> Column:
    """Null for an empty string."""
    return F.nullif(_c(x), F.lit(""))


def normalize_isbn(x: str | Column) -> Column:
    """Digits and X only, x made X; X stays wherever it stands.  May be empty."""
    return F.translate(F.regexp_replace(_c(x), "[^0-9Xx]", ""), "x", "X")


def unwrap_isbn(x: str | Column) -> Column:
    """The normal form of a cell that may be wrapped as ``="..."``; nothing left: null."""
    return blank_to_null(normalize_isbn(F.regexp_replace(trim(x), '^="(.*)"$', "$1")))


def isbn10_to_13(x: str | Column) -> Column:
    """The ISBN-13 of an ISBN-10, whose own check digit is not verified; null for anything else."""
    s = normalize_isbn(x)
    body = F.concat(F.lit("978"), F.substring(s, 1, 9))
    weighted = F.lit(0)
    for i in range(12):
        weighted = weighted + F.substring(body, i + 1, 1).try_cast("int") * (3 if i % 2 else 1)
    check = F.pmod(F.lit(10) - F.pmod(weighted, F.lit(10)), F.lit(10))
    return F.when(s.rlike("^[0-9]{9}[0-9X]$"), F.concat(body, check.cast("string")))


def looks_like_isbn(x: str | Column) -> Column:
    """Whether there are exactly 10 or 13 digits."""
    return F.length(F.regexp_replace(_c(x), "[^0-9]", "")).isin(10, 13)


def strip_number_prefix(x: str | Column) -> Column:
    """Without a leading ``12. `` or ``12) `` and the white space after it."""
    return F.regexp_replace(_c(x), f"^[0-9]+[.)] [{WHITE}]*", "")


def parse_line(x: str | Column) -> Column:
    """struct(title, author) of a list's line: split at the last `` by `` in any case, else at the last `` - ``, else all title.

    A split with nothing on one side doesn't count.
    """
    s = strip_number_prefix(trim(x))
    out = F.struct(s.alias("title"), F.lit(None).cast("string").alias("author"))
    for pattern in ("^(.*) - (.*)$", "(?i)^(.*) by (.*)$"):
        title, author = (trim(F.regexp_extract(s, pattern, i)) for i in (1, 2))
        out = F.when((title != "") & (author != ""), F.struct(title.alias("title"), author.alias("author"))).otherwise(out)
    return out


def is_list_entry(x: str | Column) -> Column:
    """Whether a list's line is neither blank nor a comment."""
    s = trim(x)
    return (s != "") & ~F.startswith(s, F.lit("#"))


def position_number(x: str | Column) -> Column:
    """A series position as a double, null if it isn't a plain finite number."""
    c = _c(x)
    return F.when(c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), c.try_cast("double"))


def format_position(p: str | Column) -> Column:
    """Whole numbers without a fraction, others as the shortest decimal, never with an exponent."""
    c = _c(p)
    plain = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,12)").cast("string"), "0+$", ""), r"\.$", "")
    shortest = F.when((F.abs(c) >= 1e-3) & (F.abs(c) < 1e7), c.cast("string")).otherwise(plain)
    return F.when(c == F.floor(c), c.cast("decimal(38,0)").cast("string")).otherwise(shortest)


def url_encode(x: str | Column) -> Column:
    """Percent-encoding of a query parameter, a space as ``%20``."""
    return F.replace(F.url_encode(_c(x)), F.lit("+"), F.lit("%20"))


def iso_utc(ts: Column | None = None) -> Column:
    """A time to the second, such as ``2024-01-31T12:00:00Z``; the session's zone must be UTC.  Now by default."""
    return F.date_format(F.current_timestamp() if ts is None else ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
