"""Column-level text helpers (all built-in Catalyst expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import TOKEN_PATTERN, WORD_SPLIT


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text) -> Column:
    """``str.split()`` semantics: split on Unicode whitespace, drop empties."""
    return F.filter(F.split(_c(text), WORD_SPLIT), lambda w: w != F.lit(""))


def tokens(text) -> Column:
    """Index tokens: lower-cased runs of >= 2 word characters, in order."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN_PATTERN), 0)


def collapse_ws(text) -> Column:
    """``" ".join(s.split())``: trim and squeeze Unicode whitespace."""
    return F.array_join(words(text), " ")


def cut(text, n: int, suffix: str | None = None) -> Column:
    """First ``n`` characters; append ``suffix`` only when something was cut."""
    t = _c(text)
    if suffix is None:
        return F.substring(t, 1, n)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit(suffix))).otherwise(t)


def utf8_ignore(content) -> Column:
    """Decode bytes as UTF-8, dropping invalid sequences (errors='ignore')."""
    return F.regexp_replace(F.make_valid_utf8(_c(content).cast("string")), "\ufffd", "")


def strip_ws(text) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(text), r"(?U)^[\x1c-\x1f\s]+|[\x1c-\x1f\s]+$", "")
