"""Text hygiene: control-character stripping, size limits, secret-like
patterns, and copied-content de-duplication.

content_dedup: the canonical copy of each normalised text (lower-cased,
whitespace squeezed) is the row with the smallest key. The hash -> first key
map is a ``groupBy`` (partial aggregation collapses a hot hash inside each
partition) joined back on the hash; AQE splits a skewed join partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import WORDS_PER_TOKEN
from ..functions.text import collapse_ws, words

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
MAX_CHARS = 10_000
MAX_TOKENS = 10_000
# Control characters removed (tab, newline and carriage return are kept).
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
# Key/token-like patterns that block a text. The leading guard stands for a
# word boundary in Unicode terms (no letter, digit or underscore before).
_G = r"(?<![\p{L}\p{N}_])"
SECRET_PATTERNS = (
    _G + r"(?i:api[_-]?key|secret|token|password|passwd)\s*[:=]\s*[\"']?[A-Za-z0-9_\-./+]{8,}",
    _G + r"AKIA[0-9A-Z]{16}",
    _G + r"sk-[A-Za-z0-9]{20,}",
    _G + r"ghp_[A-Za-z0-9]{36}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_controls(text) -> Column:
    return F.regexp_replace(_c(text), CONTROL_CHARS, "")


def hygiene(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds clean_text, n_chars, n_tokens, too_long, blocked, accepted."""
    clean = strip_controls(text)
    blocked = None
    for p in SECRET_PATTERNS:
        m = F.col("clean_text").rlike(p)
        blocked = m if blocked is None else (blocked | m)
    return (df.withColumn("clean_text", clean)
              .withColumn("n_chars", F.length("clean_text"))
              .withColumn("n_tokens", F.size(words("clean_text")) * F.lit(WORDS_PER_TOKEN))
              .withColumn("too_long", (F.col("n_chars") > MAX_CHARS) | (F.col("n_tokens") > MAX_TOKENS))
              .withColumn("blocked", blocked)
              .withColumn("accepted", ~F.col("too_long") & ~F.col("blocked")))


def content_hash(text) -> Column:
    return F.sha2(collapse_ws(F.lower(_c(text))), 256)


def content_dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds content_hash, canonical_id (smallest key with the same hash) and
    is_duplicate."""
    h = df.withColumn("content_hash", content_hash(text))
    first = h.groupBy("content_hash").agg(F.min(key).alias("canonical_id"))
    return (h.join(first, "content_hash")
             .withColumn("is_duplicate", F.col(key) != F.col("canonical_id")))
