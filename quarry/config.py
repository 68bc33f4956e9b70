"""Engine parameters and fixed values.

Defaults follow the behaviour the engine reproduces (chunk window, k of
each top-k stage, RRF constant, exact-match bonus steps, cache TTL, ...).
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must stay equal for identical results)
# ---------------------------------------------------------------------------

# Token pattern for the lexical index: runs of >= 2 letters/digits/underscore.
TOKEN_CLASS = r"[\p{L}\p{N}_]"
TOKEN_PATTERN = TOKEN_CLASS + "{2,}"

# Whitespace for word splitting: Unicode whitespace plus the four
# information-separator controls that str.split() also breaks on.
WORD_SPLIT = r"(?U)[\x1c-\x1f\s]+"

# Words per token used to turn a token budget into words.
WORDS_PER_TOKEN = 1.3

# Query parameters dropped during URL normalisation.
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "ref", "fbclid", "gclid", "source", "si", "_hsenc", "_hsmi",
)

# Abbreviations expanded by query simplification; the first one found, in
# this order, is expanded (first occurrence only).
ABBREVIATIONS = (
    ("RAG", "retrieval augmented generation"),
    ("LLM", "large language model"),
    ("NLP", "natural language processing"),
    ("CV", "computer vision"),
    ("ML", "machine learning"),
    ("AI", "artificial intelligence"),
    ("DL", "deep learning"),
    ("RL", "reinforcement learning"),
    ("GAN", "generative adversarial network"),
    ("CNN", "convolutional neural network"),
    ("RNN", "recurrent neural network"),
)

# Search engines: the safe fallback list, in preference order.
FALLBACK_ENGINES = ("duckduckgo", "brave", "qwant", "wikipedia")
LAST_RESORT_ENGINE = "duckduckgo"

# Marker that precedes the final answer channel in a model response.
FINAL_CHANNEL_MARKER = "<|end|><|start|>assistant<|channel|>final<|message|>"

# Page text cut and the suffix appended when cut.
TRUNCATED_SUFFIX = "... [truncated]"

# Corpus file suffixes (case-sensitive).
CORPUS_SUFFIXES = ("md", "txt", "html")


@dataclass(frozen=True)
class IndexConfig:
    chunk_size: int = 512          # tokens
    chunk_overlap: int = 200       # tokens
    min_chunk_length: int = 100    # characters, kept when len >= this
    min_content_length: int = 100  # file skipped when shorter
    reindex_interval_days: int = 7

    @property
    def window_words(self) -> int:
        return int(self.chunk_size / WORDS_PER_TOKEN)

    @property
    def overlap_words(self) -> int:
        return int(self.chunk_overlap / WORDS_PER_TOKEN)

    @property
    def stride_words(self) -> int:
        step = self.window_words - self.overlap_words
        if step <= 0:
            raise ValueError(
                f"chunk_overlap ({self.chunk_overlap}) must be smaller than "
                f"chunk_size ({self.chunk_size}) in words")
        return step


@dataclass(frozen=True)
class SearchConfig:
    top_k_lexical: int = 50
    top_k_dense: int = 50
    rrf_k: int = 60
    fused_limit: int = 60
    top_k_final: int = 5
    rerank_text_chars: int = 512
    exact_bonus_short: float = 2.0    # query length < 10
    exact_bonus_medium: float = 5.0   # query length < 30
    exact_bonus_long: float = 8.0
    guard_margin: float = 0.05
    fresh_text_chars: int = 5000


@dataclass(frozen=True)
class WebConfig:
    max_sources: int = 10
    max_per_domain: int = 2
    cache_ttl_seconds: int = 3600
    page_max_chars: int = 4000
    page_min_chars: int = 100      # kept when len > this
    candidate_limit: int = 20
    snippet_chars: int = 120
    report_chars: int = 150
    max_retries: int = 3
    preferred_engines: tuple = field(default=("duckduckgo", "brave", "qwant", "wikipedia"))
    banned_engines: tuple = field(default=())


# Broadcast guard: sides whose measured bytes are at most this may be broadcast;
# larger sides take the shuffle path.
BROADCAST_MAX_BYTES = 64 << 20
