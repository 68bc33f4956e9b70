"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts and
full-width forms become Latin letters, invisible characters vanish, digits and
signs inside a word become the letters they stand for, letters repeated three
times and more become one, and whatever else is no letter ends a word. A term
is a whole word (`` scum ``) or the beginning of one (`` lowei``), matched in the
folded text by one automaton that also holds the exception phrases: a match
that lies inside one of those does not count.

Weights are learned: of a bounded sample of labelled training texts
(``SAMPLE`` a class in the order of a hash, of up to ``SAMPLE_BYTES`` bytes) every
word and every beginning of ``SHORTEST`` letters and more is counted by class in
Spark. A candidate enters the lexicon if chance explains so many toxic texts
among those that hold it with a probability below ``FALSE_TERMS`` in all candidates
together, where holding means once, twice or four times and more; its weight is
the logarithm of how much more often it occurs in a toxic text. Of nested
beginnings the most telling one stays, and of equally telling ones the longest. A few common insults
(``INSULTS``) count as if they had been seen where labels say nothing.

A text's matches add up to its weight; the weight per word (and ``EXTRA_WORDS``) and
the weight itself give the probability by a logistic curve. The curve is fitted
on texts whose features come from a lexicon that has not seen them: two
lexicons from the two halves of the sample judge each other's half.

Defined cases: null, empty and letterless texts hold no match and get the
curve's value there; equal texts get equal scores, whatever their ids; without
training labels of both classes the insults alone decide; texts of any length
are read whole; columns beside those named are ignored; an empty table gives an
empty result, and ids that are null are never training rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored, text_bytes

SAMPLE, SAMPLE_BYTES = 3000, 1 << 15
SHORTEST, LONGEST = 4, 12           # letters of a beginning
FALSE_TERMS = 5.0                   # terms that chance may add to the whole lexicon, at most
EXTRA_WORDS = 20.0
HEAVIEST = 8.0
THRESHOLD = 0.7

# Insults that count before any label is seen, and phrases in which such words are harmless.
INSULTS = ("idiot", "idiots", "moron", "morons", "scum", "loser", "losers", "stupid", "pathetic", "worthless", "disgusting")
PHRASES = ("trash can", "trash bin", "trash bag", "clown fish", "sore loser", "scum line", "pond scum", "soap scum")

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m",
              "т": "t", "в": "b", "н": "h", "ԁ": "d", "ӏ": "l", "ո": "n", "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k",
              "τ": "t", "υ": "u", "χ": "x", "ε": "e", "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l"}
# Digits and signs that stand for letters inside a word.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
INVISIBLE = "­​‌‍⁠﻿"

_OTHER = {ord(a): b for a, b in LOOKALIKES.items()} | {ord(c): None for c in INVISIBLE}
# runs of letters and stand-ins that hold one of these; a run without letters is a number, and "wow!" ends with a mark
_SIGNS = re.escape("".join(STAND_INS))
_STANDS_IN = re.compile(rf"[^\W{_SIGNS}_]*[{_SIGNS}](?:[^\W_]|[{_SIGNS}])*")
_LETTER = re.compile(r"[^\W\d_]")
_INSIDE = str.maketrans(STAND_INS)
_LONG_RUN = re.compile(r"([^\W\d_])\1{2,}")
_NO_LETTERS = re.compile(r"[\W\d_]+")


def _read(m: re.Match) -> str:
    """A run with stand-ins read as letters."""
    run = m[0].rstrip("!")
    return run.translate(_INSIDE) + " " * (run != m[0]) if _LETTER.search(run) else " "


def fold(text: str) -> str:
    """The words of a text, folded, with one space around each."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower().translate(_OTHER)
    else:
        text = text.lower()
    text = _STANDS_IN.sub(_read, text)
    return _NO_LETTERS.sub(" ", " " + _LONG_RUN.sub(r"\1", text) + " ")


def beginnings(words) -> set[str]:
    """Candidate terms of a set of words: `` word `` and `` begin``."""
    out = set()
    for w in words:
        out.add(f" {w} ")
        for n in range(SHORTEST, min(len(w), LONGEST) + 1):
            out.add(" " + w[:n])
    return out


def _spellings(term: str) -> set[str]:
    """A term and how it folds if a 1 stands for one of its l."""
    places = [i for i, c in enumerate(term) if c == "l"][:4]
    out = {term}
    for i in places:
        out |= {t[:i] + "i" + t[i + 1:] for t in out}
    return out


class Lexicon:
    """Terms with weights, and phrases in which they do not count."""

    def __init__(self, weights: dict[str, float], phrases=PHRASES):
        self.weights = dict(weights)
        self.phrases = tuple(fold(p) for p in phrases)
        self.machine = None

    def __getstate__(self):
        return {**self.__dict__, "machine": None}

    def _machine(self):
        if self.machine is None:
            import ahocorasick
            m = ahocorasick.Automaton()
            spelled: dict[str, float] = {}
            for term, w in sorted(self.weights.items()):
                for t in _spellings(term):
                    spelled[t] = max(w, spelled.get(t, 0.0)) if t != term else w
            for t, w in spelled.items():
                m.add_word(t, (len(t), w, False))
            for p in self.phrases:
                m.add_word(p, (len(p), self.weights.get(p, 0.0), True))
            m.make_automaton()
            self.machine = m
        return self.machine

    def match(self, text: str) -> tuple[float, int, int]:
        """Weight, number of matches and number of words of a text."""
        folded = fold(text)
        n_words = max(0, folded.count(" ") - 1)
        hits, free = [], []
        if self.weights:
            for end, (length, w, phrase) in self._machine().iter(folded):
                (free if phrase else hits).append((end + 1 - length, end + 1, w))
        # a word counts once, by its heaviest term
        words: dict[int, float] = {}
        for a, b, w in hits:
            if not any(x <= a and b <= y for x, y, _ in free):
                words[a] = max(w, words.get(a, 0.0))
        return sum(words[a] for a in sorted(words)), len(words), n_words


class Model:
    """Lexicon and curve."""

    def __init__(self, lexicon: Lexicon, curve: np.ndarray):
        self.lexicon, self.curve = lexicon, curve

    def score(self, text: str) -> float:
        weight, _, n_words = self.lexicon.match(text)
        return float(1 / (1 + math.exp(-float(np.clip(design(np.array([[weight, n_words]]))[0] @ self.curve, -30, 30)))))


def design(x: np.ndarray) -> np.ndarray:
    """Weight per word, weight, constant; both grow slower and slower."""
    weight, words = x[:, 0], x[:, 1]
    return np.column_stack([np.log1p(100 * weight / (words + EXTRA_WORDS)), np.log1p(weight), np.ones(len(x))])


# of a text without labels: two insults in a sentence are toxic, none is not
PRIOR_CURVE = np.array([1.2, 0.8, -5.0])


def fit_curve(x: np.ndarray, y: np.ndarray, share: float, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps, held near the prior curve; classes
    weigh as among all labels."""
    d = design(x)
    each = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    w = PRIOR_CURVE.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        g = d.T @ (each * (p - y)) + 0.05 * (w - PRIOR_CURVE)
        h = (d * (each * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ d + 0.05 * np.eye(3)
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -1.0, 1.0)
        if np.abs(step).max() < 1e-9:
            break
    return w


def held_out(key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1


def training_texts(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """(toxic, half, text) of the sample: ``limit`` labelled training ids a class
    in hash order, their texts of up to SAMPLE_BYTES bytes, equal ones once."""
    marked = labels.where(~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = None
    for value in (0, 1):
        own = marked.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        ids = own if ids is None else ids.unionByName(own)
    rows = docs.where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(ids), "doc_id")       # 2 * limit ids at most
    once = rows.groupBy(F.sha2("text", 256).alias("_h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    return once.select("toxic", F.pmod(F.crc32(F.col("_h").cast("binary")), F.lit(2)).cast("int").alias("half"), "text")


# a term is told by how many texts hold it this often at least
OFTEN = (1, 2, 4)
MOST = 8                  # occurrences in one text that count for a weight
_COLUMNS = tuple(f"{c}{h}_{k}" for c in "ab" for h in (0, 1) for k in (*OFTEN, "n"))      # toxic and clean texts of each half


def candidate_counts(sample: DataFrame) -> DataFrame:
    """term and ``_COLUMNS``: texts of each class and half that hold it once,
    twice, four times, and its occurrences (up to MOST a text)."""
    width = len(OFTEN) + 1

    def run(batches):
        for batch in batches:
            count: dict[str, list[int]] = {}
            for toxic, half, text in zip(*[c.to_pylist() for c in batch.columns]):
                at = width * ((0 if toxic else 2) + half)
                own: Counter = Counter()
                for word, n in Counter(fold(text).split()).items():
                    for t in beginnings((word,)):
                        own[t] += n
                for t, n in own.items():
                    c = count.setdefault(t, [0] * len(_COLUMNS))
                    for k, m in enumerate(OFTEN):
                        c[at + k] += n >= m
                    c[at + width - 1] += min(n, MOST)
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string())] + [pa.array([c[k] for c in count.values()], pa.int64()) for k in range(len(_COLUMNS))],
                                             names=["term", *_COLUMNS])
    parts = sample.select("toxic", "half", "text").mapInArrow(run, "term string, " + ", ".join(f"{c} long" for c in _COLUMNS))
    return parts.groupBy("term").agg(*[F.sum(c).alias(c) for c in _COLUMNS])


def _chance(a: int, b: int, share: float) -> float:
    """Logarithm of a bound (Chernoff) of the probability that a of a + b texts
    are toxic when ``share`` of all are."""
    p = a / (a + b) if a else 0.0
    if p <= share:
        return 0.0
    q = 0.0 if b == 0 else (1 - p) * math.log((1 - p) / (1 - share))
    return -(a + b) * (p * math.log(p / share) + q)


def choose(counts: list[tuple], toxic: int, clean: int, tries: int) -> dict[str, float]:
    """Terms and weights from (term, toxic counts, clean counts), the counts
    being texts for each of OFTEN and then occurrences; ``tries`` candidates
    were looked at. A weight compares occurrences per text."""
    if not toxic or not clean:
        return {}
    share = toxic / (toxic + clean)
    limit = math.log(FALSE_TERMS / (len(OFTEN) * max(1, tries)))
    rated = [(chance, -len(t), t, a[-1], b[-1]) for t, a, b in counts
             if (chance := min(_chance(x, y, share) for x, y in zip(a[:-1], b[:-1]))) < limit]
    kept: dict[str, float] = {}
    taken: set[str] = set()         # beginnings of kept terms
    for chance, _, t, a, b in sorted(rated):
        own = {t[:n] for n in range(SHORTEST + 1, len(t) + 1)}
        if t in taken or any(x in kept for x in own):
            continue
        kept[t] = max(0.0, min(HEAVIEST, math.log((a + 0.5) / toxic) - math.log((b + 0.5) / clean)))
        taken |= own
    return kept


def with_insults(weights: dict[str, float]) -> dict[str, float]:
    """The insults count as much as a typical learned term; what was learned wins."""
    usual = float(np.median(list(weights.values()))) if weights else 4.0
    return {**{fold(w): usual for w in INSULTS}, **weights}


def train(docs: DataFrame, labels: DataFrame, phrases=PHRASES) -> Model:
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sample = stored(training_texts(texts, marks), "toxic-sample")          # at most 2 * SAMPLE texts
    size = {(r.toxic, r.half): r.n for r in sample.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect()}
    found = stored(candidate_counts(sample), "toxic-terms")
    both = lambda c: F.col(f"{c}0_1") + F.col(f"{c}1_1")
    tries = found.agg(F.count_if(both("a") + both("b") >= 2).alias("n")).first().n
    n = {(t, h): size.get((t, h), 0) for t in (0, 1) for h in (0, 1)}
    # terms of a bounded sample; those of one text, or not commoner in toxic texts, cannot enter a lexicon
    rate = (n[1, 0] + n[1, 1]) / max(1, n[0, 0] + n[0, 1])
    table = found.where((both("a") >= 2) & (F.col("a0_n") + F.col("a1_n") > (F.col("b0_n") + F.col("b1_n")) * rate)).collect()

    def lexicon(halves) -> Lexicon:
        sums = lambda r, c: tuple(sum(r[f"{c}{h}_{k}"] for h in halves) for k in (*OFTEN, "n"))
        chosen = choose([(r.term, sums(r, "a"), sums(r, "b")) for r in table], sum(n[1, h] for h in halves), sum(n[0, h] for h in halves), tries)
        return Lexicon(with_insults(chosen), phrases)

    toxic, clean = n[1, 0] + n[1, 1], n[0, 0] + n[0, 1]
    if not toxic or not clean:
        return Model(Lexicon(with_insults({}), phrases), PRIOR_CURVE)
    halves = [lexicon((0,)), lexicon((1,))]
    x = features(sample, halves)
    share = marks.where(~held_out()).agg(F.avg("toxic")).first()[0]
    y = np.array([r[0] for r in x])
    return Model(lexicon((0, 1)), fit_curve(np.array([r[1:] for r in x]), y, float(share)))


def features(sample: DataFrame, halves: list[Lexicon]) -> list[tuple[int, float, int]]:
    """(toxic, weight, words) of each text of the sample, by the lexicon of the other half."""
    shared = sample.sparkSession.sparkContext.broadcast(halves)       # terms of a bounded sample

    def run(batches):
        for batch in batches:
            rows = [(t, *shared.value[1 - h].match(text)) for t, h, text in zip(*[c.to_pylist() for c in batch.columns])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64()),
                                              pa.array([r[3] for r in rows], pa.int64())], names=["toxic", "weight", "words"])
    rows = sample.select("toxic", "half", "text").mapInArrow(run, "toxic int, weight double, words long")
    return sorted((r.toxic, r.weight, r.words) for r in rows.collect())       # three numbers a text, at most 2 * SAMPLE texts


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep`` columns of the documents and the score, weight and number of matches."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = [x.decode("utf-8", "replace") for x in text_bytes(batch.column(batch.num_columns - 1))]
            found = [m.lexicon.match(t) for t in texts]
            x = np.array([[f[0], f[2]] for f in found], dtype=float).reshape(-1, 2)
            p = 1 / (1 + np.exp(-np.clip(design(x) @ m.curve, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64()), pa.array([f[0] for f in found], pa.float64()),
                                              pa.array([f[1] for f in found], pa.int64())], names=[*keep, "score", "weight", "n_matches"])

    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep) + "score double, weight double, n_matches long"
    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, n_matches for every document."""
    prepare(docs.sparkSession)
    model = train(docs, labels)
    return (score(docs.select("doc_id", "text"), model, "doc_id")
            .select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted"), "n_matches"))
