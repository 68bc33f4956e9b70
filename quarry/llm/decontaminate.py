"""Benchmark decontamination: close word pairs, then Smith-Waterman.

1. Each test item is cut into words (lower-cased runs of letters and digits).
   Its seeds are all pairs of words that stand next to each other or with one
   word between.
2. One pass looks the same pairs of the documents up. An alignment (match 2,
   mismatch -1, gap -1 per word, local) of score s holds at least s / 2 - 1
   pairs of successive matches that at most one edit parts, because every other
   step between matches costs two; such a pair is a seed on both sides. So does
   its span follow: at most 3 n - s words of the document for n words. A passage
   without so many seeds in so many words cannot reach the threshold, and every
   other one is aligned: nothing that reaches the threshold is missed.
3. Overlapping passages of an item are merged; one that shares enough words is
   aligned with the item. The score is the alignment's share of the item's full
   score.

Seeds travel to the tasks in blocks of at most ``BLOCK_SEEDS``; a larger test
set takes more passes, not more memory. All work on a document is done in the
task that reads it, so there is nothing to skew; hits are handled ``HITS`` at a
time.

Defined cases: null and empty texts match nothing; items of fewer than three
words match nothing; repeated rows and repeated items are
judged each by itself; an empty table on either side gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, mix, prepare, stored, units

LEAST_WORDS = 3         # of an item
THRESHOLD = 0.4
BLOCK_SEEDS = 1_000_000
HITS = 4_000_000        # (word, item) rows that are sorted at once
MATCH, MISS, GAP = 2, -1, -1
_LETTERS = np.ones(256, dtype=bool)      # bytes that separate words
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _words(texts: list[str | None]) -> Words:
    return Words([(t or "").lower().encode() for t in texts], separators=_LETTERS)


def _pairs(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word with the next one and the one after it, and the
    places of the first words, in the order of the words."""
    value, real = np.zeros((len(h), 2), dtype=U64), np.zeros((len(h), 2), dtype=bool)
    for k in (1, 2):
        value[:-k, k - 1] = mix(h[:-k] * U64(0x9E3779B97F4A7C15) + h[k:])
        real[:-k, k - 1] = doc[:-k] == doc[k:]
    return value[real], np.nonzero(real)[0]


class Lookup:
    """Sorted values with a bit table in front; most misses end there."""

    def __init__(self, values: np.ndarray):
        self.values = np.sort(values)
        self.mask = U64((1 << max(16, int(math.log2(max(1, len(values)))) + 6)) - 1)
        self.table = np.zeros(int(self.mask) + 1, dtype=bool)
        self.table[(values & self.mask).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in x of known values, and where in ``values`` they are."""
        at = np.flatnonzero(self.table[(x & self.mask).astype(np.int64)])
        if not len(at) or not len(self.values):
            return at[:0], at[:0]
        where = np.minimum(np.searchsorted(self.values, x[at]), len(self.values) - 1)
        hit = self.values[where] == x[at]
        return at[hit], where[hit]


class Items:
    """Words and seeds of a block of test items."""

    def __init__(self, ids: list, words: list[np.ndarray], pairs: list[np.ndarray], threshold: float):
        self.ids, self.words = ids, words
        value, item = np.concatenate(pairs), np.repeat(np.arange(len(pairs)), [len(x) for x in pairs])
        order = np.argsort(value, kind="stable")
        self.seeds, self.item = value[order], item[order]
        size = np.array([len(x) for x in words])
        score = np.ceil(threshold * MATCH * size - 1e-9).astype(np.int64)
        self.need = np.maximum(1, (score + 1) // 2 - 1)      # seeds of an alignment that reaches the threshold
        self.span = 3 * size - score                         # its words at most


def align(item: np.ndarray, passages: list[np.ndarray]):
    """Best local alignments of one item with passages: score, and first and
    last matched word of the passage and of the item."""
    n, m, width = len(passages), len(item), max(len(p) for p in passages)
    words = np.zeros((n, width), dtype=U64)
    real = np.zeros((n, width), dtype=bool)
    for k, p in enumerate(passages):
        words[k, :len(p)], real[k, :len(p)] = p, True
    h = np.zeros((n, width + 1), dtype=np.int32)
    start = np.zeros((n, width + 1), dtype=np.int64)       # passage start * 2^20 + item start of the alignment ending here
    best, best_end, best_start = np.zeros(n, dtype=np.int32), np.zeros((n, 2), dtype=np.int64), np.zeros(n, dtype=np.int64)
    fresh = np.arange(width, dtype=np.int64) << 20
    ramp = np.arange(width + 1, dtype=np.int32) * -GAP
    for i in range(m):
        step = np.where((words == item[i]) & real, MATCH, MISS).astype(np.int32)
        diagonal = h[:, :-1] + step
        diagonal_start = np.where(h[:, :-1] > 0, start[:, :-1], fresh + i)
        up = h[:, 1:] + GAP
        cell = np.maximum(np.maximum(diagonal, up), 0)
        cell_start = np.where(diagonal >= up, diagonal_start, start[:, 1:])
        new, new_start = np.zeros_like(h), np.zeros_like(start)
        new[:, 1:], new_start[:, 1:] = cell, cell_start
        # gaps along the passage: the running maximum of value + distance
        lifted = new + ramp
        peak = np.maximum.accumulate(lifted, axis=1)
        source = np.maximum.accumulate(np.where(lifted == peak, np.arange(width + 1), 0), axis=1)
        new = np.maximum(peak - ramp, 0)
        new_start = np.take_along_axis(new_start, source, axis=1)
        h, start = new, new_start
        top = h[:, 1:].argmax(axis=1)
        value = h[np.arange(n), top + 1]
        better = value > best
        best[better] = value[better]
        best_end[better] = np.column_stack([top, np.full(n, i)])[better]
        best_start[better] = start[np.arange(n), top + 1][better]
    return best, best_start >> 20, best_end[:, 0], best_start & ((1 << 20) - 1), best_end[:, 1]


def _passages(w: Words, items: Items, seeds: Lookup):
    """(item, first word, end) of stretches with enough seeds of an item, by
    item and place; words are counted over all texts in a row."""
    value, place = _pairs(w.h, w.doc)
    at, where = seeds.find(value)
    if not len(at):
        return
    place = place[at]
    # a seed may belong to several items
    low, high = np.searchsorted(items.seeds, seeds.values[where], "left"), np.searchsorted(items.seeds, seeds.values[where], "right")
    reps = high - low
    total = np.concatenate([[0], np.cumsum(reps)])
    first, length = units([w.doc])
    begin_of, end_of = np.repeat(first, length), np.repeat(first + length, length)
    reach, a = int(items.span.max()), 0
    while a < len(place):
        b = int(np.searchsorted(total, total[a] + HITS, "right")) - 1
        stop = int(place[b]) if b < len(place) else len(w.h)     # windows that begin before this word
        stop = max(stop, int(place[a]) + 1)
        b, far = int(np.searchsorted(place, stop)), int(np.searchsorted(place, stop + reach))
        n = reps[a:far]
        seed = np.repeat(low[a:far] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        key = np.sort((items.item[seed] << 40) | np.repeat(place[a:far], n))
        key = key[np.concatenate([[True], np.diff(key) != 0])]
        item, word = key >> 40, key & ((1 << 40) - 1)
        last = np.arange(len(key)) + items.need[item] - 1
        fits = np.flatnonzero((last < len(key)) & (word < stop))
        last = last[fits]
        ok = (item[last] == item[fits]) & (word[last] - word[fits] < items.span[item[fits]]) & (begin_of[word[last]] == begin_of[word[fits]])
        fits, last = fits[ok], last[ok]
        item, begin, end = item[fits], word[last] - items.span[item[fits]] + 1, word[fits] + items.span[item[fits]]
        begin, end = np.maximum(begin, begin_of[word[fits]]), np.minimum(end, end_of[word[fits]])
        rows = list(zip(item.tolist(), begin.tolist(), end.tolist(), strict=True))
        k = 0
        while k < len(rows):
            i, f, e = rows[k]
            k += 1
            limit = f + 3 * int(items.span[i])
            while k < len(rows) and rows[k][0] == i and rows[k][1] < e and rows[k][2] <= limit:
                e = rows[k][2]
                k += 1
            yield i, f, e
        a = b


def _matches(w: Words, items: Items, seeds: Lookup, threshold: float):
    """(text, item, score, first word, last word, matched share) of good passages."""
    merged: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    first, _ = units([w.doc])
    for i, b, e in _passages(w, items, seeds):
        own = w.h[b:e]
        # no more words can match than the item and the passage share
        if np.isin(items.words[i], own).sum() >= threshold * len(items.words[i]):
            merged.setdefault(i, []).append((int(w.doc[b]), b - int(first[np.searchsorted(first, b, "right") - 1]), own))
    out = []
    for i, passages in merged.items():
        full = MATCH * len(items.words[i])
        for a in range(0, len(passages), 256):
            part = passages[a:a + 256]
            score, p0, p1, i0, i1 = align(items.words[i], [x[2] for x in part])
            for k, (d, b, _) in enumerate(part):
                if score[k] >= threshold * full:
                    out.append((d, i, score[k] / full, b + int(p0[k]), b + int(p1[k]), (int(i1[k]) - int(i0[k]) + 1) / len(items.words[i])))
    return out


def _blocks(benchmark: DataFrame):
    """Blocks of (ids, words, pairs) of test items."""
    ids, words, pairs, size = [], [], [], 0
    for r in benchmark.select("item_id", F.col("text").cast("string").alias("text")).orderBy("item_id", "text").toLocalIterator():
        w = _words([r.text])
        if len(w.h) < LEAST_WORDS:
            continue
        ids.append(r.item_id)
        words.append(w.h)
        pairs.append(np.unique(_pairs(w.h, w.doc)[0]))
        size += len(pairs[-1])
        if size >= BLOCK_SEEDS:
            yield ids, words, pairs
            ids, words, pairs, size = [], [], [], 0
    if ids:
        yield ids, words, pairs


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and item with a passage that scores ``threshold``
    or more: doc_id, item_id, score, first_word, last_word (of the best
    passage, in words of letters and digits), item_share."""
    spark = docs.sparkSession
    prepare(spark)
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, score double, first_word long, last_word long, item_share double"
    found = spark.createDataFrame([], schema)
    for ids, words, pairs in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(Items(ids, words, pairs, threshold))      # at most BLOCK_SEEDS, and one item more

        def match(batches, shared=shared):
            own = shared.value
            lookup = Lookup(np.unique(own.seeds))
            for batch in batches:
                best = {}
                for row in _matches(_words(batch.column(1).to_pylist()), own, lookup, threshold):
                    best[row[:2]] = max(best.get(row[:2], row), row, key=lambda r: (r[2], -r[3]))
                rows = sorted(best.values())
                cols = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array([own.ids[i] for i in cols[1]], _arrow(item_kind)),
                     pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.float64())],
                    names=["doc_id", "item_id", "score", "first_word", "last_word", "item_share"])

        found = found.unionByName(stored(text.mapInArrow(match, schema), "leaks"))
    return found


def _arrow(kind: str):
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def without_leaks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents without those that hold a passage of a test item."""
    gone = found.select(F.col("doc_id").alias("__doc")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__doc")), "left_anti")
