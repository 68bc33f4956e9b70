"""Compression classifier for text quality.

Two zstandard dictionaries are trained, one from good and one from bad
labelled texts. A text is compressed in blocks with each of them; what it
costs more with the good dictionary than with the bad one, per byte of text,
says which class it resembles. A logistic curve fitted on labelled texts that
the dictionaries have not seen turns the difference, together with the texts'
own compression rate (worn-out repetition compresses well with either), into
a probability. Blocks keep the dictionaries' weight the same in short and in
long texts; every byte of a text is in one block.

Fitting uses a bounded sample (``SAMPLE`` texts of each class, those of at most
``SAMPLE_BYTES`` bytes, in the order of a hash), scoring covers everything.

Defined cases: null and empty texts have features of 0 and get the curve's
value there; a document is scored by its text alone, so equal texts get equal
scores; without labelled texts of both classes the score is the share of good
labels, smoothed; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_bytes

SAMPLE, SAMPLE_BYTES = 1200, 16384
DICT_BYTES = 65536
BLOCK = 1024
LEVEL = 1
SHORT_BYTES = 64        # a text of this length counts half
THRESHOLD = 0.7


def held_out(key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2


class Model:
    """Dictionaries (bytes) and curve; small enough to travel in a closure."""

    def __init__(self, good: bytes, bad: bytes, weights, prior: float):
        self.good, self.bad, self.weights, self.prior = good, bad, weights, prior
        self.tools = None

    def __getstate__(self):
        return {**self.__dict__, "tools": None}

    def features(self, text: bytes) -> tuple[float, float, float, int]:
        if not text:
            return 0.0, 0.0, 0.0, 0
        if self.tools is None:
            dicts = [zstandard.ZstdCompressionDict(x) for x in (self.good, self.bad)]
            for d in dicts:
                d.precompute_compress(level=LEVEL)
            plain = {"write_content_size": False, "write_checksum": False}
            self.tools = [zstandard.ZstdCompressor(dict_data=d, **plain) for d in dicts] + [zstandard.ZstdCompressor(level=LEVEL)]
        by_good, by_bad, alone = (x.compress for x in self.tools)
        view = memoryview(text)
        g = b = a = 0
        for at in range(0, len(text), BLOCK):
            part = view[at:at + BLOCK]
            g += len(by_good(part))
            b += len(by_bad(part))
            a += len(alone(part))
        n = len(text)
        return (g - b) / n, (g - b) / (g + b), a / n, n

    def score(self, text: bytes) -> float:
        if self.weights is None:
            return self.prior
        if not text:
            return float(_curve(np.zeros((1, 4)), self.weights)[0])
        return float(_curve(np.array([self.features(text)]), self.weights)[0])


def _design(x: np.ndarray) -> np.ndarray:
    """Difference per byte and per compressed byte, the rate, and how far the
    rate is below usual; each counts less the shorter the text is."""
    trust = x[:, 3] / (x[:, 3] + SHORT_BYTES)
    low = np.maximum(0, 0.4 - x[:, 2]) * (x[:, 2] > 0)
    return np.column_stack([x[:, 0] * 20 * trust, x[:, 1] * 10 * trust, (x[:, 2] - 0.5) * 2 * trust, low * 20 * trust, np.ones(len(x))])


def _curve(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_design(x) @ weights, -30, 30)))


def _fit_curve(x: np.ndarray, y: np.ndarray, prior: float, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Logistic regression by Newton steps; the classes weigh as among all labels."""
    d = _design(x)
    weight = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum()))
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        g = d.T @ (weight * (p - y)) + ridge * 1e-2 * w
        h = (d * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ d + np.eye(len(w)) * ridge * 1e-2
        w = w - np.linalg.solve(h, g)
    return w


def sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> dict[int, list[bytes]]:
    """Training texts of each class: ``limit`` labelled ids a class in hash
    order, and of those the texts of 1 to SAMPLE_BYTES bytes."""
    marked = labels.where(~held_out() & F.col("quality").isin(0, 1)).select("doc_id", "quality").distinct()
    ids = None
    for value in (0, 1):
        own = marked.where(F.col("quality") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        ids = own if ids is None else ids.unionByName(own)
    # 2 * limit ids at most are broadcast
    rows = (docs.where(F.octet_length("text").between(1, SAMPLE_BYTES)).join(F.broadcast(ids), "doc_id")
                .select("quality", "text").distinct().orderBy("quality", F.xxhash64("text"), "text").collect())
    return {value: [r.text.encode() for r in rows if r.quality == value] for value in (0, 1)}


def train(docs: DataFrame, labels: DataFrame) -> Model:
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
    own = sample(texts, marks)
    count = {r.quality: r.n for r in marks.where(~held_out() & F.col("quality").isin(0, 1)).groupBy("quality").agg(F.count("*").alias("n")).collect()}
    return fit(own[1], own[0], (count.get(1, 0) + 1) / (sum(count.values()) + 2))


def fit(good: list[bytes], bad: list[bytes], prior: float) -> Model:
    """Dictionaries from every other text, the curve from the rest."""
    if len(good) < 8 or len(bad) < 8:
        return Model(b"", b"", None, prior)
    # lines that several texts share say nothing about a class, but would fill its dictionary
    seen = Counter(line for t in good + bad for line in set(t.split(b"\n")))

    def dictionary(own: list[bytes]) -> bytes:
        alone = [b"\n".join(x for x in t.split(b"\n") if seen[x] == 1) for t in own]
        parts = [t[i:i + BLOCK] for t in alone for i in range(0, len(t), BLOCK)]
        size = min(DICT_BYTES, max(1024, sum(map(len, parts)) // 8))
        try:
            return zstandard.train_dictionary(size, parts, level=LEVEL).as_bytes()
        except zstandard.ZstdError:      # too little text to train on: its content is the dictionary
            return b"".join(parts)[-DICT_BYTES:]

    m = Model(dictionary(good[::2]), dictionary(bad[::2]), None, prior)
    x = np.array([m.features(t) for t in good[1::2] + bad[1::2]])
    y = np.array([1] * len(good[1::2]) + [0] * len(bad[1::2]))
    m.weights = _fit_curve(x, y, prior)
    return m


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score ``threshold`` or more, all columns as they are."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(t) >= threshold for t in text_bytes(batch.column(at))], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep`` columns of the documents and the score."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)        # two dictionaries of DICT_BYTES
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches):
        m = shared.value
        for batch in batches:
            scores = [m.score(t) for t in text_bytes(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*keep, "score"])

    text = F.col("text").cast("string").alias("__text")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return docs.select(*keep, text).mapInArrow(run, schema + ", score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    prepare(docs.sparkSession)
    model = train(docs, labels)
    return (score(docs, model, "doc_id")
            .select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))
