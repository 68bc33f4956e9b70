"""Helpers shared by the operators: stored stages, hashed words, components."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

# Rows per Arrow batch: texts are long, so batches are kept short.
ARROW_ROWS = 512
# Bytes of text whose word hashes are computed in one go.
PIECE_BYTES = 1 << 20

SHINGLE_WORDS = 5


def prepare(spark: SparkSession) -> None:
    """Session settings that every operator relies on."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a stage to the shared folder and read it back. The result has no
    lineage, so losing an executor later repeats nothing before this point."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows that may be sent to every executor: some tens of megabytes of ids.
FEW_ROWS = 500_000


def few(df: DataFrame) -> DataFrame:
    """``df`` (stored) marked for a broadcast join if its rows are counted to
    be few; beyond that the join shuffles both sides."""
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


# ---------------------------------------------------------------------------
# words as 64-bit hashes, computed for whole batches of texts
# ---------------------------------------------------------------------------

U64 = np.uint64
# odd constants of a polynomial hash and of a 64-bit finaliser
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[U64, np.ndarray] = {}


def powers(base: U64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE_BYTES + 1), base, dtype=U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= PIECE_BYTES + 1:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _hash_piece(data: np.ndarray, separators: np.ndarray):
    """Hash, start and end of each word of one piece of text."""
    d = _LOWER[data]
    inside = np.zeros(len(d) + 2, dtype=np.int8)
    inside[1:-1] = ~separators[d]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    total = np.zeros(len(d) + 1, dtype=U64)
    np.cumsum((d.astype(U64) + U64(1)) * powers(_BASE, len(d)), out=total[1:])
    h = (total[end] - total[start]) * powers(_BASE_INV, len(d) + 1)[start]
    return mix(h + (end - start).astype(U64)), start, end


def _pieces(text: bytes):
    """Cut a text at white space into pieces of about PIECE_BYTES."""
    at = 0
    while len(text) - at > PIECE_BYTES:
        cut = max(text.rfind(b" ", at, at + PIECE_BYTES), text.rfind(b"\n", at, at + PIECE_BYTES))
        if cut <= at:
            ahead = [x for x in (text.find(b" ", at + PIECE_BYTES), text.find(b"\n", at + PIECE_BYTES)) if x >= 0]
            if not ahead:
                break
            cut = min(ahead)
        yield at, text[at:cut + 1]
        at = cut + 1
    yield at, text[at:]


class Words:
    """The words of a batch of texts, lower-cased (A-Z) and hashed.

    h: hash, doc: number of the text, line: number of newlines before the
    word, start and end: byte offsets in its text. ``separators`` marks the
    byte values between words; a space and a newline must be among them.
    """

    def __init__(self, texts: list[bytes], separators: np.ndarray = _SPACE):
        h, doc, line, start, end = [], [], [], [], []

        def add(buffer: bytes, docs: list[tuple[int, int, int]], lines_before: int):
            data = np.frombuffer(buffer, dtype=np.uint8)
            if not len(data):
                return 0
            hh, s, e = _hash_piece(data, separators)
            newlines = np.concatenate([[0], np.cumsum(data == 10)])
            begins = np.array([x[1] for x in docs])
            which = np.searchsorted(begins, s, side="right") - 1
            numbers, first = np.array([x[0] for x in docs]), np.array([x[2] for x in docs])
            h.append(hh)
            doc.append(numbers[which])
            line.append(newlines[s] - newlines[begins][which] + lines_before)
            start.append(s - begins[which] + first[which])
            end.append(e - begins[which] + first[which])
            return int(newlines[-1])

        group, docs, size = [], [], 0
        for i, t in enumerate(texts):
            if len(t) > PIECE_BYTES:
                before = 0
                for at, piece in _pieces(t):
                    before += add(piece, [(i, 0, at)], before)
                continue
            if size + len(t) > PIECE_BYTES:
                add(b"".join(group), docs, 0)
                group, docs, size = [], [], 0
            docs.append((i, size, 0))
            group += [t, b" "]
            size += len(t) + 1
        if docs:
            add(b"".join(group), docs, 0)
        cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, dtype=kind)
        self.h, self.doc, self.line = cat(h, U64), cat(doc, np.int64), cat(line, np.int64)
        self.start, self.end = cat(start, np.int64), cat(end, np.int64)
        if len(self.doc) and (np.diff(self.doc) < 0).any():      # long texts are added between groups
            order = np.argsort(self.doc, kind="stable")
            for k in ("h", "doc", "line", "start", "end"):
                setattr(self, k, getattr(self, k)[order])


def units(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First position and length of each run of equal keys."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, n))


_SHIFT = [U64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingles(h: np.ndarray, first: np.ndarray, length: np.ndarray, width: int = SHINGLE_WORDS):
    """Hashes of all runs of ``width`` words inside each unit, and how many a
    unit has. A shorter unit has one: its whole sequence."""
    n = len(h)
    if not len(first):
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    count = np.maximum(length - width + 1, 1)
    offset = np.concatenate([[0], np.cumsum(count)])
    where = np.repeat(first - offset[:-1], count) + np.arange(offset[-1])
    used = np.repeat(np.minimum(length, width), count)
    out = np.zeros(offset[-1], dtype=U64)
    for j in range(width):
        use = used > j
        at = np.minimum(where + j, n - 1)
        if use.all():
            out += mix(h[at] * _SHIFT[j % 5] + U64(j))
        else:
            out[use] += mix(h[at[use]] * _SHIFT[j % 5] + U64(j))
    return mix(out + used.astype(U64)), count


def minhashes(s: np.ndarray, count: np.ndarray, n_hashes: int, seed: int = 7) -> np.ndarray:
    """(units, n_hashes) smallest value of each hash function over a unit's shingles."""
    if not len(count):
        return np.zeros((0, n_hashes), dtype=U64)
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, n_hashes, dtype=np.uint64) * U64(2) + U64(1)
    b = rng.integers(0, 1 << 63, n_hashes, dtype=np.uint64)
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    out = np.empty((len(count), n_hashes), dtype=U64)
    for j in range(n_hashes):
        x = (s ^ b[j]) * a[j]
        x ^= x >> U64(29)
        out[:, j] = np.minimum.reduceat(x, begin)
    return out


def sequence_hash(h: np.ndarray, first: np.ndarray, length: np.ndarray, base: int) -> np.ndarray:
    """64-bit hash of each unit's whole word sequence."""
    if not len(first):
        return np.zeros(0, dtype=U64)
    place = np.arange(len(h)) - np.repeat(first, length)
    p = powers(U64(base), int(place.max()) + 1)
    return mix(np.add.reduceat(mix(h ^ U64(base)) * p[place], first) + length.astype(U64))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def text_bytes(column) -> list[bytes]:
    """Bytes of a string column, empty for null."""
    column = column if isinstance(column, pa.Array) else column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


# ---------------------------------------------------------------------------
# connected components
# ---------------------------------------------------------------------------

def components(edges: DataFrame, name: str = "components", start: DataFrame | None = None) -> DataFrame:
    """(id, comp): smallest id reachable over the links (a, b), for each id
    that has one. ``start`` is such a result for other links; its ids and
    theirs are joined further.

    Each round points every id to the smallest id it is linked with, then to
    what that points to, and contracts the links to the ids pointed to. At
    least half of the linked ids vanish in a round, and in practice nearly all
    do. A hub's links are reduced by partial minima before the shuffle."""
    links = edges.select("a", "b")
    if start is not None:
        links = _through(_through(links, start.select(F.col("id").alias("a"), F.col("comp").alias("to")), "a"),
                         start.select(F.col("id").alias("b"), F.col("comp").alias("to")), "b")
    links = stored(_ordered(links), name + "-edges")
    steps = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("low")), name)
        up = low.select(F.col("id").alias("low"), F.col("low").alias("to"))
        low = stored(low.join(up, "low").select("id", "to"), name)
        steps.append(low)
        links = stored(_ordered(links.join(low.withColumnRenamed("id", "a"), "a").select(F.col("to").alias("a"), "b")
                                     .join(low.withColumnRenamed("id", "b"), "b").select("a", F.col("to").alias("b"))), name + "-edges")
    if not steps:
        return start if start is not None else links.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    label = steps[0].select("id", F.col("to").alias("comp"))
    for step in steps[1:]:
        label = _through(label, step.withColumnRenamed("id", "comp"), "comp")
    if start is not None:
        label = stored(label, name)
        label = (_through(start, label.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp")
                 .unionByName(label.join(start.select("id"), "id", "left_anti")))
    return stored(label.select("id", "comp"), name)


def _through(rows: DataFrame, step: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` replaced by what ``step`` (column, to) says, if anything."""
    rest = [F.coalesce("to", column).alias(column) if c == column else F.col(c) for c in rows.columns]
    return rows.join(step, column, "left").select(*rest)


def _ordered(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
