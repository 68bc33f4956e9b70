"""Language of a text by a bidirectional gated recurrent network over bytes.

Two recurrent layers read each window of ``WINDOW`` bytes from both ends; the
two states at a byte give the probabilities of the languages there. Every byte
of a text lies in one window. A document's probability of a language is the
mean over its letters' bytes. The network is trained in numpy by
backpropagation through time on a bounded sample (about ``SAMPLE`` windows of
each language, drawn by hash from the labelled training rows); applying it is
one pass over the texts, in which every task handles its rows.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
a document is judged by its text alone, so repeated rows agree; ties go to the
language first in order; without labelled rows every document is ``und``; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_bytes

HIDDEN = 8
WINDOW = 64
SAMPLE = 600
SAMPLE_CHARS = 400
STEPS, BATCH, RATE = 260, 256, 0.02
RUN_WINDOWS = 2048
LETTER = regex.compile(r"\p{L}")
BLANK = 32

# bytes as the network sees them: small letters, one blank for every other ASCII character
SEEN = np.arange(256, dtype=np.uint8)
SEEN[:128] = BLANK
SEEN[97:123] = np.arange(97, 123)
SEEN[65:91] = np.arange(97, 123)


def as_seen(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, dtype=np.uint8)
    d = SEEN[raw]
    if len(d) > 1:      # capitals of the Latin-1 letters, two bytes each
        capital = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        d[1:][capital] += 0x20
    return d


def _gate(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)) in place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Network:
    """One direction: X (3H, 256) for bytes, U (3H, H) for the state, c (H) inside the reset gate."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.25).astype(np.float32)
        self.languages, self.hidden = languages, hidden
        self.params = {}
        for way in "fb":
            self.params["X" + way], self.params["U" + way] = draw(3 * hidden, 256), draw(3 * hidden, hidden)
            self.params["c" + way] = np.zeros((hidden, 1), dtype=np.float32)
        self.params["W"], self.params["o"] = draw(len(languages), 2 * hidden), np.zeros((len(languages), 1), dtype=np.float32)

    def states(self, data: np.ndarray, way: str, keep: bool = False):
        """States (T, H, B) of windows (T, B); with ``keep`` what backpropagation needs."""
        h_, x, u, c = self.hidden, self.params["X" + way], self.params["U" + way], self.params["c" + way]
        t_, b = data.shape
        out = np.empty((t_, h_, b), dtype=np.float32)
        h = np.zeros((h_, b), dtype=np.float32)
        tape = []
        gather, a = np.empty((3 * h_, b), dtype=np.float32), np.empty((3 * h_, b), dtype=np.float32)
        for t in (range(t_) if way == "f" else range(t_ - 1, -1, -1)):
            np.take(x, data[t], axis=1, out=gather, mode="clip")
            np.matmul(u, h, out=a)
            zr = _gate(gather[:2 * h_] + a[:2 * h_])
            z, r = zr[:h_], zr[h_:]
            m = a[2 * h_:] + c
            n = gather[2 * h_:] + r * m
            n *= 2
            n = _gate(n)
            n *= 2
            n -= 1                                   # tanh
            if keep:
                tape.append((t, h, z, r, n, m))
            h = n + z * (h - n)
            out[t] = h
        return (out, tape) if keep else out

    def probabilities(self, data: np.ndarray) -> np.ndarray:
        """(T, languages, B) at each byte of windows (T, B)."""
        both = np.concatenate([self.states(data, "f"), self.states(data, "b")], axis=1)
        p = np.matmul(self.params["W"], both)
        p += self.params["o"]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def gradients(self, data: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over weighted positions."""
        h_, t_, b = self.hidden, *data.shape
        g = {k: np.zeros_like(v) for k, v in self.params.items()}
        kept = {way: self.states(data, way, keep=True) for way in "fb"}
        both = np.concatenate([kept["f"][0], kept["b"][0]], axis=1)
        p = np.matmul(self.params["W"], both) + self.params["o"]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        p[:, label, np.arange(b)] -= 1
        p *= (weight / max(1.0, weight.sum()))[:, None, :]
        g["W"] = np.einsum("tlb,thb->lh", p, both)
        g["o"] = p.sum(axis=(0, 2))[:, None]
        back = np.matmul(self.params["W"].T, p)
        for k, way in enumerate("fb"):
            u = self.params["U" + way]
            later = np.zeros((h_, b), dtype=np.float32)
            for t, before, z, r, n, m in reversed(kept[way][1]):
                d = later + back[t, k * h_:(k + 1) * h_]
                dn = d * (1 - z) * (1 - n * n)
                dm = dn * r
                da = np.concatenate([d * (before - n) * z * (1 - z), dn * m * r * (1 - r), dm])
                dx = np.concatenate([da[:2 * h_], dn])
                g["U" + way] += da @ before.T
                g["c" + way] += dm.sum(axis=1, keepdims=True)
                for i in range(3 * h_):
                    g["X" + way][i] += np.bincount(data[t], weights=dx[i], minlength=256).astype(np.float32)
                later = d * z + u.T @ da
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 5):
        """Adam on random windows; each language is drawn equally often."""
        rng = np.random.default_rng(seed)
        seen = [as_seen(t) for t in texts]
        of = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        first = {k: np.zeros_like(v) for k, v in self.params.items()}
        second = {k: np.zeros_like(v) for k, v in self.params.items()}
        with np.errstate(over="ignore"):
            for step in range(1, steps + 1):
                label = rng.integers(0, len(self.languages), batch)
                data = np.full((WINDOW, batch), BLANK, dtype=np.uint8)
                weight = np.zeros((WINDOW, batch), dtype=np.float32)
                for j, k in enumerate(label):
                    d = seen[of[k][rng.integers(len(of[k]))]]
                    at = rng.integers(0, max(1, len(d) - WINDOW + 1))
                    part = d[at:at + WINDOW]
                    data[:len(part), j] = part
                    weight[:len(part), j] = part != BLANK
                g = self.gradients(data, label, weight)
                pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
                for k, v in self.params.items():
                    first[k] = 0.9 * first[k] + 0.1 * g[k]
                    second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
                    v -= (pace * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
        return self

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages) mean probability over the bytes that are not blank."""
        total, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for windows, owner in _windows(texts):
            data = np.ascontiguousarray(windows.T)
            with np.errstate(over="ignore"):
                p = self.probabilities(data)
            use = (data != BLANK).astype(np.float32)
            p *= use[:, None, :]
            each = p.sum(axis=0)
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(owner, weights=each[k], minlength=len(texts))
            count += np.bincount(owner, weights=use.sum(axis=0), minlength=len(texts))
        return total / np.maximum(count, 1)[:, None]


def _windows(texts: list[bytes]):
    """Groups of RUN_WINDOWS windows (rows) and the texts they belong to."""
    rows, owner, have = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t), WINDOW * RUN_WINDOWS):      # a very long text spans several groups
            d = as_seen(t[at:at + WINDOW * RUN_WINDOWS])
            n = -(-len(d) // WINDOW)
            full = np.full(n * WINDOW, BLANK, dtype=np.uint8)
            full[:len(d)] = d
            rows.append(full.reshape(n, WINDOW))
            owner.append(np.full(n, i))
            have += n
            if have >= RUN_WINDOWS:
                yield np.concatenate(rows), np.concatenate(owner)
                rows, owner, have = [], [], 0
    if rows:
        yield np.concatenate(rows), np.concatenate(owner)


def held_out(key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Network for the languages of the training rows, None without any."""
    own = docs.where(~F.coalesce(held_out(), F.lit(False)) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    count = {r.lang: r.n for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}      # one row a language
    if not count:
        return None
    # the share of a language's rows that gives about ``sample`` of them, by a hash of the row
    share = F.create_map(*[F.lit(x) for k, n in sorted(count.items()) for x in (k, sample / n)])[F.col("lang")]
    at = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1))) + 1
    rows = (own.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share * (1 << 20))
               .select("lang", F.substring("text", at.cast("int"), F.lit(SAMPLE_CHARS)).alias("text")).orderBy("lang", "text").collect())
    rows = [r for r in rows if LETTER.search(r.text)]
    languages = sorted({r.lang for r in rows})
    if not languages:
        return None
    net = Network(languages)
    if len(languages) > 1:
        net.fit([r.text.encode() for r in rows], np.array([languages.index(r.lang) for r in rows]))
    return net


def identify(docs: DataFrame, net: Network | None, *keep: str) -> DataFrame:
    """``keep`` columns, lang_pred and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(net)      # a few kilobytes a language
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches):
        model = shared.value
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            lettered = np.array([bool(t) and bool(LETTER.search(t)) for t in column.to_pylist()], dtype=bool)
            p = model.documents(text_bytes(column)) if model is not None else np.zeros((len(lettered), 1))
            best = p.argmax(axis=1) if len(p) else np.zeros(0, dtype=int)
            known = lettered & (model is not None)
            names = [model.languages[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
            score = np.clip(np.where(known, p[np.arange(len(p)), best], 0.0), 0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep) + "lang_pred string, score double"
    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(run, schema)


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    prepare(docs.sparkSession)
    net = train(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    return identify(docs, net, "doc_id").select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
