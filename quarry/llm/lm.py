"""Language-model scores from a log-bilinear model trained by noise contrast.

Tokens are the words of a text (A-Z lower-cased) and one end. Words fall into
classes: the ``SHORT`` most frequent are classes of their own, all others
share ``GROUPS`` classes by their first letters (so unseen words have one too).

* P(class | the CONTEXT classes before it) is a log-bilinear model: a vector
  per context class, a diagonal matrix per position and a vector and a bias per
  predicted class. It is trained by noise-contrastive estimation in numpy, in
  every partition on all its training texts; the partitions' parameters are
  averaged, weighted by tokens. Scores are normalised over all classes: blocks
  of predictions times all class vectors, one matrix product each.
* P(word | class) = (c + 1) / (sum over the class's words of (c + 1), + 1): the
  last 1 is the mass of the class's unseen words.

c are counts over all training documents, made by partial counts per task and
one shuffle on the word. The product is the model's probability of a token.

Counts reach the documents in two ways: those of the ``HOT`` most frequent
words travel to the tasks (a bound on rows), which also keeps words that every
document has out of the joins; the other words are counted per document and
joined with the table of counts.

Defined cases: null and empty texts have one token, the end; rows that share a
doc_id are scored each by itself; rows without a doc_id are training rows;
without training rows c, N and V are 0 and base scores are 0; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored, text_bytes

END = b"\n"             # cannot be a word
SHORT, GROUPS = 255, 192
HOT = 100_000
CONTEXT = 5
DIM = 16
NOISE, BATCH, RATE, PAST = 48, 2048, 0.3, 1e-4
COUNTED = 300_000       # words a task counts before it hands them on
SCORED = 1024           # tokens in one matrix product


def held_out(key: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def tokens(text: bytes) -> list[bytes]:
    words = text.lower().split()        # of bytes: only A-Z change, only ASCII white space splits
    words.append(END)
    return words


class _Groups(dict):
    """Class of a word outside the short list, by its first letters."""

    def __missing__(self, letters: bytes) -> int:
        self[letters] = SHORT + int.from_bytes(letters, "big") * 2654435761 % (1 << 32) * GROUPS // (1 << 32)
        return self[letters]


_GROUP = _Groups()


def group(word: bytes) -> int:
    return _GROUP[word[:3]]


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts."""
    def run(batches):
        count: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for t in text_bytes(batch.column(0)):
                count.update(tokens(t))
            if len(count) > COUNTED:
                yield rows()
                count = Counter()
        yield rows()
    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Lexicon:
    """Hot words: number, count and class."""

    def __init__(self, words: list[bytes], counts: list[int]):
        self.number = {w: i for i, w in enumerate(words)}
        self.count = np.array(counts, dtype=np.float64)
        self.cls = np.array([i if i < SHORT else group(w) for i, w in enumerate(words)], dtype=np.int32)

    def classes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1: not hot) and class of each word."""
        get = self.number.get
        n = np.array([get(w, -1) for w in words], dtype=np.int32)
        cls = self.cls[n] if len(self.cls) else np.zeros(len(n), dtype=np.int32)
        other = np.flatnonzero(n < 0)
        cls[other] = [_GROUP[words[i][:3]] for i in other.tolist()]
        return n, cls


CLASSES = SHORT + GROUPS
START = CLASSES         # what stands before a text


def contexts(cls: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(tokens, CONTEXT) classes before each token of texts in a row, nearest first."""
    place = np.arange(len(cls)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.full((len(cls), CONTEXT), START, dtype=np.int32)
    for j in range(CONTEXT):
        inside = place > j
        out[inside, j] = cls[np.flatnonzero(inside) - 1 - j]
    return out


class Batch:
    """Tokens of texts in a row."""

    def __init__(self, lexicon: Lexicon, texts: list[bytes]):
        own = [tokens(t) for t in texts]
        self.lengths = np.array([len(w) for w in own], dtype=np.int64)
        self.words = [w for part in own for w in part]
        self.number, self.cls = lexicon.classes(self.words)
        self.ctx = contexts(self.cls, self.lengths)


class LogBilinear:
    def __init__(self, log_unigram: np.ndarray, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.r = (rng.standard_normal((CLASSES + 1, DIM)) * 0.3).astype(np.float32)      # context vectors
        self.c = np.full((CONTEXT, DIM), 0.5, dtype=np.float32)                          # diagonal matrices
        self.q = (rng.standard_normal((CLASSES, DIM)) * 0.05).astype(np.float32)         # predicted vectors
        self.b = log_unigram.astype(np.float32).copy()
        self.log_unigram = log_unigram

    NAMES = ("r", "c", "q", "b")

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES]).astype(np.float64)

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k in self.NAMES:
            v = getattr(self, k)
            setattr(self, k, np.ascontiguousarray(flat[at:at + v.size].reshape(v.shape), dtype=np.float32))
            at += v.size

    def predict(self, ctx: np.ndarray) -> np.ndarray:
        out = self.r[ctx[:, 0]] * self.c[0]
        for j in range(1, CONTEXT):
            out += self.r[ctx[:, j]] * self.c[j]
        return out

    def log_probabilities(self, ctx: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of P(target | ctx), normalised over all classes."""
        out = np.empty(len(target))
        q = np.vstack([self.q.T, self.b[None]])                  # the bias as one more dimension
        for a in range(0, len(target), SCORED):
            hat = self.predict(ctx[a:a + SCORED])
            s = np.column_stack([hat, np.ones(len(hat), dtype=np.float32)]) @ q
            np.clip(s, -80, 80, out=s)                           # keeps the sum finite in single precision
            own = s[np.arange(len(s)), target[a:a + SCORED]].astype(np.float64)
            np.exp(s, out=s)
            out[a:a + SCORED] = own - np.log(s.sum(axis=1), dtype=np.float64)
        return out

    def trainer(self, seed: int = 21):
        """step(ctx, target): one noise-contrastive step with Adagrad."""
        rng = np.random.default_rng(seed)
        noise_p = np.exp(self.log_unigram)
        ladder = np.cumsum(noise_p / noise_p.sum())
        log_noise = (np.log(NOISE) + self.log_unigram).astype(np.float32)
        past = {k: np.full(getattr(self, k).shape, PAST, dtype=np.float32) for k in self.NAMES}
        sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))

        def scatter(index, values, size):
            rows = np.ascontiguousarray(values.T, dtype=np.float64)
            return np.stack([np.bincount(index, weights=row, minlength=size) for row in rows], axis=1)

        def step(ctx: np.ndarray, target: np.ndarray) -> None:
            n = len(target)
            noise = np.minimum(np.searchsorted(ladder, rng.random(NOISE)), CLASSES - 1)
            hat = self.predict(ctx)
            q_t, q_n = self.q[target], self.q[noise]
            up = sigmoid((hat * q_t).sum(1) + self.b[target] - log_noise[target]) - 1
            down = sigmoid(hat @ q_n.T + self.b[noise] - log_noise[noise])
            g = {"q": scatter(target, up[:, None] * hat, CLASSES), "b": np.bincount(target, weights=up, minlength=CLASSES)}
            np.add.at(g["q"], noise, down.T @ hat)
            np.add.at(g["b"], noise, down.sum(0))
            d_hat = up[:, None] * q_t + down @ q_n
            back = d_hat[:, None, :] * self.c                    # (tokens, CONTEXT, DIM)
            g["c"] = np.einsum("td,tjd->jd", d_hat, self.r[ctx])
            g["r"] = scatter(ctx.ravel(), back.reshape(-1, DIM), CLASSES + 1)
            for k, v in g.items():
                v = (v / n).astype(np.float32)
                past[k] += v * v
                setattr(self, k, getattr(self, k) - RATE * v / np.sqrt(past[k]))
        return step


def _train(texts: DataFrame, lexicon, start) -> np.ndarray | None:
    """Parameters averaged over the partitions, each trained on all its texts."""
    def run(batches):
        words, model = lexicon.value, LogBilinear(start.value)
        step, seen, ctx, target, waiting = model.trainer(), 0, [], [], 0
        for batch in batches:
            for part in _groups(text_bytes(batch.column(0))):
                b = Batch(words, part)
                ctx.append(b.ctx)
                target.append(b.cls)
                waiting += len(b.cls)
                if waiting >= 16 * BATCH:
                    seen += _steps(step, ctx, target, seen)
                    ctx, target, waiting = [], [], 0
        if waiting:
            seen += _steps(step, ctx, target, seen)
        if seen:
            flat = model.flat() * seen
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat), pa.array(np.full(len(flat), float(seen)))],
                                             names=["i", "v", "n"])

    rows = texts.mapInArrow(run, "i long, v double, n double").groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")).collect()
    if not rows:
        return None
    flat = np.zeros(len(rows))      # one row a parameter
    for r in rows:
        flat[r.i] = r.v
    return flat


def _groups(texts: list[bytes], size: int = 1 << 20):
    """Runs of texts of about ``size`` bytes."""
    at = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield texts[at:i + 1]
            at, total = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def _steps(step, ctx: list, target: list, seed: int) -> int:
    """Mini-batches over gathered texts, shuffled among themselves."""
    c, t = np.concatenate(ctx), np.concatenate(target)
    order = np.random.default_rng(seed).permutation(len(t))
    for a in range(0, len(order), BATCH):
        at = order[a:a + BATCH]
        step(c[at], t[at])
    return len(t)


def _class_mass(counts: DataFrame, lexicon) -> np.ndarray:
    """Sum of (c + 1) over the known words of each class."""
    def run(batches):
        words = lexicon.value
        total = np.zeros(CLASSES)
        for batch in batches:
            _, cls = words.classes(batch.column(0).to_pylist())
            total += np.bincount(cls, weights=batch.column(1).to_numpy() + 1.0, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(total)], names=["cls", "m"])
    mass = np.zeros(CLASSES)
    for r in counts.mapInArrow(run, "cls long, m double").groupBy("cls").agg(F.sum("m").alias("m")).collect():
        mass[r.cls] = r.m
    return mass


def _score_rows(lexicon, model, log_mass, log_all: float, kind: str):
    """Per text: tokens, known hot tokens, their base score, the model's score
    but for the counts of the other words, and those words. Terms are joined
    per token before they are summed: their sums would be large and cancel."""
    def run(batches):
        words, net, mass = lexicon.value, model.value, log_mass.value
        log_c = np.log10(words.count + 1)
        for batch in batches:
            n, hot, hot_log, part, tails, amounts, sizes = [], [], [], [], [], [], []
            for texts in _groups(text_bytes(batch.column(1))):
                b = Batch(words, texts)
                owner = np.repeat(np.arange(len(texts)), b.lengths)
                is_hot = b.number >= 0
                known = np.where(is_hot, log_c[b.number], 0.0) if len(log_c) else np.zeros(len(owner))
                each = net.log_probabilities(b.ctx, b.cls) / math.log(10) - mass[b.cls] + known
                count = lambda v: np.bincount(owner, weights=v, minlength=len(texts))  # noqa: B023, E731
                n.append(b.lengths)
                hot.append(count(is_hot).astype(np.int64))
                hot_log.append(count(np.where(is_hot, known - log_all, 0.0)))
                part.append(count(each))
                other = np.flatnonzero(~is_hot)
                ends = np.searchsorted(owner[other], np.arange(len(texts)), side="right")
                rare, at = [b.words[i] for i in other.tolist()], 0
                for end in ends.tolist():
                    rest = Counter(rare[at:end])
                    tails += rest
                    amounts += rest.values()
                    sizes.append(len(rest))
                    at = end
            cat = lambda v, kind: pa.array(np.concatenate(v) if v else np.zeros(0), kind)
            tail = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.StructArray.from_arrays(
                [pa.array(tails, pa.binary()), pa.array(amounts, pa.int32())], names=["word", "k"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), cat(n, pa.int64()), cat(hot, pa.int64()), cat(hot_log, pa.float64()), cat(part, pa.float64()), tail],
                names=["doc_id", "n_tokens", "hot", "hot_log", "part", "tail"])
    return run, f"doc_id {kind}, n_tokens long, hot long, hot_log double, part double, tail array<struct<word:binary,k:int>>"


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    prepare(spark)
    share = spark.sparkContext.broadcast
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    learn = texts.where(~held_out()).select("text")
    counts = stored(word_counts(learn), "lm-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("c"), "word").limit(HOT).collect()      # HOT rows at most
    lexicon = share(Lexicon([bytes(r.word) for r in top], [r.c for r in top]))
    mass = _class_mass(counts, lexicon) if top else np.zeros(CLASSES)
    with_unseen = mass + (np.arange(CLASSES) >= SHORT)                  # a short-list class has no unseen words
    with_unseen[with_unseen == 0] = 1e-9                                # a class of no word at all
    log_unigram = np.log(with_unseen / with_unseen.sum())
    flat = _train(learn, lexicon, share(log_unigram))
    net = LogBilinear(log_unigram)
    if flat is not None:
        net.load(flat)
    log_all = math.log10(total.n + total.v + 1)
    run, schema = _score_rows(lexicon, share(net), share(np.log10(with_unseen)), log_all, docs.schema["doc_id"].dataType.simpleString())
    rows = stored(texts.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    tail = rows.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.k")
    log_c = F.log10(F.coalesce("c", F.lit(0)) + 1)
    found = (tail.join(counts, "word", "left").groupBy("row")
                 .agg(F.sum(F.col("k") * log_c).alias("tail_log"), F.sum(F.col("k") * (log_c - log_all)).alias("tail_base"), F.sum(F.when(F.col("c").isNotNull(), F.col("k"))).alias("tail_known")))
    full = rows.drop("tail").join(found, "row", "left").na.fill(0, ["tail_log", "tail_base", "tail_known"])
    return full.select("doc_id", held_out().alias("held_out"), "n_tokens", (F.col("hot") + F.col("tail_known")).cast("long").alias("n_known"),
                       F.lit(int(total.n)).cast("long").alias("train_tokens"),
                       (F.col("hot_log") + F.col("tail_base")).alias("base_score"), (F.col("part") + F.col("tail_log")).alias("score"))
