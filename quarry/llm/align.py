"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

A text with a space before it is split by a byte-level BPE (A) and by a
piece BPE (B). Token ends are byte offsets; where A and B both end is a cut, and
cuts make groups of tokens that stand for the same bytes. An interval of a
text looks for a cut near its middle: the ends of A tokens around the middle,
in growing rings, are located among the ends of B by bisection. It is cut
there and both halves go on; an interval without a cut is a group. All
intervals of a batch of texts take each step together, so a step is a few array
operations and there is no recursion.

Every pair of an A and a B token that share bytes is a link. A pair's count is
the number of its links in the whole corpus. Texts are worked off in packs of
about ``PACK_BYTES``. A pack stores its pairs with their counts, and for each
document the numbers of its pairs in that list. The counts are summed in Spark by
pair, the highest of each B id is joined to them, and each pack's list comes
back with both, so a pack is read beside its own pairs only and no table of all
pairs is ever sent to every task.

Defined cases: null and empty texts, and texts whose tokens of A or B do not
join to the same bytes (control characters that B drops, its own space mark),
have no tokens: zeros and an empty digest; texts of any length are one piece, a
pack holds at least one; rows may repeat and ids may be null, each row
counts; columns beside doc_id and text are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_vocabulary
from .common import prepare, stored

# Texts tokenized together, and texts whose pairs are stored together.
BATCH_BYTES = 1 << 19
PACK_BYTES = 1 << 23

# The pattern of the byte-level BPE's word pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE_MARK = "▁"


# ---------------------------------------------------------------------------
# tokens and their bytes
# ---------------------------------------------------------------------------

def byte_letters() -> dict[str, int]:
    """The letter of each byte in a byte-level vocabulary: printable bytes
    stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        import tiktoken
        model = json.loads(a_file)
        letters = byte_letters()
        vocab = {word: i for word, i in model["model"]["vocab"].items()}
        special = {x["content"] for x in model.get("added_tokens", ())}
        ranks = {bytes(letters[c] for c in word): i for word, i in vocab.items() if word not in special}
        # ids have to be the order of the merges: then merging by id is merging by rank
        for i, merge in enumerate(model["model"]["merges"]):
            if vocab["".join(merge) if isinstance(merge, list) else merge.replace(" ", "")] != 256 + i:
                raise ValueError("ids of the byte-level vocabulary do not follow its merges")
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for word, i in ranks.items():
            self.a_bytes[i] = word
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(i)[1:-1], 16)]) if self.b.is_byte(i) else piece(i).replace(SPACE_MARK, " ").encode()
                        for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in y], dtype=np.int64) for y in (self.a_bytes, self.b_bytes))
        # decimal ids with what follows them: in a group, at its end
        self.a_words = [f"{i}," for i in range(len(self.a_bytes))] + [f"{i}|" for i in range(len(self.a_bytes))]
        self.b_words = [f"{i}," for i in range(len(self.b_bytes))] + [f"{i};" for i in range(len(self.b_bytes))]

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of each text by A and B, both empty where they do not join to its bytes."""
        out = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1)):
            whole = (" " + text).encode()
            a = self.a.encode_ordinary(" " + text) if text else []
            same = text and b"".join(map(self.a_bytes.__getitem__, a)) == whole and b"".join(map(self.b_bytes.__getitem__, b)) == whole
            out.append((a, b) if same else ([], []))
        return out


_TOOLS: dict[bytes, Tokens] = {}


def tools(a_file: bytes, b_file: bytes) -> Tokens:
    """The process's tokenizers for two files."""
    key = hashlib.sha256(a_file + b_file).digest()
    if key not in _TOOLS:
        _TOOLS.clear()
        _TOOLS[key] = Tokens(a_file, b_file)
    return _TOOLS[key]


# ---------------------------------------------------------------------------
# cuts, groups and links of a batch of texts
# ---------------------------------------------------------------------------

def common_ends(a_ends: np.ndarray, b_ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Marks of the A tokens that end where a B token ends. ``first`` and ``last``
    are the first and last A token of each text; last ones end together."""
    cut = np.zeros(len(a_ends), dtype=bool)
    cut[last] = True
    low, high = first, last                    # tokens low .. high - 1 may end at a cut inside
    while True:
        some = low < high
        low, high = low[some], high[some]
        if not len(low):
            return cut
        middle = (low + high) // 2
        where = np.full(len(low), -1, dtype=np.int64)
        open_, ring = np.arange(len(low)), 0
        while len(open_):
            # tokens ring .. 2 * ring away from the middle, the nearer ones first
            away = np.arange(ring, max(1, 2 * ring))
            steps = np.column_stack([-away, away]).ravel() if ring else away
            at = middle[open_, None] + steps
            inside = (at >= low[open_, None]) & (at < high[open_, None])
            ends = a_ends[np.where(inside, at, low[open_, None])]
            hit = inside & (b_ends[np.searchsorted(b_ends, ends)] == ends)      # bisection
            any_ = hit.any(axis=1)
            where[open_[any_]] = at[any_, hit[any_].argmax(axis=1)]
            open_ = open_[~any_ & inside.any(axis=1)]
            ring = max(1, 2 * ring)
        found = where >= 0
        cut[where[found]] = True
        low, high = (np.column_stack(x)[found].ravel() for x in ((low, where + 1), (where, high)))


class Aligned:
    """Groups and links of a batch of texts, given the ids of each."""

    def __init__(self, t: Tokens, pairs: list[tuple[list[int], list[int]]]):
        self.n_a, self.n_b = (np.array([len(p[k]) for p in pairs], dtype=np.int64) for k in (0, 1))
        self.a, self.b = (np.array([x for p in pairs for x in p[k]], dtype=np.int64) for k in (0, 1))
        full = np.flatnonzero(self.n_a)
        a_ends, b_ends = np.cumsum(t.a_size[self.a]), np.cumsum(t.b_size[self.b])
        stop = np.cumsum(self.n_a)
        self.a_cut = common_ends(a_ends, b_ends, (stop - self.n_a)[full], stop[full] - 1)
        self.b_cut = np.zeros(len(b_ends), dtype=bool)
        self.b_cut[np.searchsorted(b_ends, a_ends[self.a_cut])] = True
        per_text = lambda marks, n: np.add.reduceat(np.append(marks, 0), np.append(0, np.cumsum(n))[:-1]) * (n > 0) if len(n) else n
        self.n_groups = per_text(self.a_cut.astype(np.int64), self.n_a)
        # each stretch between neighbouring ends, of A or B, is one pair's shared bytes
        ends = np.union1d(a_ends, b_ends)
        at = np.searchsorted(a_ends, ends)
        self.code = self.a[at] * len(t.b_bytes) + self.b[np.searchsorted(b_ends, ends)] if len(ends) else ends.astype(np.int64)
        self.text = np.repeat(np.arange(len(pairs)), self.n_a)[at] if len(ends) else self.code
        self.n_links = self.n_a + self.n_b - self.n_groups

    def digests(self, t: Tokens) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` of each text, empty without tokens."""
        group_a = np.cumsum(self.a_cut) - self.a_cut
        group_b = np.cumsum(self.b_cut) - self.b_cut
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        words = t.a_words + t.b_words
        keys = np.concatenate([self.a + self.a_cut * len(t.a_bytes), len(t.a_words) + self.b + self.b_cut * len(t.b_bytes)])[order].tolist()
        out, at = [], 0
        for n in (self.n_a + self.n_b).tolist():
            line = "".join(map(words.__getitem__, keys[at:at + n]))[:-1]
            out.append(hashlib.sha256(line.encode()).hexdigest() if n else "")
            at += n
        return out


# ---------------------------------------------------------------------------
# packs
# ---------------------------------------------------------------------------

# a document's row has everything but pairs; a pack's row has pairs alone
PACK_COLUMNS = ("pack long, is_doc boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, own binary, pairs binary")


def _small(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(x).tobytes() for x in arrays))


def _read(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.int64).reshape(2, -1)


class Pack:
    """Documents until their pairs are stored."""

    def __init__(self):
        self.rows, self.codes, self.texts, self.bytes = [], [], [], 0

    def add(self, ids: list, t: Tokens, texts: list[str], size: int) -> None:
        done = Aligned(t, t.encode(texts))
        self.codes.append(done.code)
        self.texts.append(done.text + len(self.rows))
        self.rows += zip(ids, done.n_a.tolist(), done.n_b.tolist(), done.n_groups.tolist(), done.n_links.tolist(), done.digests(t))
        self.bytes += size

    def close(self, number: int, id_type) -> pa.RecordBatch:
        code, text = np.concatenate(self.codes), np.concatenate(self.texts)
        pairs, place, times = np.unique(code, return_inverse=True, return_counts=True)
        width = max(1, len(pairs))
        own, n_own = np.unique(text * width + place, return_counts=True)
        bounds = np.searchsorted(own, np.arange(len(self.rows) + 1) * width)
        blobs = [_small(own[x:y] % width, n_own[x:y].astype(np.int64)) for x, y in zip(bounds, bounds[1:])]
        n = len(self.rows)
        columns = [pa.array([r[0] for r in self.rows] + [None], id_type), pa.array([number] * (n + 1), pa.int64()), pa.array([True] * n + [False])]
        columns += [pa.array([r[k] for r in self.rows] + [None], pa.int64()) for k in range(1, 5)]
        columns += [pa.array([r[5] for r in self.rows] + [None], pa.string()), pa.array(blobs + [None], pa.binary()),
                    pa.array([None] * n + [_small(pairs, times.astype(np.int64))], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", *[c.split()[0] for c in PACK_COLUMNS.split(", ")]])


def packs(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of documents and packs (PACK_COLUMNS)."""
    files = docs.sparkSession.sparkContext.broadcast((read_vocabulary(a_path), read_vocabulary(b_path)))     # two vocabulary files
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        t = tools(*files.value)
        number = TaskContext.get().partitionId() << 32
        pack, ids, texts, size, id_type = Pack(), [], [], 0, None
        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc_id)
                texts.append(text or "")
                size += len(text or "")
                if size >= BATCH_BYTES or len(ids) >= 1 << 16:
                    pack.add(ids, t, texts, size)
                    ids, texts, size = [], [], 0
                    if pack.bytes >= PACK_BYTES or len(pack.rows) >= 1 << 18:
                        yield pack.close(number, id_type)
                        pack, number = Pack(), number + 1
        if ids:
            pack.add(ids, t, texts, size)
        if pack.rows:
            yield pack.close(number, id_type)

    return docs.select("doc_id", F.col("text").cast("string").alias("__text")).mapInArrow(run, f"doc_id {kind}, {PACK_COLUMNS}")


def pair_rows(made: DataFrame) -> DataFrame:
    """(pack, code, n): each pack's pairs and how many links they have in it."""
    def run(batches):
        for batch in batches:
            for pack, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                code, n = _read(data)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), pack), pa.int64()), pa.array(code), pa.array(n)], names=["pack", "code", "n"])
    return made.where(~F.col("is_doc")).select("pack", "pairs").mapInArrow(run, "pack long, code long, n long")


def counted(rows: DataFrame, n_b_ids: int) -> DataFrame:
    """(code, total, best): a pair's links in the corpus, and whether no pair of its B id has more."""
    total = stored(rows.groupBy("code").agg(F.sum("n").alias("total")), "pair-counts")
    b_id = (F.col("code") % n_b_ids).alias("b_id")
    top = total.groupBy(b_id).agg(F.max("total").alias("top"))
    return total.select("code", "total", b_id).join(top, "b_id").select("code", "total", (F.col("total") == F.col("top")).alias("best"))


RESULT = ("n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = stored(packs(docs, a_path, b_path), "packs")
    import sentencepiece
    n_b_ids = sentencepiece.SentencePieceProcessor(model_file=os.fspath(b_path)).get_piece_size()
    rows = pair_rows(made)
    back = rows.select("pack", "code").join(counted(rows, n_b_ids), "code").select("pack", "code", "total", "best")

    def run(own, pairs):
        code = pairs.column("code").to_numpy()
        order = np.argsort(code, kind="stable")          # a document's numbers are places in the sorted pairs
        total, best = pairs.column("total").to_numpy()[order], pairs.column("best").to_numpy()[order]
        n_best, count_sum = [], []
        for data in own.column("own").to_pylist():
            place, n = _read(data)
            n_best.append(int((n * best[place]).sum()) if len(place) else 0)
            count_sum.append(int((n * total[place]).sum()) if len(place) else 0)
        c = own.column
        return pa.table([c("doc_id"), c("n_a"), c("n_b"), c("n_groups"), c("n_links"), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), c("groups_sha256")],
                        names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    own = made.where("is_doc").select("doc_id", "pack", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "own")
    return own.groupBy("pack").cogroup(back.groupBy("pack")).applyInArrow(run, f"doc_id {kind}, {RESULT}")
