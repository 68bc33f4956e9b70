"""Byte-level BPE encoding and decoding by DuckDB queries inside partitions.

Spark deals the documents to tasks; each task splits its texts with the
tokenizer's pattern and keeps the distinct pieces. A recursive query holds one
row per (piece, position): rows join the merge table on their own and the next
token, each piece contracts its leftmost pair of smallest rank, and pieces
without a mergeable pair are done. Decoding joins tokens with the vocabulary
and aggregates their bytes in order.

Only pieces that are not themselves tokens go through the recursion, and a
bounded memory of finished pieces is kept in each Python worker
(``REMEMBERED``); it changes no result. Long pieces (over ``LONG_BYTES``)
contract all places of the smallest rank in one round where that provably
equals doing so one by one (no merge of the new token has a smaller rank).

The vocabulary is a parameter: the bytes of a rank file (base64 token, rank
per line) and a pattern.

Defined cases: a null text is empty; an empty text has no tokens, the SHA-256
of nothing twice; each row is encoded by itself, so repeated rows give equal
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import ctypes
import gc
import hashlib
import re
import tempfile
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

REMEMBERED = 500_000
LONG_BYTES = 256
ROUND_PIECES = 100_000    # pieces in one query
GROUP_CHARS = 8 << 20     # characters of text whose new parts share a query

# Rows stay in the order of (w, pos): one thread, insertion order kept, join sides fixed. The windows without an
# ORDER BY then run as streams; ``Tokenizer._contract`` checks the order of what comes out.
STEPS = """
WITH RECURSIVE step AS (
  SELECT w, pos, tok, false AS done FROM base
  UNION ALL
  (WITH pairs AS (
     SELECT s.w, s.pos, s.tok, m.made
     FROM (SELECT w, pos, tok, CASE WHEN lead(w) OVER () = w THEN lead(tok) OVER () END AS following FROM step WHERE NOT done) s
     LEFT JOIN merges m ON m.l = s.tok AND m.r = s.following),
   best AS (SELECT w, min((made::BIGINT << 32) | pos) & 4294967295 AS spot FROM pairs GROUP BY w),
   merged AS (
     SELECT p.w, pos, CASE WHEN pos = spot THEN made ELSE tok END AS tok, spot IS NULL AS done,
            lag(pos = spot) OVER () AND lag(p.w) OVER () = p.w AS eaten
     FROM pairs p JOIN best b ON b.w = p.w)
   SELECT w, pos, tok, done FROM merged WHERE eaten IS NOT TRUE))
SELECT w, pos, tok FROM step WHERE done
"""

# as above, but a piece contracts every place of its smallest rank, from the left in each run of overlapping
# places; where the new token has a merge of smaller rank, only the leftmost
LONG_STEPS = """
WITH RECURSIVE step AS (
  SELECT w, pos, tok, false AS done FROM base
  UNION ALL
  SELECT w, pos, tok, done FROM (
    SELECT w, pos, CASE WHEN hit THEN made ELSE tok END AS tok, least_made IS NULL AS done,
           lag(hit) OVER (PARTITION BY w ORDER BY pos) AS eaten
    FROM (
      SELECT *, coalesce(may AND (place - start_) % 2 = 0, false) AS hit
      FROM (
        SELECT *, max(CASE WHEN may AND NOT coalesce(may_before, false) THEN place END)
                    OVER (PARTITION BY w ORDER BY pos ROWS UNBOUNDED PRECEDING) AS start_
        FROM (
          SELECT *, lag(may) OVER (PARTITION BY w ORDER BY pos) AS may_before
          FROM (
            SELECT *, coalesce(made = least_made AND (alike OR pos = first_pos), false) AS may
            FROM (
              SELECT *, min(CASE WHEN made = least_made THEN pos END) OVER (PARTITION BY w) AS first_pos
              FROM (
                SELECT s.*, m.made, m.alike, min(m.made) OVER (PARTITION BY s.w) AS least_made
                FROM (SELECT w, pos, tok, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS following,
                             row_number() OVER (PARTITION BY w ORDER BY pos) AS place
                      FROM step WHERE NOT done) s
                LEFT JOIN merges m ON m.l = s.tok AND m.r = s.following)))))))
  WHERE eaten IS NOT TRUE)
SELECT w, pos, tok FROM step WHERE done
"""

TOKENS = """
SELECT w, string_agg(shown, ' ' ORDER BY pos) AS ids, string_agg(hexed, '' ORDER BY pos) AS decoded
FROM done JOIN vocab USING (tok) GROUP BY w
"""
DECODE = "SELECT w, unhex(string_agg(hexed, '' ORDER BY pos)) AS decoded FROM ids JOIN vocab USING (tok) GROUP BY w"

class Tokenizer:
    """Rank file and pattern; queries run in a DuckDB of the process."""

    def __init__(self, rank_file: bytes, pattern: str, remembered: int = REMEMBERED, group: int = GROUP_CHARS):
        self.remembered, self.group = remembered, group
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        # the library's \s is Unicode white space only, without the separators \x1c-\x1f
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"\s", r"\p{White_Space}"))
        self.byte_rank = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        left, right, made = [], [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        lowest = np.full(max(self.ranks.values()) + 1, np.iinfo(np.int32).max)
        np.minimum.at(lowest, np.array(left), np.array(made))
        np.minimum.at(lowest, np.array(right), np.array(made))
        alike = lowest[np.array(made)] > np.array(made)
        self.con = duckdb.connect()
        self.con.execute("SET threads = 1")
        self.con.execute("SET memory_limit = '350MB'")
        self.con.execute("SET preserve_insertion_order = true")
        self.con.execute("SET disabled_optimizers = 'build_side_probe_side,join_order'")
        self.con.execute(f"SET temp_directory = '{tempfile.gettempdir()}'")
        kind = pa.int32()
        self._table("merges_in", {"l": pa.array(left, kind), "r": pa.array(right, kind), "made": pa.array(made, kind), "alike": pa.array(alike)})
        self._table("vocab_in", {"tok": pa.array(list(self.ranks.values()), kind), "hexed": pa.array([t.hex() for t in self.ranks]),
                                 "shown": pa.array([str(r) for r in self.ranks.values()])})
        self.con.execute("CREATE TABLE merges AS FROM merges_in")
        self.con.execute("CREATE TABLE vocab AS FROM vocab_in")
        self.young: dict[str, tuple[str, bytes]] = {}
        self.old: dict[str, tuple[str, bytes]] = {}

    def _table(self, name: str, columns: dict):
        self.con.register(name, pa.table(columns))

    def _rows(self, name: str, column: str, values: np.ndarray, lengths: np.ndarray):
        total = np.concatenate([[0], np.cumsum(lengths)])
        w = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        pos = (np.arange(total[-1]) - np.repeat(total[:-1], lengths)).astype(np.int32)
        self._table(name, {"w": w, "pos": pos, column: values})

    def _contract(self, pieces: list[bytes], steps: str):
        """(number of piece, ids as text, decoded bytes) of pieces."""
        self._rows("base", "tok", self.byte_rank[np.frombuffer(b"".join(pieces), dtype=np.uint8)], np.array([len(p) for p in pieces]))
        rows = self.con.sql(steps).to_arrow_table()
        w, pos = rows.column("w").to_numpy(), rows.column("pos").to_numpy()
        new = np.diff(w) != 0
        if steps is STEPS and (new.sum() + 1 != len(pieces) or not (new | (np.diff(pos) > 0)).all()):
            raise RuntimeError("token positions came out of order")
        self.con.register("done", rows)
        got = self.con.sql(TOKENS).to_arrow_table()
        columns = [got.column(c).to_pylist() for c in ("w", "ids", "decoded")]
        return zip(*columns[:2], map(bytes.fromhex, columns[2]), strict=True)

    def pieces(self, distinct: list[str]) -> dict[str, tuple[str, bytes]]:
        """ids as text and decoded bytes of each piece."""
        data = [p.encode() for p in distinct]
        ranks = list(map(self.ranks.get, data))
        whole = [i for i, r in enumerate(ranks) if r is not None]      # a piece that is a token needs no merges
        out = {distinct[i]: (str(ranks[i]), d) for i, d in zip(whole, self.decode([[ranks[i]] for i in whole]), strict=True)}
        rest = [i for i, r in enumerate(ranks) if r is None and len(data[i]) <= LONG_BYTES]
        long = [i for i, r in enumerate(ranks) if r is None and len(data[i]) > LONG_BYTES]
        groups = [(rest[i:i + ROUND_PIECES], STEPS) for i in range(0, len(rest), ROUND_PIECES)] + [([i], LONG_STEPS) for i in long]
        for group, steps in groups:
            for w, ids, decoded in self._contract([data[i] for i in group], steps):
                out[distinct[group[w]]] = (ids, decoded)
        return out

    def decode(self, ids: list[list[int]]) -> list[bytes]:
        """Bytes of each list of ids."""
        out = [b""] * len(ids)
        lengths = np.array([len(x) for x in ids], dtype=np.int64)
        if lengths.sum():
            flat = np.fromiter((t for x in ids for t in x), dtype=np.int32, count=int(lengths.sum()))
            self._rows("ids", "tok", flat, lengths)
            got = self.con.sql(DECODE).to_arrow_table()
            for w, decoded in zip(got.column("w").to_pylist(), got.column("decoded").to_pylist(), strict=True):
                out[w] = decoded
        return out

    def _split(self, text: str) -> list[str]:
        """Keys of parts of a text that the pattern splits alike alone and in
        the text. It joins a space only to what follows, unless white space
        meets white space; and a comma or full stop behind a letter or digit and
        before white space is a piece. A key stands for itself behind a space,
        or for what follows its ALONE mark."""
        if not text:
            return []
        if TWO_SPACES.search(text) or ALONE in text:
            return [_key(p) for p in self.pattern.findall(text)]
        if not LOOSE_MARK.search(text):
            text = text.replace(", ", f" {ALONE}, ").replace(". ", f" {ALONE}. ").replace(".\n", f" {ALONE}.\n {ALONE}")
        parts = text.split(" ")
        if parts[-1] == ALONE:
            parts.pop()
        if parts[0] == "":
            return parts[1:]
        if parts[0][0] != ALONE:
            parts[0] = ALONE + parts[0]
        return parts

    def _cut(self, key: str) -> list[str]:
        """Pieces of a part."""
        if key.isalpha():                                   # letters after a space are one piece
            return [" " + key]
        text = key[1:] if key[:1] == ALONE else " " + key
        return [text] if text.isalpha() else self.pattern.findall(text)

    def _learn(self, missing: list[str]) -> None:
        """Put parts into memory."""
        young, old = self.young, self.old
        cut = list(map(self._cut, missing))
        done, new = {}, []
        for p in set(chain.from_iterable(cut)):
            key = _key(p)      # a piece is a part, too
            known = young.get(key) or old.get(key)
            if known:
                done[p] = known
            else:
                new.append(p)
        done |= self.pieces(new)
        for k, own in zip(missing, cut, strict=True):
            if len(own) == 1:
                young[k] = done[own[0]]
            else:
                got = [done[p] for p in own]
                young[k] = (" ".join([x[0] for x in got]), b"".join([x[1] for x in got]))

    def encode(self, texts: list[str]) -> list[tuple[int, str, bytes]]:
        """Number of ids, ids as text and decoded bytes of each text."""
        keys = [self._split(t) for t in texts]
        need = set(chain.from_iterable(keys))
        new = []
        for k in need - self.young.keys():
            known = self.old.get(k)
            if known is None:
                new.append(k)
            else:
                self.young[k] = known
        self._learn(new)
        ids_of, bytes_of = {}, {}
        for k in need:
            ids_of[k], bytes_of[k] = self.young[k]
        out = []
        for own in keys:
            ids = " ".join(map(ids_of.__getitem__, own))
            out.append((ids.count(" ") + 1 if own else 0, ids, b"".join(map(bytes_of.__getitem__, own))))
        if len(self.young) > self.remembered:
            self.old, self.young = self.young, {}
        return out


ALONE = "\x01"


def _key(piece: str) -> str:
    """Key of a piece."""
    return piece[1:] if piece[0] == " " and len(piece) > 1 and piece.rfind(" ") == 0 and ALONE not in piece else ALONE + piece


# a comma or full stop that may belong to a run of marks
LOOSE_MARK = re.compile(r"(?:\W|_)(?:[,.] |\.\n)")
TWO_SPACES = re.compile(r"\s\s")
_TOKENIZERS: dict[tuple, Tokenizer] = {}


def tokenizer(rank_file: bytes, pattern: str) -> Tokenizer:
    """The process's tokenizer for a vocabulary."""
    key = (hashlib.sha256(rank_file).digest(), pattern)
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = Tokenizer(rank_file, pattern)
    return _TOKENIZERS[key]


# Parts that a tokenizer of one task remembers: some tens of megabytes.
REMEMBERED_IN_TASK = 60_000
# Characters of text in its queries: their steps are held at once.
GROUP_CHARS_IN_TASK = 2 << 20


def give_back() -> None:
    """Return freed memory to the system: a worker process lives on for other stages."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):       # not this C library
        pass


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _groups(texts: list[str], size: int = GROUP_CHARS):
    """Runs of texts of about ``size`` characters."""
    at = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield texts[at:i + 1]
            at, total = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def _joined(batches, size: int = 2 * GROUP_CHARS):
    """Arrow batches put together to about ``size`` bytes."""
    waiting, total = [], 0
    for batch in batches:
        waiting.append(batch)
        total += batch.nbytes
        if total >= size:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
            waiting, total = [], 0
    if waiting:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def _strings(column) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def _mapped(docs: DataFrame, source, path: str, pattern: str, keep: tuple[str, ...], schema: str, build, own_task: bool = False) -> DataFrame:
    """``keep`` columns and what build(tokenizer, column) gives for ``source``.
    With ``own_task`` a tokenizer lives as long as its task and remembers less:
    for jobs whose other stages use the same worker processes."""
    prepare(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))      # one rank file
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches):
        t = Tokenizer(vocabulary.value, pattern, REMEMBERED_IN_TASK, GROUP_CHARS_IN_TASK) if own_task else tokenizer(vocabulary.value, pattern)
        for batch in _joined(batches, 2 * t.group):
            gc.disable()      # nothing here is cyclic, and a scan of all remembered parts is slow
            made = build(t, batch.column(batch.num_columns - 1))
            gc.enable()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made.values()], names=[*keep, *made])
        if own_task:
            t.con.close()
            del t
            give_back()

    own = "".join(f"`{c}` {kinds[c]}, " for c in keep)
    return docs.select(*keep, source.alias("__source")).mapInArrow(run, own + schema)


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the ids (array<int>) of each text."""
    def build(t, column):
        return {"ids": _lists([_numbers(ids) for g in _groups(_strings(column), t.group) for _, ids, _ in t.encode(g)])}
    return _mapped(docs, F.col("text").cast("string"), path, pattern, keep, "ids array<int>", build)


def decode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the bytes that the ids stand for (null: none)."""
    def build(t, column):
        return {"decoded": pa.array(t.decode([x or [] for x in column.to_pylist()]), pa.binary())}
    return _mapped(docs, F.col("ids").cast("array<int>"), path, pattern, keep, "decoded binary", build)


def round_trip(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False,
               own_task: bool = False) -> DataFrame:
    """``keep`` columns, n_tokens, and the digests of the ids and of their
    decoded bytes; ``with_ids`` adds the ids themselves."""
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def build(t, column):
        made = [(n, sha(ids.encode()), sha(decoded), _numbers(ids) if with_ids else None)
                for g in _groups(_strings(column), t.group) for n, ids, decoded in t.encode(g)]
        out = {"n_tokens": pa.array([x[0] for x in made], pa.int64())}
        if with_ids:
            out["ids"] = _lists([x[3] for x in made])
        return out | {"ids_sha256": pa.array([x[1] for x in made], pa.string()), "decoded_sha256": pa.array([x[2] for x in made], pa.string())}
    schema = "n_tokens long, " + ("ids array<int>, " if with_ids else "") + "ids_sha256 string, decoded_sha256 string"
    return _mapped(docs, F.col("text").cast("string"), path, pattern, keep, schema, build, own_task)


def _numbers(ids: str) -> np.ndarray:
    return np.fromstring(ids, dtype=np.int32, sep=" ") if ids else np.zeros(0, dtype=np.int32)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32)))
