"""Conversation structure repair by depth-first branch and bound.

A conversation's rows, in the order of turn (nulls first), then role, then
text, are edited so that the initials of the roles match ``(s?(ua)+)?``:

    K keep     0   (not for blank and duplicate rows)
    R rerole   1   to user or assistant (not for blank and duplicate rows)
    D delete   2
    I insert   5   an empty user or assistant row, anywhere
               5   more for a truncated row that is kept or reroled

The cheapest edits win, and among them the audit (their initials in order)
that is least in ASCII order. ``search`` proves it: an explicit stack of
prefixes, a lower bound of what the remaining rows cost, the incumbent (cost,
audit), and a table of the best prefix per node (row, state) that eliminates
worse ones. An audit fixes the roles, because only a kept row can be a system
row, and after it roles alternate.

Rows are sorted by ranges of (conversation, turn, role, text), so one
conversation may be dealt to many tasks. A task streams its rows, searches
segments of ``SEGMENT`` rows for every state they can be entered and left in,
and links what it finds: of two equally dear prefixes that end in the same
state neither begins with the other (more inserts would cost more), so the
least prefix stays least whatever follows. Pieces of a conversation from
several tasks are linked the same way. Texts are digested by a stream of sorted
rows behind one header row with the audit; a conversation is never held whole.
What is held of it is its audit, which its one row of the result has to carry.

Defined cases: a null role or text is one space, and so are a null conv_id and
turn where they are hashed; a null conv_id is a conversation of its own;
null turns come first and do not count for gaps; equal rows stand next to each
other and all but the first of them are duplicates; an empty text is blank;
roles other than user, assistant and system have to be reroled or deleted;
texts of any length are read whole; further columns are ignored whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored

SEGMENT = 32
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5

# states: nothing yet, after the system row, after a user row, after an assistant row
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
_NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}      # of a reroled or an inserted row
FINAL = (START, ASSISTANT)
_NEVER = 1 << 60


def _by_inserts() -> list[list[int]]:
    """Least cost of inserts that lead from one state to another."""
    out = [[0 if s == t else _NEVER for t in STATES] for s in STATES]
    for s in STATES:
        at, cost = s, 0
        for _ in STATES:
            at, cost = _TURN[at], cost + INSERT
            out[s][at] = min(out[s][at], cost)
    return out


INSERTS = _by_inserts()


def moves(initial: str, fault: int, state: int) -> list[tuple[int, str, int]]:
    """(cost, edit, next state) of the edits of one row, best first."""
    out = [(DELETE, "D", state)]
    if fault not in (BLANK, DUPLICATE):
        more = CUT_SHORT if fault == TRUNCATED else 0
        out.append((REROLE + more, "R", _TURN[state]))
        if state in _NEXT.get(initial, {}):
            out.append((KEEP + more, "K", _NEXT[initial][state]))
    return sorted(out)


def search(rows: list[tuple[str, int]], start: int = START, goal: int = ASSISTANT) -> tuple[int, str] | None:
    """Least (cost, audit) that leads over rows of (initial, fault) from one
    state to another, or None."""
    n = len(rows)
    tail = [0] * (n + 1)        # lower bound: each remaining row at its cheapest, roles aside
    for i in range(n - 1, -1, -1):
        fault = rows[i][1]
        tail[i] = tail[i + 1] + (DELETE if fault else KEEP)
    best: tuple[int, str] | None = None
    table: list[list] = [[None] * len(STATES) for _ in range(n + 1)]
    table[0][start] = (0, "")
    stack = [(0, start, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if table[i][state] != (cost, audit):
            continue                                       # a better prefix came here since
        if best is not None:
            bound = cost + tail[i]
            if bound > best[0] or (bound == best[0] and audit > best[1][:len(audit)]):
                continue
        if i == n and state == goal:
            best = (cost, audit) if best is None or (cost, audit) < best else best
        options = [(cost + INSERT, audit + "I", i, _TURN[state])]
        if i < n:
            options += [(cost + c, audit + edit, i + 1, to) for c, edit, to in moves(*rows[i], state)]
        options.sort(key=lambda x: (x[0] + tail[x[2]], -x[2], x[1]), reverse=True)
        for c, a, j, to in options:                        # the most promising one is pushed last
            if best is not None and c + tail[j] > best[0]:
                continue
            here = table[j]
            if here[to] is not None and here[to] <= (c, a):
                continue
            if any(here[s] is not None and here[s][0] + INSERTS[s][to] < c for s in STATES):
                continue                                   # dearer than coming from there by inserts
            here[to] = (c, a)
            stack.append((j, to, c, a))
    return best


class Piece:
    """Least (cost, audit) between states over rows that come one by one."""

    def __init__(self, entries, segment: int = SEGMENT):
        self.segment, self.rows = segment, []
        self.found = {(s, s): (0, "") for s in entries}

    def add(self, initial: str, fault: int) -> None:
        self.rows.append((initial, fault))
        if len(self.rows) >= self.segment:
            self._flush(STATES)

    def _flush(self, goals) -> None:
        rows, self.rows = self.rows, []
        own = {}
        for middle in {m for _, m in self.found}:
            for goal in goals:
                own[middle, goal] = search(rows, middle, goal)
        self.found = linked(self.found, own)

    def finish(self, goals=STATES) -> dict:
        if self.rows:
            self._flush(goals)
        return {k: v for k, v in self.found.items() if k[1] in goals}


def linked(first: dict, second: dict) -> dict:
    """Both tables (entry, exit) -> (cost, audit) one after the other."""
    out: dict = {}
    for (a, b), x in first.items():
        for (c, d), y in second.items():
            if b == c and x is not None and y is not None:
                z = (x[0] + y[0], x[1] + y[1])
                if (a, d) not in out or z < out[a, d]:
                    out[a, d] = z
    return out


def cheapest(table: dict) -> tuple[int, str]:
    """The answer of a whole conversation."""
    ends = [table[START, s] for s in FINAL if table.get((START, s)) is not None]
    # a table that was cut to one exit may still need inserts to end well
    ends += [(x[0] + INSERTS[s][ASSISTANT], x[1] + "I" * (INSERTS[s][ASSISTANT] // INSERT))
             for (e, s), x in table.items() if e == START and x is not None and INSERTS[s][ASSISTANT] < _NEVER]
    return min(ends)


# ---------------------------------------------------------------------------
# damage and faults, as Spark expressions
# ---------------------------------------------------------------------------

def _rows(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text without nulls in role and text."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"),
                                filled("role").alias("role"), filled("text").alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with every fault that repair has to find, by a hash of
    ``conv_id:turn``: dropped, emptied, unpunctuated, repeated, another's role."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    times = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(kind != 0).select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


ORDER = ("conv", "turn", "role", "text")        # Spark's ascending order puts nulls first


def _faults(rows: DataFrame) -> DataFrame:
    """The rows with their initial, and a fault that needs no neighbour: blank,
    said in an earlier turn, truncated. Rows equal to the one before them in
    the sorted order are found by the stream."""
    said = F.sha2(F.to_json(F.struct("conv", "role", "text")), 256)
    at = F.coalesce("turn", F.lit(-(1 << 63)))
    keyed = rows.withColumn("said", said).withColumn("at", at)
    # only what is said in several turns is joined; a phrase's rows are reduced before the shuffle
    again = keyed.groupBy("said").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last").drop("last")
    bare = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    fault = (F.when(bare == "", BLANK).when(F.col("at") > F.col("first"), DUPLICATE)
             .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0))
    return keyed.join(again, "said", "left").select(*ORDER, F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


_LEGAL = {"su", "ua", "au"}
PIECES = "whole boolean, piece long, entry int, exit int, cost long, audit string, blank long, duplicate long, truncated long, illegal long, head string, last string"


def _pieces(rows: DataFrame, segment: int) -> DataFrame:
    """What each task finds of each conversation that it holds rows of: the
    answer, if it holds all of them, else one row per way of entering and
    leaving them. Only a task's first and last conversation can go on elsewhere."""
    kind = rows.schema["conv"].dataType.simpleString()
    ordered = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)

    def run(batches):
        number = TaskContext.get().partitionId()
        nothing = object()
        conv, piece, first_piece, before, seen, emitted = nothing, None, True, None, None, []

        def close(whole_end: bool):
            found = piece.finish(FINAL if whole_end else STATES)
            whole = whole_end and not first_piece
            if whole:
                found = {(START, ASSISTANT): cheapest(found)}
            for (entry, leave), x in found.items():
                if x is not None:
                    emitted.append((conv, whole, number, entry, leave, *x, *seen))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(6)]
            for c, turn, role, text, initial, fault in zip(*columns):
                if c != conv or conv is nothing:
                    if conv is not nothing:
                        close(True)
                        first_piece = False
                    conv, before = c, None
                    piece, seen = Piece(STATES if first_piece else (START,), segment), [0, 0, 0, 0, initial, initial]
                else:
                    seen[3] += seen[5] + initial not in _LEGAL
                    seen[5] = initial
                if fault != BLANK and before == (turn, role, text):
                    fault = DUPLICATE
                before = (turn, role, text)
                if fault:
                    seen[fault - 1] += 1
                piece.add(initial, fault)
            if emitted:
                yield _batch(emitted, kinds)
                emitted.clear()
        if conv is not nothing:
            close(False)
            yield _batch(emitted, kinds)

    schema = f"conv {kind}, {PIECES}"
    kinds = _arrow(schema, rows)
    return ordered.mapInArrow(run, schema)


def _arrow(schema: str, df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)


COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _linked_pieces(pieces: DataFrame) -> DataFrame:
    """One row per conversation: counts, cost, audit. A conversation has at
    most one piece per task of the sort, and a task at most two to link."""
    kind = pieces.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string"

    def run(key, table):
        by_piece: dict = {}
        for r in table.to_pylist():
            by_piece.setdefault(r["piece"], []).append(r)
        order = sorted(by_piece)
        whole = reduce(linked, ({(r["entry"], r["exit"]): (r["cost"], r["audit"]) for r in by_piece[p]} for p in order))
        one = [by_piece[p][0] for p in order]
        counts = [sum(r[c] for r in one) for c in COUNTS]
        counts[3] += sum(a["last"] + b["head"] not in _LEGAL for a, b in zip(one, one[1:]))
        cost, audit = cheapest(whole)
        return pa.table([pa.array([x], t.type) for x, t in zip((one[0]["conv"], *counts, cost, audit), kinds)], schema=kinds)

    kinds = _arrow(schema, pieces)
    return (pieces.where("whole").select("conv", *COUNTS, "cost", "audit")
            .unionByName(pieces.where("not whole").groupBy("conv").applyInArrow(run, schema)))


def _digests(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """The heads with the SHA-256 of each repaired conversation: its sorted
    rows pass behind its head, which says what happens to them."""
    from pyspark.sql import types as T
    add = [c for c in heads.columns if c != "conv"]
    kinds = {f.name: f.dataType.simpleString() for f in heads.schema}
    empty = lambda names, t: [F.lit(None).cast(t[c]).alias(c) for c in names]
    both = (heads.select("conv", F.lit(0).alias("part"), *empty(("turn", "role", "text"), {"turn": "long", "role": "string", "text": "string"}), *add)
            .unionByName(rows.select("conv", F.lit(1).alias("part"), "turn", "role", "text", *empty(add, kinds))))
    schema = T.StructType([*heads.schema.fields, T.StructField("repaired_sha256", T.StringType())])
    width = len(heads.columns)

    def run(batches):
        state, out = None, []

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in range(batch.num_columns)]):
                if row[1] == 0:
                    if state:
                        out.append(state.close())
                    state = _Digest((row[0], *row[5:]), row[5 + add.index("audit")])
                else:
                    state.add(row[3], row[4])     # role, text
            if out:
                yield _batch([x[:width + 1] for x in out], kinds_out)
                out = []
        if state:
            yield _batch([state.close()], kinds_out)

    from pyspark.sql.pandas.types import to_arrow_schema
    kinds_out = to_arrow_schema(schema)
    return (both.repartition("conv").sortWithinPartitions("conv", "part", "turn", "role", "text")
            .select("conv", "part", "turn", "role", "text", *add).mapInArrow(run, schema))


class _Digest:
    """Running digest of one conversation's repaired rows."""

    def __init__(self, head: tuple, audit: str):
        self.head, self.audit, self.at = head, audit, 0
        self.state, self.hash, self.any = START, hashlib.sha256(), False

    def _say(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any = True

    def _turn(self, text: str) -> None:
        self.state = _TURN[self.state]
        self._say("user" if self.state == USER else "assistant", text)

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._turn("")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _NEXT[role[:1]][self.state]
            self._say(role, text)
        elif edit == "R":
            self._turn(text)

    def close(self) -> tuple:
        self._inserts()
        return (*self.head, self.hash.hexdigest())


def repaired(rows: DataFrame, every: DataFrame | None = None, segment: int = SEGMENT) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256 for each conversation of ``rows`` (conv, turn, role, text,
    no nulls in the last two) and of ``every`` (conv); those without rows have
    zeros, an empty audit and the digest of an empty text."""
    prepare(rows.sparkSession)
    found = _linked_pieces(stored(_pieces(_faults(rows), segment), "repair"))      # read twice, searched once
    # turns are counted per conversation after equal ones are merged, both steps with partial sums
    gaps = rows.where("turn is not null").select("conv", "turn").distinct().groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    kind = rows.schema["conv"].dataType
    parts = [found.withColumn("gaps", F.lit(None).cast("long")),
             gaps.select("conv", "gaps", *[F.lit(None).cast("long").alias(c) for c in (*COUNTS, "cost")], F.lit(None).cast("string").alias("audit"))]
    if every is not None:
        parts.append(every.select(F.col("conv").cast(kind).alias("conv")).distinct()
                     .select("conv", *[F.lit(None).cast("long").alias(c) for c in ("gaps", *COUNTS, "cost")], F.lit(None).cast("string").alias("audit")))
    zero = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c)
    heads = reduce(DataFrame.unionByName, parts).groupBy("conv").agg(
        zero("gaps"), *[zero(c) for c in COUNTS], zero("cost"), F.coalesce(F.max("audit"), F.lit("")).alias("audit"))
    return _digests(rows, heads).withColumnRenamed("conv", "conv_id")


def damage_and_repair(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Damage by hash, then repair; every conversation of the table has a row."""
    rows = _rows(conversations)
    return repaired(damaged(rows), rows.select("conv"), segment)
