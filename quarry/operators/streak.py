"""Error streak and back-off delay over an ordered outcome log, per key.

Per key, in (ts, event_id) order: success -> c = max(0, c - 1), error ->
c = min(c + 1, 5); delay = min(0.5 * 1.5^c, 2.0) (no jitter). Alongside,
``consecutive_errors`` (reset to 0 by a success) and ``breaker_open`` (5 or
more consecutive errors) feed the circuit-breaker view.

The clamped fold is not a window sum, but each event is a function
c -> clamp(c + a, lo, hi), and such functions compose into the same form. That
makes the fold a prefix scan over a tree, which no hot key can unbalance:

1. all events are numbered in the order (key, *order) by ranges, and a key's
   events are cut into segments of ``SEGMENT`` consecutive ones;
2. a segment's events compose into one (a, lo, hi) summary, ``FAN`` neighbouring
   summaries into one of the next level, and so on until a key has one;
3. downwards, each node's start value gives those of the nodes below it, by
   what the neighbours before them do;
4. each segment replays its events from its start value.

All of it is grouping, joins on (key, node) and array expressions over at most
``SEGMENT`` events or ``FAN`` summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordering import by_key, numbered

MAX_STREAK = 5
BASE_DELAY = 0.5
GROWTH = 1.5
MAX_DELAY = 2.0
BREAKER_THRESHOLD = 5
SEGMENT = 32
FAN = 32
_FAR = 1 << 40          # no streak comes near it


_IDENTITY = {"a": 0, "lo": -_FAR, "hi": _FAR, "reset": False, "run": 0}
_F = "struct<a:bigint,lo:bigint,hi:bigint,reset:boolean,run:bigint>"


def _long(x):
    return F.lit(x).cast("long")


def _function(**parts):
    return F.struct(*[(x if isinstance(x, Column) else F.lit(x) if isinstance(x, bool) else _long(x)).alias(k) for k, x in parts.items()])


def _then(f, g):
    """The function f followed by g."""
    clamp = lambda x: F.least(F.greatest(x + g["a"], g["lo"]), g["hi"])
    return _function(a=f["a"] + g["a"], lo=clamp(f["lo"]), hi=clamp(f["hi"]), reset=f["reset"] | g["reset"],
                     run=F.when(g["reset"], g["run"]).otherwise(f["run"] + g["run"]))


def _event(err, cap: int):
    return _function(a=F.when(err, _long(1)).otherwise(_long(-1)), lo=F.when(err, _long(-_FAR)).otherwise(_long(0)),
                     hi=F.when(err, _long(cap)).otherwise(_long(_FAR)), reset=~err, run=F.when(err, _long(1)).otherwise(_long(0)))


def _starts(leaves: DataFrame, levels: int, fan: int) -> DataFrame:
    """(key, node, c, r): the state each segment starts from, given (key, node, f)."""
    below, tree = leaves, []
    for _ in range(levels):
        kids = below.groupBy("key", F.floor(F.col("node") / fan).alias("up")).agg(F.array_sort(F.collect_list(F.struct("node", "f"))).alias("kids"))
        first = F.struct(_function(**_IDENTITY).alias("f"), F.array().cast(f"array<struct<node:bigint,f:{_F}>>").alias("out"))
        step = lambda acc, x: F.struct(_then(acc["f"], x["f"]).alias("f"), F.concat(acc["out"], F.array(F.struct(x["node"].alias("node"), acc["f"].alias("f")))).alias("out"))
        level = cut_lineage(kids.select("key", "up", F.aggregate("kids", first, step).alias("x")))
        tree.append(level.select("key", "up", F.explode("x.out").alias("kid")))
        below = level.select("key", F.col("up").alias("node"), F.col("x.f").alias("f"))
    start = below.select("key", "node", _long(0).alias("c"), _long(0).alias("r"))
    for kids in reversed(tree):
        f = F.col("kid.f")
        up = start.select(F.col("key").alias("_key"), F.col("node").alias("_up"), "c", "r")
        start = (kids.join(up, F.col("key").eqNullSafe(F.col("_key")) & (F.col("up") == F.col("_up")))
                     .select("key", F.col("kid.node").alias("node"), F.least(F.greatest(F.col("c") + f["a"], f["lo"]), f["hi"]).alias("c"),
                             (F.when(f["reset"], _long(0)).otherwise(F.col("r")) + f["run"]).alias("r")))
    return start


def error_streak(events: DataFrame, key: str = "user_id", order=("ts", "event_id"),
                 is_error: str = "is_error", cap: int = MAX_STREAK, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """Per event: key, *order, streak, delay, consecutive_errors, breaker_open.

    Rows without a time come before all others of their key; a null outcome
    counts as a success; a null key is a key of its own."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    base = events.select(F.col(key).alias("key"), *order, F.coalesce(F.col(is_error).cast("boolean"), F.lit(False)).alias("_err"))
    rows = by_key(numbered(base, "key", *order), "key").withColumn("node", F.floor(F.col("_pos") / segment))
    segments = rows.groupBy("key", "node").agg(F.array_sort(F.collect_list(F.struct("_n", *order, "_err"))).alias("_events"))
    leaves = cut_lineage(segments.select("key", "node", F.aggregate("_events", _function(**_IDENTITY), lambda f, e: _then(f, _event(e["_err"], cap))).alias("f")))
    most = leaves.agg(F.max("node")).first()[0]
    levels = 0
    while most:             # a key's nodes are numbered from 0, so this many levels leave one
        most, levels = most // fan, levels + 1
    starts = _starts(leaves, levels, fan).select(F.col("key").alias("_key"), F.col("node").alias("_node"), "c", "r")

    def replay(acc, e):
        c = F.when(e["_err"], F.least(acc["c"] + 1, _long(cap))).otherwise(F.greatest(acc["c"] - 1, _long(0)))
        r = F.when(e["_err"], acc["r"] + 1).otherwise(_long(0))
        row = F.struct(*[e[c_].alias(c_) for c_ in order], c.alias("streak"), r.alias("consecutive_errors"))
        return F.struct(c.alias("c"), r.alias("r"), F.concat(acc["out"], F.array(row)).alias("out"))

    row_type = ",".join(f"{c}:{kinds[c]}" for c in order) + ",streak:bigint,consecutive_errors:bigint"
    first = F.struct("c", "r", F.array().cast(f"array<struct<{row_type}>>").alias("out"))
    joined = segments.join(starts, F.col("key").eqNullSafe(F.col("_key")) & (F.col("node") == F.col("_node")))
    out = joined.select("key", F.explode(F.aggregate("_events", first, replay)["out"]).alias("e"))
    delay = F.least(F.lit(BASE_DELAY) * F.pow(F.lit(GROWTH), F.col("e.streak").cast("double")), F.lit(MAX_DELAY))
    return out.select(F.col("key").alias(key), *[F.col(f"e.{c}").alias(c) for c in order], F.col("e.streak").alias("streak"), delay.alias("delay"),
                      F.col("e.consecutive_errors").alias("consecutive_errors"),
                      (F.col("e.consecutive_errors") >= BREAKER_THRESHOLD).alias("breaker_open"))
