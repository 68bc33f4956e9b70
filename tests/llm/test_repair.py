"""Conversation repair against exhaustive and plain Python restatements."""
import hashlib
import itertools
import random
import re
import zlib

import pytest

from quarry.llm import repair

GOOD = re.compile(r"(s?(ua)+)?")


def every_way(rows, limit=2):
    """Cheapest (cost, audit, roles) by trying all edits with up to ``limit`` inserts a gap."""
    best = None
    gaps = [x for n in range(limit + 1) for x in itertools.product("ua", repeat=n)]
    choices = [[("D", 2, "")] + ([] if f in (1, 2) else [("K", 5 * (f == 3), i or "?")] + [("R", 1 + 5 * (f == 3), r) for r in "ua"]) for i, f in rows]
    for own in itertools.product(*choices):
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            audit, roles, cost = "", "", 0
            for k in range(len(rows) + 1):
                audit, roles, cost = audit + "I" * len(ins[k]), roles + "".join(ins[k]), cost + 5 * len(ins[k])
                if k < len(rows):
                    audit, roles, cost = audit + own[k][0], roles + own[k][2], cost + own[k][1]
            if GOOD.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, roles)
    return best


def plain(rows):
    """Least (cost, audit) by relaxing all steps of a table, row by row."""
    step = {"E": "u", "s": "u", "u": "a", "a": "u"}
    now = {"E": (0, "")}
    for i in range(len(rows) + 1):
        for _ in range(4):
            for s, (c, a) in list(now.items()):
                t, x = step[s], (c + 5, a + "I")
                if t not in now or x < now[t]:
                    now[t] = x
        if i == len(rows):
            return min(now[s] for s in "Ea" if s in now)
        init, f = rows[i]
        new = {}

        def put(s, x):
            if s not in new or x < new[s]:
                new[s] = x
        for s, (c, a) in now.items():
            put(s, (c + 2, a + "D"))
            if f not in (1, 2):
                more = 5 * (f == 3)
                put(step[s], (c + 1 + more, a + "R"))
                if (init == "s" and s == "E") or (init in "ua" and init and step[s] == init):
                    put(init, (c + more, a + "K"))
        now = new


def expected(table, damage=True):
    """The contract, conversation by conversation."""
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in [r for r in table if r[0] == conv]:
            role, text = (" " if x is None else x for x in (role, text))
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            rows += [(turn, role, text)] * (2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {r[0] for r in rows if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        faults, said = [], set()
        for _, role, text in rows:
            bare = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            faults.append(1 if not bare else 2 if (role, text) in said else 3 if bare[-1] not in ".!?" else 0)
            said.add((role, text))
        codes = [(r[1][:1], f) for r, f in zip(rows, faults)]
        cost, audit = plain(codes)
        lines, state, at = [], None, 0
        for edit in audit:
            if edit == "I":
                state = "assistant" if state == "user" else "user"
                lines.append(state + ":")
                continue
            _, role, text = rows[at]
            at += 1
            if edit == "D":
                continue
            if edit == "R":
                role = "assistant" if state == "user" else "user"
            state = role if role[:1] != "s" else "s"
            state = {"u": "user", "a": "assistant", "s": "s"}[state[:1]]
            lines.append(role + ":" + text)
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))
        out[conv] = (gaps, *[faults.count(k) for k in (1, 2, 3)], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_search_equals_every_way(n):
    rnd = random.Random(n)
    cases = list(itertools.product([(i, f) for i in ("s", "u", "a", "") for f in (0, 1, 3)], repeat=n))
    for rows in rnd.sample(cases, min(25 if n == 3 else 150, len(cases))):
        cost, audit, _ = every_way(rows, 2 if n < 3 else 1)
        assert min(x for g in repair.FINAL if (x := repair.search(list(rows), goal=g))) == (cost, audit)
        assert plain(list(rows)) == (cost, audit)


@pytest.mark.parametrize("segment", [1, 3, 32])
def test_segments_change_nothing(segment):
    rnd = random.Random(segment)
    for _ in range(150):
        rows = [(rnd.choice("ssuuuaaa "), rnd.choice([0, 0, 0, 1, 2, 3])) for _ in range(rnd.randint(0, 40))]
        p = repair.Piece((repair.START,), segment)
        for r in rows:
            p.add(*r)
        assert repair.cheapest(p.finish(repair.FINAL)) == plain(rows), rows


def random_table(rnd, convs, longest):
    texts = ["Yes.", "No", "", " \t", "Why?", "Why? ", "ü", "Long " * 400 + "end!", "a.b", None]
    rows = []
    for c in range(convs):
        for t in range(rnd.randint(1, longest)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((c, t if rnd.random() < .9 else rnd.choice([None, t + 3, 1]), role, rnd.choice(texts)))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_damage_and_repair(spark):
    rnd = random.Random(5)
    table = random_table(rnd, 60, 9) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hi."), (None, None, "user", None)]
    table += [(c, 0, "user", "gone.") for c in range(1000, 1040)]       # some of them lose their only row
    df = spark.createDataFrame(table, SCHEMA).repartition(5)
    assert got(repair.damage_and_repair(df)) == expected(table)


def test_one_conversation_over_many_tasks(spark):
    """A conversation that holds most rows is cut by ranges and linked again."""
    rnd = random.Random(6)
    table = random_table(rnd, 6, 5) + [(77, t, rnd.choice(["user", "assistant", "system"]), rnd.choice(["Yes.", "No", "", f"t{t}."])) for t in range(700)]
    df = spark.createDataFrame(table, SCHEMA)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = repair._pieces(repair._faults(repair.damaged(repair._rows(df))), 16)
        assert pieces.where("conv = 77").select("piece").distinct().count() > 2
        assert got(repair.damage_and_repair(df, segment=16)) == expected(table)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_empty_table_and_clashing_columns(spark):
    assert repair.damage_and_repair(spark.createDataFrame([], SCHEMA)).count() == 0
    table = [(1, 1, "user", "Hi."), (1, 2, "assistant", "Hi?")]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in table], SCHEMA + ", conv int, cost int, audit string")
    assert got(repair.damage_and_repair(df)) == expected(table)
