"""Word hashes and components against plain versions."""
import random

import numpy as np

from quarry.llm import common


def test_words_lines_and_offsets(monkeypatch):
    rng = random.Random(2)
    texts = ["", " ", "One two\nthree", "\n\nx\x0by \x1c é É\t", "a" * 50] + [
        "".join(rng.choice(["ab ", "Cd\n", "é", " ", "word-", "\r\n"]) for _ in range(rng.randrange(200))) for _ in range(60)]
    data = [t.encode() for t in texts]
    whole = common.Words(data)
    monkeypatch.setattr(common, "PIECE_BYTES", 64)
    cut = common.Words(data)
    names = {}
    for w in (whole, cut):
        seen = [(int(d), data[d][s:e].lower(), int(n)) for d, s, e, n in zip(w.doc, w.start, w.end, w.line, strict=True)]
        want = []
        for d, t in enumerate(data):
            for n, line in enumerate(t.split(b"\n")):
                want += [(d, x, n) for x in line.lower().split()]
        assert seen == want
        for (_, x, _), h in zip(seen, w.h.tolist(), strict=True):
            assert names.setdefault(x, h) == h
    assert len(set(names.values())) == len(names)


def test_shingles_of_short_and_long_units():
    w = common.Words([b"a b c", b"a b c d e f", b"a", b"a b c d e", b""])
    first, length = common.units([w.doc])
    s, count = common.shingles(w.h, first, length)
    assert count.tolist() == [1, 2, 1, 1] and len(s) == 5
    assert s[1] == s[4] and len(set(s.tolist())) == 4
    m = common.minhashes(s, count, 3)
    assert m.shape == (4, 3) and (m[3] >= m[1]).all()


def plain(edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = random.Random(7)
    path = list(range(100, 160))
    rng.shuffle(path)
    edges = list(zip(path, path[1:])) + [(1, x) for x in range(2, 40)] + [(rng.randrange(500, 800), rng.randrange(500, 800)) for _ in range(200)] + [(5, 5), (7, 1)]
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    proper = [e for e in edges if e[0] != e[1]]
    first = common.components(frame(edges))
    assert {r.id: r.comp for r in first.collect()} == plain(proper)
    more = [(120, 33), (700, 9000), (9000, 9001), (2, 3)]
    assert {r.id: r.comp for r in common.components(frame(more), start=first).collect()} == plain(proper + more)
    assert common.components(frame([]), start=first).count() == first.count()
    assert common.components(frame([])).collect() == []
    assert np.array(common.powers(np.uint64(3), 4)).tolist() == [1, 3, 9, 27]
