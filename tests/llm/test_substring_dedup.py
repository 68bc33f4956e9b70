"""Repeated paragraphs against brute force; cutting them out."""
import random

from quarry.llm import substring_dedup as sd
from test_near_dedup import words


def brute(rows, percent=75, min_words=15):
    pars = []
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            w = words(line)
            if len(w) >= min_words:
                pars.append((d, k, {tuple(w[i:i + 5]) for i in range(len(w) - 4)}))
    parent = list(range(len(pars)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(pars)):
        for j in range(i):
            n = len(pars[i][2] & pars[j][2])
            if n and 100 * n >= percent * len(pars[i][2] | pars[j][2]):
                parent[find(i)] = find(j)
    groups = {}
    for i, p in enumerate(pars):
        groups.setdefault(find(i), []).append(p[:2])
    return sorted(p + min(g) + (p == min(g),) for g in groups.values() if len(g) > 1 for p in g)


def corpus():
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    rows = [(0, None), (1, ""), (2, "\n\n \n"), (3, " ".join(f"once{i}" for i in range(30)))]
    for i in range(60):
        lines = [" ".join(f"u{i}_{k}_{j}" for j in range(rng.randrange(1, 40))) for k in range(rng.randrange(0, 5))]
        p = list(passage)
        for _ in range(rng.randrange(0, 4)):
            p[rng.randrange(60)] = f"x{rng.randrange(999)}"
        lines.insert(rng.randrange(len(lines) + 1), " ".join(p).upper() if i % 3 else " ".join(p))
        if i % 10 == 0:
            lines += ["Short line here."] * 3
        rows.append((10 + i, "\n".join(lines)))
    rows.append((500, "\n".join(" ".join(f"v{(i * 13 + j) % 900}" for j in range(40)) for i in range(400))))
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    found = sd.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.par, r.first_doc, r.first_par, r.kept) for r in found.collect()) == brute(rows)


def test_cutting_leaves_first_copies_and_other_columns(spark):
    rows = corpus()
    docs = spark.createDataFrame([r + (len(r[1] or ""), "src", 1) for r in rows], "doc_id long, text string, n_chars long, source string, par int")
    found = sd.repeated_paragraphs(docs)
    got = {r.doc_id: r for r in sd.without_repeats(docs, found).collect()}
    gone = {}
    for d, par, *_, kept in brute(rows):
        if not kept:
            gone.setdefault(d, set()).add(par)
    for d, t in rows:
        want = t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ()))
        if d in gone and not want.strip():
            assert d not in got
        else:
            assert got[d].text == want and got[d].source == "src" and (d not in gone or got[d].n_chars == len(want))


def test_spans_repeats_and_empty(spark):
    line = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, "é first\n  " + line + " "), (None, line), (2, "x"), (2, "x")], "doc_id long, text string")
    found = {r.doc_id: r for r in sd.repeated_paragraphs(df).collect()}
    r = found[1]
    assert "é first\n  ".encode() + line.encode() == ("é first\n  " + line).encode()[:r.begin + r.n_bytes] and r.begin == len("é first\n  ".encode())
    assert set(found) == {1, None}
    assert sd.repeated_paragraphs(df.limit(0)).collect() == []


def test_spans_are_found_whatever_the_lines(spark):
    rng = random.Random(4)
    fresh = iter(range(10 ** 6))
    some = lambda n: [f"f{next(fresh)}" for _ in range(n)]
    shared, short = some(60), some(49)
    rows = [(1, " ".join(some(200) + shared + some(200))), (2, " ".join(some(30) + shared[:55] + some(300))),           # inside longer lines
            (3, "\n".join(" ".join(shared[i:i + 7]) for i in range(0, 60, 7))), (4, " ".join(short)), (5, " ".join(short + some(9))),
            (6, " ".join(some(20) + 2 * (shared[3:] + some(5)))), (None, " ".join(shared)), (7, None), (8, "")]
    for i in range(20):
        w = [rng.choice("abc") for _ in range(rng.randrange(0, 150))]
        rows.append((10 + i, " ".join(w + (rows[9 + rng.randrange(i)][1].split()[:70] if i else []))))
    places, want = {}, {}
    for d, t in rows:
        w = (t or "").split()
        for i in range(len(w) - sd.RUN + 1):
            places.setdefault(tuple(w[i:i + sd.RUN]), []).append((-1 if d is None else d, i))
    for p in places.values():
        for at in p if len(p) > 1 else []:
            want.setdefault((at[0], at == min(p)), set()).update(range(at[1], at[1] + sd.RUN))
    got, texts = {}, dict(rows)
    for r in sd.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        words_of = texts[r.doc_id].split()[r.first_word:r.first_word + r.n_words]
        assert texts[r.doc_id].encode()[r.begin:r.begin + r.n_bytes].decode().split() == words_of
        got.setdefault((-1 if r.doc_id is None else r.doc_id, r.kept), set()).update(range(r.first_word, r.first_word + r.n_words))
    assert got == want and {1, 2, 3, 6, -1} <= {d for d, _ in want} and not {4, 5} & {d for d, _ in want}
    assert sd.repeated_spans(spark.createDataFrame(rows[:0], "doc_id long, text string")).collect() == []


def test_passages_are_cut_whatever_the_lines(spark):
    rng = random.Random(6)
    fresh = iter(range(10 ** 6))
    some = lambda n: [f"wé{next(fresh)}" for _ in range(n)]
    planted = [some(rng.randrange(51, 120)) for _ in range(12)]
    wrapped = lambda p: "\n".join(" ".join(p[i:i + 7]) for i in range(0, len(p), 7))
    rows = [(100 + i, " ".join(some(200))) for i in range(10)]                                    # clean
    for i, p in enumerate(planted):
        rows += [(i, " ".join(some(90) + p + some(90))), (20 + i, " ".join(some(80)) + "\n" + wrapped(p) + "\n" + " ".join(some(30))),
                 (40 + i, " ".join(some(150)) + "  " + " ".join(p).replace("w", "W") + " \t" + " ".join(some(150)))]
    rows += [(60, wrapped(planted[0])), (61, wrapped(planted[1])), (61, "short"), (62, None), (63, ""), (64, " ".join(some(3) + planted[2][:49])),
             (65, " ".join(2 * planted[3][:50] + some(2)))]
    docs = spark.createDataFrame([r + (len(r[1] or ""), "src", 1) for r in rows], "doc_id long, text string, n_chars long, source string, row int")
    seen, want = set(), []
    for d, t in sorted(rows, key=lambda r: r[0]):
        w = words(t or "")
        gone = set()
        for i in range(len(w) - sd.RUN + 1):
            run = tuple(w[i:i + sd.RUN])
            if run in seen:
                gone.update(range(i, i + sd.RUN))
            seen.add(run)
        if not gone or len(gone) < len(w):
            want.append((d, tuple(x for i, x in enumerate(w) if i not in gone)))
    for got in (sd.without_passages(docs).collect(), sd.without_copies(docs).collect()):
        assert sorted((r.doc_id, tuple(words(r.text or ""))) for r in got) == sorted(want)
        assert all((r.source, r.row, r.n_chars) == ("src", 1, len(r.text or "")) for r in got)
        assert {(r.doc_id, r.text) for r in got if r.doc_id >= 100} == {r for r in rows if r[0] >= 100}
        assert {r.text for r in got if r.doc_id == 61} == {"short"} and not [r for r in got if r.doc_id == 60]
        left = [set(words(r.text or "")) for r in got if 20 <= r.doc_id < 60]
        assert len(left) == 24 and not any(set(words(" ".join(p))) & x for p in planted for x in left)
    cut = sd.without_repeats(docs, sd.repeated_paragraphs(docs))                                   # lines alone leave them all
    assert sum(any(set(words(" ".join(p))) <= set(words(r.text or "")) for p in planted) for r in cut.collect() if 20 <= r.doc_id < 60) == 24
    assert sd.without_copies(docs.limit(0)).collect() == []
