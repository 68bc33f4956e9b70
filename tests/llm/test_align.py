"""Alignment against a plain walk over bytes, with the tokenizers library as A."""
import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import align

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(A_PATH)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
LETTERS = align.byte_letters()


def token_bytes(text):
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    ab = [bytes(LETTERS[c] for c in A.id_to_token(i)) for i in a]
    bb = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    return a, b, ab, bb


def plain(texts):
    """Rows of the contract, byte by byte."""
    links, rows = [], []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a, b, ab, bb = token_bytes(text) if text else ([], [], [], [])
        if b"".join(ab) != whole or b"".join(bb) != whole:
            rows.append((0, 0, 0, ""))
            links.append([])
            continue
        owner = [[i for i, x in enumerate(t) for _ in x] for t in (ab, bb)]
        links.append([(a[i], b[j]) for i, j in dict.fromkeys(zip(*owner))])
        groups, x, y, i, j = [], 0, 0, 0, 0
        now = ([], [])
        while i < len(a) or j < len(b):
            if x <= y and i < len(a):
                x += len(ab[i])
                now[0].append(a[i])
                i += 1
            else:
                y += len(bb[j])
                now[1].append(b[j])
                j += 1
            if x == y and now[0] and now[1]:
                groups.append(now)
                now = ([], [])
        line = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        rows.append((len(a), len(b), len(groups), hashlib.sha256(line.encode()).hexdigest()))
    count = collections.Counter(p for x in links for p in x)
    top = collections.defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [(r[0], r[1], r[2], len(x), sum(count[p] == top[p[1]] for p in x), sum(count[p] for p in x), r[3]) for r, x in zip(rows, links)]


def random_texts(seed, n):
    rnd = random.Random(seed)
    words = ["the", "Hello", "antidisestablishment", "naïve", "日本語", "🙂", "  ", "\n\n", "\t", "x" * 50, "12345", "don't", "<|endoftext|>", "</s>", "\x00",
             "é", "ﬁ", "...", "(){}", "ñandú", "Übergröße", "aaaaaaaaaaa", " ", "\r\n", "　"]
    # the space mark itself joins to other bytes than the text's
    return ["".join(rnd.choice(words) + rnd.choice(["", " ", " ", "  "]) for _ in range(rnd.randint(0, 40))) + "a▁b" * (i % 10 == 0) for i in range(n)]


def test_common_ends_equal_intersection():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        size = int(rnd.integers(1, 400))
        a, b = (np.unique(np.append(rnd.integers(1, size + 1, int(rnd.integers(1, size + 1))), size)) for _ in range(2))
        # a second text behind the first
        a2, b2 = np.concatenate([a, a + size]), np.concatenate([b, b + size])
        cut = align.common_ends(a2, b2, np.array([0, len(a)]), np.array([len(a) - 1, 2 * len(a) - 1]))
        assert a2[cut].tolist() == np.intersect1d(a2, b2).tolist()


def test_long_stretch_without_a_cut():
    a, b = np.append(np.arange(1, 300_001, 2), 300_001), np.append(np.arange(2, 300_001, 2), 300_001)
    assert align.common_ends(a, b, np.array([0]), np.array([len(a) - 1])).sum() == np.intersect1d(a, b).size


@pytest.mark.parametrize("parts", [1, 5])
def test_alignment_equals_plain_walk(spark, monkeypatch, parts):
    texts = random_texts(parts, 300) + [None, "", " ", "word", "word", "word " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    df = df.withColumn("pack", F.lit("x")).withColumn("code", F.lit(1)).withColumn("n_a", F.lit(None))
    got = {r.doc_id: tuple(r)[1:] for r in align.alignment(df, A_PATH, B_PATH).collect()}
    want = dict(enumerate(plain(texts)))
    assert got == want
    assert 30 < sum(w[0] == 0 for w in want.values()) < 100


def test_a_is_the_vocabulary_of_the_library():
    t = align.Tokens(open(A_PATH, "rb").read(), open(B_PATH, "rb").read())
    rnd = random.Random(9)
    texts = random_texts(9, 500) + ["".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(160, 0x24F), rnd.randint(0x3040, 0x30FF)])) for _ in range(60)) for _ in range(2000)]
    assert [t.a.encode_ordinary(x) for x in texts] == [e.ids for e in A.encode_batch(texts, add_special_tokens=False)]


def test_small_packs_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id int, text string")
    rows = align.alignment(df, A_PATH, B_PATH).collect()
    assert len(rows) == 3 and {(r.n_links, r.n_best, r.count_sum) for r in rows} == {(2, 2, 6)}
    assert align.alignment(df.limit(0), A_PATH, B_PATH).count() == 0
    none = align.alignment(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), A_PATH, B_PATH).collect()
    assert sorted(tuple(r) for r in none) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
