"""Encoding equals the tiktoken library; decoding gives the bytes back."""
import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from quarry.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(4)
    texts = ["", " ", "a  b", "a   b\n\n c", "x\x1cy \x1d z", "don't I'll  we've' '", "\n\n", "a \n b", " lead", "trail ", "½²③ ١٢", "日本語 テキスト",
             "\U0001f600 \U0001f600", "a" * 300, "ab" * 400, "!" * 777 + "?" * 3, "\x85a​b", "\x00 \x00a", "<|endoftext|>", "word, word. word; 'word'"]
    texts += ["".join(rng.choice(" \n\tab'sll.!éß日\x1f　 ") for _ in range(rng.randint(1, 60))) for _ in range(150)]
    texts += ["".join(rng.choice(["th", "he", "aa", "ing", "ation", "a", "é"]) for _ in range(rng.randint(60, 400))) for _ in range(10)]
    return texts + ["".join(rng.choice(["wo", "rd ", "and ", "x.\n"]) for _ in range(60000))]


def test_equals_the_library(spark, library):
    texts = odd_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(-1, None), (3, "again"), (3, "again")]
    got = sorted(bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), PATH, P.PATTERN).collect())
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert [tuple(r) for r in got] == sorted(want)


def test_encode_then_decode(spark, library):
    df = spark.createDataFrame(list(enumerate(odd_texts())), "doc_id long, text string")
    ids = bpe.encode(df, PATH, P.PATTERN)
    assert {r.doc_id: list(r.ids) for r in ids.collect()} == {i: library.encode_ordinary(t) for i, t in enumerate(odd_texts())}
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(ids, PATH, P.PATTERN).collect()}
    assert back == {i: t.encode() for i, t in enumerate(odd_texts())}


def test_small_memory_changes_nothing(library):
    t = bpe.Tokenizer(bpe.read_vocabulary(PATH), P.PATTERN)
    old, bpe.REMEMBERED = bpe.REMEMBERED, 5
    try:
        for text in odd_texts()[:60] * 2:
            (n, ids, decoded), = t.encode([text])
            want = library.encode_ordinary(text)
            assert (n, ids, decoded) == (len(want), " ".join(map(str, want)), text.encode())
    finally:
        bpe.REMEMBERED = old


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip(empty, PATH, P.PATTERN).collect() == []
    df = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, n_tokens int, ids string")
    row, = bpe.round_trip(df, PATH, P.PATTERN).collect()
    assert row.n_tokens == 2
