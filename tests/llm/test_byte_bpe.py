"""Byte-level BPE against the public library and by round trips."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from airgrid.llm.byte_bpe import BYTES, LETTERS, ByteBpe, byte_bpe_digests, read_ranks, runs, serialise

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def pair():
    tokens = read_ranks(RANKS)
    return ByteBpe(serialise(tokens), P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def flat(bpe, text):
    return [i for run in bpe.encode(text) for i in run]


def test_letters_stand_for_bytes():
    assert len(set(LETTERS)) == 256 and all(LETTERS[b] == x for x, b in BYTES.items())


def test_random_texts(pair):
    bpe, library = pair
    rng = random.Random(2)
    pool = [*map(chr, range(0x250)), " ", "　", "\U0001f600", "١", "一", "́", "​", "﻿", "'s", "'ll", " ", " ", "  ", "\n", "hello", " world", "123", "<unk>", "<unk> ", "<|endoftext|>", "<0x41>", "▁"]
    for _ in range(3000):
        t = "".join(rng.choices(pool, k=rng.randrange(30)))
        ids = flat(bpe, t)
        assert ids == library.encode_ordinary(t)
        assert bpe.decode(ids) == t.encode()


def test_long_texts_go_in_runs(pair):
    bpe, library = pair
    t = "x y " * 40_000 + "a" * 100_000 + " " * 100_000 + "é" * 50_000 + "b c\n d" + " q" * 70_000
    assert "".join(runs(t)) == t and max(map(len, runs("ab cd " * 50_000))) < 1 << 17
    assert flat(bpe, t) == library.encode_ordinary(t)
    assert len(list(bpe.encode(t))) > 3 and all(len(w) <= 64 for w in [*bpe.words, *bpe.tokens])


def test_whole_tokens_win_over_merges(pair):
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", b"xyz"]
    bpe = ByteBpe(serialise(tokens), r"\S+|\s+")
    library = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    for t in ("abc", "bcabcab", "xyz", "xyzx", "aabbcc abcabc"):
        assert flat(bpe, t) == library.encode_ordinary(t)


def test_digests(spark, pair):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "  \n\t x"), (None, "n"), (None, "n"), (1, "Hello world"), (5, "a b " * 40_000), (6, "né 😀")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_tokens": F.lit(1), "ids": F.lit("x")}).repartition(3)
    want = collections.Counter()
    for i, t in rows:
        ids = pair[1].encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, byte_bpe_digests(d, RANKS, P.PATTERN).collect())) == want
    assert byte_bpe_digests(d.limit(0), RANKS, P.PATTERN).count() == 0


def test_gaps_in_ranks_are_refused(tmp_path):
    (tmp_path / "r").write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError, match="gaps"):
        read_ranks(str(tmp_path / "r"))
