from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import public_tokenizers
from quirelake.llm import packing as p
from quirelake.llm.common import table

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def verify(pieces, ids_of):
    """Every id in exactly one piece, sequences gapless, checksums right; padding left."""
    docs, seqs = {}, {}
    for r in pieces:
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
        ids = ids_of(r.doc_id)[r.start : r.start + r.length]
        assert len(ids) == r.length > 0 and r.doc_tokens == len(ids_of(r.doc_id))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    for rows in docs.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == rows[0].doc_tokens
    padding = 0
    for rows in seqs.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return docs, padding


def test_whole_table(spark, plain):
    docs = table(spark, SMALL, "documents")
    ids = {r.doc_id: plain(r.text) for r in docs.collect()}
    found, padding = verify(p.pack(docs).collect(), ids.__getitem__)
    assert found.keys() == ids.keys() and padding == 0


def test_odd_texts(spark, plain, docs):
    texts = [None, "", " ", "ΑΣ Σ", "İstanbul DŽ", "a\u0301 e\u0301", "it's DON'T we'll 'S 12 3x", "\x1c\x85\u2028x", "<|endoftext|> a", "né.né,né!!",
             "word " * 9000, "ﬁ ½ ²", "\u4e2d\u6587 x", "“quoted” – dash…", "tab\tnew\r\nline"]
    ids = {i: plain(t) for i, t in enumerate(texts)}
    verify(p.pack(docs(*texts, extra="length")).collect(), ids.__getitem__)
    assert p.pack(docs("a").limit(0)).count() == 0


def test_words_encode_as_the_whole(plain):
    rng, cache = random.Random(1), p.TokenCache(PATH)
    chars = [chr(c) for c in range(0x20, 0x250)] + list("‐‘’“”…€\t\n") + ["'s ", "'re", " "] * 8
    texts = ["".join(rng.choice(chars) for _ in range(60)) for _ in range(1500)]
    assert [np.frombuffer(b, "<u4").tolist() for b in cache.encode(texts)] == [plain(t)[:-1] for t in texts]


def test_repeated_rows_are_packed_once_each(spark, docs):
    rows = p.pack(docs((1, "a b c"), (1, "a b c"), (None, "a"))).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 8 and sum(r.length for r in rows if r.doc_id is None) == 2


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 90), st.integers(0, 60)), max_size=60), st.integers(1, 6), st.integers(8, 40))
def test_limits_hold_together(items, segments, loss):
    out = []
    pack = p.Packer(lambda n, at, key, start, length: out.append((n, at, key, start, length)), 32, segments, loss)
    for key, (length, loss_from) in enumerate(items):
        pack.add(key, 0, length, loss_from)
    pack.flush()
    seen = {}
    for n, at, key, start, length in out:
        seen.setdefault(n, []).append((at, key, start, length))
    for rows in seen.values():
        assert len(rows) <= segments or sum(r[3] for r in rows) < 32  # a tail is cut at powers of two
        assert sum(r[3] for r in rows) <= 32
        assert sum(max(0, s + n - max(s, items[k][1])) for _, k, s, n in rows) <= max(loss, 0)
        at = 0
        for a, *_, n in sorted(rows):
            assert a == at
            at += n
    for key, (length, _) in enumerate(items):
        ranges = sorted((s, n) for _, _, k, s, n in out if k == key)
        at = 0
        for s, n in ranges:
            assert s == at
            at += n
        assert at == length


def test_little_padding_and_few_cuts():
    rng, out = random.Random(4), []
    pack = p.Packer(lambda n, at, key, start, length: out.append((n, length)))
    sizes = [rng.randrange(1, 700) for _ in range(5000)]
    for k, n in enumerate(sizes):
        pack.add(k, 0, n)
    pack.flush()
    assert max(n for n, _ in out) + 1 <= sum(sizes) // 2048 + 12
    assert len(out) < 1.2 * len(sizes)


def test_cache_gives_up_what_is_not_used(plain):
    rng, cache = random.Random(2), p.TokenCache(PATH)
    texts = [" ".join(f"{rng.choice('abcdefgh') * rng.randrange(1, 9)}{rng.choice(['', ',', chr(39) + 's'])}" for _ in range(30)) for _ in range(300)]
    for t in texts:
        assert np.frombuffer(cache.encode([t], 60)[0], "<u4").tolist() == plain(t)[:-1]
        assert len(cache.young) <= 30 + 100 and len(cache.old) <= 30 + 100
    cache.shrink(5)
    assert len(cache.young) == 5 and not cache.old


@pytest.mark.parametrize("length, free, full", [(4, 2, (40, 8, 24)), (50, 0, (64, None, 64)), (60, 58, (128, None, None))])
def test_three_limits_bind_apart(spark, plain, length, free, full):
    """Many short documents meet the limit of segments, documents that are all loss that of loss, long prompts that of tokens."""
    rows = [(k, "word " * length, free, "x") for k in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, prompt int, loss_from string").coalesce(1)
    found = p.pack(docs, tokens=128, segments=8, loss=64, loss_from="prompt").collect()
    seqs = {}
    for r in found:
        seqs.setdefault(r.sequence_id, []).append(r)
    sums = [(sum(r.length for r in s), len(s), sum(max(0, r.start + r.length - max(r.start, free)) for r in s)) for _, s in sorted(seqs.items())][:-8]
    assert sums and all(want is None or got == want for row in sums for got, want in zip(row, full, strict=True))
    assert all(t <= 128 and n <= 8 and x <= 64 for t, n, x in sums)
    assert sum(r.length for r in found) == 64 * (length + 1) == 64 * len(plain("word " * length))
