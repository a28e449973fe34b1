from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, assume, given, settings
from hypothesis import strategies as st

from quirelake.llm import substrings as sub


def plain(texts, window=35):
    """(n_words, n_removed, digest of what is kept) per text, window by window."""
    split = [[w for w in _split(t or "")] for t in texts]
    times = Counter(tuple(w[k : k + window]) for w in split for k in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {j for k in range(len(w) - window + 1) if times[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def _split(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def report(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in sub.report(df).collect())


def corpus():
    rng = random.Random(3)
    words = ["a", "b", "né", "c,", "d.", " ", "long" * 80]
    text = lambda n, k=400: " ".join(rng.choice([*words, *map(str, range(k))]) for _ in range(n))
    licence, shared, edge = text(60), text(35), text(34)
    out = [text(rng.randrange(1, 300)) for _ in range(40)]
    out += [f"{text(20)} {licence} {text(9)}" for _ in range(12)] + [f"{licence} {text(50)}", f"{text(5)}\n{licence}"]
    out += [f"{text(3)} {shared}\t{text(4)}" for _ in range(3)] + [f"{text(3)} {edge} {text(4)}" for _ in range(3)]
    # Parts of one passage, overlapping; a text that repeats itself; runs of one word; copies.
    long = text(200).split(" ")
    out += [" ".join(long[a:b]) for a, b in ((0, 90), (60, 200), (20, 55), (100, 134), (100, 135))]
    twice = text(36)
    out += [f"{twice} x {twice}", "z " * 36, "z " * 35, "z " * 500, out[0], out[0], out[3], None, "", " \n ", None, "\xa0" * 40]
    return out


def test_brute_force(spark, docs):
    texts = corpus()
    assert report(docs(*texts, extra="k1")) == [(i, *row) for i, row in enumerate(plain(texts))]


@pytest.mark.parametrize("hot", [1, 5])
def test_hot_anchors(spark, docs, monkeypatch, hot):
    """Anchors with more occurrences than a shard takes are dealt out window by window, with the same result."""
    monkeypatch.setattr(sub, "HOT", hot)
    texts = corpus()
    assert report(docs(*texts)) == [(i, *row) for i, row in enumerate(plain(texts))]


def test_repeated_rows_null_ids_and_empty_tables(spark, docs):
    text = " ".join(map(str, range(50)))
    found = sub.report(docs((1, text), (1, text), (None, "a"), (2, text + " x"))).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in found) == [(0, 0), (1, 50), (1, 50), (2, 50)]
    assert sub.report(docs("a").limit(0)).count() == 0


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=12).map("".join), min_size=1, max_size=6), st.integers(2, 6))
def test_shards_equal_brute_force(texts, window):
    """A shard that holds all stretches as those of one anchor finds what brute force finds."""
    times = Counter(t for t in texts if len(t) >= window)
    assume(times)
    shard = sub.Shard(window)
    shard.add([(" ".join(t).encode(), n) for t, n in times.items()])
    # Within a stretch windows differ, as runs of one anchor have it.
    windows = {t: [t[k : k + window] for k in range(len(t) - window + 1)] for t in times}
    assume(all(len({*x}) == len(x) for x in windows.values()))
    count = Counter(w for t, n in times.items() for w in windows[t] for _ in range(n))
    for t, spans in zip(times, next(shard.located()), strict=True):
        want = {j for k, w in enumerate(windows[t]) if count[w] > 1 for j in range(k, k + window)}
        assert {j for a, b in zip(spans[::2], spans[1::2], strict=True) for j in range(a, b)} == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab"), min_size=12, max_size=60), st.integers(0, 20), st.integers(0, 20))
def test_equal_windows_have_equal_anchors(words, before, after):
    window, gram = 10, 4

    def of(text):
        h, at, n = sub.anchors(sub.word_hashes(" ".join(text).encode()), window, gram)
        return np.repeat(h, n).tolist()

    inner = of(words)
    outer = of(["x"] * before + words + ["y"] * after)
    assert outer[before : before + len(inner)] == inner


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("aé \n\t\x85\xa0b"), max_size=60), st.sampled_from([1, 7, 1 << 20]))
def test_hashes_are_of_words(text, size):
    old, sub.SLICE = sub.SLICE, size
    try:
        found = sub.word_hashes(text.encode())
    finally:
        sub.SLICE = old
    words = _split(text)
    assert len(found) == len(words)
    assert len({*zip(words, found.tolist(), strict=True)}) == len(set(words)) == len(set(found.tolist()))
