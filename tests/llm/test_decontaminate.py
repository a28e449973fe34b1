from __future__ import annotations

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quirelake.llm import decontaminate as d


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(texts, items, window=10):
    """(n_words, n_hit, ids) per text, window by window."""
    out = []
    for text in texts:
        w, hit, ids = plain_words(text), set(), set()
        for key, item in items:
            p = plain_words(item)
            m = min(window, len(p))
            for i in range(len(p) - m + 1 if p else 0):
                for s in range(len(w) - m + 1):
                    if w[s : s + m] == p[i : i + m]:
                        hit |= set(range(s, s + m))
                        if key is not None:
                            ids.add(str(key))
        out.append((len(w), len(hit), sorted(ids)))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=5), min_size=1, max_size=6))
def test_search_finds_every_occurrence(text, pats):
    pats = {tuple(p) for p in pats}
    found = sorted((s, p) for t in d.searchers(pats) for s, p in t.search(text))
    want = sorted((s, p) for p in pats for s in range(len(text) - len(p) + 1) if tuple(text[s : s + len(p)]) == p)
    assert found == want


def test_shift_skips():
    t = d.WuManber(4, [tuple("abcd")])
    assert t.shift[("a", "b")] == 2 and t.shift[("c", "d")] == 0 and t.most == 3


def test_report_equals_brute_force(spark, docs):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["Ab", "é", "C-3", "d", "e."]) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 14]))) for i in range(12)] + [(12, None), (13, ""), (14, "..."), (None, "e d e d"), (3, text(12))]
    texts = [text(n) for n in (0, 1, 5, 30, 200)] + [None, "", items[5][1], f"x {items[7][1]} y", items[5][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = {r.doc_id: r for r in d.report(docs(*texts), bench).collect()}
    for i, (n, hit, ids) in enumerate(plain(texts, items)):
        want = (n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0)
        r = rows[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want


def test_blocks_of_the_test_set_add_up(spark, docs):
    items = [(i, f"one two three word{i}") for i in range(9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = docs(*[f"zero one two three word{i} four one two three word{8 - i}" for i in range(9)])
    whole = d.mark_windows(frame, bench).orderBy("doc_id").collect()
    split = d.mark_windows(frame, bench, block_bytes=30).orderBy("doc_id").collect()
    assert whole == split and whole[0]["__leaks"]["items"] == ["0", "8"]


def test_empty_tables_and_extra_columns(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    frame = docs("a b", "c", extra="n_words")
    assert [r.contaminated for r in d.report(frame, none).collect()] == [False, False]
    kept = d.drop_contaminated(frame, spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    assert kept.columns == frame.columns and [r.doc_id for r in kept.collect()] == [1]
    assert d.report(docs("x").limit(0), none).count() == 0
