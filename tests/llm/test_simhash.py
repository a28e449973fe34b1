from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import SMALL
from pyspark.sql import functions as F

from quirelake.llm import simhash as s
from quirelake.llm.common import table


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, radius=4):
    """Component of each position by comparing all pairs."""
    fps, comp = np.array(prints, np.uint64), list(range(len(prints)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius):
            a, b = root(i), root(int(j))
            comp[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def near_set(rng, n, flips):
    base = rng.getrandbits(64)
    return [base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(flips + 1))) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 63, 64, 65, 1500])
def test_near_counts_distances(n):
    rng = random.Random(n)
    x = np.array([f for _ in range(n) for f in near_set(rng, 1, 9)], np.uint64)
    q = int(x[0])
    x[n // 2 :] = np.array(near_set(rng, n - n // 2, 12), np.uint64)
    for query in (q, int(x[-1]), 0, (1 << 64) - 1):
        assert (s.near(s.planes(x), n, query) == (np.bitwise_count(x ^ np.uint64(query)) <= 4)).all()


@pytest.mark.parametrize("size", [2, 20, 25, 400])
def test_forest_connects_what_links_connect(size):
    rng = random.Random(size)
    fps = np.array(sorted({f for _ in range(3) for f in near_set(rng, size, 5)}), np.uint64)
    comp = list(range(len(fps)))
    for i, j in s.forest(fps):
        comp[i] = j
    want = plain_components(fps.tolist())
    assert len(set(comp)) == len(set(want)) and all(want[i] == want[c] for i, c in enumerate(comp))


def test_fingerprint(spark, docs):
    texts = ["A b C d e f", "a\tb\nc\x0bd e f", "one", "One two THREE", "", None, " \n", "É é", "\xa0x y z w\x85 v", "ab " * 5000]
    rows = docs(*texts).select("doc_id", s.fingerprinted(F.col("text")).alias("fp")).collect()
    assert [r.fp % (1 << 64) for r in sorted(rows)] == [plain_fingerprint(t) for t in texts]


def test_whole_table_equals_all_pairs(spark):
    docs = table(spark, SMALL, "documents")
    rows = sorted(s.report(docs).collect())
    prints = [plain_fingerprint(r.text) for r in docs.orderBy("doc_id").collect()]
    assert [int(r.fingerprint, 16) for r in rows] == prints
    assert [r.component_id for r in rows] == [rows[c].doc_id for c in plain_components(prints)]


def _components_of(spark, fps):
    nodes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    roots = {r.node: r.root for r in s.components(s.links(nodes)).collect()}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    return [roots.get(f, f) for f in signed]


def test_links_across_keys_and_long_runs(spark, monkeypatch):
    rng = random.Random(11)
    fps = sorted({f for n in (1, 2, 5, 120) for f in near_set(rng, n, 6)} | {rng.getrandbits(64) for _ in range(200)} | {0, 1, (1 << 64) - 1})
    want = plain_components(fps)
    groups = lambda comp: {frozenset(i for i, c in enumerate(comp) if c == x) for x in comp}
    assert groups(_components_of(spark, fps)) == groups(want)


def test_runs_too_long_for_a_task_come_back_whole():
    run = np.arange(s.RUN + 700, dtype=np.int64)
    k, key = np.zeros(len(run), np.int32), np.full(len(run), 9, np.int64)
    after = np.array([5, 4], np.int64)
    names = ["k", "key", "fp"]
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(k[a:b]), pa.array(key[a:b]), pa.array(run[a:b])], names)
    tail = pa.RecordBatch.from_arrays([pa.array(np.ones(2, np.int32)), pa.array(np.zeros(2, np.int64)), pa.array(after)], names)
    out = pa.Table.from_batches(s._linked(iter([batch(0, 5000), batch(5000, 8500), batch(8500, len(run)), tail]), 4)).to_pylist()
    assert sorted(r["u"] for r in out if r["v"] is None) == run.tolist()
    assert [(r["u"], r["v"]) for r in out if r["v"] is not None] in ([(4, 5)], [(5, 4)])


def test_long_runs_are_compared_in_parts(spark):
    rng = random.Random(2)
    fps = [int(np.uint64(f).astype(np.int64)) for f in {f for _ in range(2) for f in near_set(rng, 300, 4)}]
    old, s.RUN = s.RUN, 128
    try:
        rows = spark.createDataFrame([(1, 7, f) for f in fps], "k int, key long, fp long")
        edges = s._long_runs(rows, 4).collect()
    finally:
        s.RUN = old
    index = {f: i for i, f in enumerate(fps)}
    comp = list(range(len(fps)))
    for u, v in edges:
        a, b = comp[index[u]], comp[index[v]]
        comp = [min(a, b) if c in (a, b) else c for c in comp]
    want = plain_components([f % (1 << 64) for f in fps])
    assert len(set(comp)) == len(set(want))


def test_keep_first(spark, docs):
    text = "the quick brown fox jumps over the lazy dog " * 5
    frame = docs((3, text), (1, text), (1, text), (2, "something else altogether of other words"), (None, text), (None, ""), (None, None), (7, "x y"),
                 extra="fingerprint")
    kept = s.keep_first(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id or -1, (r.text or "")[:3]) for r in kept.collect()) == [(-1, ""), (1, "the"), (2, "som"), (7, "x y")]
    assert s.keep_first(frame.limit(0)).count() == 0 and s.report(frame.limit(0)).count() == 0


def test_chain_of_links(spark):
    fps = [(1 << k) - 1 for k in range(0, 64, 4)]  # each four bits from the next
    assert len(set(_components_of(spark, fps))) == 1
