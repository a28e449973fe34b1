"""Edit logs against edits of plain lists, one after another."""

from __future__ import annotations

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirelake.operators.edits import OPS, _chain, _replayed, _summaries, edit_pages
from quirelake.operators.pages import apply_page_map
from quirelake.schemas import PAGES

EDITS = "doc_id long, seq long, op string, at int, to int, other_id long"


def make(spark, sizes):
    rows = [(d, p, 600.0 + d, 700.0 + p) for d, n in sizes.items() for p in range(n)]
    return spark.createDataFrame(rows, PAGES)


def plain(sizes, log):
    start = {d: [(d, p) for p in range(n)] for d, n in sizes.items()}
    docs = {d: list(ps) for d, ps in start.items()}
    for d, _, op, at, to, other in sorted((e for e in log if None not in e[:2]), key=lambda e: (e[0], e[1])):
        ps = docs.setdefault(d, [])
        if op == "append":
            ps.extend(start.get(other, []))
            continue
        if at is None or not 0 <= at < len(ps) or op not in OPS:
            continue
        if op == "delete":
            ps.pop(at)
            continue
        to = {"up": at - 1, "down": at + 1}.get(op, to)
        if to is None or not 0 <= to < len(ps) or to == at:
            continue
        page = ps.pop(at)
        ps.insert(to - 1 if op == "reorder" and to > at else to, page)
    return {d: ps for d, ps in docs.items() if ps}


def result(df):
    out = {}
    for r in df.collect():
        assert (r.width_pt, r.height_pt) == (600.0 + r.source_doc_id, 700.0 + r.source_page_idx)
        assert out.setdefault(r.doc_id, {}).setdefault(r.page_idx, (r.source_doc_id, r.source_page_idx)) == (
            r.source_doc_id, r.source_page_idx)
    for ps in out.values():
        assert sorted(ps) == list(range(len(ps)))
    return {d: [ps[i] for i in range(len(ps))] for d, ps in out.items()}


def logs(rng, docs, edits, sizes):
    reach = max(sizes.values()) + 3
    return [
        (rng.choice(docs), s, rng.choice(OPS), rng.randrange(-1, reach), rng.randrange(-1, reach), rng.choice([*docs, 999]))
        for s in rng.sample(range(edits * 3), edits)
    ]


@pytest.mark.parametrize("block,tile_bits,edits", [(256, 16, 120), (4, 2, 160), (1, 1, 60), (3, 16, 90)])
def test_random_logs(spark, block, tile_bits, edits):
    rng = random.Random(block)
    sizes = {0: 9, 1: 1, 2: 30, 3: 4, 4: 6}
    log = logs(rng, [0, 1, 2, 3, 7], edits, sizes)
    got = result(edit_pages(make(spark, sizes), spark.createDataFrame(log, EDITS), block, tile_bits))
    assert got == plain(sizes, log)


def test_a_long_log_of_one_document(spark):
    """Many levels, lineage cuts between them, and pages that are moved over borders of tiles."""
    rng = random.Random(7)
    sizes = {1: 300, 2: 40}
    log = [(1, s, rng.choices(OPS, (30, 20, 20, 40, 1))[0], rng.randrange(400), rng.randrange(400), 2) for s in range(500)]
    got = result(edit_pages(make(spark, sizes), spark.createDataFrame(log, EDITS), block=8, tile_bits=5))
    assert got == plain(sizes, log)


def test_deletions_past_the_end_count_for_nothing(spark):
    sizes = {1: 3}
    log = [(1, s, "delete", 1, None, None) for s in range(9)] + [(1, 20, "append", None, None, 1), (1, 21, "down", 1, None, None)]
    got = result(edit_pages(make(spark, sizes), spark.createDataFrame(log, EDITS), block=2, tile_bits=1))
    assert got == plain(sizes, log) == {1: [(1, 0), (1, 1), (1, 0), (1, 2)]}


def test_what_is_no_edit(spark):
    sizes = {1: 3, 2: 2}
    log = [
        (None, 1, "delete", 0, None, None), (1, None, "delete", 0, None, None), (1, 2, None, 0, 1, 2), (1, 3, "turn", 0, 1, None),
        (1, 4, "delete", None, None, None), (1, 5, "reorder", 0, None, None), (1, 6, "append", 0, 0, None), (1, 7, "delete", -1, 0, 0),
    ]
    got = result(edit_pages(make(spark, sizes), spark.createDataFrame(log, EDITS)))
    assert got == {1: [(1, 0), (1, 1), (1, 2)], 2: [(2, 0), (2, 1)]}


def test_empty_tables(spark):
    none = spark.createDataFrame([], EDITS)
    assert result(edit_pages(make(spark, {1: 2}), none)) == {1: [(1, 0), (1, 1)]}
    assert edit_pages(make(spark, {}), none).count() == 0
    gone = spark.createDataFrame([(1, 1, "delete", 0, None, None), (1, 2, "delete", 0, None, None)], EDITS)
    assert edit_pages(make(spark, {1: 2}), gone).count() == 0


def test_words_go_where_their_pages_go(spark):
    """A document appended twice brings its words twice; words of deleted pages go."""
    pages = make(spark, {1: 1, 2: 2})
    log = [(1, 1, "append", None, None, 2), (1, 2, "append", None, None, 2), (1, 3, "delete", 0, None, None), (2, 1, "delete", 1, None, None)]
    words = pages.select("doc_id", "page_idx", F.concat_ws("/", "doc_id", "page_idx").alias("text"))
    moved = edit_pages(pages, spark.createDataFrame(log, EDITS))
    got = sorted((r.doc_id, r.page_idx, r.text) for r in apply_page_map(words, moved).collect())
    assert got == [(1, 0, "2/0"), (1, 1, "2/1"), (1, 2, "2/0"), (1, 3, "2/1"), (2, 0, "2/0")]


def test_a_batch_of_many_blocks_is_never_python_objects_as_a_whole():
    """A batch that the three steps in Python are given holds up to ten thousand blocks of 256 edits."""
    edits = [{"seq": s, "op": "reorder" if s % 2 else "delete", "at": s % 7, "to": 3, "start": 0, "size": 0} for s in range(100)]
    n = 1000
    batch = pa.record_batch({
        "doc_id": pa.array(range(n)), "block": pa.array([0] * n), "blocks": pa.array([1] * n), "n": pa.array([200] * n),
        "n0": pa.array([200] * n), "shift": pa.array([0] * n), "steps": pa.array([list(range(200))] * n), "edits": pa.array([edits] * n),
    })
    for step, rows in ((_summaries, n), (_chain, n), (_replayed, None)):
        tracemalloc.start()
        made = sum(b.num_rows for b in step(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert made == rows or rows is None and made % n == 0 and made > n
        assert peak < 5e6
