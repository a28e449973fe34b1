"""Line grouping, reading order and joined text against plain loops."""

from __future__ import annotations

import random

import pytest

from quirelake.operators import lines
from quirelake.schemas import WORDS


def words_of(spark, tops_lefts, doc=1):
    rows = [(doc, 0, n, f"w{n}", left, top - 10, left + 5, top, 10.0, "A") for n, (top, left) in enumerate(tops_lefts)]
    return spark.createDataFrame(rows, WORDS)


def grouped(words):
    """Lines of ``(idx, top, left)`` words, by scanning in reading order."""
    out, anchor = [], None
    for w in sorted(words, key=lambda w: (-w[1], w[2], w[0])):
        if anchor is None or abs(w[1] - anchor) > 3:
            out.append([])
            anchor = w[1]
        out[-1].append(w[0])
    return out


@pytest.mark.parametrize(
    ("tops", "want"),
    [
        ([100, 98, 96, 94], [0, 0, 1, 1]),  # the anchor does not follow
        ([100, 97], [0, 0]),
        ([100, 96.999], [0, 1]),
        ([100, 100, 50], [0, 0, 1]),
        ([94, 96, 98, 100], [1, 1, 0, 0]),
    ],
)
def test_anchored_lines(spark, tops, want):
    got = lines.group_lines(words_of(spark, [(float(t), 0.0) for t in tops])).collect()
    assert [r.line_no for r in sorted(got, key=lambda r: r.word_idx)] == want


def test_random_pages(spark):
    rng = random.Random(5)
    pages, rows = {}, []
    for doc in range(60):
        n = rng.choice([1, 3, 20, 60])
        step = rng.choice([0.25, 1.0, 2.0])
        pages[doc] = [(i, rng.randint(0, 60) * step, float(rng.randint(0, 9))) for i in range(n)]
        rows += [(doc, 0, i, f"w{i}", left, top, left, top, 10.0, "A") for i, top, left in pages[doc]]
    df = spark.createDataFrame(rows, WORDS)
    lined = lines.group_lines(df)
    got = {(r.doc_id, r.line_no): r.text for r in lines.line_text(lined).collect()}
    want = {(d, n): " ".join(f"w{i}" for i in ln) for d, ws in pages.items() for n, ln in enumerate(grouped(ws))}
    assert got == want
    order = {(r.doc_id, r.read_pos): r.word_idx for r in lines.reading_order(df).collect()}
    for d, ws in pages.items():
        by_hand = sorted(ws, key=lambda w: (-w[1], w[2], w[0]))
        assert [order[d, n] for n in range(len(ws))] == [w[0] for w in by_hand]
    across = lines.left_to_right(lined, ["doc_id", "page_idx", "line_no"]).collect()
    pos = {(r.doc_id, r.word_idx): r.line_pos for r in across}
    for d, ws in pages.items():
        left = {w[0]: w[2] for w in ws}
        for ln in grouped(ws):
            assert [i for i in sorted(ln, key=lambda i: pos[d, i])] == sorted(ln, key=lambda i: (left[i], i))


def test_region_text_and_page_text(spark):
    df = words_of(spark, [(100.0, 50.0), (101.0, 90.0), (80.0, 10.0)])
    regions = df.selectExpr("7L as region_id", *[c for c in df.columns])
    assert lines.region_text(regions).collect()[0].asDict() == {"region_id": 7, "text": "w1 w0\nw2", "n_words": 3}
    assert [r.text for r in lines.page_text(df).collect()] == ["w0 w1 w2"]
    blank = df.withColumn("text", lines.F.lit(" "))
    assert lines.page_text(blank).count() == 0


def test_page_text_joins_blocks_in_order(spark, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK_BITS", 2)
    df = words_of(spark, [(100.0, 0.0)] * 30)
    assert lines.page_text(df).first().text == " ".join(f"w{n}" for n in range(30))


def test_line_bounds(spark):
    df = words_of(spark, [(100.0, 50.0), (98.0, 10.0)])
    b = lines.line_bounds(lines.group_lines(df)).first()
    assert (b.left_pt, b.bottom_pt, b.right_pt, b.top_pt, b.width_pt, b.height_pt) == (10, 88, 55, 100, 45, 12)


def test_a_page_of_many_levels(spark):
    """Every word at a height of its own: levels are sorted strip by strip, and lines still follow their anchors."""
    n = 20_000
    df = spark.range(n).selectExpr(
        "1L as doc_id", "0 as page_idx", "cast(id as int) as word_idx", "'w' as text", "0D as left_pt", "0D as bottom_pt", "1D as right_pt",
        f"cast((id * 7919) % {n} as double) / 64 as top_pt", "1D as font_size", "'A' as font_name",
    )
    rows = sorted(lines.reading_order(lines.group_lines(df)).select("top_pt", "line_no", "read_pos").collect(), reverse=True)
    assert [r.read_pos for r in rows] == list(range(n))
    anchor, line = None, -1
    for r in rows:
        if anchor is None or anchor - r.top_pt > 3:
            anchor, line = r.top_pt, line + 1
        assert r.line_no == line


@pytest.mark.parametrize("tolerance", [3.0, 0.5, 0.0, 40.0])
def test_tall_gapless_pages_over_many_blocks(spark, tolerance):
    """Anchors are carried from block to block, wherever the lines of a page start, also below zero."""
    rng = random.Random(int(tolerance * 2))
    pages = {}
    for doc, (n, span, step) in enumerate([(700, 3000, 0.5), (300, 900, 0.25), (500, 4000, 2.0), (40, 90000, 1.0), (200, 60, 0.125)]):
        pages[doc] = [(i, rng.randint(-span, span) * step, float(rng.randint(0, 9))) for i in range(n)]
    pages[9] = [(i, 1000.0 - 3.0 * i, 0.0) for i in range(400)]  # every top just within reach of the one before
    rows = [(d, 0, i, f"w{i}", left, top - 1, left, top, 10.0, "A") for d, ws in pages.items() for i, top, left in ws]
    df = spark.createDataFrame(rows, WORDS)
    want, texts = {}, {}
    for d, ws in pages.items():
        anchor, line = None, -1
        for i, top, _ in sorted(ws, key=lambda w: (-w[1], w[2], w[0])):
            if anchor is None or anchor - top > tolerance:
                anchor, line = top, line + 1
                texts[d] = texts.get(d, "") + "\n"
            else:
                texts[d] += " "
            texts[d] += f"w{i}"
            want[d, i] = line
    assert {(r.doc_id, r.word_idx): r.line_no for r in lines.group_lines(df, tolerance=tolerance).collect()} == want
    got = lines.region_text(df.withColumnRenamed("doc_id", "region_id"), tolerance).collect()
    assert {r.region_id: (r.text, r.n_words) for r in got} == {d: (texts[d][1:], len(ws)) for d, ws in pages.items()}


def test_no_window_over_a_page_and_one_look_at_the_words(spark):
    df = words_of(spark, [(100.0, 0.0)])
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan(lines.group_lines(df))
    text = plan(lines.region_text(df.withColumn("region_id", df["doc_id"])))
    assert "Window" not in text and text.count("Exchange hashpartitioning") <= 5
