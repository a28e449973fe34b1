"""Column functions and filters on both sides of each threshold."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quirelake.functions import geometry as G
from quirelake.functions import text as X
from quirelake.operators import filters as flt
from quirelake.schemas import ANNOTATIONS, SIGNATURES


def apply(spark, values, schema, fn):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, v {schema}")
    return [r.out for r in df.select("n", fn(F.col("v")).alias("out")).orderBy("n").collect()]


def test_font_names(spark):
    names = {
        "ABCDEF+Arial": "Arial", "Arial-BoldItalic": "ArialItalic", "Times,Bold": "Times", "Helvetica-Regular": "Helvetica",
        "Georgia-Roman": "Georgia", "A+B+C": "B+C", "XYZ+-Bold": "Segoe UI", None: "Segoe UI", "": "Segoe UI", " \t": "Segoe UI",
        "arial-bold": "arial-bold", "A,Bold-BoldB": "AB", "X-It,Boldalic": "X", "+": "Segoe UI",
    }
    assert apply(spark, list(names), "string", X.normalise_font) == list(names.values())


def test_protected_messages(spark):
    messages = {"Invalid PASSWORD": True, "file is Encrypted": True, "Protected document": True, "unexpected end of file": False, None: False}
    assert apply(spark, list(messages), "string", X.is_protected) == list(messages.values())


def test_strings(spark):
    assert apply(spark, ["  a b \n", "", None], "string", X.trim_whitespace) == ["a b", "", None]
    assert apply(spark, ["  ", None, " x"], "string", X.is_blank) == [True, True, False]
    assert apply(spark, ["abc", "é", "😀b", "", None], "string", X.utf16_length) == [3, 1, 3, 0, None]
    assert apply(spark, ["a.pdf", "b.PDF", "c.pdf.txt", "pdf"], "string", X.has_extension) == [True, True, False, False]
    assert apply(spark, [0, 9], "int", X.page_label) == ["Page 1", "Page 10"]


def test_edit_font_size(spark):
    df = spark.createDataFrame([(12.0, 2.0, 8.0), (3.0, 2.0, 99.0), (None, 2.0, 20.0), (None, 2.0, 8.0)], "f double, s double, h double")
    out = df.select(X.edit_font_size(F.col("f"), F.col("s"), F.col("h")).alias("o"))
    assert [r.o for r in out.collect()] == [24.0, 10.0, 15.0, 10.0]


def test_boxes(spark):
    lit = lambda *vs: [F.lit(float(v)) for v in vs]
    row = spark.range(1).select(
        G.page_to_canvas(*lit(10, 20, 30, 60, 100, 200, 200, 100)).alias("canvas"),
        G.canvas_to_page(*lit(20, 70, 40, 20, 100, 200, 200, 100)).alias("page"),
        G.highlight_box(G.rect(*lit(1, 2, 3.9, 4.1))).alias("floored"),
        G.normalise_drag(*lit(10, 2, 3, 8)).alias("drag"),
    ).first()
    assert tuple(row.canvas) == (20, 70, 40, 20)
    assert tuple(row.page) == (10, 20, 30, 60)
    assert tuple(row.floored) == (1, 2, 4, 4.1)
    assert tuple(row.drag) == (3, 2, 7, 6)


def test_only_later_points_are_clamped(spark):
    points = [[(-5.0, 900.0), (-5.0, 900.0), (3.0, 4.0)], []]
    out = apply(spark, points, "array<struct<x:double,y:double>>", lambda c: G.clamp_points(c, F.lit(10.0), F.lit(20.0)))
    assert [[tuple(p) for p in ps] for ps in out] == [[(-5, 900), (0, 20), (3, 4)], []]


def annots(spark, rows):
    blank = dict.fromkeys(ANNOTATIONS.fieldNames())
    return spark.createDataFrame([tuple({**blank, "doc_id": 1, "page_idx": 0, "seq": n, **r}.values()) for n, r in enumerate(rows)], ANNOTATIONS)


def test_accepted_annotations(spark):
    p = (0.0, 0.0)
    df = annots(
        spark,
        [
            {"kind": "highlight", "rect": (0.0, 0.0, 3.0, 9.0)}, {"kind": "highlight", "rect": (0.0, 0.0, 3.1, 3.1)},
            {"kind": "ink", "points": [p, p]}, {"kind": "ink", "points": [p, p, p]},
            {"kind": "text", "content": " \n"}, {"kind": "text", "content": "\tx "}, {"kind": "text"},
            {"kind": "signature"},
        ],
    )
    assert {(r.seq, r.content) for r in flt.accept_annotations(df).collect()} == {(1, None), (3, None), (5, "x"), (7, None)}


def test_accepted_edits(spark):
    df = annots(
        spark,
        [
            {"kind": "text_edit", "content": " b ", "original": "a"}, {"kind": "text_edit", "content": " a", "original": "a"},
            {"kind": "text_edit", "content": "a", "original": "a "}, {"kind": "text_edit", "content": " ", "original": "a"},
            {"kind": "text_edit", "content": "A", "original": "a"},
        ],
    )
    # The original is compared as it is, blanks and all.
    assert {(r.seq, r.content) for r in flt.accept_text_edits(df).collect()} == {(0, "b"), (2, "a"), (4, "A")}


def test_accepted_strokes(spark):
    p = (0.0, 0.0)
    df = spark.createDataFrame([("a", "A", [[p], [p, p]], 1.0, 1.0), ("b", "B", [[p]], 1.0, 1.0), ("c", "C", [], 1.0, 1.0)], SIGNATURES)
    assert [(r.id, len(r.strokes)) for r in flt.accept_strokes(df).collect()] == [("a", 1)]


def test_burnable_needs_page_and_size(spark):
    df = annots(spark, [{"kind": "ink", "page_idx": p} for p in range(3)])
    pages = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, page_idx int")
    dims = spark.createDataFrame([(1, 1), (1, 2)], "doc_id long, page_idx int")
    assert [r.page_idx for r in flt.burnable(df, pages, dims).collect()] == [1]


@pytest.mark.parametrize("kind", ["text", "highlight", "ink", "text_edit", "signature"])
def test_drawing(spark, kind):
    from quirelake.operators.drawing import draw_kind, flatten_annotations

    red = (255, 0, 0, 80)
    df = annots(
        spark,
        [
            {"kind": "text", "pos": (10.0, 20.0), "content": "a\n\nb", "font_size": 10.0},
            {"kind": "highlight", "rect": (2.0, 4.0, 6.0, 8.0), "rgba": red},
            {"kind": "ink", "points": [(0.0, 0.0), (2.0, 4.0), (4.0, 4.0)], "stroke_width": 4.0, "rgba": red},
            {"kind": "ink", "points": [(0.0, 0.0)], "stroke_width": 4.0, "rgba": red},
            {"kind": "text_edit", "pos": (10.0, 20.0), "rect": (10.0, 20.0, 30.0, 40.0), "content": "n", "font_size": 10.0, "font_name": "F"},
            {"kind": "signature", "pos": (10.0, 20.0), "scale": 0.5, "strokes": [[(0.0, 0.0), (4.0, 8.0)], [(1.0, 1.0)], []]},
            {"kind": "ink", "page_idx": 9, "points": [(0.0, 0.0), (2.0, 4.0)], "stroke_width": 4.0, "rgba": red},
        ],
    )
    pages = spark.createDataFrame([(1, 0, 100.0, 50.0)], "doc_id long, page_idx int, width_pt double, height_pt double")
    dims = spark.createDataFrame([(1, 0, 200, 200)], "doc_id long, page_idx int, render_w int, render_h int")
    # sx = 1/2, sy = 1/4
    want = {
        "text": [(0, "string", 5.0, 7.5, "a", "Segoe UI", 2.5), (1, "string", 5.0, 13.5, "b", "Segoe UI", 2.5)],
        "highlight": [(0, "rect", 1.0, 1.0, 3.0, 2.0)],
        "ink": [(0, "line", 0.0, 0.0, 1.0, 1.0, 2.0), (1, "line", 1.0, 1.0, 2.0, 1.0, 2.0)],
        "text_edit": [(0, "rect", 4.0, 4.5, 17.0, 11.0), (1, "string", 5.0, 7.5, "n", "F", 2.5)],
        "signature": [(0, "line", 5.0, 5.0, 6.0, 6.0, 0.5)],
    }[kind]
    cols = ["x1", "y1", "x2", "y2", "w", "h", "text", "font", "size", "pen_width"]
    pack = lambda df: sorted(
        (r.prim_idx, r.kind, *[r[c] for c in cols if r[c] is not None]) for r in df.collect()
    )
    assert pack(draw_kind(df, pages, dims, kind)) == want
    everything = flatten_annotations(df, pages, dims)
    seqs = {r.seq for r in df.where(F.col("kind") == kind).select("seq").collect()}
    assert pack(everything.where(F.col("seq").isin(*seqs))) == want
    colours = {tuple(r.rgba) for r in everything.where("seq in (1, 2)").collect()}
    assert colours == {red}
