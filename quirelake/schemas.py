"""Explicit schemas of the corpus tables. Nothing is ever inferred.

Coordinates ending in ``_pt`` are page points (origin bottom-left, y up); every other
coordinate is in rendered pixels (origin top-left, y down).
"""

from __future__ import annotations

from pyspark.sql import types as T

#: Key of one page. Spelled K in the docstrings.
K = ["doc_id", "page_idx"]

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
POLYLINE = T.ArrayType(POINT)
STROKES = T.ArrayType(POLYLINE)
RECT = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "w", "h")])
# Colour channels are unsigned bytes, hence short.
RGBA = T.StructType([T.StructField(c, T.ShortType()) for c in ("r", "g", "b", "a")])

PAGES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("page_idx", T.IntegerType()),
        T.StructField("width_pt", T.DoubleType()),
        T.StructField("height_pt", T.DoubleType()),
    ]
)

# word_idx is the 0-based content order on the page; text holds no U+0020.
WORDS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("page_idx", T.IntegerType()),
        T.StructField("word_idx", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("left_pt", T.DoubleType()),
        T.StructField("bottom_pt", T.DoubleType()),
        T.StructField("right_pt", T.DoubleType()),
        T.StructField("top_pt", T.DoubleType()),
        T.StructField("font_size", T.DoubleType()),
        T.StructField("font_name", T.StringType()),
    ]
)

RENDER_DIMS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("page_idx", T.IntegerType()),
        T.StructField("render_w", T.IntegerType()),
        T.StructField("render_h", T.IntegerType()),
    ]
)

KINDS = ("text", "highlight", "ink", "text_edit", "signature")

ANNOTATIONS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("page_idx", T.IntegerType()),
        T.StructField("seq", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("pos", POINT),
        T.StructField("rect", RECT),
        T.StructField("content", T.StringType()),
        T.StructField("original", T.StringType()),
        T.StructField("font_size", T.DoubleType()),
        T.StructField("font_name", T.StringType()),
        T.StructField("points", POLYLINE),
        T.StructField("strokes", STROKES),
        T.StructField("scale", T.DoubleType()),
        T.StructField("src_w", T.DoubleType()),
        T.StructField("src_h", T.DoubleType()),
        T.StructField("stroke_width", T.DoubleType()),
        T.StructField("rgba", RGBA),
        # Measured text size, which only a font engine knows; read by hit tests alone.
        T.StructField("measured_w", T.DoubleType()),
        T.StructField("measured_h", T.DoubleType()),
    ]
)

OPS = ("add", "delete", "undo", "clear", "reload")

ANNOT_EVENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("page_idx", T.IntegerType()),
        T.StructField("op", T.StringType()),
        T.StructField("annot_id", T.LongType()),
    ]
)

# The saved-signature file keeps its own capitalised JSON names.
_JSON_POINT = T.StructType([T.StructField("X", T.DoubleType()), T.StructField("Y", T.DoubleType())])
SIGNATURE_JSON = T.StructType(
    [
        T.StructField("Id", T.StringType()),
        T.StructField("Name", T.StringType()),
        T.StructField("Strokes", T.ArrayType(T.ArrayType(_JSON_POINT))),
        T.StructField("CanvasWidth", T.DoubleType()),
        T.StructField("CanvasHeight", T.DoubleType()),
    ]
)

SIGNATURES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("strokes", STROKES),
        T.StructField("canvas_w", T.DoubleType()),
        T.StructField("canvas_h", T.DoubleType()),
    ]
)

PRIMITIVE = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("x1", T.DoubleType()),
        T.StructField("y1", T.DoubleType()),
        T.StructField("x2", T.DoubleType()),
        T.StructField("y2", T.DoubleType()),
        T.StructField("w", T.DoubleType()),
        T.StructField("h", T.DoubleType()),
        T.StructField("text", T.StringType()),
        T.StructField("font", T.StringType()),
        T.StructField("size", T.DoubleType()),
        T.StructField("pen_width", T.DoubleType()),
        T.StructField("rgba", RGBA),
    ]
)

DRAW_OPS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("page_idx", T.IntegerType()),
        T.StructField("seq", T.LongType()),
        T.StructField("prim_idx", T.IntegerType()),
        *PRIMITIVE.fields,
    ]
)
