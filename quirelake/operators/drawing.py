"""Annotations to drawing primitives, in points with the origin at the top left.

Each kind has one expression that builds an array of primitives from a row with ``sx`` and
``sy``; flattening is one join for the scales and one generate over the expression of the
row's kind, however many kinds there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions.text import DEFAULT_FONT
from quirelake.operators.spatial import WHITE_BOX_PAD_PX, with_dims
from quirelake.schemas import K, PRIMITIVE

#: Distance between baselines in font sizes.
LINE_SPACING = 1.2
#: Pen of a signature before scaling, in pixels.
SIGNATURE_PEN_PX = 2

_OUT = [f.name for f in PRIMITIVE.fields]


def _rgba(r: int, g: int, b: int, a: int) -> Column:
    return F.struct(*[F.lit(v).cast("short").alias(c) for c, v in zip("rgba", (r, g, b, a))])


BLACK, WHITE = (0, 0, 0, 255), (255, 255, 255, 255)


def _prim(**cols: Column) -> Column:
    """A primitive with the given fields; the others are null."""
    return F.struct(
        *[cols.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PRIMITIVE.fields]
    )


def _no_prims() -> Column:
    return F.array().cast(f"array<{PRIMITIVE.simpleString()}>")


def _string(x: Column, baseline: Column, text: Column, font: Column) -> Column:
    size = F.col("font_size") * F.col("sy")
    return _prim(
        kind=F.lit("string"), x1=x, y1=baseline, text=text, font=font, size=size, rgba=_rgba(*BLACK)
    )


def _segments(points: Column, place, pen: Column, colour: Column) -> Column:
    """Lines between consecutive points; none for fewer than two points."""

    def segment(i: Column) -> Column:
        x1, y1 = place(F.get(points, i))
        x2, y2 = place(F.get(points, i + 1))
        return _prim(kind=F.lit("line"), x1=x1, y1=y1, x2=x2, y2=y2, pen_width=pen, rgba=colour)

    # A sequence down to -1 would count backwards, hence the guard.
    return F.when(
        F.size(points) >= 2, F.transform(F.sequence(F.lit(0), F.size(points) - 2), segment)
    ).otherwise(_no_prims())


def text_prims() -> Column:
    """One string per line of content; empty lines take their space and draw nothing."""
    size = F.col("font_size") * F.col("sy")
    first = F.col("pos.y") * F.col("sy") + size
    lines = F.transform(
        F.split("content", "\n"),
        lambda t, i: F.struct(t.alias("t"), i.alias("i")),
    )
    return F.transform(
        F.filter(lines, lambda ln: ln["t"] != ""),
        lambda ln: _string(
            F.col("pos.x") * F.col("sx"), first + ln["i"] * (size * LINE_SPACING), ln["t"], F.lit(DEFAULT_FONT)
        ),
    )


def highlight_prims() -> Column:
    sx, sy, r = F.col("sx"), F.col("sy"), F.col("rect")
    return F.array(
        _prim(
            kind=F.lit("rect"), x1=r["x"] * sx, y1=r["y"] * sy, w=r["w"] * sx, h=r["h"] * sy,
            rgba=F.col("rgba"),
        )
    )


def ink_prims() -> Column:
    sx, sy = F.col("sx"), F.col("sy")
    return _segments(
        F.col("points"), lambda p: (p["x"] * sx, p["y"] * sy), F.col("stroke_width") * sx, F.col("rgba")
    )


def text_edit_prims() -> Column:
    """A white box over the original line, then the new text."""
    sx, sy, r, pad = F.col("sx"), F.col("sy"), F.col("rect"), WHITE_BOX_PAD_PX
    white = _prim(
        kind=F.lit("rect"), x1=(r["x"] - pad) * sx, y1=(r["y"] - pad) * sy,
        w=(r["w"] + 2 * pad) * sx, h=(r["h"] + 2 * pad) * sy, rgba=_rgba(*WHITE),
    )
    baseline = F.col("pos.y") * sy + F.col("font_size") * sy
    return F.array(
        white, _string(F.col("pos.x") * sx, baseline, F.col("content"), F.col("font_name"))
    )


def signature_prims() -> Column:
    sx, sy, scale = F.col("sx"), F.col("sy"), F.col("scale")

    def place(p: Column) -> tuple[Column, Column]:
        return (F.col("pos.x") + p["x"] * scale) * sx, (F.col("pos.y") + p["y"] * scale) * sy

    pen = SIGNATURE_PEN_PX * scale * sx
    return F.flatten(F.transform("strokes", lambda s: _segments(s, place, pen, _rgba(*BLACK))))


PRIMS = {
    "text": text_prims,
    "highlight": highlight_prims,
    "ink": ink_prims,
    "text_edit": text_edit_prims,
    "signature": signature_prims,
}


def _draw(scaled: DataFrame, prims: Column) -> DataFrame:
    out = scaled.select(*K, "seq", F.posexplode(prims).alias("prim_idx", "p"))
    return out.select(*K, "seq", "prim_idx", *[F.col(f"p.{c}").alias(c) for c in _OUT])


def draw_kind(annotations: DataFrame, pages: DataFrame, dims: DataFrame, kind: str) -> DataFrame:
    """Primitives of the annotations of one kind."""
    return _draw(with_dims(annotations.where(F.col("kind") == kind), pages, dims), PRIMS[kind]())


def draw_text(annotations: DataFrame, pages: DataFrame, dims: DataFrame) -> DataFrame:
    return draw_kind(annotations, pages, dims, "text")


def draw_highlight(annotations: DataFrame, pages: DataFrame, dims: DataFrame) -> DataFrame:
    return draw_kind(annotations, pages, dims, "highlight")


def draw_ink(annotations: DataFrame, pages: DataFrame, dims: DataFrame) -> DataFrame:
    return draw_kind(annotations, pages, dims, "ink")


def draw_text_edit(annotations: DataFrame, pages: DataFrame, dims: DataFrame) -> DataFrame:
    return draw_kind(annotations, pages, dims, "text_edit")


def draw_signature(annotations: DataFrame, pages: DataFrame, dims: DataFrame) -> DataFrame:
    return draw_kind(annotations, pages, dims, "signature")


def flatten_annotations(annotations: DataFrame, pages: DataFrame, dims: DataFrame) -> DataFrame:
    """Primitives of all annotations; drawing order on a page is ``(seq, prim_idx)``.

    The join for the scales is inner on existing, rendered pages, so it also drops what cannot
    be burned.
    """
    prims = None
    for kind, build in PRIMS.items():
        here = F.col("kind") == kind
        prims = F.when(here, build()) if prims is None else prims.when(here, build())
    return _draw(with_dims(annotations, pages, dims), prims)
