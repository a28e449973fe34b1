"""Coordinate arithmetic as column expressions (page space, canvas space, boxes, points)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smallest side, in pixels, of a search highlight or of the bounds of an ink stroke.
MIN_BOX_PX = 4.0


def rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def page_to_canvas(
    left: Column, bottom: Column, right: Column, top: Column,
    page_w: Column, page_h: Column, render_w: Column, render_h: Column,
) -> Column:
    """Box in points to a pixel rect; the y axis flips."""
    sx, sy = render_w / page_w, render_h / page_h
    return rect(left * sx, render_h - top * sy, (right - left) * sx, (top - bottom) * sy)


def canvas_to_page(
    x: Column, y: Column, w: Column, h: Column,
    page_w: Column, page_h: Column, render_w: Column, render_h: Column,
) -> Column:
    """Pixel rect to a box in points with ordered edges."""
    sx, sy = page_w / render_w, page_h / render_h
    y_a, y_b = page_h - y * sy, page_h - (y + h) * sy
    return F.struct(
        (x * sx).alias("left"),
        F.least(y_a, y_b).alias("bottom"),
        ((x + w) * sx).alias("right"),
        F.greatest(y_a, y_b).alias("top"),
    )


def highlight_box(canvas_rect: Column) -> Column:
    """A pixel rect whose sides are at least ``MIN_BOX_PX``."""
    return rect(
        canvas_rect["x"],
        canvas_rect["y"],
        F.greatest(canvas_rect["w"], F.lit(MIN_BOX_PX)),
        F.greatest(canvas_rect["h"], F.lit(MIN_BOX_PX)),
    )


def normalise_drag(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Rect spanned by the two ends of a drag, whatever its direction."""
    return rect(F.least(x0, x1), F.least(y0, y1), F.abs(x1 - x0), F.abs(y1 - y0))


def clamp_points(points: Column, w: Column, h: Column) -> Column:
    """Clamp every point but the first into ``[0, w] x [0, h]``.

    A stroke starts where the button went down, and that point is taken as it is.
    """

    def clamp(v: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(hi, v))

    return F.transform(
        points,
        lambda p, i: F.struct(
            F.when(i == 0, p["x"]).otherwise(clamp(p["x"], w)).alias("x"),
            F.when(i == 0, p["y"]).otherwise(clamp(p["y"], h)).alias("y"),
        ),
    )


def contains(x: Column, y: Column, w: Column, h: Column, px: Column, py: Column) -> Column:
    """Point in rect, all four edges included."""
    return (px >= x) & (px <= x + w) & (py >= y) & (py <= y + h)


def points_bounds(points: Column) -> Column:
    """Bounds of a polyline with sides floored at ``MIN_BOX_PX``."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    x0, y0 = F.array_min(xs), F.array_min(ys)
    floor = F.lit(MIN_BOX_PX)
    return rect(
        x0, y0, F.greatest(F.array_max(xs) - x0, floor), F.greatest(F.array_max(ys) - y0, floor)
    )
