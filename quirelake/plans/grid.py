"""Grid cells that turn a range condition into an equi-join key.

A spatial join on the page key alone compares everything on a page with everything else on it.
With a cell in the key, only what is near meets, and the rows of one crowded page spread over
many hash buckets. Cells are of a fixed size and the outermost ones reach to infinity, so any
coordinate has a cell, the mapping is monotone, and a box covers a bounded number of cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells per axis between the two outer ones.
CELLS = 16


def cell(v: Column, size: float | Column, cells: int | Column = CELLS) -> Column:
    """Cell number of a coordinate along one axis: -1 below zero, up to ``cells`` beyond the grid."""
    last = F.lit(cells) if isinstance(cells, int) else cells
    return F.least(F.greatest(F.floor(v / size), F.lit(-1)), last).cast("int")


def spread_span(
    df: DataFrame, lo: Column, hi: Column, size: float | Column, out: str, cells: int | Column = CELLS
) -> DataFrame:
    """One row per cell that the span ``[lo, hi]`` touches; spans with ``hi < lo`` drop out."""
    touched = F.sequence(cell(lo, size, cells), cell(hi, size, cells))
    return df.where(lo <= hi).withColumn(out, F.explode(touched))


def spread_box(
    df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size: float | Column,
    cells: int | Column = CELLS,
) -> DataFrame:
    """One row per cell that the box touches, as ``cell_x`` and ``cell_y``."""
    return spread_span(spread_span(df, x0, x1, size, "cell_x", cells), y0, y1, size, "cell_y", cells)


def spread_levels(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> DataFrame:
    """One row per cell that the box touches, as ``level``, ``cell_x`` and ``cell_y``: four at most.

    Cells of a level are twice as wide as those of the level below, from ``size`` up, and a box goes to the
    lowest level whose cells are at least as wide and high as itself. Boxes with ``x1 < x0`` or ``y1 < y0``
    drop out.
    """
    extent = F.greatest(x1 - x0, y1 - y0)
    level = F.greatest(F.ceil(F.log2(extent / size) - 1e-9), F.lit(0)).cast("int")
    placed = df.where((x0 <= x1) & (y0 <= y1)).withColumn("level", F.coalesce(level, F.lit(0)))
    touched = lambda lo, hi: F.sequence(level_cell(lo, "level", size), level_cell(hi, "level", size))
    return placed.withColumn("cell_x", F.explode(touched(x0, x1))).withColumn("cell_y", F.explode(touched(y0, y1)))


def level_cell(v: Column, level: str, size: float) -> Column:
    """Cell number of a coordinate along one axis of a level."""
    return F.floor(v / (F.lit(float(size)) * F.pow(F.lit(2.0), F.col(level)))).cast("long")
