"""Spatial joins between words, regions, clicks, annotations and placements.

Every join is an equi-join on the page and on grid cells, with the exact test as residual
(``plans.grid``). No side is broadcast by hint: the size-checked threshold of Spark decides.
Regions, clicks and edits are converted to the space of the other side, so words are never
joined with page sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions.geometry import canvas_to_page, contains, points_bounds, rect
from quirelake.functions.text import edit_font_size, normalise_font
from quirelake.plans.grid import cell, level_cell, spread_box, spread_levels, spread_span
from quirelake.schemas import K

#: Cell sizes: points for words, pixels for the smallest annotations. The second is a power of two, so that cell
#: borders are exact on every level.
WORD_CELL_PT = 96.0
ANNOT_CELL_PX = 128.0
#: Vertical reach of a click around a line, and of one line around the nearest word, in pixels.
LINE_REACH_PX = 3
NEAREST_LINE_PX = 5
#: An ink annotation is hit closer than this to one of its points.
INK_REACH_PX = 15
#: Padding of a text annotation around its measured text.
TEXT_PAD_PX = 8
#: A white box covers this much around the edited line on each side.
WHITE_BOX_PAD_PX = 2
PLACED_SCALE = 0.5
#: Click heights and middles of a page are ordered within strips of this height.
STRIP_PT = 4.0
_SCALE = ("width_pt", "height_pt", "render_w", "render_h")


def page_scales(pages: DataFrame, dims: DataFrame) -> DataFrame:
    """Page and render sizes of every page that has both."""
    return pages.select(*K, "width_pt", "height_pt").join(
        dims.select(*K, F.col("render_w").cast("double"), F.col("render_h").cast("double")), K
    )


def with_dims(annotations: DataFrame, pages: DataFrame, dims: DataFrame) -> DataFrame:
    """Attach ``sx`` and ``sy``, points per pixel; rows without a rendered page drop out."""
    scales = page_scales(pages, dims).select(
        *K,
        (F.col("width_pt") / F.col("render_w")).alias("sx"),
        (F.col("height_pt") / F.col("render_h")).alias("sy"),
    )
    return annotations.join(scales, K)


def _in_page_space(boxes: DataFrame, pages: DataFrame, dims: DataFrame, x, y, w, h) -> DataFrame:
    """Add ``b``, the box in points, to rows with a canvas rect."""
    return boxes.join(page_scales(pages, dims), K).withColumn(
        "b",
        canvas_to_page(
            x, y, w, h, F.col("width_pt"), F.col("height_pt"), F.col("render_w"), F.col("render_h")
        ),
    )


def _centre() -> tuple[Column, Column]:
    return (
        (F.col("left_pt") + F.col("right_pt")) / 2,
        (F.col("bottom_pt") + F.col("top_pt")) / 2,
    )


def _inside(cx: Column, cy: Column) -> Column:
    return (
        (cx >= F.col("b.left")) & (cx <= F.col("b.right"))
        & (cy >= F.col("b.bottom")) & (cy <= F.col("b.top"))
    )


def _spread_page_boxes(boxes: DataFrame) -> DataFrame:
    return spread_box(
        boxes, F.col("b.left"), F.col("b.bottom"), F.col("b.right"), F.col("b.top"), WORD_CELL_PT
    )


def words_in_region(regions: DataFrame, words: DataFrame, pages: DataFrame, dims: DataFrame) -> DataFrame:
    """Words whose centre lies in a region, edges included: ``region_id`` plus the word."""
    boxes = _in_page_space(regions, pages, dims, *[F.col(c) for c in "xywh"])
    boxes = _spread_page_boxes(boxes.select("region_id", *K, "b"))
    cx, cy = _centre()
    # A word's centre lies in one cell, so a pair meets at most once.
    celled = words.withColumn("cell_x", cell(cx, WORD_CELL_PT)).withColumn("cell_y", cell(cy, WORD_CELL_PT))
    keys = [*K, "cell_x", "cell_y"]
    return celled.join(boxes, keys).where(_inside(cx, cy)).drop("cell_x", "cell_y", "b")


def visible_words(words: DataFrame, edits: DataFrame, pages: DataFrame, dims: DataFrame) -> DataFrame:
    """Words not covered by the white box of a text edit. ``word_idx`` keeps its gaps."""
    pad = WHITE_BOX_PAD_PX
    boxes = edits.where(F.col("kind") == "text_edit").select(*K, "rect")
    boxes = _in_page_space(
        boxes, pages, dims,
        F.col("rect.x") - pad, F.col("rect.y") - pad, F.col("rect.w") + 2 * pad, F.col("rect.h") + 2 * pad,
    )
    boxes = _spread_page_boxes(boxes.select(*K, "b"))
    cx, cy = _centre()
    keys = [*K, "cell_x", "cell_y"]
    celled = words.withColumn("cell_x", cell(cx, WORD_CELL_PT)).withColumn("cell_y", cell(cy, WORD_CELL_PT))
    w, e = celled.alias("w"), boxes.alias("e")
    same_cell = F.lit(True)
    for k in keys:
        same_cell = same_cell & (F.col(f"w.{k}") == F.col(f"e.{k}"))
    return w.join(e, same_cell & _inside(cx, cy), "left_anti").select(*words.columns)


# --- hit tests -------------------------------------------------------------------------------


def _hit_bounds() -> Column:
    """What is selected when an annotation is hit, by kind; null for kinds without bounds."""
    kind, pos = F.col("kind"), F.col("pos")
    pad = F.lit(float(TEXT_PAD_PX))
    return (
        F.when(kind.isin("highlight", "text_edit"), F.col("rect"))
        .when(kind == "text", rect(pos["x"], pos["y"], F.col("measured_w") + pad, F.col("measured_h") + pad))
        .when(
            kind == "signature",
            rect(pos["x"], pos["y"], F.col("src_w") * F.col("scale"), F.col("src_h") * F.col("scale")),
        )
        .when((kind == "ink") & (F.size("points") > 0), points_bounds(F.col("points")))
    )


def _hit_targets(annotations: DataFrame) -> DataFrame:
    """Annotations with their bounds, on the cells of their level."""
    ink = F.col("kind") == "ink"
    b = F.col("bounds")
    # Ink reaches beyond its bounds, so it is looked up in a wider box.
    reach = F.when(ink, F.lit(float(INK_REACH_PX))).otherwise(0.0)
    # Exploding an array of one keeps the optimizer from copying the bounds into every later use.
    targets = annotations.select(
        *K, "seq", "kind", F.when(ink, F.col("points")).alias("points"),
        F.explode(F.array(_hit_bounds())).alias("bounds"),
    )
    return spread_levels(
        targets, b["x"] - reach, b["y"] - reach, b["x"] + b["w"] + reach, b["y"] + b["h"] + reach, ANNOT_CELL_PX
    )


def hit_test(clicks: DataFrame, annotations: DataFrame) -> DataFrame:
    """The topmost annotation under each click, with its bounds.

    An annotation lies on the cells of the level that fits its size, at most four of them; a click looks into one
    cell of each level its page has. Only annotations of a click's cells are tested, and pairs reduce to the
    topmost where they arise.
    """
    targets = _hit_targets(annotations)
    cell_keys = [*K, "level", "cell_x", "cell_y"]
    levels = targets.groupBy(*K).agg(F.collect_set("level").alias("levels"))
    x, y, b = F.col("x"), F.col("y"), F.col("bounds")
    celled = (
        clicks.select("click_id", *K, "x", "y").join(levels, K)
        .select("click_id", *K, "x", "y", F.explode("levels").alias("level"))
        .withColumn("cell_x", level_cell(x, "level", ANNOT_CELL_PX))
        .withColumn("cell_y", level_cell(y, "level", ANNOT_CELL_PX))
    )
    near = F.exists(
        "points",
        lambda p: F.sqrt((p["x"] - x) * (p["x"] - x) + (p["y"] - y) * (p["y"] - y)) < INK_REACH_PX,
    )
    hit = F.when(F.col("kind") == "ink", near).otherwise(contains(b["x"], b["y"], b["w"], b["h"], x, y))
    pairs = celled.join(targets, cell_keys).where(hit)
    # Pre-aggregated where the pairs arise: they are never shuffled one by one.
    top = pairs.groupBy("click_id", *K).agg(
        F.max_by(F.struct("seq", "kind", "bounds"), "seq").alias("top")
    )
    return top.select(
        "click_id", *K, "top.seq", "top.kind",
        *[F.col(f"top.bounds.{c}").alias(c) for c in "xywh"],
    )


def place_signatures(placements: DataFrame, signatures: DataFrame) -> DataFrame:
    """Annotations from ``placements(doc_id, page_idx, seq, signature_id, x, y)``."""
    sigs = signatures.select(
        F.col("id").alias("signature_id"), "strokes",
        F.col("canvas_w").alias("src_w"), F.col("canvas_h").alias("src_h"),
    )
    return placements.join(sigs, "signature_id").select(
        *K, "seq", F.lit("signature").alias("kind"),
        F.struct("x", "y").alias("pos"), "strokes",
        F.lit(PLACED_SCALE).alias("scale"), "src_w", "src_h",
    )


# --- the line under a click ------------------------------------------------------------------


def _click_heights(clicks: DataFrame, pages: DataFrame, dims: DataFrame) -> DataFrame:
    """The distinct heights at which a page was clicked.

    The line depends on the height alone, so however many clicks a page gets, no more than
    its distinct heights take part in the joins with words.
    """
    return clicks.select(*K, F.col("y").alias("click_y")).distinct().join(page_scales(pages, dims), K)


def _canvas_y() -> tuple[Column, Column, Column]:
    """Scale, upper and lower edge of a word on the canvas."""
    sy = F.col("render_h") / F.col("height_pt")
    upper = F.col("render_h") - F.col("top_pt") * sy
    return sy, upper, upper + (F.col("top_pt") - F.col("bottom_pt")) * sy


def _on_heights(heights: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs of a click height and a word (or anything with a top and a bottom) it is level with.

    Both sides span bands: the first band they share is the one in which they meet, once.
    """
    y_pt = (F.col("render_h") - F.col("click_y")) * F.col("height_pt") / F.col("render_h")
    # A point of slack keeps rounding out of the band; the exact test follows.
    slack = LINE_REACH_PX * F.col("height_pt") / F.col("render_h") + 1
    lo = y_pt - slack
    h = spread_span(heights.withColumn("h_lo", cell(lo, WORD_CELL_PT)), lo, y_pt + slack, WORD_CELL_PT, "band")
    w = words.withColumn("w_lo", cell(F.col("bottom_pt"), WORD_CELL_PT))
    w = spread_span(w, F.col("bottom_pt"), F.col("top_pt"), WORD_CELL_PT, "band")
    _, upper, lower = _canvas_y()
    y = F.col("click_y")
    return (
        w.join(h, [*K, "band"])
        .where(F.col("band") == F.greatest("h_lo", "w_lo"))
        .where((y >= upper - LINE_REACH_PX) & (y <= lower + LINE_REACH_PX))
        .drop("band", "h_lo", "w_lo")
    )


def _edit_context(matched: DataFrame, keys: list[str]) -> DataFrame:
    """Left-to-right text, bounds and font of the words of each line, on the canvas."""
    sx = F.col("render_w") / F.col("width_pt")
    sy, upper, lower = _canvas_y()
    cols = matched.select(
        *keys, "word_idx", "text", "font_size", "font_name", sy.alias("sy"),
        (F.col("left_pt") * sx).alias("l"),
        (F.col("left_pt") * sx + (F.col("right_pt") - F.col("left_pt")) * sx).alias("r"),
        upper.alias("t"), lower.alias("b"),
    )
    line = cols.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("l", "word_idx", "text"))).alias("ws"),
        F.min_by(F.struct("font_size", "font_name"), F.struct("l", "word_idx")).alias("first"),
        F.first("sy").alias("sy"),
        F.min("l").alias("x"), F.min("t").alias("y"), F.max("r").alias("r"), F.max("b").alias("b"),
    )
    height = F.col("b") - F.col("y")
    return line.select(
        *keys,
        F.array_join("ws.text", " ").alias("text"),
        "x", "y", (F.col("r") - F.col("x")).alias("w"), height.alias("h"),
        edit_font_size(F.col("first.font_size"), F.col("sy"), height).alias("font_size"),
        normalise_font(F.col("first.font_name")).alias("font_name"),
    )


def _per_click(clicks: DataFrame, lines: DataFrame) -> DataFrame:
    named = clicks.select("click_id", *K, F.col("y").alias("click_y"))
    return named.join(lines, [*K, "click_y"]).drop("click_y")


def line_at_point(clicks: DataFrame, words: DataFrame, pages: DataFrame, dims: DataFrame) -> DataFrame:
    """The line of words at the height of each click; clicks between lines drop out."""
    matched = _on_heights(_click_heights(clicks, pages, dims), words)
    return _per_click(clicks, _edit_context(matched, [*K, "click_y"]))


def nearest_line(clicks: DataFrame, words: DataFrame, pages: DataFrame, dims: DataFrame) -> DataFrame:
    """The line nearest to each click that hits none, however far away it is.

    A line's words share their middle to within ``NEAREST_LINE_PX`` of the nearest word's.
    """
    heights = _click_heights(clicks, pages, dims)
    keys = [*K, "click_y"]
    # Vertical extents are few compared with words, and all that the first two steps need.
    extents = words.groupBy(*K, "top_pt", "bottom_pt").agg(F.min("word_idx").alias("word_idx"))
    level = _on_heights(heights, extents).select(*keys).distinct()
    lost = heights.join(level, keys, "left_anti")
    mids = extents.groupBy(*K, ((F.col("top_pt") + F.col("bottom_pt")) / 2).alias("mid_pt")).agg(
        F.min("word_idx").alias("word_idx")
    )
    near = _nearest_mid(lost, mids)
    # Words of the line around each chosen middle, once per middle and not once per click.
    chosen = near.select(*K, "near_pt", *_SCALE).distinct()
    slack = NEAREST_LINE_PX * F.col("height_pt") / F.col("render_h") + 1
    chosen = spread_span(chosen, F.col("near_pt") - slack, F.col("near_pt") + slack, WORD_CELL_PT, "band")
    banded = words.withColumn("band", cell((F.col("top_pt") + F.col("bottom_pt")) / 2, WORD_CELL_PT))
    _, upper, lower = _canvas_y()
    around = banded.join(chosen, [*K, "band"]).where(
        F.abs((upper + lower) / 2 - _mid_px(F.col("near_pt"))) < NEAREST_LINE_PX
    )
    lines = _edit_context(around, [*K, "near_pt"])
    return _per_click(clicks, near.select(*keys, "near_pt").join(lines, [*K, "near_pt"]).drop("near_pt"))


def _mid_px(mid_pt: Column) -> Column:
    return F.col("render_h") - mid_pt * F.col("render_h") / F.col("height_pt")


def _nearest_mid(heights: DataFrame, mids: DataFrame) -> DataFrame:
    """``heights`` with ``near_pt``, the nearest word middle; of two as near, that of the earlier word.

    An as-of lookup in both directions over the union of distinct heights and distinct middles: no pairs arise. Rows
    are ordered inside strips of a page; what lies in other strips comes from the order of the strips.
    """
    here = F.col("click_y")
    middle = F.struct("mid_pt", "word_idx")
    y_pt = (F.col("render_h") - here) * F.col("height_pt") / F.col("render_h")
    stacked = mids.select(*K, F.col("mid_pt").alias("at"), middle.alias("m")).unionByName(
        heights.select(*K, y_pt.alias("at"), "click_y", *_SCALE), allowMissingColumns=True
    )
    stacked = stacked.withColumn("strip", F.floor(F.col("at") / STRIP_PT))
    ends = stacked.groupBy(*K, "strip").agg(F.min("m").alias("low"), F.max("m").alias("high"))

    def beside(value: str, order: Column) -> Column:
        w = Window.partitionBy(*K).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.last(value, ignorenulls=True).over(w)

    strips = ends.select(
        *K, "strip", beside("high", F.asc("strip")).alias("under"), beside("low", F.desc("strip")).alias("over")
    )

    def inside(order: Column) -> Column:
        # Growing frames only: the value behind in one order is the value ahead in the other.
        w = Window.partitionBy(*K, "strip").orderBy(order, here.asc_nulls_first())
        return F.last("m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))

    both = stacked.withColumn("below", inside(F.col("at").asc())).withColumn("above", inside(F.col("at").desc()))
    both = both.where(here.isNotNull()).join(strips, [*K, "strip"])

    def rank(m: Column) -> Column:
        d = F.abs(_mid_px(m["mid_pt"]) - here)
        return F.when(m.isNotNull(), F.struct(d.alias("d"), m["word_idx"].alias("i"), m["mid_pt"].alias("mid")))

    best = F.array_min(F.array_compact(F.array(rank(F.coalesce("below", "under")), rank(F.coalesce("above", "over")))))
    return both.select(*K, "click_y", *_SCALE, best["mid"].alias("near_pt")).where(F.col("near_pt").isNotNull())


def edit_target(clicks: DataFrame, words: DataFrame, pages: DataFrame, dims: DataFrame) -> DataFrame:
    """The line to edit for each click: the one it hits, else the nearest."""
    return line_at_point(clicks, words, pages, dims).unionByName(nearest_line(clicks, words, pages, dims))
