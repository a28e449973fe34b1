"""Page algebra: merge, extract, delete, move, reorder; page counts and raster sizes.

Operators return pages at their new place plus ``source_doc_id`` and ``source_page_idx``, so
that ``apply_page_map`` can move words (or anything else keyed by page) the same way.
Pages of a document are numbered 0 to n-1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.plans.blocks import dense_position, running_sum
from quirelake.schemas import K

RASTER_DPI = 150
POINTS_PER_INCH = 72.0


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))


def merged_page_counts(pages: DataFrame, order: DataFrame) -> DataFrame:
    """Pages per merge target."""
    return (
        page_counts(pages)
        .join(order.select("doc_id", "target_id"), "doc_id")
        .groupBy(F.col("target_id").alias("doc_id"))
        .agg(F.sum("n_pages").alias("n_pages"))
    )


def raster_dims(pages: DataFrame, dpi: int = RASTER_DPI) -> DataFrame:
    """Largest page of each document in whole pixels, at least 1 x 1."""

    def largest(size: str) -> Column:
        # Casting to int truncates towards zero.
        return F.greatest(F.lit(1), F.max((F.col(size) * dpi / POINTS_PER_INCH).cast("int")))

    return pages.groupBy("doc_id").agg(
        largest("width_pt").alias("raster_w"), largest("height_pt").alias("raster_h")
    )


def _with_source(pages: DataFrame) -> DataFrame:
    return pages.withColumn("source_doc_id", F.col("doc_id")).withColumn("source_page_idx", F.col("page_idx"))


def apply_page_map(table: DataFrame, moved: DataFrame) -> DataFrame:
    """Carry a table keyed by page to where its pages went; rows of dropped pages go."""
    page_map = moved.select(
        F.col("source_doc_id").alias("doc_id"),
        F.col("source_page_idx").alias("page_idx"),
        F.col("doc_id").alias("__doc_id"),
        F.col("page_idx").alias("__page_idx"),
    )
    joined = table.join(page_map, K)
    return joined.select(
        *[F.col(f"__{c}").alias(c) if c in K else F.col(c) for c in table.columns]
    )


def merge_documents(pages: DataFrame, order: DataFrame) -> DataFrame:
    """Append the pages of each ``order(doc_id, target_id, ord)`` to its target, by ``ord``.

    ``ord`` is an integer, unique within a target. Offsets come from page counts per document,
    so pages themselves are joined once and never sorted.
    """
    listed = order.select("doc_id", "target_id", "ord").join(page_counts(pages), "doc_id")
    ends = running_sum(listed, ["target_id"], "ord", F.col("n_pages"), "__end")
    offsets = ends.select("doc_id", "target_id", (F.col("__end") - F.col("n_pages")).alias("__offset"))
    return (
        _with_source(pages)
        .join(offsets, "doc_id")
        .withColumn("doc_id", F.col("target_id"))
        .withColumn("page_idx", (F.col("page_idx") + F.col("__offset")).cast("int"))
        .drop("target_id", "__offset")
    )


def _renumber(pages: DataFrame) -> DataFrame:
    ranked = dense_position(_with_source(pages), ["doc_id"], "page_idx", "__new")
    return ranked.withColumn("page_idx", F.col("__new").cast("int")).drop("__new")


def extract_pages(pages: DataFrame, selection: DataFrame) -> DataFrame:
    """The selected pages, in ascending order, renumbered from 0."""
    return _renumber(pages.join(selection.select(*K), K, "left_semi"))


def delete_pages(pages: DataFrame, selection: DataFrame) -> DataFrame:
    """The pages not selected, renumbered from 0; a document may end up with none."""
    return _renumber(pages.join(selection.select(*K), K, "left_anti"))


def _remap(pages: DataFrame, moves: DataFrame, new_idx: Column) -> DataFrame:
    """Join one move per document to its pages and renumber; documents without a move stay."""
    joined = _with_source(pages).join(moves, "doc_id", "left")
    extra = [c for c in moves.columns if c != "doc_id"]
    return joined.withColumn("page_idx", F.coalesce(new_idx, F.col("page_idx")).cast("int")).drop(*extra)


def move_page(pages: DataFrame, moves: DataFrame, direction: str) -> DataFrame:
    """Swap the page in ``moves(doc_id, page_idx)`` with its neighbour; no-op at either end.

    At most one move per document.
    """
    if direction not in ("up", "down"):
        raise ValueError(f"direction is 'up' or 'down', not {direction!r}")
    n = page_counts(pages)
    wanted = moves.select("doc_id", F.col("page_idx").alias("__at")).join(n, "doc_id")
    step = -1 if direction == "up" else 1
    at, other = F.col("__at"), F.col("__at") + step
    valid = at.between(0, F.col("n_pages") - 1) & other.between(0, F.col("n_pages") - 1)
    wanted = wanted.where(valid).drop("n_pages")
    p = F.col("page_idx")
    return _remap(pages, wanted, F.when(p == at, other).when(p == other, at))


def reorder_page(pages: DataFrame, moves: DataFrame) -> DataFrame:
    """Take out page ``from_idx`` of ``moves(doc_id, from_idx, to_idx)`` and put it before ``to_idx``.

    At most one move per document. Both are positions before the move, so a move down lands
    one lower than ``to_idx`` and a page can never become the last one this way.
    """
    n = page_counts(pages)
    src, dst = F.col("__from"), F.col("__to")
    wanted = (
        moves.select("doc_id", F.col("from_idx").alias("__from"), F.col("to_idx").alias("__to"))
        .join(n, "doc_id")
        .where((src != dst) & src.between(0, F.col("n_pages") - 1) & dst.between(0, F.col("n_pages") - 1))
        .select("doc_id", "__from", F.when(dst > src, dst - 1).otherwise(dst).alias("__to"))
    )
    p = F.col("page_idx")
    new_idx = (
        F.when(p == src, dst)
        .when((p > src) & (p <= dst), p - 1)
        .when((p >= dst) & (p < src), p + 1)
    )
    return _remap(pages, wanted, new_idx)


def invalidate_annotations(annotations: DataFrame, changed: DataFrame) -> DataFrame:
    """Annotations of documents whose pages were not restructured."""
    return annotations.join(changed.select("doc_id").distinct(), "doc_id", "left_anti")
