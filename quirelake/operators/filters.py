"""What is accepted and what is not: annotations, strokes, edits, queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.functions.text import is_blank, trim_whitespace, utf16_length
from quirelake.schemas import K

#: A highlight must be wider and higher than this, in pixels.
MIN_HIGHLIGHT_PX = 3
#: An ink annotation needs more points than this, a signature stroke more than the second.
MIN_INK_POINTS = 2
MIN_STROKE_POINTS = 1
#: Search-as-you-type waits for this many characters.
MIN_LIVE_QUERY = 2


def accept_annotations(raw: DataFrame) -> DataFrame:
    """Drop specks: tiny highlights, dots of ink, empty texts. Text content is trimmed."""
    kind = F.col("kind")
    content = F.when(kind == "text", trim_whitespace(F.col("content"))).otherwise(F.col("content"))
    keep = (
        F.when(
            kind == "highlight",
            (F.col("rect.w") > MIN_HIGHLIGHT_PX) & (F.col("rect.h") > MIN_HIGHLIGHT_PX),
        )
        .when(kind == "ink", F.size("points") > MIN_INK_POINTS)
        .when(kind == "text", ~is_blank(F.col("content")))
        .otherwise(True)
    )
    return raw.where(keep).withColumn("content", content)


def accept_strokes(signatures: DataFrame) -> DataFrame:
    """Drop one-point strokes, then signatures that have no stroke left."""
    kept = F.filter("strokes", lambda s: F.size(s) > MIN_STROKE_POINTS)
    return signatures.withColumn("strokes", kept).where(F.size("strokes") > 0)


def accept_text_edits(edits: DataFrame) -> DataFrame:
    """Keep edits whose trimmed text is not empty and differs from the untrimmed original."""
    return edits.withColumn("content", trim_whitespace(F.col("content"))).where(
        (F.col("content") != "") & ~F.col("content").eqNullSafe(F.col("original"))
    )


def burnable(annotations: DataFrame, pages: DataFrame, dims: DataFrame) -> DataFrame:
    """Annotations whose page exists and has been rendered."""
    drawable = pages.select(*K).join(dims.select(*K), K, "left_semi")
    return annotations.join(drawable, K, "left_semi")


def search_gate(queries: DataFrame, mode: str = "live") -> DataFrame:
    """Queries worth running. Blank ones never are; ``live`` also wants two characters."""
    if mode not in ("live", "enter"):
        raise ValueError(f"mode is 'live' or 'enter', not {mode!r}")
    kept = queries.where(~is_blank(F.col("q")))
    return kept.where(utf16_length(F.col("q")) >= MIN_LIVE_QUERY) if mode == "live" else kept
