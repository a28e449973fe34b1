"""Positioned words out of plain text, so that a text corpus has the shape of a laid-out one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the layout: lines of ten words, forty lines a page, US Letter in points.
WORDS_PER_LINE = 10
WORDS_PER_PAGE = 400
PAGE_W, PAGE_H = 612.0, 792.0
RENDER_W, RENDER_H = 1224, 1584
FONTS = (
    "ABCDEF+Arial", "Arial-BoldItalic", "Times,Bold", "Helvetica-Regular",
    "Georgia-Roman", "A+B+C", "XYZ+-Bold", None,
)


def _tokens(text: Column) -> Column:
    """Words of a text; trimming first leaves no empty token, unless there is nothing else."""
    trimmed = F.btrim(text, F.lit(" \n"))
    return F.when(trimmed != "", F.split(trimmed, "[ \n]+"))


def _placed(g: Column, text: Column) -> dict[str, Column]:
    """What is laid out of the ``g``-th word of a document, beside its keys."""
    left = 36 + (g % WORDS_PER_LINE) * 54
    # The 0-4 pt jitter straddles the tolerance of line grouping on purpose.
    top = 756 - F.floor(g % WORDS_PER_PAGE / WORDS_PER_LINE) * 18 - (g * 7) % 5
    return {
        "text": text,
        "left_pt": left.cast("double"),
        "bottom_pt": (top - 10).cast("double"),
        "right_pt": (left + 5 * F.least(F.length(text), F.lit(10))).cast("double"),
        "top_pt": top.cast("double"),
        "font_size": (8 + g % 5).cast("double"),
        "font_name": F.get(F.array(*[F.lit(f) for f in FONTS]), g % len(FONTS)),
    }


def layout_words(documents: DataFrame) -> DataFrame:
    """One row per word of ``documents(doc_id, text)``; a narrow plan, no shuffle."""
    g = F.col("g")
    return documents.select("doc_id", F.posexplode(_tokens(F.col("text"))).alias("g", "text")).select(
        "doc_id",
        F.floor(g / WORDS_PER_PAGE).cast("int").alias("page_idx"),
        (g % WORDS_PER_PAGE).cast("int").alias("word_idx"),
        *[c.alias(name) for name, c in _placed(g, F.col("text")).items()],
    )


def layout_whole_pages(documents: DataFrame) -> DataFrame:
    """The same words as one row per page, ``words`` being an array in content order; a narrow plan, too.

    The words of a document are cut into pages before there are rows, so no row holds more than a page.
    """
    tokens = F.col("tokens")
    last = F.floor((F.size(tokens) - 1) / WORDS_PER_PAGE).cast("int")

    def page(p: Column) -> Column:
        words = F.slice(tokens, p * WORDS_PER_PAGE + 1, WORDS_PER_PAGE)
        return F.transform(words, lambda w, i: F.struct(*[c.alias(n) for n, c in _placed(p * WORDS_PER_PAGE + i, w).items()]))

    split = documents.select("doc_id", _tokens(F.col("text")).alias("tokens")).where(F.size(tokens) > 0)
    return split.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), last), page)).alias("page_idx", "words"))


def documents_of(documents: DataFrame, rows: DataFrame, others: bool = False) -> DataFrame:
    """The documents that ``rows`` name by ``doc_id``, or all ``others``.

    Clicks, regions and edits lie on some documents. Joined before words arise, texts are shuffled at most (not even
    those, if the ids are few); joined to words, every word of every document would be.
    """
    named = rows.select("doc_id").distinct()
    return documents.join(named, "doc_id", "left_anti" if others else "left_semi")


def layout_pages(documents: DataFrame) -> DataFrame:
    """One row per page, straight from the number of tokens: no word rows, no shuffle."""
    n = F.size(_tokens(F.col("text")))
    return (
        documents.select("doc_id", n.alias("n"))
        .where("n > 0")  # null counts as -1 or as null, by session setting
        .select(
            "doc_id",
            F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / WORDS_PER_PAGE).cast("int"))).alias("page_idx"),
        )
        .select("doc_id", "page_idx", F.lit(PAGE_W).alias("width_pt"), F.lit(PAGE_H).alias("height_pt"))
    )


def layout_dims(pages: DataFrame) -> DataFrame:
    """Rendered size of every laid-out page."""
    return pages.select(
        "doc_id", "page_idx", F.lit(RENDER_W).alias("render_w"), F.lit(RENDER_H).alias("render_h")
    )


def layout_text(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(pages, words)`` of a text corpus."""
    return layout_pages(documents), layout_words(documents)
