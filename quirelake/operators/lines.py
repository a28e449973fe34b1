"""Reading order, line grouping, and the text of regions and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions.text import is_blank
from quirelake.plans.blocks import BLOCK_BITS
from quirelake.schemas import K

#: A word belongs to a line when its top is at most this far from the line's first word's.
LINE_TOLERANCE_PT = 3.0
#: Words of a group are ordered within strips of this height (or width), and the strips among themselves.
STRIP_PT = 4.0
#: Lines are worked out in blocks of this height, and at least so many tolerances.
BLOCK_PT, BLOCK_TOLERANCES = 48.0, 16
_STRIP = "__strip"
_BLOCK = "__block"


def reading_key() -> Column:
    """Sort key of reading order: top descending, then left, then content order."""
    return F.struct((-F.col("top_pt")).alias("up"), F.col("left_pt").alias("left"), F.col("word_idx"))


def join_text(key: Column, text: Column, sep: str) -> Column:
    """Aggregate: the texts of a group in the order of ``key``."""
    ordered = F.sort_array(F.collect_list(F.struct(key.alias("k"), text.alias("t"))))
    return F.array_join(ordered["t"], sep)


# --- anchored lines -----------------------------------------------------------------------------
#
# A block of tops maps the anchor that enters it from above to the anchor that leaves it below. That map depends
# only on the first top that is too far below the entering anchor, which lies near the upper edge of the block, so it
# is a short list of (first start, last start, number of starts). Maps are composed down the blocks of a group; then
# every block knows its entering anchor and is filled in by itself.


def _line_block(tolerance: float) -> tuple[Column, float]:
    height = max(BLOCK_TOLERANCES * tolerance, BLOCK_PT)
    return F.floor(F.col("top_pt") / height), height


def _scan(tops: Column, enter: Column, n: Column, tolerance: float) -> Column:
    """Anchor and number of starts after descending ``tops``, entered with an anchor and a number."""
    return F.aggregate(
        tops,
        F.struct(enter.alias("at"), n.alias("n")),
        lambda acc, t: F.when(
            acc["at"].isNull() | (acc["at"] - t > tolerance), F.struct(t.alias("at"), (acc["n"] + 1).alias("n"))
        ).otherwise(acc),
    )


def _entered(blocks: DataFrame, keys: list[str], height: float, tolerance: float) -> DataFrame:
    """Entering anchor and number of lines before it for every row of ``blocks`` (keys, block, descending ``tops``)."""
    # Starts an entering anchor can lead to: tops as near to the upper edge as the tolerance (with slack), and the next.
    edge = (F.col(_BLOCK) + 1) * height - tolerance - 1e-6
    firsts = F.slice("tops", F.lit(1), F.size(F.filter("tops", lambda t: t >= edge)) + 1)
    one = F.lit(1).cast("long")
    maps = F.transform(firsts, lambda s: F.struct(s.alias("start"), _scan(F.col("tops"), s, one, tolerance).alias("last")))
    whole = blocks.select(*keys, _BLOCK, maps.alias("maps")).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(_BLOCK, "maps")), asc=False).alias("blocks")
    )
    none = F.array().cast("array<struct<block:bigint,enter:double,before:bigint>>")

    def through(acc: Column, b: Column) -> Column:
        taken = F.get(F.filter(b["maps"], lambda m: acc["at"].isNull() | (acc["at"] - m["start"] > tolerance)), F.lit(0))
        here = F.struct(b[_BLOCK].alias("block"), acc["at"].alias("enter"), acc["n"].alias("before"))
        return F.struct(
            F.coalesce(taken["last"]["at"], acc["at"]).alias("at"),
            (acc["n"] + F.coalesce(taken["last"]["n"], F.lit(0).cast("long"))).alias("n"),
            F.concat(acc["out"], F.array(here)).alias("out"),
        )

    start = F.struct(F.lit(None).cast("double").alias("at"), F.lit(0).cast("long").alias("n"), none.alias("out"))
    return whole.select(*keys, F.explode(F.aggregate("blocks", start, through)["out"]).alias("o")).select(
        *keys, F.col("o.block").alias(_BLOCK), "o.enter", "o.before"
    )


def _starts(tops: Column, enter: Column, tolerance: float) -> Column:
    """The starts of lines among descending ``tops``, entered with an anchor."""
    empty = F.struct(enter.alias("at"), F.array().cast("array<double>").alias("found"))
    return F.aggregate(
        tops,
        empty,
        lambda acc, t: F.when(
            acc["at"].isNull() | (acc["at"] - t > tolerance),
            F.struct(t.alias("at"), F.concat(acc["found"], F.array(t)).alias("found")),
        ).otherwise(acc),
        lambda acc: acc["found"],
    )


def group_lines(words: DataFrame, keys: list[str] = K, tolerance: float = LINE_TOLERANCE_PT) -> DataFrame:
    """Add ``line_no``, counted from the top, to the words of each group.

    A line is anchored at its first word in reading order, and the anchor does not follow later words. Only the
    distinct tops of a block meet in one task, and of a group only what its blocks map anchors to, so a
    group of any height spreads over tasks.
    """
    block, height = _line_block(tolerance)
    blocks = words.groupBy(*keys, block.alias(_BLOCK)).agg(F.sort_array(F.collect_set("top_pt"), asc=False).alias("tops"))
    entered = _entered(blocks, keys, height, tolerance)
    lines = blocks.join(entered, [*keys, _BLOCK]).select(
        *keys, _BLOCK, "before", _starts(F.col("tops"), F.col("enter"), tolerance).alias("starts")
    )
    passed = F.size(F.filter("starts", lambda a: a >= F.col("top_pt")))
    return (
        words.withColumn(_BLOCK, block).join(lines, [*keys, _BLOCK])
        .withColumn("line_no", (F.col("before") + passed - 1).cast("int"))
        .drop(_BLOCK, "before", "starts")
    )


def line_text(lined: DataFrame, keys: list[str] = K) -> DataFrame:
    """One row per line: its words in reading order, joined by a space."""
    return lined.groupBy(*keys, "line_no").agg(
        join_text(reading_key(), F.col("text"), " ").alias("text"), F.count("*").alias("n_words")
    )


def line_bounds(lined: DataFrame, keys: list[str] = K) -> DataFrame:
    """Bounds of each line in points."""
    b = lined.groupBy(*keys, "line_no").agg(
        F.min("left_pt").alias("left_pt"), F.min("bottom_pt").alias("bottom_pt"),
        F.max("right_pt").alias("right_pt"), F.max("top_pt").alias("top_pt"),
    )
    return b.withColumn("width_pt", F.col("right_pt") - F.col("left_pt")).withColumn(
        "height_pt", F.col("top_pt") - F.col("bottom_pt")
    )


def region_text(words_in_regions: DataFrame, tolerance: float = LINE_TOLERANCE_PT) -> DataFrame:
    """Text of each region, lines joined by newlines, and its number of words.

    Reading order runs through the blocks of a region from top to bottom and a line ends where the next starts, so
    each block becomes a piece of text once its entering anchor is known, and words are dealt out only once.
    """
    block, height = _line_block(tolerance)
    word = F.struct((-F.col("top_pt")).alias("up"), F.col("left_pt").alias("left"), "word_idx", "text")
    blocks = (
        words_in_regions.where(F.col("top_pt").isNotNull()).groupBy("region_id", block.alias(_BLOCK))
        .agg(F.sort_array(F.collect_list(word)).alias("ws"))
        .select("region_id", _BLOCK, "ws", F.array_distinct(F.transform("ws", lambda w: -w["up"])).alias("tops"))
    )
    entered = _entered(blocks, ["region_id"], height, tolerance)
    starts = _starts(F.col("tops"), F.col("enter"), tolerance)
    pieces = blocks.join(entered, ["region_id", _BLOCK]).select("region_id", _BLOCK, "ws", starts.alias("starts"))
    # A line: the words from its start up to the next; before the first start the line from above goes on.
    bounds = F.concat(F.array(F.lit(None).cast("double")), F.col("starts"))
    lines = F.transform(
        bounds,
        lambda a, i: F.array_join(F.transform(F.filter(
            "ws",
            lambda w: (a.isNull() | (-w["up"] <= a))
            & F.coalesce(-w["up"] > F.get(F.col("starts"), i), F.lit(True)),
        ), lambda w: w["text"]), " "),
    )
    text = F.when(
        F.get(F.col("starts"), F.lit(0)) == -F.col("ws")[0]["up"],
        F.concat(F.lit("\n"), F.array_join(F.slice("lines", 2, F.size("lines")), "\n")),
    ).otherwise(F.concat(F.lit(" "), F.array_join("lines", "\n")))
    texts = pieces.withColumn("lines", F.explode(F.array(lines))).select(
        "region_id", (-F.col(_BLOCK)).alias("place"), text.alias("text"), F.size("ws").cast("long").alias("n")
    )
    whole = texts.groupBy("region_id").agg(join_text(F.col("place"), F.col("text"), "").alias("text"), F.sum("n").alias("n_words"))
    return whole.select("region_id", F.substring("text", 2, 2**31 - 1).alias("text"), "n_words")


def page_text(words: DataFrame) -> DataFrame:
    """All words of a page in content order, joined by a space; blank pages give no row.

    Blocks of a page are sorted and joined in parallel first, so only their strings meet.
    """
    blocks = words.groupBy(*K, F.shiftright("word_idx", BLOCK_BITS).alias("block")).agg(
        join_text(F.col("word_idx"), F.col("text"), " ").alias("text")
    )
    whole = blocks.groupBy(*K).agg(join_text(F.col("block"), F.col("text"), " ").alias("text"))
    return whole.where(~is_blank(F.col("text")))


def _position(words: DataFrame, keys: list[str], level: str, down: bool, ties: list[str], out: str) -> DataFrame:
    """Add the 0-based place of each word by ``level``, then by ``ties``, within its group.

    Words are dealt out by strips, once: ranks and the words of a strip both come from that. Only the numbers
    of words per strip are summed over a group.
    """
    order = F.desc if down else F.asc
    strips = words.withColumn(_STRIP, F.floor(F.col(level) / STRIP_PT)).where(F.col(level).isNotNull())
    ranked = strips.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, _STRIP).orderBy(order(level), *ties)))
    before = Window.partitionBy(*keys).orderBy(order(_STRIP)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranked.groupBy(*keys, _STRIP).agg(F.max("rank").cast("long").alias("n"))
        .select(*keys, _STRIP, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    return (
        ranked.join(offsets, [*keys, _STRIP])
        .withColumn(out, F.col("before") + F.col("rank") - 1)
        .drop("before", "rank", _STRIP)
    )


def reading_order(words: DataFrame, keys: list[str] = K) -> DataFrame:
    """Add ``read_pos``, the place in reading order: top down, then from the left."""
    return _position(words, keys, "top_pt", True, ["left_pt", "word_idx"], "read_pos")


def left_to_right(lined: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``line_pos``, the place from the left in each line, whatever the height."""
    return _position(lined, keys, "left_pt", False, ["word_idx"], "line_pos")
