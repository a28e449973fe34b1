"""Logs of page edits: any number of deletions, moves and appended documents per document, in turn.

An edit is a map from positions after it to positions before it, made of a few shifted ranges
(pieces). A log is composed without replaying it in one task:

1. Edits are numbered per document and gathered into blocks of ``BLOCK`` edits.
2. Whether an edit applies hangs on the page count ``n`` at its time. What a block does to ``n`` is
   ``n + shift - (number of steps <= n)``, one step per deletion, so only these few numbers of each
   block are chained through a document.
3. With the count before it known, a block is replayed on a piece table by itself.
4. Blocks next to each other are composed, pair by pair, in as many levels as the longest log needs.
   Two maps meet in tiles of the positions between them, where their ends cut each other; a tile
   holds at most ``2 ** TILE_BITS`` pieces of either.
5. Pages look up the piece they lie in, tile by tile.

Input positions of a document are its own pages followed by those of each appended document, so
appended pages are pieces like any other.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.operators.pages import page_counts
from quirelake.plans.blocks import dense_position, running_sum
from quirelake.plans.lineage import cut_lineage

BLOCK = 256
TILE_BITS = 16
#: Levels of composition between two lineage cuts.
LEVELS = 4
#: Blocks that are Python objects at a time; an Arrow batch may hold ten thousand.
AT_ONCE = 32
OPS = ("delete", "up", "down", "reorder", "append")

_EDIT = ("seq", "op", "at", "to", "start", "size")
_SUMMARY = "doc_id long, block long, shift long, steps array<long>"
_COUNTED = "doc_id long, block long, n long"
_PIECES = "doc_id long, block long, blocks long, out long, len long, src long, own boolean"


def _ordered(edits: list[dict]) -> list[dict]:
    return sorted(edits, key=lambda e: e["seq"])


def _steps(edits: list[dict]) -> tuple[int, list[int]]:
    """What edits do to a page count ``n``: ``n + shift - (number of steps <= n)``."""
    shift, steps = 0, []
    for e in _ordered(edits):
        if e["op"] == "append":
            shift += e["size"]
        elif e["op"] == "delete" and e["at"] is not None and e["at"] >= 0:
            # The least count that leaves more than ``at`` pages at this time.
            least = e["at"] + 1 - shift
            least += bisect_right(range(len(steps)), least, key=lambda i: steps[i] - i)
            if least <= 0:
                shift -= 1
            else:
                insort(steps, least)
    return shift, steps


def _cut(pieces: list[tuple], at: int) -> int:
    """Index of the piece that starts at position ``at``, after a split if none does."""
    for i, (src, length, own) in enumerate(pieces):
        if at <= 0:
            return i
        if at < length:
            pieces[i : i + 1] = [(src, at, own), (src + at, length - at, own)]
            return i + 1
        at -= length
    return len(pieces)


def _taken(pieces: list[tuple], at: int) -> list[tuple]:
    """Take the page at position ``at`` out."""
    i, j = _cut(pieces, at), _cut(pieces, at + 1)
    out = pieces[i:j]
    del pieces[i:j]
    return out


def _replay(edits: list[dict], n: int) -> list[tuple]:
    """Pieces ``(src, len, own)`` after edits of ``n`` pages; ``own`` ones count positions before the edits."""
    pieces = [(0, n, True)] if n else []
    for e in _ordered(edits):
        op, at, to = e["op"], e["at"], e["to"]
        if op == "append":
            if e["size"]:
                pieces.append((e["start"], e["size"], False))
                n += e["size"]
            continue
        if at is None or not 0 <= at < n:
            continue
        if op == "delete":
            _taken(pieces, at)
            n -= 1
            continue
        to = at - 1 if op == "up" else at + 1 if op == "down" else to
        if to is None or to == at or not 0 <= to < n:
            continue
        page = _taken(pieces, at)
        i = _cut(pieces, to - 1 if op == "reorder" and to > at else to)
        pieces[i:i] = page
    return pieces


def _batch(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of the batches, ``AT_ONCE`` at a time: an edit takes some ten times as much room in Python as in Arrow."""
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(at, AT_ONCE).to_pylist()


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for few in _few(batches):
        rows = [(r["doc_id"], r["block"], *_steps(r["edits"])) for r in few]
        yield _batch(["doc_id", "block", "shift", "steps"], [pa.int64()] * 3 + [pa.list_(pa.int64())], rows)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Page counts before blocks, which come sorted by document and block."""
    doc, n = None, 0
    for few in _few(batches):
        rows = []
        for r in few:
            if r["doc_id"] != doc:
                doc, n = r["doc_id"], r["n0"]
            rows.append((doc, r["block"], n))
            n += r["shift"] - bisect_right(r["steps"], n)
        yield _batch(["doc_id", "block", "n"], [pa.int64()] * 3, rows)


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "block", "blocks", "out", "len", "src", "own"]
    for few in _few(batches):
        rows = []
        for r in few:
            out = 0
            for src, length, own in _replay(r["edits"], r["n"]):
                rows.append((r["doc_id"], r["block"], r["blocks"], out, length, src, own))
                out += length
        yield _batch(names, [pa.int64()] * 6 + [pa.bool_()], rows)


def _tiled(df: DataFrame, position: str, tile_bits: int) -> DataFrame:
    """Cut pieces where the range of ``len`` positions from ``position`` on crosses the border of a tile."""
    p = F.col(position)
    last = F.shiftright(p + F.col("len") - 1, tile_bits)
    cut = df.withColumn("tile", F.explode(F.sequence(F.shiftright(p, tile_bits), last)))
    skip = F.greatest(F.shiftleft(F.col("tile"), tile_bits) - p, F.lit(0))
    end = F.least(p + F.col("len"), F.shiftleft(F.col("tile") + 1, tile_bits))
    return cut.withColumn("__skip", skip).withColumn("__len", end - p - skip).select(
        *[F.col("__len").alias(c) if c == "len" else (F.col(c) + F.col("__skip")).alias(c) if c in ("out", "src", "p") else F.col(c)
          for c in cut.columns]
    )


def _paired(pieces: DataFrame, tile_bits: int) -> DataFrame:
    """Compose each even block with the odd one behind it."""
    late = F.col("block") % 2 == 1
    alone = (~late & (F.col("block") + 1 >= F.col("blocks"))) | (late & ~F.col("own"))
    # Middle positions: where an earlier block's pieces lie after it, and what a later block's own pieces count.
    rows = pieces.withColumn("alone", alone).withColumn("p", F.when(late & ~alone, F.col("src")).otherwise(F.col("out")))
    rows = _tiled(rows, "p", tile_bits)
    first = F.struct("p", "src", "own")
    then = F.struct("p", "out", "len")
    tile = Window.partitionBy("doc_id", F.shiftright("block", 1), "alone", "tile").orderBy("p", "block")
    seen = tile.rowsBetween(Window.unboundedPreceding, 0)
    cut = rows.select(
        "doc_id", F.shiftright("block", 1).alias("block"), F.shiftright(F.col("blocks") + 1, 1).alias("blocks"),
        "alone", "p", "out", "len", "src", "own",
        F.last(F.when(~late, first), ignorenulls=True).over(seen).alias("a"),
        F.last(F.when(late, then), ignorenulls=True).over(seen).alias("b"),
        F.lead("p").over(tile).alias("next"),
    )
    end = F.least(F.col("next"), F.col("b.p") + F.col("b.len"))
    met = cut.withColumn("__len", F.when(F.col("alone"), F.col("len")).otherwise(end - F.col("p")))
    met = met.where("__len > 0 and (alone or b is not null)")

    def either(alone: str, composed) -> F.Column:
        return F.when(F.col("alone"), F.col(alone)).otherwise(composed).alias(alone)

    return met.select(
        "doc_id", "block", "blocks",
        either("out", F.col("b.out") + F.col("p") - F.col("b.p")), F.col("__len").alias("len"),
        either("src", F.col("a.src") + F.col("p") - F.col("a.p")), either("own", F.col("a.own")),
    )


def _pieces(edits: DataFrame, block: int, tile_bits: int) -> DataFrame:
    """Pieces of all documents in ``edits``, whose rows carry ``n0``, ``start`` and ``size``."""
    numbered = dense_position(edits, ["doc_id"], "seq", "nth").withColumn("block", F.floor(F.col("nth") / block))
    blocks = numbered.groupBy("doc_id", "block").agg(
        F.collect_list(F.struct(*_EDIT)).alias("edits"), F.max("n0").alias("n0")
    )
    summed = blocks.select("doc_id", "block", "edits").mapInArrow(_summaries, _SUMMARY)
    starts = edits.groupBy("doc_id").agg(F.max("n0").alias("n0"), F.count("*").alias("edits"))
    starts = starts.select("doc_id", "n0", F.ceil(F.col("edits") / block).alias("blocks"))
    chained = (
        summed.join(starts, "doc_id").repartition("doc_id").sortWithinPartitions("doc_id", "block")
        .mapInArrow(_chain, _COUNTED)
    )
    ready = blocks.drop("n0").join(chained, ["doc_id", "block"]).join(starts.drop("n0"), "doc_id")
    pieces = ready.select("doc_id", "block", "blocks", "edits", "n").mapInArrow(_replayed, _PIECES)
    most = starts.agg(F.max("blocks")).first()[0] or 1
    for level in range(1, (int(most) - 1).bit_length() + 1):
        pieces = _paired(pieces, tile_bits)
        if level % LEVELS == 0:
            pieces = cut_lineage(pieces)
    return pieces.select("doc_id", "out", "len", "src")


def edit_pages(
    pages: DataFrame, edits: DataFrame, block: int = BLOCK, tile_bits: int = TILE_BITS
) -> DataFrame:
    """Apply ``edits(doc_id, seq, op, at, to, other_id)`` to each document, by ``seq``.

    Positions are those at the time of the edit, from 0. ``delete`` takes page ``at`` out, ``up`` and ``down``
    swap it with its neighbour, ``reorder`` takes it out and puts it before page ``to`` (as ``reorder_page``
    does, so never last), ``append`` adds all pages of ``other_id`` as they are in ``pages``, whatever edits
    that document has itself. An edit that names a position the document has not got then, null or negative
    ones included, an unknown ``op`` and an unknown ``other_id`` do nothing; edits without ``doc_id`` or
    ``seq`` are none. ``seq`` is an integer, unique within a document. A document may end up with no pages, and
    one that only occurs in ``edits`` may get some.

    Returns pages at their new place with ``source_doc_id`` and ``source_page_idx``; other columns come
    from the source page.
    """
    counts = page_counts(pages)
    known = edits.where("doc_id is not null and seq is not null").select(
        F.col("doc_id").cast("long"), F.col("seq").cast("long"), "op", F.col("at").cast("long"),
        F.col("to").cast("long"), F.when(F.col("op") == "append", F.col("other_id")).alias("other_id"),
    )
    sizes = counts.select(F.col("doc_id").alias("other_id"), F.col("n_pages").alias("size"))
    # Only appending edits meet on ``other_id``; the nulls of all others would share a task.
    appends = F.col("op").eqNullSafe("append") & F.col("other_id").isNotNull()
    sized = known.where(appends).join(sizes, "other_id", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    sized = sized.unionByName(known.where(~appends).withColumn("size", F.lit(0)))
    sized = sized.join(counts.withColumnRenamed("n_pages", "n0"), "doc_id", "left").withColumn("n0", F.coalesce("n0", F.lit(0)))
    ends = running_sum(sized, ["doc_id"], "seq", F.col("size"), "end")
    placed = ends.withColumn("start", F.col("n0") + F.col("end") - F.col("size")).drop("end")

    unedited = counts.join(known.select("doc_id").distinct(), "doc_id", "left_anti").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("out"), F.col("n_pages").alias("len"),
        F.lit(0).cast("long").alias("src"),
    )
    pieces = _tiled(_pieces(placed, block, tile_bits).unionByName(unedited), "src", tile_bits)

    kept = F.struct(*[c for c in pages.columns if c not in ("doc_id", "page_idx")], F.col("doc_id").alias("source_doc_id"),
                    F.col("page_idx").alias("source_page_idx")).alias("page")
    source = pages.select(kept)
    own = source.select(F.col("page.source_doc_id").cast("long").alias("doc_id"), F.col("page.source_page_idx").cast("long").alias("src"), "page")
    appended = placed.where("size > 0").select("doc_id", "start", F.col("other_id").alias("__other"))
    added = source.join(appended, F.col("page.source_doc_id") == F.col("__other")).select(
        "doc_id", (F.col("start") + F.col("page.source_page_idx")).alias("src"), "page"
    )
    line = own.unionByName(added).withColumn("tile", F.shiftright("src", tile_bits))
    both = line.unionByName(
        pieces.select("doc_id", "tile", "src", F.struct("src", "out", "len").alias("piece")), allowMissingColumns=True
    )
    tile = Window.partitionBy("doc_id", "tile").orderBy("src", F.col("piece").isNull())
    seen = tile.rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("piece", F.last("piece", ignorenulls=True).over(seen)).where(
        "page is not null and src < piece.src + piece.len"
    )
    new_idx = (F.col("piece.out") + F.col("src") - F.col("piece.src")).cast("int")
    values = {"doc_id": F.col("doc_id"), "page_idx": new_idx}
    return found.select(
        *[values.get(c, F.col(f"page.{c}")).alias(c) for c in pages.columns],
        F.col("page.source_doc_id").alias("source_doc_id"), F.col("page.source_page_idx").alias("source_page_idx"),
    )
