"""Annotation stacks: order, undo, bounds, and the state an event log leaves behind."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions.geometry import points_bounds
from quirelake.plans.blocks import BLOCK_BITS, dense_position, next_marked, running_sum
from quirelake.plans.lineage import cut_lineage
from quirelake.schemas import K

#: Events of a document up to which one task works on it as a whole: as many as a block may hold.
WHOLE = 1 << BLOCK_BITS
#: Rounds over such documents before those that are settled are set aside.
ROUNDS = 3


def undo_last(annotations: DataFrame) -> DataFrame:
    """Remove the latest annotation of each page.

    The anti join is on page *and* ``seq``, so a crowded page spreads over all tasks.
    """
    last = annotations.groupBy(*K).agg(F.max("seq").alias("seq"))
    return annotations.join(last, [*K, "seq"], "left_anti").select(*annotations.columns)


def z_order(annotations: DataFrame) -> DataFrame:
    """Add ``z``, the 0-based drawing order on the page."""
    return dense_position(annotations, K, "seq", "z")


def ink_bounds(annotations: DataFrame) -> DataFrame:
    """Bounds of the ink annotations that have points."""
    ink = annotations.where((F.col("kind") == "ink") & (F.size("points") > 0))
    b = ink.select(*K, "seq", points_bounds(F.col("points")).alias("b"))
    return b.select(*K, "seq", *[F.col(f"b.{c}").alias(c) for c in "xywh"])


def has_annotations(documents: DataFrame, annotations: DataFrame) -> DataFrame:
    """For each document, whether any of its pages holds an annotation."""
    held = annotations.groupBy("doc_id").agg(F.lit(True).alias("has_annotations"))
    return (
        documents.select("doc_id")
        .join(held, "doc_id", "left")
        .withColumn("has_annotations", F.coalesce("has_annotations", F.lit(False)))
    )


def annotation_state(events: DataFrame, whole: int = WHOLE) -> DataFrame:
    """Annotations alive after an event log: ``doc_id, page_idx, seq, annot_id``.

    Events apply per document in ``seq`` order: ``add`` pushes ``annot_id`` on its page's stack,
    ``delete`` removes that id wherever it is, ``undo`` pops the page's stack (an empty one stays
    empty), ``clear`` empties the page, ``reload`` the document. ``seq`` is unique in a document,
    and so is the ``annot_id`` of an add.

    No log is folded event by event. Reloads and clears reduce to a greatest ``seq``. Undos pair
    with adds like closing with opening brackets: give each the depth of the stack (a running sum
    of +1 and -1), and an undo takes the nearest earlier add of its own depth. A deletion that
    finds its annotation alive is the same as if the annotation had never been added, as no undo
    before it got that deep; one that comes after the undo is void. Which of the two holds depends
    only on later adds, so starting with every deletion in force and re-deciding them
    all settles after a few rounds, on a unique answer.

    Documents of up to ``whole`` events are dealt out once and stay where they are, windows and rounds included. Larger
    ones take joins and blocks, so that they spread over all tasks; both give the same.
    """
    # At most one document per ``whole`` events.
    crowded = cut_lineage(events.groupBy("doc_id").count().where(F.col("count") > whole).select(F.col("doc_id").alias("__doc")))
    if crowded.isEmpty():
        return _settled(_log_of_whole(events), None)
    # Null-safe, so that events of no document are on one side as well.
    same = F.col("doc_id").eqNullSafe(F.col("__doc"))
    small, large = (events.join(F.broadcast(crowded), same, how) for how in ("left_anti", "left_semi"))
    return _settled(_log_of_whole(small), None).unionByName(_settled(_log(large), BLOCK_BITS))


def _log_of_whole(events: DataFrame) -> DataFrame:
    """What ``_log`` gives, by windows over whole documents."""
    seq, op = F.col("seq"), F.col("op")
    later = Window.partitionBy("doc_id", "annot_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)

    def greatest(name: str, *keys: str) -> Column:
        known = functools.reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
        return F.when(known, F.max(F.when(op == name, seq)).over(Window.partitionBy(*keys)))

    known = F.col("doc_id").isNotNull() & F.col("annot_id").isNotNull() & (op == "add")
    return (
        events.repartition("doc_id")
        .withColumn("__clear", greatest("clear", *K))
        .withColumn("__reload", greatest("reload", "doc_id"))
        .where(op.isin("add", "undo", "delete") & (F.col("__reload").isNull() | (seq > F.col("__reload"))))
        # The first deletion after the add; repeats of it are void.
        .withColumn("del_seq", F.when(known, F.last(F.when(op == "delete", seq), ignorenulls=True).over(later)))
        .where((op != "delete") & (F.col("__clear").isNull() | (seq > F.col("__clear"))))
        .select(*K, "seq", "op", "annot_id", "del_seq", F.col("del_seq").isNotNull().alias("removed"))
    )


def _log(events: DataFrame) -> DataFrame:
    """Adds and undos that no reload or clear takes, with the deletion of each add, which at first is in force."""
    seq = F.col("seq")
    reloads = events.where(F.col("op") == "reload").groupBy("doc_id").agg(F.max("seq").alias("__reload"))
    clears = events.where(F.col("op") == "clear").groupBy(*K).agg(F.max("seq").alias("__clear"))
    current = (
        events.where(F.col("op").isin("add", "undo"))
        .join(reloads, "doc_id", "left")
        .join(clears, K, "left")
        .withColumn("__from", F.greatest("__reload", "__clear"))
        .where(F.col("__from").isNull() | (seq > F.col("__from")))
        .select(*K, "seq", "op", "annot_id")
    )
    adds = current.where(F.col("op") == "add")
    deletes = events.where((F.col("op") == "delete") & F.col("annot_id").isNotNull()).select(
        "doc_id", "annot_id", F.col("seq").alias("__del")
    )
    # The first deletion after the add; repeats of it are void.
    ends = (
        adds.select("doc_id", "annot_id", "seq")
        .join(deletes, ["doc_id", "annot_id"])
        .where(F.col("__del") > seq)
        .groupBy("doc_id", "seq")
        .agg(F.min("__del").alias("del_seq"))
    )
    return (
        current.join(ends, ["doc_id", "seq"], "left")
        .select(*K, "seq", "op", "annot_id", "del_seq")
        .withColumn("removed", F.col("del_seq").isNotNull())
    )


def _settled(log: DataFrame, bits: int | None) -> DataFrame:
    """Decide deletions until none changes; what is alive then."""
    # Without blocks a round is cheap and needs no shuffle, so several go before a look at what is left.
    at_once = 1 if bits else ROUNDS
    alive = (F.col("op") == "add") & ~F.col("removed") & F.col("undo_seq").isNull()
    if bits:
        log = cut_lineage(log)
    settled, limit = None, None
    while limit is None or limit > 0:
        decided = log
        for _ in range(at_once):
            decided = _decide(decided.select(*K, "seq", "op", "annot_id", "del_seq", "removed"), bits)
        decided = cut_lineage(decided)
        if limit is None:
            # Each round settles the latest open deletion of every page at least.
            limit = decided.where(F.col("del_seq").isNotNull()).count() + 1
        limit -= at_once
        moved = decided.where("flipped").select(*K).distinct()
        if decided.where("flipped").isEmpty():
            calm, log = decided, None
        else:
            # A page whose deletions all stand as assumed is finished; the others go on.
            calm, log = decided.join(moved, K, "left_anti"), decided.join(moved, K, "left_semi")
        calm = calm.where(alive).select(*K, "seq", "annot_id")
        settled = calm if settled is None else settled.unionByName(calm)
        if log is None:
            return settled
    raise ValueError("seq is not unique in a document")


def _decide(log: DataFrame, bits: int | None) -> DataFrame:
    """Pair undos with adds, given which adds are ``removed``, and decide all deletions anew.

    A removed add has no weight in the depths, but is still told which undo would take it.
    """
    add, undo = F.col("op") == "add", F.col("op") == "undo"
    step = F.when(undo, -1).when(add & ~F.col("removed"), 1).otherwise(0)
    depth = running_sum(log, K, "seq", step, "depth", bits)
    # Depth an add leaves behind and depth an undo finds: the undo that takes an add is the next
    # one to find the depth of the add, and for a removed add, the one that would reach below it.
    own = F.when(undo, F.col("depth") + 1).otherwise(F.col("depth"))
    levelled = depth.withColumn("level", own)
    paired = next_marked(levelled, [*K, "level"], "seq", undo, "undo_seq", bits)
    removed = F.coalesce(
        F.col("del_seq").isNotNull() & (F.col("undo_seq").isNull() | (F.col("undo_seq") > F.col("del_seq"))),
        F.lit(False),
    ) & add
    return (
        paired.withColumn("now", removed)
        .withColumn("flipped", F.col("now") != F.col("removed"))
        .withColumn("removed", F.col("now"))
        .drop("now", "depth", "level")
    )
