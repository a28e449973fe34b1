"""The annotation stack as a stream: event log in, the live annotations and what changed out.

Every micro-batch is worked on by the batch operator: what is alive counts as additions before the new events, so no
event is folded by hand, nothing runs in Python, and the work splits by document, or where one is large by page, as in a batch.

The state is a log by buckets of documents. A batch reads the buckets that its documents lie in and appends to them what
it changed; a bucket that has gathered ``COMPACT`` such parts is rewritten whole as part of the next batch that touches it.
A manifest per batch says which parts make up a bucket, and is published last by one rename: a batch that is cut short at any
step leaves the state as it was, one that is replayed after its manifest is out does nothing.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirelake.operators.annotations import annotation_state
from quirelake.plans import snapshots
from quirelake.plans.lineage import cut_lineage, filesystem
from quirelake.schemas import K

BUCKETS = 64
#: Parts of a bucket that are merged on reading before the bucket is rewritten.
COMPACT = 8

ROW = ("doc_id", "page_idx", "seq", "annot_id")
COLUMNS = ("doc_id", "seq", "page_idx", "op", "annot_id")
LIVE = "doc_id long, page_idx int, seq long, annot_id long"
SCHEMAS = {"live": LIVE, "changes": f"{LIVE}, change string", "last": "doc_id long, last_seq long", "seen": "doc_id long, last_seq long"}


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")


def _at(root: str, table: str, batch_id: int) -> str:
    return f"{root.rstrip('/')}/{table}/batch={batch_id}"


def _state_before(spark: SparkSession, root: str, batch_id: int | None = None) -> dict:
    """The manifest before a batch (None: the last one): for each bucket, folders of each table below ``root``."""
    numbers = [n for n in snapshots.versions(spark, root.rstrip("/")) if batch_id is None or n < batch_id]
    return snapshots.load(spark, root.rstrip("/"), numbers[-1]) if numbers else {"buckets": None, "parts": {}}


def _read(spark: SparkSession, root: str, state: dict, table: str, buckets: Iterable[str]) -> DataFrame:
    parts = [f"{root.rstrip('/')}/{p}" for b in buckets for p in state["parts"].get(b, {}).get(table, ())]
    if parts:
        return spark.read.schema(SCHEMAS[table]).parquet(*parts)
    # Known to be empty when it is planned, so that what joins it goes away.
    nulls = [f"CAST(NULL AS {kind}) AS {name}" for name, kind in (c.split() for c in SCHEMAS[table].split(", "))]
    return spark.sql(f"SELECT {', '.join(nulls)} WHERE false")


def _merged(spark: SparkSession, root: str, state: dict, buckets: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """Live annotations and last sequence numbers of some buckets; an annotation comes once and goes once."""
    buckets = list(buckets)
    changes = _read(spark, root, state, "changes", buckets)
    removed = changes.where("change = 'removed'")
    added = changes.where("change = 'added'").select(*ROW)
    live = _read(spark, root, state, "live", buckets).unionByName(added).join(removed, ["doc_id", "seq"], "left_anti")
    seen = _read(spark, root, state, "last", buckets).unionByName(_read(spark, root, state, "seen", buckets))
    return live.select(*ROW), seen.groupBy("doc_id").agg(F.max("last_seq").alias("last_seq"))


def _write(df: DataFrame, root: str, table: str, batch_id: int, buckets: int) -> dict[str, str]:
    """Write by bucket and say which buckets got a part."""
    path = _at(root, table, batch_id)
    rows = df.withColumn("bucket", _bucket(buckets)).hint("rebalance", "bucket")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(path)
    fs, folder = filesystem(df.sparkSession, path)
    names = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]
    return {n.removeprefix("bucket="): f"{table}/batch={batch_id}/{n}" for n in names if n.startswith("bucket=")}


def _apply(batch: DataFrame, batch_id: int, root: str, buckets: int = BUCKETS, compact: int = COMPACT) -> None:
    """Append what a batch changes to the buckets of its documents."""
    spark = batch.sparkSession
    if batch_id in snapshots.versions(spark, root.rstrip("/")):
        return
    state = _state_before(spark, root, batch_id)
    buckets = state["buckets"] or buckets
    events = cut_lineage(batch.select(*COLUMNS))
    # At most ``buckets`` numbers.
    touched_buckets = [str(r[0]) for r in events.select(_bucket(buckets)).distinct().collect()]
    live, last = _merged(spark, root, state, touched_buckets)

    # What is alive before the batch, and its events, worked out once.
    in_time = F.col("last_seq").isNull() | (F.col("seq") > F.col("last_seq"))
    placed = events.join(last, "doc_id", "left").select(*COLUMNS, F.when(in_time, "fresh").otherwise("late").alias("state"))
    touched = placed.where("state = 'fresh'").select("doc_id").distinct()
    before = live.join(touched, "doc_id", "left_semi").withColumns({"op": F.lit("add"), "state": F.lit("before")})
    log = cut_lineage(before.select(*COLUMNS, "state").unionByName(placed))

    before = log.where("state = 'before'").select(*ROW, F.lit(-1).alias("step"))
    after = annotation_state(log.where("state <> 'late'").select(*COLUMNS)).select(*ROW, F.lit(1).alias("step"))
    moved = before.unionByName(after).groupBy("doc_id", "seq").agg(
        F.sum("step").alias("step"), *[F.first(c).alias(c) for c in ROW if c not in ("doc_id", "seq")]
    )
    change = F.when(F.col("step") > 0, "added").otherwise("removed").alias("change")
    changes = (
        moved.where("step <> 0").select(*ROW, change)
        .unionByName(log.where("state = 'late'").select(*ROW, F.lit("late").alias("change")))
    )
    seen = log.where("state = 'fresh'").groupBy("doc_id").agg(F.max("seq").alias("last_seq"))
    parts = {b: {t: list(ps) for t, ps in tables.items()} for b, tables in state["parts"].items()}
    for table, rows in (("changes", changes), ("seen", seen)):
        for b, part in _write(rows, root, table, batch_id, buckets).items():
            parts.setdefault(b, {}).setdefault(table, []).append(part)

    full = [b for b in touched_buckets if len(parts.get(b, {}).get("changes", ())) > compact]
    if full:
        merged = _merged(spark, root, {"parts": parts}, full)
        for b in full:
            parts[b] = {}
        for table, rows in zip(("live", "last"), merged, strict=True):
            for b, part in _write(rows, root, table, batch_id, buckets).items():
                parts[b][table] = [part]
    snapshots._publish(spark, root.rstrip("/"), batch_id, {"buckets": buckets, "parts": parts})
    _forget(spark, root, batch_id)


def _forget(spark: SparkSession, root: str, batch_id: int) -> None:
    """Delete manifests older than the one before ``batch_id``, and parts of the state that only they name.

    ``changes`` stay, being an output of the stream.
    """
    root = root.rstrip("/")
    numbers = snapshots.versions(spark, root)
    old = [n for n in numbers if n < batch_id][:-1]
    kept = [n for n in numbers if n not in old]

    def named(ns: list[int]) -> set[str]:
        manifests = [snapshots.load(spark, root, n)["parts"] for n in ns]
        return {p for m in manifests for tables in m.values() for t, ps in tables.items() if t != "changes" for p in ps}

    gone = named(old) - named(kept)
    for path in [snapshots.manifest_path(root, n) for n in old] + [f"{root}/{p}" for p in sorted(gone)]:
        fs, p = filesystem(spark, path)
        fs.delete(p, True)


def annotation_state_stream(
    events: DataFrame, root: str, checkpoint: str, buckets: int = BUCKETS, compact: int = COMPACT, **trigger
) -> StreamingQuery:
    """Fold a stream of annotation events; below ``root`` it keeps its state, and ``changes`` per batch.

    Events are applied in ``seq`` order inside a micro-batch; one at or below the last applied ``seq`` of its
    document comes too late, is not applied and is reported as ``late``. Changes are those of a batch as a whole:
    what was ``added`` and is still there, and what was there and is ``removed``. The number of buckets is kept with
    the state; another one given later has no effect.
    """
    writer = events.writeStream.foreachBatch(lambda batch, batch_id: _apply(batch, batch_id, root, buckets, compact))
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def live_annotations(spark: SparkSession, root: str) -> DataFrame:
    """What is alive after the last batch; equals ``operators.annotations.annotation_state`` of all in-time events."""
    state = _state_before(spark, root)
    return _merged(spark, root, state, state["parts"])[0].select(*K, "seq", "annot_id")
