"""Annotation stacks against a list that is edited event by event."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

from quirelake.operators.annotations import annotation_state, has_annotations, ink_bounds, undo_last, z_order
from quirelake.schemas import ANNOT_EVENTS, ANNOTATIONS
from quirelake.plans import snapshots
from quirelake.plans.lineage import cut_lineage
from quirelake.streaming.annotation_state import _apply, annotation_state_stream, live_annotations


def fold(events):
    live = []  # page, id, seq
    for doc, seq, page, op, annot in sorted(events, key=lambda e: e[1]):
        if op == "add":
            live.append((page, annot, seq))
        elif op == "delete":
            live = [a for a in live if a[1] != annot]
        elif op == "undo":
            mine = [a for a in live if a[0] == page]
            if mine:
                live.remove(mine[-1])
        elif op == "clear":
            live = [a for a in live if a[0] != page]
        else:
            live = []
    return {(events[0][0], page, seq, annot) for page, annot, seq in live}


def make_logs(seed: int, docs: int):
    rng = random.Random(seed)
    logs = []
    for doc in range(docs):
        weights = rng.choice([(60, 14, 20, 3, 1), (45, 30, 45, 0, 0), (50, 0, 50, 5, 2), (40, 60, 10, 1, 0)])
        seq, known, log = 0, [], []
        for _ in range(rng.choice([1, 5, 30, 120])):
            seq += rng.randint(1, 3)
            op = rng.choices(["add", "delete", "undo", "clear", "reload"], weights)[0]
            annot = None
            if op == "add":
                annot = seq * 10
                known.append(annot)
            elif op == "delete":
                # Sometimes null, not yet added, or already gone.
                recent = known[-4:] + known[:1]
                annot = rng.choice([*recent, None, seq * 10 + 10, 7])
            log.append((doc, seq, rng.randint(0, 2), op, annot))
        logs.append(log)
    return logs


def test_state_equals_fold(spark):
    logs = make_logs(3, 150)
    df = spark.createDataFrame([e for log in logs for e in log], ANNOT_EVENTS)
    got = [tuple(r) for r in annotation_state(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == set().union(*map(fold, logs))


def test_whole_and_crowded_documents_give_the_same(spark):
    """No, some and all documents over the limit; as many rounds as a nest of undone deletions asks for."""
    logs = make_logs(5, 60)
    deep = [(900, n + 1, 0, "add", n) for n in range(12)]
    deep += [(900, 20 + 2 * n + k, 0, op, 11 - n if k else None) for n in range(12) for k, op in enumerate(("undo", "delete"))]
    logs.append(deep)
    df = spark.createDataFrame([e for log in logs for e in log], ANNOT_EVENTS)
    want = set().union(*map(fold, logs))
    for whole in (1000, 20, 0):
        got = [tuple(r) for r in annotation_state(df, whole=whole).collect()]
        assert len(got) == len(want) and set(got) == want


def test_a_batch_of_small_documents_takes_few_jobs(spark, tmp_path):
    """18 jobs here, where rounds of joins and blocks took 71."""
    logs = make_logs(6, 40)
    tracker, group = spark.sparkContext.statusTracker(), "annotation batch"
    frame = cut_lineage(spark.createDataFrame([e for log in logs for e in log], ANNOT_EVENTS))
    spark.sparkContext.setJobGroup(group, group)
    try:
        _apply(frame, 0, str(tmp_path), 4)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup(group)) <= 35
    assert {tuple(r) for r in live_annotations(spark, str(tmp_path)).collect()} == set().union(*map(fold, logs))


def test_stream_ends_in_the_state_of_the_batch(spark, tmp_path):
    logs = make_logs(4, 40)
    events = [e for log in logs for e in log]
    last = max(e[1] for e in events)

    def arrive(rows):
        spark.createDataFrame(rows, ANNOT_EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(ANNOT_EVENTS).parquet(f"{tmp_path}/in")
        annotation_state_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state", availableNow=True).awaitTermination()
        return {tuple(r) for r in live_annotations(spark, f"{tmp_path}/out").collect()}

    before = set()
    for part in range(3):
        lo, hi = last * part // 3, last * (part + 1) // 3
        live = arrive([e for e in events if lo < e[1] <= hi])
        changes = spark.read.parquet(f"{tmp_path}/out/changes/batch={part}").collect()
        of = lambda kind: {(r.doc_id, r.page_idx, r.seq, r.annot_id) for r in changes if r.change == kind}  # noqa: B023, E731
        assert of("added") == live - before and of("removed") == before - live and not of("late")
        before = live
    want = set().union(*map(fold, logs))
    assert live == want
    # The same events again come too late, every one of them.
    assert arrive(events) == want
    assert spark.read.parquet(f"{tmp_path}/out/changes/batch=3").where("change = 'late'").count() == len(events)


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    first = spark.createDataFrame([(1, 1, 0, "add", 1), (1, 2, 0, "add", 2)], ANNOT_EVENTS)
    second = spark.createDataFrame([(1, 3, 0, "undo", None), (2, 3, 0, "add", 9), (1, 2, 0, "add", 7)], ANNOT_EVENTS)
    for batch, number in ((first, 0), (second, 1), (second, 1)):
        _apply(batch, number, str(tmp_path))
        live = {tuple(r) for r in live_annotations(spark, str(tmp_path)).collect()}
    assert live == {(1, 0, 1, 1), (2, 0, 3, 9)}
    assert live_annotations(spark, f"{tmp_path}/none").count() == 0


def files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


def bucket_of(path):
    return next((part for part in path.split("/") if part.startswith("bucket=")), None)


def test_a_batch_of_one_document_writes_one_bucket(spark, tmp_path):
    many = spark.createDataFrame([(d, 1, 0, "add", 1) for d in range(200)], ANNOT_EVENTS)
    _apply(many, 0, str(tmp_path), buckets=16)
    want = {(d, 0, 1, 1) for d in range(200)}
    before = files(tmp_path)
    assert len({bucket_of(p) for p in before}) == 16
    for batch in range(1, 6):
        one = spark.createDataFrame([(7, batch + 1, 0, "add", batch)], ANNOT_EVENTS)
        _apply(one, batch, str(tmp_path), buckets=16, compact=2)
        want.add((7, 0, batch + 1, batch))
        assert {tuple(r) for r in live_annotations(spark, str(tmp_path)).collect()} == want
    after = files(tmp_path)
    new = {bucket_of(p) for p in after.keys() - before.keys()}
    assert len(new) == 1
    # What other buckets hold was neither written again nor deleted.
    others = {p: t for p, t in before.items() if bucket_of(p) not in new}
    assert others.items() <= after.items()
    parts = snapshots.current(spark, str(tmp_path))["parts"]
    assert [p["changes"] for b, p in parts.items() if f"bucket={b}" not in new] and all(len(p.get("changes", ())) <= 2 for p in parts.values())
    assert parts[new.pop().removeprefix("bucket=")].keys() >= {"live", "last"}


@pytest.mark.parametrize("lost", ["live", "publish"])
def test_a_batch_cut_short_leaves_the_state_as_it_was(spark, tmp_path, monkeypatch, lost):
    """The writer is lost while it compacts, and before it publishes; the replay then ends as if nothing had been."""
    from quirelake.streaming import annotation_state as module

    batches = [[(d, n + 1, 0, op, n) for d in range(3)] for n, op in enumerate(("add", "add", "undo", "add"))]
    frames = [spark.createDataFrame(b, ANNOT_EVENTS) for b in batches]
    states = []
    for n, frame in enumerate(frames):
        if n == 1:
            with monkeypatch.context() as patch:
                real = module._write

                def write(df, root, table, *rest):
                    if table == lost:
                        raise OSError("lost")
                    return real(df, root, table, *rest)

                def publish(*_):
                    raise OSError("lost")

                patch.setattr(module, "_write", write)
                if lost == "publish":
                    patch.setattr(module.snapshots, "_publish", publish)
                with pytest.raises(OSError):
                    _apply(frame, n, str(tmp_path), 4, 1)
            assert {tuple(r) for r in live_annotations(spark, str(tmp_path)).collect()} == states[-1]
        for _ in range(2):
            _apply(frame, n, str(tmp_path), 4, 1)
        states.append({tuple(r) for r in live_annotations(spark, str(tmp_path)).collect()})
    assert states[2] == {(d, 0, 1, 0) for d in range(3)}
    assert states[3] == {(d, 0, s, a) for d in range(3) for s, a in ((1, 0), (4, 3))}
    assert len(snapshots.versions(spark, str(tmp_path))) == 2


def annots(spark, rows):
    blank = dict.fromkeys(ANNOTATIONS.fieldNames())
    return spark.createDataFrame([tuple({**blank, **r}.values()) for r in rows], ANNOTATIONS)


def test_stack_operators(spark):
    df = annots(
        spark,
        [{"doc_id": 1, "page_idx": p, "seq": s, "kind": "ink", "points": pts} for p, s, pts in [
            (0, 5, [(1.0, 2.0), (3.0, 9.0)]), (0, 900_000, [(1.0, 1.0)]), (0, 7, []), (1, 6, None),
        ]],
    )
    assert {(r.page_idx, r.seq) for r in undo_last(df).collect()} == {(0, 5), (0, 7)}
    assert {(r.seq, r.z) for r in z_order(df).collect()} == {(5, 0), (7, 1), (900_000, 2), (6, 0)}
    assert {tuple(r) for r in ink_bounds(df).collect()} == {(1, 0, 5, 1.0, 2.0, 4.0, 7.0), (1, 0, 900_000, 1.0, 1.0, 4.0, 4.0)}
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert {tuple(r) for r in has_annotations(docs, df).collect()} == {(1, True), (2, False)}
