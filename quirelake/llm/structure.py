"""Repair of conversation structure by weighted CYK interval parsing.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles: perhaps a system turn, then user and assistant
in turn. Four states follow that expression; a nonterminal <p,q> is a span of turns whose repair leads from
state p to state q. The repair grammar is in Chomsky normal form: <p,r> -> <p,q> <q,r>, and <p,q> -> turn, where a
turn may be kept, reroled or deleted. Inserted turns are empty words: they are closed into the rule of the turn behind
them, and at the end of the conversation. A cell keeps the least (cost, audit), the audit being the initials of its
edits; of two audits of one span and cost none begins the other, so least cells add up to least cells.

Cells are combined bottom-up by span length: spans of one turn, of two, four and so on. Every split of a
span gives the same cell, because a derivation may be cut between any two turns, so one split will do and n turns take n - 1
combinations. That is also what lets a conversation of any length be parsed in parts: turns are dealt out by ranges of
their order, each task combines what it has of a conversation, and the few parts left are combined at the end.
Repeated turns are found by an aggregate over digests. Only the repaired conversation, in order, streams through one task; no
task holds one, but for its audit.

Cases: null roles and texts are a space; a null conversation id is a conversation of its own, a null turn comes first.
Turns with equal numbers are ordered by role and SHA-256 of the text. A role without initial is in no place and never
kept. Repeated rows are duplicates. Very long texts are streamed like others. A conversation without turns, and every row of an
empty table, has nothing to repair. Extra columns are dropped.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import lean
from quirelake.plans.lineage import cut_lineage

KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
#: Costs of a turn that is cut short and stays.
CUT_SHORT = 1
#: Where each initial leads from a state: nothing yet, after the system turn, after a user, after an assistant.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ACCEPT = range(4), (0, 3)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
PAIRS = tuple((p, q) for p in STATES for q in STATES if q and (q != 1 or p <= 1) or p == q == 0)

_BLANKS = " \t\n\x0b\x0c\r"

Cell = tuple[int, str]
Cells = dict[tuple[int, int], Cell]


# --- grammar ------------------------------------------------------------------------------------


@functools.cache
def inserted() -> Cells:
    """Least insertions that lead from one state to another: the closure of the empty words."""
    found: Cells = {(p, p): (0, "") for p in STATES}
    for _ in STATES:
        for (p, q), (cost, audit) in list(found.items()):
            for (at, initial), to in STEPS.items():
                if at == q and initial in ROLES:
                    new = cost + COST[INSERT], audit + INSERT
                    found[p, to] = min(found.get((p, to), new), new)
    return found


@functools.cache
def turn_cells(initial: str, doomed: bool, cut_short: bool) -> Cells:
    """Cells of a span of one turn; a ``doomed`` turn (blank or duplicate) can only be deleted."""
    edits = [(p, p, COST[DELETE], DELETE) for p in STATES]
    if not doomed:
        for (p, letter), q in STEPS.items():
            edits += [(p, q, COST[KEEP] + CUT_SHORT * cut_short, KEEP)] * (letter == initial)
            edits += [(p, q, COST[REROLE] + CUT_SHORT * cut_short, REROLE)] * (letter in ROLES)
    out: Cells = {}
    for (o, p), (cost, audit) in inserted().items():
        for start, q, more, letter in edits:
            if start == p:
                new = cost + more, audit + letter
                out[o, q] = min(out.get((o, q), new), new)
    return out


_RULES = tuple((p, q, r) for p, q in PAIRS for q_, r in PAIRS if q == q_)


def combined(left: Cells, right: Cells) -> Cells:
    """Cells of two neighbouring spans taken together."""
    out: Cells = {}
    for p, q, r in _RULES:
        x, y = left.get((p, q)), right.get((q, r))
        if x and y:
            cost = x[0] + y[0]
            old = out.get((p, r))
            if old is None or cost < old[0] or cost == old[0] and x[1] + y[1] < old[1]:
                out[p, r] = cost, x[1] + y[1]
    return out


class Spans:
    """Neighbouring spans, combined whenever the last is as long as the one before it."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, Cells]] = []

    def add(self, cells: Cells, length: int = 1) -> None:
        while self.spans and self.spans[-1][0] <= length:
            n, before = self.spans.pop()
            cells, length = combined(before, cells), length + n
        self.spans.append((length, cells))

    def whole(self) -> Cells:
        while len(self.spans) > 1:
            self.add(self.spans.pop()[1], self.spans[-1][0])
        return self.spans[0][1]


def best(cells: Cells) -> Cell:
    """Least (cost, audit) of a whole conversation, with insertions at its end."""
    ends = inserted()
    found = [
        (cost + ends[q, r][0], audit + ends[q, r][1])
        for (p, q), (cost, audit) in cells.items() if p == 0 for r in ACCEPT if (q, r) in ends
    ]
    return min(found)


# --- turns --------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns of (conv_id, turn, role, text) with faults: by a checksum of id and turn some are dropped, emptied, robbed
    of their stops, repeated or given to the user."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), kind.alias("kind"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(1)))
    return rows.where("kind != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("t")).drop("t")


def key(conv_id: Column) -> Column:
    """A conversation's id as text that is never null."""
    return F.to_json(F.struct(conv_id.alias("id")))


def ordered(turns: DataFrame) -> DataFrame:
    """``turns`` with key, digest of the text and ``pos``, which rises in the order of conversations and their turns; written."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = lean(turns).select("conv_id", "turn", name("role"), name("text")).withColumn("digest", F.sha2("text", 256))
    order = ("conv_id", "turn", "role", "digest")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(dealt.select("*", key(F.col("conv_id")).alias("key"), F.monotonically_increasing_id().alias("pos")))


def faulty(rows: DataFrame) -> DataFrame:
    """key, pos, initial and first fault (blank, duplicate, truncated or null) of ``ordered`` turns."""
    stripped = F.rtrim("text", F.lit(_BLANKS))
    marks = rows.select(
        "key", "pos", "role", "digest", (stripped == "").alias("blank"), (~F.right(stripped, F.lit(1)).isin(*".!?")).alias("truncated")
    )
    firsts = marks.groupBy("key", "role", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    fault = F.when(F.col("blank"), "blank").when(F.col("pos") > F.col("first"), "duplicate").when(F.col("truncated"), "truncated")
    return marks.join(firsts, ["key", "role", "digest"], "left").select(
        "key", "pos", F.substring("role", 1, 1).alias("initial"), fault.alias("fault")
    )


_PART = "key string, pos long, n long, first string, last string, illegal long, cells array<struct<cost:long,audit:string>>"
_CELL = pa.struct([("cost", pa.int64()), ("audit", pa.string())])


class Part:
    """What a task knows of neighbouring turns of a conversation."""

    def __init__(self, key: str, pos: int):
        self.key, self.pos, self.n, self.illegal = key, pos, 0, 0
        self.first = self.last = None
        self.spans = Spans()

    def add(self, cells: Cells, first: str, last: str, illegal: int = 0, n: int = 1) -> None:
        if self.n:
            self.illegal += self.last + first not in LEGAL
        else:
            self.first = first
        self.n, self.last, self.illegal = self.n + n, last, self.illegal + illegal
        self.spans.add(cells, n)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to parts of conversations."""
    part = None
    for batch in batches:
        done = []
        for k, pos, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("key", "pos", "initial", "fault")), strict=True):
            if part is None or part.key != k:
                done += [part] if part else []
                part = Part(k, pos)
            part.add(turn_cells(initial, fault in ("blank", "duplicate"), fault == "truncated"), initial, initial)
        if done:
            yield _written(done)
    if part:
        yield _written([part])


def _written(parts: list[Part]) -> pa.RecordBatch:
    cells = []
    for p in parts:
        whole = p.spans.whole()
        cells.append([dict(zip(("cost", "audit"), whole[pair], strict=True)) if pair in whole else None for pair in PAIRS])
    kinds = (("key", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()))
    arrays = [pa.array([getattr(p, c) for p in parts], t) for c, t in kinds]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(cells, pa.list_(_CELL))], [*(c for c, _ in kinds), "cells"])


def _wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted parts to conversations."""

    def out(parts: list[Part]) -> pa.RecordBatch:
        costs, audits = zip(*(best(p.spans.whole()) for p in parts), strict=True)
        columns = {"key": [p.key for p in parts], "illegal": [p.illegal for p in parts], "cost": costs, "audit": audits}
        return pa.RecordBatch.from_pydict(columns)

    whole = None
    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if whole is None or whole.key != r["key"]:
                done += [whole] if whole else []
                whole = Part(r["key"], r["pos"])
            cells = {pair: (c["cost"], c["audit"]) for pair, c in zip(PAIRS, r["cells"], strict=True) if c}
            whole.add(cells, r["first"], r["last"], r["illegal"], r["n"])
        if done:
            yield out(done)
    if whole:
        yield out([whole])


def parsed(marks: DataFrame) -> DataFrame:
    """key, number of illegal neighbours, cost and audit of every conversation with turns; ``marks`` as ``faulty`` gives them."""
    spans = marks.repartitionByRange("pos").sortWithinPartitions("pos").mapInArrow(_parts, _PART)
    return spans.repartition("key").sortWithinPartitions("key", "pos").mapInArrow(_wholes, "key string, illegal long, cost long, audit string")


# --- repaired conversations ---------------------------------------------------------------------


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns, each conversation's audit before them, to repaired turns."""
    names = ("key", "n", "edit", "role", "text")
    k = audit = None
    at = state = n = 0
    out: list[tuple] = []

    def put(edit: str, role: str, text: str) -> None:
        nonlocal state, n
        state = STEPS[state, role[:1]]
        out.append((k, n, edit, role, text))
        n += 1

    def insert() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == INSERT:
            put(INSERT, "user" if (state, "u") in STEPS else "assistant", "")
            at += 1

    def drain() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        for key_, pos, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "pos", "role", "text")), strict=True):
            if pos < 0:
                k, audit, at, state, n = key_, text, 0, 0, 0
                insert()
                continue
            edit = audit[at]
            at += 1
            if edit == KEEP:
                put(KEEP, role, text)
            elif edit == REROLE:
                put(REROLE, "user" if (state, "u") in STEPS else "assistant", text)
            insert()
        yield drain()


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Turns after repair: key, place, edit, role and text, in order within each partition; ``rows`` as ``ordered`` gives them."""
    audits = found.select("key", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    both = rows.select("key", "pos", "role", "text").unionByName(audits)
    return both.repartition("key").sortWithinPartitions("key", "pos").mapInArrow(_apply, "key string, n long, edit string, role string, text string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    k, digest = None, hashlib.sha256()
    for batch in batches:
        done: list[tuple[str, str]] = []
        for key_, n, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "role", "text")), strict=True):
            if n == 0:
                done += [(k, digest.hexdigest())] if k is not None else []
                k, digest = key_, hashlib.sha256()
            digest.update(f"{chr(10) if n else ''}{role}:{text}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], ["key", "repaired_sha256"])
    if k is not None:
        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([digest.hexdigest()])], ["key", "repaired_sha256"])


def report(conversations: DataFrame) -> DataFrame:
    """The digest per conversation of ``conversations`` once they are ``damaged``."""
    rows = ordered(damaged(conversations))
    marks = faulty(rows)
    found = cut_lineage(parsed(marks))
    hashes = repaired(rows, found).mapInArrow(_digests, "key string, repaired_sha256 string")
    turns = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = rows.groupBy("key").agg(F.coalesce(turns, F.lit(0)).cast("long").alias("gaps"))
    faults = marks.groupBy("key").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    ids = conversations.select("conv_id").distinct().withColumn("key", key(F.col("conv_id")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return ids.join(gaps, "key", "left").join(faults, "key", "left").join(found, "key", "left").join(hashes, "key", "left").select(
        "conv_id", zero("gaps"), zero("blank"), zero("duplicate"), zero("truncated"), zero("illegal"), zero("cost"),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
