from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from quirelake.llm import structure as s
from quirelake.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def cheapest(turns):
    """Least (cost, audit) of (initial, doomed, cut short) turns, over all edits with up to three insertions in a place."""
    found = []
    gaps = itertools.product(range(4), repeat=len(turns) + 1)
    for gap in gaps:
        for edits in itertools.product(*["D" if doomed else "KRD" for _, doomed, _ in turns]):
            cost, audit, letters = 2 * sum(gap), "I" * gap[0], ["[ua]" * gap[0]]
            for edit, (initial, _, cut), more in zip(edits, turns, gap[1:], strict=True):
                cost += {"K": 0, "R": 2, "D": 3}[edit] + (cut and edit != "D")
                audit += edit + "I" * more
                letters.append({"K": initial or "-", "R": "[ua]", "D": ""}[edit] + "[ua]" * more)
            found.append((cost, audit, "".join(letters)))
    for cost, audit, pattern in sorted(found):
        n = len(re.sub(r"\[ua\]", "x", pattern))
        if not n or any(re.fullmatch(pattern, x) for x in ("s" * k + "ua" * ((n - k) // 2) for k in (0, 1)) if len(x) == n and x != "s"):
            return cost, audit


def plain_cyk(turns):
    """All spans by all splits."""
    n = len(turns)
    if not n:
        return 0, ""
    cells = {(i, i + 1): s.turn_cells(*t) for i, t in enumerate(turns)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            whole = {}
            for k in range(i + 1, i + length):
                for pair, cell in s.combined(cells[i, k], cells[k, i + length]).items():
                    whole[pair] = min(whole.get(pair, cell), cell)
            cells[i, i + length] = whole
    return s.best(cells[0, n])


def plain_scan(turns):
    """From the last turn to the first: the least (cost, audit) of what follows a state."""
    steps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def closed(after):
        for _ in range(3):
            after = [min([after[p], *((after[q][0] + 2, "I" + after[q][1]) for (o, x), q in steps.items() if o == p and x in "ua")]) for p in range(4)]
        return after

    worst = (10**9, "")
    after = closed([(0, ""), worst, worst, (0, "")])
    for initial, doomed, cut in reversed(turns):
        new = []
        for p in range(4):
            options = [(after[p][0] + 3, "D" + after[p][1])]
            for (o, x), q in steps.items():
                if o == p and not doomed:
                    options += [(after[q][0] + cut, "K" + after[q][1])] if x == initial else []
                    options += [(after[q][0] + 2 + cut, "R" + after[q][1])] if x in "ua" else []
            new.append(min(options))
        after = closed(new)
    return after[0]


def parse(turns):
    spans = s.Spans()
    for t in turns:
        spans.add(s.turn_cells(*t))
    return s.best(spans.whole()) if turns else (0, "")


TURN = st.tuples(st.sampled_from(["s", "u", "a", "x", ""]), st.booleans(), st.booleans())


@settings(max_examples=30, deadline=None)
@given(st.lists(TURN, max_size=3))
def test_least_edits(turns):
    assert parse(turns) == plain_cyk(turns) == cheapest(turns)


@settings(max_examples=80, deadline=None)
@given(st.lists(TURN, min_size=4, max_size=12))
def test_one_split_gives_what_all_splits_give(turns):
    assert parse(turns) == plain_cyk(turns) == plain_scan(turns)


def plain_report(rows):
    """conv_id -> the row of the contract, turn by turn."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            turns += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).hexdigest()))
        seen, faults, seq = set(), [], []
        for _, role, text in turns:
            bare = text.rstrip(BLANK)
            fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            seq.append((role[:1], fault in ("b", "d"), fault == "t"))
        cost, audit = plain_scan(seq)
        lines, left = [], list(turns)
        state = ""
        for edit in audit:
            if edit == "D":
                left.pop(0)
                continue
            forced = "assistant" if state == "u" else "user"
            role, text = (forced, "") if edit == "I" else left.pop(0)[1:]
            role = forced if edit == "R" else role
            state = role[0]
            lines.append(f"{role}:{text}")
        numbers = [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        out[conv] = (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def report(df):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in s.report(df).collect()}


def test_whole_table(spark):
    df = table(spark, SMALL, "conversations")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert report(df) == plain_report(rows)


def test_odd_rows(spark):
    rng = random.Random(7)
    role = lambda: rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
    text = lambda: rng.choice(["Yes.", "No!", "ok", "", " \t", None, "a.\n", "é?", "long " * 4000])
    rows = [(c, rng.choice([t, t, t, None, 3, 5 * t]), role(), text()) for c in (*range(25), None) for t in range(rng.randrange(1, 14))]
    rows += rows[:9] + [(99, t, "user", "hello.") for t in range(300)] + [(100, None, None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", pos string")
    assert report(df) == plain_report(rows)
    assert s.report(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 40])
def test_a_conversation_over_many_tasks(spark, n):
    rows = [(1, t, "user" if t % 7 else "assistant", f"turn {t % 50}{'.' * (t % 3)}") for t in range(600)] + [(c, 0, "user", "hi.") for c in range(2, 40)]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert s.ordered(s.damaged(df)).rdd.getNumPartitions() == n
        found = report(df)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == plain_report(rows)


def test_every_conversation_comes_back(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "hi.")], SCHEMA)
    assert report(df) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
