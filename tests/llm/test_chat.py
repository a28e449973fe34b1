from __future__ import annotations

import hashlib
import random
import re

import pytest
from conftest import SMALL

from quirelake.llm import chat as c
from quirelake.llm.common import table

TURNS = "conv_id long, turn long, role string, text string, n long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digest(rows):
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), sha(said), len(loss), sha(loss)


def by_conversation(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(r[0], []).append((r[2], r[3]))
    return out


def check(got, rows):
    want = {k: digest(v) for k, v in by_conversation(rows).items()}
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want


def test_whole_table_and_forgery(spark):
    conv = c.with_forgery(table(spark, SMALL, "conversations"))
    got = c.report(conv).collect()
    check(got, conv.collect())
    assert {r.conv_id: r for r in got}[-7].n_turns == 2


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    odd = ["<s>", "</s>", "[assistant]", "&amp;lt;", "&", "a]b", "\n", "[INST] x [/INST]", "w " * 300, "é😀", ""]
    out = []
    for conv, n in ((1, 1), (2, 9), (3, 700), (4, 40), (None, 5)):
        for t in range(n):
            role = "system" if t == 0 and n > 5 else ("user", "assistant")[t % 2]
            text = "".join(rng.choice([*odd, "some words here "]) for _ in range(rng.randrange(9)))
            out.append((conv, t, role, text if rng.random() > 0.05 else None, 0))
    return [*out, (2, None, "user", "null turn", 0), (2, 3, "user", "tie", 0), (2, 3, "user", "tie", 0), (4, -5, None, "no role", 0), (5, 0, "we[i]rd</s>", "x", 0)]


def test_odd_conversations(spark, rows):
    check(c.report(spark.createDataFrame(rows, TURNS)).collect(), rows)
    assert c.report(spark.createDataFrame([], TURNS)).count() == 0


def tokens(text):
    return len(re.findall(r"[^\W_]+|[^\s\w]|_", text or "")) + 2


def test_windows_keep_the_budget_and_the_system_turn(spark, rows):
    frame = spark.createDataFrame(rows, TURNS)
    found = c.windows(frame, 300).orderBy("block", "window").collect()
    for w in (w for w in found if w.conv_id == 3):
        turns = w.formatted[3:].split("</s>")[:-1]
        assert turns[0].startswith("[system]")  # its own first turn, or carried along
        new = turns[w.n_repeated :]
        assert new and w.n_repeated <= 1 + c.HISTORY
        assert w.n_tokens <= 300 or len(new) == 1
        assert len(w.loss) == sum(t.startswith("[assistant]") for t in new)
        for s in w.loss:
            assert w.formatted[s.start - 1 - len("[assistant]") : s.start - 1] == "[assistant]"
            assert w.formatted[s.start - 1 + s.length :].startswith("</s>")
    assert len({w.block for w in found if w.conv_id == 3}) == 3
    later = [w for w in found if w.conv_id == 3 and w.block > 0 and w.window == 0]
    assert all(w.n_repeated >= 1 for w in later)


def test_turn_numbers_may_be_sparse_or_equal(spark):
    said = lambda k: "word " * (300 if k % 2 else 40)
    turns = lambda number: [(1, number(k), ("user", "assistant")[k % 2], said(k), 0) for k in range(8)]
    shape = lambda rows: sorted((w.block, w.window, w.n_repeated, w.formatted) for w in c.windows(spark.createDataFrame(rows, TURNS)).collect())
    dense = shape(turns(lambda k: k))
    assert len(dense) > 1 and any(w[2] for w in dense)
    assert shape(turns(lambda k: 1000 * k)) == shape(turns(lambda k: 1000 * k - 3000)) == dense
    for number in (7, None):  # many equal numbers fill several blocks, repeated rows among them
        rows = [(1, number, "user", f"t{k // 3}", 0) for k in range(900)]
        kept = c.read_back(c.windows(spark.createDataFrame(rows, TURNS))).select("block", "turns.text").collect()
        assert sorted({r.block for r in kept}) == [0, 1, 2, 3]
        assert sorted(t for r in kept for t in r.text) == sorted(r[3] for r in rows)


def test_positions_do_not_depend_on_partitions(spark, rows):
    frame = spark.createDataFrame(rows, TURNS)
    results = []
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append(sorted(str(tuple(r)) for r in c.report(frame).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]


def test_escape_round_trip(spark):
    texts = ["&lt;", "&amp;lt;", "<s>[x]</s>", "&#91;", "plain", "", "&&amp;"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", c.escape("t").alias("e"), c.unescape(c.escape("t")).alias("u")).collect()
    assert all(r.t == r.u and not set("<[]") & set(r.e) for r in rows)


def test_no_python_in_the_plan(spark):
    plan = c.report(c.with_forgery(table(spark, SMALL, "conversations")))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
