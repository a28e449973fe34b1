"""Block-wise ordered computations against plain loops."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quirelake.plans.blocks import dense_position, next_marked, running_sum


def rows(seed: int):
    rng = random.Random(seed)
    out = []
    for key in range(12):
        for at in sorted(rng.sample(range(-20, 200), rng.choice([1, 2, 10, 80]))):
            out.append((key, at, rng.randint(-3, 3), rng.random() < 0.2))
    return out


def by_key(data):
    groups = {}
    for r in data:
        groups.setdefault(r[0], []).append(r)
    return groups.items()


def test_running_sum_and_positions(spark):
    data = rows(1)
    df = spark.createDataFrame(data, "k int, at long, v int, mark boolean")
    want_sum, want_pos = {}, {}
    for k, group in by_key(data):
        total = 0
        for n, (_, at, v, _) in enumerate(group):
            total += v
            want_sum[k, at], want_pos[k, at] = total, n
    got = running_sum(df, ["k"], "at", F.col("v"), "s", bits=3).collect()
    assert {(r.k, r.at): r.s for r in got} == want_sum and len(got) == len(data)
    got = dense_position(df, ["k"], "at", "p", bits=3).collect()
    assert {(r.k, r.at): r.p for r in got} == want_pos


def test_next_marked(spark):
    data = rows(2)
    df = spark.createDataFrame(data, "k int, at long, v int, mark boolean")
    want = {
        (k, r[1]): next((s[1] for s in group if s[1] >= r[1] and s[3]), None) for k, group in by_key(data) for r in group
    }
    got = next_marked(df, ["k"], "at", F.col("mark"), "n", bits=2).collect()
    assert {(r.k, r.at): r.n for r in got} == want and len(got) == len(data)


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 5), (None, 9), (1, 2)], "k int, at long")
    got = dense_position(df, ["k"], "at", "p", bits=1).collect()
    assert {(r.k, r.at, r.p) for r in got} == {(None, 5, 0), (None, 9, 1), (1, 2, 0)}
