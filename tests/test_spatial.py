"""Bounds, thresholds and fallbacks of the spatial joins."""

from __future__ import annotations

import math
import random

import pytest

from quirelake.operators import spatial as S
from quirelake.schemas import ANNOTATIONS, PAGES, RENDER_DIMS, WORDS

W, H = 600.0, 800.0


@pytest.fixture(scope="module")
def page(spark):
    pages = spark.createDataFrame([(1, 0, W, H), (2, 0, W, H)], PAGES)
    dims = spark.createDataFrame([(1, 0, 1200, 1600), (2, 0, 300, 200)], RENDER_DIMS)
    return pages, dims


def words(spark, boxes, doc=1):
    rows = [(doc, 0, n, f"w{n}", *[float(v) for v in b], 4.0 + n, "XX+Arial,Bold") for n, b in enumerate(boxes)]
    return spark.createDataFrame(rows, WORDS)


def annots(spark, rows):
    blank = dict.fromkeys(ANNOTATIONS.fieldNames())
    base = {**blank, "doc_id": 1, "page_idx": 0}
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], ANNOTATIONS)


def test_region_edges_are_inclusive(spark, page):
    # Centres at (10, 10); regions end, start, or just miss there. 2 px are 1 pt.
    ws = words(spark, [(5, 5, 15, 15)])
    regions = [
        (0, 1, 0, 0.0, 1580.0, 20.0, 20.0), (1, 1, 0, 20.0, 1560.0, 5.0, 20.0), (2, 1, 0, 20.5, 1560.0, 50.0, 40.0),
        (3, 1, 0, 0.0, 1580.5, 50.0, 10.0), (4, 2, 0, 0.0, 0.0, 300.0, 200.0),
    ]
    df = spark.createDataFrame(regions, "region_id long, doc_id long, page_idx int, x double, y double, w double, h double")
    assert sorted(r.region_id for r in S.words_in_region(df, ws, *page).collect()) == [0, 1]


def test_random_regions_off_and_on_the_page(spark, page):
    rng = random.Random(2)
    boxes = []
    for _ in range(300):
        x, y = rng.randint(-900, 2500), rng.randint(-900, 2500)
        boxes.append((x, y, x + rng.randint(0, 60), y + rng.randint(0, 20)))
    regions = [
        (n, 1, 0, float(rng.randint(-2000, 3000)), float(rng.randint(-2000, 3000)), float(rng.choice([0, 50, 900, 9000])),
         float(rng.choice([0, 50, 900, 9000]))) for n in range(80)
    ]
    df = spark.createDataFrame(regions, "region_id long, doc_id long, page_idx int, x double, y double, w double, h double")
    want = set()
    for n, _, _, x, y, w, h in regions:
        for i, (left, bottom, right, top) in enumerate(boxes):
            cx, cy = (left + right) / 2, (bottom + top) / 2
            if x / 2 <= cx <= (x + w) / 2 and 800 - (y + h) / 2 <= cy <= 800 - y / 2:
                want.add((n, i))
    got = [(r.region_id, r.word_idx) for r in S.words_in_region(df, words(spark, boxes), *page).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def clicks(spark, points):
    rows = [(n, 1, 0, float(x), float(y)) for n, (x, y) in enumerate(points)]
    return spark.createDataFrame(rows, "click_id long, doc_id long, page_idx int, x double, y double")


def test_hit_rules_by_kind(spark):
    df = annots(
        spark,
        [
            {"seq": 1, "kind": "highlight", "rect": (0.0, 0.0, 10.0, 10.0)},
            {"seq": 2, "kind": "text_edit", "rect": (5.0, 5.0, 10.0, 10.0)},
            {"seq": 3, "kind": "text", "pos": (100.0, 100.0), "measured_w": 20.0, "measured_h": 10.0},
            {"seq": 4, "kind": "signature", "pos": (300.0, 300.0), "src_w": 40.0, "src_h": 20.0, "scale": 0.5},
            {"seq": 5, "kind": "ink", "points": [(500.0, 500.0), (540.0, 501.0)]},
            {"seq": 6, "kind": "ink", "points": []},
        ],
    )
    points = [(10, 10), (10, 4), (128, 118), (128.5, 118), (320, 310), (320, 310.5), (514.9, 500), (515, 500), (-14.9, 0),
              (555.5, 501), (500, 485.5)]
    got = {r.click_id: r for r in S.hit_test(clicks(spark, points), df).collect()}
    assert {k: r.seq for k, r in got.items()} == {0: 2, 1: 1, 2: 3, 4: 4, 6: 5, 10: 5}
    assert tuple(got[2])[5:] == (100.0, 100.0, 28.0, 18.0)
    assert tuple(got[4])[5:] == (300.0, 300.0, 20.0, 10.0)
    assert tuple(got[6])[5:] == (500.0, 500.0, 40.0, 4.0)


@pytest.mark.parametrize("n", [10_000, 12_000])
@pytest.mark.parametrize("size", [0.0, 128.0, 1500.0, 1e7])
def test_an_annotation_lies_on_four_cells_at_most(spark, n, size):
    rng = random.Random(n)
    rows = [(float(rng.randint(-900, 9000)), float(rng.randint(-900, 9000))) for _ in range(n)]
    frame = spark.createDataFrame(rows, "x double, y double").selectExpr(
        "1L as doc_id", "0 as page_idx", "1L as seq", "'highlight' as kind", "cast(null as array<struct<x:double,y:double>>) as points",
        f"named_struct('x', x, 'y', y, 'w', {size}D, 'h', {size / 2}D) as rect", "cast(null as struct<x:double,y:double>) as pos",
        "0D as measured_w", "0D as measured_h", "0D as src_w", "0D as src_h", "0D as scale",
    )
    assert n <= S._hit_targets(frame).count() <= 4 * n


def test_hit_test_shuffles(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = annots(spark, [{"seq": 1, "kind": "highlight", "rect": (0.0, 0.0, 10.0, 10.0)}])
        plan = S.hit_test(clicks(spark, [(1, 1)]), df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") <= 6


def test_random_hits_across_cells(spark):
    rng = random.Random(9)
    rows, rects = [], []
    for seq in range(200):
        r = (float(rng.randint(-500, 4000)), float(rng.randint(-500, 4000)), float(rng.choice([0, 40, 800, 5000])), float(rng.choice([0, 30, 700])))
        rects.append(r)
        if seq % 3:
            rows.append({"seq": seq, "kind": "highlight", "rect": r})
        else:
            rows.append({"seq": seq, "kind": "ink", "points": [r[:2], (r[0] + r[2], r[1] + r[3])]})
    points = [(rng.randint(-600, 4500), rng.randint(-600, 4500)) for _ in range(400)]
    points += [(r[0] + 10, r[1] + 10) for r in rects] + [(128 * n, 32 * n) for n in range(40)]
    want = {}
    for n, (px, py) in enumerate(points):
        for seq, (x, y, w, h) in enumerate(rects):
            if seq % 3:
                hit = x <= px <= x + w and y <= py <= y + h
            else:
                hit = any(math.hypot(px - a, py - b) < 15 for a, b in ((x, y), (x + w, y + h)))
            if hit:
                want[n] = seq
    got = {r.click_id: r.seq for r in S.hit_test(clicks(spark, points), annots(spark, rows)).collect()}
    assert got == want


def test_line_under_a_click(spark, page):
    # On the canvas the word spans y = 1400 to 1420.
    ws = words(spark, [(60, 90, 80, 100), (10, 90, 50, 100), (10, 10, 50, 20)])
    got = {r.click_id: r for r in S.line_at_point(clicks(spark, [(0, 1397), (0, 1396.9), (0, 1423), (0, 1423.1), (5, 1397)]), ws, *page).collect()}
    assert sorted(got) == [0, 2, 4]
    r = got[0]
    assert (r.text, r.x, r.y, r.w, r.h, r.font_size, r.font_name) == ("w1 w0", 20, 1400, 140, 20, 10, "Arial")


def test_nearest_line_has_no_distance_limit(spark, page):
    ws = words(spark, [(60, 90, 80, 100), (10, 92.4, 50, 102.4), (10, 10, 50, 20), (70, 92.6, 80, 102.6)])
    # Middles at 1410, 1405.2, 1570 and 1404.8 pixels; the click at 0 is nearest to the last.
    near = S.nearest_line(clicks(spark, [(0, 0), (0, 1410), (0, 1500), (0, 99999), (0, -50)]), ws, *page)
    got = {r.click_id: r.text for r in near.collect()}
    assert got == {0: "w1 w3", 2: "w2", 3: "w2", 4: "w1 w3"}


def test_nearest_of_two_lines_is_the_earlier_word(spark, page):
    ws = words(spark, [(0, 90, 10, 100), (0, 110, 10, 120)])
    assert [r.text for r in S.nearest_line(clicks(spark, [(0, 1390)]), ws, *page).collect()] == ["w0"]
    swapped = words(spark, [(0, 110, 10, 120), (0, 90, 10, 100)])
    assert [r.text for r in S.nearest_line(clicks(spark, [(0, 1390)]), swapped, *page).collect()] == ["w0"]


def test_random_edit_targets(spark, page):
    rng = random.Random(11)
    boxes = []
    for _ in range(60):
        y = rng.randint(-300, 1200)
        x = rng.randint(0, 500)
        boxes.append((x, y, x + 10, y + rng.randint(1, 300)))
    ys = [rng.randint(-900, 2500) for _ in range(150)] + [-5000, 9000]
    canvas = [(n, b[0] * 2, 1600 - b[3] * 2, 1600 - b[3] * 2 + (b[3] - b[1]) * 2) for n, b in enumerate(boxes)]
    want = {}
    for c, y in enumerate(ys):
        line = [w for w in canvas if w[2] - 3 <= y <= w[3] + 3]
        if not line:
            near = min(canvas, key=lambda w: abs((w[2] + w[3]) / 2 - y))
            line = [w for w in canvas if abs((w[2] + w[3]) / 2 - (near[2] + near[3]) / 2) < 5]
        want[c] = " ".join(f"w{w[0]}" for w in sorted(line, key=lambda w: (w[1], w[0])))
    got = S.edit_target(clicks(spark, [(0, y) for y in ys]), words(spark, boxes), *page).collect()
    assert len(got) == len(ys) and {r.click_id: r.text for r in got} == want


def test_white_box_hides_words(spark, page):
    # Centres at y = 1500 px; the boxes start 2 px above or just below.
    ws = words(spark, [(5, 45, 15, 55)])
    edits = annots(spark, [{"seq": 1, "kind": "text_edit", "rect": (0.0, 1502.0, 40.0, 9.0)}])
    assert S.visible_words(ws, edits, *page).count() == 0
    missed = annots(spark, [{"seq": 1, "kind": "text_edit", "rect": (0.0, 1502.5, 40.0, 9.0)}, {"seq": 2, "kind": "highlight", "rect": (0.0, 0.0, 999.0, 9999.0)}])
    assert S.visible_words(ws, missed, *page).count() == 1


def test_placed_signature(spark):
    sigs = spark.createDataFrame([("s1", [[(0.0, 1.0)]], 400.0, 150.0)], "id string, strokes array<array<struct<x:double,y:double>>>, canvas_w double, canvas_h double")
    at = spark.createDataFrame([(1, 0, 5, "s1", 7.0, 8.0), (1, 0, 6, "gone", 0.0, 0.0)], "doc_id long, page_idx int, seq long, signature_id string, x double, y double")
    (r,) = S.place_signatures(at, sigs).collect()
    assert (r.seq, r.kind, tuple(r.pos), r.scale, r.src_w, r.src_h) == (5, "signature", (7.0, 8.0), 0.5, 400.0, 150.0)
