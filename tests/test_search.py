"""Phrase search against a loop that grows every run word by word."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quirelake.catalog.inputs import LIVE, Inputs
from quirelake.catalog.queries import registered
from quirelake.operators import search
from quirelake.operators.filters import search_gate
from quirelake.schemas import WORDS

VOCAB = ["a", "ab", "The", "the", "hat", "that", "of", "oftheo", "X", "longlonglongword", "é", "foo", "bar", "😀b"]
QUERIES = ["the", "ab", "of the", "hat the", "a", "t t", " the", "the ", "e  t", "zz", "foo bar the", "😀b a", "B"]


def utf16(s: str) -> int:
    return len(s.encode("utf-16-be")) // 2


def grow(texts: list[str], q: str):
    low = q.lower()
    for i, text in enumerate(texts):
        so_far = text
        if low in so_far.lower():
            yield i, i
            continue
        for j in range(i + 1, len(texts)):
            if utf16(so_far) >= utf16(q) + 20:
                break
            so_far += " " + texts[j]
            if low in so_far.lower():
                yield i, j
                break


def make_pages(seed: int, sizes: list[int], gaps: bool):
    rng = random.Random(seed)
    pages = []
    for doc, size in enumerate(sizes):
        step = (lambda: rng.randint(1, 40)) if gaps else (lambda: 1)
        at, rows = -1, []
        for _ in range(size):
            at += step()
            box = [float(rng.randint(0, 99)) for _ in range(4)]
            rows.append((doc, doc % 3, at, rng.choice(VOCAB), *box, 10.0, "Arial"))
        pages.append(rows)
    return pages


def expected(pages):
    out = set()
    for rows in pages:
        for n, q in enumerate(QUERIES):
            for i, j in grow([r[3] for r in rows], q):
                run = rows[i : j + 1]
                out.add(
                    (n, rows[0][0], rows[0][1], i, j, min(r[4] for r in run), min(r[5] for r in run),
                     max(r[6] for r in run), max(r[7] for r in run))
                )
    return out


def as_given(spark, queries, table):
    return spark.createDataFrame(queries, "query_id int, q string") if table else queries


@pytest.mark.parametrize("gaps", [False, True])
@pytest.mark.parametrize("table", [False, True])
def test_hits_equal_grown_runs(spark, monkeypatch, gaps, table):
    # Chunks of 64 words, so that pages span several.
    monkeypatch.setattr(search, "CHUNK_BITS", 6)
    pages = make_pages(7, [1, 2, 3, 5, 63, 64, 65, 200, 300] + [12] * 20, gaps)
    words = spark.createDataFrame([r for p in pages for r in p], WORDS)
    queries = as_given(spark, [*enumerate(QUERIES), (99, None), (98, " "), (97, "")], table)
    rows = search.phrase_search(words, queries, dense=not gaps).collect()
    got = {tuple(r) for r in rows}
    assert len(rows) == len(got)
    assert got == expected(pages)


@pytest.mark.parametrize("table", [False, True])
def test_each_row_of_queries_counts_under_its_id(spark, table):
    words = spark.createDataFrame(
        [(1, 0, n, t, 0.0, 0.0, 1.0, 1.0, 10.0, "A") for n, t in enumerate(["foo", "bar", "baz"])], WORDS
    )
    queries = as_given(spark, [(0, "foo"), (0, "baz"), (1, "bar"), (1, "BAR"), (2, None), (3, "zz")], table)
    hits = search.phrase_search(words, queries, dense=True).collect()
    assert sorted((r.query_id, r.i, r.j) for r in hits) == [
        (0, 0, 0), (0, 0, 2), (0, 1, 2), (0, 2, 2), (1, 0, 1), (1, 0, 1), (1, 1, 1), (1, 1, 1)]
    counts = search.search_counts(words, queries, dense=True).collect()
    assert sorted((r.query_id, r.n_hits) for r in counts) == [(0, 4), (1, 4)]


@pytest.mark.parametrize("table", [False, True])
def test_counts_report_what_is_requested(spark, table):
    words = spark.createDataFrame(
        [(1, 0, n, t, 0.0, 0.0, 1.0, 1.0, 10.0, "A") for n, t in enumerate(["foo", "bar", "baz"])], WORDS
    )
    asked = spark.createDataFrame([(q, 1, p) for q in (0, 1) for p in (0, 1)], "query_id int, doc_id long, page_idx int")
    queries = as_given(spark, [(0, "bar"), (1, "zz"), (2, "foo")], table)
    got = search.search_counts(words, queries, asked, dense=True).collect()
    assert {(r.query_id, r.page_idx, r.n_hits, r.status) for r in got} == {
        (0, 0, 2, "2 found"), (0, 1, 0, "No matches"), (1, 0, 0, "No matches"), (1, 1, 0, "No matches"),
    }


@pytest.mark.parametrize("table", [False, True])
def test_no_query_no_hits(spark, table):
    words = spark.createDataFrame([(1, 0, 0, "foo", 0.0, 0.0, 1.0, 1.0, 10.0, "A")], WORDS)
    none = as_given(spark, [], table)
    assert search.phrase_search(words, none).count() == 0
    assert search.search_counts(words, none).count() == 0


def test_gate(spark):
    qs = spark.createDataFrame([(0, "ab"), (1, "a"), (2, " "), (3, " \t"), (4, ""), (5, None), (6, "😀")], "query_id int, q string")
    ids = lambda df: sorted(r.query_id for r in df.collect())
    assert ids(search_gate(qs, "live")) == [0, 6]
    assert ids(search_gate(qs, "enter")) == [0, 1, 6]
    with pytest.raises(ValueError):
        search_gate(qs, "other")


def test_a_crowded_page_is_split(spark):
    """One page of all the words spreads over tasks by its chunks."""
    words = spark.range(50_000).selectExpr(
        "1L as doc_id", "0 as page_idx", "cast(id as int) as word_idx", "if(id % 1000 = 0, 'needle', 'hay') as text",
        "0D as left_pt", "0D as bottom_pt", "1D as right_pt", "1D as top_pt",
    )
    hits = search.phrase_search(words, [(0, "needle")], dense=True)
    assert hits.where("i = j").count() == 50
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert hits.select(F.spark_partition_id().alias("p")).distinct().count() > 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scaled_boxes_of_all_queries(spark, tmp_path):
    docs = [(d, " ".join(random.Random(d).choices(["the", "other", "of", "The", "hat", "that", "a", "X"], k=30 + 190 * (d % 3)))) for d in range(6)]
    docs[5] = (5, "the other of the " * 250)  # two pages
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    by: dict[tuple, list] = {}
    for w in Inputs(spark, str(tmp_path)).words.orderBy("doc_id", "page_idx", "word_idx").collect():
        by.setdefault((w.doc_id, w.page_idx), []).append(w)
    want = []
    for (d, p), ws in by.items():
        if (d + p) % 5:
            fx, fy, height = 2 ** (d % 3), 2 ** ((d + p) % 2 + 1), 792 * (1 + p % 2)
            for n, q in LIVE:
                for i, j in grow([w.text for w in ws], q):
                    left, right = min(w.left_pt for w in ws[i : j + 1]), max(w.right_pt for w in ws[i : j + 1])
                    low, top = min(w.bottom_pt for w in ws[i : j + 1]), max(w.top_pt for w in ws[i : j + 1])
                    want.append((n, d, p, i, j, left * fx, (height - top) * fy, max(4, (right - left) * fx), max(4, (top - low) * fy)))
    got = sorted(map(tuple, registered()["scaled_search_boxes_all"](spark, str(tmp_path)).collect()))
    assert {0, 1} < {r[0] for r in got} and len(got) == len(want)
    assert all(g[:5] == w[:5] and g[5:] == pytest.approx(w[5:]) for g, w in zip(got, sorted(want), strict=True))


def test_all_phrases_of_the_benchmark_are_searched(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["the", "hat", "of", "x"], k=k % 9 + 1)) for k in range(14)]
    docs = [(d, " ".join(rng.choices(["The", "hat", "of", "x"], k=120))) for d in range(4)]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    phrases = []
    for n, t in enumerate(texts):
        ws = t.split(" ")
        starts = list(range(0, max(len(ws) - 2, 1), 3))
        phrases += [(n, " ".join(ws[i:] if i == starts[-1] else ws[i : i + 3])) for i in starts]
    assert all(" ".join(q for m, q in phrases if m == n) == t for n, t in enumerate(texts))
    asked = Inputs(spark, str(tmp_path)).all_queries.collect()
    assert sorted((r.query_id, r.q) for r in asked if r.q is not None) == sorted(phrases)
    assert [r.query_id for r in asked if r.q is None] == [3, 10]
    want = sorted((n, d, i, j) for d, t in docs for n, q in phrases for i, j in grow(t.split(" "), q))
    hits = registered()["phrase_search_all"](spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r.doc_id, r.i, r.j) for r in hits) == want and {3, 10} <= {r[0] for r in want}
    counts = registered()["search_counts_all"](spark, str(tmp_path)).collect()
    assert {(r.query_id, r.doc_id): r.n_hits for r in counts} == {k: sum(w[:2] == k for w in want) for k in {w[:2] for w in want}}


def test_a_short_table_of_queries_shuffles_words_once(spark):
    words = spark.range(100).selectExpr(
        "id % 7 as doc_id", "0 as page_idx", "cast(id div 7 as int) as word_idx", "'x' as text",
        "0D as left_pt", "0D as bottom_pt", "0D as right_pt", "0D as top_pt",
    )
    queries = spark.createDataFrame([(2**40, "x x"), (1, "X"), (1, None), (3, " ")], "query_id long, q string")
    hits = search.phrase_search(words, queries, dense=True)
    assert hits._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert hits.schema["query_id"].dataType.simpleString() == "bigint"
    assert {(r.query_id, r.n) for r in hits.groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {(2**40, 93), (1, 100)}


@pytest.mark.parametrize("gaps", [False, True])
def test_long_tables_of_queries_have_the_same_hits(spark, monkeypatch, gaps):
    monkeypatch.setattr(search, "FEW", 0)
    test_hits_equal_grown_runs(spark, monkeypatch, gaps, True)


def test_candidates_of_a_phrase_come_from_its_rarest_token(spark):
    vocabulary = spark.createDataFrame([("the", 1000), ("longestword", 500), ("rare", 2), ("fare", 3)], "low string, freq long")
    terms = spark.createDataFrame([("the longestword rare", 20), ("gone the", 8), ("  are ", 6), ("are", 3)], "q string, n int")
    got = {tuple(r) for r in search._known_words(vocabulary, terms).collect()}
    assert got == {
        ("rare", "the longestword rare", 20, 2, 2), ("rare", "are", 3, 0, 0), ("fare", "are", 3, 0, 0),
    }


def test_sparse_chunks_look_ahead_over_one_another(spark, monkeypatch):
    """Chunks of 64 numbers with a word or two each: a run goes through many of them."""
    monkeypatch.setattr(search, "CHUNK_BITS", 6)
    rng = random.Random(3)
    at, rows = -1, []
    for _ in range(150):
        at += rng.choice([1, 40, 90, 200])
        rows.append((0, 0, at, rng.choice(VOCAB[:9]), *[float(rng.randint(0, 99)) for _ in range(4)], 10.0, "Arial"))
    words = spark.createDataFrame(rows, WORDS)
    got = [tuple(r) for r in search.phrase_search(words, [*enumerate(QUERIES)]).collect()]
    assert len(got) == len(set(got)) and set(got) == expected([rows])


def test_words_with_gaps_are_shuffled_once(spark):
    words = spark.range(100).selectExpr(
        "id % 7 as doc_id", "0 as page_idx", "cast(id as int) as word_idx", "'x' as text",
        "0D as left_pt", "0D as bottom_pt", "0D as right_pt", "0D as top_pt",
    )
    text = search.phrase_search(words, [(0, "x x"), (1, "y")])._jdf.queryExecution().executedPlan().toString()
    # Own words by chunk; numbers of words per chunk, per page; the few words that another chunk looks ahead to.
    shuffles = [line for line in text.split("\n") if "Exchange hashpartitioning" in line]
    assert len([line for line in shuffles if "chunk" in line]) <= 4 and "__block" not in text


@pytest.mark.parametrize("table", [False, True])
def test_placed_words_with_gaps_have_the_same_hits(spark, table):
    """Words of a page in one task: numbered there, whatever gaps they have, with the hits of words in any order."""
    rng = random.Random(11)
    rows = []
    for doc in range(5):
        at = -1
        for _ in range(rng.choice([1, 3, 60])):
            at += rng.choice([1, 1, 2, 5000])
            rows.append((doc, doc % 2, at, rng.choice(VOCAB[:9]), *[float(rng.randint(0, 99)) for _ in range(4)], 10.0, "Arial"))
    words = spark.createDataFrame(rows, WORDS)
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, q string") if table else [*enumerate(QUERIES)]
    want = sorted(map(tuple, search.phrase_search(words, queries).collect()))
    got = search.phrase_search(words.repartition(4, "doc_id"), queries, placed=True)
    assert sorted(map(tuple, got.collect())) == want and want
