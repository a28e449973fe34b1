"""Registered queries lay words out where they are worked on."""

from __future__ import annotations

import json
import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from quirelake.catalog import queries
from quirelake.schemas import WORDS
from quirelake.sources import corpus, layout
from quirelake.streaming.search import ARRIVING_PAGES, arriving_words

SHUFFLE = re.compile(r"Exchange (?:hash|range|single|rebalance)\w*.*")


@pytest.mark.parametrize(
    "name",
    ["page_text", "search_boxes", "scaled_search_boxes_all", "group_lines", "line_bounds", "reading_order", "left_to_right"],
)
def test_words_are_not_shuffled(spark, name):
    """Only texts are: whatever is grouped or joined by document, page or finer stays in its task."""
    plan = queries.registered()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    shuffles = SHUFFLE.findall(plan)
    assert shuffles and all("REPARTITION_BY_NUM" in s for s in shuffles), shuffles


def test_whole_pages_hold_the_same_words(spark):
    """Pages arrive as rows without a shuffle; blank and null texts have none."""
    texts = [(1, " ".join(f"w{n}" for n in range(1000))), (2, "a \n b"), (3, " \n"), (4, None), (5, " ".join("x" * 400)), (6, "")]
    documents = spark.createDataFrame(texts, "doc_id long, text string")
    whole = layout.layout_whole_pages(documents)
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    got = arriving_words(spark.createDataFrame(whole.rdd, ARRIVING_PAGES)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, layout.layout_words(documents).collect()), key=str)
    assert len(got) == 1402


@pytest.mark.parametrize("name", ["corpus_roundtrip", "read_documents", "resaved_corpus"])
def test_laid_out_words_are_saved_without_a_shuffle(spark, name, monkeypatch):
    """Only the second save of ``resaved_corpus``, of words that have been joined, deals words out."""
    frame = type(spark.range(0))
    hints, real = [], frame.hint
    monkeypatch.setattr(frame, "hint", lambda df, *a: hints.append(a) or real(df, *a))
    assert queries.registered()[name](spark, SMALL).count() > 0
    assert len(hints) == (2 if name == "resaved_corpus" else 0)


def test_gathered_documents_are_saved_like_others(spark, tmp_path):
    documents = spark.range(300).selectExpr("id as doc_id", "repeat(concat('w', id, ' '), cast(id * 7 % 900 as int)) as text")
    texts = corpus.by_bucket(documents, tasks=20, buckets=8)
    saved = {}
    for name, rows in (("plain", documents), ("gathered", texts)):
        words = layout.layout_words(rows)
        made = corpus.Corpus(layout.layout_pages(rows), words, None, None)
        corpus.write_corpus(made, f"{tmp_path}/{name}", buckets=8, gathered=name == "gathered")
        read = corpus.read_corpus(spark, f"{tmp_path}/{name}")
        saved[name] = [sorted(map(str, t.collect())) for t in (read.pages, read.words)]
    assert saved["plain"] == saved["gathered"]
    # A bucket of three parts has three files at most, each in order.
    for folder in tmp_path.glob("gathered/words/version=*/doc_bucket=*"):
        files = list(folder.glob("*.parquet"))
        assert len(files) <= 3
        for f in files:
            keys = [tuple(r) for r in spark.read.parquet(str(f)).coalesce(1).select("doc_id", "page_idx", "word_idx").collect()]
            assert keys == sorted(keys)


def test_saved_words_are_read_and_saved_again_without_a_shuffle(spark, monkeypatch):
    """Both joins of ``resaved_corpus`` leave words where they lie; only pages are dealt out."""
    frame = type(spark.range(0))
    hints, real = [], frame.hint
    monkeypatch.setattr(frame, "hint", lambda df, *a: hints.append(a) or real(df, *a))
    mapped, real_map = [], queries.pages.apply_page_map
    monkeypatch.setattr(queries.pages, "apply_page_map", lambda *a: mapped.append(real_map(*a)) or mapped[-1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        final = queries.registered()["resaved_corpus"](spark, SMALL)
        for df in (mapped[0], final):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert SHUFFLE.findall(plan) and "Bucketed: true" in plan and "Exchange" not in above_scan_of(plan, "text#")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(hints) == [("rebalance", "doc_bucket"), ("shuffle_hash",)]


def above_scan_of(plan: str, column: str) -> str:
    """What lies on one side of a join, down to the scan that reads ``column``."""
    lines = plan.split("\n")
    at = next(n for n, line in enumerate(lines) if "FileScan" in line and column in line)
    join = max(n for n in range(at) if "Join" in lines[n])
    return "\n".join(lines[join + 1 : at])


@pytest.mark.parametrize("laid", ["by part", "anywhere", "as int"])
def test_words_saved_by_parts_are_all_found(spark, tmp_path, laid):
    """Also those that lie elsewhere, and ids of another width; some documents are read from their folders."""
    documents = spark.range(300).selectExpr("id as doc_id", "repeat(concat('w', id, ' '), cast(id * 7 % 900 as int)) as text")
    documents = documents.withColumn("doc_id", F.col("doc_id").cast("int" if laid == "as int" else "long"))
    texts = documents.repartition(3) if laid == "anywhere" else corpus.by_bucket(documents, tasks=20, buckets=8)
    words, pages = layout.layout_words(texts), layout.layout_pages(texts)
    corpus.write_corpus(corpus.Corpus(pages, words, None, None), f"{tmp_path}/it's", buckets=8, gathered=True, parts=corpus.parts_of(20, 8))
    read = corpus.read_corpus(spark, f"{tmp_path}/it's")
    assert read.words.schema == WORDS and not [t for t in spark.catalog.listTables() if t.name.startswith("corpus_")]
    names = ["doc_id", "page_idx", "word_idx", "text", "top_pt"]
    want = sorted(map(tuple, words.select(names).collect()))
    assert sorted(map(tuple, read.words.select(names).collect())) == want
    joined = read.words.join(read.pages, ["doc_id", "page_idx"])
    assert sorted(map(tuple, joined.select(names).collect())) == want
    some = corpus.read_corpus(spark, f"{tmp_path}/it's", spark.createDataFrame([(7,), (8,)], "doc_id long")).words
    assert sorted(map(tuple, some.select(names).collect())) == [w for w in want if w[0] in (7, 8)]


def test_folders_of_older_corpora_are_found(spark, tmp_path):
    """Manifests without ``hashed`` name folders by XXH64."""
    documents = spark.range(40).selectExpr("id as doc_id", "concat('a b ', id) as text")
    made = corpus.Corpus(layout.layout_pages(documents), layout.layout_words(documents), None, None)
    corpus._bucket, now = (lambda buckets, hashed="xxhash64": now(buckets, hashed)), corpus._bucket
    try:
        corpus.write_corpus(made, str(tmp_path), buckets=8)
    finally:
        corpus._bucket = now
    manifest = next((tmp_path / "_manifests").glob("0*.json"))
    facts = json.loads(manifest.read_text())
    del facts["hashed"], facts["parts"]
    manifest.write_text(json.dumps(facts))
    for crc in (tmp_path / "_manifests").glob(".*.crc"):
        crc.write_bytes(b"")
    wanted = spark.createDataFrame([(3,), (5,)], "doc_id long")
    assert corpus.read_corpus(spark, str(tmp_path), wanted).words.count() == 6
    assert corpus.read_corpus(spark, str(tmp_path)).words.count() == 120


@pytest.mark.parametrize("name", ["phrase_search_all", "search_counts_all"])
def test_words_stay_where_many_phrases_are_looked_for(spark, name):
    """Texts are dealt out once for all looks at words; candidates, matches and runs of words stay with them."""
    plan = queries.registered()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    shuffles = SHUFFLE.findall(plan)
    assert shuffles and all("REPARTITION_BY_NUM" in s for s in shuffles), shuffles


def test_words_with_gaps_stay_where_they_are_searched(spark):
    """The join with the edits leaves words where texts were dealt to; they are numbered and searched there."""
    plan = queries.registered()["phrase_search_gaps"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in re.split(r"REPARTITION_BY_NUM", plan)[0].split("Join")[0]
    shuffles = [s for s in SHUFFLE.findall(plan) if "REPARTITION_BY_NUM" not in s]
    # Beside texts only boxes of edits are dealt out.
    assert len(shuffles) <= 1 and "Union" not in plan, shuffles
