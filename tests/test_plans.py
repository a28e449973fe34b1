"""What the plans of the registered queries must not contain."""

from __future__ import annotations

import pytest
from conftest import SMALL

from quirelake.catalog.queries import registered

# These write and read files on the way; what they return is a scan.
EAGER = {
    "annotation_state_stream", "search_stream", "corpus_roundtrip", "resaved_corpus", "burned_corpus", "read_documents", "pdf_inventory",
    "signature_roundtrip", "signature_array_roundtrip", "annotation_state",
}
LAZY = sorted(set(registered()) - EAGER)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("broadcast", ["-1", "10MB"])
def test_no_products_no_python_no_single_partition(spark, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        for name in LAZY:
            text = plan(registered()[name](spark, SMALL))
            for bad in ("CartesianProduct", "BroadcastNestedLoop", "SinglePartition", "Python", "BatchEvalPython"):
                assert bad not in text, f"{bad} in {name}"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scans_read_only_what_is_needed(spark):
    text = plan(registered()["page_inventory"](spark, SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    text = plan(registered()["undo_last"](spark, SMALL))
    assert "props" not in text and "value" not in text


def test_counting_hits_shuffles_words_once(spark):
    """Words by chunk, then one pre-aggregated row per page."""
    from quirelake.operators.search import search_counts

    words = spark.range(100).selectExpr(
        "id % 7 as doc_id", "0 as page_idx", "cast(id div 7 as int) as word_idx", "'x' as text",
        "0D as left_pt", "0D as bottom_pt", "0D as right_pt", "0D as top_pt",
    )
    text = plan(search_counts(words, [(0, "x x"), (1, "y")], dense=True))
    assert text.count("Exchange hashpartitioning") == 2
    # Bounds are not computed for counts.
    assert "left_pt" not in text


def test_only_the_text_stage_is_shuffled_for_page_text(spark):
    text = plan(registered()["page_text"](spark, SMALL))
    assert "left_pt" not in text and "font_name" not in text


def test_some_documents_are_read_from_their_folders(spark, tmp_path):
    from quirelake.sources import corpus as C
    from quirelake.sources.layout import layout_text

    docs = spark.range(50).selectExpr("id as doc_id", "repeat('word ', 500) as text")
    pages, words = layout_text(docs)
    none = spark.createDataFrame([], "doc_id long")
    C.write_corpus(C.Corpus(pages, words, none, none), str(tmp_path), buckets=8)
    wanted = spark.createDataFrame([(3,), (3,), (999,)], "doc_id long")
    read = C.read_corpus(spark, str(tmp_path), wanted, buckets=8)
    text = plan(read.words)
    assert "PartitionFilters: [doc_bucket" in text
    assert {r.doc_id for r in read.words.collect()} == {3} and read.pages.count() == 2
    assert read.words.count() == 500


def assert_words_of_named_documents(spark, name: str):
    """All words that are matched arise above a join of documents: none of another document is shuffled."""
    text = registered()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    laid = text.split("Generate posexplode")[1:]
    assert laid and all("LeftSemi" in below.split("Generate")[0] or "LeftAnti" in below.split("Generate")[0] for below in laid), text


@pytest.mark.parametrize("name", ["edit_target", "nearest_line", "line_at_point", "scaled_line_at_point"])
def test_words_of_other_documents_do_not_meet_clicks(spark, name):
    assert_words_of_named_documents(spark, name)


@pytest.mark.parametrize("name", ["region_text", "words_in_region", "scaled_words_in_region"])
def test_words_of_other_documents_do_not_meet_regions(spark, name):
    assert_words_of_named_documents(spark, name)


def test_only_words_of_edited_documents_meet_edits(spark):
    assert_words_of_named_documents(spark, "visible_words")
