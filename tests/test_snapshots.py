"""Corpora change as a whole: lost writers, two writers, saves over what was read, versions that go."""

from __future__ import annotations

import pytest

from quirelake.plans import snapshots as S
from quirelake.sources import corpus as C
from quirelake.sources.layout import layout_text


def corpus(spark, said):
    docs = spark.createDataFrame([(d, said) for d in range(10)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    return C.Corpus(*layout_text(docs), none, none)


def said(spark, path):
    read = C.read_corpus(spark, path)
    assert {r.doc_id for r in read.pages.collect()} == {r.doc_id for r in read.words.collect()}
    return {r.text for r in read.words.select("text").distinct().collect()}


def test_a_writer_lost_at_any_step_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    assert C.write_corpus(corpus(spark, "old"), path) == 1
    write, publish = C._write_bucketed, S._publish

    def lost(*_, **__):
        raise RuntimeError("lost")

    steps = []

    def until(n):
        def step(*args, **kw):
            steps.append(n)
            if len(steps) > n:
                lost()
            write(*args, **kw)

        return step

    for n in range(2):  # lost before pages, before words
        steps.clear()
        monkeypatch.setattr(C, "_write_bucketed", until(n))
        with pytest.raises(RuntimeError):
            C.write_corpus(corpus(spark, "new"), path)
        assert said(spark, path) == {"old"}
    monkeypatch.setattr(C, "_write_bucketed", write)
    monkeypatch.setattr(S, "_publish", lost)  # lost with all tables written
    with pytest.raises(RuntimeError):
        C.write_corpus(corpus(spark, "new"), path)
    assert said(spark, path) == {"old"}
    monkeypatch.setattr(S, "_publish", publish)
    (tmp_path / "c" / "_manifests" / "_half").write_text('{"vers')  # lost while writing the manifest
    assert said(spark, path) == {"old"}
    assert C.write_corpus(corpus(spark, "new"), path) == 2 and said(spark, path) == {"new"}


def test_a_corpus_is_saved_over_itself(spark, tmp_path):
    path = str(tmp_path)
    C.write_corpus(corpus(spark, "a b"), path)
    opened = C.read_corpus(spark, path)
    more = C.Corpus(opened.pages, opened.words.where("text = 'b'"), opened.annotations, opened.render_dims)
    C.write_corpus(more, path)
    assert said(spark, path) == {"b"} and opened.words.count() == 20  # what was opened is still there


def test_the_second_of_two_writers_is_told(spark, tmp_path):
    path = str(tmp_path)
    base = C.write_corpus(corpus(spark, "one"), path)
    C.write_corpus(corpus(spark, "two"), path, base=base)
    with pytest.raises(S.Conflict):
        C.write_corpus(corpus(spark, "three"), path, base=base)
    assert said(spark, path) == {"two"}


def test_a_wrong_number_of_buckets_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "c")
    C.write_corpus(corpus(spark, "x"), path, buckets=8)
    wanted = spark.range(10).withColumnRenamed("id", "doc_id")
    assert C.read_corpus(spark, path, wanted).words.count() == 10
    with pytest.raises(ValueError):
        C.read_corpus(spark, path, wanted, buckets=64)
    plain = str(tmp_path / "plain")
    for name in ("pages", "words"):
        getattr(corpus(spark, "y"), name).write.parquet(f"{plain}/{name}")
    assert C.read_corpus(spark, plain, wanted.where("doc_id < 3"), buckets=8).words.count() == 3


def test_old_versions_go(spark, tmp_path):
    path = str(tmp_path)
    for text in ("one", "two", "three"):
        C.write_corpus(corpus(spark, text), path)
    (tmp_path / "words" / "version=lost").mkdir()
    C.vacuum_corpus(spark, path, keep=2)
    assert len(list((tmp_path / "words").glob("version=*"))) == 3 and len(list((tmp_path / "_manifests").glob("*.json"))) == 2
    C.vacuum_corpus(spark, path, orphan_age=-1)
    assert [p.name for p in (tmp_path / "words").glob("version=*")] == [f"version={S.current(spark, path)['version']}"]
    assert said(spark, path) == {"three"} and C.read_draws(spark, path).count() == 0
    with pytest.raises(ValueError):
        C.vacuum_corpus(spark, path, keep=0)
    assert C.write_corpus(corpus(spark, "four"), path) == 4 and said(spark, path) == {"four"}
