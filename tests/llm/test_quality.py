from __future__ import annotations

import zlib

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from quirelake.llm import quality as q
from quirelake.llm.common import table

SF = SMALL.replace("0.001", "0.01")


@pytest.fixture(scope="module")
def rows(spark):
    return q.scored(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()


def test_held_out_accuracy(spark, rows):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    test = [r for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert sum(r.predicted == labels[r.doc_id] for r in test) / len(test) > 0.95
    good = [r for r in test if labels[r.doc_id] == 1]
    assert sum(r.predicted for r in good) / len(good) > 0.95
    assert len(rows) == table(spark, SF, "documents").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_held_out_labels_teach_nothing(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    lies = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    stats = q.statistics(docs)
    assert sorted(q.sample(stats, labels).collect()) == sorted(q.sample(stats, lies).collect())


def test_statistics_of_odd_texts(spark, docs):
    got = {r.doc_id: r for r in q.statistics(docs(None, "", "A b. a!\nA b. a!", "x" * 300_000, extra="marks")).collect()}
    assert got[0][1:] == got[1][1:] and got[0].log_chars == 0 and got[0].distinct_words == 0
    assert got[2].distinct_words == pytest.approx(2 / 6) and got[2].distinct_lines == 0.5 and got[2].upper == pytest.approx(2 / 15)
    assert got[3].word_length == 300_000


def test_rules_are_paths_with_one_bound_per_side():
    assert q._tight((("a", True, 3.0), ("a", True, 2.0), ("b", False, 1.0), ("a", False, 0.5), ("b", False, 2.0))) == (
        ("a", False, 0.5), ("a", True, 2.0), ("b", False, 2.0))


def test_compiled_score(spark):
    frame = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    model = q.Ensemble([(2.0, (("a", True, 2.0), ("b", False, 4.0)))], -1.0)
    assert [r[0] for r in frame.select(model.score()).collect()] == pytest.approx([0.7310586, 0.2689414])


def test_without_labels_or_with_one_class(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in q.scored(docs("a", None), none).collect()] == [0.5, 0.5]
    ones = spark.createDataFrame([(i, 1, 0) for i in range(8)] + [(9, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in q.scored(docs(*"abcdefgh"), ones).collect()} == {1.0}
    assert q.scored(docs("a").limit(0), none).count() == 0
