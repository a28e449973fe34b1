from __future__ import annotations

import random
import zlib

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from quirelake.llm import language
from quirelake.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def model(spark):
    return language.learn(table(spark, SMALL.replace("0.001", "0.01"), "documents"))


def test_held_out_accuracy(spark, model):
    docs = table(spark, SMALL.replace("0.001", "0.01"), "documents")
    rows = language.report(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) / len(rows) < 0.01


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, "wort " * 30, "de" if zlib.crc32(str(i).encode()) % 4 == 2 else "en", "s", 1) for i in range(40)]
    assert [name for name, _ in language.learn(spark.createDataFrame(rows, DOCS))] == ["en"]


def test_odd_texts(spark, model):
    frame = spark.createDataFrame(
        [(0, None), (1, ""), (2, "123 ... !"), (3, "Of"), (4, "the " * 200_000), (4, "the " * 200_000), (None, "the of and")],
        "doc_id long, text string",
    )
    rows = language.report(frame, model).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 7
    assert all((by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True) for i in (0, 1, 2))
    assert by[3].lang_pred == "en" and not by[3].rejected  # a tie goes to the language seen most
    assert by[4].lang_pred == "en"


def test_ties_go_to_the_smaller_name(spark):
    same = [("b", b"one two three four "), ("a", b"one two three four ")]
    assert language.Classifier(same)("zzz yyy")[0] == "b"  # the order of the model, which counts, then names, make
    rows = [(i, "one two", "b" if i % 2 else "a", "s", 1) for i in (0, 1, 2, 4, 7, 9) if zlib.crc32(str(i).encode()) % 4 != 2]
    names = [n for n, _ in language.learn(spark.createDataFrame(rows, DOCS))]
    counts = {x: sum(r[2] == x for r in rows) for x in names}
    assert names == sorted(names, key=lambda n: (-counts[n], n))


def test_filter_keeps_columns_and_empty_tables(spark, model, docs):
    frame = docs("the and of the thing", None, extra="rejected")
    kept = language.keep_identified(frame, model)
    assert kept.columns == frame.columns and [r.doc_id for r in kept.collect()] == [0]
    empty = frame.limit(0)
    assert language.learn(empty) == [] and language.keep_identified(empty).count() == 0
    assert language.report(docs("abc"), []).select(F.col("lang_pred")).first()[0] == "und"


def test_unlearned_text_is_rejected_and_learned_text_stays(spark):
    docs = table(spark, SMALL.replace("0.001", "0.1"), "documents")  # enough to fill the dictionaries
    model = language.learn(docs)
    texts = [(r.lang, language.letters(r.text).decode()) for r in docs.where(language.held_out(F.col("doc_id"))).limit(800).collect()]
    share = lambda judge, some: sum(judge(t)[2] for t in some) / len(some)
    whole = language.Classifier(model)
    for chars, least in ((None, 0.8), (300, 0.6), (150, 0.6)):
        some = [(lang, t[:chars]) for lang, t in texts if len(t) >= (chars or 40)]
        assert share(whole, [t for _, t in some]) < 0.02
        left = 0.0
        for name, _ in model:
            own = [t for lang, t in some if lang == name]
            left += share(language.Classifier([m for m in model if m[0] != name]), own) / len(model)
        assert left > least, chars
    rng = random.Random(4)
    for words in (10, 50, 400):
        noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(words)) for _ in range(100)]
        assert share(whole, noise) > 0.9, words


def test_numbers_are_no_letters():
    assert language.letters("½² ① Ⅻ 12 _") == b"" and language.letters("a½b ②") == b"ab " and language.letters("É x2") == "é x ".encode()
    assert language.Classifier([("en", b"the and of " * 50)])("½² ①") == (language.UNKNOWN, 0.0, True)
