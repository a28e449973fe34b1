"""Files in and out, and streams over files."""

from __future__ import annotations

import json

from quirelake.catalog import queries
from quirelake.operators.search import phrase_search
from quirelake.schemas import ANNOTATIONS, PAGES, RENDER_DIMS, SIGNATURES, WORDS
from quirelake.sources import corpus as C
from quirelake.sources.layout import layout_text
from quirelake.sources.signatures import read_signatures, write_signatures
from quirelake.streaming.search import ARRIVING_PAGES, search_stream


def test_saved_signatures(spark, tmp_path):
    saved = [{"Id": "s1", "Name": "Signature 1", "Strokes": [[{"X": 0, "Y": 0}, {"X": 10, "Y": 5}]], "CanvasWidth": 400, "CanvasHeight": 150}]
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps(saved, indent=2))
    bad.write_text('[{"Id": "s1", ')
    (r,) = read_signatures(spark, str(good)).collect()
    assert (r.id, r.name, [[tuple(p) for p in s] for s in r.strokes], r.canvas_w) == ("s1", "Signature 1", [[(0, 0), (10, 5)]], 400)
    assert read_signatures(spark, str(bad)).count() == 0
    bad.write_text(json.dumps(saved)[:-1] + ', {"Id": "s2"')
    assert read_signatures(spark, str(bad)).count() == 0
    assert read_signatures(spark, str(tmp_path / "none.json")).count() == 0


def test_a_list_that_is_not_altogether_right_is_empty(spark, tmp_path):
    good = [{"Id": "s1", "Name": "n", "Strokes": [[{"X": 0, "Y": 0.5}]], "CanvasWidth": 4, "CanvasHeight": None}, {"Id": "s2", "More": 1}]
    path = tmp_path / "list.json"

    def read(text):
        path.write_text(text)
        return sorted(r.id for r in read_signatures(spark, str(path)).collect())

    assert read(json.dumps(good)) == ["s1", "s2"] and read("[]") == []
    change = lambda **kw: json.dumps([good[1], {**good[0], **kw}])
    for text in (
        change(CanvasWidth="wide"), change(Strokes=[[{"X": "a", "Y": 0}]]), change(Id=7), change(Strokes={}), change(CanvasWidth=True),
        json.dumps(good) + " more", json.dumps(good) + "[]", json.dumps(good[0]), "", "null", "[1]", "[NaN]", json.dumps(good)[:-1],
    ):
        assert read(text) == [], text


def test_a_broken_line_empties_its_file(spark, tmp_path):
    (tmp_path / "a").write_text('{"Id": "s1"}\n{"Id": "s2", \n')
    (tmp_path / "b").write_text('{"Id": "s3"}\n')
    assert [r.id for r in read_signatures(spark, str(tmp_path), lines=True).collect()] == ["s3"]


def test_a_lost_writer_leaves_a_list(spark, tmp_path):
    path = tmp_path / "list"
    one = spark.createDataFrame([("a", "A", [[(1.0, 2.0)]], 4.0, 5.0)], SIGNATURES)
    write_signatures(one, str(path))
    path.rename(tmp_path / "list.old")  # lost between the two moves
    assert [r.id for r in read_signatures(spark, str(path), lines=True).collect()] == ["a"]
    write_signatures(one.withColumn("id", C.F.lit("b")), str(path))
    assert [r.id for r in read_signatures(spark, str(path), lines=True).collect()] == ["b"]
    assert not (tmp_path / "list.old").exists()


def test_signature_list_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "list")
    one = spark.createDataFrame([("a", "A", [[(1.0, 2.0)]], 4.0, 5.0)], SIGNATURES)
    write_signatures(one, path)
    # Reading from the list that is being replaced is fine.
    again = read_signatures(spark, path, lines=True)
    write_signatures(again.unionByName(again.withColumn("id", C.F.lit("b"))), path)
    assert sorted(r.id for r in read_signatures(spark, path, lines=True).collect()) == ["a", "b"]
    write_signatures(read_signatures(spark, path, lines=True).where("id = 'b'"), path)
    (r,) = read_signatures(spark, path, lines=True).collect()
    assert (r.id, tuple(r.strokes[0][0]), r.canvas_h) == ("b", (1.0, 2.0), 5.0)


def test_inventory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.pdf", "sub/b.PDF", "c.txt"):
        (tmp_path / name).write_bytes(b"12345")
    files = C.pdf_inventory(spark, str(tmp_path))
    assert sorted((r.path.rsplit("/", 1)[1], r.length) for r in files.collect()) == [("a.pdf", 5), ("b.PDF", 5)]
    assert files.columns == ["path", "length", "modified"]


def test_corpus_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "  one two\nthree "), (2, ""), (3, "x " * 401), (4, " \n"), (5, None)], "doc_id long, text string")
    pages, words = layout_text(docs)
    assert {(r.doc_id, r.page_idx) for r in pages.collect()} == {(1, 0), (3, 0), (3, 1)}
    assert words.count() == 404
    blank = dict.fromkeys(ANNOTATIONS.fieldNames())
    note = {**blank, "doc_id": 1, "page_idx": 0, "seq": 1, "kind": "highlight", "rect": (0.0, 0.0, 9.0, 9.0), "rgba": (1, 2, 3, 4)}
    annotations = spark.createDataFrame([tuple(note.values())], ANNOTATIONS)
    dims = spark.createDataFrame([(1, 0, 1224, 1584)], RENDER_DIMS)
    corpus = C.Corpus(pages, words, annotations, dims)
    C.write_corpus(corpus, str(tmp_path / "plain"), buckets=4)
    assert not (tmp_path / "plain" / "draw_ops").exists()
    C.write_corpus(corpus, str(tmp_path / "burned"), burned=True, buckets=4)
    assert spark.read.parquet(str(tmp_path / "burned" / "draw_ops")).count() == 1
    back = C.read_corpus(spark, str(tmp_path / "burned"))
    assert back.annotations.count() == 0 and back.render_dims.count() == 0
    assert back.words.schema == WORDS and back.pages.schema == PAGES
    key = lambda df, cols: sorted(tuple(r) for r in df.select(*cols).collect())
    assert key(back.words, ["doc_id", "page_idx", "word_idx", "text"]) == key(words, ["doc_id", "page_idx", "word_idx", "text"])
    assert key(back.pages, PAGES.fieldNames()) == key(pages, PAGES.fieldNames())


def test_each_arriving_page_is_searched_once(spark, tmp_path):
    queries = spark.createDataFrame([(0, "of the")], "query_id int, q string")
    word = lambda t: (t, 0.0, 0.0, 1.0, 1.0, 10.0, "A")
    for batch in range(2):
        page = (batch, 0, [word("of"), word("them"), word("x")])
        spark.createDataFrame([page], ARRIVING_PAGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(ARRIVING_PAGES).parquet(f"{tmp_path}/in")
        search_stream(stream, queries, f"{tmp_path}/hits", f"{tmp_path}/state", availableNow=True).awaitTermination()
    hits = spark.read.parquet(f"{tmp_path}/hits").collect()
    assert sorted((r.doc_id, r.i, r.j) for r in hits) == [(0, 0, 1), (1, 0, 1)]


def test_search_of_read_words(spark):
    docs = spark.createDataFrame([(1, "Foo bar baz")], "doc_id long, text string")
    _, words = layout_text(docs)
    queries = spark.createDataFrame([(0, "bar")], "query_id int, q string")
    assert sorted((r.i, r.j) for r in phrase_search(words, queries).collect()) == [(0, 1), (1, 1)]


def test_lists_of_signatures_stay_small(spark, tmp_path, monkeypatch):
    events = spark.range(20_000).selectExpr("id as event_id", "id % 9 as user_id", "'error' as event_type")
    events.write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(queries, "new_path", lambda spark, name: f"{tmp_path}/{name}")
    got = {r.id for r in queries.registered()["signature_array_roundtrip"](spark, str(tmp_path)).collect()}
    assert got == {f"s{i}" for i in range(20_000)}
    files = list((tmp_path / "signature-arrays").rglob("*.txt"))
    held = [f.read_text().count('"Id"') for f in files]
    assert max(held) == 1000 and sum(held) == 22_500 and len(files) == 27


def test_deep_nesting_is_no_list_of_signatures(spark, tmp_path):
    (tmp_path / "deep.json").write_text("[" * 200_000)
    assert read_signatures(spark, str(tmp_path / "deep.json")).count() == 0
