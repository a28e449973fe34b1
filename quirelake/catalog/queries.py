"""The registered queries: every operator over the whole of its inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quirelake.catalog.inputs import LIVE, Inputs
from quirelake.functions import geometry as geo
from quirelake.functions import text as txt
from quirelake.operators import annotations as ann
from quirelake.operators import drawing as draw
from quirelake.operators import edits
from quirelake.operators import filters as flt
from quirelake.operators import lines, pages, search, spatial
from quirelake.plans.lineage import cut_lineage, new_path
from quirelake.schemas import ANNOT_EVENTS, PAGES, K
from quirelake.sources import corpus as src
from quirelake.sources.signatures import as_json, read_signatures, write_signatures
from quirelake.streaming import annotation_state as ann_stream
from quirelake.streaming import search as page_stream

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

RECT = "xywh"
BOX = ("left_pt", "bottom_pt", "right_pt", "top_pt")
#: Most signatures in a list.
LISTED = 1000
SIZES = ("width_pt", "height_pt", "render_w", "render_h")


def _cols(names) -> list:
    return [F.col(c) for c in names]


def query(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    _QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
    return fn


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


def _fields(struct: str, names: str = "xywh") -> list:
    return [F.col(f"{struct}.{c}").alias(c) for c in names]


def _points(exploded: DataFrame, keys: list) -> DataFrame:
    return exploded.select(*keys, "i", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


# --- sources and sinks -----------------------------------------------------------------------


@query
def layout_text(t: Inputs) -> DataFrame:
    return t.words


def _save(t: Inputs, path: str, burned: bool = False) -> None:
    corpus = src.Corpus(t.bucketed_pages, t.bucketed_words, t.annotations, t.dims)
    src.write_corpus(corpus, path, burned=burned, gathered=True, parts=t.parts)


@query
def corpus_roundtrip(t: Inputs) -> DataFrame:
    path = new_path(t.spark, "corpus")
    _save(t, path)
    saved = src.read_corpus(t.spark, path)
    return saved.words.join(saved.pages, K).select(*K, "word_idx", "text", "left_pt", "top_pt", "height_pt")


@query
def burned_corpus(t: Inputs) -> DataFrame:
    path = new_path(t.spark, "burned")
    _save(t, path, burned=True)
    return _flat(src.read_draws(t.spark, path))


@query
def resaved_corpus(t: Inputs) -> DataFrame:
    """A third of the pages deleted, and the corpus saved over the one it was read from."""
    path = new_path(t.spark, "corpus")
    _save(t, path)
    saved = src.read_corpus(t.spark, path)
    left = pages.delete_pages(saved.pages, saved.pages.where("page_idx % 3 = 1"))
    # Words are saved where they were read: they meet the page map there, unsorted.
    words = pages.apply_page_map(saved.words, left.hint("shuffle_hash"))
    src.write_corpus(src.Corpus(left.select(*PAGES.names), words, saved.annotations, saved.render_dims), path, parts=t.parts)
    again = src.read_corpus(t.spark, path)
    return again.words.join(again.pages, K).select(*K, "word_idx", "text", "top_pt", "height_pt")


@query
def read_documents(t: Inputs) -> DataFrame:
    """Some documents of a written corpus, read from the folders that hold them."""
    path = new_path(t.spark, "corpus")
    _save(t, path)
    wanted = t.documents.where("doc_id % 97 = 5").select("doc_id")
    return src.read_corpus(t.spark, path, wanted).words.select(*K, "word_idx", "text")


@query
def pdf_inventory(t: Inputs) -> DataFrame:
    """Bytes below each folder of texts that Spark has written, from the listing alone."""
    path = new_path(t.spark, "inventory")
    t.documents.select("source", "text").write.partitionBy("source").text(path)
    files = src.pdf_inventory(t.spark, path, extension=".TXT")
    folder = F.element_at(F.split("path", "/"), -2)
    return files.groupBy(folder.alias("folder")).agg(F.sum("length").alias("n_bytes"))


@query
def select_files(t: Inputs) -> DataFrame:
    path = (
        "concat(source, '/', doc_id, case doc_id % 4 when 0 then '.pdf' when 1 then '.PDF'"
        " when 2 then '.pdf.bak' else '.txt' end) as path"
    )
    return src.select_files(t.documents.selectExpr(path, "n_chars as length"))


@query
def triage_failures(t: Inputs) -> DataFrame:
    message = (
        "case event_id % 5 when 0 then concat('Invalid PASSWORD on ', event_type)"
        " when 1 then 'file is Encrypted' when 2 then concat(event_type, ': Protected document')"
        " when 3 then 'unexpected end of file' end as message"
    )
    return src.triage_failures(t.events.selectExpr("event_id", message))


@query
def page_inventory(t: Inputs) -> DataFrame:
    return src.page_inventory(t.pages)


@query
def signature_roundtrip(t: Inputs) -> DataFrame:
    path = new_path(t.spark, "signatures")
    write_signatures(t.signatures, path)
    saved = read_signatures(t.spark, path, lines=True)
    return saved.select(
        "id", "name", "canvas_w", "canvas_h",
        F.to_json("strokes").alias("strokes"),
    )


@query
def signature_array_roundtrip(t: Inputs) -> DataFrame:
    """Lists of signatures as one JSON array per file; copies of those of one shard, cut short, stand beside them and count as empty."""
    path = new_path(t.spark, "signature-arrays")
    event = "cast(substring(id, 2) as long)"
    # A list never holds more than LISTED signatures: larger tables make more of them.
    keys = [F.expr(f"{event} % 8").alias("shard"), F.expr(f"{event} div {8 * LISTED}").alias("block")]
    lists = t.signatures.groupBy(*keys).agg(F.collect_list(as_json(F.struct("*"))).alias("rows"))
    text = F.concat(F.lit("[\n"), F.array_join("rows", ",\n"), F.lit("]"))
    cut = F.substring(text, F.lit(1), F.length(text) - 1)
    kinds = F.when(F.col("shard") == 5, F.array(F.struct("shard", text.alias("value")), F.struct((F.col("shard") + 8).alias("shard"), cut.alias("value"))))
    kinds = kinds.otherwise(F.array(F.struct("shard", text.alias("value"))))
    # A folder for each list, and one file in it.
    lists.select("block", F.inline(kinds)).write.option("lineSep", "\n\n").partitionBy("shard", "block").text(path)
    saved = read_signatures(t.spark, path)
    return saved.select(
        F.expr("cast(substring(id, 2) as long) % 8").alias("shard"), "id", "canvas_w", "canvas_h",
        F.expr("cast(aggregate(strokes, 0, (n, s) -> n + size(s)) as int)").alias("n_points"),
    )


# --- column functions ------------------------------------------------------------------------


@query
def page_to_canvas(t: Inputs) -> DataFrame:
    placed = t.words.join(spatial.page_scales(t.pages, t.dims), K)
    r = geo.page_to_canvas(*_cols(BOX + SIZES))
    return placed.withColumn("r", r).select(*K, "word_idx", *_fields("r"))


@query
def canvas_to_page(t: Inputs) -> DataFrame:
    placed = t.regions.join(spatial.page_scales(t.pages, t.dims), K)
    b = geo.canvas_to_page(*_cols(RECT), *_cols(SIZES))
    return placed.withColumn("b", b).select(
        "region_id", *[F.col(f"b.{c}").alias(c) for c in ("left", "bottom", "right", "top")]
    )


@query
def highlight_box(t: Inputs) -> DataFrame:
    marks = t.annotations.where("kind = 'highlight'").select(*K, "seq", "rect")
    placed = marks.join(spatial.page_scales(t.pages, t.dims), K)
    placed = placed.withColumn("b", geo.canvas_to_page(*[F.col(f"rect.{c}") for c in RECT], *_cols(SIZES)))
    on_page = [F.col(f"b.{c}") for c in ("left", "bottom", "right", "top")]
    r = geo.highlight_box(geo.page_to_canvas(*on_page, *_cols(SIZES)))
    return placed.withColumn("r", r).select("seq", *_fields("r"))


@query
def normalise_drag(t: Inputs) -> DataFrame:
    r = geo.normalise_drag(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    return t.drags.withColumn("r", r).select("drag_id", *_fields("r"))


@query
def clamp_points(t: Inputs) -> DataFrame:
    ink = t.annotations.where("kind = 'ink'")
    clamped = geo.clamp_points(F.col("points"), F.lit(500.0), F.lit(700.0))
    return _points(ink.select("seq", F.posexplode(clamped).alias("i", "p")), ["seq"])


@query
def normalise_font(t: Inputs) -> DataFrame:
    return t.words.select(*K, "word_idx", txt.normalise_font(F.col("font_name")).alias("font"))


@query
def edit_font_size(t: Inputs) -> DataFrame:
    placed = t.words.join(spatial.page_scales(t.pages, t.dims), K)
    sy = F.col("render_h") / F.col("height_pt")
    known = F.when(F.col("word_idx") % 3 > 0, F.col("font_size") / 2)
    height = (F.col("top_pt") - F.col("bottom_pt")) * sy * (1 + F.col("word_idx") % 2) / 2
    return placed.select(*K, "word_idx", txt.edit_font_size(known, sy, height).alias("size"))


# --- filters ---------------------------------------------------------------------------------


@query
def accept_annotations(t: Inputs) -> DataFrame:
    return flt.accept_annotations(t.annotations).select(*K, "seq", "kind", "content")


@query
def accept_strokes(t: Inputs) -> DataFrame:
    # Every other signature starts with a dot, so that some have nothing but dots.
    dot = "transform(strokes, s -> case when cast(substring(id, 2) as bigint) % 2 = 0 then slice(s, 1, 1) else s end)"
    kept = flt.accept_strokes(t.signatures.withColumn("strokes", F.expr(dot)))
    return kept.select("id", F.size("strokes").alias("n_strokes"), F.to_json("strokes").alias("strokes"))


@query
def accept_text_edits(t: Inputs) -> DataFrame:
    edits = t.annotations.where("kind = 'text_edit'")
    return flt.accept_text_edits(edits).select(*K, "seq", "content", "original")


@query
def burnable(t: Inputs) -> DataFrame:
    return flt.burnable(t.annotations, t.pages, t.dims).select(*K, "seq", "kind")


@query
def search_gate(t: Inputs) -> DataFrame:
    typed = t.events.selectExpr(
        "event_id as query_id", "case when event_id % 4 = 3 then '  ' else left(event_type, cast(event_id % 4 as int)) end as q"
    )
    live = flt.search_gate(typed, "live").withColumn("mode", F.lit("live"))
    return live.unionByName(flt.search_gate(typed, "enter").withColumn("mode", F.lit("enter")))


# --- spatial joins ---------------------------------------------------------------------------


@query
def words_in_region(t: Inputs) -> DataFrame:
    found = spatial.words_in_region(t.regions, t.words_of(t.regions), t.pages, t.dims)
    return found.select("region_id", *K, "word_idx", "text")


@query
def hit_test(t: Inputs) -> DataFrame:
    return spatial.hit_test(t.clicks.withColumn("x", F.col("x") + 20), t.annotations)


@query
def line_at_point(t: Inputs) -> DataFrame:
    return spatial.line_at_point(t.clicks, t.words_of(t.clicks), t.pages, t.dims)


@query
def nearest_line(t: Inputs) -> DataFrame:
    return spatial.nearest_line(t.clicks, t.words_of(t.clicks), t.pages, t.dims)


@query
def edit_target(t: Inputs) -> DataFrame:
    return spatial.edit_target(t.clicks, t.words_of(t.clicks), t.pages, t.dims)


@query
def place_signatures(t: Inputs) -> DataFrame:
    placements = t.clicks.selectExpr(
        *K, "click_id as seq", "concat('s', click_id * 7 div 10) as signature_id", "x", "y"
    )
    placed = spatial.place_signatures(placements, t.signatures)
    return placed.select(*K, "seq", "kind", *_fields("pos", "xy"), "scale", "src_w", "src_h", F.to_json("strokes").alias("strokes"))


@query
def with_dims(t: Inputs) -> DataFrame:
    return spatial.with_dims(t.annotations, t.pages, t.dims).select(*K, "seq", "sx", "sy")


def _shown(t: Inputs, edits: DataFrame) -> DataFrame:
    """Visible words; documents without edits do not take part in the join."""
    edited = spatial.visible_words(t.words_of(edits), edits, t.pages, t.dims)
    return edited.unionByName(t.words_of(edits, others=True))


@query
def visible_words(t: Inputs) -> DataFrame:
    seen = _shown(t, t.annotations.where("kind = 'text_edit'"))
    return seen.select(*K, "word_idx", "text")


# --- lines and text --------------------------------------------------------------------------


@query
def group_lines(t: Inputs) -> DataFrame:
    return lines.group_lines(t.placed_words).select(*K, "word_idx", "line_no")


@query
def line_bounds(t: Inputs) -> DataFrame:
    return lines.line_bounds(lines.group_lines(t.placed_words))


@query
def region_text(t: Inputs) -> DataFrame:
    return lines.region_text(spatial.words_in_region(t.regions, t.words_of(t.regions), t.pages, t.dims))


@query
def page_text(t: Inputs) -> DataFrame:
    return lines.page_text(t.placed_words)


@query
def reading_order(t: Inputs) -> DataFrame:
    return lines.reading_order(t.placed_words).select(*K, "word_idx", "read_pos")


@query
def left_to_right(t: Inputs) -> DataFrame:
    lined = lines.group_lines(t.placed_words)
    return lines.left_to_right(lined, [*K, "line_no"]).select(*K, "word_idx", "line_no", "line_pos")


# --- search ----------------------------------------------------------------------------------


@query
def phrase_search(t: Inputs) -> DataFrame:
    return search.phrase_search(t.words, LIVE, dense=True)


@query
def search_counts(t: Inputs) -> DataFrame:
    return search.search_counts(t.words, LIVE, t.every_page(LIVE), dense=True)


@query
def phrase_search_joined(t: Inputs) -> DataFrame:
    """The same queries as a table: the same hits."""
    return search.phrase_search(t.words, flt.search_gate(t.queries), dense=True)


@query
def phrase_search_all(t: Inputs) -> DataFrame:
    """The phrases of all benchmark texts."""
    return search.phrase_search(t.placed_words, t.all_queries, dense=True)


@query
def search_counts_all(t: Inputs) -> DataFrame:
    return search.search_counts(t.placed_words, t.all_queries, dense=True)


@query
def phrase_search_gaps(t: Inputs) -> DataFrame:
    """Words that edits have whited out do not count."""
    edits = t.annotations.where("kind = 'text_edit'")
    shown = spatial.visible_words(t.placed_words, edits, t.pages, t.dims)
    return search.phrase_search(shown, LIVE, placed=True).select("query_id", *K, "i", "j")


@query
def search_boxes(t: Inputs) -> DataFrame:
    hits = search.phrase_search(t.placed_words, LIVE, dense=True)
    return search.search_boxes(hits, t.placed_pages, t.placed_dims)


# --- page algebra ----------------------------------------------------------------------------

MOVED = ["source_doc_id", "source_page_idx", *K]


def _nth(t: Inputs, position: str) -> DataFrame:
    return t.page_totals.selectExpr("doc_id", f"cast({position} as int) as page_idx")


@query
def page_counts(t: Inputs) -> DataFrame:
    return pages.page_counts(t.pages)


def _merge_order(t: Inputs) -> DataFrame:
    return t.documents.selectExpr("doc_id", "doc_id div 10 as target_id", "doc_id as ord")


@query
def merged_page_counts(t: Inputs) -> DataFrame:
    return pages.merged_page_counts(t.pages, _merge_order(t))


@query
def raster_dims(t: Inputs) -> DataFrame:
    varied = t.pages.withColumn("width_pt", F.col("width_pt") + F.col("doc_id") % 7 * 0.5 + F.col("page_idx"))
    return pages.raster_dims(varied)


@query
def merge_documents(t: Inputs) -> DataFrame:
    return pages.merge_documents(t.pages, _merge_order(t)).select(*MOVED)


@query
def merged_words(t: Inputs) -> DataFrame:
    merged = pages.merge_documents(t.pages, _merge_order(t))
    return pages.apply_page_map(t.words, merged).select(*K, "word_idx", "text")


@query
def extract_pages(t: Inputs) -> DataFrame:
    return pages.extract_pages(t.pages, t.pages.where("page_idx % 2 = 0")).select(*MOVED)


@query
def delete_pages(t: Inputs) -> DataFrame:
    return pages.delete_pages(t.pages, t.pages.where("page_idx % 3 = 1")).select(*MOVED)


@query
def move_page(t: Inputs) -> DataFrame:
    moves = _nth(t, "doc_id % n")
    both = [
        pages.move_page(t.pages, moves, d).select(*MOVED).withColumn("direction", F.lit(d)) for d in ("up", "down")
    ]
    return both[0].unionByName(both[1])


@query
def reorder_page(t: Inputs) -> DataFrame:
    moves = t.page_totals.selectExpr(
        "doc_id", "cast(doc_id % n as int) as from_idx", "cast((doc_id * 3) % n as int) as to_idx"
    )
    return pages.reorder_page(t.pages, moves).select(*MOVED)


@query
def edited_pages(t: Inputs) -> DataFrame:
    return edits.edit_pages(t.pages, t.page_edits).select(*MOVED)


@query
def edited_words(t: Inputs) -> DataFrame:
    """Words carried along by the edits of their pages."""
    moved = edits.edit_pages(t.pages, t.page_edits)
    return pages.apply_page_map(t.words, moved).select(*K, "word_idx", "text")


@query
def invalidate_annotations(t: Inputs) -> DataFrame:
    changed = t.pages.where("doc_id % 3 = 0").select("doc_id")
    return pages.invalidate_annotations(t.annotations, changed).select(*K, "seq")


# --- annotations -----------------------------------------------------------------------------


@query
def undo_last(t: Inputs) -> DataFrame:
    return ann.undo_last(t.annotations).select(*K, "seq")


@query
def z_order(t: Inputs) -> DataFrame:
    return ann.z_order(t.annotations).select(*K, "seq", "z")


@query
def ink_bounds(t: Inputs) -> DataFrame:
    return ann.ink_bounds(t.annotations)


@query
def has_annotations(t: Inputs) -> DataFrame:
    return ann.has_annotations(t.documents, t.annotations)


@query
def annotation_state(t: Inputs) -> DataFrame:
    # The log is looked at more than once.
    return ann.annotation_state(cut_lineage(t.annot_events))


# --- drawing ---------------------------------------------------------------------------------

PRIM = [*K, "seq", "prim_idx", "kind", "text", "font"]
MEASURES = ["x1", "y1", "x2", "y2", "w", "h", "size", "pen_width"]


def _flat(prims: DataFrame) -> DataFrame:
    """Rounded measures and single colour channels, to compare across engines."""
    return prims.select(
        *PRIM, *[F.round(c, 6).alias(c) for c in MEASURES],
        *[F.col(f"rgba.{c}").cast("int").alias(c) for c in "rgba"],
    )


@query
def draw_text(t: Inputs) -> DataFrame:
    return _flat(draw.draw_text(t.annotations, t.pages, t.dims))


@query
def draw_highlight(t: Inputs) -> DataFrame:
    return _flat(draw.draw_highlight(t.annotations, t.pages, t.dims))


@query
def draw_ink(t: Inputs) -> DataFrame:
    return _flat(draw.draw_ink(t.annotations, t.pages, t.dims))


@query
def draw_text_edit(t: Inputs) -> DataFrame:
    return _flat(draw.draw_text_edit(t.annotations, t.pages, t.dims))


@query
def draw_signature(t: Inputs) -> DataFrame:
    return _flat(draw.draw_signature(t.annotations, t.pages, t.dims))


@query
def flatten_annotations(t: Inputs) -> DataFrame:
    accepted = flt.accept_annotations(t.annotations)
    return _flat(draw.flatten_annotations(accepted, t.pages, t.dims))


# --- pages of other sizes: scales differ across, down, by document and by page ------------------


@query
def scaled_page_to_canvas(t: Inputs) -> DataFrame:
    placed = t.words.join(spatial.page_scales(t.scaled_pages, t.scaled_dims), K)
    r = geo.page_to_canvas(*_cols(BOX + SIZES))
    return placed.withColumn("r", r).select(*K, "word_idx", *_fields("r"))


@query
def scaled_words_in_region(t: Inputs) -> DataFrame:
    found = spatial.words_in_region(t.regions, t.words_of(t.regions), t.scaled_pages, t.scaled_dims)
    return found.select("region_id", *K, "word_idx", "text")


@query
def scaled_line_at_point(t: Inputs) -> DataFrame:
    found = spatial.line_at_point(t.clicks, t.words_of(t.clicks), t.scaled_pages, t.scaled_dims)
    return found.select("click_id", *K, "text", "x", "y", "w", "h")


@query
def scaled_search_boxes_all(t: Inputs) -> DataFrame:
    hits = search.phrase_search(t.placed_words, LIVE, dense=True)
    return search.search_boxes(hits, t.placed_scaled_pages, t.placed_scaled_dims)


@query
def scaled_with_dims(t: Inputs) -> DataFrame:
    return spatial.with_dims(t.annotations, t.scaled_pages, t.scaled_dims).select(*K, "seq", "sx", "sy")


@query
def scaled_burnable(t: Inputs) -> DataFrame:
    return flt.burnable(t.annotations, t.scaled_pages, t.scaled_dims).select(*K, "seq", "kind")


@query
def scaled_draw_highlight(t: Inputs) -> DataFrame:
    return _flat(draw.draw_highlight(t.annotations, t.scaled_pages, t.scaled_dims)).select(*K, "seq", "x1", "y1", "w", "h")


@query
def scaled_draw_ink(t: Inputs) -> DataFrame:
    lines = _flat(draw.draw_ink(t.annotations, t.scaled_pages, t.scaled_dims))
    return lines.select(*K, "seq", "prim_idx", "x1", "y1", "x2", "y2", "pen_width")


# --- streams ---------------------------------------------------------------------------------


@query
def annotation_state_stream(t: Inputs) -> DataFrame:
    """The event log arriving in four parts, the stream restarting in between."""
    root = new_path(t.spark, "annot-stream")
    last = t.events.agg(F.max("event_id")).first()[0] or 0
    quarter = last // 4 + 1
    # The log is derived once, not once per part.
    parts = t.annot_events.withColumn("part", F.floor(F.col("seq") / quarter).cast("int"))
    parts.write.partitionBy("part").parquet(f"{root}/parts")
    staged = t.spark.read.schema(StructType([*ANNOT_EVENTS, StructField("part", IntegerType())])).parquet(f"{root}/parts")
    for n in range(4):
        staged.where(F.col("part") == n).drop("part").write.mode("append").parquet(f"{root}/events")
        run = ann_stream.annotation_state_stream(
            t.spark.readStream.schema(ANNOT_EVENTS).parquet(f"{root}/events"), f"{root}/out", f"{root}/state", availableNow=True
        )
        run.awaitTermination()
    return ann_stream.live_annotations(t.spark, f"{root}/out")


@query
def search_stream(t: Inputs) -> DataFrame:
    """Laid-out pages, of 400 words at most, arriving as rows and searched as they come."""
    root = new_path(t.spark, "search-stream")
    t.whole_pages.write.parquet(f"{root}/pages")
    stream = t.spark.readStream.schema(page_stream.ARRIVING_PAGES).parquet(f"{root}/pages")
    run = page_stream.search_stream(
        stream, LIVE, f"{root}/hits", f"{root}/state", availableNow=True
    )
    run.awaitTermination()
    return t.spark.read.parquet(f"{root}/hits").drop("batch")
