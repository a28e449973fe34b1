"""Corpus tables derived by fixed rules from the given parquet tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.plans.blocks import dense_position
from quirelake.schemas import RGBA, K
from quirelake.sources import corpus, layout

#: Queries of the search examples: one too short to search as typed, one blank, one without hits.
QUERIES = [(0, "the"), (1, "er"), (2, "of the"), (3, "hat th"), (4, "a"), (5, "   "), (6, "zzqx")]
#: Those worth running as they are typed; the gate, as a query of its own, is held against the same rule.
LIVE = [(i, q) for i, q in QUERIES if len(q) > 1 and q.strip()]

#: Characters of text whose words one task sorts.
TASK_CHARS = 4_000_000


@dataclass(frozen=True)
class Inputs:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def placed_documents(self) -> DataFrame:
        """The documents dealt out by ``doc_id``, ``TASK_CHARS`` of text to a task.

        What is laid out from them stays where it is: groups and joins by document, page or finer need no shuffle of
        words, and a task has no more words than it can sort in memory.
        """
        # Both sides of a join on (document, page, ...) may lie by document alone.
        self.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        return self.documents.select("doc_id", "text").repartition(self._tasks, "doc_id")

    @cached_property
    def _tasks(self) -> int:
        chars = self.documents.agg(F.sum(F.length("text"))).first()[0] or 0
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // TASK_CHARS))

    @cached_property
    def placed_words(self) -> DataFrame:
        return layout.layout_words(self.placed_documents)

    @cached_property
    def placed_pages(self) -> DataFrame:
        return layout.layout_pages(self.placed_documents)

    @cached_property
    def placed_dims(self) -> DataFrame:
        return layout.layout_dims(self.placed_pages)

    @cached_property
    def bucketed_documents(self) -> DataFrame:
        """The documents dealt out by the bucket that a corpus keeps them in, and by parts of it where it is large."""
        self.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        return corpus.by_bucket(self.documents.select("doc_id", "text"), self.parts)

    @cached_property
    def parts(self) -> int:
        return corpus.parts_of(self._tasks)

    @cached_property
    def bucketed_words(self) -> DataFrame:
        return layout.layout_words(self.bucketed_documents)

    @cached_property
    def bucketed_pages(self) -> DataFrame:
        return layout.layout_pages(self.bucketed_documents)

    @cached_property
    def whole_pages(self) -> DataFrame:
        return layout.layout_whole_pages(self.documents)

    @cached_property
    def placed_scaled_pages(self) -> DataFrame:
        return self._scaled(self.placed_pages)

    @cached_property
    def placed_scaled_dims(self) -> DataFrame:
        return self._rendered(self.placed_scaled_pages)

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").select("event_id", "user_id", "event_type")

    @cached_property
    def words(self) -> DataFrame:
        return layout.layout_words(self.documents)

    def words_of(self, rows: DataFrame, others: bool = False) -> DataFrame:
        """Words of the documents that ``rows`` name, or of all others."""
        return layout.layout_words(layout.documents_of(self.documents, rows, others))

    @cached_property
    def pages(self) -> DataFrame:
        return layout.layout_pages(self.documents)

    @cached_property
    def dims(self) -> DataFrame:
        return layout.layout_dims(self.pages)

    @cached_property
    def scaled_pages(self) -> DataFrame:
        """The pages at other sizes, which differ by document and page."""
        return self._scaled(self.pages)

    @staticmethod
    def _scaled(pages: DataFrame) -> DataFrame:
        return pages.select(
            *K, (612.0 * (1 + F.col("doc_id") % 2)).alias("width_pt"), (792.0 * (1 + F.col("page_idx") % 2)).alias("height_pt")
        )

    @cached_property
    def scaled_dims(self) -> DataFrame:
        """Rendered sizes with different powers of two across and down; one page in five is not rendered."""
        return self._rendered(self.scaled_pages)

    @staticmethod
    def _rendered(scaled_pages: DataFrame) -> DataFrame:
        wide = F.pow(F.lit(2.0), F.col("doc_id") % 3)
        high = F.pow(F.lit(2.0), (F.col("doc_id") + F.col("page_idx")) % 2 + 1)
        return scaled_pages.where((F.col("doc_id") + F.col("page_idx")) % 5 != 0).select(
            *K, (F.col("width_pt") * wide).cast("int").alias("render_w"), (F.col("height_pt") * high).cast("int").alias("render_h")
        )

    @cached_property
    def queries(self) -> DataFrame:
        return self.spark.createDataFrame(QUERIES, "query_id int, q string")

    @cached_property
    def all_queries(self) -> DataFrame:
        """The benchmark texts cut into phrases of three words, the last of an item with what is left; null queries beside them."""
        words = F.split(F.col("text"), "[ \\n]+")
        at = F.sequence(F.lit(1), F.greatest(F.size(words) - 2, F.lit(1)), F.lit(3))
        last = F.element_at(at, -1)
        phrase = F.transform(at, lambda i: F.array_join(F.slice(words, i, F.when(i == last, F.greatest(F.size(words), F.lit(1))).otherwise(3)), " "))
        items = self.table("benchmark").select(F.col("item_id").cast("int").alias("query_id"), "text", phrase.alias("phrases"))
        nulls = items.where("query_id % 7 = 3").select("query_id", F.lit(None).cast("string").alias("q"))
        return items.select("query_id", F.explode("phrases").alias("q")).unionByName(nulls)

    def every_page(self, queries: list[tuple[int, str]]) -> DataFrame:
        """A request for each of some queries on each page."""
        return self.pages.select(*K, F.explode(F.array(*[F.lit(i) for i, _ in queries])).alias("query_id"))

    def _placed(self, pages: int) -> DataFrame:
        """One box per event, on one of the first pages of a document."""
        return self.events.selectExpr(
            "event_id", "event_type", "user_id as doc_id", f"cast(event_id % {pages} as int) as page_idx",
            "cast((event_id * 37) % 1100 as double) as x", "cast((event_id * 53) % 1500 as double) as y",
            "cast(60 + event_id % 300 as double) as w", "cast(20 + event_id % 200 as double) as h",
        )

    @cached_property
    def regions(self) -> DataFrame:
        return self._placed(2).selectExpr("event_id as region_id", *K, "x", "y", "w", "h")

    @cached_property
    def clicks(self) -> DataFrame:
        return self._placed(2).selectExpr("event_id as click_id", *K, "x", "y")

    @cached_property
    def drags(self) -> DataFrame:
        """Two ends of a drag, in any direction."""
        return self._placed(2).selectExpr(
            "event_id as drag_id", "x as x0", "y as y0",
            "cast((event_id * 91) % 1100 as double) as x1", "cast((event_id * 17) % 1500 as double) as y1",
        )

    @cached_property
    def annotations(self) -> DataFrame:
        kind = (
            "case event_type when 'view' then 'highlight' when 'click' then 'ink' when 'signup' then 'text'"
            " when 'purchase' then 'text_edit' else 'signature' end"
        )
        rect = (
            "case when kind = 'highlight' then named_struct('x', x, 'y', y,"
            " 'w', cast(seq % 9 as double), 'h', cast(seq % 7 as double))"
            " when kind = 'text_edit' then named_struct('x', x, 'y', y, 'w', w, 'h', h) end"
        )
        content = (
            "case when kind = 'text_edit' then concat('item ', seq % 7)"
            " when kind <> 'text' then null when seq % 7 = 0 then '   '"
            " when seq % 3 = 0 then concat(' note ', seq, char(10), char(10), 'more')"
            " else concat(' note ', seq) end"
        )
        points = (
            "case when kind = 'ink' then transform(sequence(0L, seq % 6),"
            " k -> named_struct('x', x + 4 * k, 'y', y + k * k)) end"
        )
        first = "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 10D, 'y', 5D), named_struct('x', 20D, 'y', 0D))"
        second = (
            "filter(array(named_struct('x', 0D, 'y', 10D), named_struct('x', 5D, 'y', 11D)),"
            " (p, i) -> i < seq % 3)"
        )
        signed = "case when kind = 'signature' then {} end"
        placed = self._placed(3).selectExpr("*", "event_id as seq", f"{kind} as kind")
        return placed.selectExpr(
            *K, "seq", "kind",
            "case when kind in ('text', 'text_edit', 'signature') then named_struct('x', x, 'y', y) end as pos",
            f"{rect} as rect", f"{content} as content",
            "case when kind = 'text_edit' then concat('item ', seq % 5) end as original",
            "case kind when 'text' then 14D when 'text_edit' then cast(10 + seq % 5 as double) end as font_size",
            "case when kind = 'text_edit' then 'Arial' end as font_name",
            f"{points} as points", f"{signed.format(f'array({first}, {second})')} as strokes",
            signed.format("0.5D") + " as scale", signed.format("400D") + " as src_w",
            signed.format("150D") + " as src_h",
            "case when kind = 'ink' then cast(1 + seq % 20 as double) end as stroke_width",
            "named_struct('r', cast(seq % 256 as short), 'g', 0S, 'b', 255S, 'a', 80S) as rgba",
            "case when kind = 'text' then w end as measured_w",
            "case when kind = 'text' then h end as measured_h",
        ).withColumn("rgba", F.col("rgba").cast(RGBA))

    @cached_property
    def annot_events(self) -> DataFrame:
        """Event log; a deletion aims at the third event before it in the same document."""
        op = (
            "case when event_id % 97 = 0 then 'reload' when event_id % 31 = 0 then 'clear'"
            " when event_id % 5 = 0 then 'undo' when event_id % 7 = 0 then 'delete' else 'add' end"
        )
        ranked = dense_position(self.events, ["user_id"], "event_id", "n")
        earlier = ranked.select("user_id", (F.col("n") + 3).alias("n"), F.col("event_id").alias("back"))
        events = ranked.join(earlier, ["user_id", "n"], "left")
        return events.selectExpr(
            "user_id as doc_id", "event_id as seq", "cast(event_id % 3 as int) as page_idx", f"{op} as op",
            f"case {op} when 'add' then event_id when 'delete' then back end as annot_id",
        )

    @cached_property
    def page_edits(self) -> DataFrame:
        """Log of page edits, a third or so of which name positions that their document has not got."""
        op = (
            "case event_type when 'click' then 'up' when 'signup' then 'down' when 'purchase' then"
            " case when event_id % 3 = 0 then 'append' else 'delete' end else 'reorder' end"
        )
        return self.events.selectExpr(
            "user_id as doc_id", "event_id as seq", f"{op} as op", "cast(event_id % 7 as int) as at",
            "cast(event_id * 3 % 11 as int) as to", "event_id * 7 % 1000 as other_id",
        )

    @cached_property
    def signatures(self) -> DataFrame:
        """A saved signature per erroneous event, with one or two strokes."""
        signed = self.annotations.where("kind = 'signature'")
        return signed.selectExpr(
            "concat('s', seq) as id", "concat('Signature ', seq) as name", "strokes",
            "400D as canvas_w", "cast(100 + seq % 100 as double) as canvas_h",
        )

    @cached_property
    def page_totals(self) -> DataFrame:
        return self.pages.groupBy("doc_id").agg(F.count("*").alias("n"))
