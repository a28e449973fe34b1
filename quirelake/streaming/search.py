"""Search over pages as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quirelake.operators.search import Queries, phrase_search
from quirelake.schemas import K, WORDS

_WORD_FIELDS = [f for f in WORDS.fields if f.name not in ("doc_id", "page_idx", "word_idx")]

#: A page arrives whole, as one row with its words in content order.
ARRIVING_PAGES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("page_idx", T.IntegerType()),
        T.StructField("words", T.ArrayType(T.StructType(_WORD_FIELDS))),
    ]
)


def arriving_words(pages: DataFrame) -> DataFrame:
    """Word rows of arriving pages."""
    rows = pages.select(*K, F.posexplode("words").alias("word_idx", "w"))
    return rows.select(*K, "word_idx", "w.*")


def search_stream(
    pages: DataFrame, queries: Queries, sink: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Search each newly arrived page once and append the hits to ``sink``.

    Matches never cross pages, so a micro-batch is searched on its own by the batch operator.
    Each one overwrites a folder of its own number: one replayed after a failure leaves no doubles.
    """

    def search(batch: DataFrame, batch_id: int) -> None:
        hits = phrase_search(arriving_words(batch), queries, dense=True)
        hits.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    writer = pages.writeStream.foreachBatch(search).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
