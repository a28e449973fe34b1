"""Reading, listing and writing corpora."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quirelake import schemas
from quirelake.functions.text import has_extension, is_protected, page_label
from quirelake.operators.drawing import flatten_annotations
from quirelake.plans.snapshots import ORPHAN_AGE, commit, current, table_path, vacuum

#: Files of a corpus are spread over this many folders by a hash of the document id.
DOC_BUCKETS = 64
#: The most parts that words are dealt out to; Spark knows no more buckets of a table.
MOST_PARTS = 100_000


@dataclass(frozen=True)
class Corpus:
    """Pages and words as read; annotations and rendered sizes are empty on opening."""

    pages: DataFrame
    words: DataFrame
    annotations: DataFrame
    render_dims: DataFrame


def _bucket(buckets: int, hashed: str = "hash"):
    return F.pmod(getattr(F, hashed)("doc_id"), F.lit(buckets)).cast("int")


@contextmanager
def _table_name(spark: SparkSession) -> Iterator[str]:
    """A name that the session forgets again; the files stay."""
    name = f"spark_catalog.default.corpus_{uuid.uuid4().hex}"
    try:
        yield name
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _keeps_parts(spark: SparkSession) -> bool:
    """Whether names are the session's own; in a shared metastore none are left for a moment, and parts are not used."""
    return spark.conf.get("spark.sql.catalogImplementation") == "in-memory"


def _read_parts(spark: SparkSession, folder: str, schema: StructType, parts: int) -> DataFrame:
    """The rows of a folder, of which Spark knows that they lie by ``doc_id``: joins and groups need no shuffle of them."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    location = folder.replace("\\", "\\\\").replace("'", "\\'")
    with _table_name(spark) as name:
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (doc_id) INTO {parts} BUCKETS LOCATION '{location}'"
        )
        return spark.table(name)


def read_corpus(
    spark: SparkSession, path: str, doc_ids: DataFrame | None = None, buckets: int | None = None
) -> Corpus:
    """Open the corpus below ``path``: its last version, or plain ``pages`` and ``words`` folders of parquet.

    With ``doc_ids(doc_id)`` only those documents are read: the folders of their buckets, and in these the files' own
    statistics of ``doc_id``. The number of buckets is kept with the corpus; ``buckets``, if given, must agree with it.
    Plain folders say nothing about buckets, so there the documents are looked for everywhere. Words that were saved by
    parts are not shuffled by what joins or groups them by document, page or finer, if
    ``spark.sql.requireAllClusterKeysForCoPartition`` is false.
    """
    saved = current(spark, path)
    if saved and buckets not in (None, saved["buckets"]):
        raise ValueError(f"{path} has {saved['buckets']} buckets, not {buckets}")
    folders = None
    if doc_ids is not None:
        doc_ids = doc_ids.select("doc_id").distinct()
        if saved:
            at = _bucket(saved["buckets"], saved.get("hashed", "xxhash64"))
            folders = [r[0] for r in doc_ids.select(at).distinct().collect()]

    def table(name: str, schema) -> DataFrame:
        folder = table_path(path, name, saved["version"]) if saved else f"{path.rstrip('/')}/{name}"
        parts = saved["parts"].get(name) if saved and "parts" in saved and doc_ids is None and _keeps_parts(spark) else None
        rows = _read_parts(spark, folder, schema, parts) if parts else spark.read.schema(schema).parquet(folder)
        if folders is not None:
            rows = rows.where(F.col("doc_bucket").isin(folders))
        if doc_ids is not None:
            rows = rows.join(doc_ids, "doc_id", "left_semi")
        return rows.select(*schema.names)

    return Corpus(
        pages=table("pages", schemas.PAGES),
        words=table("words", schemas.WORDS),
        annotations=spark.createDataFrame([], schemas.ANNOTATIONS),
        render_dims=spark.createDataFrame([], schemas.RENDER_DIMS),
    )


def parts_of(tasks: int, buckets: int = DOC_BUCKETS) -> int:
    """The number of parts, of one bucket each, for so many tasks."""
    return max(1, min(-(-tasks // buckets), MOST_PARTS // buckets)) * buckets


def by_bucket(rows: DataFrame, tasks: int, buckets: int = DOC_BUCKETS) -> DataFrame:
    """``rows(doc_id, ...)`` dealt out to ``parts_of(tasks)`` tasks, each of one bucket; a document stays whole.

    Texts dealt out like this give words that ``write_corpus`` need not shuffle (``gathered``, ``parts``).
    """
    return rows.repartition(parts_of(tasks, buckets), F.col("doc_id").cast("long"))


def _write_bucketed(df: DataFrame, path: str, buckets: int, gathered: bool = False, parts: int | None = None) -> None:
    """One folder per bucket of documents, rows of a file in order.

    The rebalance hint gathers a bucket into few files and splits a bucket that is too large
    for one task, as it is when a single document holds much of the data. Rows that are ``gathered`` stay where they are;
    with ``parts`` their files tell the part.
    """
    rows = df.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("doc_bucket", _bucket(buckets))
    if not gathered:
        rows = rows.hint("rebalance", "doc_bucket")
    order = [c for c in ("doc_id", "page_idx", "word_idx", "seq", "prim_idx") if c in rows.columns]
    if parts is None:
        rows.sortWithinPartitions("doc_bucket", *order).write.mode("overwrite").partitionBy("doc_bucket").parquet(path)
        return
    with _table_name(df.sparkSession) as name:
        by_part = rows.write.format("parquet").partitionBy("doc_bucket").bucketBy(parts, "doc_id").sortBy(*order)
        by_part.option("path", path).saveAsTable(name)


def write_corpus(
    corpus: Corpus, path: str, burned: bool = False, buckets: int = DOC_BUCKETS, base: int | None = None, gathered: bool = False,
    parts: int | None = None,
) -> int:
    """Save pages and words as a new version; ``burned`` saves what the annotations draw as well.

    All tables become visible at once, and a writer that is lost changes nothing. The corpus may be one that was
    read from ``path``. The number of the version is returned; given as ``base``, a save fails (``Conflict``) if someone
    else has saved since. ``vacuum_corpus`` deletes older versions. The corpus itself is not changed by a
    burned save: its annotations stay pending. ``gathered`` says that the tasks of pages and words hold few buckets each, and not more
    than they can sort, as after ``by_bucket``: they are not shuffled then. ``parts`` says so of the words alone, which lie by that many
    parts: after ``by_bucket`` of ``parts_of`` tasks, or as read from a corpus saved so, documents having kept their ids. They are
    read again as they lie. Words that lie elsewhere are saved right as well, but in many small files.
    """
    rows = {"pages": corpus.pages, "words": corpus.words}
    if burned:
        rows["draw_ops"] = flatten_annotations(corpus.annotations, corpus.pages, corpus.render_dims)
    stay = {"pages": gathered, "words": gathered or parts is not None}
    kept = {"words": parts} if parts and _keeps_parts(corpus.pages.sparkSession) else {}
    writers = {
        name: partial(_write_bucketed, df, buckets=buckets, gathered=stay.get(name, False), parts=kept.get(name)) for name, df in rows.items()
    }
    return commit(corpus.pages.sparkSession, path, writers, {"buckets": buckets, "hashed": "hash", "parts": kept}, base)


def read_draws(spark: SparkSession, path: str) -> DataFrame:
    """What the annotations of a burned corpus drew; empty if the last version is not burned."""
    saved = current(spark, path)
    if saved is None or "draw_ops" not in saved["tables"]:
        return spark.createDataFrame([], schemas.DRAW_OPS)
    return spark.read.schema(schemas.DRAW_OPS).parquet(table_path(path, "draw_ops", saved["version"])).select(*schemas.DRAW_OPS.names)


def vacuum_corpus(spark: SparkSession, path: str, keep: int = 1, orphan_age: float = ORPHAN_AGE) -> None:
    """Delete all versions but the last ``keep``, and what writers that were lost left behind."""
    vacuum(spark, path, keep, orphan_age)


def select_files(files: DataFrame, extension: str = ".pdf") -> DataFrame:
    """Rows whose ``path`` ends in the extension, ignoring case."""
    return files.where(has_extension(F.col("path"), extension))


def pdf_inventory(spark: SparkSession, directory: str, extension: str = ".pdf") -> DataFrame:
    """Candidate files below a folder. File contents are pruned from the scan, never read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(directory)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )
    return select_files(files, extension)


def triage_failures(errors: DataFrame) -> DataFrame:
    """Mark failures whose ``message`` says that the file is locked."""
    return errors.withColumn("is_protected", is_protected(F.col("message")))


def page_inventory(pages: DataFrame) -> DataFrame:
    """One labelled row per page."""
    return pages.select("doc_id", "page_idx", page_label(F.col("page_idx")).alias("label"))
