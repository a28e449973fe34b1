"""Documents to training sequences: five stages, each over all that the one before has kept.

1. ``language``: texts whose language is rejected go.
2. ``near_dedup``: of every group of near-duplicates one document stays.
3. ``decontaminate``: documents that hold a window of the test set go.
4. ``secrets``: secrets are replaced by a mark; every document stays, ``n_chars`` follows the text.
5. ``pack``: token sequences.

The first four return the columns they are given. Null texts are rejected by the first stage. Columns beside those
of ``documents`` are carried along; columns starting with two underscores are the stages' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import decontaminate, language, packing, secrets, simhash
from quirelake.llm.common import table
from quirelake.plans.lineage import new_path


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, cached=400_000, kept=60_000)  # the other stages need the memory


STAGES = [
    ("language", keep_identified),
    ("near_dedup", near_dedup),
    ("decontaminate", drop_contaminated),
    ("secrets", redact),
    ("pack", pack),
]

#: Compression, token ids and fingerprints have no counterpart in SQL; ``tests/llm`` has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
