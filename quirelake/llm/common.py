"""Small helpers of the operators: table access, ids, hashes, ASCII case."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One row in four (by checksum of its id) is kept out of everything that is learned.
FOLDS, HELD_OUT = 4, 2


#: Rows carry whole texts here, so Arrow batches hold fewer of them than Spark's default of 10,000.
BATCH_ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def lean(df: DataFrame) -> DataFrame:
    """``df`` itself; its session passes rows to Python workers in batches of at most ``BATCH_ROWS``."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH)) <= BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept out of learning; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT
