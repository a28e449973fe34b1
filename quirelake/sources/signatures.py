"""The list of saved signatures, as JSON."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.plans.lineage import filesystem
from quirelake.schemas import SIGNATURE_JSON, SIGNATURES


def _aside(path: str) -> str:
    """Where the old list waits while a new one is moved in."""
    return f"{path.rstrip('/')}.old"


def _fits(value, kind: T.DataType) -> bool:
    """Whether a parsed value is of a type, null allowed; unknown fields do not matter."""
    if value is None:
        return True
    if isinstance(kind, T.ArrayType):
        return isinstance(value, list) and all(_fits(v, kind.elementType) for v in value)
    if isinstance(kind, T.StructType):
        return isinstance(value, dict) and all(_fits(value.get(f.name), f.dataType) for f in kind)
    if isinstance(kind, T.StringType):
        return isinstance(value, str)
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _refuse(constant: str):
    raise ValueError(f"{constant} is not JSON")


def _whole_list(text: str | None) -> str | None:
    """``text`` if it is one array of signatures and nothing else, otherwise null."""
    try:
        value = json.loads(text or "", parse_constant=_refuse)
    except (ValueError, RecursionError):  # brackets nested too deep are no list of signatures either
        return None
    return text if isinstance(value, list) and _fits(value, T.ArrayType(SIGNATURE_JSON)) else None


def _from_json_names(s: Column) -> list[Column]:
    point = lambda q: F.struct(q["X"].alias("x"), q["Y"].alias("y"))
    return [
        s["Id"].alias("id"),
        s["Name"].alias("name"),
        F.transform(s["Strokes"], lambda t: F.transform(t, point)).alias("strokes"),
        s["CanvasWidth"].alias("canvas_w"),
        s["CanvasHeight"].alias("canvas_h"),
    ]


def as_json(s: Column) -> Column:
    """A saved signature as its JSON object."""
    point = lambda q: F.struct(q["x"].alias("X"), q["y"].alias("Y"))
    return F.to_json(
        F.struct(
            s["id"].alias("Id"), s["name"].alias("Name"),
            F.transform(s["strokes"], lambda t: F.transform(t, point)).alias("Strokes"),
            s["canvas_w"].alias("CanvasWidth"), s["canvas_h"].alias("CanvasHeight"),
        )
    )


def read_signatures(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Saved signatures; a missing path gives none, and so does a file that is not altogether right.

    A hand-kept file is one JSON array and is read all or nothing: with a value of the wrong type, or text
    behind the array, it counts as empty. ``lines=True`` reads the splittable form that ``write_signatures``
    leaves, one signature per line, by the same rule per file.
    """
    fs, p = filesystem(spark, path)
    if not fs.exists(p):
        path = _aside(path)  # a writer was lost between its two moves
        if not fs.exists(filesystem(spark, path)[1]):
            return spark.createDataFrame([], SIGNATURES)
    if lines:
        broken = "_broken"
        kind = T.StructType([*SIGNATURE_JSON.fields, T.StructField(broken, T.StringType())])
        text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where("value <> ''")
        rows = text.select("file", F.from_json("value", kind, {"columnNameOfCorruptRecord": broken}).alias("s"))
        bad = rows.where(F.col(f"s.{broken}").isNotNull() | F.col("s").isNull()).select("file").distinct()
        rows = rows.join(bad, "file", "left_anti")
    else:
        text = spark.read.text(path, wholetext=True).select(F.udf(_whole_list, "string")("value").alias("value"))
        rows = text.select(F.explode(F.from_json("value", T.ArrayType(SIGNATURE_JSON))).alias("s")).where("s is not null")
    return rows.select(*_from_json_names(F.col("s")))


def write_signatures(signatures: DataFrame, path: str) -> None:
    """Replace the whole list.

    The new list is complete on disk before the old one is moved aside, and the old one goes last: whenever
    the writer is lost, a reader finds one list or the other.
    """
    spark = signatures.sparkSession
    fs, target = filesystem(spark, path)
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    signatures.select(as_json(F.struct("*")).alias("value")).write.text(staged)
    aside = filesystem(spark, _aside(path))[1]
    if fs.exists(target):
        if fs.exists(aside):
            fs.delete(aside, True)
        if not fs.rename(target, aside):
            raise OSError(f"could not move {path} aside")
    if not fs.rename(filesystem(spark, staged)[1], target):
        raise OSError(f"could not move {staged} to {path}")
    if fs.exists(aside):
        fs.delete(aside, True)
