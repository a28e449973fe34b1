"""Folders of tables that change all at once.

A writer puts every table into a folder of its own version, ``<root>/<table>/version=<id>``, and then publishes the
version by a manifest, one small file that names it. Manifests are numbered, and a number can be taken once only (a
rename onto a name that exists fails), so of two writers that started from the same state the later one is
told, and a reader finds what one writer wrote as a whole. Nothing is deleted by a commit: what was read before,
also by the writer itself, stays readable until ``vacuum``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from quirelake.plans.lineage import filesystem

_MANIFESTS = "_manifests"
_DIGITS = 12
#: Seconds after which a version that no manifest names counts as left behind by a lost writer.
ORPHAN_AGE = 7 * 24 * 3600


class Conflict(Exception):
    """Another writer committed first."""


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, folder = filesystem(spark, f"{root}/{_MANIFESTS}")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())


def manifest_path(root: str, number: int) -> str:
    return f"{root}/{_MANIFESTS}/{number:0{_DIGITS}}.json"


def load(spark: SparkSession, root: str, number: int) -> dict:
    fs, path = filesystem(spark, manifest_path(root, number))
    stream = fs.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def current(spark: SparkSession, root: str) -> dict | None:
    """The manifest of the last version, with its ``number``; None where nothing was committed."""
    root = root.rstrip("/")
    numbers = versions(spark, root)
    return {**load(spark, root, numbers[-1]), "number": numbers[-1]} if numbers else None


def table_path(root: str, table: str, version: str) -> str:
    return f"{root.rstrip('/')}/{table}/version={version}"


def commit(
    spark: SparkSession, root: str, tables: dict[str, Callable[[str], None]], facts: dict | None = None, base: int | None = None
) -> int:
    """Write each table (a function that takes a folder) and publish them together, with ``facts`` beside them.

    ``base`` is the number of the version that the caller started from (None: whichever is last now). The number
    of the new version is returned. ``Conflict`` is raised, and nothing published, if there is a later one by then.
    """
    root = root.rstrip("/")
    started = base if base is not None else max(versions(spark, root), default=0)
    version = uuid.uuid4().hex
    for name, write in tables.items():
        write(table_path(root, name, version))
    _publish(spark, root, started + 1, {"version": version, "tables": sorted(tables), **(facts or {})})
    return started + 1


def _publish(spark: SparkSession, root: str, number: int, manifest: dict) -> None:
    """One rename makes a version visible."""
    fs, target = filesystem(spark, manifest_path(root, number))
    staged = filesystem(spark, f"{root}/{_MANIFESTS}/_{uuid.uuid4().hex}")[1]
    out = fs.create(staged, False)
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()
    if fs.exists(target) or not fs.rename(staged, target):
        fs.delete(staged, False)
        raise Conflict(f"version {number} of {root} is there already")


def vacuum(spark: SparkSession, root: str, keep: int = 1, orphan_age: float = ORPHAN_AGE) -> None:
    """Delete all but the last ``keep`` versions, and what lost writers left more than ``orphan_age`` seconds ago.

    Manifests go first, so that no reader is sent to a folder that is going.
    """
    if keep < 1:
        raise ValueError("the last version cannot go")
    root = root.rstrip("/")
    numbers = versions(spark, root)
    old, kept = numbers[:-keep], numbers[-keep:]
    names = {load(spark, root, n)["version"] for n in kept}
    gone = {load(spark, root, n)["version"] for n in old}
    fs, folder = filesystem(spark, root)
    for n in old:
        fs.delete(filesystem(spark, manifest_path(root, n))[1], False)
    limit = (time.time() - orphan_age) * 1000
    for table in fs.listStatus(folder) if fs.exists(folder) else ():
        if not table.isDirectory() or table.getPath().getName() == _MANIFESTS:
            continue
        for status in fs.listStatus(table.getPath()):
            name = status.getPath().getName()
            version = name.removeprefix("version=")
            if version == name or version in names:
                continue
            if version in gone or status.getModificationTime() < limit:
                fs.delete(status.getPath(), True)
