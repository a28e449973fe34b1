"""URL filters as a sort-merge range join with a stack of nested rules.

A host is turned round (``com.example.blog.``), so that a rule's host and all its subdomains are one interval
of keys. URLs are dealt out by ranges of (key, path, id), which splits a host of any size; each rule goes to the
ranges its interval touches. In a range, rules and URLs are swept in key order: the rules whose interval is
open lie on a stack, outermost first, and every URL asks the open rules for those its path starts with.
The longest rule (host and path together) wins; of two equal ones that disagree, the blocking one.

Rules are a table of any size; what the driver sees is one pair of keys per range.

Cases: a null URL, or one without ``://``, has an empty host and path. Null actions, hosts or paths in rules make
the rule void. Repeated rows are judged once each. Without a fitting rule the verdict is ``default``. An empty
table of either kind works. The query drops extra columns.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.common import ascii_lower
from quirelake.plans.lineage import cut_lineage

#: (action, host, path)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
ALLOW, BLOCK = "allow", "block"


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "action string, host string, path string")


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def key(host: Column) -> Column:
    """Labels from the top, each closed by a dot: a prefix of keys is a domain with its subdomains."""
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), "."), F.lit("."))


def beyond(key: str) -> str:
    """The least string above all that start with ``key``: its final dot raised by one."""
    return key[:-1] + "/"


class Stack:
    """Open intervals, outermost first, each with its rules by path."""

    def __init__(self) -> None:
        self.open: list[tuple[str, str, dict[str, tuple[int, str, str]], list[int]]] = []

    def close(self, key: str) -> None:
        while self.open and self.open[-1][1] <= key:
            self.open.pop()

    def push(self, key: str, action: str, host: str, path: str) -> None:
        self.close(key)
        if not self.open or self.open[-1][0] != key:
            self.open.append((key, beyond(key), {}, []))
        _, _, paths, lengths = self.open[-1]
        if path not in paths or action == BLOCK:
            paths[path] = (len(host) + len(path), host + path, action)
        at = bisect_left(lengths, len(path))
        if at == len(lengths) or lengths[at] != len(path):
            lengths.insert(at, len(path))

    def ask(self, key: str, path: str) -> tuple[str | None, str | None]:
        self.close(key)
        best: tuple[int, str, str] | None = None
        for _, _, paths, lengths in self.open:
            for n in reversed(lengths[: bisect_right(lengths, len(path))]):
                rule = paths.get(path[:n])
                if rule:
                    best = rule if best is None or rule[0] > best[0] else best
                    break
        return (best[1], best[2]) if best else (None, None)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, key, rules first); gives the URL rows with rule and action."""
    stack, at = Stack(), None
    for batch in batches:
        keep, rules, actions = [], [], []
        cols = [batch.column(c).to_pylist() for c in ("__range", "__key", "__action", "host", "path")]
        for i, (rng, k, action, h, p) in enumerate(zip(*cols, strict=True)):
            if rng != at:
                stack, at = Stack(), rng
            if action is not None:
                stack.push(k, action, h, p)
                continue
            rule, verdict = stack.ask(k, p)
            keep.append(i)
            rules.append(rule)
            actions.append(verdict)
        out = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [out.column("__id"), out.column("host"), out.column("path"),
             pa.array(rules, pa.string()), pa.array(actions, pa.string())],
            ["__id", "host", "path", "rule", "action"],
        )


def _extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(range, first key, last key) of a sorted partition."""
    first = None
    for batch in batches:
        if batch.num_rows:
            first = first or (batch.column("__range")[0].as_py(), batch.column("__key")[0].as_py())
            last = batch.column("__key")[batch.num_rows - 1].as_py()
    if first:
        yield pa.RecordBatch.from_pydict({"r": pa.array([first[0]], pa.int32()), "first": [first[1]], "last": [last]})


def judge(
    pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = ALLOW
) -> DataFrame:
    """page id, host, path, winning rule (or null) and verdict of every row of ``pages``."""
    urls = pages.select(F.col(page_id).alias("__id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    urls = urls.withColumn("__key", key(F.col("host")))
    urls = urls.repartitionByRange("__key", "path", "__id").sortWithinPartitions("__key")
    urls = cut_lineage(urls.withColumn("__range", F.spark_partition_id()))
    extents = sorted(tuple(r) for r in urls.mapInArrow(_extents, "r int, first string, last string").collect())
    numbers, firsts, lasts = ([e[k] for e in extents] for k in range(3))

    def touched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for keys in batches:
            yield pa.array(
                [numbers[bisect_left(lasts, k) : bisect_left(firsts, beyond(k))] for k in keys.to_pylist()],
                pa.list_(pa.int32()),
            )

    spread = (
        rules.select("action", ascii_lower(F.col("host")).alias("host"), "path").dropna().distinct()
        .withColumn("__key", key(F.col("host")))
        .withColumn("__range", F.explode(F.arrow_udf(touched, "array<int>")("__key")))
        .select(F.lit(None).cast(urls.schema["__id"].dataType).alias("__id"), "host", "path", "__key", "__range",
                F.col("action").alias("__action"))
    )
    both = urls.withColumn("__action", F.lit(None).cast("string")).unionByName(spread)
    swept = both.repartition("__range").sortWithinPartitions("__range", "__key", F.col("__action").isNull())
    id_type = urls.schema["__id"].dataType.simpleString()
    judged = swept.mapInArrow(_sweep, f"__id {id_type}, host string, path string, rule string, action string")
    return judged.select(
        F.col("__id").alias(page_id), "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict")
    )


def report(pages: DataFrame) -> DataFrame:
    return judge(pages, rule_table(pages.sparkSession))


SQL = r"""
WITH r(verdict, h, p) AS (VALUES
  ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
u AS (
  SELECT row_number() OVER () AS n, page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fit AS (
  SELECT n, arg_max(h || p, len(h || p)) AS rule, arg_max(verdict, len(h || p)) AS verdict
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN fit USING (n)
"""
