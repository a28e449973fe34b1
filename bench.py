"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

The given tables are single files of one row group, which one core would read through every narrow step. They are
written out in parts first, as tables of any size have them; that is not timed. Each query runs
``$BENCH_RUNS`` times (3) after a warm-up and counts with its median; ``shuffles`` are those of its final plans.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "layout_text", "search_counts", "phrase_search", "search_boxes", "phrase_search_all", "group_lines", "left_to_right",
    "region_text", "words_in_region", "page_text", "line_at_point", "nearest_line", "edit_target", "hit_test", "visible_words",
    "merge_documents", "extract_pages", "reorder_page", "flatten_annotations", "annotation_state",
)
TABLES = ("documents", "events", "benchmark", "labels", "conversations")


def in_parts(spark: SparkSession, sf_dir: str, parts: int) -> str:
    """A copy of the tables that the queries read, each in several files."""
    out = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for name in TABLES:
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        rows.repartition(parts).write.parquet(f"{out}/{name}.parquet")
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "20g")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from quirelake.catalog.queries import registered

    names = sys.argv[1:] or HEADLINE
    known = registered()
    data = in_parts(spark, sf_dir, 4 * int(cpus))
    known["phrase_search"](spark, data).write.format("noop").mode("overwrite").save()  # warm up
    seconds, shuffles = {}, {}
    for name in names:
        took = []
        for _ in range(runs):
            start = time.perf_counter()
            rows = known[name](spark, data)
            rows.write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took), 3)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        shuffles[name] = len(re.findall(r"(?<!Reused)Exchange (?:hash|range|RoundRobin)", plan))
    print(
        json.dumps(
            {
                "metric": "headline queries, total of median wall clocks", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "shuffles": shuffles, "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
