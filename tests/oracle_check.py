"""Run registered queries against their SQL: ``python tests/oracle_check.py SF_DIR [query ...]``."""

from __future__ import annotations

import faulthandler
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

# Integer widths matter; how an engine spells its types does not.
_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _clean(v):
    return None if isinstance(v, float) and math.isnan(v) else v


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_clean(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty when both sides agree, else what differs."""
    got_types = {f.name: _TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    pdf = df.toPandas()
    got_cols = list(pdf.columns)
    got = _rows(got_cols, pdf.astype(object).where(pdf.notna(), None).itertuples(index=False))
    rel = con.execute(sql)
    want_cols = [d[0] for d in rel.description]
    want_types = {d[0]: str(d[1]) for d in rel.description}
    want = _rows(want_cols, rel.fetchall())
    if got_types != want_types:
        return f"types {got_types} != {want_types}"
    if len(got) != len(want):
        return f"{len(got)} rows, want {len(want)}; {list(set(got) ^ set(want))[:4]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else ""


def main() -> int:
    from conftest import session

    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    faulthandler.dump_traceback_later(900, exit=True)
    spark, con, sql, failed = session(), connect(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            diff = compare(query(spark, sf_dir), con, sql[name])
        except Exception as e:  # noqa: BLE001
            diff = f"{type(e).__name__}: {str(e)[:600]}"
        failed += bool(diff)
        print(f"{'FAIL' if diff else 'ok':5}{name:28}{time.time() - t0:7.1f}s  {diff}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
