"""Run registered queries against their SQL: ``python tests/check_oracles.py [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry_module  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def _whole(column: pd.Series) -> pd.Series:
    """Whole numbers with nulls in one form: each engine hands them over as another type."""
    if column.dtype == "float64" and column.isna().any() and (column.dropna() % 1 == 0).all():
        return column.astype("Int64")
    return column


def _ordered(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), ignore_index=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when both hold the same bag of rows."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    got, want = _ordered(got), _ordered(want)
    for name in got.columns:
        a, b = _whole(got[name]), _whole(want[name])
        if a.dtype != b.dtype and "O" not in (a.dtype.kind, b.dtype.kind):
            return f"type of {name}: {a.dtype} != {b.dtype}"
        same = (a == b).fillna(False).to_numpy(bool) | (a.isna() & b.isna()).to_numpy()
        if not np.all(same):
            at = int(np.argmin(same))
            return f"{name}[{at}]: {a[at]!r} != {b[at]!r} ({int((~same).sum())} differ)"
    return None


def check(spark, connection, name: str, sf: str) -> str | None:
    got = entry_module.queries()[name](spark, sf).toPandas()
    statement = entry_module.oracle_sql().get(name)
    if statement is None:
        return None if len(got) else "no rows"
    return difference(got, connection.execute(statement).df())


def main() -> int:
    from conftest import make_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry_module.queries())
    spark, connection, failed = make_session(), connect(sf), 0
    for name in names:
        start = time.time()
        try:
            problem = check(spark, connection, name, sf)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
