"""Side-by-side check of a Spark query against its DuckDB oracle.

Mirrors the acceptance check: same row count, same column names, and the
same multiset of rows (columns sorted by name, rows sorted). Floats are
compared exactly by default; ``tol`` reports near-misses separately.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import duckdb
import pandas as pd

VIEWS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
         "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for v in VIEWS:
        con.execute(f"create view {v} as select * from read_parquet('{sf_dir}/{v}.parquet')")
    return con


@dataclass
class Outcome:
    name: str
    rows_spark: int
    rows_oracle: int
    columns_match: bool
    values_match: bool
    near_match: bool
    detail: str = ""

    @property
    def ok(self) -> bool:
        return self.rows_spark == self.rows_oracle and self.columns_match and self.values_match


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except (ValueError, AttributeError):
            pass
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    try:
        import numpy as np
        if isinstance(v, np.ndarray):
            return tuple(_norm(x) for x in v.tolist())
    except ImportError:
        pass
    if hasattr(v, "as_py"):
        return v.as_py()
    from decimal import Decimal
    if isinstance(v, Decimal):
        return float(v)
    return v


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def _close(a, b, tol: float) -> bool:
    if isinstance(a, float) and isinstance(b, (float, int)) or isinstance(b, float) and isinstance(a, (float, int)):
        return abs(a - b) <= tol * max(1.0, abs(a), abs(b))
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(_close(x, y, tol) for x, y in zip(a, b))
    return a == b


def compare(name: str, spark_df, con: duckdb.DuckDBPyConnection, sql: str, tol: float = 1e-9) -> Outcome:
    s = spark_df.toPandas()
    o = con.execute(sql).df()
    cols_ok = sorted(s.columns) == sorted(o.columns)
    if not cols_ok:
        return Outcome(name, len(s), len(o), False, False, False,
                       f"columns spark={sorted(s.columns)} oracle={sorted(o.columns)}")
    rs, ro = _rows(s), _rows(o)
    exact = rs == ro
    near = exact or (len(rs) == len(ro) and all(_close(a, b, tol) for a, b in zip(rs, ro)))
    detail = ""
    if not exact:
        diffs = [(a, b) for a, b in zip(rs, ro) if a != b][:3]
        detail = f"first diffs: {diffs}"
    return Outcome(name, len(s), len(o), True, exact, near, detail)
