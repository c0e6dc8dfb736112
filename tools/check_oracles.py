"""Run every registered query against its DuckDB oracle and print a table.

    python tools/check_oracles.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shopcast.queries import oracle_sql, queries  # noqa: E402
from shopcast.session import get_spark  # noqa: E402
from shopcast.testing import compare, duck  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = get_spark("local[8]", 8)
    con = duck(sf_dir)
    qs, orc = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        df = fn(spark, sf_dir)
        if name not in orc:
            n = df.count()
            print(f"{name:32s} rows-only   rows={n} {time.time() - t0:.1f}s", flush=True)
            continue
        out = compare(name, df, con, orc[name])
        status = "OK" if out.ok else ("NEAR" if out.near_match else "FAIL")
        if not out.ok:
            bad += 1
        print(f"{name:32s} {status:5s} spark={out.rows_spark} oracle={out.rows_oracle} "
              f"{time.time() - t0:.1f}s {out.detail[:600]}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
