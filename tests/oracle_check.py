"""Compare registered queries with their SQL on DuckDB: rows, types, values.

Usage: python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

# Spark type names and the DuckDB names they must meet.
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def _bag(rows, order) -> Counter:
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(df, con, sql: str) -> list[str]:
    """Differences between a Spark result and a SQL result; empty if there are none."""
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    expected = relation.fetchall()
    kinds = dict(zip(names, [r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()]))
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    for name, kind in df.dtypes:
        if TYPES.get(kind, kind) != kinds[name]:
            problems.append(f"type of {name}: {kind} against {kinds[name]}")
    rows = df.collect()
    if len(rows) != len(expected):
        problems.append(f"{len(rows)} rows against {len(expected)}")
    columns = sorted(names)
    ours = _bag(rows, [df.columns.index(c) for c in columns])
    theirs = _bag(expected, [names.index(c) for c in columns])
    if ours != theirs:
        extra, lacking = list((ours - theirs).items()), list((theirs - ours).items())
        problems.append(f"{len(extra)} values differ: {columns} {extra[:2]} against {lacking[:2]}")
    return problems


def main(argv) -> int:
    import __spark_entry__ as entry
    from conftest import make_spark

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con = make_spark(), duck(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in argv[1:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            problems = compare(df, con, sql[name]) if name in sql else []
            state = "rows" if name not in sql else "ok"
            rows = len(df.collect()) if name not in sql else ""
        except Exception as e:  # report and go on with the next query
            problems, state, rows = [f"{type(e).__name__}: {str(e)[:600]}"], "", ""
        failed += bool(problems)
        print(f"{name:26s} {time.time() - start:6.1f}s {'FAIL' if problems else state} {rows} {' | '.join(problems)}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
