"""Run Spark queries beside their SQL and report differences.

python -m tests.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _plain(value):
    return float(value) if isinstance(value, Decimal) else value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, sf_dir: str, connection, query, sql: str) -> str | None:
    frame = query(spark, sf_dir)
    ours = _rows(frame.columns, frame.collect())
    relation = connection.execute(sql)
    columns = [d[0] for d in relation.description]
    theirs = _rows(columns, relation.fetchall())
    if sorted(frame.columns) != sorted(columns):
        return f"columns {sorted(frame.columns)} / {sorted(columns)}"
    if ours == theirs:
        return None
    pairs = [(a, b) for a, b in zip(ours, theirs) if a != b][:2]
    return f"{len(ours)} / {len(theirs)} rows; " + "; ".join(f"{repr(a)[:400]}\n      / {repr(b)[:400]}" for a, b in pairs)


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from jobharbor.session import build_session

    where = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.enabled": "false"})
    session.sparkContext.setLogLevel("OFF")
    database = connect(where)
    bad = 0
    for name, run in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            found = difference(session, where, database, run, oracle_sql()[name]) if name in oracle_sql() else f"no SQL, {run(session, where).count()} rows"
        except Exception as failure:
            found = f"{type(failure).__name__}: {str(failure)[:1500]}"
        bad += found is not None
        print(f"{name:28} {time.time() - start:6.1f}s  {found or 'equal'}", flush=True)
    print(f"{bad} differ")
