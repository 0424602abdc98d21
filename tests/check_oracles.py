"""Compare every registered query with its SQL on one data folder.

    python tests/check_oracles.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9) + 0.0
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def compare(spark, con, folder, name, run, sql):
    """None when equal, else what differs."""
    df = run(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    rel = con.sql(sql)
    if sorted(rel.columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    want = rows_of(rel.columns, rel.fetchall())
    types = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    odd = [(c, d, kinds[c]) for c, d in df.dtypes if types.get(d, kinds[c]) != kinds[c]]
    if odd:
        return f"types {odd}"
    if got != want:
        first = next(((g, w) for g, w in zip(got, want) if g != w), "length")
        return f"rows {len(got)} != {len(want)}; first {str(first)[:600]}"
    return None if got else "no rows"


def main(folder, names):
    from __spark_entry__ import oracle_sql, queries
    from quirewise.session import get_session

    spark = get_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(folder), oracle_sql(), 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, folder, name, run, sqls.get(name))
        except Exception as exc:  # report and go on with the next query
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
