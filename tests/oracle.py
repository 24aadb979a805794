"""Run registered queries and their check SQL side by side and compare whole results."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

from corpusworks.plans.inputs import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, decimal.Decimal):
        return repr(float(value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, name, query, sql, sf_dir) -> str:
    """'' when equal, else what differs."""
    df = query(spark, sf_dir)
    ours = [tuple(r) for r in df.collect()]
    if sql is None:
        return "" if ours else "no rows"
    done = con.execute(sql)
    columns = [d[0] for d in done.description]
    theirs = done.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    a, b = normal(df.columns, ours), normal(columns, theirs)
    if a == b:
        return "" if a else "no rows"
    diff = next(((x, y) for x, y in zip(a, b) if x != y), None)
    types = {type(v).__name__ for row in ours[:50] for v in row} | {type(v).__name__ for row in theirs[:50] for v in row}
    return f"{len(a)} / {len(b)} rows, first difference {sorted(columns)} {diff} {types}"


def main() -> None:
    import __spark_entry__ as entry
    from corpusworks.session import local_session

    sf_dir = sys.argv[1]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    wanted = [n for n in queries if not sys.argv[2:] or any(w in n for w in sys.argv[2:])]
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            problem = compare(spark, con, name, queries[name], sql.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += bool(problem)
        mark = "FAIL" if problem else ("ok  " if name in sql else "rows")
        print(f"{mark} {name} {time.time() - start:.2f}s {problem[:1200]}", flush=True)
    print(f"{len(wanted)} queries, {bad} bad, {sum(n in sql for n in wanted)} with SQL")


if __name__ == "__main__":
    main()
