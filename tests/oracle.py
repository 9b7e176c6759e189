"""Compare a registered query with its oracle statement on one dataset folder."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

from rankwell.plans.catalog import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (decimal.Decimal, float, int)):
        number = float(value)
        return "nan" if math.isnan(number) else round(number, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def normal(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> str:
    start = time.time()
    df = fn(spark, sf_dir)
    left = normal(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return f"ROWS {len(left[1])} {took:.1f}s"
    cursor = con.execute(sql)
    right = normal([d[0] for d in cursor.description], cursor.fetchall())
    if left[0] != right[0]:
        return f"COLUMNS {left[0]} vs {right[0]}"
    if left[1] != right[1]:
        only_left = [r for r in left[1] if r not in set(right[1])][:3]
        only_right = [r for r in right[1] if r not in set(left[1])][:3]
        return f"VALUES {len(left[1])} vs {len(right[1])}\n   spark  {str(only_left)[:1500]}\n   oracle {str(only_right)[:1500]}"
    return f"ok {len(left[1])} {took:.1f}s"


def main(argv: list[str]) -> None:
    import __spark_entry__ as entry
    from rankwell.session import build_session

    sf_dir = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("/"):
        sf_dir, argv = argv[0], argv[1:]
    spark = build_session(
        "check",
        **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(a == n or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    bad = 0
    for name in names:
        try:
            result = compare(spark, con, sf_dir, name, queries[name], oracles.get(name))
        except Exception as error:  # report and go on with the next query
            result = f"ERROR {type(error).__name__} {str(error)[:900]}"
        bad += not result.startswith(("ok", "ROWS"))
        print(f"{name:28} {result}", flush=True)
    print(f"{len(names)} checked, {bad} differ")


if __name__ == "__main__":
    main(sys.argv[1:])
