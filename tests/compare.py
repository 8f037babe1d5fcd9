"""Compare Spark results with DuckDB results, rows in any order, columns by name."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool) or value is None:
        return str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def kinds_duck(con, sql):
    return {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}


def differences(df, con, sql) -> list[str]:
    spark_cols, spark_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    duck_cols, duck_rows = rows_of([d[0] for d in cur.description], cur.fetchall())
    out = []
    if spark_cols != duck_cols:
        out.append(f"columns {spark_cols} != {duck_cols}")
    if len(spark_rows) != len(duck_rows):
        out.append(f"rows {len(spark_rows)} != {len(duck_rows)}")
    for a, b in zip(spark_rows, duck_rows):
        if a != b:
            out.append(f"first difference:\n  spark {str(a)[:600]}\n  duck  {str(b)[:600]}")
            break
    types = {n: t for n, t in df.dtypes}
    match = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for name, kind in kinds_duck(con, sql).items():
        if match.get(types.get(name), types.get(name)) != kind:
            out.append(f"type of {name}: {types.get(name)} != {kind}")
    return out


def main() -> None:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from quirewise.session import local_session

    root = sys.argv[1]
    names = sys.argv[2:] or list(entry.queries())
    spark = local_session(8)
    con = duck(root)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, root)
            sql = entry.oracle_sql().get(name)
            if sql is None:
                print(f"{name}: rows only, {df.count()} rows, {time.time() - start:.1f}s", flush=True)
                continue
            diff = differences(df, con, sql)
            n = df.count()
        except Exception as err:  # noqa: BLE001
            diff, n = [f"{type(err).__name__}: {str(err)[:1500]}"], -1
        bad += bool(diff)
        print(f"{name}: {'DIFF' if diff else 'ok'} {n} rows {time.time() - start:.1f}s", *diff, sep="\n  " if diff else "", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
