"""Runs a query's SQL on DuckDB and compares rows."""

import os

import duckdb

DATA = "/root/testdata"


def views(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def differences(con, df, sql):
    """(rows, rows of the one side only, whether the types agree)."""
    got = df.toArrow()
    con.register("got", got)
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    a, b = f"(SELECT {columns} FROM got)", f"(SELECT {columns} FROM ({sql}))"
    only = con.execute(f"({a} EXCEPT ALL {b}) UNION ALL ({b} EXCEPT ALL {a})").fetchall()
    types = [[x[1] for x in con.execute(f"DESCRIBE {x}").fetchall()] for x in (a, b)]
    return got.num_rows, only, types[0] == types[1]
