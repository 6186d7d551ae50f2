"""Run a query in Spark and its SQL in DuckDB, and compare names, types and rows."""

from __future__ import annotations

import decimal
import math
import time

import duckdb

spent: dict[str, float] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def kind(dtype: str) -> str:
    d = dtype.lower()
    if d in ("bigint", "long", "int", "integer", "smallint", "tinyint"):
        return "int"
    if d in ("double", "float", "real"):
        return "float"
    if d in ("string", "varchar"):
        return "text"
    return d


def cell(v):
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def rows_of(rows, order) -> list[tuple]:
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(df, con, sql: str) -> str | None:
    """What differs, or None."""
    start = time.time()
    rel = con.sql(sql)
    names, sql_names = df.columns, rel.columns
    if sorted(names) != sorted(sql_names):
        return f"columns {sorted(names)} vs {sorted(sql_names)}"
    types = {n: kind(t) for n, t in df.dtypes}
    sql_types = {n: kind(str(t)) for n, t in zip(sql_names, rel.types)}
    if types != sql_types:
        return "types " + str({n: (types[n], sql_types[n]) for n in types if types[n] != sql_types[n]})
    ordered = sorted(names)
    mine = rows_of([tuple(r) for r in df.collect()], [names.index(n) for n in ordered])
    spent["spark"] = time.time() - start
    theirs = rows_of(rel.fetchall(), [sql_names.index(n) for n in ordered])
    if len(mine) != len(theirs):
        return f"{len(mine)} rows vs {len(theirs)}"
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(mine)} rows differ, first {str(wrong[0])[:600]}"
    return None
