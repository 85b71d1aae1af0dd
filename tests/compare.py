"""Runs registered queries beside their SQL: `python tests/compare.py [sf_dir] [name part ...]`."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(picked, key=repr)


def type_kind(name: str) -> str:
    name = str(name).lower()
    return {"integer": "int", "varchar": "string", "long": "bigint"}.get(name, name)


def difference(df, con, sql: str) -> str:
    """Empty when the query and its SQL agree in names, types, row count and values."""
    rel = con.sql(sql)
    sql_cols, sql_types = rel.columns, [type_kind(t) for t in rel.types]
    want = rows_of(sql_cols, rel.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got[0] != want[0]:
        return f"columns {got[0]} / {want[0]}"
    spark_types = {f.name: type_kind(f.dataType.simpleString()) for f in df.schema.fields}
    types = {n: (spark_types[n], t) for n, t in zip(sql_cols, sql_types) if spark_types[n] != t}
    if types:
        return f"types {types}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} / {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"values\n   spark {str(a)[:600]}\n   sql   {str(b)[:600]}"
    return ""


def main() -> None:
    import __spark_entry__ as entry
    from tests.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark, con = local_session(), duck(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            df = query(spark, sf_dir)
            if name in sqls:
                text = difference(df, con, sqls[name]) or "equal"
            else:
                text = f"no sql, {len(df.collect())} rows"
        except Exception as e:  # noqa: BLE001
            text = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += text != "equal" and not text.startswith("no sql")
        n = len(df.columns) if not text.startswith(("Attr", "Type")) else 0
        print(f"{time.time() - t:6.1f}s  {name}: {text}", flush=True)
    print("not equal:", bad)


if __name__ == "__main__":
    main()
