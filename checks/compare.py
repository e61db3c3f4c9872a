"""Run registered queries beside their SQL and compare: python -m checks.compare [sf] [name ...]"""

from __future__ import annotations

import sys
import time

import duckdb

from lakeimpact.session import local_session

from .oracles import oracle_sql
from .queries import queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows), sorted(columns)


def main(sf: str, names: list[str]) -> int:
    spark = local_session("compare")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    oracles, failed = oracle_sql(), []
    for name, query in queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            df = query(spark, sf)
            mine, my_columns = rows_of(df.columns, [tuple(r) for r in df.collect()])
        except Exception as error:  # noqa: BLE001  (report and go on with the next query)
            failed.append(name)
            print(f"{name:26} {error}"[:900], flush=True)
            continue
        took = time.time() - began
        if name not in oracles:
            print(f"{name:26} rows {len(mine):8} no SQL  {took:6.2f}s", flush=True)
            continue
        began = time.time()
        try:
            cursor = con.execute(oracles[name])
        except duckdb.Error as error:
            failed.append(name)
            print(f"{name:26} {error}"[:600], flush=True)
            continue
        columns = [c[0] for c in cursor.description]
        theirs, their_columns = rows_of(columns, cursor.fetchall())
        same = mine == theirs and my_columns == their_columns
        print(
            f"{name:26} rows {len(mine):8} {len(theirs):8} {'same' if same else 'DIFFERENT'}"
            f"  {took:6.2f}s  sql {time.time() - began:6.2f}s",
            flush=True,
        )
        if not same:
            failed.append(name)
            print("   columns", my_columns, their_columns)
            print("   only spark", sorted(set(mine) - set(theirs))[:5])
            print("   only sql  ", sorted(set(theirs) - set(mine))[:5])
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    raise SystemExit(main(folder, sys.argv[2:]))
