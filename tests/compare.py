"""Runs queries and their SQL twins side by side and compares names, rows and values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(row[i]) for i in order) for row in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


KINDS = {"bigint": {"BIGINT", "INTEGER", "HUGEINT"}, "string": {"VARCHAR"}, "boolean": {"BOOLEAN"}, "double": {"DOUBLE"}}


def difference(df, con, sql: str) -> str | None:
    """What differs, or None."""
    got = rows_of(df.columns, [tuple(row) for row in df.collect()])
    result = con.execute(sql)
    names = [column[0] for column in result.description]
    kinds = {column[0]: str(column[1]) for column in result.description}
    wanted = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    odd = [(n, t, kinds[n]) for n, t in df.dtypes if kinds[n] not in KINDS.get(t, set()) and kinds[n] != '"NULL"']
    if odd:
        return f"types {odd}"
    if got != wanted:
        only_got = [row for row in got if row not in set(wanted)][:3]
        only_wanted = [row for row in wanted if row not in set(got)][:3]
        return f"{len(got)} and {len(wanted)} rows; only ours {only_got}; only theirs {only_wanted}"
    return None


def main() -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as contract
    from pathloom.session import local_session

    folder, only = sys.argv[1], sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles = database(folder), contract.oracle_sql()
    for name, build in contract.queries().items():
        if only and name not in only:
            continue
        started = time.time()
        try:
            df = build(spark, folder)
            found = difference(df, con, oracles[name]) if name in oracles else f"no SQL, {df.count()} rows"
        except Exception as error:  # noqa: BLE001
            found = f"ERROR {str(error)[:1200]}"
        print(f"{'ok' if found is None else 'DIFF'} {name} {time.time() - started:.1f}s {found or ''}"[:1800], flush=True)


if __name__ == "__main__":
    main()
