"""Run registered queries in Spark and their check SQL in DuckDB, and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, name: str, sf: str, queries, oracles) -> str | None:
    """None when both sides agree, else what differs."""
    df = queries[name](spark, sf)
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    if name not in oracles:
        return None if got else "no rows"
    cur = con.execute(oracles[name])
    want_names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}"
    a, b = rows_of(got_names, got), rows_of(want_names, want)
    if a == b:
        return None
    in_a, in_b = set(map(repr, a)), set(map(repr, b))
    only_a, only_b = [x for x in a if repr(x) not in in_b][:2], [x for x in b if repr(x) not in in_a][:2]
    return f"{len(a)} vs {len(b)} rows; spark only {str(only_a)[:600]}; sql only {str(only_b)[:600]}"


def main() -> None:
    from tests.conftest import make_session
    from __spark_entry__ import oracle_sql, queries

    sf = "/root/testdata/sf0.01"
    names = sys.argv[1:]
    spark, con = make_session(), connect(sf)
    qs, os_ = queries(), oracle_sql()
    bad = 0
    for name in names or qs:
        start = time.time()
        try:
            diff = difference(spark, con, name, sf, qs, os_)
        except Exception as error:  # noqa: BLE001 - reported, not hidden
            diff = f"{type(error).__name__}: {str(error)[:900]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'DIFF'} {name} {time.time() - start:.1f}s {'' if name in os_ else '(no sql)'} {diff or ''}", flush=True)
    print(f"{bad} of {len(names or qs)} differ")


if __name__ == "__main__":
    main()
