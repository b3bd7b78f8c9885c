"""Compare a query with its SQL twin; also runnable: compare.py SF [name ...]."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


# Types that both engines write alike.
KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
}


def check(spark, con, name: str, sf_dir: str, queries, sql) -> tuple[bool, str]:
    df = queries[name](spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in sql:
        return True, f"rows {len(got)} (no SQL)"
    cur = con.execute(sql[name])
    kinds = {x[0]: str(x[1]) for x in cur.description}
    exp_cols, exp = rows_of([x[0] for x in cur.description], cur.fetchall())
    if got_cols != exp_cols:
        return False, f"columns {got_cols} != {exp_cols}"
    odd = [f"{c}:{t}/{kinds[c]}" for c, t in df.dtypes if KINDS.get(t, t) != kinds[c]]
    if got != exp:
        a, b = [r for r in got if r not in set(exp)][:2], [r for r in exp if r not in set(got)][:2]
        return False, f"{len(got)} vs {len(exp)} rows; spark {a} sql {b} {odd}"
    if odd:
        return False, f"types {odd}"
    return True, f"rows {len(got)}"


def main() -> None:
    import __spark_entry__ as entry
    from newsloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("compare")
    queries, sql = entry.queries(), entry.oracle_sql()
    con = oracle(sf_dir)
    names = sys.argv[2:] or list(queries)
    bad = 0
    for n in names:
        start = time.time()
        try:
            ok, note = check(spark, con, n, sf_dir, queries, sql)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {n:28s} {time.time() - start:6.2f}s {note}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main()
