"""Run registered queries in Spark and their SQL in DuckDB and compare all rows."""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, str, bytes)):
        return value
    if isinstance(value, float):
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def ordered(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, sf_dir: str, query, sql: str):
    """None when equal, else a message."""
    df = query(spark, sf_dir)
    got = ordered(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = ordered(names, cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows, expected {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if repr(g) != repr(w)]
    if bad:
        return f"{len(bad)} of {len(want[1])} rows differ, first {got[0]}:\n   got  {bad[0][0]}\n   want {bad[0][1]}"
    return None if want[1] else "EMPTY"


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from ledgerloom.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    wanted = argv[2:]
    spark, con = local_session(), connect(sf_dir)
    queries, checks = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, query in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in checks:
                problem = compare(spark, con, sf_dir, query, checks[name])
            else:
                n = len(query(spark, sf_dir).collect())
                problem = None if n else "EMPTY"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name} {time.time() - start:.2f}s {'' if name in checks else '(rows only)'} {problem or ''}", flush=True)
    print("failed:", failed, "queries:", len(queries), "with SQL:", len(checks))
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
