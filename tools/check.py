"""Run queries and their SQL side by side: python tools/check.py [folder] [name ...]."""

from __future__ import annotations

import decimal
import pathlib
import sys
import time

import duckdb

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from pastward.plans.registry import all_queries  # noqa: E402
from pastward.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, float) and value != value:
        return None
    if hasattr(value, "tzinfo") and getattr(value, "tzinfo", None) is not None:
        return value.replace(tzinfo=None)
    return value


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    out.sort(key=repr)
    return [columns[i] for i in order], out


def compare(spark_df, con, sql):
    left = table_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    types = {d[0]: str(d[1]) for d in result.description}
    right = table_of([d[0] for d in result.description], result.fetchall())
    if left[0] != right[0]:
        return f"columns differ: {left[0]} vs {right[0]}"
    odd = [c for c, t in types.items() if "HUGEINT" in t or "DECIMAL" in t]
    if odd:
        return f"oracle types need a cast: {odd}"
    if len(left[1]) != len(right[1]):
        return f"rows differ: {len(left[1])} vs {len(right[1])}"
    bad = [(a, b) for a, b in zip(left[1], right[1]) if a != b or repr(a) != repr(b)]
    if bad:
        other = set(map(repr, right[1]))
        mine = set(map(repr, left[1]))
        only = [r for r in left[1] if repr(r) not in other]
        theirs = [r for r in right[1] if repr(r) not in mine]
        return f"{len(only)} of {len(left[1])} rows differ, columns {left[0]}\n   spark {only[:2]}\n   sql   {theirs[:2]}"
    return ("ok" if left[1] else "ok (EMPTY)") + f" {len(left[1])} rows"


def main(argv):
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark = local_session()
    con = connect(folder)
    failures = 0
    for name, query in all_queries().items():
        if names and not any(name == n or name.startswith(n.rstrip("*")) and n.endswith("*") for n in names):
            continue
        start = time.time()
        try:
            if query.sql is None:
                rows = query.run(spark, folder).collect()
                status = f"ok rows-only {len(rows)}"
            else:
                status = compare(query.run(spark, folder), con, query.sql)
        except Exception as error:  # report and go on with the next query
            status = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        failures += not status.startswith("ok")
        print(f"{name:40s} {time.time() - start:6.2f}s {status}", flush=True)
    print("failures:", failures)
    return failures


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
