"""Run registered queries beside their SQL in DuckDB and compare rows.

    python tests/compare.py [sf_dir] [query ...]

With COMPARE_SHUFFLE=1 no side of a join is broadcast, as with large inputs.
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from datetime import date, datetime

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or isinstance(v, (str, datetime, date)):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 9) + 0.0
    return float(v) if hasattr(v, "is_finite") else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return Counter(tuple(plain(r[n]) for n in order) for r in rows)


def compare(name, df, con, sql):
    """Problems found, as text; empty if both agree."""
    got = df.collect()
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return f"columns {sorted(df.columns)} vs {sorted(want_cols)}", len(got)
    if not got:
        return "no rows", 0
    kinds = dict(zip(want_cols, (str(d[1]) for d in cur.description)))
    pairs = {
        "bigint": {"BIGINT", "HUGEINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "string": {"VARCHAR"},
        "timestamp_ntz": {"TIMESTAMP", "DATETIME"}, "boolean": {"BOOLEAN", "BOOL"}, "date": {"DATE"},
    }
    loose = {"bigint": "NUMBER", "int": "NUMBER", "double": "NUMBER", "string": "STRING", "timestamp_ntz": "DATETIME", "boolean": "bool", "date": "Date"}
    bad = [
        f"{f.name}: {f.dataType.simpleString()} vs {kinds[f.name]}"
        for f in df.schema.fields
        if kinds[f.name] not in pairs.get(f.dataType.simpleString(), set())
        and kinds[f.name] != loose.get(f.dataType.simpleString())
    ]
    a, b = rows_of(df.columns, got), rows_of(want_cols, want)
    if a != b:
        only_a, only_b = list((a - b).elements()), list((b - a).elements())
        return (
            f"{len(got)} vs {len(want)} rows; columns {sorted(want_cols)}; only here {len(only_a)}: "
            f"{sorted(only_a, key=str)[:3]}; only SQL {len(only_b)}: {sorted(only_b, key=str)[:3]}"
        ), len(got)
    return ("types " + "; ".join(bad)) if bad else "", len(got)


def main(argv):
    from drivetrace.registry import ORACLES, QUERIES
    from drivetrace.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = local_session()
    if os.environ.get("COMPARE_SHUFFLE"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    con = oracle_connection(sf_dir)
    failed = 0
    for name in names:
        started = time.time()
        try:
            problem, n = compare(name, QUERIES[name](spark, sf_dir), con, ORACLES[name]) if name in ORACLES else ("no SQL", QUERIES[name](spark, sf_dir).count())
        except Exception as ex:  # noqa: BLE001
            problem, n = f"{type(ex).__name__}: {str(ex)[:1500]}", 0
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {n:7d} rows {time.time() - started:6.2f}s {problem}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
