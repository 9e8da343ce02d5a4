"""Run registered queries and their SQL twins side by side and report differences.

    python tests/check_twins.py [--sf DIR] [--time] [key-prefix ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def normal(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"f{value:.9g}"
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(normal(v) for v in value) + "]"
    if isinstance(value, dict):
        return "[" + ",".join(normal(v) for v in value.values()) + "]"
    return f"{type(value).__name__}:{value}"


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(df, con, sql, spent):
    begun = time.time()
    names = sorted(df.columns)
    spark_rows = [tuple(normal(r[n]) for n in names) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    spent["spark"] = spent.get("spark", 0.0) + time.time() - begun
    begun = time.time()
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    if sorted(columns) != names:
        only = set(names) ^ set(columns)
        return f"columns differ: {sorted(only)}", len(spark_rows)
    order = [columns.index(n) for n in names]
    kinds = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "date": "DATE"}
    spark_types = {f.name: kinds.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    other = {d[0]: str(d[1]) for d in rel.description}
    off = [(n, spark_types[n], other[n]) for n in names if spark_types[n] != other[n]]
    if off:
        print(f"     types {off[:8]}", flush=True)
    duck_rows = [tuple(normal(r[i]) for i in order) for r in rel.fetchall()]
    spent["duckdb"] = time.time() - begun
    if len(spark_rows) != len(duck_rows):
        return f"rows {len(spark_rows)} vs {len(duck_rows)}", len(spark_rows)
    a, b = sorted(spark_rows), sorted(duck_rows)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        x, y = bad[0]
        diff = [(n, p, q) for n, p, q in zip(names, x, y) if p != q][:6]
        return f"{len(bad)} rows differ, e.g. {diff}", len(a)
    return None, len(a)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--time", action="store_true")
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as entry
    from renewlake.session import local_session

    spark = local_session(8)
    con = duck(args.sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    unknown = set(oracles) - set(queries)
    if unknown:
        print("twins without a query:", sorted(unknown))
    bad = 0
    for key, run in queries.items():
        if args.keys and not any(key == k or (k.endswith("*") and key.startswith(k[:-1])) for k in args.keys):
            continue
        start, spent = time.time(), {}
        try:
            df = run(spark, args.sf)
            spent["spark"] = time.time() - start
            if key in oracles:
                problem, n = compare(df, con, oracles[key], spent)
            else:
                problem, n = None, df.count()
        except Exception as error:  # report and go on
            problem, n = f"{type(error).__name__}: {str(error)[:600]}", -1
        if problem or n == 0:
            bad += 1
            print(f"BAD  {key}: {problem or 'no rows'}", flush=True)
        elif args.time or args.keys:
            print(f"ok   {key} rows={n} {'twin' if key in oracles else 'rows-only'} {time.time() - start:.1f}s "
                  + " ".join(f"{k}={v:.1f}" for k, v in spent.items()), flush=True)
    print(f"{len(queries)} queries, {len(oracles)} twins, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
