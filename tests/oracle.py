"""Side-by-side check of registered queries against their DuckDB twins.

    python tests/oracle.py [sf] [name or prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str):
    try:
        import duckdb
    except ImportError:
        sys.path.append("/opt/oracle")
        import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(value):
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return "∅" if value != value else repr(value)
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return f"{type(value).__name__[:1]}:{value}"


def compare(spark_rows, spark_cols, duck_rows, duck_cols):
    """None when equal, else a short description of the difference."""
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns {sorted(spark_cols)} vs {sorted(duck_cols)}"
    s_order = sorted(range(len(spark_cols)), key=lambda i: spark_cols[i])
    d_order = sorted(range(len(duck_cols)), key=lambda i: duck_cols[i])
    left = sorted(tuple(canonical(r[i]) for i in s_order) for r in spark_rows)
    right = sorted(tuple(canonical(r[i]) for i in d_order) for r in duck_rows)
    if left == right:
        return None
    in_left, in_right = set(left), set(right)
    only_l = [r for r in left if r not in in_right]
    only_r = [r for r in right if r not in in_left]
    names = sorted(spark_cols)
    return (
        f"rows {len(left)} vs {len(right)}; {len(only_l)} only in spark, {len(only_r)} only in duckdb\n  {names}"
        + "".join(f"\n  spark  {r}" for r in only_l[:3])
        + "".join(f"\n  duckdb {r}" for r in only_r[:3])
    )


def main(argv):
    from pricetide.plans import registry
    from pricetide.session import build_session

    sf = argv[1] if len(argv) > 1 else "0.01"
    wanted = argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    registry.load_all()
    names = [n for n in registry.QUERIES if not wanted or any(n.startswith(w) for w in wanted)]
    spark = build_session("oracle", cores=8)
    con = connect(sf_dir)
    failed = []
    for name in names:
        start = time.time()
        try:
            df = registry.QUERIES[name](spark, sf_dir)
            rows = df.collect()
            spent = time.time() - start
            sql = registry.ORACLES.get(name)
            if sql is None:
                print(f"rows  {name:38s} {len(rows):7d} rows {spent:6.2f}s", flush=True)
                continue
            cur = con.execute(sql)
            cols = [d[0] for d in cur.description]
            problem = compare(rows, df.columns, cur.fetchall(), cols)
            if problem is None and not rows:
                problem = "empty result on both sides"
        except Exception as exc:  # noqa: BLE001 - report and go on
            problem, spent, rows = f"{type(exc).__name__}: {str(exc)[:400]}", time.time() - start, []
        print(f"{'ok   ' if problem is None else 'FAIL '} {name:38s} {len(rows):7d} rows {spent:6.2f}s", flush=True)
        if problem:
            failed.append(name)
            print("   " + problem, flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} good; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
