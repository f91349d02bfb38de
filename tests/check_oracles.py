"""Compare registered queries with their SQL twins: python -m tests.check_oracles [sf] [name ...]"""

from __future__ import annotations

import sys
import tempfile
import time
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    """A connection of its own: one that a fatal error invalidates takes no other down.
    Large results spill to a temporary folder instead of failing."""
    folder = tempfile.mkdtemp(prefix="tendero-duck-")
    con = duckdb.connect(config={"memory_limit": "6GB", "temp_directory": folder, "threads": 4})
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def kind(value) -> str:
    return type(value).__name__


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, [tuple(r[n] for n in names) for r in df.collect()]


def rows_of_duck(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(r[i] for i in order) for r in cur.fetchall()]


def text(value) -> str:
    return repr(value)


def compare(df, con, sql, times=None) -> str | None:
    """None when equal, else what differs first."""
    start = time.time()
    names, got = rows_of_spark(df)
    if times is not None:
        times.append(time.time() - start)
    want_names, want = rows_of_duck(con, sql)
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = sorted(map(text, got)), sorted(map(text, want))
    for x, y in zip(a, b):
        if x != y:
            return f"\n   spark  {x[:600]}\n   duckdb {y[:600]}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tendero.session import clear_scratch, local_session

    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    sqls, bad = oracle_sql(), []
    for name, build in queries().items():
        if len(args) > 1 and not any(name.startswith(a) for a in args[1:]):
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            if name in sqls:
                times = []
                with duck(sf_dir) as con:
                    problem = compare(df, con, sqls[name], times)
                n = f"spark {times[0]:.2f}s"
            else:
                n, problem = f"{df.count()} rows, no SQL", None
        except Exception as error:  # noqa: BLE001
            problem, n = f"{kind(error)}: {str(error)[:700]}", ""
        took = time.time() - start
        if problem:
            bad.append(name)
        print(f"{'FAIL' if problem else 'ok  '} {took:6.2f}s {name} {problem or n}", flush=True)
    clear_scratch(spark)
    print(f"{len(bad)} failures: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
