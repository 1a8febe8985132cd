"""Run registered queries in Spark and their SQL in DuckDB and compare every row."""

from __future__ import annotations

import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple("\x00" if r[i] is None else str(r[i]) for i in order) for r in rows])


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}


def compare(spark, con, sf_dir, fn, sql):
    """None when equal, otherwise a short description of the difference."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    types = {c[0]: str(c[1]) for c in cur.description}
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    odd = {
        c: (t, types[c])
        for c, t in df.dtypes
        if (TYPES.get(t) or t.upper()) != types[c]
    }
    a, b = _rows(df.columns, got), _rows(names, want)
    if a != b:
        extra = [x for x in a if x not in set(b)][:3]
        missing = [x for x in b if x not in set(a)][:3]
        return f"rows {len(a)} vs {len(b)}\n  spark only {extra}\n  sql only   {missing}"
    if odd:
        return f"types {odd}"
    return None


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf_dir = sys.argv[1]
    only = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf_dir), []
    qs, os_ = e.queries(), e.oracle_sql()
    for name, fn in qs.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t = time.time()
        try:
            if name in os_:
                diff = compare(spark, con, sf_dir, fn, os_[name])
                n = ""
            else:
                n = f" rows={len(fn(spark, sf_dir).collect())} (no SQL)"
                diff = None
        except Exception as ex:  # noqa: BLE001
            diff = f"{type(ex).__name__}: {str(ex)[:600]}"
        print(f"{'ok ' if diff is None else 'BAD'} {name} {time.time() - t:.1f}s{n if diff is None else ''}", flush=True)
        if diff is not None:
            bad.append(name)
            print("   ", diff, flush=True)
    print(f"{len(bad)} bad: {bad}")


if __name__ == "__main__":
    main()
