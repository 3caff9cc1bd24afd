"""Compare every named query with its SQL in DuckDB on the same files.

    python -m opslens.plans.check /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import sys
import time
from datetime import date, datetime
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, Decimal):
        return float(v) if v != v.to_integral_value() else int(v)
    if isinstance(v, float) and v == int(v) if isinstance(v, float) and abs(v) < 1e15 else False:
        return int(v)
    if isinstance(v, datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def keyed(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, sf_dir: str, fn, sql: str | None) -> tuple[bool | None, str]:
    t0 = time.time()
    df = fn(spark, sf_dir)
    rows = df.collect()
    took = time.time() - t0
    if sql is None:
        return None, f"{len(rows)} rows, no SQL, {took:.2f} s"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(names)}"
    a, b = keyed(rows, df.columns), keyed(want, names)
    if a == b:
        return True, f"{len(a)} rows, {took:.2f} s"
    only_a = [x for x in a if x not in set(b)][:3] if len(a) < 200_000 else a[:1]
    only_b = [x for x in b if x not in set(a)][:3] if len(b) < 200_000 else b[:1]
    return False, f"{len(a)} against {len(b)} rows; columns {sorted(names)}; spark {only_a}; sql {only_b}"


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("opslens")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str]) -> int:
    from opslens.plans import CHECKS, QUERIES

    sf_dir, names = argv[0], argv[1:]
    spark, con = session(), duck(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if names and not any(n in name for n in names):
            continue
        try:
            ok, text = compare(spark, con, sf_dir, fn, CHECKS.get(name))
        except Exception as e:  # report and go on to the next query
            ok, text = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += ok is False
        print({True: "ok  ", False: "FAIL", None: "rows"}[ok], name, text, flush=True)
    print(f"{bad} failures")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
