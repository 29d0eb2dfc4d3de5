"""Compare registered queries with their SQL: ``python tests/oracle.py [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = Path("/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else float(v)
    if hasattr(v, "asDict"):
        return _plain(v.asDict())
    if isinstance(v, dict):
        return tuple((k, _plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, fn, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    took = time.time() - start
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {took:.1f}s"
    start = time.time()
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    kinds = {c[0]: str(c[1]) for c in res.description}
    want = rows_of(names, res.fetchall())
    note = f"{len(got)} rows, spark {took:.1f}s, sql {time.time() - start:.1f}s"
    if sorted(names) != sorted(df.columns):
        return False, f"columns differ: {sorted(set(names) ^ set(df.columns))} {note}"
    alias = {"double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN",
             "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
    odd = [f"{c}:{t}/{kinds[c]}" for c, t in df.dtypes if t in alias and alias[t] != kinds[c]]
    if len(got) != len(want):
        return False, f"{len(got)} rows, SQL {len(want)}; {note} types {odd}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        cols = sorted(names)
        where = {}
        for a, b in bad:
            for c, x, y in zip(cols, a, b):
                if x != y:
                    where.setdefault(c, []).append((x, y))
        text = "; ".join(f"{c}: {len(v)} e.g. {v[0]}" for c, v in list(where.items())[:6])
        return False, f"{len(bad)}/{len(got)} rows differ ({text}) {note} types {odd}"
    if odd:
        return False, f"types {odd} {note}"
    return True, note


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("barloom-check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry

    sf, names = (argv[0] if argv else "0.01"), argv[1:]
    sf_dir = str(DATA / f"sf{sf}")
    spark, con = session(), connect(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    failed = []
    for name in qs:
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        try:
            ok, note = compare(spark, con, sf_dir, qs[name], sqls.get(name))
        except Exception as e:  # report and go on with the other queries
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
