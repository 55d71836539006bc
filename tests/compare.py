"""Run registered queries next to their SQL twins: python tests/compare.py [sf_dir] [name-part ...]"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (round(v, 9) + 0.0)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    if type(v).__name__ == "Decimal":
        return round(float(v), 9)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


FAMILY = {"BIGINT": "int", "INTEGER": "int", "HUGEINT": "huge", "DOUBLE": "float", "VARCHAR": "str", "BOOLEAN": "bool",
          "bigint": "int", "int": "int", "double": "float", "string": "str", "boolean": "bool"}


def differences(spark, con, sf_dir, fn, sql):
    """None when Spark and DuckDB agree, else a short description."""
    df = fn(spark, sf_dir)
    mine, cols = rows_of(df.columns, df.collect())
    rel = con.sql(sql)
    theirs, other = rows_of(rel.columns, rel.fetchall())
    if cols != other:
        return f"columns {cols} != {other}", len(mine)
    types = {c: FAMILY.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    for c, t in df.dtypes:
        if FAMILY.get(t, t) != types[c]:
            return f"type of {c}: spark {t}, duckdb {types[c]}", len(mine)
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}", len(mine)
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        return f"{len(bad)} rows differ, first {bad[0]} columns {cols}", len(mine)
    return None, len(mine)


if __name__ == "__main__":
    import __spark_entry__ as entry
    from signalblind.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sqls = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if len(sys.argv) > 2 and not any(p in name for p in sys.argv[2:]):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem, n = differences(spark, con, sf, fn, sqls[name])
            else:
                problem, n = None, fn(spark, sf).count()
                name += " (no SQL)"
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:600]}", 0
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {n} rows {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failed:", failed)
