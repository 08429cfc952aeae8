"""Runs queries of __spark_entry__ against their SQL twins: python tests/differential.py FOLDER [NAME...]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canonical(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, Decimal):
        return float(f"{float(value):.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((str(k), canonical(v)) for k, v in value.items()))
    return value


def duck(base: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{base}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def difference(query, sql: str, spark, base: str, con) -> str:
    """Empty if both give the same columns and rows."""
    df = query(spark, base)
    columns = sorted(df.columns)
    got = Counter(tuple(canonical(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    order = [names.index(c) for c in columns]
    want = Counter(tuple(canonical(r[i]) for i in order) for r in cursor.fetchall())
    if got == want:
        return ""
    return f"rows {sum(got.values())} and {sum(want.values())}; only in Spark {list((got - want).items())[:3]}; only in SQL {list((want - got).items())[:3]}"


if __name__ == "__main__":
    import __spark_entry__ as e
    from lodestream.session import local_session

    base, names = sys.argv[1], sys.argv[2:]
    spark = local_session(shuffle_partitions=8)
    con, sql = duck(base), e.oracle_sql()
    bad = 0
    for name, query in e.queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            said = difference(query, sql[name], spark, base, con) if name in sql else f"no SQL, {query(spark, base).count()} rows"
        except Exception as error:
            said = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        bad += bool(said) and not said.startswith("no SQL")
        print(f"{name}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)
    sys.exit(bad > 0)
