"""Run registered queries against their SQL counterparts: python tests/oracle_check.py [sf] [prefix,...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA:
            return None
        if isinstance(v, float):
            return None if v != v else round(v, 9) + 0.0
        if isinstance(v, (bool, str)):
            return v
        return int(v) if hasattr(v, "__int__") else v

    cols = sorted(pdf.columns)
    rows = [tuple(one(v) for v in r) for r in pdf[cols].astype(object).itertuples(index=False)]
    return sorted(rows, key=repr)


def compare(spark, con, name, query, sql, sf_dir) -> str:
    df = query(spark, sf_dir)
    got = df.toPandas()
    if sql is None:
        return f"rows only: {len(got)}"
    res = con.execute(sql)
    want_types = {d[0]: str(d[1]) for d in res.description}
    want = res.df()
    if sorted(got.columns) != sorted(want.columns):
        return f"FAIL columns {sorted(got.columns)} != {sorted(want.columns)}"
    types = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    off = {c: (types[c], want_types[c]) for c in types if types[c] != want_types[c]}
    a, b = canonical(got), canonical(want)
    if len(a) != len(b):
        return f"FAIL rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"FAIL {len(bad)} of {len(a)} differ, e.g.\n   spark {str(bad[0][0])[:600]}\n   sql   {str(bad[0][1])[:600]}"
    return f"ok {len(a)} rows" + (f" TYPES {off}" if off else "")


def main() -> int:
    import __spark_entry__ as entry
    from tests.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2].split(",") if len(sys.argv) > 2 else [""]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = connect(sf_dir)
    failed = ran = 0
    oracle = entry.oracle_sql()
    for name, q in entry.queries().items():
        if not any(name.startswith(w) for w in wanted):
            continue
        ran += 1
        t0 = time.time()
        try:
            msg = compare(spark, con, name, q, oracle.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            msg = f"FAIL {type(e).__name__}: {str(e)[:1500]}"
        failed += msg.startswith("FAIL")
        print(f"{name:34s} {time.time()-t0:6.2f}s {msg}", flush=True)
    print("failed:", failed, "of", ran)
    return failed if ran else 1


if __name__ == "__main__":
    sys.exit(main())
