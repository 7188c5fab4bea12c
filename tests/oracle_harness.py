"""Run a catalog query in Spark and its oracle SQL in DuckDB and compare.

Usage as a script: ``python tests/oracle_harness.py [sf_dir] [key ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "boolean": "BOOLEAN", "smallint": "SMALLINT", "float": "FLOAT",
}


def duck_connection(sf_dir: str):
    import duckdb

    from basketry.sources.tables import TABLES

    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


EXACT = os.environ.get("ORACLE_EXACT") == "1"


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if EXACT else round(v, 9)
    return v


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def compare(spark, con, name: str, sf_dir: str) -> dict:
    from basketry.plans.catalog import QUERIES
    from basketry.plans.oracle import ORACLE

    t0 = time.time()
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    t_spark = time.time() - t0
    s_cols = df.columns
    s_types = [SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString().upper())
               for f in df.schema.fields]
    rel = con.sql(ORACLE[name])
    d_cols = rel.columns
    d_types = [str(t) for t in rel.types]
    d_rows = rel.fetchall()
    out = {"name": name, "spark_rows": len(rows), "oracle_rows": len(d_rows), "spark_sec": round(t_spark, 2)}
    out["names_ok"] = sorted(s_cols) == sorted(d_cols)
    out["types_ok"] = dict(zip(s_cols, s_types)) == dict(zip(d_cols, d_types))
    if not out["types_ok"]:
        out["types"] = {c: (dict(zip(s_cols, s_types)).get(c), dict(zip(d_cols, d_types)).get(c))
                        for c in set(s_cols) | set(d_cols)
                        if dict(zip(s_cols, s_types)).get(c) != dict(zip(d_cols, d_types)).get(c)}
    if out["names_ok"]:
        order = sorted(s_cols)
        si = [s_cols.index(c) for c in order]
        di = [d_cols.index(c) for c in order]
        sv = sorted((tuple(_norm(r[i]) for i in si) for r in rows), key=_key)
        dv = sorted((tuple(_norm(r[i]) for i in di) for r in d_rows), key=_key)
        out["values_ok"] = sv == dv
        if not out["values_ok"]:
            diff = [(a, b) for a, b in zip(sv, dv) if a != b]
            out["first_diff"] = diff[:2]
            out["n_diff"] = len(diff)
    else:
        out["values_ok"] = False
        out["cols"] = (s_cols, d_cols)
    out["ok"] = out["names_ok"] and out["types_ok"] and out["values_ok"] and len(rows) == len(d_rows)
    return out


def main(argv):
    from basketry.plans.catalog import QUERIES
    from basketry.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:] or list(QUERIES)
    spark = local_session(partitions=8, extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="basketry-harness-")})
    con = duck_connection(sf_dir)
    bad = 0
    for k in keys:
        try:
            r = compare(spark, con, k, sf_dir)
        except Exception as e:  # report and continue
            r = {"name": k, "ok": False, "error": repr(e)[:600]}
        bad += not r["ok"]
        print(r if not r["ok"] else f"OK {k} rows={r['spark_rows']} {r['spark_sec']}s", flush=True)
    print(f"{len(keys) - bad}/{len(keys)} ok")


if __name__ == "__main__":
    main(sys.argv)
