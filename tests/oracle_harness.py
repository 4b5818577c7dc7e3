"""Compare a Spark query with its DuckDB oracle the way the round driver does:
row count, column names, order-insensitive values (doubles rounded)."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from netprism.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, decimal.Decimal):
        return _norm(float(v))
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, int):
        return int(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
          "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "date": "DATE",
          "smallint": "SMALLINT", "tinyint": "TINYINT", "binary": "BLOB",
          "timestamp": "TIMESTAMP WITH TIME ZONE", "array<string>": "VARCHAR[]",
          "array<double>": "DOUBLE[]"}


def type_diffs(sdf, cur) -> list:
    """(column, spark type, duckdb type) where the two differ."""
    d_types = {d[0]: str(d[1]) for d in cur.description}
    out = []
    for name, t in sdf.dtypes:
        want = _TYPES.get(t, t.upper())
        got = d_types.get(name)
        if got is not None and got.upper() != want:
            out.append((name, t, got))
    return out


def compare(spark, key: str, builder, sql: str | None, sf_dir: str, con=None):
    t0 = time.time()
    sdf = builder(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t_spark = time.time() - t0
    res = {"key": key, "rows": len(s_rows), "spark_sec": round(t_spark, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    con = con or duck(sf_dir)
    cur = con.execute(sql)
    d_cols = [d[0] for d in cur.description]
    res["type_diffs"] = type_diffs(sdf, cur)
    d_rows = cur.fetchall()
    res["oracle_rows"] = len(d_rows)
    if sorted(s_cols) != sorted(d_cols):
        res["status"] = f"columns differ: spark={sorted(s_cols)} oracle={sorted(d_cols)}"
        return res
    if len(s_rows) != len(d_rows):
        res["status"] = "row count differs"
        return res
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    if a != b:
        diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res["status"] = f"values differ, e.g. {diffs}"
        return res
    res["status"] = "match"
    return res


def main(argv):
    from netprism.plans import catalog
    from netprism.session import local_session

    catalog.load_all()
    sf = "/root/testdata/sf0.01"
    keys = [a for a in argv if not a.startswith("--")] or sorted(catalog.QUERIES)
    spark = local_session(8, 8)
    con = duck(sf)
    bad = 0
    for k in keys:
        try:
            r = compare(spark, k, catalog.QUERIES[k], catalog.ORACLE.get(k), sf, con)
        except Exception as e:  # report and go on
            r = {"key": k, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
        if r["status"] not in ("match", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{len(keys) - bad}/{len(keys)} ok")


if __name__ == "__main__":
    main(sys.argv[1:])
