"""Local oracle check: run a registered plan on Spark and its SQL on DuckDB over the same parquet tables, then
compare row count, column names and an order-insensitive multiset of rounded rows (the driver's gate, locally)."""
from __future__ import annotations

import math
import sys
import time
from collections import Counter

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits=12):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, digits) + 0.0
    if hasattr(v, "as_tuple"):  # Decimal
        return round(float(v), digits)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(), digits)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


# Spark simple type -> DuckDB type name, for the schema comparison.
TYPE_MAP = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
            "float": "FLOAT", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
            "array<double>": "DOUBLE[]", "array<int>": "INTEGER[]", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def compare(spark, name: str, sf_dir: str, con=None, verbose: bool = True) -> dict:
    from augeval.plans.registry import ORACLE, QUERIES, load_all, rounded_sql
    load_all()
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = QUERIES[name](spark, sf_dir)
    s_rows = [r.asDict(recursive=True) for r in sdf.collect()]
    t1 = time.time()
    s_cols = sorted(sdf.columns)
    res = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if name not in ORACLE:
        res["oracle"] = None
        return res
    rel = con.sql(rounded_sql(name))
    d_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    s_types = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    type_diffs = [(c, t, d_types.get(c)) for c, t in s_types.items() if TYPE_MAP.get(t, t) != d_types.get(c)]
    res["types_match"] = not type_diffs
    if type_diffs:
        res["type_diffs"] = type_diffs
    cur = con.execute(rounded_sql(name))
    d_cols_raw = [c[0] for c in cur.description]
    d_rows = [dict(zip(d_cols_raw, r)) for r in cur.fetchall()]
    d_cols = sorted(d_cols_raw)
    res["duck_rows"] = len(d_rows)
    res["cols_match"] = s_cols == d_cols
    if s_cols != d_cols:
        res["cols"] = (s_cols, d_cols)
    key = lambda r, cols: tuple(_norm(r.get(c)) for c in cols)
    sc = Counter(key(r, s_cols) for r in s_rows)
    dc = Counter(key(r, s_cols) for r in d_rows) if s_cols == d_cols else Counter()
    res["values_match"] = sc == dc
    if sc != dc and verbose:
        only_s = list((sc - dc).elements())[:5]
        only_d = list((dc - sc).elements())[:5]
        res["only_spark"] = only_s
        res["only_duck"] = only_d
    return res


def main(argv):
    from augeval.session import get_spark
    from augeval.plans.registry import QUERIES, load_all
    load_all()
    sf_dir = "/root/testdata/sf0.01"
    names = argv or sorted(QUERIES)
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as e:  # report and continue
            r = {"name": n, "error": repr(e)[:600]}
        ok = (r.get("values_match") and r.get("cols_match") and r.get("types_match")
              and r.get("spark_rows") == r.get("duck_rows"))
        if r.get("oracle", 1) is None:
            ok = "rows-only"
        if ok is not True:
            bad += ok != "rows-only"
        print(("OK  " if ok is True else "--  " if ok == "rows-only" else "BAD ") + str(r), flush=True)
    print(f"{bad} failing", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
