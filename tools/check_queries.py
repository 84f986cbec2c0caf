"""Run registered queries beside their SQL twins and report mismatches.

    python tools/check_queries.py [--sf DIR] [--only REGEX]
"""

from __future__ import annotations

import argparse
import math
import os
import re
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from orderlens import catalog  # noqa: E402
from orderlens.session import build_session  # noqa: E402
from orderlens.sources.driver_tables import STAR_TABLES  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in STAR_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v if not isinstance(v, (list, dict)) else str(v)) for v in row)


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for row in rows:
        vals = []
        for i in order:
            v = row[i]
            if isinstance(v, float) and v == 0:
                v = 0.0
            if isinstance(v, float) and math.isnan(v):
                v = "NaN"
            if isinstance(v, (tuple, list)):
                v = str(list(v))
            vals.append(v)
        out.append(tuple(vals))
    return [columns[i] for i in order], sorted(out, key=_key)


def compare(spark, con, name, sf_dir, sqls):
    start = time.time()
    df = catalog.all_queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    if name not in sqls:
        return "rows-only", len(rows), spent, ""
    rel = con.execute(sqls[name])
    cols = [d[0] for d in rel.description]
    expected = rel.fetchall()
    got_c, got = normalise(df.columns, rows)
    exp_c, exp = normalise(cols, expected)
    if got_c != exp_c:
        return "COLUMNS", len(rows), spent, f"{got_c} vs {exp_c}"
    if len(got) != len(exp):
        return "ROWCOUNT", len(rows), spent, f"{len(got)} vs {len(exp)}"
    bad = [(g, e) for g, e in zip(got, exp) if g != e]
    types = [
        (c, type(g).__name__, type(e).__name__)
        for row_g, row_e in zip(got[:200], exp[:200]) for c, g, e in zip(got_c, row_g, row_e)
        if g is not None and e is not None and type(g) is not type(e)
    ]
    if types:
        return "TYPES", len(rows), spent, str(types[0])
    if bad:
        return "VALUES", len(rows), spent, f"{len(bad)} differ; {got_c}\n   got {bad[0][0]}\n   exp {bad[0][1]}"
    return "ok", len(rows), spent, ""


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--only", default=".")
    args = parser.parse_args()
    spark = build_session("local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    sqls = catalog.all_sql()
    failures = 0
    for name in catalog.all_queries():
        if not re.search(args.only, name):
            continue
        try:
            status, n, spent, note = compare(spark, con, name, args.sf, sqls)
        except Exception as error:  # report and go on
            status, n, spent, note = "ERROR", 0, 0.0, str(error)[:1500]
        failures += status not in ("ok", "rows-only")
        print(f"{status:10s} {name:36s} rows={n:<8d} {spent:6.2f}s {note}", flush=True)
    print(f"failures: {failures}")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())
