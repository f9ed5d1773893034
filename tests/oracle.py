"""Compare queries() with oracle_sql() in DuckDB: columns, rows and values."""

from __future__ import annotations

import sys
import time

import duckdb
import numpy as np
import pandas as pd

from selenic.fixtures import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(pdf: pd.DataFrame) -> pd.DataFrame:
    out = pdf[sorted(pdf.columns)].copy()
    for c in out.columns:
        out[c] = out[c].map(lambda v: "~" if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v))
                            else repr(float(v)) if isinstance(v, (float, np.floating))
                            else str(int(v)) if isinstance(v, (int, np.integer)) and not isinstance(v, bool) else str(v))
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def diff(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> str | None:
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} vs {sorted(duck_pdf.columns)}"
    for c in spark_pdf.columns:
        kinds = spark_pdf[c].dtype.kind, duck_pdf[c].dtype.kind
        # pandas has no type of its own for a column of nulls only
        if len(spark_pdf) and kinds[0] != kinds[1] and not (spark_pdf[c].isna().all() and duck_pdf[c].isna().all()):
            return f"type of {c}: {spark_pdf[c].dtype} vs {duck_pdf[c].dtype}"
    if len(spark_pdf) != len(duck_pdf):
        return f"rows {len(spark_pdf)} vs {len(duck_pdf)}"
    a, b = canon(spark_pdf), canon(duck_pdf)
    bad = (a != b).any(axis=1)
    if bad.any():
        i = bad.idxmax()
        return f"{int(bad.sum())} rows differ, first\n  spark {a.loc[i].to_dict()}\n  duck  {b.loc[i].to_dict()}"
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from selenic.session import build_session

    sf_dir = argv[0]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                         "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if len(argv) > 1 and not any(name.startswith(p) for p in argv[1:]):
            continue
        t0 = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            t1 = time.time()
            if name not in oracles:
                print(f"rows {name} {len(got)} {t1 - t0:.1f}s", flush=True)
                continue
            msg = diff(got, con.execute(oracles[name]).df())
            note = "" if len(got) else " EMPTY"
            print(f"{'ok  ' if msg is None else 'BAD '}{name} {len(got)}{note} spark {t1 - t0:.1f}s duck {time.time() - t1:.1f}s"
                  + (f" {msg}" if msg else ""), flush=True)
            bad += msg is not None
        except Exception as e:  # noqa: BLE001
            print(f"ERR {name} {type(e).__name__}: {str(e)[:600]}", flush=True)
            bad += 1
    print("bad", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
