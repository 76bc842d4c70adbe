"""Run registered queries and compare them with their SQL on the same tables.

``python tests/compare.py /root/testdata/sf0.01 [name ...]`` prints one line per query.
"""

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normalize(pdf):
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        if pd.api.types.is_datetime64_any_dtype(pdf[c]):
            pdf[c] = pdf[c].astype("datetime64[us]")
        elif pd.api.types.is_integer_dtype(pdf[c]):
            pdf[c] = pdf[c].astype("int64")
        elif pd.api.types.is_float_dtype(pdf[c]):
            pdf[c] = pdf[c].astype(float)
        else:
            pdf[c] = pdf[c].astype(object).where(pdf[c].notna(), None)
    return pdf.sort_values(list(pdf.columns), na_position="first").reset_index(drop=True)


def differences(got, want):
    """Problems found, empty when the frames agree exactly."""
    if sorted(got.columns) != sorted(want.columns):
        return [f"columns {sorted(got.columns)} != {sorted(want.columns)}"]
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}"]
    got, want = normalize(got), normalize(want)
    found = []
    for c in got.columns:
        if got[c].dtype != want[c].dtype and not (got[c].isna().all() and want[c].isna().all()):
            found.append(f"{c}: type {got[c].dtype} != {want[c].dtype}")
            continue
        equal = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        if not equal.all():
            i = int(np.argmin(equal.to_numpy()))
            found.append(f"{c}: {(~equal).sum()} differ, first {got[c][i]!r} != {want[c][i]!r}")
    return found


def main():
    import __spark_entry__ as entry
    from tidegrid.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8, 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = query(spark, sf_dir).toPandas()
            spent = time.time() - start
            if name not in oracle:
                print(f"{name}: rows only, {len(got)} rows, {spent:.1f}s", flush=True)
                continue
            problems = differences(got, con.execute(oracle[name]).df())
        except Exception as error:  # report and go on with the next query
            problems, got, spent = [f"{type(error).__name__}: {str(error)[:600]}"], [], time.time() - start
        bad += bool(problems)
        print(f"{name}: {'OK' if not problems else problems}, {len(got)} rows, {spent:.1f}s", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
