"""Order-free comparison of a Spark result with a DuckDB result."""

import glob
import math
import os

import duckdb


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def differences(df, con, sql):
    """Empty when columns, types and values agree."""
    answer = con.execute(sql)
    duck_types = {d[0]: str(d[1]) for d in answer.description}
    expected = answer.fetchall()
    spark_types = {n: KINDS.get(t, t) for n, t in df.dtypes}
    found = []
    if spark_types != duck_types:
        found.append(f"types {spark_types} / {duck_types}")
        if set(spark_types) != set(duck_types):
            return found
    got = rows_of(df.columns, df.collect())
    want = rows_of(list(duck_types), expected)
    if len(got) != len(want):
        found.append(f"rows {len(got)} / {len(want)}")
    found += [f"{a} / {b}" for a, b in zip(got, want) if a != b][:3]
    return found
