"""Rows of a result in a form that Spark and DuckDB share."""

import numbers

import pandas as pd


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    return repr(float(v)) if isinstance(v, numbers.Number) else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted(tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False))


def same(spark_df, duck_rel) -> None:
    a, b = spark_df.toPandas(), duck_rel.df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
