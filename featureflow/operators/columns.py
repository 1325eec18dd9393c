"""Projection and column operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.functions.hashing import key_fraction, key_hash32
from featureflow.functions.numbers import NUMERIC


def select(df: DataFrame, cols: str | list[str]) -> DataFrame:
    return df.select(*([cols] if isinstance(cols, str) else cols))


def drop_columns(df: DataFrame, cols: list[str], errors: str = "raise") -> DataFrame:
    """Drop columns; `errors="raise"` refuses unknown names, "ignore" skips them."""
    if errors not in ("raise", "ignore"):
        raise ValueError("errors must be 'raise' or 'ignore'")
    missing = [c for c in cols if c not in df.columns]
    if missing and errors == "raise":
        raise KeyError(f"columns not found: {missing}")
    return df.drop(*cols)


def assign(df: DataFrame, **exprs: Column | str | Callable[[DataFrame], Column]) -> DataFrame:
    """Several derived columns at once, all computed from the incoming frame."""
    cols = {}
    for name, e in exprs.items():
        cols[name] = F.expr(e) if isinstance(e, str) else e(df) if callable(e) else e
    return df.withColumns(cols)


def copy_column(df: DataFrame, src: str, dst: str) -> DataFrame:
    return df.withColumn(dst, F.col(src))


def cols_of(df: DataFrame, kind: str) -> list[str]:
    """Column names of one kind: string, numeric, boolean or timestamp."""
    kinds = {
        "string": (T.StringType,),
        "numeric": NUMERIC,
        "boolean": (T.BooleanType,),
        "timestamp": (T.TimestampType, T.TimestampNTZType, T.DateType),
    }
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds[kind])]


def cols_except(df: DataFrame, *names: str) -> list[str]:
    return [c for c in df.columns if c not in names]


def apply_excluding(df: DataFrame, step: Callable[[DataFrame], DataFrame], exclude: list[str]) -> DataFrame:
    """Run a row-wise `step` that sees all columns but `exclude`; those pass through.

    The excluded columns travel inside one struct, so no join is needed and the step
    must keep columns it does not know.
    """
    kept = [c for c in exclude if c in df.columns]
    packed = df.select(*cols_except(df, *kept), F.struct(*kept).alias("_carried"))
    out = step(packed)
    if "_carried" not in out.columns:
        raise ValueError("the step dropped the carried columns")
    return out.select(*cols_except(out, "_carried"), "_carried.*")


def mark(
    df: DataFrame,
    X: list[str] | None = None,
    y: str | None = None,
    description: str = "",
) -> DataFrame:
    """Note role and description of feature and label columns in the schema metadata."""
    roles = {c: "X" for c in (X or [])}
    if y:
        roles[y] = "y"
    unknown = [c for c in roles if c not in df.columns]
    if unknown:
        raise KeyError(f"columns not found: {unknown}")
    for name, role in roles.items():
        old = dict(df.schema[name].metadata or {})
        df = df.withMetadata(name, {**old, "role": role, "description": description})
    return df


def marked(df: DataFrame, role: str) -> list[str]:
    return [f.name for f in df.schema.fields if (f.metadata or {}).get("role") == role]


def random_columns(
    df: DataFrame, key: str | list[str], seed: int, uniform: str = "random_col1",
    choice: str = "random_col2", values: tuple = ("A", "B", "C"),
) -> DataFrame:
    """A uniform number and a choice from `values`, both functions of key and seed."""
    pick = F.pmod(key_hash32(key, seed + 1), F.lit(len(values))).cast("int") + 1
    return df.withColumns(
        {
            uniform: key_fraction(key, seed),
            choice: F.element_at(F.array(*[F.lit(v) for v in values]), pick),
        }
    )


def with_row_id(df: DataFrame, order_cols: list[str], name: str = "row_id") -> DataFrame:
    """Dense row number 0, 1, 2, ... in the order of `order_cols`, over all partitions."""
    from featureflow.operators.windows import global_position

    return global_position(df, order_cols, name)


def as_frame(x, spark=None) -> DataFrame | None:
    """Table, column vector, list or array → table; anything else → None.

    A frame with one vector column becomes one column per vector slot.
    """
    import numpy as np
    import pandas as pd

    if isinstance(x, DataFrame):
        return x
    if spark is None:
        return None
    if isinstance(x, pd.DataFrame):
        return spark.createDataFrame(x)
    if isinstance(x, pd.Series):
        return spark.createDataFrame(x.to_frame(name=x.name if x.name is not None else "value"))
    if isinstance(x, np.ndarray) and x.ndim in (1, 2):
        table = pd.DataFrame(x if x.ndim == 2 else {"value": x})
        table.columns = [str(c) for c in table.columns]
        return spark.createDataFrame(table)
    return None


def vector_columns(df: DataFrame, vector: str, size: int, prefix: str = "v") -> DataFrame:
    """One double column per slot of an ml vector column."""
    from pyspark.ml.functions import vector_to_array

    arr = vector_to_array(F.col(vector))
    return df.select(*cols_except(df, vector), *[arr[i].alias(f"{prefix}{i}") for i in range(size)])
