"""Null, NaN and division rules in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.functions.hashing import _col

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FLOATING = (T.FloatType, T.DoubleType)


def log1p(c) -> Column:
    return F.log1p(_col(c).cast("double"))


def ratio(a, b, plus: float = 1) -> Column:
    """a / (b + plus); NULL when the denominator is zero. plus=0 is the plain safe ratio."""
    den = _col(b).cast("double") + F.lit(float(plus)) if plus else _col(b).cast("double")
    return F.try_divide(_col(a).cast("double"), den)


def rounded(c, digits: int = 0) -> Column:
    return F.round(_col(c), digits)


def finite(c, dtype: T.DataType) -> Column:
    """NaN and infinities become NULL, at any depth of arrays, structs and maps."""
    c = _col(c)
    if isinstance(dtype, FLOATING):
        return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)
    if isinstance(dtype, T.ArrayType) and _has_float(dtype.elementType):
        return F.transform(c, lambda x: finite(x, dtype.elementType))
    if isinstance(dtype, T.MapType) and _has_float(dtype.valueType):
        return F.transform_values(c, lambda k, v: finite(v, dtype.valueType))
    if isinstance(dtype, T.StructType) and _has_float(dtype):
        fields = [finite(c.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def _has_float(dtype: T.DataType) -> bool:
    if isinstance(dtype, FLOATING):
        return True
    if isinstance(dtype, T.ArrayType):
        return _has_float(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _has_float(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return any(_has_float(f.dataType) for f in dtype.fields)
    return False


def finite_frame(df: DataFrame) -> DataFrame:
    """`finite` over every column that holds floating numbers."""
    return df.select(*[finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def fill_by_type(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Missing text becomes "", numbers 0, booleans false; NaN counts as missing."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if cols is not None and f.name not in cols:
            out.append(c)
        elif isinstance(f.dataType, T.StringType):
            out.append(F.coalesce(c, F.lit("")).alias(f.name))
        elif isinstance(f.dataType, FLOATING):
            out.append(F.coalesce(F.nanvl(c, F.lit(None).cast(f.dataType)), F.lit(0).cast(f.dataType)).alias(f.name))
        elif isinstance(f.dataType, NUMERIC):
            out.append(F.coalesce(c, F.lit(0).cast(f.dataType)).alias(f.name))
        elif isinstance(f.dataType, T.BooleanType):
            out.append(F.coalesce(c, F.lit(False)).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)
