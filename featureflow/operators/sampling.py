"""Sorts, limits, samples, splits and folds (L1-L8). All seeds act on keys, not on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featureflow.functions.hashing import key_digest, key_fraction, key_hash32
from featureflow.session import stage

#: Up to this many rows a per-task heap is cheaper than a histogram.
HEAP_ROWS = 10_000


def preview(df: DataFrame, n: int = 5, order: list | None = None) -> DataFrame:
    return (df.orderBy(*order) if order else df).limit(n)


def hash_top_n(df: DataFrame, n: int | str, key, seed: int, by: list[str] | None = None) -> DataFrame:
    """Exactly n rows per group (n may name a column) in the seeded order of the keys.

    A histogram over 65,536 hash ranges finds the range where the n-th row of each group
    lies. Lower ranges are kept whole, only the rows of that one range are ranked. No
    group is gathered, however large n is.
    """
    by = by or []
    want = F.col(n) if isinstance(n, str) else F.lit(n)
    bucket = F.shiftright(key_hash32(key, seed), 16)
    hist = df.groupBy(*by, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_c"), F.max(want).alias("_w"))
    upto = Window.partitionBy(*by, F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_before", F.coalesce(F.sum("_c").over(upto), F.lit(0)))
    reached = F.col("_before") + F.col("_c") >= F.col("_w")
    cuts = hist.groupBy(*[F.col(b).alias(f"_h_{b}") for b in by]).agg(
        F.min(F.when(reached, F.struct("_b", (F.col("_w") - F.col("_before")).alias("_left")))).alias("_cut")
    )
    data = df.withColumn("_b", bucket)
    if by:
        cond = None
        for b in by:
            e = F.col(b).eqNullSafe(F.col(f"_h_{b}"))
            cond = e if cond is None else cond & e
        # staged: one row per group, so the join is planned from its true size
        data = data.join(stage(cuts), cond)
        cut, left = F.col("_cut._b"), F.col("_cut._left")
    else:
        got = cuts.first()["_cut"]
        if got is None:
            return df
        cut, left = F.lit(got["_b"]), F.lit(got["_left"])
    keys = key if isinstance(key, (list, tuple)) else [key]
    rank = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(key_digest(key, seed), *keys))
    whole = data.where(cut.isNull() | (F.col("_b") < cut)).select(*df.columns)
    part = data.where(F.col("_b") == cut).withColumn("_rn", rank).where(F.col("_rn") <= left).select(*df.columns)
    return whole.unionByName(part)


def sample_n(df: DataFrame, n: int, key, seed: int) -> DataFrame:
    """Exactly n rows (or all, if fewer), the same on every cluster."""
    if n <= HEAP_ROWS:
        keys = key if isinstance(key, (list, tuple)) else [key]
        return df.orderBy(key_digest(key, seed), *keys).limit(n)
    return hash_top_n(df, n, key, seed)


def cap_rows(df: DataFrame, n: int, key, seed: int = 0) -> DataFrame:
    """Row cap before a learner that takes no more than n rows."""
    return sample_n(df, n, key, seed)


def subsample(df: DataFrame, n: int, key, seed: int = 0, how: str = "random", keep: bool = True) -> DataFrame:
    """Work on n rows while designing; `keep=False` (the final fit) returns all rows."""
    if not keep:
        return df
    if how == "head":
        return df.orderBy(*(key if isinstance(key, (list, tuple)) else [key])).limit(n)
    if how != "random":
        raise ValueError("how must be 'random' or 'head'")
    return sample_n(df, n, key, seed)


def split(df: DataFrame, test_size: float, key, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test): disjoint, complete, stable for a key whatever the partitioning."""
    u: Column = key_fraction(key, seed)
    return df.where(u >= F.lit(float(test_size))), df.where(u < F.lit(float(test_size)))


def with_fold(df: DataFrame, k: int, key, seed: int = 0, name: str = "fold") -> DataFrame:
    return df.withColumn(name, F.pmod(key_hash32(key, seed), F.lit(k)).cast("int"))
