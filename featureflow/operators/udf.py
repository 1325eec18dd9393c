"""User-defined steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from featureflow.functions.hashing import _col


def apply_func(df: DataFrame, fn: Callable[..., DataFrame], **tables) -> DataFrame:
    """A table-to-table function as a step, with further named tables as arguments."""
    return df.transform(fn, **tables)


def tap(df: DataFrame, fn: Callable[..., DataFrame | None], sink: str | None = None, when: str = "predict",
        phase: str = "predict", **tables) -> DataFrame:
    """Side analysis: its result goes to `sink` (parquet); the main frame is returned as it is.

    Nothing runs when the current phase is not `when`.
    """
    if phase == when:
        side = fn(df, **tables)
        if side is not None and sink is not None:
            side.write.mode("overwrite").parquet(sink)
    return df


def observe_step(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Row and null counts gathered while the job runs; no second pass over the data."""
    seen = Observation(name)
    counts = [F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"nulls_{c}") for c in df.columns]
    return df.observe(seen, F.count(F.lit(1)).alias("row_count"), *counts), seen


def map_value(c, fn: Callable, returns: str) -> Column:
    """A per-value Python function, vectorised over Arrow batches. Prefer a built-in."""
    @F.pandas_udf(returns)
    def run(s: pd.Series) -> pd.Series:
        return s.map(fn, na_action="ignore")

    return run(_col(c))


def agg_udf(df: DataFrame, keys: list[str], col: str, merge: dict[str, Column], finish: Column, name: str) -> DataFrame:
    """A custom group aggregate as partial sums plus a closing formula.

    `merge` holds built-in aggregates over `col`; `finish` combines their names. Each part
    has a map-side half, so a hot group never meets in one task.
    """
    parts = df.groupBy(*keys).agg(*[c.alias(n) for n, c in merge.items()])
    return parts.select(*keys, finish.alias(name))


def map_batches(df: DataFrame, fn: Callable, schema: str, batch_size: int = 1024,
                resource: Callable | None = None) -> DataFrame:
    """A batch function on rows (annotator or batch model); `resource` is built once per task."""

    def run(frames: Iterator) -> Iterator:
        held = resource() if resource else None
        for frame in frames:
            for at in range(0, len(frame), batch_size):
                piece = frame.iloc[at : at + batch_size]
                yield fn(piece, held) if resource else fn(piece)

    return df.mapInPandas(run, schema)


def fit_step(estimator, X: DataFrame, y: str | None = None):
    """Fit an ml estimator as a step; `y` names the label column."""
    if y is not None and estimator.hasParam("labelCol"):
        estimator = estimator.copy({estimator.getParam("labelCol"): y})
    return estimator.fit(X)

