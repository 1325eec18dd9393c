"""Set operations (V1, V2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def concat(*dfs: DataFrame) -> DataFrame:
    """All rows; columns are matched by name, missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_distinct(*dfs: DataFrame) -> DataFrame:
    return concat(*dfs).dropDuplicates()
