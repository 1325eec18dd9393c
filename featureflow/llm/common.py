"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featureflow.session import path_exists, stage, staged_path

#: The folder that holds this package.
ROOT = str(Path(__file__).resolve().parents[2])

#: A staged side is sent to every executor up to this many bytes on disk; larger sides are shuffled.
BROADCAST_BYTES = 16 << 20

#: ASCII white space, as in the class [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def with_package(df: DataFrame) -> DataFrame:
    """`df`, after this package's folder was named to Python workers that share it.

    On a cluster without a shared folder the package comes with `--py-files`.
    """
    env = df.sparkSession.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return df


def text_of(column: str = "text") -> Column:
    """The text column with NULL read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow and Parquet batches of at most `rows` rows for the actions inside, where rows are long."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(name) for name in names]
    for name, value in zip(names, before, strict=True):
        spark.conf.set(name, str(min(rows, int(value)) if int(value) > 0 else rows))
    try:
        yield
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)


def staged_bytes(df: DataFrame) -> int:
    """Bytes of a staged table in the shared folder."""
    spark, path = df.sparkSession, staged_path(df)
    if path is None or not path_exists(spark, path):
        raise ValueError("not a staged table")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength()


def staged_side(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`df` staged; with a broadcast hint if its files hold at most `max_bytes`.

    Beyond the bound the join shuffles both sides, and AQE splits hot keys.
    """
    out = stage(df)
    return F.broadcast(out) if staged_bytes(out) <= max_bytes else out


def let(value: Column, body) -> Column:
    """`body(value)` with `value` worked out once, also inside higher-order functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def range_bucket(value: Column, cuts: Sequence[int]) -> Column:
    """Number of cuts that are at most `value` (cuts ascending), by binary search in the row."""
    if not cuts:
        return F.lit(0)
    steps = len(cuts).bit_length()
    table = F.array(*[F.lit(int(c)).cast("long") for c in cuts])
    pos = F.lit(0)

    def search(arr: Column) -> Column:
        def step(at: Column, s: Column) -> Column:
            ahead = at + s
            inside = ahead <= F.lit(len(cuts))
            return F.when(inside & (F.get(arr, ahead - 1) <= value), ahead).otherwise(at)

        return F.aggregate(F.array(*[F.lit(1 << i) for i in range(steps - 1, -1, -1)]), pos, step)

    return let(table, search)


def running(values: Column, xor: bool = False, block: int = 128) -> Column:
    """Array of running sums (or XORs) of an array of longs, each element included.

    Blocks are scanned on their own and moved by what comes before them, so that
    no array of the full length is copied once per element.
    """
    empty = F.expr("cast(array() as array<bigint>)")
    zero = F.lit(0).cast("long")
    add = (lambda a, b: a.bitwiseXOR(b)) if xor else (lambda a, b: a + b)
    less = (lambda a, b: a.bitwiseXOR(b)) if xor else (lambda a, b: a - b)

    def scan(arr: Column) -> Column:
        last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), zero)
        return F.aggregate(arr, empty, lambda acc, x: F.concat(acc, F.array(add(last(acc), x))))

    def blocks(arr: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(arr) - 1) / block).cast("int"))
        return F.transform(starts, lambda b: scan(F.slice(arr, b * block + 1, block)))

    def moved(parts: Column) -> Column:
        ends = scan(F.transform(parts, lambda p: F.element_at(p, -1)))
        shift = lambda p, end: let(less(end, F.element_at(p, -1)), lambda d: F.transform(p, lambda x: add(x, d)))
        return F.flatten(F.zip_with(parts, ends, shift))

    return F.when(F.size(values) == 0, empty).otherwise(let(values, lambda arr: let(blocks(arr), moved)))
