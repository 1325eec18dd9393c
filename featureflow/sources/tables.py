"""Tables in and out."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.session import broadcast_if_small, remove_path, stage, staged_path


def read_table(spark: SparkSession, path: str, schema: str | T.StructType, fmt: str = "csv") -> DataFrame:
    """A file or folder with a declared schema; empty CSV cells become NULL, NaN too."""
    reader = spark.read.schema(schema)
    df = reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in floats}) if floats else df


class Inputs(Mapping):
    """Named tables bound at run time; one pipeline function, several bindings."""

    def __init__(self, **dfs: DataFrame):
        self._dfs = dict(dfs)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._dfs:
            raise KeyError(f"input {name!r} is not bound; bound: {sorted(self._dfs)}")
        return self._dfs[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._dfs)

    def __len__(self) -> int:
        return len(self._dfs)

    def rebind(self, **dfs: DataFrame) -> Inputs:
        return Inputs(**{**self._dfs, **dfs})


def load_dataset(spark: SparkSession, folder: str, names: list[str]) -> Inputs:
    """Several parquet tables of one folder as bound inputs."""
    return Inputs(**{n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names})


KEYS = ["cache_key", "operation"]
_PLACE = ["batch", *KEYS]
_SNAPSHOT = "batch string, cache_key string, operation string, version int"


def write_results(df: DataFrame, path: str) -> None:
    """Store rows by (cache_key, operation); only the keys in `df` are replaced.

    Rows go into a folder of their own that no snapshot names yet; the snapshot that makes them live is
    committed by one rename, so readers see all of a write or nothing. The rebalance
    hint merges small writers and splits a key that holds most rows.
    """
    spark, batch = df.sparkSession, uuid.uuid4().hex
    df.hint("rebalance", *KEYS).write.partitionBy(*KEYS).parquet(f"{path}/data/batch={batch}")
    if not any(True for _ in _children(spark, f"{path}/data/batch={batch}", "cache_key=")):
        return  # no rows, no keys
    new = _text_keys(spark, f"{path}/data/batch={batch}").select(*KEYS).distinct().withColumn("batch", F.lit(batch))
    new = stage(new.select(*_PLACE, F.lit(None).cast("int").alias("version")))

    def after(rows: DataFrame) -> DataFrame:
        gone = new.select(*[F.col(k).alias(f"_{k}") for k in KEYS])
        same = F.col("cache_key").eqNullSafe(F.col("_cache_key")) & F.col("operation").eqNullSafe(F.col("_operation"))
        kept = rows.join(gone, same & F.col("version").isNull(), "left_anti")
        return kept.unionByName(new)

    _commit(spark, path, after)
    remove_path(spark, staged_path(new))


def read_results(spark: SparkSession, path: str, key: str | None = None, operation: str | None = None) -> DataFrame:
    """Live rows of the newest snapshot; the filters prune folders."""
    return _rows(spark, path, F.col("_version").isNull(), key, operation).drop("_version")


def list_keys(spark: SparkSession, path: str) -> DataFrame:
    """Live keys, from the snapshot alone."""
    return _snapshot(spark, path)[1].where("version IS NULL").select("cache_key").distinct()


def archive_results(spark: SparkSession, path: str, key: str) -> int:
    """Make the live rows of a key its next archive version; returns the version.

    Rows stay where they are: the next snapshot names them as archived. A job that is lost before
    the commit has changed nothing, one that is repeated after it finds nothing to archive.
    """
    found = {}

    def after(rows: DataFrame) -> DataFrame:
        own = F.col("cache_key") == key
        old = rows.where(own).agg(F.max("version").alias("v"), F.count(F.when(F.col("version").isNull(), 1)).alias("live")).first()
        found["version"] = (old["v"] or 0) + (1 if old["live"] else 0)
        moved = F.when(own & F.col("version").isNull(), F.lit(found["version"])).otherwise(F.col("version"))
        return rows.withColumn("version", moved.cast("int"))

    _commit(spark, path, after)
    return found["version"]


def read_archive(spark: SparkSession, path: str, key: str | None = None, version: int | None = None) -> DataFrame:
    """Archived rows of the newest snapshot with their version."""
    wanted = F.col("_version").isNotNull() if version is None else F.col("_version") == version
    return _rows(spark, path, wanted, key, None).withColumnRenamed("_version", "version")


def clean_results(spark: SparkSession, path: str) -> int:
    """Remove what the newest snapshot doesn't name: replaced rows, lost writes, older snapshots. Returns the folders removed.

    Not beside running writers or readers of older snapshots.
    """
    number, rows = _snapshot(spark, path)
    used = {r["batch"] for r in rows.select("batch").distinct().collect()}  # one row per write
    gone = [b for b in _children(spark, f"{path}/data", "batch=") if b.partition("=")[2] not in used]
    newest = _name_of(spark, path, number)
    gone_rows = [r for r in _children(spark, f"{path}/snapshots/rows", "") if r != newest]
    for folder in [f"{path}/data/{b}" for b in gone] + [f"{path}/snapshots/rows/{r}" for r in gone_rows]:
        remove_path(spark, folder)
    for n in _numbers(spark, path):
        if n < number:
            remove_path(spark, f"{path}/snapshots/{n}")
    return len(gone)


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _children(spark: SparkSession, path: str, prefix: str) -> Iterator[str]:
    p, fs = _hadoop(spark, path)
    if fs.exists(p):
        for status in fs.listStatus(p):
            name = status.getPath().getName()
            if name.startswith(prefix) and not name.startswith((".", "_")):
                yield name


def _text_keys(spark: SparkSession, path: str) -> DataFrame:
    """A folder with its partition columns as the text they are."""
    name = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set(name, before)


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n) for n in _children(spark, f"{path}/snapshots", "") if n.isdigit())


def _name_of(spark: SparkSession, path: str, number: int) -> str | None:
    return spark.read.text(f"{path}/snapshots/{number}").first()[0] if number else None


def _snapshot(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """Number and rows of the newest snapshot: which keys of which write are live (version NULL) or archived."""
    numbers = _numbers(spark, path)
    if not numbers:
        return 0, spark.createDataFrame([], _SNAPSHOT)
    name = _name_of(spark, path, numbers[-1])
    return numbers[-1], spark.read.schema(_SNAPSHOT).parquet(f"{path}/snapshots/rows/{name}")


def _commit(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> None:
    """Write the next snapshot and commit it by renaming the file that names it; begins anew if another writer was first."""
    while True:
        number, rows = _snapshot(spark, path)
        name = uuid.uuid4().hex
        change(rows).coalesce(1).write.parquet(f"{path}/snapshots/rows/{name}")  # a row per key, not per result
        _write_text(spark, f"{path}/snapshots/.{name}", name)
        if _rename(spark, f"{path}/snapshots/.{name}", f"{path}/snapshots/{number + 1}"):
            return
        remove_path(spark, f"{path}/snapshots/rows/{name}")


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _hadoop(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _rename(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a file unless the target is there; True if it was done."""
    jvm = spark.sparkContext._jvm
    (src, _), (dst, _) = _hadoop(spark, source), _hadoop(spark, target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(src.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(src, dst, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in str(e.java_exception):
            raise
        remove_path(spark, source)
        return False
    return True


def _rows(spark: SparkSession, path: str, wanted: Column, key: str | None, operation: str | None) -> DataFrame:
    number, snapshot = _snapshot(spark, path)
    if not number:
        raise ValueError(f"no results under {path}")
    data = _text_keys(spark, f"{path}/data")
    named = snapshot.withColumnRenamed("version", "_version").where(wanted)
    for column, value in (("cache_key", key), ("operation", operation)):
        if value is not None:
            data, named = data.where(F.col(column) == value), named.where(F.col(column) == value)
    named = named.select(*[F.col(c).alias(f"_{c}") for c in _PLACE], "_version")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _PLACE])
    return data.join(broadcast_if_small(named), same).drop(*[f"_{c}" for c in _PLACE], "batch")
