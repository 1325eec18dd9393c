"""Session helpers: shared scratch folder, staged tables, size-checked broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most this many bytes by the optimizer's statistics may be sent to every executor.
BROADCAST_BYTES = 32 << 20


def build_session(app: str = "featureflow", cores: str = "*", **conf) -> SparkSession:
    """A local session with the settings the library expects (tests, bench)."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        # methods beyond this size are not compiled by the JVM; wide projections then run split
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Folder all executors share: `spark.checkpoint.dir` of the session.

    Only a local session, where the setting may be absent, gets its own folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    known = spark.conf.get("spark.featureflow.scratch.dir", None)
    if known:
        return known
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="run-")
    spark.conf.set("spark.featureflow.scratch.dir", folder)
    return folder


def stage(df: DataFrame, replaces: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends here.

    The written files survive the loss of executors, fix nondeterministic
    columns and give the optimizer a true size. `replaces` names the folder of an
    earlier round that nothing reads any more; it is removed after the write.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/staged/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    if replaces:
        remove_path(spark, replaces)
    if (own := _STAGED.get()) is not None:
        own.add(path)
    return out


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """For the actions inside: plans whose methods the JVM would not compile run in split ones."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 8000)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def staged_path(df: DataFrame) -> str | None:
    return getattr(df, "_staged_path", None)


#: Folders staged by the innermost `tidy` call of this thread.
_STAGED: ContextVar[set[str] | None] = ContextVar("staged", default=None)


def tidy(fn: Callable) -> Callable:
    """Removes what `fn` has staged once it returns, but for the folders that its result, a frame, still reads.

    Calls may nest: what is left of an inner one is the outer one's to remove. Frames that
    `fn` was given are never touched, nor those staged in threads of its own.
    """

    @wraps(fn)
    def run(*args, **kwargs):
        outer, own = _STAGED.get(), set()
        token = _STAGED.set(own)
        try:
            out = fn(*args, **kwargs)
        finally:
            _STAGED.reset(token)
        read = read_folders(out) if isinstance(out, DataFrame) else set()
        spark = SparkSession.getActiveSession()
        for path in own:
            if path.rpartition("/")[2] not in read:
                remove_path(spark, path)
            elif outer is not None:
                outer.add(path)
        return out

    return run


def read_folders(df: DataFrame) -> set[str]:
    """Names of the folders that a frame's plan reads."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found: set[str] = set()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            found.update(p.rstrip("/").rpartition("/")[2] for p in leaf.relation().location().rootPaths().mkString("\n").split("\n"))
    return found


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def with_package(df: DataFrame) -> DataFrame:
    """`df`, after this package's folder was named to Python workers that share it.

    On a cluster without a shared folder the package comes with `--py-files`.
    """
    env = df.sparkSession.sparkContext.environment
    root = str(Path(__file__).resolve().parents[1])
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return df


def has_at_most(df: DataFrame, rows: int) -> bool:
    """True if `df` has no more than `rows` rows; reads no further than needed."""
    return df.limit(rows + 1).count() <= rows


def plan_bytes(df: DataFrame) -> int:
    """Size of a plan's result as the optimizer sees it: file sizes, carried upwards. Runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`broadcast(df)` if its plan is within the bound, else `df`, which Spark shuffles or sends by its own rule."""
    return F.broadcast(df) if plan_bytes(df) <= max_bytes else df
