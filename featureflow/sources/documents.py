"""JSON documents of search runs."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.functions.hashing import _col

TRAJECTORY = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("export", T.StringType()),
        T.StructField("part", T.LongType()),
        T.StructField("optimizer_args", T.MapType(T.StringType(), T.StringType())),
        T.StructField(
            "outcomes",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(
                            "search_node",
                            T.StructType(
                                [
                                    T.StructField("trial", T.LongType()),
                                    T.StructField("parent_trial", T.LongType()),
                                    T.StructField("operator_to_evolve", T.StringType()),
                                ]
                            ),
                        ),
                        T.StructField("score", T.DoubleType()),
                        T.StructField("state", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)

MODEL_CONFIG = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("parameters", T.StructType([T.StructField("temperature", T.DoubleType())])),
    ]
)


def unwrap_json(c) -> Column:
    """JSON object text of a document that may be a JSON string of itself; NULL if neither."""
    boxed = F.get_json_object(F.concat(F.lit('{"v":'), _col(c), F.lit("}")), "$.v")
    return F.when(F.ltrim(boxed).startswith("{"), boxed)


def parse_trajectories(df: DataFrame, text: str, keep: list[str] | None = None) -> DataFrame:
    """Document text → run_id, args, model settings, outcomes. Bad documents are left out.

    The model settings sit under a top-level key that ends in `_config`.
    """
    body = df.withColumn("_t", unwrap_json(text)).where(F.col("_t").isNotNull())
    top = F.from_json("_t", T.MapType(T.StringType(), T.StringType()))
    parsed = body.withColumns({"_d": F.from_json("_t", TRAJECTORY), "_m": top}).where(F.col("_d").isNotNull())
    config = F.map_values(F.map_filter("_m", lambda k, v: k.endswith("_config")))
    model = F.from_json(F.get_json_object(F.get(config, F.lit(0)), "$.llm_for_code_generation"), MODEL_CONFIG)
    return parsed.withColumn("_c", model).select(
        *(keep or []),
        F.col("_d.run_id").alias("run_id"),
        F.col("_d.export").alias("export"),
        F.coalesce(F.col("_d.part"), F.lit(0).cast("bigint")).alias("part"),
        F.col("_d.optimizer_args").alias("args"),
        F.col("_c.name").alias("model"),
        F.col("_c.parameters.temperature").alias("temperature"),
        F.coalesce(F.col("_d.outcomes"), F.array().cast(TRAJECTORY["outcomes"].dataType)).alias("outcomes"),
    )


def read_trajectories(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Trajectory documents of a folder: one per file, or one per line for large histories.

    A document without a run id takes the name of its folder run=..., else that of its file.
    """
    raw = spark.read.text(path, wholetext=one_per_file).select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )
    docs = parse_trajectories(raw, "value", ["file_path", "modified"])
    name = F.url_decode(F.element_at(F.split("file_path", "/"), -1))
    # Spark's writer escapes folder names once more than paths are
    decoded = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    folder = F.nullif(decoded(decoded(F.regexp_extract("file_path", r"/run=([^/]+)/[^/]+$", 1))), F.lit(""))
    return docs.withColumn("run_id", F.coalesce("run_id", folder, F.regexp_replace(name, r"\.[^.]*$", "")))


#: Characters that Spark's writer escapes in the names of folders.
ESCAPED = re.compile("[\x01-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]")


def write_documents(docs: DataFrame, path: str, folder: str, text: str = "value") -> None:
    """One file per row of `docs` in a folder `folder=<value>`, as Spark's text writer lays them out; one row per value.

    In a folder of the file system tasks write the files themselves, each under a name that is given to it when
    it is whole, so that a task may run again: Hadoop starts processes for each file to set its permissions there.
    Elsewhere Spark's writer does it.
    """
    local = re.match(r"(?:file:(?://)?)?(/(?!/).*)", path)
    if not local:
        docs.select(folder, text).write.partitionBy(folder).text(path)
        return
    root = local[1]

    def write(rows):
        for name, body in rows:
            name = "__HIVE_DEFAULT_PARTITION__" if not name else ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", name)
            own = f"{root}/{folder}={name}"
            os.makedirs(own, exist_ok=True)
            part = f"{own}/_{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(f"{'' if body is None else body}\n".encode())
            os.replace(part, f"{own}/part-0.txt")

    os.makedirs(root)
    docs.select(F.col(folder).cast("string"), text).foreachPartition(write)


def newest_files(df: DataFrame, key: str, exclude: str | None = None, path: str = "file_path",
                 modified: str = "modified", priority: str | None = None) -> DataFrame:
    """One row per key: lowest priority number first, then the newest file, then the path.

    Files whose name holds `exclude` are left out. Documents with a column `export` (a run
    written in several parts) are chosen by export: all parts of the chosen one stay, one
    row per part.
    """
    if exclude:
        name = F.element_at(F.split(F.col(path), "/"), -1)
        df = df.where(~name.contains(exclude))
    rest = [c for c in df.columns if c != key]
    rank = -F.col(priority) if priority else F.lit(0)
    order = F.struct(rank.alias("p"), F.col(modified), F.col(path))
    if "export" in df.columns:
        own = F.coalesce("export", path)  # a document that doesn't say is an export of its own
        best = df.groupBy(key).agg(F.max_by(own, order).alias("_export")).withColumnRenamed(key, "_key")
        chosen = df.join(best, F.col(key).eqNullSafe(F.col("_key")) & (own == F.col("_export"))).drop("_key", "_export")
        rest = [c for c in df.columns if c not in (key, "part")]
        parts = chosen.groupBy(key, "part").agg(F.max_by(F.struct(*rest), order).alias("_r"))
        return parts.select(key, "part", "_r.*").select(*df.columns)
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*").select(*df.columns)


def outcomes_json(trials: DataFrame, run: str = "run_id", per_document: int = 1000, export: str | None = None) -> DataFrame:
    """Trials → trajectory documents (G8), at most `per_document` trials in each.

    A longer run spans several documents with the same run_id and export and their own
    part number; readers explode the outcomes, and `newest_files` keeps all parts.
    """
    export = export or uuid.uuid4().hex
    node = F.struct(F.col("trial"), F.col("parent_trial"), F.col("operator").alias("operator_to_evolve"))
    code = F.col("code") if "code" in trials.columns else F.lit(None).cast("string")
    outcome = F.struct(node.alias("search_node"), F.col("score"), F.struct(code.alias("generated_code")).alias("state"))
    doc = F.struct(F.col(run).cast("string").alias("run_id"), F.lit(export).alias("export"), "part", F.col("_o").alias("outcomes"))
    return (
        trials.groupBy(run, F.floor(F.col("trial") / per_document).alias("part"))
        .agg(F.array_sort(F.collect_list(outcome)).alias("_o"))
        .select(run, "part", F.to_json(doc).alias("document"))
    )


def write_trajectory(trials: DataFrame, path: str, args: dict | None = None, config: dict | None = None,
                     run: str = "run_id") -> None:
    """JSON lines with run id, arguments, settings and outcomes."""
    import json

    extra = {"optimizer_args": {k: str(v) for k, v in (args or {}).items()}, "search_config": config or {}}
    head = json.dumps(extra)[:-1] + ", "
    docs = outcomes_json(trials, run)
    docs.select(F.concat(F.lit(head), F.expr("substring(document, 2)")).alias("value")).write.mode("append").text(path)
