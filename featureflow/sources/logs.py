"""Run logs and event lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from featureflow.functions.hashing import _col
from featureflow.operators.windows import running
from featureflow.session import stage

# The kinds of marked blocks in a run log.
BLOCK_KINDS = ("NODE_CODE", "GRAPH", "NODE_PREVIEW", "VAR_PREVIEW", "EXECUTION_STATS", "NODE_INPUT_SUMMARY")
BLOCK_END = "##END##"
_KINDS = "|".join(sorted(BLOCK_KINDS, key=len, reverse=True))
BLOCK = rf"(?s)##(?:[A-Z]+_)??({_KINDS})##\s*\n(.*?)\n##END##"

FIELD = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("dtype", T.StringType())]))
BLOCK_FIELDS = T.StructType(
    [
        T.StructField("index", T.LongType()),
        T.StructField("code", T.StringType()),
        T.StructField("cost_usd", T.DoubleType()),
        T.StructField("attempts", T.LongType()),
        T.StructField("retries", T.LongType()),
        T.StructField("node_id", T.StringType()),
        T.StructField("var_name", T.StringType()),
        T.StructField("schema", FIELD),
        T.StructField("row_count", T.LongType()),
        T.StructField("duration_ms", T.DoubleType()),
        T.StructField("nodes", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
        T.StructField("parents", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("children", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    ]
)

#: The field a block must carry to count, per kind.
REQUIRED = {"GRAPH": "nodes", "NODE_PREVIEW": "node_id", "VAR_PREVIEW": "var_name", "NODE_INPUT_SUMMARY": "var_name"}


def json_object(c: Column, schema: T.StructType) -> Column:
    """Parsed object, NULL for malformed text or anything that is no object."""
    whole = F.from_json(c, T.MapType(T.StringType(), T.StringType()))
    return F.when(whole.isNotNull(), F.from_json(c, schema))


def parse_marked_blocks(df: DataFrame, text: str) -> DataFrame:
    """Marked blocks of a log text: kind, position in the text, raw JSON and its fields.

    Malformed blocks and blocks without their required field are skipped.
    """
    spans = F.posexplode(F.regexp_extract_all(F.col(text), F.lit(BLOCK), F.lit(0)))
    rest = [c for c in df.columns if c != text]
    found = df.select(*rest, spans.alias("position", "_b"))
    found = found.select(
        *rest,
        F.col("position").cast("bigint").alias("position"),
        F.regexp_extract("_b", BLOCK, 1).alias("kind"),
        F.trim(F.regexp_extract("_b", BLOCK, 2)).alias("json"),
    )
    parsed = found.withColumn("fields", json_object(F.col("json"), BLOCK_FIELDS)).where(F.col("fields").isNotNull())
    ok = F.lit(True)
    for kind, field in REQUIRED.items():
        ok = ok & ((F.col("kind") != kind) | F.col(f"fields.{field}").isNotNull())
    return parsed.where(ok)


def read_log_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of log files of any size: files are split at the end mark, not read whole.

    `position` counts the blocks of a file. A file whose pieces and end marks add up to more
    than its size has no mark after its last piece; a block cut off there does not count.
    """
    raw = spark.read.option("lineSep", BLOCK_END).text(path)
    pieces = raw.select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("_size"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"),
        (F.octet_length("value") + len(BLOCK_END)).alias("_bytes"), F.concat("value", F.lit(BLOCK_END)).alias("value"),
    )
    # only pieces that end in a block matter, and of the others their sizes
    pieces = stage(pieces.withColumn("value", F.when(F.col("value").rlike(BLOCK), F.col("value"))))
    ends = pieces.groupBy("file_path").agg(
        F.max(F.struct("_block", "_row")).alias("_last"), (F.sum("_bytes") > F.max("_size")).alias("_open")
    )
    whole = pieces.where("value IS NOT NULL").join(ends, "file_path")
    whole = whole.where(~(F.col("_open") & (F.struct("_block", "_row") == F.col("_last"))))
    placed = running(whole, ["file_path"], ["_block", "_row"], {"_nth": ("count", F.lit(1))})
    out = parse_marked_blocks(placed.select("file_path", "_nth", "value"), "value")
    return out.withColumn("position", (F.col("_nth") - 1).cast("bigint")).drop("_nth")


def growing_pieces(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """Pieces of text files that are still written, as a stream: (file_path, end, value).

    The source keeps a byte offset per file. A batch takes what the files have gained; a piece ends with the end mark
    of a block and belongs to the batch in which the mark is complete, so that a block cut across two
    batches comes once and whole: its front is read again, back to the mark before it. `end` is the
    byte after the mark. Files are listed on the driver and read in the tasks, by the folder's
    file system. A file that shrinks counts as a new one. A restart goes on from its checkpoint.
    """
    spark.dataSource.register(_growing_source())
    return spark.readStream.format("growing_pieces").option("folder", folder).option("suffix", suffix).load()


def stream_growing(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """Marked blocks of growing log files; `position` counts the blocks of a piece, `end` orders pieces in a file."""
    return parse_marked_blocks(growing_pieces(spark, folder, suffix), "value")


def _growing_source() -> type:
    """The source's class; made here, so that workers get it with the stream and need no package."""
    mark, step = BLOCK_END.encode(), 1 << 16

    class Reader(DataSourceStreamReader):
        def __init__(self, folder: str, suffix: str):
            self.folder, self.suffix = folder, suffix

        def _files(self):
            from pyarrow import fs

            if "://" in self.folder or self.folder.startswith("file:"):
                return fs.FileSystem.from_uri(self.folder)
            return fs.LocalFileSystem(), self.folder

        def initialOffset(self) -> dict:
            return {}

        def latestOffset(self) -> dict:
            from pyarrow import fs

            files, root = self._files()
            found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
            named = (f for f in found if f.is_file and not f.base_name.startswith((".", "_")) and f.base_name.endswith(self.suffix))
            return {f.path: f.size for f in named if f.size}

        def partitions(self, start: dict, end: dict) -> list:
            grown = []
            for path, to in sorted(end.items()):
                since = start.get(path, 0)
                since = 0 if since > to else since
                if since < to:
                    grown.append(GrowingPart(path, since, to))
            return grown

        def read(self, part):
            files, _ = self._files()
            with files.open_input_file(part.path) as f:
                # the open piece begins after the last mark that was complete before `since`
                first, tail = part.since, b""
                while first > 0 and mark not in tail:
                    back = max(0, first - step)
                    f.seek(back)
                    tail = f.read(first - back) + tail
                    first = back
                if mark in tail:
                    first += tail.rindex(mark) + len(mark)
                f.seek(first)
                held, at = b"", first
                while at < part.to:
                    chunk = f.read(min(step, part.to - at))
                    if not chunk:
                        break
                    at += len(chunk)
                    *whole, held = (held + chunk).split(mark)
                    for piece in whole:
                        first += len(piece) + len(mark)
                        yield (part.path, first, (piece + mark).decode("utf-8", "replace"))

        def commit(self, end: dict) -> None:
            pass

    class GrowingPart(InputPartition):
        def __init__(self, path: str, since: int, to: int):
            super().__init__(0)
            self.path, self.since, self.to = path, since, to

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return "growing_pieces"

        def schema(self) -> str:
            return "file_path string, end long, value string"

        def streamReader(self, schema):
            return Reader(self.options["folder"], self.options.get("suffix", ""))

    return Source


EVENT = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("node_id", T.StringType()),
        T.StructField("line", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("generated_code", T.StringType()),
        T.StructField("retries", T.LongType()),
        T.StructField("cost_usd", T.DoubleType()),
        T.StructField("total_usd", T.DoubleType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("duration_ms", T.DoubleType()),
        T.StructField("profile", T.MapType(T.StringType(), T.DoubleType())),
    ]
)


def parse_event_lines(df: DataFrame, line: str = "value", schema: T.StructType = EVENT) -> DataFrame:
    """`data: {json}` lines → event columns; other lines and broken JSON are skipped."""
    rest = [c for c in df.columns if c != line]
    body = F.rtrim(F.expr(f"substring(`{line}`, 7)"))
    return (
        df.where(_col(line).startswith("data: "))
        .select(*rest, json_object(body, schema).alias("_e"))
        .where(F.col("_e").isNotNull())
        .select(*rest, "_e.*")
    )
