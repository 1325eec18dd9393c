"""Streams of run events (ST1-ST6). Late data: rows later than the watermark are dropped."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from featureflow.operators.windows import latest_per_key
from featureflow.sources.logs import EVENT, parse_event_lines, parse_marked_blocks

DONE = ("done", "error")


def stream_events(spark: SparkSession, folder: str, schema: T.StructType = EVENT, files_per_trigger: int = 1000) -> DataFrame:
    """Event lines that arrive as text files → typed events, with event time `ts` from `ts_ms`."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    events = parse_event_lines(lines, "value", schema)
    return events.withColumn("ts", F.timestamp_millis("ts_ms"))


def stream_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Marked blocks of log files as they arrive; a file that arrives is whole and read as one text."""
    return parse_marked_blocks(spark.readStream.text(folder, wholetext=True), "value")


def with_event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Zone-less timestamps as UTC instants, which watermarks need."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def dedupe_stream(df: DataFrame, keys: list[str], watermark: str = "1 hour", ts: str = "ts") -> DataFrame:
    """First event per key. State is dropped once the watermark has passed a key's first event."""
    if not df.isStreaming:
        return df.dropDuplicates(keys)
    return df.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


def run_status(events: DataFrame, run: str = "run_id", type_: str = "type", cost: str = "cost", ts: str = "ts",
               seq: str = "seq", done: tuple[str, ...] = DONE, node_type: str = "node_code") -> DataFrame:
    """Per run: cost so far, events, node events and the last terminal event (NULL while running).

    Works on batch and streaming frames. All parts have a map-side half.
    """
    end = F.when(F.col(type_).isin(*done), F.col(type_))
    when = F.when(F.col(type_).isin(*done), F.struct(F.col(ts), F.col(seq)))
    return events.groupBy(run).agg(
        F.sum(F.coalesce(F.col(cost), F.lit(0.0))).alias("cost_usd"),
        F.count(F.lit(1)).alias("events"),
        F.count(F.when(F.col(type_) == node_type, 1)).alias("nodes"),
        F.max_by(end, when).alias("status"),
    )


STATUS = "cost_usd double, events long, nodes long, status string, ended boolean"


def run_status_until(events: DataFrame, timeout_s: int, run: str = "run_id", type_: str = "type", cost: str = "cost", ts: str = "ts",
                     seq: str = "seq", done: tuple[str, ...] = DONE, node_type: str = "node_code", late_s: int = 0) -> DataFrame:
    """`run_status` of a stream with bounded state: a run ends `timeout_s` seconds after its last event.

    One row per run in every batch that has events of it, and a last one with `ended` when its
    time is up: the status is then "timeout" if no terminal event came, and its state is dropped. Time
    is event time; rows more than `late_s` seconds behind the latest one are late and dropped, out of
    order ones within that count. A run that speaks again after its end starts anew. Needs the RocksDB state store.
    """
    key = events.schema[run].dataType.simpleString()
    rows = events.withWatermark(ts, f"{late_s} seconds").select(
        F.col(run).alias("run"), F.col(ts).alias("ts"), F.col(seq).cast("long").alias("seq"), F.coalesce(F.col(cost).cast("double"), F.lit(0.0)).alias("cost"),
        (F.col(type_) == node_type).alias("node"), F.when(F.col(type_).isin(*done), F.col(type_)).alias("end"),
    )
    out = rows.groupBy("run").transformWithStateInPandas(_run_processor(timeout_s * 1000), f"run {key}, {STATUS}", "update", "eventTime")
    return out.withColumnRenamed("run", run)


def _run_processor(timeout_ms: int) -> StatefulProcessor:
    """Status of one run; a small class made here, so that workers get it with the stream and need no package."""

    class Status(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            kinds = "cost double, events long, nodes long, status string, end_ms long, end_seq long, last_ms long"
            self.state = handle.getValueState("run", kinds)

        def handleInputRows(self, key, rows, timerValues):
            cost, events, nodes, status, end_ms, end_seq, last = self.state.get() or (0.0, 0, 0, None, None, None, None)
            before = last
            for part in rows:
                ms = part["ts"].astype("datetime64[ms]").astype("int64")
                cost, events, nodes = cost + float(part["cost"].sum()), events + len(part), nodes + int(part["node"].fillna(False).sum())
                last = int(ms.max()) if last is None else max(last, int(ms.max()))
                for at, nth, end in zip(ms, part["seq"], part["end"], strict=True):
                    if end is not None and (end_ms is None or (int(at), int(nth)) > (end_ms, end_seq)):
                        status, end_ms, end_seq = end, int(at), int(nth)
            if before is not None:
                self.handle.deleteTimer(before + timeout_ms)
            self.handle.registerTimer(last + timeout_ms)
            self.state.update((cost, events, nodes, status, end_ms, end_seq, last))
            yield pd.DataFrame({"run": [key[0]], "cost_usd": [cost], "events": [events], "nodes": [nodes], "status": [status], "ended": [False]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            cost, events, nodes, status, *_ = self.state.get()
            self.state.clear()
            yield pd.DataFrame({"run": [key[0]], "cost_usd": [cost], "events": [events], "nodes": [nodes], "status": [status or "timeout"], "ended": [True]})

        def close(self) -> None:
            pass

    return Status()


def write_updates(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Update-mode sink: every micro-batch adds its changed rows with the batch number.

    A repeated batch overwrites its own folder, so a restart does not double rows.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The current row per key of an update sink."""
    return latest_per_key(spark.read.parquet(path), keys, "batch").drop("batch")


def write_append(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet")
    return (writer.trigger(availableNow=True) if once else writer).start(path)


def replay(events: DataFrame, key: str | None = None, run: str = "run_id", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Stored events of a run (or all runs) in order, numbered from 1 inside each run."""
    from featureflow.operators.windows import running

    chosen = events.where(F.col(run) == key) if key is not None else events
    numbered = running(chosen, [run], list(order), {"step": ("count", F.lit(1))})
    return numbered.orderBy(run, "step")


def run_profile(events: DataFrame, run: str = "run_id", stage: str = "stage", ms: str = "ms",
                stages: tuple[str, ...] = ("prepare", "exec", "post", "emit")) -> DataFrame:
    """One row per run with the milliseconds of every stage and their total."""
    sums = [F.sum(F.when(F.col(stage) == s, F.col(ms))).alias(f"{s}_ms") for s in stages]
    return events.where(F.col(stage).isin(*stages)).groupBy(run).agg(*sums, F.sum(ms).alias("total_ms"))


def slowest_stage(profile: DataFrame, stages: tuple[str, ...] = ("prepare", "exec", "post", "emit")) -> DataFrame:
    """The stage that took longest in each run."""
    best = F.greatest(*[F.coalesce(F.col(f"{s}_ms"), F.lit(-1.0)) for s in stages])
    hit = F.coalesce(*[F.when(F.coalesce(F.col(f"{s}_ms"), F.lit(-1.0)) == best, F.lit(s)) for s in stages])
    return profile.withColumn("slowest", hit)

