"""Training order: token sequences in a keyed random order, in shards of fixed-stride records.

Documents become ids (end id after each), each task cuts its ids into sequences of
`length` ids, the last one filled up with the end id, and sequences are numbered without
gaps over all tasks. A keyed Feistel network over the smallest even number of bits that
holds all numbers, walked on until the result is a number in use, is a permutation of
the n numbers: it gives every sequence its slot without sorting or shuffling keys,
and its inverse says which sequence a slot holds.

Slots are cut into ranges of `per_shard`; each range is one file of records of
2 * length bytes (little-endian unsigned 16-bit ids) and a closing byte, in slot
order. On their way records that go to the same shard are compressed together. Slot s lies in shard s div per_shard at byte (s mod per_shard) * stride, so reading goes
on anywhere. Spark's text writer writes the records, with its commit protocol, to any
file system.

Defined results: a NULL text counts as empty and gives the end id alone; repeated rows
follow one another; an empty table gives no sequence and no shard; vocabularies
beyond 65,536 ids are refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featureflow.llm.common import batch_rows, with_package
from featureflow.llm.tokens import default_paths, encoder
from featureflow.session import scratch_dir, stage, tidy

LENGTH = 2048
PER_SHARD = 2048
#: Records that a task holds to compress those of a shard together.
HELD = 8192
#: Rows that the JVM and a Python worker hand each other at once: texts, records or blocks of some 100 records.
TEXTS, RECORDS = 512, 64
#: Bytes of compressed blocks that leave a task at once, and of a row group of sequences.
SENT, GROUP = 1 << 20, 16 << 20
END_ID = 1
KEY = 20240229
ROUNDS = 6
_CLOSE = 10  # the byte after each record

SEQUENCES = "task long, nth long, doc_ids array<long>, first_start long, n_ids long, ids_crc32 long, record binary"


def _mixed(x: np.ndarray, key: int, nth: int) -> np.ndarray:
    """A 64-bit hash of the half block under the round's key."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((key * 0x9E3779B97F4A7C15 + (nth + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _network(x: np.ndarray, half: int, key: int, back: bool) -> np.ndarray:
    low = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & low
    for nth in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if back:
            left, right = right ^ (_mixed(left, key, nth) & low), left
        else:
            left, right = right, left ^ (_mixed(right, key, nth) & low)
    return (left << np.uint64(half)) | right


def slots(numbers: np.ndarray, n: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """The slots of sequence numbers among n, or (`back`) the numbers that slots hold."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    out = _network(numbers.astype(np.uint64), half, key, back)
    while (over := out >= np.uint64(n)).any():
        out[over] = _network(out[over], half, key, back)
    return out.astype(np.int64)


def sequences(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None) -> DataFrame:
    """The ids of `docs` in records of `length` ids, numbered (task, nth)."""
    paths = (tokenizer, None) if tokenizer else default_paths()
    fields = [f.strip().split(" ")[0] for f in SEQUENCES.split(", ")]

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, enc = TaskContext.get().partitionId(), encoder(*paths)
        out: list[tuple] = []
        nth, held, owners, start, size = 0, [], [], 0, 0  # of the sequence at hand

        def close() -> None:
            nonlocal nth, held, owners, size
            ids = np.concatenate(held)
            if len(ids) and int(ids.max()) > 0xFFFF:
                raise ValueError("ids beyond 16 bits")
            full = np.full(length, END_ID, dtype="<u2")
            full[: len(ids)] = ids
            raw = full.tobytes()
            out.append((task, nth, owners, start, len(ids), crc32(raw), raw))
            nth, held, owners, size = nth + 1, [], [], 0

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                    ids, at = np.append(ids, np.uint32(END_ID)), 0
                    while at < len(ids):
                        if not size:
                            start = at
                        take = min(length - size, len(ids) - at)
                        held.append(ids[at : at + take])
                        owners.append(doc_id)
                        size, at = size + take, at + take
                        if size == length:
                            close()
                if len(out) >= 256:
                    yield to_batch(out)
                    out.clear()
        if size:
            close()
        if out:
            yield to_batch(out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_package(rows).mapInArrow(run, SEQUENCES)


def _slot(number: Column, n: int, key: int) -> Column:
    @F.pandas_udf("long")
    def slot(numbers: pd.Series) -> pd.Series:
        return pd.Series(slots(numbers.to_numpy(np.uint64), n, key))

    return slot(number)


def numbered(made: DataFrame) -> tuple[DataFrame, int]:
    """Staged sequences with `number`, without gaps over all tasks, and how many there are."""
    sizes = made.groupBy("task").agg(F.max("nth").alias("last")).orderBy("task").collect()  # a row per task
    first, n = [(-1, 0)], 0
    for row in sizes:
        first.append((row["task"], n))
        n += row["last"] + 1
    starts = made.sparkSession.createDataFrame(first, "task long, first long")
    own = [c for c in made.columns if c not in ("task", "nth")]
    return made.join(F.broadcast(starts), "task").select((F.col("first") + F.col("nth")).alias("number"), *own), n


def stride(length: int = LENGTH) -> int:
    return 2 * length + 1


def _blocks(n: int, key: int, per_shard: int):
    """Records on their way to the same shard, compressed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdCompressor

        press, kinds = ZstdCompressor(level=3), (pa.int64(), pa.binary(), pa.binary())
        numbers: list[np.ndarray] = []
        records: list[bytes] = []

        def to_batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "slots", "block"])

        def flush() -> Iterator[pa.RecordBatch]:
            at = slots(np.concatenate(numbers).astype(np.uint64), n, key)
            order = np.argsort(at, kind="stable")
            cuts = np.flatnonzero(np.diff(at[order] // per_shard)) + 1
            rows, size = [], 0
            for part in np.split(order, cuts):
                whole = press.compress(b"".join([records[i] for i in part.tolist()]))
                rows.append((int(at[part[0]]) // per_shard, at[part].tobytes(), whole))
                size += len(whole)
                if size >= SENT:
                    yield to_batch(rows)
                    rows, size = [], 0
            if rows:
                yield to_batch(rows)
            numbers.clear()
            records.clear()

        for batch in batches:
            numbers.append(batch.column(0).to_numpy())
            records += batch.column(1).to_pylist()
            if len(records) >= HELD:
                yield from flush()
        if records:
            yield from flush()

    return run


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from zstandard import ZstdDecompressor

    open_ = ZstdDecompressor()
    for batch in batches:
        for shard, raw, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at = np.frombuffer(raw, dtype=np.int64)
            whole = open_.decompress(block)
            size = len(whole) // len(at)
            records = [whole[i : i + size] for i in range(0, len(whole), size)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard)), pa.array(at), pa.array(records, pa.binary())], ["shard", "slot", "record"])


def write_shards(rows: DataFrame, n: int, path: str, per_shard: int = PER_SHARD, key: int = KEY) -> None:
    """One file of fixed-stride records in each folder shard=k below `path`; `rows` has number and record."""
    sent = with_package(rows.select("number", "record")).mapInArrow(_blocks(n, key, per_shard), "shard long, slots binary, block binary")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    got = sent.repartition(tasks, "shard").mapInArrow(_records, "shard long, slot long, record binary")
    got = got.sortWithinPartitions("shard", "slot").select("shard", F.col("record").cast("string").alias("record"))
    with batch_rows(rows.sparkSession, RECORDS):
        got.write.partitionBy("shard").option("lineSep", chr(_CLOSE)).option("compression", "none").text(path)


def read_shards(spark, path: str, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """slot, shard, byte offset and CRC of every record, read from the files by place alone."""
    step = stride(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = int(name.split("shard=")[1].split("/")[0])
                at = np.arange(len(raw) // step)
                if len(raw) % step or any(raw[(i + 1) * step - 1] != _CLOSE for i in at.tolist()):
                    raise ValueError(f"{name}: not a whole number of records")
                sums = [crc32(raw[i * step : (i + 1) * step - 1]) for i in at.tolist()]
                data = [at + shard * per_shard, np.full(len(at), shard), at * step, np.array(sums, dtype=np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in data], ["slot", "shard", "byte_offset", "stored_crc32"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return with_package(files.select("path", "content")).mapInArrow(run, "slot long, shard long, byte_offset long, stored_crc32 long")


@tidy
def materialise(docs: DataFrame, path: str | None = None, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, tokenizer: str | None = None) -> DataFrame:
    """Writes the shards and returns a row per sequence: what it holds and where it lies, with the CRC read back."""
    spark = docs.sparkSession
    folder = f"{scratch_dir(spark)}/training-order-{uuid.uuid4().hex}"
    # written once, so that numbers can't change when a task is repeated
    with batch_rows(spark, TEXTS):
        sequences(docs, length, tokenizer).write.option("compression", "zstd").option("parquet.block.size", GROUP).parquet(f"{folder}/sequences")
    made, n = numbered(spark.read.parquet(f"{folder}/sequences"))
    path = path or f"{folder}/shards"
    shown = made.select("number", _slot(F.col("number"), max(n, 1), key).alias("slot"), "doc_ids", "first_start", "n_ids", "ids_crc32")
    if not n:
        found = spark.createDataFrame([], "slot long, shard long, byte_offset long, stored_crc32 long")
    else:
        write_shards(made, n, path, per_shard, key)
        with batch_rows(spark, 1):  # a row is a whole shard
            found = stage(read_shards(spark, path, length, per_shard))
    return with_package(shown).join(found, "slot").select("number", "slot", "shard", "byte_offset", "doc_ids", "first_start", "n_ids", "ids_crc32", "stored_crc32")
