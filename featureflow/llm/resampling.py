"""Importance resampling towards a target distribution, ranked by a distributed radix sort.

Every text becomes an array of hashed features (runs of `grams` words). The counts of a
feature's bucket among all documents and among all target texts give the bucket a gain, the
log of the ratio of their smoothed shares; a document's weight is the sum of the
gains of its array. Gumbel noise from a keyed digest of the doc_id is added, so that the highest scores are
a draw without replacement in proportion to the weights' exponentials.

Scores are ranked by a least-significant-digit radix sort over (score descending, doc_id
ascending). Rows are numbered; a block holds up to 2^16 consecutive numbers. One pass per digit
counts the rows of each (block, digit), turns the counts into global offsets by prefix sums (all smaller
digits, then the same digit in earlier blocks) and lets each block place its rows
by a stable counting sort: a row's offset plus its turn is its number in the next pass.
Digits on which all rows agree are left out. After the last pass the number is the rank.

Defined results: NULL text has no words, so weight 0, and is never drawn; a NULL doc_id draws
noise as the empty string and comes after all others at equal score; rows that
repeat a doc_id and text count one by one, and tie in any order; no target texts leave only the
smoothing; an empty table gives no rows. Very long texts count whole. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from featureflow.llm.common import with_package
from featureflow.session import remove_path, stage, staged_path, tidy

#: Bits of the numbers within a block, least and most, and of one digit: a block meets at most 2^DIGIT offsets.
BLOCK_BITS = (10, 16)
DIGIT = 11

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class Draw:
    """Feature lengths, buckets, least words of a document that may be drawn, percentage drawn, seed."""

    least_gram: int = 1
    most_gram: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: int = 2024


def features(text: bytes | None, draw: Draw) -> tuple[int, np.ndarray]:
    """Number of words and the bucket of every feature, repeats counted."""
    words = _WORD.findall((text or b"").lower())  # of bytes: only A-Z change, and all bytes beyond ASCII belong to words
    found = list(words) if draw.least_gram == 1 else []
    for n in range(max(2, draw.least_gram), draw.most_gram + 1):
        found += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return len(words), np.fromiter((crc32(w) % draw.buckets for w in found), dtype="<u4", count=len(found))


def hashed(texts: DataFrame, draw: Draw) -> DataFrame:
    """doc_id, n_words and `own`, the buckets of all features in the narrowest whole numbers."""
    kind = "<u2" if draw.buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t, draw) for t in batch.column(1).to_pylist()]
            own = pa.array([b.astype(kind).tobytes() for _, b in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), own], ["doc_id", "n_words", "own"])

    return with_package(texts).mapInArrow(run, "doc_id long, n_words long, own binary")


def bucket_counts(rows: DataFrame, draw: Draw) -> np.ndarray:
    """Features in every bucket. The driver gets one row per bucket, whose number is a parameter."""
    kind = "<u2" if draw.buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(draw.buckets, dtype=np.int64)
        for batch in batches:
            whole = b"".join(batch.column(0).to_pylist())
            total += np.bincount(np.frombuffer(whole, dtype=kind), minlength=draw.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    found = with_package(rows.select("own")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(draw.buckets, dtype=np.int64)
    for r in found:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of the buckets' smoothed shares."""
    n, all_s, all_t = len(source), int(source.sum()), int(target.sum())
    return np.array([floor(1000 * log((int(t) + 1) * (all_s + n) / ((int(s) + 1) * (all_t + n)))) for s, t in zip(source, target, strict=True)], dtype=np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return floor(-1000 * log(-log((h + 0.5) / 4294967296)))


def scored(rows: DataFrame, gain: np.ndarray, draw: Draw) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""
    kind = "<u2" if draw.buckets <= 1 << 16 else "<u4"
    names = ["doc_id", "n_words", "n_features", "weight", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(b, dtype=kind) for b in batch.column(2).to_pylist()]
            weight = np.array([int(gain[b].sum()) for b in own], dtype=np.int64)
            moved = np.array([noise(d, draw.seed) for d in batch.column(0).to_pylist()], dtype=np.int64)
            counts = pa.array([len(b) for b in own], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts, pa.array(weight), pa.array(weight + moved)], names)

    return with_package(rows).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _digits(name: str, least: int, most: int) -> list[Column]:
    """Digits of a long with its sign bit turned, lowest first, up to the highest bit on which the rows differ."""
    width = ((least ^ most) & ((1 << 64) - 1)).bit_length()
    turned = F.col(name).bitwiseXOR(F.lit(-(1 << 63)))
    return [F.shiftrightunsigned(turned, at).bitwiseAND(F.lit((1 << DIGIT) - 1)).cast("int") for at in range(0, width, DIGIT)]


def radix_ranks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`rows`, staged, with `number`, from 0, in the ascending order of the longs `keys` (none NULL)."""
    current = stage(rows.withColumn("number", F.monotonically_increasing_id()))
    sides = [f(k).alias(f"{n}{i}") for i, k in enumerate(keys) for n, f in (("lo", F.min), ("hi", F.max))]
    bounds = current.select(F.count(F.lit(1)).alias("n"), *sides).first()
    spread = bounds.n // (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bits = min(max(spread.bit_length(), BLOCK_BITS[0]), BLOCK_BITS[1])
    digits = [d for i, k in reversed(list(enumerate(keys))) if bounds.n for d in _digits(k, bounds[f"lo{i}"], bounds[f"hi{i}"])]
    for digit in digits or [F.lit(0)]:
        current = _counting_pass(current, digit, bits)
    return current


def _counting_pass(rows: DataFrame, digit: Column, bits: int) -> DataFrame:
    """One stable pass over staged rows: they get the numbers they have when sorted by `digit`."""
    before = staged_path(rows)
    schema = rows.schema
    rows = rows.select("*", F.shiftright("number", bits).alias("block"), digit.alias("digit"))
    counts = stage(rows.groupBy("block", "digit").agg(F.count(F.lit(1)).alias("n")))
    earlier = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    smaller = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)  # one row per digit: 2^DIGIT at most
    totals = counts.groupBy("digit").agg(F.sum("n").alias("n"))
    bases = totals.select("digit", F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("base"))
    offsets = counts.select("block", "digit", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead")).join(F.broadcast(bases), "digit")
    offsets = offsets.select("block", "digit", (F.col("base") + F.col("ahead")).alias("offset"))
    out = stage(rows.groupBy("block").cogroup(offsets.groupBy("block")).applyInArrow(_placed, schema), replaces=before)
    remove_path(rows.sparkSession, staged_path(counts))
    return out


def _placed(rows: pa.Table, offsets: pa.Table) -> pa.Table:
    """A block's rows with their new numbers: a stable counting sort."""
    rows = rows.combine_chunks()
    number = rows.column("number").to_numpy()
    order = np.argsort(number, kind="stable")
    digit = rows.column("digit").to_numpy()[order].astype(np.int64)
    start = np.zeros(1 << DIGIT, dtype=np.int64)
    start[offsets.column("digit").to_numpy()] = offsets.column("offset").to_numpy()
    count = np.bincount(digit, minlength=1 << DIGIT)
    within = np.cumsum(count) - count
    by_digit = np.argsort(digit, kind="stable")  # rows of a digit in their order
    turn = np.empty(len(digit), dtype=np.int64)
    turn[by_digit] = np.arange(len(digit)) - within[digit[by_digit]]
    new = np.empty(len(digit), dtype=np.int64)
    new[order] = start[digit] + turn
    return rows.drop_columns(["block", "digit", "number"]).append_column("number", pa.array(new))


@tidy
def resample(docs: DataFrame, target: DataFrame, draw: Draw = Draw()) -> DataFrame:
    """Every document's features, weight, score and rank; rank is NULL where it isn't drawn."""
    texts = lambda df, key: df.select(key, F.col("text").cast("string").cast("binary").alias("text"))
    source = stage(hashed(texts(docs, F.col("doc_id").cast("long").alias("doc_id")), draw))
    wanted = hashed(texts(target, F.lit(0).cast("long").alias("doc_id")), draw)
    gain = gains(bucket_counts(source, draw), bucket_counts(wanted, draw))
    rows = stage(scored(source, gain, draw), replaces=staged_path(source))
    able = F.col("n_words") >= draw.least_words
    # descending scores: the complement ascends
    sorted_by = [F.bitwise_not("score").alias("k0"), F.col("doc_id").isNull().cast("long").alias("k1"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("k2")]
    ranked = radix_ranks(rows.where(able).select("*", *sorted_by), ["k0", "k1", "k2"])
    drawn = draw.percent * ranked.count() // 100
    kept = ["doc_id", "n_features", "weight", "score"]
    rank = F.when(F.col("number") < drawn, F.col("number") + 1)
    return ranked.select(*kept, rank.alias("rank")).unionByName(rows.where(~able).select(*kept, F.lit(None).cast("long").alias("rank")))


def resample_sql(draw: Draw = Draw()) -> str:
    """The query's result for single words in DuckDB's SQL; CRC-32 by bytes over the distinct words."""
    if (draw.least_gram, draw.most_gram) != (1, 1):
        raise ValueError("the SQL knows single words only")
    step = lambda x: f"(CASE WHEN ({x}) & 1 = 1 THEN xor(({x}) >> 1, 3988292384) ELSE ({x}) >> 1 END)"
    return rf"""
WITH RECURSIVE z(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, {step('c')} FROM z WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM z WHERE k = 8),
w AS (SELECT 0 AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
      UNION ALL SELECT 1, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
e AS (SELECT side, doc_id, unnest(ws) AS w FROM w),
u AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM e),
b AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % {draw.buckets} AS bucket FROM u, tab),
f AS (SELECT side, doc_id, bucket, count(*) AS n FROM e JOIN b USING (w) GROUP BY ALL),
g AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM f GROUP BY 1),
tot AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM g),
gain AS (SELECT bucket, floor(1000 * ln((g.t + 1)::DOUBLE * (tot.s + {draw.buckets}) / ((g.s + 1)::DOUBLE * (tot.t + {draw.buckets})))) AS gain FROM g, tot),
we AS (SELECT doc_id, sum(n * gain) AS weight FROM f JOIN gain USING (bucket) WHERE side = 0 GROUP BY 1),
d AS (SELECT w.doc_id, len(ws) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        ('0x' || substr(sha256('{draw.seed}:' || w.doc_id), 1, 8))::BIGINT AS h FROM w LEFT JOIN we USING (doc_id) WHERE side = 0),
sc AS (SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296::DOUBLE))))::BIGINT AS score FROM d),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM sc WHERE n_features >= {draw.least_words})
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= {draw.percent} * n // 100 THEN rank END::BIGINT AS rank FROM sc LEFT JOIN r USING (doc_id)"""
